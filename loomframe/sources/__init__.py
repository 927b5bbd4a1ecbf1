"""Readers and writers: CSV, JSON in four orients, line-delimited JSON, Parquet."""

from loomframe.sources.csv import read_csv, write_csv
from loomframe.sources.json import read_json, read_ndjson, write_json, write_ndjson
from loomframe.sources.parquet import read_parquet, write_parquet

__all__ = ["read_csv", "read_json", "read_ndjson", "read_parquet", "write_csv", "write_json", "write_ndjson", "write_parquet"]
