"""Parquet, whose scans take filters and column lists from the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from loomframe.operators.frame import Frame


def read_parquet(spark: SparkSession, path: str, order_by: str | Sequence[str] | None = None) -> Frame:
    return Frame.of(spark.read.parquet(path), order_by)


def write_parquet(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    frame.to_spark().write.mode(mode).parquet(path)
