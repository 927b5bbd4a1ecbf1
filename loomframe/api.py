"""The library's names in one place."""

from loomframe.expr import Expr, col, len_, lit, lower, upper, where
from loomframe.functions.categorical import make as make_categorical
from loomframe.operators.concat import concat
from loomframe.operators.frame import Frame
from loomframe.operators.groupby import group_count, group_size
from loomframe.operators.merge import join, merge
from loomframe.operators.ndarray import NDArray, concatenate, hstack, vstack
from loomframe.operators.resample import resample
from loomframe.operators.reshape import melt, pivot, pivot_table, stack, unstack
from loomframe.operators.series import Series
from loomframe.operators.series import concat as concat_series
from loomframe.sources import read_csv, read_json, read_ndjson, read_parquet, write_csv, write_json, write_ndjson, write_parquet

__all__ = [
    "Expr", "Frame", "NDArray", "Series", "col", "concat", "concat_series", "concatenate", "group_count", "group_size", "hstack", "join", "len_", "lit", "lower", "make_categorical", "melt", "merge",
    "pivot", "pivot_table", "read_csv", "read_json", "read_ndjson", "read_parquet", "resample", "stack", "unstack", "upper", "vstack", "where", "write_csv", "write_json", "write_ndjson", "write_parquet",
]
