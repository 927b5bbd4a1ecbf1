"""CSV: read as text in parallel, then typed by one aggregation over the columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import ColumnNotFound
from loomframe.functions import categorical, datetimes, dtypes
from loomframe.operators.frame import Frame, Key, q

#: Cells that mean missing.
MISSING = ("", "NA", "NaN", "null", "NULL", "None")


def read_csv(
    spark: SparkSession, path: str, header: bool = True, sep: str = ",", na_values: Sequence[str] | None = None, keep_default_na: bool = False, infer: bool = True,
    parse_dates: Sequence[str] = (), date_format: str | None = None, trim: bool = False, comment: str | None = None, usecols: Sequence[str] = (), nrows: int | None = None,
    categories: Sequence[str] = (),
) -> Frame:
    """A frame of a CSV file or folder of files, in file order. Short rows are filled with missing values.

    A list of missing cells replaces the default one unless that is kept as well. Without a header columns are called
    column_0, column_1, …. A column that is asked for and isn't there is refused, and so is a date that can't be read.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("inferSchema", False).option("mode", "PERMISSIVE")
    reader = reader.option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').option("multiLine", False)
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    if not header:
        df = df.toDF(*[f"column_{i}" for i in range(len(df.columns))])
    df = df.withColumn("__o0", F.monotonically_increasing_id())
    names = [c for c in df.columns if c != "__o0"]
    if missing := [c for c in (*usecols, *parse_dates, *categories) if c not in names]:
        raise ColumnNotFound(", ".join(missing))
    if usecols:
        names = [c for c in names if c in usecols]
        df = df.select(*map(q, names), "__o0")
    if nrows is not None:
        df = df.orderBy("__o0").limit(nrows)
    gone = [*(MISSING if na_values is None or keep_default_na else ()), *(na_values or ())]
    df = df.withColumns({c: F.when(~q(c).isin(gone), q(c)) for c in names})
    if infer:
        df = dtypes.infer_text(df, [c for c in names if c not in (*parse_dates, *categories)])
    for c in parse_dates:
        if date_format:
            got = datetimes.to_datetime(q(c), T.StringType(), date_format)
        else:
            t = dtypes.parse_time(q(c), dtypes.CAST_LAYOUTS)
            got = F.when(q(c).isNotNull() & t.isNull(), F.raise_error(F.concat(F.lit("no date: "), q(c))).cast("timestamp_ntz")).otherwise(t)
        df = df.withColumn(c, got)
    f = Frame(df, [Key("__o0")])
    for c in categories:
        f = categorical.make(f, c)
    return f


def as_text(c: Column, t: T.DataType) -> Column:
    """A cell as written: whole floats keep .0, times are RFC 3339, missing is empty."""
    if isinstance(t, T.BooleanType):
        out = F.when(c, "true").when(~c, "false")
    elif isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        out = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def write_csv(frame: Frame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists", single: bool = False) -> None:
    """The data columns, without labels, in the frame's order, as a folder of part files (or one part)."""
    df: DataFrame = frame.ordered().select(*[as_text(q(c), frame.schema[c].dataType).alias(c) for c in frame.columns])
    if single:
        df = df.coalesce(1)
    df.write.mode(mode).option("header", header).option("sep", sep).option("emptyValue", "").option("escape", '"').csv(path)


