"""JSON documents in the orients records, values, split and columns, and line-delimited JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import NotSupported, ParseError
from loomframe.functions import na
from loomframe.operators.frame import Frame, Key, q
from loomframe.sources.csv import as_text

ORIENTS = ("records", "values", "split", "columns")


def _whole(df: DataFrame) -> DataFrame:
    """Float columns as int where all values that are there are whole and below 1e15; columns without a type as text."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    if floats:
        fits = df.agg(*[F.min((q(c) == F.rint(q(c))) & (F.abs(q(c)) < 1e15)).alias(c) for c in floats]).first()
        df = df.withColumns({c: q(c).cast("long") for c in floats if fits[c]})
    return df


def read_ndjson(spark: SparkSession, path: str) -> Frame:
    """One object a line, blank lines skipped; a bad line is refused. Columns are the sorted keys."""
    return _records(spark.read.option("mode", "FAILFAST").json(path))


def _records(df: DataFrame) -> Frame:
    df = df.select(*[q(c) for c in sorted(df.columns)])
    return Frame(na.nan_to_null(_whole(df)).withColumn("__o0", F.monotonically_increasing_id()), [Key("__o0")])


def read_json(spark: SparkSession, path: str, orient: str = "records") -> Frame:
    """A document in one of the orients. A document is one value, so it is parsed in one task; use read_ndjson for data
    that is large."""
    if orient not in ORIENTS:
        raise NotSupported(f"orient {orient!r}")
    if orient == "records":
        return _records(spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path))
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ParseError(str(e)) from None
    if orient == "values":
        width = max((len(r) for r in data), default=0)
        rows, names = [[*r, *[None] * (width - len(r))] for r in data], [f"column_{i}" for i in range(width)]
    elif orient == "split":
        rows, names = data["data"], data["columns"]
    else:
        names = sorted(data)
        keys = {k for c in data.values() for k in c}
        ordered = sorted(keys, key=int) if all(k.lstrip("-").isdigit() for k in keys) else sorted(keys)
        rows = [[data[c].get(k) for c in names] for k in ordered]
    f = Frame.from_rows(spark, rows, names)
    return Frame(_whole(f.df), f.order)


def _object(frame: Frame) -> Column:
    times = (T.TimestampNTZType, T.TimestampType)
    cells = [(as_text(q(c), frame.schema[c].dataType) if isinstance(frame.schema[c].dataType, times) else q(c)).alias(c) for c in frame.columns]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def write_ndjson(frame: Frame, path: str, mode: str = "errorifexists") -> None:
    """One object a row, in order, in part files."""
    frame.df.orderBy(*[k.column for k in frame.order]).select(_object(frame).alias("value")).write.mode(mode).text(path)


def write_json(frame: Frame, path: str, orient: str = "records", indent: int | None = None, mode: str = "errorifexists") -> None:
    """One document. It is put together on the driver, as a document is one value; use write_ndjson for large frames."""
    if orient not in ORIENTS:
        raise NotSupported(f"orient {orient!r}")
    objects = [json.loads(r[0]) for r in frame.df.orderBy(*[k.column for k in frame.order]).select(_object(frame)).collect()]
    names = frame.columns
    rows = [[o[c] for c in names] for o in objects]
    document = {
        "records": lambda: objects, "values": lambda: rows, "split": lambda: {"columns": names, "index": list(range(len(rows))), "data": rows},
        "columns": lambda: {c: {str(i): r[k] for i, r in enumerate(rows)} for k, c in enumerate(names)},
    }[orient]()
    spark = frame.df.sparkSession
    text = json.dumps(document, indent=indent, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


