"""Streams: the calendar buckets of resample over an unbounded source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.errors import NotSupported

#: Frequencies whose buckets have a fixed length, and that length.
LENGTHS = {"H": "1 hour", "D": "1 day"}


def resample_stream(events: DataFrame, time: str, freq: str, late: str, aggregates: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by key and hour or day; a bucket is closed once the watermark, `late` behind the latest time, passes it."""
    if freq not in LENGTHS:
        raise NotSupported(f"streams have no {freq!r} buckets")
    bucket = F.window(F.col(time), LENGTHS[freq])
    out = events.withWatermark(time, late).groupBy(bucket, *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias(time), *keys, *aggregates)
