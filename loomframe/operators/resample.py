"""Calendar buckets of a time label: observed buckets only, ascending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidIndex, InvalidOperation, NotSupported
from loomframe.functions import na
from loomframe.operators.frame import Frame, Key, q
from loomframe.operators.groupby import GroupBy

#: Frequencies and the unit that a time is cut to. ME is labelled by the month's last day.
UNITS = {"H": "hour", "h": "hour", "D": "day", "W": "week", "M": "month", "MS": "month", "ME": "month"}


def bucket(c: Column, freq: str) -> Column:
    """The start of a time's bucket (weeks start on Monday); for ME the last day of its month at 0:00."""
    if freq not in UNITS:
        raise InvalidOperation(f"unknown frequency {freq!r}")
    if freq == "ME":
        return F.last_day(c).cast("timestamp_ntz")
    return F.date_trunc(UNITS[freq], c).cast("timestamp_ntz")


class Resampler:
    """Rows by bucket; rows without a time are left out."""

    def __init__(self, frame: Frame, freq: str):
        if len(frame.index) > 1:
            raise NotSupported("several label columns")
        if not frame.index or not isinstance(frame.df.schema[frame.index[0]].dataType, (T.TimestampNTZType, T.TimestampType)):
            raise InvalidIndex("resampling needs a time label")
        self.frame, self.name = frame, frame.index[0]
        self.bucket = bucket(q(self.name), freq)

    def agg(self, how: str) -> Frame:
        f = self.frame
        names = [c for c in f.columns if how not in ("sum", "mean") or na.is_number(f.schema[c].dataType)]
        time = q(self.name)
        order = [Key(f"__o{i}", k.ascending) for i, k in enumerate(f.order)]
        df = f.df.filter(time.isNotNull()).select(self.bucket.alias("__bucket"), *map(q, names), *[q(k.name).alias(o.name) for k, o in zip(f.order, order, strict=True)])
        made = GroupBy(Frame(df, order), ["__bucket"])._agg([(c, how, c) for c in names])
        return Frame(made.df.withColumnRenamed("__bucket", self.name).select(self.name, *map(q, names)), [Key(self.name)], [self.name])

    def sum(self) -> Frame:
        return self.agg("sum")

    def mean(self) -> Frame:
        return self.agg("mean")

    def count(self) -> Frame:
        return self.agg("count")

    def min(self) -> Frame:
        return self.agg("min")

    def max(self) -> Frame:
        return self.agg("max")

    def first(self) -> Frame:
        return self.agg("first")

    def last(self) -> Frame:
        return self.agg("last")


def resample(frame: Frame, freq: str) -> Resampler:
    return Resampler(frame, freq)
