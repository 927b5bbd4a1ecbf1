"""Time accessor, and parsing of text and numbers as times."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidOperation, NotSupported, TypeMismatch
from loomframe.functions import dtypes

if TYPE_CHECKING:
    from loomframe.operators.series import Series

UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def to_datetime(c: Column, kind: T.DataType, layout: str | None = None, errors: str = "raise", unit: str | None = None) -> Column:
    """Times from text (by a strftime layout, or the first layout known that fits) or from numbers in a unit.

    What can't be read, the empty text included, raises, or is missing with errors="coerce". Nanoseconds are cut to
    microseconds.
    """
    if errors not in ("raise", "coerce"):
        raise NotSupported(f"errors={errors!r}")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        if unit not in (*UNITS, "ns"):
            raise InvalidOperation("numbers need a unit: s, ms, us or ns")
        micros = F.floor(c / 1000) if unit == "ns" else c * UNITS[unit]
        return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")
    if not isinstance(kind, T.StringType):
        raise TypeMismatch("times are read from text or numbers")
    got = F.try_to_timestamp(c, F.lit(dtypes.strftime(layout))).cast("timestamp_ntz") if layout else dtypes.parse_time(c)
    if errors == "coerce":
        return got
    return F.when(c.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("no time: "), c)).cast("timestamp_ntz")).otherwise(got)


class Times:
    def __init__(self, series: Series):
        if not isinstance(series.field.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            raise TypeMismatch("the time accessor needs times")
        self.s, self.c = series, series.column

    def _long(self, f) -> Series:
        return self.s._new(f(self.c).cast("long"))

    def year(self) -> Series:
        return self._long(F.year)

    def month(self) -> Series:
        return self._long(F.month)

    def day(self) -> Series:
        return self._long(F.dayofmonth)

    def hour(self) -> Series:
        return self._long(F.hour)

    def minute(self) -> Series:
        return self._long(F.minute)

    def second(self) -> Series:
        return self._long(F.second)

    def weekday(self) -> Series:
        """Monday is 0."""
        return self._long(F.weekday)

    def dayofyear(self) -> Series:
        return self._long(F.dayofyear)

    def quarter(self) -> Series:
        return self._long(F.quarter)

    def date(self) -> Series:
        return self.s._new(F.date_trunc("day", self.c).cast("timestamp_ntz"))

    def time(self) -> Series:
        return self.s._new(F.date_format(self.c, "HH:mm:ss"))

    def is_month_start(self) -> Series:
        return self.s._new(F.dayofmonth(self.c) == 1)

    def is_month_end(self) -> Series:
        return self.s._new(self.c.cast("date") == F.last_day(self.c))

    def is_year_start(self) -> Series:
        return self.s._new((F.dayofmonth(self.c) == 1) & (F.month(self.c) == 1))

    def is_year_end(self) -> Series:
        return self.s._new((F.dayofmonth(self.c) == 31) & (F.month(self.c) == 12))
