"""Text accessor. A missing value stays missing; lengths are in bytes, positions in code points."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import ParseError, TypeMismatch

if TYPE_CHECKING:
    from loomframe.operators.series import Series

SPACE = r"[\p{IsWhite_Space}]+"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}", ""), f"{SPACE}$", "")


def substring(c: Column, start: int | None, stop: int | None) -> Column:
    """Code points [start, stop) with negative positions counted from the end."""
    n = F.length(c)
    at = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    a = at(start or 0)
    b = n if stop is None else at(stop)
    return F.substr(c, a + 1, F.greatest(b - a, F.lit(0)))


class Text:
    def __init__(self, series: Series):
        if not isinstance(series.field.dataType, T.StringType):
            raise TypeMismatch("the text accessor needs text")
        self.s, self.c = series, series.column

    def contains(self, text: str) -> Series:
        return self.s._new(self.c.contains(text))

    def startswith(self, text: str) -> Series:
        return self.s._new(self.c.startswith(text))

    def endswith(self, text: str) -> Series:
        return self.s._new(self.c.endswith(text))

    def lower(self) -> Series:
        return self.s._new(F.lower(self.c))

    def upper(self) -> Series:
        return self.s._new(F.upper(self.c))

    def len(self) -> Series:
        return self.s._new(F.octet_length(self.c).cast("long"))

    def strip(self) -> Series:
        return self.s._new(strip(self.c))

    def replace(self, old: str, new: str) -> Series:
        return self.s._new(F.replace(self.c, F.lit(old), F.lit(new)))

    def split(self, sep: str) -> Series:
        return self.s._new(F.split(self.c, re.escape(sep)))

    def match(self, pattern: str) -> Series:
        return self.s._new(self.c.rlike(f"^(?:{_checked(pattern)})"))

    def contains_regex(self, pattern: str) -> Series:
        return self.s._new(self.c.rlike(_checked(pattern)))

    def replace_regex(self, pattern: str, new: str) -> Series:
        return self.s._new(F.regexp_replace(self.c, _checked(pattern), new))

    def get(self, i: int) -> Series:
        n = F.length(self.c)
        inside = (n > i) if i >= 0 else (n >= -i)
        return self.s._new(F.when(inside, F.substr(self.c, F.lit(i + 1) if i >= 0 else n + (i + 1), F.lit(1))))

    def slice(self, start: int | None, stop: int | None = None) -> Series:
        return self.s._new(substring(self.c, start, stop))


def _checked(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ParseError(f"bad pattern: {e}") from None
    return pattern
