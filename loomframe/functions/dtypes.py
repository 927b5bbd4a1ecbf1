"""Types: names, promotion, casts, inference, and the lists of time layouts."""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidDType, ParseError

#: Names of types and the Spark types that hold them.
NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "int": T.LongType(), "int64": T.LongType(), "Int64": T.LongType(), "int8": T.ByteType(),
    "int16": T.ShortType(), "int32": T.IntegerType(), "uint8": T.LongType(), "uint16": T.LongType(), "uint32": T.LongType(), "uint": T.LongType(),
    "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "float": T.DoubleType(), "string": T.StringType(), "str": T.StringType(),
    "bytes": T.BinaryType(), "datetime64": T.TimestampNTZType(), "datetime64[ns]": T.TimestampNTZType(), "datetime64[us]": T.TimestampNTZType(),
    "datetime64[ms]": T.TimestampNTZType(), "datetime64[s]": T.TimestampNTZType(), "timedelta64": T.DayTimeIntervalType(), "object": T.StringType(),
}
#: Layouts that casts and CSV dates try, in order (month first). Seconds may have a fraction of any length.
CAST_LAYOUTS = ("yyyy-MM-ddTHH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")
#: Layouts that parsing, comparisons and labels try, in order (day first, then month first).
PARSE_LAYOUTS = ("yyyy-MM-ddTHH:mm:ssXXX", "yyyy-MM-ddTHH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy")
#: Strftime directives and the patterns that stand for them.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "z": "xx", "%": "'%'"}
TRUE, FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")

_INTEGERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def parse(name: str | T.DataType) -> T.DataType:
    if isinstance(name, T.DataType):
        return name
    if name not in NAMES:
        raise InvalidDType(f"unknown type {name!r}")
    return NAMES[name]


def name_of(t: T.DataType) -> str:
    names = {T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.StringType: "string", T.BinaryType: "bytes", T.TimestampNTZType: "datetime64", T.TimestampType: "datetime64", T.DateType: "datetime64"}
    return names.get(type(t), "object")


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: wider integer, float64 with a float, string (object) where text or time meets another kind."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.BooleanType) and isinstance(b, T.NumericType):
        return b
    if isinstance(b, T.BooleanType) and isinstance(a, T.NumericType):
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if a in _INTEGERS and b in _INTEGERS:
            return max(a, b, key=_INTEGERS.index)
        return T.DoubleType()
    return T.StringType()


def promote_all(kinds: list[T.DataType]) -> T.DataType:
    return reduce(promote, kinds)


def strftime(layout: str) -> str:
    """A Spark pattern for a strftime layout; unknown or dangling directives are refused."""
    out, i, text = [], 0, ""
    while i < len(layout):
        c = layout[i]
        i += 1
        if c == "%":
            d = layout[i : i + 1]
            i += 1
            if d == "f":
                if not text.endswith("."):
                    raise ParseError("%f must follow a dot")
                out[-1:] = ["[.SSSSSS][.SSS]"]
            elif d in DIRECTIVES and d:
                out.append(DIRECTIVES[d])
            else:
                raise ParseError(f"unknown directive %{d}")
            text = ""
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            text = c
    return "".join(out)


#: What stands in a text for each field of a layout. The hour may have one digit, a fraction follows a dot or a comma.
_FIELDS = {"yyyy": "([0-9]{4})", "MM": "([0-9]{2})", "dd": "([0-9]{2})", "HH:mm:ss": "([0-9]{1,2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,6})[0-9]*)?", "XXX": "(Z|[+-](?:[01][0-9]|2[0-4]):[0-5][0-9])"}


@lru_cache
def _form(layout: str) -> tuple[str, dict[str, int]]:
    """The expression that the texts of a layout match as a whole, and the numbers of its groups."""
    at: dict[str, int] = {}

    def field(m: re.Match) -> str:
        at[m.group()] = len(at) + 1
        if m.group() == "HH:mm:ss":
            at["fraction"] = len(at) + 1
        return _FIELDS[m.group()]

    return re.sub("yyyy|MM|dd|HH:mm:ss|XXX", field, layout), at


def _read_time(c: Column, layout: str) -> Column:
    """The text's form is tested first, so what doesn't fit costs no exception; then one cast reads it."""
    form, at = _form(layout)
    form = rf"\A{form}\z"
    plain = f"${at['yyyy']}-${at['MM']}-${at['dd']}"
    if "HH:mm:ss" in at:
        plain += f" ${at['HH:mm:ss']}"
    got = F.regexp_replace(c, form, plain).try_cast("timestamp_ntz")
    if "fraction" in at:
        got = F.timestamp_add("MICROSECOND", F.rpad(F.regexp_extract(c, form, at["fraction"]), 6, "0").cast("int"), got)
    if "XXX" in at:
        zone = F.regexp_extract(c, form, at["XXX"])
        minutes = F.when(zone == "Z", 0).otherwise(F.substring(zone, 1, 3).try_cast("int") * 60 + F.concat(F.substring(zone, 1, 1), F.substring(zone, 5, 2)).try_cast("int"))
        got = F.timestamp_add("MINUTE", -minutes, got)
    return F.when(c.rlike(form), got)


def parse_time(c: Column, layouts=PARSE_LAYOUTS) -> Column:
    """The time by the first layout that fits the whole text, in UTC if it names its zone; NULL if none fits. Fractions
    are cut to microseconds."""
    return F.coalesce(*[_read_time(c, x) for x in layouts])


def time_of(text: str, layouts=CAST_LAYOUTS) -> dt.datetime:
    """A single text as parse_time reads it, by the layouts of casts unless others are given."""
    for layout in layouts:
        form, at = _form(layout)
        if m := re.fullmatch(form, text):
            clock = map(int, m[at["HH:mm:ss"]].split(":")) if "HH:mm:ss" in at else (0, 0, 0)
            micros = int((m[at["fraction"]] or "").ljust(6, "0")) if "fraction" in at else 0
            zone = m[at["XXX"]] if "XXX" in at else "Z"
            minutes = 0 if zone == "Z" else int(zone[:3]) * 60 + int(zone[0] + zone[4:])
            try:
                return dt.datetime(*(int(m[at[k]]) for k in ("yyyy", "MM", "dd")), *clock, micros) - dt.timedelta(minutes=minutes)
            except (ValueError, OverflowError):
                continue
    raise ParseError(f"{text!r} is not a time in any of {len(layouts)} layouts")


def cast(c: Column, have: T.DataType, want: T.DataType, strict: bool = True) -> Column:
    """Missing passes through; text to bool takes the words of TRUE and FALSE; text to int takes integer literals only;
    floats are truncated. A value that can't be cast raises when strict and is missing otherwise."""
    if have == want:
        return c
    if isinstance(have, T.StringType) and isinstance(want, T.BooleanType):
        low = F.lower(F.trim(c))
        got = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    elif isinstance(have, T.StringType) and want in _INTEGERS:
        got = F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast(want))
    elif isinstance(have, T.StringType) and isinstance(want, (T.TimestampNTZType, T.TimestampType)):
        got = parse_time(c, CAST_LAYOUTS).cast(want)
    elif isinstance(have, T.BooleanType) and isinstance(want, T.StringType):
        return F.when(c, "true").when(~c, "false")
    elif isinstance(have, T.BooleanType):
        return c.cast("int").cast(want)
    elif isinstance(have, (T.TimestampNTZType, T.TimestampType)) and isinstance(want, T.NumericType):
        raise InvalidDType("times can't be cast to numbers")
    else:
        got = c.try_cast(want)
    if not strict:
        return got
    shown = F.concat(F.lit("can't cast "), F.coalesce(c.cast("string"), F.lit("")))
    return F.when(c.isNotNull() & got.isNull(), F.raise_error(shown).cast(want)).otherwise(got)


def infer_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns as int, float or bool where every value that is there is one; int with float is float; else text.

    One aggregation counts, for all columns at once, how many values each type takes.
    """
    columns = columns if columns is not None else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df
    whole = lambda c: c.rlike(r"^[+-]?[0-9]{1,18}$")
    real = lambda c: c.try_cast("double").isNotNull() & ~c.rlike(r"[fFdD]$")
    logic = lambda c: F.lower(c).isin("true", "false")
    found = df.agg(*[F.count_if(test(df[c])).alias(f"{k}{i}") for i, c in enumerate(columns) for k, test in (("i", whole), ("r", real), ("b", logic))], *[F.count(df[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    casts = {}
    for i, c in enumerate(columns):
        n = found[f"n{i}"]
        if n and found[f"i{i}"] == n:
            casts[c] = df[c].cast("long")
        elif n and found[f"r{i}"] == n:
            casts[c] = df[c].cast("double")
        elif n and found[f"b{i}"] == n:
            casts[c] = F.lower(df[c]).cast("boolean")
    return df.withColumns(casts) if casts else df
