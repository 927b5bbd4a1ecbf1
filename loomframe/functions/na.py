"""One missing value (NULL) and arithmetic that never raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = float("inf"), float("nan")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of float columns as NULL: frames know a single missing value."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(df[c]), df[c]) for c in floats}) if floats else df


def quiet(c: Column) -> Column:
    """A computed NaN as NULL."""
    return F.when(~F.isnan(c), c)


def fdiv(x: Column, y: Column) -> Column:
    """IEEE division: x/0 is NaN or an infinity, whose sign is that of both (-0.0 is negative)."""
    x, y = x.cast("double"), y.cast("double")
    above = ~y.cast("string").startswith("-")  # tells 0.0 from -0.0, which are equal
    zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when((x > 0) == above, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(F.try_divide(x, y))


def fmod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor."""
    x, y = x.cast("double"), y.cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, F.lit(NAN)).otherwise(F.try_mod(x, y))


def log(x: Column, base: str = "ln") -> Column:
    """Logarithm with log(0) = -inf and NaN below."""
    f = {"ln": F.ln, "log2": F.log2, "log10": F.log10}[base]
    x = x.cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


def round_even(x: Column, digits: int = 0) -> Column:
    """Half to even on the binary double, as scaling and rint give it."""
    scale = F.lit(10.0**digits)
    return F.rint(x.cast("double") * scale) / scale


def is_number(t: T.DataType) -> bool:
    """Numeric or bool: what reductions, clip, round and correlations take."""
    return isinstance(t, (T.NumericType, T.BooleanType))


def as_double(c: Column, t: T.DataType | None = None) -> Column:
    return c.cast("int").cast("double") if isinstance(t, T.BooleanType) else c.cast("double")
