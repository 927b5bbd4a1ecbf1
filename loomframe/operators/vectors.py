"""Arrays, one vector a row: elementwise and row-local operations on array columns, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import na


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def each(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(doubles(c), f)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x * y)


def div(a: Column, b: Column) -> Column:
    return zipped(a, b, na.fdiv)


def total(c: Column) -> Column:
    return F.aggregate(doubles(c), F.lit(0.0), lambda s, x: s + x)


def mean(c: Column) -> Column:
    return na.fdiv(total(c), F.size(c))


def var(c: Column, ddof: int = 0) -> Column:
    """Variance around the mean; NaN for no more values than ddof."""
    m = mean(c)
    squares = F.aggregate(each(c, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(c) > ddof, na.fdiv(squares, F.size(c) - ddof)).otherwise(F.lit(na.NAN))


def std(c: Column, ddof: int = 0) -> Column:
    return F.sqrt(var(c, ddof))


def low(c: Column) -> Column:
    """The minimum; NaN if there is one."""
    return F.when(F.exists(doubles(c), F.isnan), F.lit(na.NAN)).otherwise(F.array_min(doubles(c)))


def high(c: Column) -> Column:
    return F.when(F.exists(doubles(c), F.isnan), F.lit(na.NAN)).otherwise(F.array_max(doubles(c)))


def argmin(c: Column) -> Column:
    """The first place of the minimum, NaN passed over; 0 if NaN is at place 0."""
    return _arg(c, F.array_min)


def argmax(c: Column) -> Column:
    """The first place of the maximum, NaN passed over; 0 if NaN is at place 0."""
    return _arg(c, F.array_max)


def _arg(c: Column, best: Callable[[Column], Column]) -> Column:
    x = doubles(c)
    return F.when(F.isnan(F.get(x, F.lit(0))), F.lit(0).cast("long")).otherwise(F.array_position(x, best(F.filter(x, lambda v: ~F.isnan(v)))) - 1)


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def argsort(c: Column) -> Column:
    """Places in ascending order of value, ties by place."""
    pairs = F.transform(doubles(c), lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"].cast("long"))


def columns_mean(df: DataFrame, name: str) -> DataFrame:
    """Mean over rows for each place of the vectors: j, v. Combined before the shuffle."""
    each_place = df.select(F.posexplode(doubles(F.col(name))).alias("j", "x"))
    return each_place.groupBy("j").agg(F.avg("x").alias("v"))


def gram(df: DataFrame, name: str, width: int) -> DataFrame:
    """The product of the transposed matrix of all rows with itself: i, j, v. Every row adds its outer product; sums are
    combined in the tasks, so that width * width numbers a task are shuffled."""
    x = F.col("x")
    both = df.select(doubles(F.col(name)).alias("x")).select(x, F.posexplode(x).alias("i", "a"))
    both = both.select("i", "a", F.posexplode(x).alias("j", "b"))
    return both.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v")).filter((F.col("i") < width) & (F.col("j") < width))
