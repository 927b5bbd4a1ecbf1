"""A series: a column expression over a frame, with its reductions, windows and accessors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidOperation, LengthMismatch, TypeMismatch
from loomframe.functions import categorical, datetimes, dtypes, na, strings
from loomframe.operators import window
from loomframe.operators.frame import Frame, Key, q
from loomframe.plans.order import POS, quantiles

MINMAX = {"min": F.min, "max": F.max}
#: Reductions that need numbers.
NUMERIC = ("sum", "mean", "median", "var", "std", "quantile", "prod")
AGGREGATES = ("count", "size", "nunique", "min", "max", "first", "last", *NUMERIC)


def clipped(c: Column, t: T.DataType, lo: float | None, hi: float | None) -> Column:
    if isinstance(t, T.BooleanType):
        c, t = c.cast("long"), T.LongType()
    whole = isinstance(t, T.IntegralType) and all(b is None or float(b).is_integer() for b in (lo, hi))
    kind = "long" if whole else "double"
    out = c.cast(kind)
    if lo is not None:
        out = F.greatest(out, F.lit(lo).cast(kind))
    if hi is not None:
        out = F.least(out, F.lit(hi).cast(kind))
    return F.when(c.isNotNull(), out)


def rounded(c: Column, t: T.DataType, digits: int) -> Column:
    if isinstance(t, T.BooleanType):
        c = c.cast("long")
    return c if isinstance(t, (T.IntegralType, T.BooleanType)) and digits >= 0 else na.round_even(c, digits)


def reduction(how: str, c: Column, field: T.StructField, at: float = 0.5, skipna: bool = True, dropna: bool = True) -> Column:
    """A reduction of a column. Sums are float64 and 0 over nothing; other statistics over nothing are missing; sample
    variance. Without skipna the result is missing if any value is."""
    t = field.dataType
    if how in NUMERIC and not na.is_number(t):
        raise TypeMismatch(f"{how} of {field.name}, which is no number")
    x = na.as_double(c, t) if na.is_number(t) else c
    if how == "quantile" and not 0 <= at <= 1:
        raise InvalidOperation("a quantile lies in [0, 1]")
    made: dict[str, Callable[[], Column]] = {
        "count": lambda: F.count(c),
        "size": lambda: F.count(F.lit(1)),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "prod": lambda: F.coalesce(F.product(x), F.lit(1.0)),
        "mean": lambda: F.avg(x),
        "median": lambda: F.median(x),
        "quantile": lambda: F.percentile(x, F.lit(at)),
        "var": lambda: F.var_samp(x),
        "std": lambda: F.stddev_samp(x),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "nunique": lambda: F.countDistinct(c) + (F.lit(0) if dropna else F.coalesce(F.max(F.when(c.isNull(), 1)), F.lit(0))),
    }
    if how not in made:
        raise InvalidOperation(f"unknown aggregate {how!r}")
    out = made[how]()
    return out if skipna or how in ("count", "size", "nunique") else F.when(F.count(c) == F.count(F.lit(1)), out)


class Series:
    def __init__(self, frame: Frame, column: Column, name: str, field: T.StructField | None = None):
        self.frame, self.column, self.name = frame, column, name
        self.field = field or T.StructField(name, frame.df.select(column.alias(name)).schema[name].dataType)

    @classmethod
    def of(cls, spark, values: Sequence[Any], name: str = "value", dtype: str | None = None) -> Series:
        f = Frame.from_rows(spark, [(v,) for v in values], [name])
        return f.col(name) if dtype is None else f.col(name).astype(dtype)

    def _new(self, column: Column, name: str | None = None) -> Series:
        return Series(self.frame, column, name or self.name)

    @property
    def dtype(self) -> str:
        return "category" if "categories" in (self.field.metadata or {}) else dtypes.name_of(self.field.dataType)

    def to_frame(self, name: str | None = None) -> Frame:
        n = name or self.name
        f = self.frame
        if n in f.index:
            f = f.reset_index(drop=True)
        return f._put({n: self.column})._keep([n])

    def values(self) -> list:
        return [r[0] for r in self.to_frame("value").rows()]

    tolist = values

    def __len__(self) -> int:
        return len(self.frame)

    # --- reductions (values on the driver) -----------------------------------------------------------------

    def _reduce(self, how: str, **options) -> Any:
        if how in ("median", "quantile") and options.get("skipna", True) and self.frame._large():
            reduction(how, self.column, self.field, **options)  # refuses what it refuses
            return quantiles(self.frame.df, na.as_double(self.column, self.field.dataType), [options.get("at", 0.5)])[0]
        return self.frame.df.agg(reduction(how, self.column, self.field, **options).alias("v")).first()["v"]

    def count(self):
        return self._reduce("count")

    def sum(self, **o):
        return self._reduce("sum", **o)

    def mean(self, **o):
        return self._reduce("mean", **o)

    def median(self, **o):
        return self._reduce("median", **o)

    def quantile(self, at: float):
        return self._reduce("quantile", at=at)

    def var(self, **o):
        return self._reduce("var", **o)

    def std(self, **o):
        return self._reduce("std", **o)

    def min(self, **o):
        return self._reduce("min", **o)

    def max(self, **o):
        return self._reduce("max", **o)

    def nunique(self, dropna: bool = True):
        return self._reduce("nunique", dropna=dropna)

    def hasna(self) -> bool:
        return not self.frame.df.filter(self.column.isNull()).isEmpty()

    def describe(self) -> Frame:
        return self.to_frame().describe()

    def _firsts(self) -> Frame:
        """Distinct values in the order of their first place, missing once, with their count."""
        df = self.frame.df
        lead = F.min(F.struct(*[q(k.name) for k in self.frame.order])).alias("__o0")
        if any(not k.ascending for k in self.frame.order):
            df, lead = self.frame.positioned(), F.min(POS).alias("__o0")
        out = df.groupBy(self.column.alias(self.name)).agg(F.count(F.lit(1)).alias("count"), lead)
        return Frame(out, [Key("__o0")])

    def unique(self) -> Frame:
        return self._firsts()._keep([self.name])

    def value_counts(self, ascending: bool = False, dropna: bool = True, normalize: bool = False) -> Frame:
        """Counts by value as text, the most frequent first, ties by first place; `<NA>` for missing when kept. Categories
        that don't occur count 0."""
        f = self._firsts()
        if dropna:
            f = f._with(f.df.filter(q(self.name).isNotNull()))
        df = f.df.withColumn(self.name, F.coalesce(dtypes.cast(q(self.name), self.field.dataType, T.StringType()), F.lit("<NA>")))
        order = [Key("__o1", ascending), Key("__o0")]
        if cats := (self.field.metadata or {}).get("categories"):
            spark = df.sparkSession
            ranks = spark.createDataFrame(list(enumerate(cats)), f"__o2 int, `{self.name}` string")
            df = ranks.join(df.drop("__o0"), self.name, "full").withColumn("count", F.coalesce("count", F.lit(0)))
            order = [Key("__o1", ascending), Key("__o2")]
        df = df.withColumn("__o1", F.col("count"))
        if normalize:
            total = df.agg(F.sum("count")).first()[0] or 1
            df = df.withColumn("proportion", F.col("count") / F.lit(float(total))).drop("count")
        return Frame(df, order)

    # --- elementwise ---------------------------------------------------------------------------------------

    def astype(self, kind: str) -> Series:
        if kind == "category":
            return categorical.make(self.to_frame(), self.name).col(self.name)
        return self._new(dtypes.cast(self.column, self.field.dataType, dtypes.parse(kind)))

    def isna(self) -> Series:
        return self._new(self.column.isNull())

    def notna(self) -> Series:
        return self._new(self.column.isNotNull())

    def dropna(self) -> Series:
        f = self.to_frame()
        return f._with(f.df.filter(q(self.name).isNotNull())).col(self.name)

    def fillna(self, value: Any) -> Series:
        return self.to_frame().fillna({self.name: value}).col(self.name)

    def _operand(self, other: Any) -> tuple[Series, Column, T.DataType]:
        """The two sides on one frame: a series of another frame is matched by position."""
        if not isinstance(other, Series):
            kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
            t = kinds.get(type(other), T.TimestampNTZType())
            return self, F.lit(other).cast(t), t
        if self.frame._extends(other.frame):
            return self, other.column, other.field.dataType
        if other.frame._extends(self.frame):
            return Series(other.frame, self.column, self.name, self.field), other.column, other.field.dataType
        if len(self) != len(other):
            raise LengthMismatch("series differ in length")
        both = self.to_frame(self.name).assign("__other", other)
        return Series(both, q(self.name), self.name, self.field), q("__other"), other.field.dataType

    def _arith(self, op: str, other: Any) -> Series:
        a, b, t = self._operand(other)
        s = a.field.dataType
        if op == "+" and isinstance(s, T.StringType) and isinstance(t, T.StringType):
            return a._new(F.concat(a.column, b))
        if not (na.is_number(s) and na.is_number(t)):
            raise TypeMismatch(f"{dtypes.name_of(s)} {op} {dtypes.name_of(t)}")
        if isinstance(s, T.IntegralType) and isinstance(t, T.IntegralType) and op in ("+", "-", "*", "%"):
            x, y = a.column.cast("long"), b.cast("long")
            return a._new({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: F.try_mod(x, y)}[op]())
        x, y = na.as_double(a.column, s), na.as_double(b, t)
        return a._new({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: na.quiet(na.fdiv(x, y)), "%": lambda: na.quiet(na.fmod(x, y)), "**": lambda: F.pow(x, y)}[op]())

    def add(self, o):
        return self._arith("+", o)

    def sub(self, o):
        return self._arith("-", o)

    def mul(self, o):
        return self._arith("*", o)

    def div(self, o):
        return self._arith("/", o)

    def mod(self, o):
        return self._arith("%", o)

    def pow(self, o):
        return self._arith("**", o)

    __add__, __sub__, __mul__, __truediv__, __mod__, __pow__ = add, sub, mul, div, mod, pow

    def _compare(self, op: str, other: Any) -> Series:
        """True where both sides are there and the test holds; false elsewhere."""
        a, b, t = self._operand(other)
        x, y = a.column, b
        if cats := (self.field.metadata or {}).get("categories"):
            if op in ("==", "!="):
                pass
            elif not self.field.metadata.get("ordered") or (isinstance(other, str) and other not in cats):
                return a._new(F.lit(False))
            else:
                rank = lambda c: F.nullif(F.array_position(F.array(*map(F.lit, cats)), c), F.lit(0))
                x, y = rank(x), rank(y)
        elif na.is_number(a.field.dataType) and na.is_number(t):
            x, y = na.as_double(x, a.field.dataType), na.as_double(y, t)
        elif type(a.field.dataType) is not type(t):
            return a._new(F.lit(op == "!=") & x.isNotNull() & y.isNotNull())
        test = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return a._new(F.coalesce(test, F.lit(False)))

    def eq(self, o):
        return self._compare("==", o)

    def ne(self, o):
        return self._compare("!=", o)

    def lt(self, o):
        return self._compare("<", o)

    def le(self, o):
        return self._compare("<=", o)

    def gt(self, o):
        return self._compare(">", o)

    def ge(self, o):
        return self._compare(">=", o)

    def between(self, lo: Any, hi: Any, inclusive: str = "both") -> Series:
        if inclusive not in ("both", "neither", "left", "right"):
            raise InvalidOperation(f"inclusive can't be {inclusive!r}")
        low = self.ge(lo) if inclusive in ("both", "left") else self.gt(lo)
        high = self.le(hi) if inclusive in ("both", "right") else self.lt(hi)
        return self._new(low.column & high.column)

    def isin(self, values: Sequence[Any]) -> Series:
        there = [v for v in values if v is not None]
        return self._new(F.coalesce(self.column.isin(there), F.lit(False)) if there else F.lit(False))

    def clip(self, lo: float | None = None, hi: float | None = None) -> Series:
        return self._new(clipped(self.column, self.field.dataType, lo, hi))

    def round(self, digits: int = 0) -> Series:
        return self._new(rounded(self.column, self.field.dataType, digits))

    def abs(self) -> Series:
        return self._new(F.abs(self.column))

    def apply(self, fn: Callable[[Any], Any], returns: str) -> Series:
        """A function of each value that is there."""
        return self._new(F.udf(lambda v: None if v is None else fn(v), returns)(self.column))

    def set(self, position: int, value: Any) -> Series:
        """The series with one value replaced; the value has to fit the type."""
        from loomframe.operators.frame import _fits

        if not _fits(value, self.field.dataType):
            raise TypeMismatch(f"{value!r} doesn't fit {self.dtype}")
        f = self.to_frame()
        df = f.positioned().withColumn(self.name, F.when(F.col(POS) == position, F.lit(value).cast(self.field.dataType)).otherwise(q(self.name))).drop(POS)
        return f._with(df).col(self.name)

    # --- rows ----------------------------------------------------------------------------------------------

    def head(self, n: int = 5) -> Series:
        return self.to_frame().head(n).col(self.name)

    def tail(self, n: int = 5) -> Series:
        return self.to_frame().tail(n).col(self.name)

    def slice(self, start: int, stop: int) -> Series:
        return self.to_frame().slice(start, stop).col(self.name)

    def take(self, positions: Sequence[int]) -> Series:
        return self.to_frame().take(positions).col(self.name)

    def iat(self, i: int) -> Any:
        return self.to_frame().iat(i, self.name)

    def at(self, label: Any) -> Any:
        return self.to_frame().loc_rows(label).rows()[0][0]

    def filter(self, mask: Series) -> Series:
        f = self.to_frame("__self")._with(self.frame._put({"__self": self.column, "__m": mask.column}).df) if mask.frame.df is self.frame.df else None
        if f is None:
            return self.to_frame().filter(mask).col(self.name)
        kept = f._with(f.df.filter(F.coalesce(q("__m"), F.lit(False))))._keep(["__self"])
        return kept.rename({"__self": self.name}).col(self.name)

    def reindex(self, labels: Sequence[Any]) -> Series:
        return self.to_frame().reindex(labels).col(self.name)

    def reset_index(self) -> Series:
        """The values with default labels."""
        return self.to_frame().reset_index(drop=True).col(self.name)

    def sort_values(self, ascending: bool = True) -> Series:
        return self.to_frame().sort_values(self.name, ascending).col(self.name)

    def sort_index(self, ascending: bool = True) -> Series:
        return self.to_frame().sort_index(ascending).col(self.name)

    def argsort(self) -> Frame:
        """Positions in sorted order, missing values last, ties by position."""
        f = self.to_frame()
        at = f._with(f.positioned().withColumnRenamed(POS, "position"))
        return at.sort_values(self.name)._keep(["position"])

    # --- windows -------------------------------------------------------------------------------------------

    def shift(self, periods: int = 1) -> Series:
        return window.shift(self.to_frame(), [self.name], periods).col(self.name)

    def diff(self, periods: int = 1) -> Series:
        return window.diff(self.to_frame(), [self.name], periods).col(self.name)

    def pct_change(self, periods: int = 1) -> Series:
        return window.pct_change(self.to_frame(), [self.name], periods).col(self.name)

    def cumsum(self) -> Series:
        return window.cumulative(self.to_frame(), [self.name], "sum").col(self.name)

    def cumprod(self) -> Series:
        return window.cumulative(self.to_frame(), [self.name], "prod").col(self.name)

    def cummin(self) -> Series:
        return window.cumulative(self.to_frame(), [self.name], "min").col(self.name)

    def cummax(self) -> Series:
        return window.cumulative(self.to_frame(), [self.name], "max").col(self.name)

    def rank(self, method: str = "average", ascending: bool = True) -> Series:
        return window.rank(self.to_frame(), self.name, method, ascending).col(self.name)

    def rolling(self, size: int, min_periods: int | None = None, center: bool = False) -> window.Windowed:
        return window.Rolling(self.to_frame(), size, min_periods, center)

    def expanding(self, min_periods: int = 1) -> window.Windowed:
        return window.Expanding(self.to_frame(), min_periods)

    # --- accessors -----------------------------------------------------------------------------------------

    @property
    def str(self) -> strings.Text:
        return strings.Text(self)

    @property
    def dt(self) -> datetimes.Times:
        return datetimes.Times(self)

    @property
    def cat(self) -> categorical.Categories:
        return categorical.Categories(self)


def concat(series: Sequence[Series], name: str = "value") -> Series:
    from loomframe.operators.concat import concat as concat_frames

    return concat_frames([s.to_frame(name) for s in series]).col(name)


