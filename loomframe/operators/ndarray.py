"""N-dimensional arrays as (i, v): the row-major place of a cell and its value, with the shape beside.

Reshaping is free, transposing and slicing are arithmetic on places, broadcasting explodes the axes of length one,
and products join on the inner axis and sum before the shuffle. NaN is a value here and spreads as IEEE says.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import BroadcastMismatch, InvalidDType, InvalidOperation, OutOfBounds, ShapeMismatch
from loomframe.functions import dtypes, na

Shape = tuple[int, ...]
NAN = na.NAN


def _size(shape: Shape) -> int:
    return math.prod(shape)


def _steps(shape: Shape) -> list[int]:
    return [math.prod(shape[k + 1 :]) for k in range(len(shape))]


def _axes(i: Column, shape: Shape) -> list[Column]:
    """Coordinates of a row-major place."""
    return [F.pmod(F.floor(i / F.lit(s)).cast("long") if s > 1 else i, F.lit(n)) for s, n in zip(_steps(shape), shape, strict=True)]


def _place(axes: Sequence[Column], shape: Shape) -> Column:
    out = F.lit(0).cast("long")
    for a, s in zip(axes, _steps(shape), strict=True):
        out = out + a * s
    return out


def broadcast_shape(*shapes: Shape) -> Shape:
    out: list[int] = []
    for k in range(1, max(map(len, shapes)) + 1):
        sizes = {s[-k] for s in shapes if len(s) >= k} - {1}
        if len(sizes) > 1:
            raise BroadcastMismatch(f"{shapes}")
        out.append(sizes.pop() if sizes else 1)
    return tuple(reversed(out))


class NDArray:
    def __init__(self, df: DataFrame, shape: Shape):
        self.df, self.shape = df, tuple(shape)

    # --- making --------------------------------------------------------------------------------------------

    @classmethod
    def of(cls, spark: SparkSession, data: Any, dtype: str | None = None) -> NDArray:
        """From nested lists; whole numbers stay whole."""
        shape, flat, level = [], data, data
        while isinstance(level, (list, tuple)):
            shape.append(len(level))
            level = level[0] if level else None
        for _ in shape[1:]:
            if len({len(x) for x in flat}) > 1:
                raise ShapeMismatch("rows differ in length")
            flat = [v for row in flat for v in row]
        flat = flat if isinstance(flat, (list, tuple)) else [flat]
        kinds = {type(v) for v in flat}
        kind = "boolean" if kinds == {bool} else "bigint" if kinds <= {int, bool} and kinds else "string" if kinds == {str} else "double"
        rows = [(i, float(v) if kind == "double" else int(v) if kind == "bigint" else v) for i, v in enumerate(flat)]
        a = cls(spark.createDataFrame(rows, f"i long, v {kind}"), tuple(shape))
        return a.astype(dtype) if dtype else a

    @classmethod
    def from_vectors(cls, df: DataFrame, order_by: str, name: str, width: int) -> NDArray:
        """A matrix of the vectors of a column, a row each, in the order of a unique key."""
        from loomframe.plans.order import BLOCK, POS, Key, with_position

        # blocks of so many cells, not vectors: a single block, and the joins of its cells, are one task
        rows = with_position(df.select(order_by, name), (Key(order_by),), block=max(1, BLOCK // max(1, width)))
        cells = rows.select(POS, F.posexplode(F.col(name).cast("array<double>")).alias("j", "v"))
        return cls(cells.select((F.col(POS) * width + F.col("j")).alias("i"), "v"), (df.count(), width))

    @classmethod
    def filled(cls, spark: SparkSession, shape: Sequence[int], value: float = 0.0) -> NDArray:
        return cls(spark.range(_size(tuple(shape))).select(F.col("id").alias("i"), F.lit(value).alias("v")), tuple(shape))

    @classmethod
    def zeros(cls, spark, shape):
        return cls.filled(spark, shape, 0.0)

    @classmethod
    def ones(cls, spark, shape):
        return cls.filled(spark, shape, 1.0)

    @classmethod
    def arange(cls, spark, start: float, stop: float | None = None, step: float = 1.0) -> NDArray:
        """Always float64; a step of 0 gives nothing."""
        a, b = (0.0, start) if stop is None else (start, stop)
        n = max(0, math.ceil((b - a) / step)) if step else 0
        return cls(spark.range(n).select(F.col("id").alias("i"), (F.lit(float(a)) + F.col("id") * float(step)).alias("v")), (n,))

    @classmethod
    def linspace(cls, spark, start: float, stop: float, n: int) -> NDArray:
        step = (stop - start) / (n - 1) if n > 1 else 0.0
        at = F.when(F.col("id") == n - 1, F.lit(float(stop))).otherwise(F.lit(float(start)) + F.col("id") * step) if n > 1 else F.lit(float(start))
        return cls(spark.range(n).select(F.col("id").alias("i"), at.alias("v")), (n,))

    @classmethod
    def logspace(cls, spark, start: float, stop: float, n: int, base: float = 10.0) -> NDArray:
        return cls.linspace(spark, start, stop, n)._map(lambda v: F.pow(F.lit(base), v))

    @classmethod
    def eye(cls, spark, n: int, m: int | None = None, k: int = 0) -> NDArray:
        shape = (n, m or n)
        a = cls.zeros(spark, shape)
        r, c = _axes(F.col("i"), shape)
        return cls(a.df.withColumn("v", F.when(c - r == k, 1.0).otherwise(0.0)), shape)

    identity = eye

    @classmethod
    def rand(cls, spark, shape, seed: int = 0) -> NDArray:
        return cls(spark.range(_size(tuple(shape))).select(F.col("id").alias("i"), F.rand(seed).alias("v")), tuple(shape))

    @classmethod
    def randn(cls, spark, shape, seed: int = 0) -> NDArray:
        return cls(spark.range(_size(tuple(shape))).select(F.col("id").alias("i"), F.randn(seed).alias("v")), tuple(shape))

    @classmethod
    def randint(cls, spark, low: int, high: int, shape, seed: int = 0) -> NDArray:
        """Whole numbers in [low, high) as float64."""
        return cls.rand(spark, shape, seed)._map(lambda v: F.floor(v * (high - low)).cast("double") + low)

    def diag(self) -> NDArray:
        """The square matrix with a vector on its diagonal, or the diagonal of a matrix."""
        if len(self.shape) == 1:
            n = self.shape[0]
            at = NDArray.zeros(self.df.sparkSession, (n, n))
            mine = self.df.select((F.col("i") * (n + 1)).alias("i"), F.col("v").cast("double").alias("w"))
            return NDArray(at.df.join(mine, "i", "left").select("i", F.coalesce("w", "v").alias("v")), (n, n))
        n = min(self.shape)
        r, c = _axes(F.col("i"), self.shape)
        return NDArray(self.df.filter(r == c).select(r.alias("i"), "v"), (n,))

    # --- facts and export ----------------------------------------------------------------------------------

    @property
    def kind(self) -> T.DataType:
        return self.df.schema["v"].dataType

    @property
    def dtype(self) -> str:
        return dtypes.name_of(self.kind)

    @property
    def size(self) -> int:
        return _size(self.shape)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def flat(self) -> list:
        return [r["v"] for r in self.df.orderBy("i").collect()]

    def tolist(self) -> Any:
        out = self.flat()
        if not self.shape:
            return out[0]
        for n in reversed(self.shape[1:]):
            out = [out[k : k + n] for k in range(0, len(out), n)]
        return out

    def item(self, *at: int) -> Any:
        """One value; negative places count from the end."""
        if len(at) != self.ndim or any(not -n <= a < n for a, n in zip(at, self.shape, strict=True)):
            raise OutOfBounds(at)
        place = sum((a % n) * s for a, n, s in zip(at, self.shape, _steps(self.shape), strict=True))
        return self.df.filter(F.col("i") == place).first()["v"]

    def set(self, at: Sequence[int], value: Any) -> NDArray:
        place = sum((a % n) * s for a, n, s in zip(at, self.shape, _steps(self.shape), strict=True))
        return NDArray(self.df.withColumn("v", F.when(F.col("i") == place, F.lit(value).cast(self.kind)).otherwise(F.col("v"))), self.shape)

    def astype(self, name: str) -> NDArray:
        if name not in ("bool", "int", "int64", "float32", "float64", "string"):
            raise InvalidDType(name)
        want, c = dtypes.parse(name), F.col("v")
        if isinstance(self.kind, T.StringType) and isinstance(want, T.LongType):
            c = c.cast("double")
        if isinstance(self.kind, T.BooleanType) and isinstance(want, T.NumericType):
            c = c.cast("int")
        return NDArray(self.df.withColumn("v", c.cast(want)), self.shape)

    # --- shape ---------------------------------------------------------------------------------------------

    def reshape(self, *shape: int) -> NDArray:
        if shape.count(-1) > 1:
            raise ShapeMismatch("one -1 at most")
        if -1 in shape:
            rest = -_size(shape)
            if not rest or self.size % rest:
                raise ShapeMismatch(f"{self.shape} as {shape}")
            shape = tuple(self.size // rest if n == -1 else n for n in shape)
        if _size(shape) != self.size:
            raise ShapeMismatch(f"{self.shape} as {shape}")
        return NDArray(self.df, shape)

    def flatten(self) -> NDArray:
        return NDArray(self.df, (self.size,))

    ravel = flatten

    def transpose(self, *axes: int) -> NDArray:
        order = axes or tuple(reversed(range(self.ndim)))
        if sorted(order) != list(range(self.ndim)):
            raise ShapeMismatch(f"axes {axes}")
        shape = tuple(self.shape[a] for a in order)
        at = _axes(F.col("i"), self.shape)
        return NDArray(self.df.select(_place([at[a] for a in order], shape).alias("i"), "v"), shape)

    @property
    def T(self) -> NDArray:
        return self.transpose()

    def squeeze(self) -> NDArray:
        return NDArray(self.df, tuple(n for n in self.shape if n != 1))

    def expand_dims(self, axis: int) -> NDArray:
        k = axis if axis >= 0 else self.ndim + 1 + axis
        if not 0 <= k <= self.ndim:
            raise ShapeMismatch(f"axis {axis}")
        return NDArray(self.df, (*self.shape[:k], 1, *self.shape[k:]))

    def broadcast_to(self, shape: Shape) -> NDArray:
        shape = tuple(shape)
        if broadcast_shape(self.shape, shape) != shape:
            raise BroadcastMismatch(f"{self.shape} to {shape}")
        if self.shape == shape:
            return self
        own = (1,) * (len(shape) - self.ndim) + self.shape
        at, df = _axes(F.col("i"), own), self.df
        df = df.select("v", *[a.alias(f"a{k}") for k, a in enumerate(at)])
        for k, (have, want) in enumerate(zip(own, shape, strict=True)):
            if have == 1 and want != 1:
                df = df.withColumn(f"a{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(want - 1).cast("long")))) if want else df.filter("false")
        return NDArray(df.select(_place([F.col(f"a{k}") for k in range(len(shape))], shape).alias("i"), "v"), shape)

    # --- selecting -----------------------------------------------------------------------------------------

    def slice(self, *cuts: slice | int) -> NDArray:
        """Slices with positive steps along the first axes, clamped; an int takes one place and drops its axis."""
        at, df = _axes(F.col("i"), self.shape), self.df
        shape, keep, cond = [], [], F.lit(True)
        for k, n in enumerate(self.shape):
            cut = cuts[k] if k < len(cuts) else slice(None)
            if isinstance(cut, int):
                if not -n <= cut < n:
                    raise OutOfBounds(cut)
                cond = cond & (at[k] == cut % n)
                continue
            a, b, step = cut.indices(n)
            if step < 0:
                raise InvalidOperation("a step is positive")
            shape.append(len(range(a, b, step)))
            cond = cond & (at[k] >= a) & (at[k] < b) & (F.pmod(at[k] - a, F.lit(step)) == 0)
            keep.append(F.floor((at[k] - a) / step).cast("long") if step > 1 else at[k] - a)
        return NDArray(df.filter(cond).select(_place(keep, tuple(shape)).alias("i"), "v"), tuple(shape))

    def take(self, positions: Sequence[int], axis: int = 0) -> NDArray:
        """Places along an axis, which may repeat; negative ones count from the end, once."""
        n = self.shape[axis]
        if any(not -n <= p < n for p in positions):
            raise OutOfBounds(positions)
        shape = (*self.shape[:axis], len(positions), *self.shape[axis + 1 :])
        want = self.df.sparkSession.createDataFrame([(k, p % n) for k, p in enumerate(positions)], "k long, p long")
        at = _axes(F.col("i"), self.shape)
        cells = self.df.select("v", *[a.alias(f"a{k}") for k, a in enumerate(at)])
        found = cells.join(want, F.col(f"a{axis}") == F.col("p"))
        axes = [F.col("k") if k == axis else F.col(f"a{k}") for k in range(self.ndim)]
        return NDArray(found.select(_place(axes, shape).alias("i"), "v"), shape)

    def mask(self, where: NDArray) -> NDArray:
        """The values where a mask of the same shape holds, flat, in order."""
        from loomframe.plans.order import POS, Key, with_position

        if where.shape != self.shape:
            raise ShapeMismatch(f"{where.shape} for {self.shape}")
        kept = self.df.join(where.df.select("i", F.col("v").alias("m")), "i").filter("m").drop("m")
        out = with_position(kept, (Key("i"),)).select(F.col(POS).alias("i"), "v")
        return NDArray(out, (out.count(),))

    compress = mask

    # --- elementwise ---------------------------------------------------------------------------------------

    def _map(self, f: Callable[[Column], Column]) -> NDArray:
        return NDArray(self.df.select("i", f(F.col("v")).alias("v")), self.shape)

    def _zip(self, other: Any, f: Callable[[Column, Column], Column]) -> NDArray:
        if not isinstance(other, NDArray):
            return self._map(lambda v: f(v, F.lit(other)))
        if other is self:
            return self._map(lambda v: f(v, v))
        shape = broadcast_shape(self.shape, other.shape)
        a, b = self.broadcast_to(shape), other.broadcast_to(shape)
        both = a.df.join(b.df.select("i", F.col("v").alias("w")), "i")
        return NDArray(both.select("i", f(F.col("v"), F.col("w")).alias("v")), shape)

    def _whole(self, other: Any) -> bool:
        mine = isinstance(self.kind, (T.IntegralType, T.BooleanType))
        theirs = isinstance(other.kind, (T.IntegralType, T.BooleanType)) if isinstance(other, NDArray) else isinstance(other, (int, bool))
        return mine and theirs

    def _arith(self, op: str, other: Any) -> NDArray:
        if isinstance(self.kind, T.StringType):
            if isinstance(other, NDArray):
                raise InvalidDType("arithmetic on text")
            return self._map(lambda v: F.lit(NAN))
        if isinstance(other, NDArray) and isinstance(other.kind, T.StringType):
            raise InvalidDType("arithmetic on text")
        whole = self._whole(other) and op != "/"
        as_kind = (lambda c: c.cast("int").cast("long")) if whole and isinstance(self.kind, T.BooleanType) else (lambda c: c.cast("long" if whole else "double"))

        def f(x: Column, y: Column) -> Column:
            x, y = as_kind(x), y.cast("int").cast("long") if whole and (isinstance(other, bool) or (isinstance(other, NDArray) and isinstance(other.kind, T.BooleanType))) else y.cast("long" if whole else "double")
            if op == "%":
                return F.try_mod(x, y) if whole else na.fmod(x, y)
            if op == "**":
                return F.pow(x, y).cast("long") if whole else F.pow(x, y)
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: na.fdiv(x, y)}[op]()

        return self._zip(other, f)

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

    def neg(self) -> NDArray:
        return self._map(lambda v: -v)

    def maximum(self, other: Any) -> NDArray:
        return self._zip(other, lambda x, y: F.greatest(x.cast("double"), y.cast("double")))

    def minimum(self, other: Any) -> NDArray:
        return self._zip(other, lambda x, y: F.when(F.isnan(x.cast("double")) | F.isnan(y.cast("double")), F.lit(NAN)).otherwise(F.least(x.cast("double"), y.cast("double"))))

    def ufunc(self, name: str, *args: Any) -> NDArray:
        """A named function of every cell. abs, floor, ceil, round and clip keep whole numbers; text gives NaN."""
        if isinstance(self.kind, T.StringType):
            return self._map(lambda v: F.lit(NAN))
        whole = isinstance(self.kind, T.IntegralType)
        if whole and name in ("floor", "ceil", "round"):
            return self
        if whole and name == "abs":
            return self._map(F.abs)
        x = (lambda v: v.cast("int").cast("double")) if isinstance(self.kind, T.BooleanType) else (lambda v: v.cast("double"))
        table: dict[str, Callable[[Column], Column]] = {
            "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": na.log, "log2": lambda v: na.log(v, "log2"), "log10": lambda v: na.log(v, "log10"), "sin": F.sin, "cos": F.cos, "tan": F.tan,
            "floor": lambda v: F.when(F.isnan(v) | (F.abs(v) == na.INF), v).otherwise(F.floor(v).cast("double")), "ceil": lambda v: F.when(F.isnan(v) | (F.abs(v) == na.INF), v).otherwise(F.ceil(v).cast("double")),
            "round": lambda v: na.round_even(v, *args), "clip": lambda v: F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(args[0]))), F.lit(float(args[1])))),
            "isnan": F.isnan, "isinf": lambda v: F.abs(v) == na.INF, "isfinite": lambda v: ~F.isnan(v) & (F.abs(v) != na.INF),
        }
        if name not in table:
            raise InvalidOperation(f"unknown function {name!r}")
        out = self._map(lambda v: table[name](x(v)))
        if whole and name == "clip":
            return out.astype("int64")
        return out.astype("float32") if isinstance(self.kind, T.FloatType) and not isinstance(out.kind, T.BooleanType) else out

    def apply(self, fn: Callable[[Any], Any], returns: str = "double") -> NDArray:
        return self._map(F.udf(fn, returns))

    def _compare(self, op: str, other: Any) -> NDArray:
        """IEEE: with NaN all are false but !=."""

        def f(x: Column, y: Column) -> Column:
            if isinstance(self.kind, T.StringType):
                odd = F.lit(False)
            else:
                x, y = (c.cast("int").cast("double") if isinstance(k, T.BooleanType) else c.cast("double") for c, k in ((x, self.kind), (y, other.kind if isinstance(other, NDArray) else T.BooleanType() if isinstance(other, bool) else T.DoubleType())))
                odd = F.isnan(x) | F.isnan(y)
            test = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return F.when(odd, F.lit(op == "!=")).otherwise(test)

        return self._zip(other, f)

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

    def logical_and(self, o: NDArray) -> NDArray:
        return self._zip(o, lambda x, y: x & y)

    def logical_or(self, o: NDArray) -> NDArray:
        return self._zip(o, lambda x, y: x | y)

    def logical_not(self) -> NDArray:
        return self._map(lambda v: ~v)

    def any(self) -> bool:
        return bool(self.df.agg(F.max("v").alias("v")).first()["v"])

    def all(self) -> bool:
        v = self.df.agg(F.min("v").alias("v")).first()["v"]
        return True if v is None else bool(v)

    def count_true(self) -> int:
        return self.df.agg(F.count_if(F.col("v")).alias("v")).first()["v"]

    def isin(self, values: Sequence[Any]) -> NDArray:
        """Membership; NaN is in nothing."""
        there = [v for v in values if v == v]
        if isinstance(self.kind, T.StringType):
            return self._map(lambda v: v.isin(there) if there else F.lit(False))
        return self._map(lambda v: v.cast("double").isin([float(x) for x in there]) if there else F.lit(False))

    # --- reductions ----------------------------------------------------------------------------------------

    def _reduced(self, how: str, ddof: int) -> Column:
        v = F.col("v").cast("int").cast("double") if isinstance(self.kind, T.BooleanType) else F.col("v").cast("double")
        n, odd = F.count("v"), F.max(F.isnan(v))
        nan = lambda c: F.when(odd, F.lit(NAN)).otherwise(F.coalesce(c, F.lit(NAN)))
        made = {
            "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "mean": lambda: F.coalesce(F.avg(v), F.lit(NAN)), "min": lambda: nan(F.min(v)), "max": lambda: nan(F.max(v)),
            "var": lambda: F.when(n > ddof, F.var_pop(v) * n / F.when(n > ddof, n - ddof)).otherwise(F.lit(NAN)), "std": lambda: F.when(n > ddof, F.sqrt(F.var_pop(v) * n / F.when(n > ddof, n - ddof))).otherwise(F.lit(NAN)),
        }
        if how not in made:
            raise InvalidOperation(f"unknown reduction {how!r}")
        out = made[how]()
        return out.cast("long") if isinstance(self.kind, T.IntegralType) and how in ("sum", "min", "max") else out

    def _rest(self, axis: int) -> tuple[Shape, Column]:
        k = axis if axis >= 0 else self.ndim + axis
        if not 0 <= k < self.ndim:
            raise OutOfBounds(f"axis {axis}")
        shape = self.shape[:k] + self.shape[k + 1 :]
        at = _axes(F.col("i"), self.shape)
        return shape, _place([a for j, a in enumerate(at) if j != k], shape)

    def reduce(self, how: str, axis: int | None = None, ddof: int = 0) -> Any:
        """sum, mean, min, max, var, std (population unless ddof) of everything, or along an axis."""
        if axis is None:
            return self.df.agg(self._reduced(how, ddof).alias("v")).first()["v"]
        shape, place = self._rest(axis)
        return NDArray(self.df.select(place.alias("i"), "v").groupBy("i").agg(self._reduced(how, ddof).alias("v")), shape)

    def arg(self, how: str, axis: int | None = None) -> Any:
        """The first place of the min or max, flat or along an axis. NaN is never better than what came before, so a NaN
        at place 0 stays and others are passed over."""
        v = F.col("v").cast("double")

        def lead(at: Column) -> Column:
            return F.struct((~(F.isnan(v) & (at == 0))).alias("later"), (v if how == "min" else -v).alias("k"), at.alias("a"))

        if axis is None:
            return self.df.agg(F.min(lead(F.col("i"))).alias("r")).first()["r"]["a"]
        shape, place = self._rest(axis)
        k = axis if axis >= 0 else self.ndim + axis
        pick = F.min(lead(_axes(F.col("i"), self.shape)[k]))["a"]
        return NDArray(self.df.select(place.alias("p"), "i", "v").groupBy("p").agg(pick.alias("v")).withColumnRenamed("p", "i"), shape)

    # --- order ---------------------------------------------------------------------------------------------

    def _lines(self) -> tuple[int, DataFrame]:
        n = self.shape[-1]
        line, at = F.floor(F.col("i") / n).cast("long"), F.pmod(F.col("i"), F.lit(n))
        w = Window.partitionBy("line").orderBy("v", "at")
        return n, self.df.select(line.alias("line"), at.alias("at"), "v").withColumn("r", F.row_number().over(w) - 1)

    def sort(self) -> NDArray:
        """Along the last axis, NaN last."""
        n, rows = self._lines() if self.ndim > 1 else (self.size, self._ranked())
        return NDArray(rows.select((F.col("line") * n + F.col("r")).alias("i"), "v"), self.shape)

    def argsort(self) -> NDArray:
        n, rows = self._lines() if self.ndim > 1 else (self.size, self._ranked())
        return NDArray(rows.select((F.col("line") * n + F.col("r")).alias("i"), F.col("at").alias("v")), self.shape)

    def _ranked(self) -> DataFrame:
        """A vector's values with their rank: by blocks, not in one task."""
        from loomframe.plans.order import POS, Key, with_position

        rows = self.df.select(F.lit(0).cast("long").alias("line"), F.col("i").alias("at"), "v")
        return with_position(rows, (Key("v"), Key("at"))).withColumnRenamed(POS, "r")

    def unique(self) -> NDArray:
        """Distinct values, sorted."""
        from loomframe.plans.order import POS, Key, with_position

        rows = with_position(self.df.select("v").distinct(), (Key("v"),)).select(F.col(POS).alias("i"), "v")
        return NDArray(rows, (rows.count(),))

    def searchsorted(self, values: NDArray, side: str = "left") -> NDArray:
        """For each value the place in this sorted vector that keeps the order, before (left) or after (right) equal ones.

        Both are put in one order, where a value's place is the count of this vector's cells before it.
        """
        from loomframe.plans.order import Key, running, with_position

        if self.ndim != 1:
            raise ShapeMismatch("a vector is searched")
        mine = self.df.select(F.col("v").cast("double").alias("v"), F.lit(1.0).alias("own"), F.lit(0 if side == "right" else 1).alias("s"), F.lit(-1).cast("long").alias("i"))
        theirs = values.df.select(F.col("v").cast("double").alias("v"), F.lit(0.0).alias("own"), F.lit(1 if side == "right" else 0).alias("s"), "i")
        rows = running(with_position(mine.unionByName(theirs), (Key("v"), Key("s"), Key("i"))), {"before": (F.col("own"), "sum")})
        return NDArray(rows.filter("i >= 0").select("i", F.col("before").cast("long").alias("v")), values.shape)

    # --- products ------------------------------------------------------------------------------------------

    def dot(self, other: NDArray) -> Any:
        """Vector by vector, matrix by vector, matrix by matrix."""
        if (self.ndim, other.ndim) not in ((1, 1), (2, 1), (2, 2)) or self.shape[-1] != other.shape[0]:
            raise ShapeMismatch(f"{self.shape} by {other.shape}")
        m, inner = (1, self.shape[0]) if self.ndim == 1 else self.shape
        n = other.shape[1] if other.ndim == 2 else 1
        a = self.df.select(F.floor(F.col("i") / inner).cast("long").alias("r"), F.pmod(F.col("i"), F.lit(inner)).alias("k"), F.col("v").cast("double").alias("x"))
        b = other.df.select(F.floor(F.col("i") / n).cast("long").alias("k"), F.pmod(F.col("i"), F.lit(n)).alias("c"), F.col("v").cast("double").alias("y"))
        out = a.join(b, "k").groupBy((F.col("r") * n + F.col("c")).alias("i")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        if self.ndim == other.ndim == 1:
            return out.agg(F.sum("v").alias("v")).first()["v"]
        return NDArray(out, (m,) if other.ndim == 1 else (m, n))

    matmul = dot

    def trace(self) -> float:
        if self.ndim != 2:
            raise ShapeMismatch("a matrix has a trace")
        return float(self.diag().reduce("sum"))


def where(cond: NDArray, x: Any, y: Any) -> NDArray:
    """x where the condition holds, else y; both arrays or scalars, broadcast."""
    shape = broadcast_shape(cond.shape, *[a.shape for a in (x, y) if isinstance(a, NDArray)])
    df = cond.broadcast_to(shape).df.withColumnRenamed("v", "c")
    cols = []
    for name, a in (("x", x), ("y", y)):
        if isinstance(a, NDArray):
            df = df.join(a.broadcast_to(shape).df.withColumnRenamed("v", name), "i")
            cols.append(F.col(name).cast("double"))
        else:
            cols.append(F.lit(float(a)))
    return NDArray(df.select("i", F.when(F.col("c"), cols[0]).otherwise(cols[1]).alias("v")), shape)


def concatenate(arrays: Sequence[NDArray], axis: int = 0) -> NDArray:
    first = arrays[0]
    k = axis if axis >= 0 else first.ndim + axis
    if any(a.ndim != first.ndim or a.shape[:k] + a.shape[k + 1 :] != first.shape[:k] + first.shape[k + 1 :] for a in arrays):
        raise ShapeMismatch("arrays differ off the axis")
    shape = (*first.shape[:k], sum(a.shape[k] for a in arrays), *first.shape[k + 1 :])
    kind = dtypes.promote_all([a.kind for a in arrays])
    out, at = None, 0
    for a in arrays:
        axes = _axes(F.col("i"), a.shape)
        axes[k] = axes[k] + at
        part = a.df.select(_place(axes, shape).alias("i"), F.col("v").cast(kind).alias("v"))
        out = part if out is None else out.unionByName(part)
        at += a.shape[k]
    return NDArray(out, shape)


def stack(arrays: Sequence[NDArray], axis: int = 0) -> NDArray:
    return concatenate([a.expand_dims(axis) for a in arrays], axis)


def hstack(arrays: Sequence[NDArray]) -> NDArray:
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def vstack(arrays: Sequence[NDArray]) -> NDArray:
    return concatenate([a.expand_dims(0) if a.ndim == 1 else a for a in arrays], 0)
