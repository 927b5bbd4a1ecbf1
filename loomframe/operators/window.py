"""Windows in row order: rolling, expanding, shifts, running aggregates and ranks. None puts all rows in one task."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidOperation, TypeMismatch
from loomframe.functions import na
from loomframe.operators.frame import Frame, q
from loomframe.plans.order import BLK, BLOCK, POS, Key, in_frames, running, with_position

#: Blocks of a running median at most (beyond, blocks grow): the driver holds a count for each two.
MEDIAN_BLOCKS = 1000
AGGREGATES = ("sum", "mean", "min", "max", "std", "var", "count", "median")


def _over(how: str, x: Column, w) -> Column:
    if how == "median":
        values = F.sort_array(F.collect_list(x).over(w))
        n = F.size(values)
        mid = (n / 2).cast("int")
        return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, F.get(values, mid)).otherwise((F.get(values, mid) + F.get(values, mid - 1)) / 2)
    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count}[how]
    return f(x).over(w).cast("double")


class Windowed:
    """Numeric columns of a frame under a moving window; other columns are dropped."""

    frame: Frame

    def agg(self, how: str) -> Frame:
        raise NotImplementedError

    def sum(self) -> Frame:
        return self.agg("sum")

    def mean(self) -> Frame:
        return self.agg("mean")

    def min(self) -> Frame:
        return self.agg("min")

    def max(self) -> Frame:
        return self.agg("max")

    def std(self) -> Frame:
        return self.agg("std")

    def var(self) -> Frame:
        return self.agg("var")

    def count(self) -> Frame:
        return self.agg("count")

    def median(self) -> Frame:
        return self.agg("median")

    def _numbers(self) -> tuple[Frame, list[str]]:
        names = self.frame.numeric()
        if not names:
            raise TypeMismatch("no numeric column")
        return self.frame._keep(names), names


class Rolling(Windowed):
    """The last `size` rows, or as many around each row; missing until min_periods (default: size) values are there."""

    def __init__(self, frame: Frame, size: int, min_periods: int | None = None, center: bool = False):
        if size <= 0:
            raise InvalidOperation("a window has at least one row")
        self.frame, self.size = frame, size
        self.min_periods = size if min_periods is None else max(1, min_periods)
        self.ahead = size // 2 if center else 0

    def agg(self, how: str) -> Frame:
        if how not in AGGREGATES:
            raise InvalidOperation(f"unknown aggregate {how!r}")
        f, names = self._numbers()
        kinds = {n: f.schema[n].dataType for n in names}
        back = self.size - 1 - self.ahead

        def make(w) -> dict[str, Column]:
            frame = w.rowsBetween(-back, self.ahead)
            out = {}
            for n in names:
                x = na.as_double(q(n), kinds[n])
                out[f"__w{n}"] = F.when(F.count(x).over(frame) >= self.min_periods, _over(how, x, frame))
            return out

        df = in_frames(f.positioned(), max(0, back), max(0, self.ahead), make)
        return f._with(df.withColumns({n: q(f"__w{n}") for n in names}).drop(POS, *[f"__w{n}" for n in names]))


class Expanding(Windowed):
    """All rows up to each one; missing until min_periods values are there."""

    def __init__(self, frame: Frame, min_periods: int = 1):
        self.frame, self.min_periods = frame, max(1, min_periods)

    def agg(self, how: str) -> Frame:
        if how not in AGGREGATES:
            raise InvalidOperation(f"unknown aggregate {how!r}")
        f, names = self._numbers()
        kinds = {n: f.schema[n].dataType for n in names}
        x = {n: na.as_double(q(n), kinds[n]) for n in names}
        if how == "median":
            df = running_medians(f.positioned(), {f"__w{n}": na.quiet(x[n]) for n in names}, self.min_periods)
            return f._with(df.withColumns({n: q(f"__w{n}") for n in names}).drop(POS, *[f"__w{n}" for n in names]))
        wanted: dict[str, tuple[Column, str]] = {}
        for i, n in enumerate(names):
            wanted[f"__n{i}"] = (x[n], "count")
            if how in ("sum", "mean", "var", "std"):
                wanted[f"__s{i}"] = (x[n], "sum")
            if how in ("min", "max"):
                wanted[f"__m{i}"] = (x[n], how)
        given = f.positioned()
        if how in ("var", "std"):  # squares around the mean of all rows, which keeps them small
            means = given.agg(*[F.avg(x[n]).alias(n) for n in names]).first()
            for i, n in enumerate(names):
                d = x[n] - F.lit(float(means[n] or 0.0))
                wanted[f"__s{i}"], wanted[f"__q{i}"] = (d, "sum"), (d * d, "sum")
        df = running(given, wanted)
        out = {}
        for i, n in enumerate(names):
            count, total = F.col(f"__n{i}"), F.col(f"__s{i}") if how in ("sum", "mean", "var", "std") else None
            if how == "count":
                v = count.cast("double")
            elif how in ("min", "max"):
                v = F.col(f"__m{i}")
            elif how == "sum":
                v = total
            elif how == "mean":
                v = total / F.when(count > 0, count)
            else:
                v = F.greatest((F.col(f"__q{i}") - total * total / F.when(count > 0, count)) / F.when(count > 1, count - 1), F.lit(0.0))
                v = F.when(count > 1, F.sqrt(v) if how == "std" else v)
            out[n] = F.when(count >= self.min_periods, v)
        return f._with(df.withColumns(out).drop(POS, *wanted))


def running_medians(df: DataFrame, columns: dict[str, Column], least: int = 1, block: int = BLOCK) -> DataFrame:
    """df, which has positions, with the exact median of each column's values up to each row: missing until `least` are there.

    Runs in blocks of consecutive positions. Over a block of m rows the median moves by less than m ranks among the values
    before the block, so only the values within m ranks of it are copied there, in whole ranges of at most m values each: a
    task holds some five times m values, and what is copied grows as the input (but for the ranges looked through).
    """
    n, names = df.count(), list(columns)
    size = max(block, -(-n // MEDIAN_BLOCKS))
    numbered = lambda p: F.floor(F.col(p) / size).cast("long")
    rows = df.withColumns({BLK: numbered(POS), "__c": F.lit(None).cast("int"), **{f"__x{i}": columns[c] for i, c in enumerate(names)}})
    beside: list[dict[int, tuple[int, int]]] = [{} for _ in names]
    for i, c in enumerate(names) if n > size else ():
        there = df.select(F.col(POS).alias("__p"), columns[c].alias("__x")).filter("__x is not null")
        ranked = with_position(there, (Key("__x"), Key("__p")), "__r", block).select(numbered("__p").alias("__b"), numbered("__r").alias("__v"), "__x")
        counts = ranked.groupBy("__b", "__v").agg(F.count(F.lit(1))).collect()
        wanted, beside[i] = _ranges_near(counts, -(-n // size), size)
        if wanted:
            table = F.broadcast(df.sparkSession.createDataFrame(wanted, f"{BLK} long, __v long"))
            copies = ranked.join(table, "__v").filter(F.col("__b") < F.col(BLK)).select(BLK, F.lit(i).alias("__c"), F.col("__x").alias(f"__x{i}"))
            rows = rows.unionByName(copies, allowMissingColumns=True)
    kept = df.columns

    def fold(table: pa.Table) -> pa.Table:
        at, own = table[BLK][0].as_py(), table.filter(pc.is_null(table["__c"])).sort_by(POS)
        out = own.select(kept)
        for i, c in enumerate(names):
            earlier = np.sort(table[f"__x{i}"].filter(pc.equal(table["__c"], i)).to_numpy()).tolist()
            made = _medians(earlier, *beside[i].get(at, (0, 0)), own[f"__x{i}"].to_pylist(), least)
            out = out.append_column(c, pa.array(made, pa.float64()))
        return out

    return rows.groupBy(BLK).applyInArrow(fold, T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]]))


def _ranges_near(counts: Iterable[Sequence[int]], blocks: int, size: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """From (block, range of values, count): the ranges that each block needs of the blocks before it, and how many of their
    values lie below and above these ranges."""
    counts = [tuple(r) for r in counts]
    table = np.zeros((blocks, 1 + max((v for _, v, _ in counts), default=0)), dtype=np.int64)
    for b, v, k in counts:
        table[b, v] = k
    wanted, beside = [], {}
    for b, before in enumerate(np.cumsum(table, axis=0)[:-1], start=1):
        upto = np.cumsum(before)
        middle = upto[-1] // 2
        near = np.flatnonzero((before > 0) & (upto > middle - size - 2) & (upto - before < middle + size + 2))
        if len(near):
            wanted += [(b, int(v)) for v in near]
            beside[b] = int(upto[near[0]] - before[near[0]]), int(upto[-1] - upto[near[-1]])
    return wanted, beside


def _medians(earlier: list[float], below: int, above: int, values: Iterable[float | None], least: int) -> list[float | None]:
    """Medians after each value, by two heaps; before them come the sorted `earlier` ones, and others below and above those."""
    n = below + len(earlier) + above
    cut = max(0, (n + 1) // 2 - below)
    low, high = [-v for v in reversed(earlier[:cut])], earlier[cut:]
    out: list[float | None] = []
    for v in values:
        if v is not None:
            n += 1
            if low and v < -low[0]:
                heapq.heappush(low, -v)
            else:
                heapq.heappush(high, v)
            while below + len(low) < (n + 1) // 2:
                heapq.heappush(low, -heapq.heappop(high))
            while below + len(low) > (n + 1) // 2:
                heapq.heappush(high, -heapq.heappop(low))
        out.append(None if not n or n < least else -low[0] if n % 2 else (high[0] - low[0]) / 2)
    return out


def _shifted(f: Frame, names: list[str], periods: int, make: Callable[[Column, Column, str], Column]) -> Frame:
    """make(value, value `periods` rows before, name) for each column."""

    def columns(w) -> dict[str, Column]:
        other = lambda n: F.lag(q(n), periods).over(w) if periods > 0 else F.lead(q(n), -periods).over(w)
        return {f"__w{n}": make(q(n), other(n), n) for n in names}

    df = in_frames(f.positioned(), max(0, periods), max(0, -periods), columns)
    return f._with(df.withColumns({n: q(f"__w{n}") for n in names}).drop(POS, *[f"__w{n}" for n in names]))


def shift(f: Frame, names: list[str], periods: int = 1) -> Frame:
    f = f._keep(f.columns)
    return f if not periods else _shifted(f, names, periods, lambda x, y, n: y)


def diff(f: Frame, names: list[str], periods: int = 1) -> Frame:
    if not periods:
        raise InvalidOperation("diff over no rows")
    f = f._keep(f.columns)
    kinds = {n: f.schema[n].dataType for n in names}
    return _shifted(f, names, periods, lambda x, y, n: na.as_double(x, kinds[n]) - na.as_double(y, kinds[n]))


def pct_change(f: Frame, names: list[str], periods: int = 1) -> Frame:
    """x / earlier - 1 as IEEE says: a change from 0 is an infinity, from 0 to 0 NaN; missing only where a value is."""
    if not periods:
        raise InvalidOperation("change over no rows")
    f = f._keep(f.columns)
    kinds = {n: f.schema[n].dataType for n in names}
    return _shifted(f, names, periods, lambda x, y, n: na.fdiv(na.as_double(x, kinds[n]), na.as_double(y, kinds[n])) - 1.0)


def cumulative(f: Frame, names: list[str], how: str) -> Frame:
    """Running aggregate; a missing value stays missing and the run goes on."""
    f = f._keep(f.columns)
    x = {n: na.as_double(q(n), f.schema[n].dataType) for n in names}
    df = running(f.positioned(), {f"__c{i}": (x[n], how) for i, n in enumerate(names)})
    out = {n: F.when(q(n).isNotNull(), F.col(f"__c{i}")) for i, n in enumerate(names)}
    return f._with(df.withColumns(out).drop(POS, *[f"__c{i}" for i in range(len(names))]))


def rank(f: Frame, name: str, method: str = "average", ascending: bool = True) -> Frame:
    """Ranks from 1 of a numeric column; missing stays missing.

    Ranks are found on the distinct values with their counts, by running totals over their order, and joined back.
    """
    if method not in ("average", "min", "max", "first", "dense"):
        raise InvalidOperation(f"unknown method {method!r}")
    f = f._keep(f.columns)
    if not na.is_number(f.schema[name].dataType):
        raise TypeMismatch("ranks need numbers")
    value = na.as_double(q(name), f.schema[name].dataType)
    if method == "first":
        there = Frame(f.df.filter(q(name).isNotNull()), f.order, f.index)
        ranked = there._sorted([(q(name), ascending)])
        df = ranked.positioned().withColumn(name, (F.col(POS) + 1).cast("double")).drop(POS)
        rest = f.df.filter(q(name).isNull()).withColumn(name, F.lit(None).cast("double"))
        return f._with(df.select(*map(q, f.df.columns)).unionByName(rest.select(*map(q, f.df.columns))))
    counts = f.df.filter(q(name).isNotNull()).groupBy(value.alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    placed = running(with_position(counts, (Key("__v", ascending),)), {"__upto": (F.col("__k").cast("double"), "sum")})
    n = F.col("__k").cast("double")
    r = {"average": F.col("__upto") - (n - 1) / 2, "min": F.col("__upto") - n + 1, "max": F.col("__upto"), "dense": (F.col(POS) + 1).cast("double")}[method]
    table = placed.select("__v", r.alias("__rank"))
    df = f.df.withColumn("__v", value).join(table, "__v", "left").withColumn(name, F.col("__rank")).drop("__v", "__rank")
    return f._with(df.select(*map(q, f.df.columns)))
