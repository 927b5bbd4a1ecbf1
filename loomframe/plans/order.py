"""Row order on unordered DataFrames, without putting all rows in one task.

Dense positions: the order keys alone are range-partitioned once, by all keys together, to get the first row of each
block; a row finds its block by a binary search over these literals, is numbered inside its block, and adds the count of
the blocks before it. As many leading keys are compared as tell the blocks apart. Ordered
windows then run in blocks of consecutive positions; a row that a frame in another block needs is copied there as a
halo, and running aggregates add the totals of the blocks before. A frame of up to BLOCK rows is a single block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks at most (beyond, blocks grow).
BLOCK, BLOCKS = 250_000, 20_000
POS, BLK = "__pos", "__blk"


@dataclass(frozen=True)
class Key:
    """A column of the row order; missing values come last in both directions."""

    name: str
    ascending: bool = True

    @property
    def column(self) -> Column:
        c = F.col(f"`{self.name}`")
        return c.asc_nulls_last() if self.ascending else c.desc_nulls_last()


def sort_columns(order: tuple[Key, ...]) -> list[Column]:
    return [k.column for k in order]


def with_position(df: DataFrame, order: tuple[Key, ...], name: str = POS, block: int = BLOCK) -> DataFrame:
    """df with the dense 0-based position of each row in the order.

    Rows of equal keys keep together in a block and are numbered arbitrarily: give a total order.
    """
    n = df.count()
    if n <= block:
        number = F.row_number().over(Window.orderBy(*sort_columns(order)))
        return df.withColumn(name, (number - 1).cast("long"))
    numbered = df.withColumn(BLK, _block(df, order, _bounds(df, order, min(BLOCKS, -(-n // block)))))
    local = F.row_number().over(Window.partitionBy(BLK).orderBy(*sort_columns(order)))
    sizes = numbered.groupBy(BLK).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(BLK, before.alias("__before"))  # a row a block, at most BLOCKS
    out = numbered.withColumn("__local", local).join(F.broadcast(offsets), BLK)
    return out.withColumn(name, F.col("__before") + F.col("__local") - 1).drop(BLK, "__local", "__before")


def _bounds(df: DataFrame, order: tuple[Key, ...], blocks: int) -> list[tuple]:
    """The first keys of each block but the first, in order: as many leading keys as make them distinct."""
    own = [Key(f"k{i}", k.ascending) for i, k in enumerate(order)]
    keys = df.select(*[F.col(f"`{k.name}`").alias(o.name) for k, o in zip(order, own, strict=True)])
    parts = keys.repartitionByRange(blocks, *sort_columns(tuple(own))).sortWithinPartitions(*sort_columns(tuple(own)))
    # a row's number inside its partition is the low 33 bits
    firsts = parts.withColumn("m", F.monotonically_increasing_id()).filter(F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    rows = [tuple(r)[:-1] for r in sorted(firsts.collect(), key=lambda r: r["m"])][1:]
    for width in range(1, len(order)):
        if len({r[:width] for r in rows}) == len(rows):
            return [r[:width] for r in rows]
    return list(dict.fromkeys(rows))


def _block(df: DataFrame, order: tuple[Key, ...], bounds: list[tuple]) -> Column:
    """The block of a row: how many of the sorted bounds it doesn't come before."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    used = order[: len(bounds[0])]
    ends = [F.array(*[F.lit(b[i]).cast(df.schema[k.name].dataType) for b in bounds]) for i, k in enumerate(used)]

    def reached(at: Column) -> Column:
        out = F.lit(True)
        for k, values in reversed(list(zip(used, ends, strict=True))):
            x, e = F.col(f"`{k.name}`"), F.get(values, at)
            after = F.when(e.isNull(), F.lit(False)).when(x.isNull(), F.lit(True)).otherwise(x > e if k.ascending else x < e)
            out = after | (x.eqNullSafe(e) & out)
        return out

    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length(), -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= n) & reached(F.least(a + s, F.lit(n)) - 1), a + s).otherwise(a))


def in_frames(df: DataFrame, before: int, after: int, make: Callable[[Window], dict[str, Column]], pos: str = POS, block: int = BLOCK) -> DataFrame:
    """Columns of ordered windows that look at most `before` rows back and `after` rows ahead.

    Runs in blocks of consecutive positions, each with a halo of its neighbours' rows.
    """
    size = max(block, 4 * (before + after))
    own = F.floor(F.col(pos) / size).cast("long")
    last, first = F.floor((F.col(pos) + before) / size).cast("long"), F.floor((F.col(pos) - after) / size).cast("long")
    spread = df.withColumn("__own", own).withColumn(BLK, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(BLK).orderBy(pos)
    return spread.withColumns(make(w)).filter(F.col(BLK) == F.col("__own")).drop(BLK, "__own")


def quantiles(df: DataFrame, value: Column, at: list[float], block: int = BLOCK) -> list[float | None]:
    """Exact quantiles of a float64 column, found by rank among its distinct values, so that no task holds them all."""
    counts = df.select(value.alias("__v")).filter("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__k"))
    total = counts.agg(F.sum("__k").alias("n")).first()["n"]
    if not total:
        return [None] * len(at)
    ends = [(math.floor((total - 1) * a), math.ceil((total - 1) * a), (total - 1) * a) for a in at]
    placed = running(with_position(counts, (Key("__v"),), POS, block), {"__upto": (F.col("__k").cast("double"), "sum")}, POS, block)
    nth = lambda i, name: F.min(F.when(F.col("__upto") > F.lit(i), F.col("__v"))).alias(name)
    found = placed.agg(*[nth(e[s], f"{'lh'[s]}{i}") for i, e in enumerate(ends) for s in (0, 1)]).first()
    pairs = [(found[f"l{i}"], found[f"h{i}"], e) for i, e in enumerate(ends)]
    return [x if x == y else (hi - at) * x + (at - lo) * y for x, y, (lo, hi, at) in pairs]


def running(df: DataFrame, columns: dict[str, tuple[Column, str]], pos: str = POS, block: int = BLOCK) -> DataFrame:
    """Running aggregates from the first row: name -> (value, how), how in sum, prod, min, max, count.

    Each block runs from its own start; the totals of the blocks before it, one row a block, are broadcast.
    """
    agg = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "count": F.count}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), "prod": lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0)), "min": F.least, "max": F.greatest, "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    names = list(columns)
    given = df.withColumns({f"__v{i}": columns[n][0] for i, n in enumerate(names)}).withColumn(BLK, F.floor(F.col(pos) / block).cast("long"))
    totals = given.groupBy(BLK).agg(*[agg[columns[n][1]](f"__v{i}").alias(f"__t{i}") for i, n in enumerate(names)])
    earlier = Window.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(BLK, *[agg["sum" if columns[n][1] == "count" else columns[n][1]](f"__t{i}").over(earlier).alias(f"__p{i}") for i, n in enumerate(names)])
    w = Window.partitionBy(BLK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = given.withColumns({f"__r{i}": agg[columns[n][1]](f"__v{i}").over(w) for i, n in enumerate(names)}).join(F.broadcast(prefix), BLK, "left")
    out = out.withColumns({n: join[columns[n][1]](F.col(f"__p{i}"), F.col(f"__r{i}")) for i, n in enumerate(names)})
    return out.drop(BLK, *[f"__{k}{i}" for k in "vtpr" for i in range(len(names))])
