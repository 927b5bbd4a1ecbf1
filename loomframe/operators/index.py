"""Labels as such: set operations, hierarchical labels, and facts about time labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidIndex, LengthMismatch
from loomframe.operators.frame import Frame, Key, q
from loomframe.plans.order import POS, in_frames, sort_columns, with_position


def _distinct(f: Frame) -> Frame:
    """The distinct labels in the order of their first place."""
    return Frame(f.drop_duplicates_raw(list(f.index)).select(*map(q, f.index), *[q(k.name).alias(f"__o{i}") for i, k in enumerate(f.order)]), [Key(f"__o{i}", k.ascending) for i, k in enumerate(f.order)], f.index)


def _same(a: Frame, b: Frame) -> None:
    if not a.index or len(a.index) != len(b.index):
        raise InvalidIndex("both frames need labels of as many levels")


def union(a: Frame, b: Frame) -> Frame:
    """Labels of a, then those of b that a lacks."""
    _same(a, b)
    x, y = _distinct(a), _distinct(b)
    rest = _semi(y, x, "left_anti")
    names, n = list(a.index), max(len(x.order), len(y.order))
    side = lambda f, i: f.df.select(*[q(c).alias(m) for c, m in zip(f.index, names, strict=True)], F.lit(i).alias("__o0"), *[q(f.order[j].name).alias(f"__o{j + 1}") if j < len(f.order) else F.lit(0).alias(f"__o{j + 1}") for j in range(n)])
    return Frame(side(x, 0).unionByName(side(rest, 1)), [Key(f"__o{j}") for j in range(n + 1)], names)


def intersection(a: Frame, b: Frame) -> Frame:
    """Labels of a that b has."""
    _same(a, b)
    return _semi(_distinct(a), _distinct(b), "left_semi")


def difference(a: Frame, b: Frame) -> Frame:
    """Labels of a that b lacks."""
    _same(a, b)
    return _semi(_distinct(a), _distinct(b), "left_anti")


def _semi(a: Frame, b: Frame, how: str) -> Frame:
    other = b.df.select(*[q(n).alias(f"__k{i}") for i, n in enumerate(b.index)])
    cond = None
    for i, n in enumerate(a.index):
        c = q(n).eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    return Frame(a.df.join(other, cond, how), a.order, a.index)


def levels(f: Frame) -> list[list[Any]]:
    """The sorted distinct labels of each level, missing left out."""
    return [sorted(r[0] for r in f.df.select(q(n)).distinct().collect() if r[0] is not None) for n in f.index]


def codes(f: Frame) -> Frame:
    """For each row the places of its labels in the levels, -1 for missing: columns named after the levels."""
    df = f.df
    for n in f.index:  # the level tables stay distributed, so that they may be of any size
        values = df.select(q(n).alias("__v")).filter("__v is not null").distinct()
        table = with_position(values, (Key("__v"),), f"__c_{n}")
        df = df.join(table, q(n) == F.col("__v"), "left").drop("__v").withColumn(f"__c_{n}", F.coalesce(q(f"__c_{n}"), F.lit(-1).cast("long")))
    order = [Key(f"__o{i}", k.ascending) for i, k in enumerate(f.order)]
    return Frame(df.select(*[q(f"__c_{n}").alias(n) for n in f.index], *[q(k.name).alias(o.name) for k, o in zip(f.order, order, strict=True)]), order)


def tuples(f: Frame) -> list[tuple]:
    """All labels in order, on the driver."""
    return [tuple(r) for r in f.df.orderBy(*sort_columns(f.order)).select(*map(q, f.index)).collect()]


def equal(a: Frame, b: Frame) -> bool:
    """Whether both have the same labels in the same order, missing ones equal; text equals text only."""
    text = [[isinstance(f.df.schema[n].dataType, T.StringType) for n in f.index] for f in (a, b)]
    if text[0] != text[1]:
        return False
    side = lambda f, s: f.positioned().select(F.col(POS).alias(f"__{s}"), *[q(n).alias(f"__{s}{i}") for i, n in enumerate(f.index)])
    both = side(a, "a").join(side(b, "b"), F.col("__a") == F.col("__b"), "full")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for i in range(len(a.index)):
        same &= F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))
    return both.filter(~same).isEmpty()


def from_arrays(spark, arrays: Sequence[Sequence[Any]], names: Sequence[str]) -> Frame:
    if len({len(x) for x in arrays}) > 1:
        raise LengthMismatch("levels differ in length")
    f = Frame.from_rows(spark, zip(*arrays, strict=True), names)
    return Frame(f.df, f.order, names)


def from_tuples(spark, rows: Sequence[Sequence[Any]], names: Sequence[str]) -> Frame:
    if any(len(r) != len(names) for r in rows):
        raise LengthMismatch("a label lacks a level")
    f = Frame.from_rows(spark, rows, names)
    return Frame(f.df, f.order, names)


def from_codes(spark, level_values: Sequence[Sequence[Any]], rows: Sequence[Sequence[int]], names: Sequence[str]) -> Frame:
    return from_tuples(spark, [[lv[c] if c >= 0 else None for lv, c in zip(level_values, r, strict=True)] for r in rows], names)


def positions(f: Frame, label: Any) -> list[int]:
    """Positions of a label, ascending."""
    df, name = f._labels()
    at = Frame(df, f.order).positioned().filter(q(name) == f._label_value(df, name, label))
    return sorted(r["__pos"] for r in at.select("__pos").collect())


def ends(f: Frame) -> tuple[Any, Any]:
    """The smallest and largest label."""
    r = f.df.agg(F.min(q(f._one_label())).alias("a"), F.max(q(f._one_label())).alias("b")).first()
    return r["a"], r["b"]


def is_monotonic_increasing(f: Frame) -> bool:
    """Whether labels never fall; with a missing one they aren't in order."""
    df, name = f._labels()
    at: DataFrame = Frame(df, f.order).positioned().select(POS, q(name).alias("l"))
    seen = in_frames(at, 1, 0, lambda w: {"p": F.lag("l").over(w)})
    return seen.filter(F.col("l").isNull() | (F.col("p") > F.col("l"))).isEmpty()
