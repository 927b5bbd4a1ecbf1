"""Equi-joins of frames. Missing keys never match; the physical join is left to the optimiser."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidJoin, TypeMismatch
from loomframe.functions import na
from loomframe.operators.frame import Frame, Key, q

#: Pairs a task makes where the keys of both sides repeat much, rows of the side that then goes to every task, tasks at most.
PAIRS, HELD, TASKS = 2_000_000, 1_000_000, 2000
HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross"}


def _side(f: Frame, tag: str) -> tuple[DataFrame, dict[str, str], list[Key]]:
    """The frame's columns under names of its own, and its order keys."""
    names = {c: f"__{tag}_{i}" for i, c in enumerate([*f.index, *f.columns])}
    order = [Key(f"__{tag}o_{i}", k.ascending) for i, k in enumerate(f.order)]
    cols = [q(c).alias(n) for c, n in names.items()] + [q(k.name).alias(o.name) for k, o in zip(f.order, order, strict=True)]
    return f.df.select(*cols, F.lit(True).alias(f"__{tag}_there")), names, order


def _key(c: Column, t: T.DataType, other: T.DataType) -> Column:
    """A key column in the type both sides share: numbers and bools as float64 unless both are whole."""
    if na.is_number(t) and na.is_number(other):
        return c.cast("long") if isinstance(t, T.IntegralType) and isinstance(other, T.IntegralType) else na.as_double(c, t)
    times = (T.TimestampNTZType, T.TimestampType)
    if isinstance(t, times) and isinstance(other, times):
        return c.cast("timestamp_ntz")
    if type(t) is not type(other):
        raise TypeMismatch(f"can't join {t.simpleString()} to {other.simpleString()}")
    return c


def _unique(f: Frame, keys: Sequence[str], side: str) -> None:
    if not f.df.dropna(subset=list(keys)).groupBy(*map(q, keys)).count().filter("count > 1").isEmpty():
        raise InvalidJoin(f"keys of the {side} frame repeat")


def merge(
    left: Frame, right: Frame, on: str | Sequence[str] | None = None, left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None,
    how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), validate: str | None = None, indicator: bool = False,
) -> Frame:
    """Rows of both frames whose keys are equal. Columns: keys, the left rest, the right rest, `_merge`.

    Rows come in the left order, then the right one (right joins: the other way round); right rows that match nothing
    are at the end of an outer join. Names in both frames get the suffixes, shared keys don't. The result has default
    labels.
    """
    if how not in HOW:
        raise InvalidJoin(f"unknown join {how!r}")
    listed = lambda x: [x] if isinstance(x, str) else list(x or ())
    lk, rk = (listed(on), listed(on)) if on else (listed(left_on), listed(right_on))
    if how == "cross":
        if lk or rk:
            raise InvalidJoin("a cross join has no keys")
        return _cross(left, right, suffixes)
    if not lk or len(lk) != len(rk):
        raise InvalidJoin("name the keys of both frames")
    left._need(lk)
    right._need(rk)
    if validate:
        known = {"one_to_one": "lr", "1:1": "lr", "one_to_many": "l", "1:m": "l", "many_to_one": "r", "m:1": "r", "many_to_many": "", "m:m": ""}
        if validate not in known:
            raise InvalidJoin(f"unknown validation {validate!r}")
        for tag, f, k in (("l", left, lk), ("r", right, rk)):
            if tag in known[validate]:
                _unique(f, k, "left" if tag == "l" else "right")
    ld, ln, lo = _side(left, "l")
    rd, rn, ro = _side(right, "r")
    kinds = [(left.df.schema[a].dataType, right.df.schema[b].dataType) for a, b in zip(lk, rk, strict=True)]
    cond = [_key(F.col(ln[a]), ta, tb) == _key(F.col(rn[b]), tb, ta) for (a, b), (ta, tb) in zip(zip(lk, rk, strict=True), kinds, strict=True)]
    ld, rd = _dealt(ld, rd, [_key(F.col(ln[a]), ta, tb) for a, (ta, tb) in zip(lk, kinds, strict=True)], [_key(F.col(rn[b]), tb, ta) for b, (ta, tb) in zip(rk, kinds, strict=True)], how)
    joined = ld.join(rd, reduce(lambda a, b: a & b, cond), HOW[how])

    out: list[Column] = []
    overlap = set(left.columns) & set(right.columns) - (set(lk) if on else set())
    metas = {}
    for a, b, (ta, tb) in zip(lk, rk, kinds, strict=True):
        x, y = F.col(ln[a]), F.col(rn[b])
        if on:
            both = F.coalesce(x, y) if ta == tb else F.coalesce(_key(x, ta, tb), _key(y, tb, ta))
            out.append((x if how in ("inner", "left") else both).alias(a))
        else:
            out.append(x.alias(f"{a}{suffixes[0]}" if a in overlap and a not in lk else a))
        if left.df.schema[a].metadata and left.df.schema[a].metadata == right.df.schema[b].metadata:
            metas[a] = left.df.schema[a].metadata
    key_names = set(lk)
    for c in left.columns:
        if c not in lk:
            out.append(F.col(ln[c]).alias(f"{c}{suffixes[0]}" if c in overlap else c))
    for c in right.columns:
        if c not in rk:
            out.append(F.col(rn[c]).alias(f"{c}{suffixes[1]}" if c in overlap or c in key_names else c))
    if indicator:
        here, there = F.col("__l_there").isNotNull(), F.col("__r_there").isNotNull()
        out.append(F.when(here & there, "both").when(here, "left_only").otherwise("right_only").alias("_merge"))
    return _framed(joined, out, [*ro, *lo] if how == "right" else [*lo, *ro], metas)


def _dealt(ld: DataFrame, rd: DataFrame, lk: list[Column], rk: list[Column], how: str) -> tuple[DataFrame, DataFrame]:
    """Both sides; where few keys make many pairs, one is dealt out evenly by rows and the other, if small, held by every task.

    A shuffle by key has as many busy tasks as there are keys, and its size says nothing of the pairs. Only sides that come
    straight from a table are counted, as others would be made twice.
    """
    if how == "outer" or any(re.search(r"\b(Aggregate|Join|Window|Generate|Distinct|\w*(Python|Pandas|Arrow)\w*)\b", d._jdf.queryExecution().analyzed().toString()) for d in (ld, rd)):
        return ld, rd
    (ln, lu), (rn, ru) = (d.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*k))).first() for d, k in ((ld, lk), (rd, rk)))
    pairs = ln * rn // max(lu, ru, 1)
    if pairs <= max(PAIRS, 8 * (ln + rn)):
        return ld, rd
    tasks = min(TASKS, -(-pairs // PAIRS))
    if rn <= HELD and (how == "left" or (how == "inner" and rn <= ln)):
        return ld.repartition(tasks), F.broadcast(rd)
    if ln <= HELD and how in ("right", "inner"):
        return F.broadcast(ld), rd.repartition(tasks)
    return ld, rd


def _framed(joined: DataFrame, out: list[Column], order: list[Key], metas: dict) -> Frame:
    hidden = [F.col(k.name).alias(f"__o{i}") for i, k in enumerate(order)]
    df = joined.select(*out, *hidden)
    if len(set(df.columns)) < len(df.columns):
        raise InvalidJoin("two columns would have one name: give suffixes")
    for c, m in metas.items():
        df = df.withMetadata(c, m)
    return Frame(df, [Key(f"__o{i}", k.ascending) for i, k in enumerate(order)])


def _cross(left: Frame, right: Frame, suffixes: tuple[str, str]) -> Frame:
    ld, ln, lo = _side(left, "l")
    rd, rn, ro = _side(right, "r")
    both = set(left.columns) & set(right.columns)
    out = [F.col(ln[c]).alias(f"{c}{suffixes[0]}" if c in both else c) for c in left.columns]
    out += [F.col(rn[c]).alias(f"{c}{suffixes[1]}" if c in both else c) for c in right.columns]
    return _framed(ld.crossJoin(rd), out, [*lo, *ro], {})


def join(left: Frame, right: Frame, on: str | None = None, how: str = "left", lsuffix: str = "", rsuffix: str = "") -> Frame:
    """Joins by label: labels to labels, or a left column to the other frame's labels. Clashing names need a suffix."""
    if how not in ("left", "inner", "outer"):
        raise InvalidJoin(f"unknown join {how!r}")
    overlap = set(left.columns) & set(right.columns)
    if overlap and not (lsuffix or rsuffix):
        raise InvalidJoin(f"columns {sorted(overlap)} are in both frames")
    ren = lambda f, s: f.rename({c: f"{c}{s}" for c in overlap})
    a, b = ren(left, lsuffix), ren(right, rsuffix)
    if len(b.index) != (1 if on else max(1, len(a.index))) and b.index:
        raise InvalidJoin("labels differ in levels")
    label = lambda i: f"__label{i}"

    def labelled(f: Frame) -> tuple[Frame, list[str]]:
        if not f.index:
            return Frame(f.positioned().withColumnRenamed("__pos", label(0)), f.order), ["index"]
        return Frame(f.df.withColumnsRenamed({n: label(i) for i, n in enumerate(f.index)}), f.order), list(f.index)

    y, ynames = labelled(b)
    if on:
        key = on if on not in overlap else f"{on}{lsuffix}"
        text = isinstance(y.df.schema[label(0)].dataType, T.StringType) and not isinstance(a.df.schema[key].dataType, T.StringType)
        x = a._put({label(0): q(key).cast("string") if text else q(key)})
        return merge(x, y, on=label(0), how=how).drop(label(0))
    x, xnames = labelled(a)
    levels = [label(i) for i in range(len(xnames))]
    out = merge(x, y, on=levels, how=how)
    return Frame(out.df.withColumnsRenamed(dict(zip(levels, xnames, strict=True))), out.order, xnames if a.index else ()).drop(*([] if a.index else ["index"]))
