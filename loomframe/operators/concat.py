"""Frames one after the other, or side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import functions as F

from loomframe.errors import InvalidOperation, LengthMismatch
from loomframe.functions import dtypes
from loomframe.operators.frame import Frame, Key, q
from loomframe.plans.order import POS


def concat(frames: Sequence[Frame | None], axis: int = 0, join: str = "outer", ignore_index: bool = False) -> Frame:
    """axis 0: rows of all frames in turn; columns as first seen (outer) or those in all frames (inner), in the type that
    holds all parts, missing where a frame lacks them. axis 1: columns side by side by position; a name seen before gets
    _1, _2, …. None is skipped."""
    given = [f for f in frames if f is not None]
    if not given:
        raise InvalidOperation("nothing to put together")
    if join not in ("outer", "inner"):
        raise InvalidOperation(f"unknown join {join!r}")
    return _below(given, join, ignore_index) if axis == 0 else _beside(given)


def _below(frames: list[Frame], join: str, ignore_index: bool) -> Frame:
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if join == "inner":
        names = [c for c in names if all(c in f.columns for f in frames)]
    kinds = {c: dtypes.promote_all([f.schema[c].dataType for f in frames if c in f.columns]) for c in names}
    levels = {len(f.index) for f in frames}
    if len(levels) > 1 and not ignore_index:
        raise InvalidOperation("labels differ in levels")
    index = () if ignore_index else frames[0].index
    metas = {}
    for c in names:
        own = [f.schema[c].metadata or {} for f in frames if c in f.columns]
        if all("categories" in m for m in own):
            cats = list(dict.fromkeys(x for m in own for x in m["categories"]))
            metas[c] = {"categories": cats, "ordered": all(m == own[0] for m in own) and own[0]["ordered"]}
    simple = all(len(f.order) == 1 and f.order[0].ascending for f in frames) and len({f.df.schema[f.order[0].name].dataType.simpleString() for f in frames}) == 1
    parts = []
    for i, f in enumerate(frames):
        df, key = (f.df, q(f.order[0].name)) if simple else (f.positioned(), F.col(POS))
        cols = [dtypes.cast(q(c), f.schema[c].dataType, kinds[c]).alias(c) if c in f.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]
        labels = [q(a).alias(b) for a, b in zip(f.index, index, strict=False)]
        parts.append(df.select(*labels, *cols, F.lit(i).alias("__o0"), key.alias("__o1")))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    for c, m in metas.items():
        out = out.withMetadata(c, m)
    return Frame(out, [Key("__o0"), Key("__o1")], index)


def _beside(frames: list[Frame]) -> Frame:
    if len({len(f) for f in frames}) > 1:
        raise LengthMismatch("frames differ in length")
    seen: dict[str, int] = {}
    first = frames[0]
    out = None
    for f in frames:
        cols = []
        for c in f.columns:
            k = seen.get(c, 0)
            seen[c] = k + 1
            cols.append(q(c).alias(f"{c}_{k}" if k else c))
        labels = [q(n) for n in f.index] if f is first else []
        df = f.positioned().select(POS, *labels, *cols)
        out = df if out is None else out.join(df, POS)
    return Frame(out.withColumnRenamed(POS, "__o0"), [Key("__o0")], first.index)
