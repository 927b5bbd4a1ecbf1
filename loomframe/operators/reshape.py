"""Melt, pivot, pivot tables, stack and unstack."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.errors import InvalidIndex, InvalidOperation, NotSupported
from loomframe.functions import dtypes
from loomframe.operators.frame import Frame, Key, q
from loomframe.operators.series import reduction

#: Column labels of a pivot at most: they become columns of the plan.
LABELS = 10_000


def melt(f: Frame, id_vars: Sequence[str] = (), value_vars: Sequence[str] = (), var_name: str = "variable", value_name: str = "value") -> Frame:
    """Columns as rows: all rows of the first variable, then those of the next. Types that differ are promoted."""
    f._need([*id_vars, *value_vars])
    values = list(value_vars) or [c for c in f.columns if c not in id_vars]
    kind = dtypes.promote_all([f.schema[c].dataType for c in values])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("k"), dtypes.cast(q(c), f.schema[c].dataType, kind).alias("v")) for i, c in enumerate(values)])
    keys = [q(k.name).alias(f"__o{j + 1}") for j, k in enumerate(f.order)]
    df = f.df.select(*map(q, id_vars), *keys, F.explode(cells).alias("__c"))
    df = df.select(*map(q, id_vars), F.col("__c.k").alias(var_name), F.col("__c.v").alias(value_name), F.col("__c.i").alias("__o0"), *[F.col(f"__o{j + 1}") for j in range(len(f.order))])
    return Frame(df, [Key("__o0"), *[Key(f"__o{j + 1}", k.ascending) for j, k in enumerate(f.order)]])


def _labels(df: DataFrame, c: Column) -> list[Any]:
    found = [r[0] for r in df.select(c.alias("l")).filter("l is not null").distinct().limit(LABELS + 1).collect()]
    if len(found) > LABELS:
        raise InvalidOperation(f"more than {LABELS} column labels")
    return sorted(found)


def _text(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return f"{v:g}" if isinstance(v, float) else str(v)


def pivot(f: Frame, index: str, columns: str, values: str) -> Frame:
    """One row a label of `index`, one column a label of `columns`, both sorted; a cell that occurs twice is refused. Rows
    with a missing key are left out."""
    f._need([index, columns, values])
    df = f.df.dropna(subset=[index, columns])
    if not df.groupBy(q(index), q(columns)).count().filter("count > 1").isEmpty():
        raise InvalidOperation("a cell occurs twice")
    labels = _labels(df, q(columns))
    out = df.groupBy(q(index)).agg(*[F.max(F.when(q(columns) == F.lit(v), q(values))).alias(_text(v)) for v in labels])
    return Frame(out, [Key(index)], [index])


def pivot_table(f: Frame, index: Sequence[str], columns: Sequence[str] = (), values: Sequence[str] = (), aggfunc: str | Sequence[str] = "mean", fill: Any = None) -> Frame:
    """Aggregates by index and column labels, in one aggregation. Names are made of value, aggregate and label, the parts
    that there is more than one of, joined by _; a single part stands alone. Rows with a missing key are left out."""
    if len(columns) > 1:
        raise NotSupported("one column key at most")
    f._need([*index, *columns, *values])
    how = [aggfunc] if isinstance(aggfunc, str) else list(aggfunc)
    chosen = list(values) or [c for c in f.numeric() if c not in (*index, *columns)]
    df = f.df.dropna(subset=[*index, *columns])
    labels = _labels(df, q(columns[0])) if columns else [None]
    out, names = [], []
    for v in chosen:
        for h in how:
            for lab in labels:
                cell = q(v) if lab is None else F.when(q(columns[0]) == F.lit(lab), q(v))
                c = reduction(h, cell, f.schema[v])
                if h in ("sum", "count") and lab is not None:
                    there = F.count(F.when(q(columns[0]) == F.lit(lab), 1))
                    c = F.when(there > 0, c)
                parts = [*([v] if len(chosen) > 1 or lab is None else []), *([h] if len(how) > 1 else []), *([_text(lab)] if lab is not None else [])]
                names.append("_".join(parts))
                out.append((F.coalesce(c, F.lit(fill).cast("double")) if fill is not None else c).alias(names[-1]))
    table = df.groupBy(*map(q, index)).agg(*out)
    return Frame(table, [Key(k) for k in index], index)


def stack(f: Frame) -> Frame:
    """All cells row by row as one column `value`, labelled by the row's labels and the column's name; missing cells stay."""
    names = f.columns
    kind = dtypes.promote_all([f.schema[c].dataType for c in names])
    if f.index:
        base, levels, order = f.df, list(f.index), list(f.order)
    else:
        base, levels, order = f.positioned().withColumnRenamed("__pos", "index"), ["index"], [Key("index")]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("k"), dtypes.cast(q(c), f.schema[c].dataType, kind).alias("v")) for i, c in enumerate(names)])
    keys = [q(k.name).alias(f"__o{j}") for j, k in enumerate(order)]
    df = base.select(*map(q, levels), *keys, F.explode(cells).alias("__c"))
    n = len(order)
    df = df.select(*map(q, levels), F.col("__c.k").alias("column"), F.col("__c.v").alias("value"), *[F.col(f"__o{j}") for j in range(n)], F.col("__c.i").alias(f"__o{n}"))
    df = df.withMetadata("column", {"stacked": names})
    return Frame(df, [*[Key(f"__o{j}", k.ascending) for j, k in enumerate(order)], Key(f"__o{n}")], [*levels, "column"])


def unstack(f: Frame) -> Frame:
    """The last label level as columns, in sorted order, or in their own order where stack() made them; rows are sorted by
    the other levels. A cell that occurs twice and a missing column label are refused; several data columns are named
    column_label."""
    if len(f.index) < 2:
        raise InvalidIndex("unstack needs two levels")
    *levels, last = f.index
    if not f.df.filter(q(last).isNull()).isEmpty():
        raise InvalidIndex("a column label is missing")
    if not f.df.groupBy(*map(q, f.index)).count().filter("count > 1").isEmpty():
        raise InvalidIndex("a cell occurs twice")
    there = _labels(f.df, q(last))
    own = (f.df.schema[last].metadata or {}).get("stacked")
    labels = [v for v in own if v in there] if own else there
    many = len(f.columns) > 1
    out = [F.max(F.when(q(last) == F.lit(v), q(c))).alias(f"{c}_{_text(v)}" if many else _text(v)) for c in f.columns for v in labels]
    return Frame(f.df.groupBy(*map(q, levels)).agg(*out), [Key(k) for k in levels], levels)


