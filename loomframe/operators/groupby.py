"""Grouping: aggregations combined before the shuffle, transforms and filters by joining group results back."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import ColumnNotFound, InvalidOperation, TypeMismatch
from loomframe.functions import na
from loomframe.operators.frame import Frame, Key, q
from loomframe.operators.series import AGGREGATES, NUMERIC, Series, reduction


@dataclass(frozen=True)
class Condition:
    """A test of a group: its size, or the count of a column's values that are there."""

    column: str | None
    op: str
    value: float

    def test(self, c: Column) -> Column:
        return {"==": c == self.value, "!=": c != self.value, ">": c > self.value, ">=": c >= self.value, "<": c < self.value, "<=": c <= self.value}[self.op]


class _Count:
    def __init__(self, column: str | None):
        self.column = column

    def __gt__(self, v):
        return Condition(self.column, ">", v)

    def __ge__(self, v):
        return Condition(self.column, ">=", v)

    def __lt__(self, v):
        return Condition(self.column, "<", v)

    def __le__(self, v):
        return Condition(self.column, "<=", v)

    def __eq__(self, v):  # type: ignore[override]
        return Condition(self.column, "==", v)

    def __ne__(self, v):  # type: ignore[override]
        return Condition(self.column, "!=", v)

    __hash__ = object.__hash__


def group_size() -> _Count:
    return _Count(None)


def group_count(column: str) -> _Count:
    return _Count(column)


class GroupBy:
    """Groups by keys. Rows with a missing key go unless dropna is off, when missing is a group, the last one. Groups are
    sorted by key (categories by rank), or come in the order of their first row; keys are columns, or labels."""

    def __init__(self, frame: Frame, keys: Sequence[str], dropna: bool = True, sort: bool = True, as_index: bool = False):
        frame._need(keys)
        if not keys:
            raise InvalidOperation("group by at least one column")
        self.frame, self.keys, self.dropna, self.sort, self.as_index = frame, list(keys), dropna, sort, as_index

    def _rows(self) -> DataFrame:
        return self.frame.df.dropna(subset=self.keys) if self.dropna else self.frame.df

    def _single_order(self) -> tuple[DataFrame, Column]:
        """Rows with one comparable column that orders them ascending."""
        order = self.frame.order
        if len(order) == 1 and order[0].ascending:
            return self._rows(), q(order[0].name)
        if all(k.ascending for k in order):
            return self._rows(), F.struct(*[q(k.name) for k in order])
        f = Frame(self._rows(), order, self.frame.index)
        return f.positioned(), F.col("__pos")

    def _reduce(self, how: str, name: str, order: Column) -> Column:
        c, field = q(name), self.frame.df.schema[name]
        if how == "first":
            return F.min_by(c, F.when(c.isNotNull(), order))
        if how == "last":
            return F.max_by(c, F.when(c.isNotNull(), order))
        return reduction(how, c, field)

    def _agg(self, wanted: Sequence[tuple[str, str, str]]) -> Frame:
        """(column, aggregate, name of the result)."""
        names = [n for _, _, n in wanted]
        if len({*names, *self.keys}) < len(names) + len(self.keys):
            raise InvalidOperation("two results would have one name")
        for c, how, _ in wanted:
            if how not in AGGREGATES or how == "quantile":
                raise InvalidOperation(f"unknown aggregate {how!r}")
            if how != "size" and c not in self.frame.schema:
                raise ColumnNotFound(c)
            if how in NUMERIC and not na.is_number(self.frame.df.schema[c].dataType):
                raise TypeMismatch(f"{how} of {c}, which is no number")
        needs_order = not self.sort or any(how in ("first", "last") for _, how, _ in wanted)
        df, order = self._single_order() if needs_order else (self._rows(), F.lit(0))
        cols = [(F.count(F.lit(1)) if how == "size" else self._reduce(how, c, order)).alias(n) for c, how, n in wanted]
        extra = [] if self.sort else [F.min(order).alias("__o0")]
        out = df.groupBy(*map(q, self.keys)).agg(*cols, *extra)
        return self._framed(out)

    def _framed(self, out: DataFrame) -> Frame:
        for k in self.keys:
            if meta := self.frame.df.schema[k].metadata:
                out = out.withMetadata(k, meta)
        f = Frame(out, [Key(k) for k in self.keys] if self.sort else [Key("__o0")])
        if self.sort and any("categories" in (self.frame.df.schema[k].metadata or {}) for k in self.keys):
            f = f.sort_values(self.keys)
        return Frame(f.df, f.order, self.keys) if self.as_index else f

    def _each(self, how: str, columns: Sequence[str]) -> Frame:
        free = [c for c in self.frame.columns if c not in self.keys]
        chosen = list(columns) or [c for c in free if how not in NUMERIC or na.is_number(self.frame.schema[c].dataType)]
        self.frame._need(chosen)
        return self._agg([(c, how, c) for c in chosen])

    def size(self) -> Frame:
        return self._agg([("", "size", "size")])

    def count(self, *columns: str) -> Frame:
        return self._each("count", columns)

    def sum(self, *columns: str) -> Frame:
        return self._each("sum", columns)

    def mean(self, *columns: str) -> Frame:
        return self._each("mean", columns)

    def median(self, *columns: str) -> Frame:
        return self._each("median", columns)

    def min(self, *columns: str) -> Frame:
        return self._each("min", columns)

    def max(self, *columns: str) -> Frame:
        return self._each("max", columns)

    def var(self, *columns: str) -> Frame:
        return self._each("var", columns)

    def std(self, *columns: str) -> Frame:
        return self._each("std", columns)

    def nunique(self, *columns: str) -> Frame:
        return self._each("nunique", columns)

    def first(self, *columns: str) -> Frame:
        return self._each("first", columns)

    def last(self, *columns: str) -> Frame:
        return self._each("last", columns)

    def agg(self, wanted: dict[str, str]) -> Frame:
        """Column to aggregate; results are named column_aggregate and sorted by column."""
        return self._agg([(c, wanted[c], f"{c}_{wanted[c]}") for c in sorted(wanted)])

    def agg_list(self, wanted: dict[str, Sequence[str]]) -> Frame:
        return self._agg([(c, how, f"{c}_{how}") for c in sorted(wanted) for how in wanted[c]])

    def _joined(self, table: DataFrame, how: str) -> DataFrame:
        """The frame's rows with the group results: a join on the keys, whose table AQE broadcasts if it is small, and
        whose large side it splits if a key is hot."""
        right = table.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(self.keys)})
        on = [q(k).eqNullSafe(F.col(f"__k{i}")) if not self.dropna else q(k) == F.col(f"__k{i}") for i, k in enumerate(self.keys)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return self.frame.df.join(right, cond, how).drop(*[f"__k{i}" for i in range(len(self.keys))])

    def transform(self, column: str, how: str) -> Series:
        """A group's aggregate at each of its rows; missing at rows whose key is missing. Order and labels stay."""
        if how == "size":
            table = GroupBy(self.frame, self.keys, self.dropna)._agg([("", "size", "__t")])
        else:
            table = GroupBy(self.frame, self.keys, self.dropna)._agg([(column, how, "__t")])
        df = self._joined(table.df.select(*map(q, self.keys), "__t"), "left")
        f = self.frame._with(df.withColumn(column if how != "size" else "size", F.col("__t")).drop("__t")) if column not in self.keys else self.frame._with(df.withColumnRenamed("__t", f"{column}_{how}"))
        return f.col("size" if how == "size" else column if column not in self.keys else f"{column}_{how}")

    def filter(self, condition: Condition) -> Frame:
        """Rows of groups that pass; rows with a missing key go."""
        n = F.count(F.lit(1)) if condition.column is None else F.count(q(condition.column))
        table = self.frame.df.dropna(subset=self.keys).groupBy(*map(q, self.keys)).agg(n.alias("__n")).filter(condition.test(F.col("__n"))).drop("__n")
        return self.frame._with(GroupBy(self.frame, self.keys, True)._joined(table, "left_semi"))

    def apply(self, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> Frame:
        """A function of each group's rows, in order, as pandas; results are put together in the order of groups.

        A group is held by one Python task: use aggregates, transforms or filters where groups can be large.
        """
        keys, order = self.keys, [(k.name, k.ascending) for k in self.frame.order]
        data = self.frame.columns
        struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names = struct.fieldNames()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([n for n, _ in order], ascending=[a for _, a in order], kind="stable")
            at = tuple(pdf[k].iloc[0] for k in keys)
            out = fn(pdf[data].reset_index(drop=True))
            if out is None:
                out = pd.DataFrame({n: [] for n in names})
            out = out[names].copy()
            for i, v in enumerate(at):
                out[f"__o{i}"] = [v] * len(out)
            out[f"__o{len(at)}"] = range(len(out))
            return out

        full = T.StructType([*struct.fields, *[T.StructField(f"__o{i}", self.frame.df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField(f"__o{len(keys)}", T.LongType())])
        df = self._rows().groupBy(*map(q, keys)).applyInPandas(run, full)
        return Frame(df, [Key(f"__o{i}") for i in range(len(keys) + 1)])


