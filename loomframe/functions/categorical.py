"""Categories: text columns whose metadata lists the categories, in order, and whether that order counts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import InvalidDType, InvalidOperation, TypeMismatch

if TYPE_CHECKING:
    from loomframe.operators.frame import Frame
    from loomframe.operators.series import Series


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def tagged(frame: Frame, name: str, column: Column, categories: Sequence[str], ordered: bool) -> Frame:
    meta = {"categories": list(categories), "ordered": ordered}
    df = frame._put({name: column}).df
    return frame._with(df.withMetadata(name, meta))


def make(frame: Frame, name: str, categories: Sequence[str] | None = None, ordered: bool = False) -> Frame:
    """A column as categories: the list given, in its order, or the sorted distinct labels.

    A given list holds no label twice and none that is missing; a label outside it is refused when read.
    """
    frame._need([name])
    if not isinstance(frame.df.schema[name].dataType, T.StringType):
        raise TypeMismatch("categories are labels of text")
    if categories is None:
        categories = sorted(r[0] for r in frame.df.select(_q(name)).distinct().collect() if r[0] is not None)
        return tagged(frame, name, _q(name), categories, ordered)
    if None in categories or len(set(categories)) < len(categories):
        raise InvalidOperation("categories are distinct and not missing")
    known = F.when(_q(name).isNull() | _q(name).isin(list(categories)), _q(name))
    return tagged(frame, name, known.otherwise(F.raise_error(F.concat(F.lit("no category: "), _q(name))).cast("string")), categories, ordered)


class Categories:
    def __init__(self, series: Series):
        meta = series.field.metadata or {}
        if "categories" not in meta:
            raise InvalidDType("not a categorical series")
        self.s, self.categories, self.ordered = series, list(meta["categories"]), bool(meta["ordered"])

    def _rank(self) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, self.categories)), self.s.column), F.lit(0))

    def codes(self) -> Series:
        """Places in the list of categories; -1 for missing."""
        return self.s._new((self._rank() - 1).cast("int"))

    def _set(self, column: Column, categories: Sequence[str], ordered: bool | None = None) -> Series:
        f = self.s.to_frame()
        return tagged(f, self.s.name, column, categories, self.ordered if ordered is None else ordered).col(self.s.name)

    def _own(self) -> Column:
        return _q(self.s.name)

    def rename(self, mapping: dict[str, str]) -> Series:
        after = [mapping.get(c, c) for c in self.categories]
        if len(set(after)) < len(after):
            raise InvalidOperation("two categories would have one name")
        pairs = F.create_map(*[F.lit(x) for p in zip(self.categories, after, strict=True) for x in p])
        return self._set(pairs[self._own()], after)

    def reorder(self, categories: Sequence[str], ordered: bool | None = None) -> Series:
        if sorted(categories) != sorted(self.categories):
            raise InvalidOperation("the same categories in another order")
        return self._set(self._own(), categories, ordered)

    def set(self, categories: Sequence[str], ordered: bool | None = None) -> Series:
        """Other categories; labels outside them become missing."""
        return self._set(F.when(self._own().isin(list(categories)), self._own()), categories, ordered)

    def add(self, categories: Sequence[str]) -> Series:
        if set(categories) & set(self.categories):
            raise InvalidOperation("a category is there already")
        return self._set(self._own(), [*self.categories, *categories])

    def remove(self, categories: Sequence[str]) -> Series:
        if set(categories) - set(self.categories):
            raise InvalidOperation("no such category")
        return self.set([c for c in self.categories if c not in categories])

    def compare(self, op: str, label: str) -> Series:
        """By rank; missing stays false. Only ordered categories, and labels among them."""
        if not self.ordered:
            raise InvalidOperation("categories without an order")
        if label not in self.categories:
            raise TypeMismatch(f"{label!r} is no category")
        r, x = self._rank(), self.categories.index(label) + 1
        test = {">": r > x, ">=": r >= x, "<": r < x, "<=": r <= x}[op]
        return self.s._new((r > 0) & test)
