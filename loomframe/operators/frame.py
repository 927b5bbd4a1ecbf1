"""Labelled, ordered frames as lazy Spark plans.

A Frame is a DataFrame, the columns that order its rows, and the columns that label them. Columns named `__o…` carry
order keys that are not data. Without labels a frame has the default labels 0, 1, …, which are its positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import loomframe
from loomframe.errors import ColumnNotFound, InvalidDType, InvalidIndex, InvalidOperation, LengthMismatch, NotSupported, OutOfBounds, TypeMismatch
from loomframe.expr.ast import Expr, Schema
from loomframe.expr.parser import parse
from loomframe.functions import dtypes, na
from loomframe.plans.order import BLOCK, POS, Key, quantiles, sort_columns, with_position

if TYPE_CHECKING:
    from loomframe.operators.groupby import GroupBy
    from loomframe.operators.series import Series

#: Executors need no copy of this package: functions of it travel with the tasks.
cloudpickle.register_pickle_by_value(loomframe)

NUMBER = "number"
#: Positions of one slice that are listed (longer slices are filters), and labels that are pushed down as a filter.
LISTED, PUSHED = 1000, 50


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, stem: str = "__o") -> str:
    i = 0
    while f"{stem}{i}" in df.columns:
        i += 1
    return f"{stem}{i}"


class Frame:
    def __init__(self, df: DataFrame, order: Sequence[Key] = (), index: Sequence[str] = ()):
        if not order:
            name = fresh(df)
            df, order = df.withColumn(name, F.monotonically_increasing_id()), (Key(name),)
        self.df, self.order, self.index = df, tuple(order), tuple(index)
        #: DataFrames of the same rows to which this one has only added columns.
        self._older: tuple[DataFrame, ...] = ()

    # --- making and leaving frames -------------------------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, order_by: str | Sequence[str] | None = None) -> Frame:
        """A frame of a DataFrame. order_by names columns that order its rows totally; else the scan order holds."""
        keys = [order_by] if isinstance(order_by, str) else list(order_by or ())
        return cls(na.nan_to_null(df), [Key(k) for k in keys])

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[Any], schema: str | Sequence[str]) -> Frame:
        """Rows in the order given, which is kept."""
        data = [(*r, i) for i, r in enumerate(map(tuple, rows))]
        if isinstance(schema, str):
            return cls(na.nan_to_null(spark.createDataFrame(data, f"{schema}, __o0 long")), [Key("__o0")])
        kinds = [dtypes.promote_all([_infer(r[i]) for r in data] or [T.NullType()]) for i in range(len(schema))]
        kinds = [T.StringType() if isinstance(k, T.NullType) else k for k in kinds]
        clean = [tuple(_fit(v, k) for v, k in zip(r, [*kinds, T.LongType()], strict=True)) for r in data]
        fields = [T.StructField(n, k) for n, k in zip([*schema, "__o0"], [*kinds, T.LongType()], strict=True)]
        return cls(na.nan_to_null(spark.createDataFrame(clean, T.StructType(fields))), [Key("__o0")])

    @classmethod
    def from_records(cls, spark: SparkSession, records: Sequence[dict], columns: Sequence[str] | None = None) -> Frame:
        """Records as rows; columns are the sorted union of their keys unless given."""
        names = list(columns or sorted({k for r in records for k in r}))
        return cls.from_rows(spark, [[r.get(c) for c in names] for r in records], names)

    @classmethod
    def from_map(cls, spark: SparkSession, data: dict[str, Sequence], columns: Sequence[str] | None = None) -> Frame:
        """Columns of equal length, sorted by name unless an order is given."""
        names = list(columns or sorted(data))
        if len({len(v) for v in data.values()}) > 1:
            raise LengthMismatch("columns differ in length")
        return cls.from_rows(spark, zip(*(data[c] for c in names), strict=True), names)

    @classmethod
    def from_objects(cls, spark: SparkSession, objects: Sequence[Any]) -> Frame:
        """Dataclass instances; a field's metadata "name" renames it and "-" leaves it out."""
        import dataclasses

        fields = [(f.name, f.metadata.get("name", f.name)) for f in dataclasses.fields(objects[0])]
        kept = [(a, b) for a, b in fields if b != "-"]
        return cls.from_rows(spark, [[getattr(o, a) for a, _ in kept] for o in objects], [b for _, b in kept])

    def _with(self, df: DataFrame, order: Sequence[Key] | None = None, index: Sequence[str] | None = None) -> Frame:
        return Frame(df, self.order if order is None else order, self.index if index is None else index)

    @property
    def columns(self) -> list[str]:
        """Names of the data columns."""
        hidden = {*self.index}
        return [c for c in self.df.columns if c not in hidden and not c.startswith("__o")]

    @property
    def schema(self) -> Schema:
        return {f.name: f for f in self.df.schema if f.name in set(self.columns)}

    @property
    def dtypes(self) -> dict[str, str]:
        return {n: "category" if "categories" in (f.metadata or {}) else dtypes.name_of(f.dataType) for n, f in self.schema.items()}

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__o")]

    def __len__(self) -> int:
        return self.df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    @property
    def empty(self) -> bool:
        return not self.columns or self.df.isEmpty()

    def to_spark(self) -> DataFrame:
        """A plain DataFrame: labels, then data; order keys that are no data are gone."""
        return self.df.select(*map(q, self.index), *map(q, self.columns))

    def ordered(self) -> DataFrame:
        """As to_spark, sorted."""
        return self.df.orderBy(*sort_columns(self.order)).select(*map(q, self.index), *map(q, self.columns))

    def rows(self) -> list[tuple]:
        """All rows in order, on the driver."""
        return [tuple(r) for r in self.df.orderBy(*sort_columns(self.order)).select(*map(q, self.columns)).collect()]

    def records(self) -> list[dict]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.rows()]

    def copy(self) -> Frame:
        return self

    def info(self) -> str:
        there = self.df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(q(c)).alias(c) for c in self.columns]).first()
        lines = [f"{there['__n']} rows, {len(self.columns)} columns"]
        return "\n".join([*lines, *(f"{c}  {there[c]} non-missing  {t}" for c, t in self.dtypes.items())])

    def render(self, n: int = 20) -> str:
        """The first n rows as text; missing values show as <NA>."""
        rows = self.head(n).rows()
        cells = [self.columns, *[["<NA>" if v is None else str(v) for v in r] for r in rows]]
        wide = [max(len(r[i]) for r in cells) for i in range(len(self.columns))]
        return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, wide, strict=True)) for r in cells)

    __repr__ = render

    def plan(self, what: Expr | str | None = None) -> str:
        """How an expression or query is evaluated, or the frame's physical plan."""
        if what is None:
            return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), "formatted")
        e = parse(what) if isinstance(what, str) else what
        try:
            e.compile(self.schema)
        except Exception as error:
            return f"error: {error}"
        return "columnar"

    # --- columns -------------------------------------------------------------------------------------------

    def _need(self, names: Iterable[str]) -> None:
        have = {*self.columns, *self.index}
        if missing := [n for n in names if n not in have]:
            raise ColumnNotFound(", ".join(missing))

    def col(self, name: str) -> Series:
        from loomframe.operators.series import Series

        self._need([name])
        return Series(self, q(name), name, self.df.schema[name])

    __getitem__ = col

    def select(self, *names: str) -> Frame:
        self._need(names)
        if len(set(names)) < len(names):
            raise InvalidOperation("a column is selected twice")
        return self._keep(list(names))

    def _keep(self, names: list[str]) -> Frame:
        """These data columns with the labels and hidden copies of the order keys that are data."""
        copies = {k.name: fresh_many(self.df, i) for i, k in enumerate(self.order) if not k.name.startswith("__o")}
        df = self.df.withColumns({new: q(old) for old, new in copies.items()}) if copies else self.df
        order = [Key(copies.get(k.name, k.name), k.ascending) for k in self.order]
        return self._with(df.select(*map(q, self.index), *map(q, names), *map(q, [k.name for k in order])), order)

    def drop(self, *names: str) -> Frame:
        self._need(names)
        return self._keep([c for c in self.columns if c not in names])

    def rename(self, mapping: dict[str, str]) -> Frame:
        """Renames columns; unknown keys are ignored, clashes refused."""
        after = [mapping.get(c, c) for c in self.columns]
        if len(set(after)) < len(after):
            raise InvalidOperation("two columns would have one name")
        kept = self._keep(self.columns)
        return kept._with(kept.df.withColumnsRenamed({k: v for k, v in mapping.items() if k in self.columns}))

    def assign(self, name: str, values: Any) -> Frame:
        """A column from a series of this frame, or of one that it extends, a series of another frame of equal length (by
        position), or a scalar."""
        from loomframe.operators.series import Series

        if not isinstance(values, Series):
            return self._put({name: F.lit(values)})
        if self._extends(values.frame):
            return self._put({name: values.column})
        left, right = self.positioned(), values.frame.positioned()
        if len(self) != len(values.frame):
            raise LengthMismatch("series and frame differ in length")
        other = right.select(q(POS), values.column.alias("__new"))
        df = left.join(other, POS).drop(POS)
        return self._with(df)._put({name: F.col("__new")})._drop_raw("__new")

    def _drop_raw(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def assign_value(self, name: str, value: Any) -> Frame:
        return self._put({name: F.lit(value)})

    def assign_expr(self, name: str, e: Expr) -> Frame:
        """A column from an expression; a missing condition is stored as false."""
        c = e.compile(self.schema)
        return self._put({name: F.coalesce(c.column, F.lit(False)) if e.is_predicate else c.column})

    def assign_func(self, name: str, fn: Callable[[dict], Any], returns: str) -> Frame:
        """A column from a function of the row as a dict; the type it returns is declared."""
        f = F.udf(lambda row: fn(row.asDict()), returns)
        return self._put({name: f(F.struct(*map(q, self.columns)))})

    def _put(self, columns: dict[str, Column]) -> Frame:
        clash = [k for k in self.order if k.name in columns]
        base = self
        if clash:
            copies = {k.name: fresh_many(self.df, i) for i, k in enumerate(clash)}
            base = self._with(self.df.withColumns({new: q(old) for old, new in copies.items()}), [Key(copies.get(k.name, k.name), k.ascending) for k in self.order])
        out = base._with(base.df.withColumns(columns))
        if not {c.lower() for c in columns} & {c.lower() for c in self.df.columns}:
            out._older = (*self._older, self.df)
        return out

    def _extends(self, other: Frame) -> bool:
        """Whether expressions over the other frame mean the same here: it has the same rows, and no column of it has changed."""
        return any(df is other.df for df in (self.df, *self._older))

    def select_dtypes(self, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Frame:
        """Columns by type; "number" stands for numeric and bool."""
        if not include and not exclude:
            raise InvalidOperation("name types to include or exclude")
        is_a = lambda f, names: any((n == NUMBER and na.is_number(f.dataType)) or (n == "category" and "categories" in (f.metadata or {})) or (n not in (NUMBER, "category") and f.dataType == dtypes.parse(n)) for n in names)
        return self._keep([n for n, f in self.schema.items() if (not include or is_a(f, include)) and not (exclude and is_a(f, exclude))])

    def astype(self, kinds: dict[str, str]) -> Frame:
        """Casts columns; unknown names are ignored; "category" makes a categorical."""
        from loomframe.functions import categorical

        out = self
        for name, kind in kinds.items():
            if name in self.columns:
                if kind == "category":
                    out = categorical.make(out, name)
                else:
                    out = out._put({name: dtypes.cast(q(name), self.schema[name].dataType, dtypes.parse(kind))})
        return out

    def infer_objects(self) -> Frame:
        return self._with(dtypes.infer_text(self.df, [n for n, f in self.schema.items() if isinstance(f.dataType, T.StringType) and not f.metadata]))

    def numeric(self, names: Sequence[str] = ()) -> list[str]:
        self._need(names)
        return list(names) or [n for n, f in self.schema.items() if na.is_number(f.dataType)]

    def clip(self, lo: float | None = None, hi: float | None = None, *names: str) -> Frame:
        from loomframe.operators.series import clipped

        return self._put({n: clipped(q(n), self.schema[n].dataType, lo, hi) for n in self.numeric(names)})

    def round(self, digits: int = 0, *names: str) -> Frame:
        from loomframe.operators.series import rounded

        return self._put({n: rounded(q(n), self.schema[n].dataType, digits) for n in self.numeric(names)})

    def abs(self, *names: str) -> Frame:
        return self._put({n: F.abs(q(n).cast("long") if isinstance(self.schema[n].dataType, T.BooleanType) else q(n)) for n in self.numeric(names)})

    def reindex_columns(self, *names: str) -> Frame:
        """These columns; unknown ones are all missing."""
        have = set(self.columns)
        return self._put({n: F.lit(None).cast("string") for n in names if n not in have})._keep(list(names))

    # --- rows ----------------------------------------------------------------------------------------------

    def where(self, e: Expr) -> Frame:
        """Rows for which the condition holds; where it is missing, the row goes."""
        from loomframe.expr.ast import as_bool

        return self._with(self.df.filter(as_bool(e.compile(self.schema))))

    def query(self, text: str) -> Frame:
        return self.where(parse(text))

    def filter(self, mask: Series) -> Frame:
        """Rows whose place in a mask of this frame's length is true."""
        if self._extends(mask.frame):
            return self._with(self.df.filter(F.coalesce(mask.column, F.lit(False))))
        return self.assign("__mask", mask)._filter_raw("__mask")

    def _filter_raw(self, name: str) -> Frame:
        return self._with(self.df.filter(F.coalesce(q(name), F.lit(False))).drop(name))

    def positioned(self) -> DataFrame:
        """The DataFrame with the dense position of each row in `__pos`."""
        return with_position(self.df, self.order)

    def _by_position(self, keep: Callable[[Column], Column]) -> Frame:
        return self._with(self.positioned().filter(keep(F.col(POS))).drop(POS))

    def head(self, n: int = 5) -> Frame:
        if n > BLOCK:  # a limit merges that many rows in one task
            return self._by_position(lambda p: p < n)
        return self._with(self.df.orderBy(*sort_columns(self.order)).limit(max(0, n)))

    def tail(self, n: int = 5) -> Frame:
        """The last n rows. Reversed keys put missing ones first, so the last rows are those at the top."""
        if n > BLOCK:
            least = len(self) - n
            return self._by_position(lambda p: p >= least)
        back = [q(k.name).desc_nulls_first() if k.ascending else q(k.name).asc_nulls_first() for k in self.order]
        return self._with(self.df.orderBy(*back).limit(max(0, n)))

    def slice(self, start: int, stop: int) -> Frame:
        n = len(self)
        if not 0 <= start <= stop <= n:
            raise OutOfBounds(f"[{start}, {stop}) of {n} rows")
        if stop > BLOCK:
            return self._by_position(lambda p: (p >= start) & (p < stop))
        return self._with(self.df.orderBy(*sort_columns(self.order)).offset(start).limit(stop - start))

    def take(self, positions: Sequence[int]) -> Frame:
        """Rows at positions, which may repeat; a negative position gives a row of missing values."""
        n = len(self)
        if any(p >= n for p in positions):
            raise OutOfBounds(f"position beyond {n} rows")
        return self._gather([p if p >= 0 else None for p in positions])

    def _gather(self, positions: Sequence[int | None], places: Sequence[int] | None = None) -> Frame:
        spark = self.df.sparkSession
        want = spark.createDataFrame(list(zip(places or range(len(positions)), positions, strict=True)), "__at long, __pos long")
        near = self.positioned().drop(*self.hidden)
        if positions and (there := [p for p in positions if p is not None]):
            near = near.filter(F.col(POS).isin(there)) if len(there) <= 1000 else near
        order = fresh(near)
        df = want.join(near, POS, "left").drop(POS).withColumnRenamed("__at", order)
        return Frame(df, [Key(order)], self.index)

    def iloc_rows(self, *picks: int | slice) -> Frame:
        """Rows by position in the order asked for: ints (negative ones count from the end) and slices with a positive step."""
        n = len(self)
        at, places, runs, place = [], [], [], 0
        for p in picks:
            if isinstance(p, slice):
                if (p.step or 1) < 0:
                    raise NotSupported("slices with a negative step")
                run = range(*p.indices(n))
            else:
                if not -n <= p < n:
                    raise OutOfBounds(f"{p} of {n} rows")
                run = range(p % n, p % n + 1)
            if len(run) > LISTED:
                runs.append((place, run))
            else:
                at += run
                places += range(place, place + len(run))
            place += len(run)
        if not runs:
            return self._gather(at, places)
        out = self._runs(runs)
        if not at:
            return out
        few = self._gather(at, places)
        return Frame(out.df.unionByName(few.df.withColumnRenamed(few.order[0].name, out.order[0].name)), out.order, self.index)

    def _runs(self, runs: Sequence[tuple[int, range]]) -> Frame:
        """Rows of long slices, told by arithmetic on positions: (place of the first, positions)."""
        df = self.positioned().drop(*self.hidden)
        order, p = fresh(df), F.col(POS)
        at = [F.when((p >= r.start) & (p < r.stop) & ((p - r.start) % r.step == 0), F.floor((p - r.start) / r.step) + first) for first, r in runs]
        return Frame(df.withColumn(order, F.explode(F.array_compact(F.array(*at)))).drop(POS), [Key(order)], self.index)

    def iloc_cols(self, *picks: int) -> Frame:
        names = self.columns
        if any(not -len(names) <= p < len(names) for p in picks):
            raise OutOfBounds("no such column")
        return self.select(*[names[p] for p in picks])

    def iat(self, row: int, column: str | int) -> Any:
        name = self.columns[column] if isinstance(column, int) else column
        self._need([name])
        return self.iloc_rows(row).rows()[0][self.columns.index(name)]

    def irow(self, row: int) -> dict:
        return self.iloc_rows(row).records()[0]

    def sample(self, n: int, seed: int = 0) -> Frame:
        """Exactly n rows without replacement; the same rows for the same seed and order keys."""
        if n > len(self):
            raise OutOfBounds(f"{n} of {len(self)} rows")
        draw = F.xxhash64(F.lit(seed), *[q(k.name) for k in self.order])
        if n > BLOCK:
            by = fresh(self.df)
            at = with_position(self.df.withColumn(by, draw), (Key(by), *self.order))
            return self._with(at.filter(F.col(POS) < n).drop(POS, by))
        return self._with(self.df.orderBy(draw, *sort_columns(self.order)).limit(n))

    def dropna(self, how: str = "any", subset: Sequence[str] = (), thresh: int | None = None, axis: int = 0) -> Frame:
        """Rows (or columns) with missing values go. thresh, the values needed, overrides how; unknown subset names are ignored."""
        if axis == 1:
            n = self.df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(q(c)).alias(c) for c in self.columns]).first()
            need = thresh if thresh is not None else (n["__n"] if how == "any" else 1)
            return self._keep([c for c in self.columns if n[c] >= need or (how == "all" and not n["__n"])])
        names = [c for c in (subset or self.columns) if c in self.columns]
        if not names:
            return self
        need = thresh if thresh is not None else (len(names) if how == "any" else 1)
        if how not in ("any", "all"):
            raise InvalidOperation(f"how is any or all, not {how!r}")
        there = sum((F.when(q(c).isNotNull(), 1).otherwise(0) for c in names), F.lit(0))
        return self._with(self.df.filter(there >= need))

    def fillna(self, values: dict[str, Any] | Any) -> Frame:
        """Missing values replaced by column, or by one value wherever it fits the type."""
        given = values if isinstance(values, dict) else {n: values for n in self.columns}
        self._need(given)
        out = {}
        for n, v in given.items():
            kind = self.schema[n].dataType
            if not _fits(v, kind):
                if isinstance(values, dict):
                    raise TypeMismatch(f"{v!r} doesn't fit {n}")
                continue
            if isinstance(v, float) and isinstance(kind, T.IntegralType):
                out[n] = F.coalesce(q(n).cast("double"), F.lit(v))
            else:
                out[n] = F.coalesce(q(n), F.lit(v).cast(kind))
        return self._put(out) if out else self

    def isna(self) -> Frame:
        return self._keep(self.columns)._each(lambda c: c.isNull())

    def notna(self) -> Frame:
        return self._keep(self.columns)._each(lambda c: c.isNotNull())

    def _each(self, f: Callable[[Column], Column]) -> Frame:
        return self._with(self.df.withColumns({n: f(q(n)) for n in self.columns}))

    def hasna(self) -> bool:
        return bool(self.columns) and not self.df.filter(_any([q(c).isNull() for c in self.columns])).isEmpty()

    def _first_key(self) -> Column | None:
        """One comparable value, never missing, that orders the rows; None if a key is descending."""
        if all(k.ascending for k in self.order):
            return F.struct(*[c for k in self.order for c in (q(k.name).isNull(), q(k.name))])
        return None

    def duplicated(self, subset: Sequence[str] = ()) -> Series:
        """True for rows that an earlier row equals on the subset; missing equals missing.

        The first place of each kind is a combined minimum, which is joined back: a kind with very many rows is neither
        sorted nor held by one task.
        """
        names = list(subset) or self.columns
        self._need(names)
        key = self._first_key()
        if key is None:
            return self._with(self.df.withColumn("__dup", self._number(names) > 1)).col("__dup")
        firsts = self.df.groupBy(*[q(n).alias(f"__k{i}") for i, n in enumerate(names)]).agg(F.min(key).alias("__first"))
        on = _all([q(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names)])
        df = self.df.join(firsts, on).withColumn("__dup", F.col("__first") < key)
        return self._with(df.drop("__first", *[f"__k{i}" for i in range(len(names))])).col("__dup")

    def drop_duplicates(self, subset: Sequence[str] = ()) -> Frame:
        """The first row of each kind, by a minimum that is combined before the shuffle."""
        names = list(subset) or self.columns
        self._need(names)
        return self._with(self.drop_duplicates_raw(names))

    def drop_duplicates_raw(self, names: list[str]) -> DataFrame:
        key = self._first_key()
        if key is None:
            return self.df.withColumn("__rn", self._number(names)).filter("__rn = 1").drop("__rn")
        first = F.min_by(F.struct(*map(q, self.df.columns)), key)
        rows = self.df.groupBy(*[q(n).alias(f"__k{i}") for i, n in enumerate(names)]).agg(first.alias("__row"))
        out = rows.select("__row.*")
        for f in self.df.schema:
            if f.metadata:
                out = out.withMetadata(f.name, f.metadata)
        return out

    def _number(self, names: list[str]) -> Column:
        from pyspark.sql import Window

        return F.row_number().over(Window.partitionBy(*map(q, names)).orderBy(*sort_columns(self.order)))

    # --- order ---------------------------------------------------------------------------------------------

    def sort_values(self, by: str | Sequence[str], ascending: bool | Sequence[bool] = True) -> Frame:
        """A stable sort, missing values last either way; categories sort by rank."""
        names = [by] if isinstance(by, str) else list(by)
        up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
        self._need(names)
        if len(up) != len(names):
            raise LengthMismatch("a direction for each column")
        return self._sorted([(self._rank(n), u) for n, u in zip(names, up, strict=True)])

    def _rank(self, name: str) -> Column:
        cats = (self.df.schema[name].metadata or {}).get("categories")
        return F.nullif(F.array_position(F.array(*map(F.lit, cats)), q(name)), F.lit(0)) if cats else q(name)

    def _sorted(self, keys: list[tuple[Column, bool]]) -> Frame:
        df, order = self.df, []
        for c, up in keys:
            name = fresh(df)
            df = df.withColumn(name, c)
            order.append(Key(name, up))
        return self._with(df, [*order, *self.order])

    def sort_index(self, ascending: bool = True) -> Frame:
        """By label. Tuples aren't compared: frames with several label columns keep their order."""
        if len(self.index) > 1:
            return self
        if not self.index:
            return self if ascending else self._with(self.df, [Key(k.name, not k.ascending) for k in self.order])
        return self._sorted([(q(self.index[0]), ascending)])

    # --- labels --------------------------------------------------------------------------------------------

    def set_index(self, *names: str) -> Frame:
        """Columns as labels. A single key that is no time becomes text; several keep their types."""
        self._need(names)
        kept = self._keep(self.columns) if not self.index else self.reset_index(drop=True)
        df = kept.df
        if len(names) == 1 and not isinstance(df.schema[names[0]].dataType, (T.TimestampNTZType, T.TimestampType)):
            df = df.withColumn(names[0], dtypes.cast(q(names[0]), df.schema[names[0]].dataType, T.StringType()))
        return Frame(df, kept.order, names)

    def reset_index(self, drop: bool = False) -> Frame:
        """Labels as leading columns; default labels become a column `index`."""
        if not self.index:
            if drop:
                return self
            df = self.positioned().withColumnRenamed(POS, "index")
            return self._with(df.select("index", *[q(c) for c in df.columns if c != "index"]))
        if drop:
            return Frame(self.df.drop(*self.index), self.order)
        if clash := set(self.index) & set(self.columns):
            raise InvalidOperation(f"{clash} is both label and column")
        return Frame(self.df.select(*map(q, self.index), *[q(c) for c in self.df.columns if c not in self.index]), self.order)

    def reindex(self, labels: Sequence[Any]) -> Frame:
        """Rows of the labels in their order: the first match of each, a row of missing values for unknown ones."""
        spark = self.df.sparkSession
        name = self._one_label()
        keyed = self if self.index else self._with(self.positioned().withColumnRenamed(POS, name), index=[name])
        firsts = keyed.drop_duplicates_raw([name])
        kind = firsts.schema[name].dataType
        order = fresh(firsts)
        want = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], T.StructType([T.StructField(order, T.LongType()), T.StructField("__label", kind)]))
        joined = want.join(firsts.drop(*[c for c in firsts.columns if c.startswith("__o")]), q("__label").eqNullSafe(q(name)), "left")
        return Frame(joined.drop(name).withColumnRenamed("__label", name), [Key(order)], [name])

    def _one_label(self) -> str:
        if len(self.index) > 1:
            raise NotSupported("several label columns")
        return self.index[0] if self.index else "index"

    def _labels(self) -> tuple[DataFrame, str]:
        name = self._one_label()
        return (self.df, name) if self.index else (self.positioned().withColumn(name, F.col(POS)).drop(POS), name)

    def _label_value(self, df: DataFrame, name: str, v: Any) -> Column:
        from loomframe.expr.ast import _time_literal

        if isinstance(df.schema[name].dataType, (T.TimestampNTZType, T.TimestampType)) and isinstance(v, str):
            return _time_literal(v)
        return F.lit(v)

    def loc_rows(self, *labels: Any) -> Frame:
        """All rows of each label, in the order asked for; a label that isn't there is refused."""
        df, name = self._labels()
        order = fresh(df)
        values = [self._label_value(df, name, v) for v in labels]
        near = df.filter(reduce(or_, [q(name) == v for v in values])) if len(values) <= PUSHED else df
        asked = F.array(*[F.struct(F.lit(i).cast("long").alias(order), v.alias("__label")) for i, v in enumerate(values)])
        table = df.sparkSession.range(1).select(F.inline(asked))
        found = near.join(table, q(name) == F.col("__label")).drop("__label")
        seen = {r[order] for r in found.select(order).distinct().collect()}
        if missing := [v for i, v in enumerate(labels) if i not in seen]:
            raise InvalidIndex(missing)
        out = Frame(found, [Key(order), *self.order], self.index)
        return out if self.index else out._drop_raw(name)

    def loc_range(self, start: Any, stop: Any) -> Frame:
        """Rows from the first match of one label to the first of the other, both included; times by value."""
        df, name = self._labels()
        if isinstance(df.schema[name].dataType, (T.TimestampNTZType, T.TimestampType)):
            return self._with(df.filter(q(name).between(self._label_value(df, name, start), self._label_value(df, name, stop))))
        at = with_position(df, self.order)
        ends = at.filter(q(name).isin([start, stop])).groupBy(q(name).alias("l")).agg(F.min(POS).alias("p")).collect()
        where = {r["l"]: r["p"] for r in ends}
        if start not in where or stop not in where:
            raise InvalidIndex([v for v in (start, stop) if v not in where])
        out = self._with(at.filter(F.col(POS).between(where[start], where[stop])).drop(POS))
        return out if self.index else out._drop_raw(name)

    def loc_tuple(self, *key: Any) -> Frame:
        """Rows whose label columns equal the key; fewer values match a prefix; None matches missing; none found is refused."""
        if len(self.index) < max(2, len(key)):
            raise InvalidIndex("not that many label columns")
        out = self._with(self.df.filter(_all([q(n).eqNullSafe(F.lit(v)) for n, v in zip(self.index, key, strict=False)])))
        if out.df.isEmpty():
            raise InvalidIndex(key)
        return out

    def xs(self, key: Any, level: str | int = 0) -> Frame:
        """Rows with this label in a level, which is dropped."""
        name = self._level(level)
        out = self._with(self.df.filter(q(name).eqNullSafe(F.lit(key))))
        if out.df.isEmpty():
            raise InvalidIndex(key)
        return out.drop_level(name)

    def _level(self, level: str | int) -> str:
        if isinstance(level, int):
            if not -len(self.index) <= level < len(self.index):
                raise InvalidIndex(level)
            return self.index[level]
        if level not in self.index:
            raise InvalidIndex(level)
        return level

    def drop_level(self, level: str | int) -> Frame:
        name = self._level(level)
        if len(self.index) < 2:
            raise InvalidIndex("the only level can't be dropped")
        return self._with(self.df.drop(name), index=[n for n in self.index if n != name])

    def swap_level(self, a: str | int = -2, b: str | int = -1) -> Frame:
        x, y = self._level(a), self._level(b)
        return self._with(self.df, index=[{x: y, y: x}.get(n, n) for n in self.index])

    def reorder_levels(self, *levels: str | int) -> Frame:
        names = [self._level(v) for v in levels]
        if sorted(names) != sorted(self.index):
            raise InvalidIndex("every level once")
        return self._with(self.df, index=names)

    # --- reductions ----------------------------------------------------------------------------------------

    def agg_row(self, how: str, names: Sequence[str] = (), **options) -> Frame:
        """One row with a reduction of each column: numeric ones, or every one for count, min, max and nunique."""
        from loomframe.operators.series import reduction

        chosen = list(names) or (self.columns if how in ("count", "min", "max", "nunique") else self.numeric())
        self._need(chosen)
        one = {n: reduction(how, q(n), self.schema[n], **options).alias(n) for n in chosen}
        if how in ("median", "quantile") and options.get("skipna", True) and self._large():
            return Frame.of(self.df.sparkSession.range(1).select(*[self._quantiles(n, [options.get("at", 0.5)])[0].alias(n) for n in one]))
        return Frame.of(self.df.agg(*one.values()))

    def _large(self) -> bool:
        return self.df.limit(BLOCK + 1).count() > BLOCK

    def _quantiles(self, name: str, at: list[float]) -> list[Column]:
        found = quantiles(self.df, na.as_double(q(name), self.schema[name].dataType), at)
        return [F.lit(v).cast("double") for v in found]

    def sum(self, **o):
        return self.agg_row("sum", **o)

    def mean(self, **o):
        return self.agg_row("mean", **o)

    def median(self, **o):
        return self.agg_row("median", **o)

    def var(self, **o):
        return self.agg_row("var", **o)

    def std(self, **o):
        return self.agg_row("std", **o)

    def min(self, **o):
        return self.agg_row("min", **o)

    def max(self, **o):
        return self.agg_row("max", **o)

    def count(self):
        return self.agg_row("count")

    def nunique(self):
        return self.agg_row("nunique")

    def quantile(self, at: float):
        return self.agg_row("quantile", at=at)

    def describe(self, *names: str) -> Frame:
        """count, mean, std, min, quartiles and max of numeric columns, a row each, labelled `stat`."""
        from loomframe.operators.series import reduction

        chosen = self.numeric(names)
        stats = [("count", {}), ("mean", {}), ("std", {}), ("min", {}), ("quantile", {"at": 0.25}), ("quantile", {"at": 0.5}), ("quantile", {"at": 0.75}), ("max", {})]
        labels = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
        ranked = {n: self._quantiles(n, [0.25, 0.5, 0.75]) for n in chosen} if self._large() else {}

        def each(n: str) -> Column:
            found = iter(ranked.get(n, ()))
            return F.array(*[next(found) if h == "quantile" and ranked else reduction(h, q(n), self.schema[n], **o).cast("double") for h, o in stats])

        one = self.df.agg(*[each(n).alias(f"s{i}") for i, n in enumerate(chosen)])
        rows = one.select(F.posexplode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("stat"), *[F.col(f"s{i}") for i in range(len(chosen))])).alias("__o0", "z"))
        return Frame(rows.select("__o0", F.col("z.stat").alias("stat"), *[F.col(f"z.s{i}").alias(n) for i, n in enumerate(chosen)]), [Key("__o0")], ["stat"])

    def cov(self, *names: str) -> Frame:
        return self._pairs(self.numeric(names), False)

    def corr(self, *names: str) -> Frame:
        return self._pairs(self.numeric(names), True)

    def _pairs(self, names: list[str], scaled: bool) -> Frame:
        """Matrix of sample covariances or correlations over rows where both are there; one aggregation for all pairs."""
        both = lambda a, b: F.when(q(a).isNotNull() & q(b).isNotNull(), na.as_double(q(a), self.schema[a].dataType))

        def entry(a: str, b: str) -> Column:
            x, y = both(a, b), both(b, a)
            n = F.count(x)
            cov = F.when(n > 1, F.covar_samp(x, y))
            if not scaled:
                return cov
            return F.try_divide(cov, F.when(n > 1, F.sqrt(F.var_samp(x)) * F.sqrt(F.var_samp(y))))

        one = self.df.agg(*[F.array(*[entry(a, b) for b in names]).alias(f"r{i}") for i, a in enumerate(names)])
        rows = one.select(F.posexplode(F.array(*[F.struct(F.lit(a).alias("column"), F.col(f"r{i}").alias("v")) for i, a in enumerate(names)])).alias("__o0", "z"))
        return Frame(rows.select("__o0", F.col("z.column").alias("column"), *[F.col("z.v")[i].alias(n) for i, n in enumerate(names)]), [Key("__o0")], ["column"])

    def value_counts(self, *names: str) -> Frame:
        """Counts of distinct rows over the columns, most frequent first, then by key; missing keys are left out."""
        chosen = list(names) or self.columns
        self._need(chosen)
        df = self.df.dropna(subset=chosen).groupBy(*map(q, chosen)).agg(F.count(F.lit(1)).alias("count"))
        return Frame(df, [Key("count", False), *map(Key, chosen)])

    def apply(self, fn: Callable[..., Any], axis: int = 0, returns: str = "double") -> Series | dict[str, Any]:
        """axis 1: a function of the row's values, as a series. axis 0: a function of each column's values, gathered in
        one grouped Python task a column."""
        if axis == 1:
            f = F.udf(lambda row: fn(list(row)), returns)
            return self._put({"result": f(F.struct(*map(q, self.columns)))}).col("result")
        found = self.df.agg(*[_column_udf(fn, returns)(q(n)).alias(n) for n in self.columns]).first()
        return {n: found[n] for n in self.columns}

    def map(self, fn: Callable[[Any], Any], returns: str) -> Frame:
        """A function of every cell; missing cells are skipped."""
        f = F.udf(lambda v: None if v is None else fn(v), returns)
        return self._keep(self.columns)._each(f)

    def pipe(self, fn: Callable[[Frame], Frame]) -> Frame:
        return fn(self)

    def rolling(self, size: int, min_periods: int | None = None, center: bool = False):
        from loomframe.operators.window import Rolling

        return Rolling(self, size, min_periods, center)

    def expanding(self, min_periods: int = 1):
        from loomframe.operators.window import Expanding

        return Expanding(self, min_periods)

    def resample(self, freq: str):
        from loomframe.operators.resample import Resampler

        return Resampler(self, freq)

    def merge(self, other: Frame, **options) -> Frame:
        from loomframe.operators.merge import merge

        return merge(self, other, **options)

    def join(self, other: Frame, **options) -> Frame:
        from loomframe.operators.merge import join

        return join(self, other, **options)

    def melt(self, *args, **options) -> Frame:
        from loomframe.operators.reshape import melt

        return melt(self, *args, **options)

    def pivot(self, index: str, columns: str, values: str) -> Frame:
        from loomframe.operators.reshape import pivot

        return pivot(self, index, columns, values)

    def pivot_table(self, *args, **options) -> Frame:
        from loomframe.operators.reshape import pivot_table

        return pivot_table(self, *args, **options)

    def stack(self) -> Frame:
        from loomframe.operators.reshape import stack

        return stack(self)

    def unstack(self) -> Frame:
        from loomframe.operators.reshape import unstack

        return unstack(self)

    def loc(self, rows: Sequence[Any], columns: Sequence[str] | None = None) -> Frame:
        """Rows by label and columns by name."""
        found = self.loc_rows(*rows)
        return found.select(*columns) if columns is not None else found

    def iloc(self, rows: Sequence[int | slice], columns: Sequence[int] | None = None) -> Frame:
        """Rows and columns by position."""
        found = self.iloc_rows(*rows)
        return found.iloc_cols(*columns) if columns is not None else found

    def groupby(self, *keys: str, dropna: bool = True, sort: bool = True, as_index: bool = False) -> GroupBy:
        from loomframe.operators.groupby import GroupBy

        return GroupBy(self, keys, dropna, sort, as_index)


def fresh_many(df: DataFrame, i: int) -> str:
    used = sum(1 for c in df.columns if c.startswith("__o"))
    name = f"__o{used + i}"
    while name in df.columns:
        i += 1
        name = f"__o{used + i}_"
    return name


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def _all(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def _column_udf(fn: Callable, returns: str):
    def f(s: pd.Series) -> float:
        return fn([None if pd.isna(v) else v for v in s.tolist()])

    return F.pandas_udf(f, returns)


def _infer(v: Any) -> T.DataType:
    import datetime as dt

    if v is None or (isinstance(v, float) and v != v):
        return T.NullType()
    for py, t in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (dt.datetime, T.TimestampNTZType())):
        if isinstance(v, py):
            return t
    raise InvalidDType(f"a cell can't be a {type(v).__name__}")


def _fit(v: Any, t: T.DataType) -> Any:
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(t, T.DoubleType):
        return float(v)
    return str(v) if isinstance(t, T.StringType) and not isinstance(v, str) else v


def _fits(v: Any, t: T.DataType) -> bool:
    if isinstance(v, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(v, (int, float)):
        return isinstance(t, T.NumericType)
    if isinstance(v, str):
        return isinstance(t, T.StringType)
    return isinstance(t, (T.TimestampNTZType, T.TimestampType))
