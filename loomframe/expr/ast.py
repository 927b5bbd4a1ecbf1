"""Typed expressions. Building one plans nothing; compile() checks operand kinds and gives a Spark column.

A comparison with a missing operand is missing, and a filter drops it; a comparison with a literal missing value is
false, so that its negation holds everywhere.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import ColumnNotFound, InvalidOperation, ParseError, TypeMismatch
from loomframe.functions import na
from loomframe.functions.dtypes import PARSE_LAYOUTS, time_of

Schema = dict[str, T.StructField]


@dataclass(frozen=True)
class Compiled:
    column: Column
    kind: str  # number, int, bool, string, time, category, null, other
    dtype: T.DataType
    literal: Any = None
    is_literal: bool = False


def kind_of(field: T.StructField) -> str:
    t = field.dataType
    if "categories" in (field.metadata or {}):
        return "category"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "time"
    return "null" if isinstance(t, T.NullType) else "other"


NUMERIC = ("number", "int", "bool")


class Expr:
    """An expression; operators build larger ones."""

    def compile(self, schema: Schema) -> Compiled:
        raise NotImplementedError

    def _bin(self, op: str, other: Any, swap: bool = False) -> Expr:
        a, b = (as_expr(other), self) if swap else (self, as_expr(other))
        return Arith(op, a, b)

    def __add__(self, o):
        return self._bin("+", o)

    def __radd__(self, o):
        return self._bin("+", o, True)

    def __sub__(self, o):
        return self._bin("-", o)

    def __rsub__(self, o):
        return self._bin("-", o, True)

    def __mul__(self, o):
        return self._bin("*", o)

    def __rmul__(self, o):
        return self._bin("*", o, True)

    def __truediv__(self, o):
        return self._bin("/", o)

    def __rtruediv__(self, o):
        return self._bin("/", o, True)

    def __mod__(self, o):
        return self._bin("%", o)

    def __pow__(self, o):
        return self._bin("**", o)

    def __eq__(self, o):  # type: ignore[override]
        return Compare("==", self, as_expr(o))

    def __ne__(self, o):  # type: ignore[override]
        return Compare("!=", self, as_expr(o))

    def __lt__(self, o):
        return Compare("<", self, as_expr(o))

    def __le__(self, o):
        return Compare("<=", self, as_expr(o))

    def __gt__(self, o):
        return Compare(">", self, as_expr(o))

    def __ge__(self, o):
        return Compare(">=", self, as_expr(o))

    __hash__ = object.__hash__

    def __and__(self, o):
        return Logic("and", self, as_expr(o))

    def __or__(self, o):
        return Logic("or", self, as_expr(o))

    def __invert__(self):
        return Not(self)

    def between(self, lo, hi) -> Expr:
        return (self >= lo) & (self <= hi)

    def isna(self) -> Expr:
        return IsNA(self, True)

    def notna(self) -> Expr:
        return IsNA(self, False)

    def isin(self, values) -> Expr:
        return IsIn(self, tuple(values))

    def contains(self, text: str) -> Expr:
        return TextTest("contains", self, text)

    def startswith(self, text: str) -> Expr:
        return TextTest("startswith", self, text)

    def endswith(self, text: str) -> Expr:
        return TextTest("endswith", self, text)

    def abs(self) -> Expr:
        return Call("abs", self)

    def sqrt(self) -> Expr:
        return Call("sqrt", self)

    def log(self) -> Expr:
        return Call("log", self)

    def exp(self) -> Expr:
        return Call("exp", self)

    @property
    def is_predicate(self) -> bool:
        return isinstance(self, (Compare, Logic, Not, IsNA, IsIn, TextTest))


def as_expr(v: Any) -> Expr:
    return v if isinstance(v, Expr) else Lit(v)


@dataclass(frozen=True, eq=False)
class Col(Expr):
    name: str

    def compile(self, schema):
        if self.name not in schema:
            raise ColumnNotFound(self.name)
        field = schema[self.name]
        return Compiled(F.col(f"`{self.name}`"), kind_of(field), field.dataType)


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: Any

    def compile(self, schema):
        v = self.value
        if v is None or (isinstance(v, float) and v != v):
            return Compiled(F.lit(None), "null", T.NullType(), None, True)
        kinds: list[tuple[type, str, T.DataType]] = [(bool, "bool", T.BooleanType()), (int, "int", T.LongType()), (float, "number", T.DoubleType()), (str, "string", T.StringType()), (dt.datetime, "time", T.TimestampNTZType())]
        for py, kind, t in kinds:
            if isinstance(v, py):
                return Compiled(F.lit(v).cast(t), kind, t, v, True)
        raise TypeMismatch(f"a literal can't be a {type(v).__name__}")


def _time_literal(text: str) -> Column:
    """A time for literal text, by the day-first layouts."""
    try:
        return F.lit(time_of(text, PARSE_LAYOUTS)).cast("timestamp_ntz")
    except ParseError as e:
        raise TypeMismatch(str(e)) from None


_TESTS: dict[str, Callable[[Column, Column], Column]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass(frozen=True, eq=False)
class Compare(Expr):
    op: str
    a: Expr
    b: Expr

    def compile(self, schema):
        a, b = self.a.compile(schema), self.b.compile(schema)
        out = lambda c: Compiled(c, "bool", T.BooleanType())
        if (a.is_literal and a.kind == "null") or (b.is_literal and b.kind == "null"):
            return out(F.lit(False))
        test = _TESTS[self.op]
        if a.kind in NUMERIC and b.kind in NUMERIC:
            same = a.kind == b.kind and a.kind in ("int", "bool")
            return out(test(a.column, b.column) if same else test(na.as_double(a.column, a.dtype), na.as_double(b.column, b.dtype)))
        if "category" in (a.kind, b.kind):
            return out(_category_test(self, a, b, schema))
        if a.kind == b.kind == "string":
            return out(test(a.column, b.column))
        if "time" in (a.kind, b.kind):
            sides = [x.column.cast("timestamp_ntz") if x.kind == "time" else _time_literal(x.literal) if x.kind == "string" and x.is_literal else None for x in (a, b)]
            if all(x is not None for x in sides):
                return out(test(*sides))
        if self.op == "==":
            return out(F.when(a.column.isNotNull() & b.column.isNotNull(), False))
        if self.op == "!=":
            return out(F.when(a.column.isNotNull() & b.column.isNotNull(), True))
        raise TypeMismatch(f"{a.kind} {self.op} {b.kind}")


def _category_test(node: Compare, a: Compiled, b: Compiled, schema: Schema) -> Column:
    """Equality by label; order by rank, for ordered categories only. A label outside the categories compares false."""
    if node.op in ("==", "!="):
        return _TESTS[node.op](a.column, b.column)
    side = node.a if a.kind == "category" else node.b
    meta = schema[side.name].metadata  # type: ignore[attr-defined]
    if not meta.get("ordered"):
        raise InvalidOperation("categories without an order can't be compared by order")
    cats = F.array(*map(F.lit, meta["categories"]))
    rank = lambda x: F.nullif(F.array_position(cats, x.column.cast("string")), F.lit(0))
    other = b if a.kind == "category" else a
    if other.is_literal and other.literal not in meta["categories"]:
        return F.lit(False)
    return _TESTS[node.op](rank(a), rank(b))


@dataclass(frozen=True, eq=False)
class Logic(Expr):
    op: str
    a: Expr
    b: Expr

    def compile(self, schema):
        a, b = (as_bool(x.compile(schema)) for x in (self.a, self.b))
        return Compiled(a & b if self.op == "and" else a | b, "bool", T.BooleanType())


@dataclass(frozen=True, eq=False)
class Not(Expr):
    a: Expr

    def compile(self, schema):
        return Compiled(~as_bool(self.a.compile(schema)), "bool", T.BooleanType())


def as_bool(c: Compiled) -> Column:
    if c.kind != "bool":
        raise TypeMismatch(f"a {c.kind} is no condition")
    return c.column


@dataclass(frozen=True, eq=False)
class IsNA(Expr):
    a: Expr
    missing: bool

    def compile(self, schema):
        c = self.a.compile(schema).column
        return Compiled(c.isNull() if self.missing else c.isNotNull(), "bool", T.BooleanType())


@dataclass(frozen=True, eq=False)
class IsIn(Expr):
    a: Expr
    values: tuple

    def compile(self, schema):
        a = self.a.compile(schema)
        there = [v for v in self.values if v is not None and v == v]
        fits = {"string": (str,), "category": (str,), "time": (str, dt.datetime)}.get(a.kind, (bool, int, float))
        there = [v for v in there if isinstance(v, fits)]
        if not there:
            return Compiled(F.when(a.column.isNotNull(), False), "bool", T.BooleanType())
        if a.kind == "time":
            return Compiled(a.column.isin([_time_literal(v) if isinstance(v, str) else F.lit(v).cast("timestamp_ntz") for v in there]), "bool", T.BooleanType())
        if a.kind in NUMERIC and not (a.kind == "int" and all(type(v) is int for v in there)):
            return Compiled(na.as_double(a.column, a.dtype).isin([float(v) for v in there]), "bool", T.BooleanType())
        return Compiled(a.column.isin(there), "bool", T.BooleanType())


@dataclass(frozen=True, eq=False)
class TextTest(Expr):
    op: str
    a: Expr
    text: str

    def compile(self, schema):
        a = self.a.compile(schema)
        if a.kind not in ("string", "category"):
            raise TypeMismatch(f"{self.op} needs text, not a {a.kind}")
        return Compiled(getattr(a.column, self.op)(self.text), "bool", T.BooleanType())


@dataclass(frozen=True, eq=False)
class Arith(Expr):
    op: str
    a: Expr
    b: Expr

    def compile(self, schema):
        a, b = self.a.compile(schema), self.b.compile(schema)
        if self.op == "+" and a.kind == b.kind == "string":
            return Compiled(F.concat(a.column, b.column), "string", T.StringType())
        if "null" in (a.kind, b.kind):
            return Compiled(F.lit(None).cast("double"), "number", T.DoubleType())
        if a.kind not in NUMERIC or b.kind not in NUMERIC:
            raise TypeMismatch(f"{a.kind} {self.op} {b.kind}")
        if a.kind == b.kind == "int" and self.op in "+-*":
            x, y = a.column.cast("long"), b.column.cast("long")
            return Compiled({"+": x + y, "-": x - y, "*": x * y}[self.op], "int", T.LongType())
        if a.kind == b.kind == "int" and self.op == "%":
            return Compiled(F.try_mod(a.column.cast("long"), b.column.cast("long")), "int", T.LongType())
        x, y = na.as_double(a.column, a.dtype), na.as_double(b.column, b.dtype)
        c = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: na.fdiv(x, y), "%": lambda: na.quiet(na.fmod(x, y)), "**": lambda: F.pow(x, y)}[self.op]()
        return Compiled(c, "number", T.DoubleType())


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    a: Expr

    def compile(self, schema):
        a = self.a.compile(schema)
        if self.name in ("lower", "upper", "len"):
            if a.kind not in ("string", "category"):
                raise TypeMismatch(f"{self.name} needs text, not a {a.kind}")
            if self.name == "len":
                return Compiled(F.octet_length(a.column).cast("long"), "int", T.LongType())
            return Compiled(getattr(F, self.name)(a.column), "string", T.StringType())
        if a.kind not in NUMERIC:
            raise TypeMismatch(f"{self.name} needs a number, not a {a.kind}")
        x = na.as_double(a.column, a.dtype)
        c = {"abs": F.abs(x), "sqrt": na.quiet(F.sqrt(x)), "log": na.quiet(na.log(x)), "exp": F.exp(x)}[self.name]
        return Compiled(c, "number", T.DoubleType())


@dataclass(frozen=True, eq=False)
class Where(Expr):
    cond: Expr
    x: Expr
    y: Expr

    def compile(self, schema):
        c, x, y = as_bool(self.cond.compile(schema)), self.x.compile(schema), self.y.compile(schema)
        if x.kind in NUMERIC and y.kind in NUMERIC and x.kind != y.kind:
            return Compiled(F.when(c, na.as_double(x.column, x.dtype)).otherwise(na.as_double(y.column, y.dtype)), "number", T.DoubleType())
        if "null" not in (x.kind, y.kind) and x.kind != y.kind:
            raise TypeMismatch(f"where picks {x.kind} or {y.kind}")
        best = y if x.kind == "null" else x
        return Compiled(F.when(c, x.column).otherwise(y.column), best.kind, best.dtype)


@dataclass(frozen=True, eq=False)
class Custom(Expr):
    """A user's own node: any function of a Spark column for the frame's schema."""

    make: Callable[[Schema], Column]
    dtype: T.DataType

    def compile(self, schema):
        return Compiled(self.make(schema), kind_of(T.StructField("_", self.dtype)), self.dtype)


def col(name: str) -> Col:
    return Col(name)


def lit(value: Any) -> Lit:
    return Lit(value)


def where(cond: Expr, x: Any, y: Any) -> Where:
    return Where(cond, as_expr(x), as_expr(y))


def lower(e: Expr) -> Expr:
    return Call("lower", e)


def upper(e: Expr) -> Expr:
    return Call("upper", e)


def len_(e: Expr) -> Expr:
    return Call("len", e)


def as_number(text: str) -> int | float:
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            raise ParseError(f"{text!r} is not a number") from None
