"""Typed values of a match: comparisons are strict in type and two-valued.

A comparison with null, or of values that cannot be compared, is false, and `~` of something that
is not true is true. Types are known from the schema, so a mixed comparison becomes a constant and
never a cast, and an ordinary one stays a bare column comparison that reaches the scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import GraphError

NUMBER, STRING, BOOLEAN, DATE, LIST, RECORD, NULL = "number", "string", "boolean", "datetime", "list", "record", "null"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    if isinstance(t, T.ArrayType):
        return LIST
    return NULL if isinstance(t, T.NullType) else RECORD


@dataclass(frozen=True, eq=False)
class Value:
    """A column with the kind that its values have. inner: the kind of a list's elements."""

    col: Column
    kind: str
    inner: str = NULL
    literal: object = None

    def __eq__(self, other) -> Value:  # type: ignore[override]
        other = value(other)
        if NULL in (self.kind, other.kind) or self.kind != other.kind or self.kind == LIST and self.inner != other.inner and NULL not in (self.inner, other.inner):
            return Value(F.lit(False), BOOLEAN)
        return Value(self.col == other.col, BOOLEAN)

    def __ne__(self, other) -> Value:  # type: ignore[override]
        other = value(other)
        if NULL in (self.kind, other.kind):
            return Value(F.lit(False), BOOLEAN)
        if self.kind != other.kind:
            return Value(self.col.isNotNull() & other.col.isNotNull(), BOOLEAN)
        return Value(self.col != other.col, BOOLEAN)

    __hash__ = None  # type: ignore[assignment]

    def _order(self, other, op) -> Value:
        other = value(other)
        if self.kind != other.kind or self.kind not in (NUMBER, STRING, BOOLEAN, DATE):
            return Value(F.lit(False), BOOLEAN)
        return Value(op(self.col, other.col), BOOLEAN)

    def __lt__(self, other) -> Value:
        return self._order(other, lambda a, b: a < b)

    def __le__(self, other) -> Value:
        return self._order(other, lambda a, b: a <= b)

    def __gt__(self, other) -> Value:
        return self._order(other, lambda a, b: a > b)

    def __ge__(self, other) -> Value:
        return self._order(other, lambda a, b: a >= b)

    def true(self) -> Column:
        """Exactly true, never null."""
        return F.coalesce(self.col, F.lit(False)) if self.kind == BOOLEAN else F.lit(False)

    def filter(self) -> Column:
        """For a filter, where null and false are one."""
        return self.col if self.kind == BOOLEAN else F.lit(False)

    def __and__(self, other) -> Value:
        return Value(self.filter() & value(other).filter(), BOOLEAN)

    def __or__(self, other) -> Value:
        return Value(self.filter() | value(other).filter(), BOOLEAN)

    def __invert__(self) -> Value:
        return Value(~self.true(), BOOLEAN)

    def _text(self, other, op) -> Value:
        other = value(other)
        return Value(op(self.col, other.col) if self.kind == other.kind == STRING else F.lit(False), BOOLEAN)

    def contains(self, other) -> Value:
        return self._text(other, lambda a, b: F.contains(a, b))

    def starts_with(self, other) -> Value:
        return self._text(other, lambda a, b: F.startswith(a, b))

    def ends_with(self, other) -> Value:
        return self._text(other, lambda a, b: F.endswith(a, b))

    def is_in(self, other) -> Value:
        """Equal to any element of a Python list (of any types), a list property or labels."""
        if isinstance(other, (list, tuple)):
            same = [x for x in other if x is not None and value(x).kind == self.kind]
            return Value(self.col.isin(same) if same else F.lit(False), BOOLEAN)
        other = value(other)
        if other.kind != LIST or other.inner != self.kind:
            return Value(F.lit(False), BOOLEAN)
        return Value(F.array_contains(other.col, self.col), BOOLEAN)

    def exists(self) -> Value:
        return Value(self.col.isNotNull(), BOOLEAN)

    def lower(self) -> Value:
        return Value(F.lower(self.col), STRING) if self.kind == STRING else Value(F.lit(None).cast("string"), STRING)


def value(x: object) -> Value:
    """A value as it is, or a Python literal."""
    if isinstance(x, Value):
        return x
    if isinstance(x, Aggregate):
        raise GraphError("SEMANTIC_ERROR", "an aggregate stands in returns() only")
    if x is None:
        return Value(F.lit(None), NULL)
    if isinstance(x, bool):
        return Value(F.lit(x), BOOLEAN, literal=x)
    if isinstance(x, (int, float)):
        return Value(F.lit(x), NUMBER, literal=x)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, literal=x)
    if isinstance(x, (dt.datetime, dt.date)):
        return Value(F.lit(x), DATE, literal=x)
    if isinstance(x, (list, tuple)):
        kinds = {value(i).kind for i in x}
        if len(kinds) > 1:
            raise GraphError("VALIDATION", "a list has elements of one type")
        return Value(F.array(*map(F.lit, x)), LIST, kinds.pop() if kinds else NULL)
    raise GraphError("VALIDATION", f"no graph value: {x!r}")


def column(col: Column, t: T.DataType) -> Value:
    return Value(col, kind_of(t), kind_of(t.elementType) if isinstance(t, T.ArrayType) else NULL)


@dataclass(frozen=True)
class Aggregate:
    """What an aggregate gives; it stands for itself in returns(), not inside other expressions or aggregates."""

    col: Column

    def __getattr__(self, name: str):
        if name in ("kind", "filter", "true", "inner", "literal"):
            raise GraphError("SEMANTIC_ERROR", "an aggregate stands in returns() only, and not in another one")
        raise AttributeError(name)


def count(x: Value | None = None, distinct: bool = False) -> Aggregate:
    """Rows, or non-null values."""
    if x is None:
        return Aggregate(F.count(F.lit(1)))
    if isinstance(x, Aggregate):
        raise GraphError("SEMANTIC_ERROR", "an aggregate of an aggregate")
    return Aggregate(F.count_distinct(x.col) if distinct else F.count(x.col))


def total(x: Value, distinct: bool = False) -> Aggregate:
    """Numbers only; 0 without any."""
    if x.kind != NUMBER:
        return Aggregate(F.lit(0))
    return Aggregate(F.coalesce(F.sum_distinct(x.col) if distinct else F.sum(x.col), F.lit(0)))


def mean(x: Value, distinct: bool = False) -> Aggregate:
    """Null without values; values that are no numbers count, but add nothing."""
    if x.kind != NUMBER:
        return Aggregate(F.when(F.count(x.col) > 0, F.lit(0.0)))
    return Aggregate(F.sum_distinct(x.col) / F.count_distinct(x.col) if distinct else F.avg(x.col))


def _ordered(x: Value, f) -> Aggregate:
    return Aggregate(f(x.col) if x.kind in (NUMBER, STRING, BOOLEAN, DATE) else F.max(F.lit(None)))


def least(x: Value) -> Aggregate:
    return _ordered(x, F.min)


def greatest(x: Value) -> Aggregate:
    return _ordered(x, F.max)


def collect(x: Value, distinct: bool = False) -> Aggregate:
    """List of non-null values, sorted, as the order of matches is none."""
    return Aggregate(F.sort_array(F.collect_set(x.col) if distinct else F.collect_list(x.col)))
