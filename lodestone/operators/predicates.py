"""Predicates: conjunctions of comparisons between fields and constants."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.comparison import compare, literal, operator, type_of


@dataclass(frozen=True)
class Field:
    name: str

    def column(self, schema: T.StructType) -> tuple[Column, T.DataType]:
        kinds = {f.name.lower(): f for f in schema.fields}
        if self.name.lower() not in kinds:
            raise ValueError(f"unknown field: {self.name}")
        found = kinds[self.name.lower()]
        return F.col(f"`{found.name}`"), found.dataType

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: int | float | str | bool | dt.datetime | dt.date

    def column(self, schema: T.StructType) -> tuple[Column, T.DataType]:
        return literal(self.value), type_of(self.value)

    def __str__(self) -> str:
        return f"'{self.value}'" if isinstance(self.value, str) else str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


Expression = Field | Const


@dataclass(frozen=True)
class Term:
    """One comparison, with a constant on either side or on both."""

    left: Expression
    op: str
    right: Expression

    def column(self, schema: T.StructType) -> Column:
        (a, x), (b, y) = self.left.column(schema), self.right.column(schema)
        return compare(a, x, self.op, b, y)

    def __str__(self) -> str:
        return f"{self.left} {operator(self.op)} {self.right}"


@dataclass(frozen=True)
class Predicate:
    """Terms that must all hold; without terms everything passes."""

    terms: tuple[Term, ...] = ()

    def column(self, schema: T.StructType) -> Column:
        return reduce(lambda a, b: a & b, (t.column(schema) for t in self.terms), F.lit(True))

    def conjoin(self, other: Predicate) -> Predicate:
        return Predicate(self.terms + other.terms)

    def __str__(self) -> str:
        return " and ".join(map(str, self.terms))


def term(left: object, op: str, right: object) -> Term:
    """Strings starting with '@' are fields; everything else is a constant. Field and Const can be given themselves."""
    make = lambda x: x if isinstance(x, Field | Const) else Field(x[1:].lower()) if isinstance(x, str) and x.startswith("@") else Const(x)
    return Term(make(left), op, make(right))


def where(*terms: tuple[object, str, object]) -> Predicate:
    return Predicate(tuple(term(*t) for t in terms))
