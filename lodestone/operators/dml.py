"""Insert, update and delete as rewrites: a table in, the changed table out, with every duplicate row kept."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.comparison import class_of, literal, type_of
from ..sources.catalog import LENGTH, default_of
from .predicates import Const, Expression, Field, Predicate
from .relational import product, project, select


def _checked(value: object, field: T.StructField) -> object:
    """The value as the field holds it: of the field's class, no fraction of a whole number, no longer than allowed."""
    if class_of(type_of(value)) != class_of(field.dataType):
        raise TypeError(f"{field.name} takes {field.dataType.simpleString()}, not {value!r}")
    if isinstance(value, float) and isinstance(field.dataType, T.IntegralType) and not value.is_integer():
        raise ValueError(f"{field.name} takes whole numbers, not {value!r}")
    limit = field.metadata.get(LENGTH)
    if isinstance(value, str) and limit is not None and len(value) > limit:
        raise ValueError(f"{field.name} holds {limit} characters at most")
    return value.replace(microsecond=0) if isinstance(value, dt.datetime) else value


def _stored(value: Column, kind: T.DataType, field: T.StructField) -> Column:
    """Another field's value as this field holds it; a row that doesn't fit fails the query."""
    made, limit = value.cast(field.dataType), field.metadata.get(LENGTH)
    if isinstance(field.dataType, T.StringType) and limit is not None:
        return F.when(F.length(made) > limit, F.raise_error(F.lit(f"{field.name} holds {limit} characters at most"))).otherwise(made)
    if isinstance(field.dataType, T.IntegralType) and not isinstance(kind, T.IntegralType):
        return F.when(value != made, F.raise_error(F.lit(f"{field.name} takes whole numbers"))).otherwise(made)
    return F.date_trunc("second", made).cast(field.dataType) if isinstance(field.dataType, T.TimestampNTZType | T.TimestampType) else made


def insert(df: DataFrame, fields: list[str], values: list[object]) -> DataFrame:
    """One more row; fields that aren't named get their type's default."""
    if len(fields) != len(values):
        raise ValueError(f"{len(fields)} fields, {len(values)} values")
    given = dict(zip((f.lower() for f in fields), values, strict=True))
    if len(given) < len(fields):
        raise ValueError(f"a field is named twice: {fields}")
    if unknown := given.keys() - {f.name.lower() for f in df.schema.fields}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    cells = [
        literal(_checked(given[f.name.lower()], f) if f.name.lower() in given else default_of(f.dataType)).cast(f.dataType).alias(f.name)
        for f in df.schema.fields
    ]
    return df.unionByName(df.sparkSession.range(1).select(*cells))


def _target(df: DataFrame, field: str) -> T.StructField | None:
    return next((f for f in df.schema.fields if f.name.lower() == field.lower()), None)


def _set(df: DataFrame, target: T.StructField, value: Expression) -> Column:
    """What ``target`` gets from a constant or from another field of the row."""
    if isinstance(value, Const):
        return literal(_checked(value.value, target)).cast(target.dataType)
    new, kind = value.column(df.schema)
    if class_of(kind) != class_of(target.dataType):
        raise TypeError(f"{target.name} takes {target.dataType.simpleString()}, not {kind.simpleString()}")
    return _stored(new, kind, target)


def update(df: DataFrame, field: str, value: Expression, predicate: Predicate | None = None) -> DataFrame:
    """Set one field where the predicate holds; rows for which it is null are left alone."""
    target = _target(df, field)
    if target is None:
        raise ValueError(f"unknown field: {field}")
    hit = F.coalesce((predicate or Predicate()).column(df.schema), F.lit(False))
    return df.withColumn(target.name, F.when(hit, _set(df, target, value)).otherwise(F.col(f"`{target.name}`")))


def delete(df: DataFrame, predicate: Predicate | None = None) -> DataFrame:
    """Without the rows for which the predicate holds; without a predicate, no rows."""
    return df.filter(~F.coalesce((predicate or Predicate()).column(df.schema), F.lit(False)))


def affected(df: DataFrame, predicate: Predicate | None = None) -> int:
    """How many rows an update or delete with this predicate touches."""
    return df.filter((predicate or Predicate()).column(df.schema)).count()


@dataclass(frozen=True)
class View:
    """A select and project over one table or over the product of two, through which the tables can be written.

    Every write returns the tables, changed, in their order. Fields outside the projection can't be set. A row inserted
    through a select isn't held against its predicate. A product takes updates alone.
    """

    tables: tuple[DataFrame, ...]
    predicate: Predicate = Predicate()
    fields: tuple[str, ...] | None = None

    def rows(self) -> DataFrame:
        found = select(product(*self.tables) if len(self.tables) == 2 else self.tables[0], self.predicate)
        return found if self.fields is None else project(found, list(self.fields))

    def _allowed(self, field: str) -> None:
        if self.fields is not None and field.lower() not in {f.lower() for f in self.fields}:
            raise ValueError(f"not a field of the view: {field}")

    def _base(self) -> DataFrame:
        if len(self.tables) != 1:
            raise TypeError("rows can't be inserted into a product or deleted from it")
        return self.tables[0]

    def insert(self, fields: list[str], values: list[object]) -> tuple[DataFrame]:
        for f in fields:
            self._allowed(f)
        return (insert(self._base(), fields, values),)

    def delete(self) -> tuple[DataFrame]:
        return (delete(self._base(), self.predicate),)

    def update(self, field: str, value: Expression) -> tuple[DataFrame, ...]:
        """Set a field of the view's rows. In a product, the left table owns a name that both have.

        A row of the owner is set if any row beside it meets the predicate, so the value must be a constant or another
        field of the owner: fields beside it could offer several values.
        """
        self._allowed(field)
        if len(self.tables) == 1:
            return (update(self.tables[0], field, value, self.predicate),)
        left, right = self.tables
        at = 0 if _target(left, field) else 1
        owner, other = (left, right) if at == 0 else (right, left)
        target = _target(owner, field)
        if target is None:
            raise ValueError(f"unknown field: {field}")
        taken = {c.lower() for c in left.columns}
        if isinstance(value, Field) and (_target(owner, value.name) is None or at and value.name.lower() in taken):
            raise ValueError(f"{field} can't be set from a field of the other table: {value}")
        # names as in the product: a name that both have is the left field, the right one takes no part
        hidden = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}" if c.lower() in taken else c) for c in right.columns])
        sides = (left, hidden)
        meets = self.predicate.column(T.StructType([*left.schema.fields, *[f for f in right.schema.fields if f.name.lower() not in taken]]))
        hit = sides[at].join(sides[1 - at], meets, "left_semi").toDF(*owner.columns)
        rest = sides[at].join(sides[1 - at], meets, "left_anti").toDF(*owner.columns)
        changed = hit.withColumn(target.name, _set(owner, target, value)).unionByName(rest)
        return (changed, other) if at == 0 else (other, changed)
