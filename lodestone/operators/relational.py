"""Select, project, product, grouping and order as DataFrame programs; Catalyst picks joins, push-down and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Predicate

#: The aggregate functions.
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
HIDDEN = "__r_"


def select(df: DataFrame, predicate: Predicate | None) -> DataFrame:
    """Rows that meet the predicate; without one, all rows."""
    return df if predicate is None else df.filter(predicate.column(df.schema))


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields named, in that order; repeats are allowed, unknown fields are an error."""
    known = {c.lower() for c in df.columns}
    for f in fields:
        if f.lower() not in known:
            raise ValueError(f"unknown field: {f}")
    return df.select(*[F.col(f"`{f}`") for f in fields])


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left fields, then right ones. A name that both have means the left field; the right one can't be reached.

    A predicate selected on top becomes the join's condition, so an equality turns this into a hash or merge join.
    """
    taken = {c.lower() for c in left.columns}
    keep = [c for c in right.columns if c.lower() not in taken]
    hidden = right.select(*[F.col(f"`{c}`").alias(c if c in keep else HIDDEN + c) for c in right.columns])
    return left.crossJoin(hidden.select(*keep) if keep else hidden.select(F.lit(1).alias(HIDDEN))).select(*left.columns, *keep)


def products(tables: list[DataFrame]) -> DataFrame:
    return reduce(product, tables)


def aggregate(fn: str, field: str, name: str | None = None) -> Column:
    """``fn`` of a field (``*`` for count), named ``<fn>of<field>`` unless a name is given."""
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {fn}")
    return AGGREGATES[fn](F.lit(1) if field == "*" else F.col(f"`{field}`")).alias(name or f"{fn}of{field.replace('*', 'rows')}")


def group(df: DataFrame, keys: list[str], aggregates: list[Column] | None = None, having: Predicate | None = None) -> DataFrame:
    """Groups with their aggregates; without aggregates, the distinct keys. ``having`` is a predicate on the result."""
    made = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    return select(made, having)


def order(df: DataFrame, items: list[tuple[str, bool]]) -> DataFrame:
    """Sorted by (field, descending) items."""
    return df.orderBy(*[F.col(f"`{f}`").desc() if down else F.col(f"`{f}`").asc() for f, down in items])
