"""Typed comparison: values of one class compare, values of different classes are unequal and unordered.

Types are known when a query is built, so a comparison across classes needs no value but whether it is null, and never
becomes a cast. Nulls follow SQL: a comparison with null is null, and a filter drops the row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The comparison operators, and each one's mirror image.
OPERATORS = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
ALIASES = {"!=": "<>"}


def operator(text: str) -> str:
    op = ALIASES.get(text, text)
    if op not in OPERATORS:
        raise ValueError(f"not a comparison operator: {text}")
    return op


def class_of(kind: T.DataType) -> str:
    """number, string, bool or date; doubles are an extension of number."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "date"
    raise TypeError(f"no comparison for {kind.simpleString()}")


def type_of(value: object) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, (dt.datetime, dt.date)):
        return T.TimestampNTZType()
    raise TypeError(f"not a constant: {value!r}")


def literal(value: object) -> Column:
    if isinstance(value, (dt.datetime, dt.date)):
        return F.lit(value.isoformat(" ") if isinstance(value, dt.datetime) else value.isoformat()).cast("timestamp_ntz")
    return F.lit(value)


def compare(left: Column, left_type: T.DataType, op: str, right: Column, right_type: T.DataType) -> Column:
    """``left op right`` as a column; across classes only <> holds, and booleans have no order."""
    op, a, b = operator(op), class_of(left_type), class_of(right_type)
    known = left.isNotNull() & right.isNotNull()
    if a != b:
        return F.when(known, F.lit(op == "<>"))
    if a == "bool" and op not in ("=", "<>"):
        return F.when(known, F.lit(False))
    made = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
    return made[op]
