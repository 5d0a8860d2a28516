"""Table definitions, Parquet tables, and the two catalog tables with each field's place in a record."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type ids, and bytes of a field and of a record's flag.
TYPE_IDS = {"int": 4, "varchar": 12, "bool": 16, "date": 91}
INT_BYTES, BOOL_BYTES, DATE_BYTES, CHAR_BYTES, FLAG_BYTES = 8, 1, 8, 4, 8
LENGTH = "length"
SPARK_TYPES = {"int": T.LongType(), "varchar": T.StringType(), "bool": T.BooleanType(), "date": T.TimestampNTZType()}


def default_of(kind: T.DataType) -> object:
    """What a field holds before it is set: 0, '', false or the first instant of year 1."""
    if isinstance(kind, T.NumericType):
        return 0
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.BooleanType):
        return False
    return dt.datetime(1, 1, 1)


@dataclass(frozen=True)
class FieldDef:
    name: str
    kind: str
    length: int = 0

    @property
    def size(self) -> int:
        return {"int": INT_BYTES, "bool": BOOL_BYTES, "date": DATE_BYTES, "varchar": INT_BYTES + CHAR_BYTES * self.length}[self.kind]


def fields(*defs: str) -> list[FieldDef]:
    """Definitions such as ``"name varchar(16)"``."""
    out = []
    for d in defs:
        name, kind = d.lower().split(maxsplit=1)
        base, _, rest = kind.partition("(")
        if base.strip() not in TYPE_IDS:
            raise ValueError(f"unknown type: {kind}")
        out.append(FieldDef(name, base.strip(), int(rest.rstrip(") ") or 0)))
    return out


class Catalog:
    """Tables that are defined in a session; a name can be defined once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}
        self.create("table_catalog", fields("tablename varchar(16)", "slotsize int"))
        self.create("field_catalog", fields("tablename varchar(16)", "fieldname varchar(16)", "offset int", "type int", "length int"))

    def create(self, name: str, defs: list[FieldDef]) -> DataFrame:
        """Define a table; returns it, empty."""
        if name.lower() in self.tables:
            raise ValueError(f"table exists: {name}")
        self.tables[name.lower()] = list(defs)
        return self.spark.createDataFrame([], self.schema(name))

    def schema(self, name: str) -> T.StructType:
        if name.lower() not in self.tables:
            raise ValueError(f"unknown table: {name}")
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.kind], True, {"type_id": TYPE_IDS[f.kind], **({LENGTH: f.length} if f.kind == "varchar" else {})}) for f in self.tables[name.lower()]])

    def _rows(self) -> DataFrame:
        rows = [(t, i, f.name, TYPE_IDS[f.kind], f.length, f.size) for t, fs in self.tables.items() for i, f in enumerate(fs)]
        return self.spark.createDataFrame(rows, "tablename string, ordinal int, fieldname string, type long, length long, size long")

    def table_catalog(self) -> DataFrame:
        """(tablename, slotsize): the flag and all fields."""
        return self._rows().groupBy("tablename").agg((F.sum("size") + FLAG_BYTES).alias("slotsize"))

    def field_catalog(self) -> DataFrame:
        """(tablename, fieldname, offset, type, length): fields follow the flag in order."""
        before = Window.partitionBy("tablename").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        offset = (F.coalesce(F.sum("size").over(before), F.lit(0)) + FLAG_BYTES).alias("offset")
        return self._rows().select("tablename", "fieldname", offset, "type", "length")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, folder: str, name: str) -> None:
    """Write a table to a new place; a table that is being read is never overwritten."""
    df.write.mode("error").parquet(f"{folder}/{name}.parquet")
