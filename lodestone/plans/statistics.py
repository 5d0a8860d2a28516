"""Statistics of a table, counted by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_stats(df: DataFrame) -> DataFrame:
    """(nrec, dv): the rows of a table, and the distinct values assumed for each of its fields."""
    return df.agg(F.count(F.lit(1)).alias("nrec")).select("nrec", (F.lit(1) + F.floor(F.col("nrec") / 3)).cast("long").alias("dv"))
