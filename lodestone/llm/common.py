"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batch = TypeVar("Batch", pa.RecordBatch, pa.Array)
#: The white space that separates words in the contracts.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a folder of our own, on a single machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Results are read lazily, so their files stay; they are named ``lodestone-*`` and go with the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[Batch], rows: int = 200) -> Iterator[Batch]:
    """Arrow batches or arrays in short ones, so that a task unpacks few texts at a time."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
