"""SimHash near-dedup with pivot distance tables.

Each distinct fingerprint carries its Hamming distances to many reference fingerprints, the pivots. By the triangle
inequality two fingerprints at distance d differ by at most d in each coordinate, so a pair whose largest coordinate
difference is over the limit is discarded before it is verified. Distances to a pivot gather closely around half the
bits, so they give no key to join on: pairs are met in buckets of equal bit blocks, of which pairs within
the limit share at least one, whatever bits differ. A bucket over ``crowd`` members is not paired at all: its members
are linked through midpoints, the values within half the limit of each, which is exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of
from .graph import components

BITS, WORDS = 64, 4
#: Reference fingerprints, and the fingerprints of the data that they are chosen from.
PIVOTS, SAMPLE = 32, 1024


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's 4-word shingles, as a signed 64-bit integer; zero for no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) for every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("body")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(limit: int, keep: int) -> list[int]:
    """Masks over ``limit + keep`` blocks of bits: ``keep`` blocks each, one mask for every choice."""
    blocks = limit + keep
    cut = [round(BITS * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(block, keep)]


def _ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits of ``fp``."""
    ball = F.array(fp)
    for _ in range(radius):
        ball = F.array_distinct(F.flatten(F.transform(ball, lambda x: F.array_append(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), x))))
    return ball


def _apart(a: str, b: str, pivots: int) -> Column:
    """The largest difference of two rows of the pivot tables."""
    return F.greatest(F.lit(0), *[F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(pivots)])


def references(nodes: DataFrame, pivots: int) -> list[int]:
    """Reference fingerprints: of SAMPLE fingerprints of the data, those that lie farthest from each other, one by one.

    They only decide which pairs are discarded early. Fewer than ``pivots`` fingerprints are used again.
    """
    some = [r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()] or [0]
    left = np.array(some, dtype=np.int64).view(np.uint64)
    apart, chosen = np.full(len(left), BITS + 1, dtype=np.int64), []
    for _ in range(pivots):
        k = int(apart.argmax())
        chosen.append(some[k])
        apart = np.minimum(apart, np.bitwise_count(left ^ left[k]))
    return chosen


def links(nodes: DataFrame, limit: int = 4, pivots: int = PIVOTS, crowd: int = 64) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``limit`` bits of each other; an odd limit raises."""
    if limit % 2:
        raise ValueError("limit must be even")
    n = nodes.count()
    keep = next((k for k in (1, 2, 3) if BITS * k / (limit + k) >= (n + 1).bit_length() + 2), 4)
    table = nodes.withColumn("pivots", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in references(nodes, pivots)]))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_masks(limit, keep))])
    placed = table.select("fp", "pivots", F.inline(keys))
    crowds = placed.groupBy("choice", "bits").count().filter(F.col("count") > crowd).select("choice", "bits")
    crowds = materialise(crowds)
    few = placed.join(crowds, ["choice", "bits"], "left_anti")
    a, b = few.alias("a"), few.alias("b")
    met = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b.hint("merge"), met & (_apart("a.pivots", "b.pivots", pivots) <= limit))
    near = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)
    # two fingerprints are within the limit if and only if a value within half of it of both exists
    many = placed.join(crowds, ["choice", "bits"], "left_semi").select("fp").distinct()
    mids = many.select("fp", F.explode(_ball(F.col("fp"), limit // 2)).alias("mid"))
    lows = mids.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("mid", "low")
    close = mids.join(lows.hint("merge"), "mid").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return near.unionByName(close)


def near_duplicates(docs: DataFrame, limit: int = 4, pivots: int = PIVOTS, crowd: int = 64) -> DataFrame:
    """Return doc_id, fingerprint (16 hex digits) and component_id for every row.

    component_id is the smallest doc_id reachable through links of ``limit`` bits or fewer. Texts without words (null
    and empty ones too) have fingerprint zero and are linked like any other. Rows without doc_id take part; a
    component of such rows alone has a null component_id. Repeated rows each get a row; an empty table gives an
    empty result; only doc_id and text are read. ``limit`` must be even, or ValueError is raised.
    """
    prints = materialise(fingerprints(docs))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), limit, pivots, crowd))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of.hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
