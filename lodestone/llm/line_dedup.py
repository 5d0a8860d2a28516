"""Line dedup: two Bloom filters, and an exact count of the lines that the second one suspects.

Pass 1 shuffles eight bytes a line: hashes go to the segment of the hash space they fall in, where a fold inserts each
into the filter of once-seen hashes and, if it was there already, into the list of twice-seen ones. Pass 2 tests every
line against a filter of the twice-seen hashes; only lines it suspects are shuffled, as text, and counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of

#: Bits of a segment's filter, and lines a segment is sized for.
SEGMENT_BITS, SEGMENT_LINES = 1 << 23, 1 << 18
#: Twice-seen hashes, and bytes of confirmed lines, that may be broadcast; beyond them joins do the same work.
MAX_HASHES, MAX_BYTES = 1 << 22, 32 << 20


def keys_of(text: bytes) -> list[bytes]:
    """A text's lines as keys: stripped of ASCII white space, A-Z lower-cased."""
    return [x.strip().lower() for x in text.split(b"\n")]


def _wanted(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in keys_of(text) if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))


class Bloom:
    """A filter of 64-bit hashes with two bits for each."""

    def __init__(self, bits: int, shift: int = 23) -> None:
        self.shift = np.uint64(shift)
        self.mask, self.bytes = np.uint64(bits - 1), np.zeros(bits // 8, dtype=np.uint8)

    def _at(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in (h & self.mask, (h >> self.shift) & self.mask):
            yield p >> np.uint64(3), np.left_shift(1, p & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        (a, x), (b, y) = self._at(h)
        return ((self.bytes[a] & x) != 0) & ((self.bytes[b] & y) != 0)

    def add(self, h: np.ndarray) -> None:
        for p, x in self._at(h):
            np.bitwise_or.at(self.bytes, p, x)


def _suspects(texts: DataFrame, min_chars: int) -> DataFrame:
    """Hashes that the fold over each segment has seen twice or more; some once-seen ones are among them."""
    lines = texts.agg(F.sum(F.regexp_count("body", F.lit("\n")) + 1)).first()[0] or 0
    segments = max(1, -(-lines // SEGMENT_LINES))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hashes([k for t in batch.column(0).to_pylist() for k in _wanted(t, min_chars)])
            u, n = np.unique(h, return_counts=True)
            at = ((u >> np.uint64(32)) % np.uint64(segments)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            u, n, at = u[order], n[order], at[order]
            ids, first = np.unique(at, return_index=True)
            cut = [*first[1:], len(u)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int32()),
                pa.array([u[a:b].tobytes() for a, b in zip(first, cut, strict=True)], pa.binary()),
                pa.array([u[a:b][n[a:b] > 1].tobytes() for a, b in zip(first, cut, strict=True)], pa.binary()),
            ], ["segment", "seen", "twice"])

    def fold(group: pa.Table) -> pa.Table:
        once, again = Bloom(SEGMENT_BITS), []
        for seen, twice in zip(group["seen"].to_pylist(), group["twice"].to_pylist(), strict=True):
            h = np.frombuffer(seen, dtype=np.uint64)
            again += [h[once.has(h)], np.frombuffer(twice, dtype=np.uint64)]
            once.add(h)
        return pa.table({"hash": np.unique(np.concatenate(again)).view(np.int64)})

    cut = texts.select("body").mapInArrow(split, "segment int, seen binary, twice binary")
    return cut.groupBy("segment").applyInArrow(fold, "hash long")


def _repeats(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Keys in at least ``min_docs`` rows, confirmed on the text, with the first (doc_id, line number) of each."""
    suspects = materialise(_suspects(texts, min_chars))
    n = suspects.count()
    pair = "key binary, hash long, doc_id long, line int"

    def candidates(held: Bloom | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2000):
                keys, ids, lines = [], [], []
                for t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    wanted, place = _wanted(t, min_chars), {}
                    for i, k in enumerate(keys_of(t)):
                        if k in wanted:
                            place.setdefault(k, i)
                    keys += place
                    ids += [d] * len(place)
                    lines += place.values()
                h = _hashes(keys)
                keep = np.flatnonzero(held.has(h)) if held else np.arange(len(h))
                columns = pa.array(keys, pa.binary()), pa.array(h.view(np.int64)), pa.array(ids, pa.int64()), pa.array(lines, pa.int32())
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in columns], ["key", "hash", "doc_id", "line"])

        return texts.select("body", "doc_id").mapInArrow(run, pair)

    if n <= MAX_HASHES:
        held = Bloom(1 << max(10, (16 * n).bit_length()))
        held.add(suspects.toPandas()["hash"].to_numpy().view(np.uint64))
        found = candidates(held)
    else:
        found = candidates(None).join(suspects, "hash", "left_semi")
    first = F.min(F.struct("doc_id", "line"))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), first.alias("first")).filter(F.col("docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """Return ``docs`` with repeated lines taken out of ``text``, and n_lines and n_dropped (both long) added.

    A line repeats if its key has ``min_chars`` code points and stands in ``min_docs`` rows; a row counts once, and
    repeated rows count as rows. ``keep="none"`` drops every such line; ``keep="first"`` leaves the one with the
    smallest (doc_id, line number), rows without doc_id first. Null and empty texts are one empty line and come back
    empty. An empty table gives an empty result. Other columns pass through; n_lines and n_dropped of the input are
    replaced.
    """
    texts = docs.select(F.encode(text_of(), "UTF-8").alias("body"), F.col("doc_id").cast("long").alias("doc_id"))
    repeats = materialise(_repeats(texts, min_docs, min_chars))
    size = repeats.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    out = "text: string, n_lines: bigint, n_dropped: bigint"

    def packed(rows: list[tuple[str, int, int]]) -> pa.Array:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.StructArray.from_arrays(columns, ["text", "n_lines", "n_dropped"])

    def strip(body: bytes, gone: dict, doc: object) -> tuple[bytes, int, int]:
        lines, keys = body.split(b"\n"), keys_of(body)
        left = [x for i, (x, k) in enumerate(zip(lines, keys, strict=True)) if k not in gone or keep == "first" and gone[k] == (doc, i)]
        return b"\n".join(left).decode(), len(lines), len(lines) - len(left)

    if size <= MAX_BYTES:
        gone = {bytes(r["key"]): tuple(r["first"]) for r in repeats.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(gone)

        @F.arrow_udf(f"struct<{out}>")
        def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for body, doc in batches:
                for b, d in zip(slices([body]), slices([doc]), strict=True):
                    yield packed([strip(x, shared.value, i) for x, i in zip(b.to_pylist(), d.to_pylist(), strict=True)])

        done = docs.withColumn("__cut", cut(F.encode(text_of(), "UTF-8"), F.col("doc_id").cast("long")))
    else:
        # a text's digest names its lines: equal texts lose the same ones
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(m, k) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in _wanted(t, min_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.binary())], ["__text", "key"])

        pairs = texts.select(F.md5("body").alias("__text"), "body").dropDuplicates(["__text"]).mapInArrow(own, "__text string, key binary")
        lists = pairs.join(repeats, "key").groupBy("__text").agg(F.collect_list(F.struct("key", "first")).alias("__gone"))

        @F.arrow_udf(f"struct<{out}>")
        def cut_by(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            held = lambda x: {r["key"]: (r["first"]["doc_id"], r["first"]["line"]) for r in x or ()}
            for body, doc, lists in batches:
                for b, d, g in zip(slices([body]), slices([doc]), slices([lists]), strict=True):
                    yield packed([strip(x, held(y), i) for x, i, y in zip(b.to_pylist(), d.to_pylist(), g.to_pylist(), strict=True)])

        keyed = docs.withColumn("__text", F.md5(F.encode(text_of(), "UTF-8"))).join(lists, "__text", "left")
        done = keyed.withColumn("__cut", cut_by(F.encode(text_of(), "UTF-8"), F.col("doc_id").cast("long"), F.col("__gone")))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*[F.col("__cut.text").alias("text") if c == "text" else F.col(c) for c in kept], "__cut.n_lines", "__cut.n_dropped")
