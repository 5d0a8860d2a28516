"""Benchmark decontamination by latent semantic retrieval.

Texts are reduced to the words they share with the benchmark, with positions. Over all passages of the corpus (two
neighbouring blocks of words each) a distributed randomised SVD of TF-IDF gives a latent space: one pass sketches
A'A on random vectors, one sums the small Gram matrix. Passages, their first blocks alone and items are projected, pairs
of high cosine are candidates, and each is verified in its task: a longest common subsequence inside a tight span, and for paraphrases
the item's answer, its closing words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of

WORD = re.compile(r"[^\W_]+")
#: Words of a block; a passage is two blocks, and longer items are searched in pieces of two blocks, one at each block.
BLOCK, RANK, EXTRA = 32, 128, 8
#: A word tells passages apart if it stands in this share of blocks at most; each item's rarest words always do.
SHARE, RAREST = 0.005, 8
#: Telling words that a candidate must share with the item.
LEAST_SHARED = 3
#: Items with fewer words match only where they stand whole, word by word.
LEAST_WORDS, ANSWER = 8, 4
#: Words of the items that are searched at once; a larger benchmark is searched in parts. Pieces of items in a product.
PART_WORDS, PIECES = 500_000, 2048
ROWS = 256  # of a partial matrix that travel together
#: All ASCII bytes; bytes with the ASCII ones that are neither letters nor digits as spaces.
ASCII, PLAIN = bytes(range(128)), bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def raw_tokens(text: str) -> list[bytes]:
    """The same words in UTF-8, split at ASCII bytes alone where all other characters are parts of words."""
    raw = text.lower().encode()
    other = raw.translate(None, ASCII)
    if other and not WORD.fullmatch(other.decode()):
        return [w.encode() for w in tokens(text)]
    return raw.translate(PLAIN).split()


def lcs(masks: dict[int, int], size: int, words: list[int]) -> list[int]:
    """Lengths of the longest common subsequence of an item with each prefix of ``words``; masks: places in the item."""
    full, row, out = (1 << size) - 1, (1 << size) - 1, []
    for w in words:
        both = row & masks.get(w, 0)
        row = ((row + both) | (row - both)) & full
        out.append(size - row.bit_count())
    return out


@dataclass
class Item:
    """A benchmark item as word numbers."""

    item_id: int | None
    words: list[int]

    def __post_init__(self) -> None:
        self.masks = self._masks(self.words)
        self.back = self._masks(self.words[::-1])
        self.answer = self.words[-ANSWER:]

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def verify(self, at: np.ndarray, words: np.ndarray, copy: float, paraphrase: float) -> tuple[float, str, int, int] | None:
        """Best share of the item found in order in a span of 2n words, the rule met, and where the found words begin and end."""
        n = len(self.words)
        seq, where = [], []
        for w, i in zip(words.tolist(), at.tolist(), strict=True):
            if w in self.masks:
                seq.append(w)
                where.append(i)
        if len(seq) < paraphrase * n or not seq:
            return None
        most = lcs(self.masks, n, seq)[-1]
        if most < paraphrase * n:
            return None
        # every widest span, but for those that lie in the one before or can't have more words than the best so far
        best, span = 0, None
        held, until, z = 0, 0, 0  # the span that was looked at last: its words in order, its end
        for a in range(len(seq)):
            before = z
            while z < len(seq) and where[z] - where[a] < 2 * n:
                z += 1
            limit = min(z - a, held + z - until)
            if z == before or limit <= best or limit < paraphrase * n:
                continue
            held, until = lcs(self.masks, n, seq[a:z])[-1], z
            if held > best and (held >= copy * n or held >= paraphrase * n and self._answered(seq[a:z])):
                best, span = held, (a, z)
                if best == most:
                    break
        if span is None:
            return None
        rule = "copy" if best >= copy * n else "paraphrase"
        first, last = self._tight(seq, *span, best, rule == "paraphrase")
        return best / n, rule, where[first], where[last]

    def _answered(self, seq: list[int]) -> bool:
        return lcs(self._masks(self.answer), len(self.answer), seq)[-1] == len(self.answer)

    def _tight(self, seq: list[int], a: int, z: int, best: int, answered: bool) -> tuple[int, int]:
        """The first end, and for it the last start, between which the same words (and the answer) are found."""
        n, k = len(self.words), len(self.answer)
        end = a + lcs(self.masks, n, seq[a:z]).index(best)
        if answered:
            end = max(end, a + lcs(self._masks(self.answer), k, seq[a:z]).index(k))
        part = seq[a : end + 1][::-1]
        start = end - lcs(self.back, n, part).index(best)
        if answered:
            start = min(start, end - lcs(self._masks(self.answer[::-1]), k, part).index(k))
        return start, end


def _hits(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Each row's words that the benchmark has too: places and word numbers, packed."""
    shared = docs.sparkSession.sparkContext.broadcast({w.encode(): k for w, k in vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in slices(batches):
            places, ids, sizes = [], [], []
            for t in batch.column(1).to_pylist():
                words = raw_tokens(t)
                own = np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words))
                at = np.flatnonzero(own >= 0).astype(np.int32)
                places.append(at.tobytes())
                ids.append(own[at].tobytes())
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(places, pa.binary()), pa.array(ids, pa.binary())], ["doc_id", "n", "at", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n int, at binary, ids binary")


@dataclass
class Batch:
    """Rows of packed hits as flat arrays; blocks are numbered through all rows, with an empty one after each row."""

    sizes: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    row: np.ndarray
    block: np.ndarray
    first: np.ndarray
    blocks: int

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> Batch:
        sizes = batch.column("n").to_numpy(zero_copy_only=False)
        at = [np.frombuffer(x, np.int32) for x in batch.column("at").to_pylist()]
        ids = [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
        row = np.repeat(np.arange(len(at)), [len(x) for x in at])
        flat = np.concatenate([*at, np.zeros(0, np.int32)])
        count = -(-sizes // width) + 1
        first = np.concatenate(([0], np.cumsum(count)))
        return cls(sizes, flat, np.concatenate([*ids, np.zeros(0, np.int32)]), row, first[row] + flat // width, first, int(first[-1]))


def _sums(block: np.ndarray, vectors: np.ndarray, ids: np.ndarray, blocks: int) -> np.ndarray:
    """The sum of vectors in each block."""
    out = np.zeros((blocks, vectors.shape[1]), dtype=vectors.dtype)
    if len(block):
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        out[block[starts]] = np.add.reduceat(vectors[ids], starts, axis=0)
    return out


def _passages(y: np.ndarray) -> np.ndarray:
    """Each block with the one after it; rows end in an empty block, so none reaches into the next row."""
    return y + np.concatenate((y[1:], np.zeros_like(y[:1])))


def _places(n: int) -> range:
    """Where the pieces of an item of n words begin."""
    return range(0, max(1, n - BLOCK), BLOCK)


def _unit(y: np.ndarray) -> np.ndarray:
    return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _shared(p: np.ndarray, k: np.ndarray, ends: np.ndarray, ids: np.ndarray, member: np.ndarray, words: int) -> np.ndarray:
    """For each (passage, item): telling words of the passage's two blocks that the item has; member: sorted k * words + id."""
    size = ends[p + 2] - ends[p]
    pair = np.repeat(np.arange(len(p)), size)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + ends[p][pair]
    wanted = k[pair].astype(np.int64) * words + ids[at]
    found = member[np.minimum(np.searchsorted(member, wanted), len(member) - 1)] == wanted
    return np.bincount(pair, found, minlength=len(p))


def _near(rows: np.ndarray, both: np.ndarray, targets: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, piece) whose cosine is large enough, for the first block alone or for both; pieces in bounded products."""
    found = []
    for lo in range(0, len(targets), PIECES):
        near = np.maximum(*(y @ targets[lo : lo + PIECES].T for y in (rows, both)))
        p, k = np.nonzero(near >= cosine)
        found.append((p, k + lo, near[p, k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Whole:
    """Short items, found where all their words stand one after the other."""

    def __init__(self, items: list[tuple[int | None, list[int]]]) -> None:
        self.by_size: dict[int, tuple[np.ndarray, list]] = {}
        for size in sorted({len(w) for _, w in items}):
            own = sorted(((self._hash(np.array([w]))[0], i, w) for i, w in items if len(w) == size), key=lambda x: x[0])
            self.by_size[size] = np.array([h for h, _, _ in own], dtype=np.uint64), [(i, w) for _, i, w in own]

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        for c in range(rows.shape[1]):
            h = (h ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def find(self, at: np.ndarray, ids: np.ndarray) -> dict[int | None, tuple[int, int]]:
        """Each item found: its first and last word's place, where it stands first."""
        out: dict[int | None, tuple[int, int]] = {}
        for size, (hashes, items) in self.by_size.items():
            starts = np.flatnonzero(at[size - 1 :] - at[: len(at) - size + 1] == size - 1) if len(at) >= size else np.zeros(0, int)
            if not len(starts):
                continue
            h = self._hash(ids[starts[:, None] + np.arange(size)])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for j in np.flatnonzero(hi > lo).tolist():
                words = ids[starts[j] : starts[j] + size].tolist()
                for i, w in items[lo[j] : hi[j]]:
                    if w == words:
                        place = int(at[starts[j]])
                        out[i] = min(out.get(i, (place, 0)), (place, place + size - 1))
        return out


def _total(hits: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """Sum a matrix that each task makes from its batches; parts of it are added up in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for small in slices(batches, 256):
            total += partial(small)
        starts = range(0, shape[0], ROWS)
        spread = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i in starts], pa.int32()), pa.array([spread] * len(starts), pa.int32()),
            pa.array([total[i : i + ROWS].tobytes() for i in starts], pa.binary()),
        ], ["part", "spread", "z"])

    def add(group: pa.Table) -> pa.Table:
        z = sum(np.frombuffer(x) for x in group["z"].to_pylist())
        return pa.table({"part": group["part"][:1], "spread": group["spread"][:1], "z": pa.array([z.tobytes()], pa.binary())})

    form = "part int, spread int, z binary"
    parts = hits.select("n", "at", "ids").mapInArrow(run, form).groupBy("part", "spread").applyInArrow(add, form).groupBy("part").applyInArrow(add, form)
    out = np.zeros(shape)
    for r in parts.collect():  # a matrix over the benchmark's words, whatever the corpus holds
        out[r["part"] : r["part"] + ROWS] = np.frombuffer(bytes(r["z"])).reshape(-1, shape[1])
    return out


def _counts(hits: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Blocks that hold each word, and all blocks."""

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        b = Batch.of(batch, BLOCK)
        once = np.unique(b.block.astype(np.int64) * words + b.ids)
        n = np.bincount(once % words, minlength=words + 1).astype(float)
        n[words] = b.blocks - len(b.sizes)
        return n[:, None]

    n = _total(hits, partial, (words + 1, 1))[:, 0]
    return n[:words], int(n[words])


FORM = "doc_id long, item_id long, rule string, overlap double, cosine double, first_word int, last_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.22, copy: float = 0.8, paraphrase: float = 0.6) -> DataFrame:
    """Return (doc_id, item_id, rule, overlap, cosine, first_word, last_word), one row for each document and item found.

    ``overlap`` is the share of the item's words found in order inside a span of at most twice its length: ``copy``
    or more of them, or ``paraphrase`` or more with the item's answer in order in that span. Items of under eight words
    must stand whole (rule ``exact``, no cosine). Items without words match nothing, nor do null and empty texts. Rows that
    share a doc_id give one row an item, and items that share an item_id one row a document; rows without doc_id, or items
    without item_id, are searched and reported under null. Equal items are reported each. A benchmark of any size is
    searched, in parts of bounded size. Only doc_id, item_id and text are read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    parts = -(-(items.agg(F.sum(F.size(F.split("text", r"[\W_]+")))).first()[0] or 0) // PART_WORDS)
    found = docs.sparkSession.createDataFrame([], FORM)
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        rows = sorted(((r["item_id"], tokens(r["text"])) for r in own.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if rows := [(i, w) for i, w in rows if w]:
            found = found.unionByName(_search(docs, rows, cosine, copy, paraphrase))
    best = F.max_by(F.struct("rule", "overlap", "cosine", "first_word", "last_word"), F.struct("overlap", "cosine", -F.col("first_word"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def _search(docs: DataFrame, rows: list[tuple[int | None, list[str]]], cosine: float, copy: float, paraphrase: float) -> DataFrame:
    """What is found of one part of a benchmark."""
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in rows for w in ws}))}
    numbered = [(i, [vocabulary[w] for w in ws]) for i, ws in rows]
    hits = materialise(_hits(docs, vocabulary))
    whole = [(i, ws) for i, ws in numbered if len(ws) < LEAST_WORDS]
    items = [Item(i, ws) for i, ws in numbered if len(ws) >= LEAST_WORDS]
    exact = _stand_whole(hits, whole) if whole else spark.createDataFrame([], FORM)
    return exact.unionByName(_latent(hits, items, len(vocabulary), cosine, copy, paraphrase)) if items else exact


def _stand_whole(hits: DataFrame, items: list[tuple[int | None, list[int]]]) -> DataFrame:
    held = hits.sparkSession.sparkContext.broadcast(Whole(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for d, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "ids")), strict=True):
                got = held.value.find(np.frombuffer(at, np.int32), np.frombuffer(ids, np.int32))
                out += [(d, i, "exact", 1.0, None, a, z) for i, (a, z) in got.items()]
            yield _batch_of(out)

    return hits.select("doc_id", "at", "ids").mapInArrow(run, FORM)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    types = pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "rule", "overlap", "cosine", "first_word", "last_word"])


def _latent(hits: DataFrame, items: list[Item], words: int, cosine: float, copy: float, paraphrase: float) -> DataFrame:
    """Latent semantic retrieval of items, each candidate verified on the text."""
    spark = hits.sparkSession
    df, blocks = _counts(hits, words)
    telling = df <= SHARE * blocks
    pieces = [(k, x.words[lo : lo + 2 * BLOCK]) for k, x in enumerate(items) for lo in _places(len(x.words))]
    for _, ws in pieces:
        telling[sorted(set(ws), key=lambda w: (df[w], w))[:RAREST]] = True
    weight = np.where(telling, np.log((1 + blocks) / (1 + df)), 0.0)
    owner = np.array([k for k, _ in pieces])
    own = np.concatenate([np.array(ws) for _, ws in pieces])
    piece = np.repeat(np.arange(len(pieces)), [len(ws) for _, ws in pieces])
    member = np.unique((owner[piece].astype(np.int64) * words + own)[weight[own] > 0])
    member = member if len(member) else np.array([-1])

    def projected(vectors: np.ndarray) -> np.ndarray:
        return _sums(piece, vectors * weight[:, None], own, len(pieces))

    # the range of A'A, from one pass; the items' pieces count as passages too
    rank = min(RANK + EXTRA, words)
    random = np.random.default_rng(3).standard_normal((words, rank))
    # vectors travel with their weights; a sketch only finds the range, so half the width will do
    held = spark.sparkContext.broadcast((telling, (random * weight[:, None]).astype(np.float32)))

    def sketch(batch: pa.RecordBatch) -> np.ndarray:
        telling, random = held.value
        b = Batch.of(batch, BLOCK)
        keep = telling[b.ids]
        block, ids = b.block[keep], b.ids[keep]
        y = _passages(_sums(block, random, ids, b.blocks))
        t = y + np.concatenate((np.zeros_like(y[:1]), y[:-1]))
        order = np.argsort(ids, kind="stable")
        return _sums(ids[order], t, block[order], len(telling))

    order = np.argsort(own, kind="stable")
    back = _sums(own[order], projected(random), piece[order], words)
    z = (_total(hits, sketch, random.shape) + back) * weight[:, None]
    basis = np.linalg.qr(z)[0]
    based = spark.sparkContext.broadcast((telling, basis * weight[:, None]))

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        telling, basis = based.value
        b = Batch.of(batch, BLOCK)
        keep = telling[b.ids]
        y = _passages(_sums(b.block[keep], basis, b.ids[keep], b.blocks))
        return y.T @ y

    g = _total(hits, gram, (rank, rank)) + projected(basis).T @ projected(basis)
    latent = basis @ np.linalg.eigh(g)[1][:, ::-1][:, : min(RANK, rank)]
    targets = _unit(projected(latent))
    space = spark.sparkContext.broadcast((telling, (latent * weight[:, None]).astype(np.float32), targets, owner, member, items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling, latent, targets, owner, member, items = space.value
        for batch in slices(batches, 256):
            b, out = Batch.of(batch, BLOCK), []
            keep = telling[b.ids]
            block, ids = b.block[keep], b.ids[keep]
            alone = _sums(block, latent, ids, b.blocks)
            both = _passages(alone)
            # a passage shares no more telling words with an item than it holds
            told = np.searchsorted(block, np.arange(b.blocks + 2))
            live = np.flatnonzero(told[2:] - told[:-2] >= LEAST_SHARED)
            p, k, near = _near(_unit(alone[live]), _unit(both[live]), targets, cosine)
            p, k = live[p], owner[k]
            shared = _shared(p, k, told, ids, member, words)
            p, k, near = (x[shared >= LEAST_SHARED] for x in (p, k, near))
            row = np.searchsorted(b.first, p, side="right") - 1
            ends = np.searchsorted(b.row, np.arange(len(b.sizes) + 1))
            names, done, seen = batch.column("doc_id"), set(), set()
            for j in np.lexsort((p, -near, k, row)).tolist():
                d, item = int(row[j]), items[k[j]]
                if (d, int(k[j])) in done or (int(p[j]), int(k[j])) in seen:
                    continue
                seen.add((int(p[j]), int(k[j])))
                reach = -(-2 * len(item.words) // BLOCK)  # holds every span that meets the passage
                lo, hi = ((int(p[j]) - int(b.first[d]) + e) * BLOCK for e in (-reach, 2 + reach))
                at = b.at[ends[d] : ends[d + 1]]
                a, z = np.searchsorted(at, (lo, hi))
                if got := item.verify(at[a:z], b.ids[ends[d] : ends[d + 1]][a:z], copy, paraphrase):
                    done.add((d, int(k[j])))
                    share, rule, first, last = got
                    out.append((names[d].as_py(), item.item_id, rule, share, float(near[j]), first, last))
            yield _batch_of(out)

    return hits.select("doc_id", "n", "at", "ids").mapInArrow(search, FORM)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. A row is named by its doc_id and text together."""
    named = docs.withColumn("__row", F.xxhash64(text_of(), F.col("doc_id").cast("long")))
    found = contaminated(named.select(F.col("__row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__row")).distinct()
    return named.join(found, "__row", "left_anti").select(*docs.columns)
