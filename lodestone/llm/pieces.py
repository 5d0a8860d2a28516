"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units across which no piece of the model reaches: a run of separators with the letters or with the
other characters after it. Each distinct unit is exploded into its substrings of bounded length, these are equi-joined
to the piece table, and the edges found are grouped by unit again. A higher-order aggregate then folds each lattice. For
unigram models it is the Viterbi fold over positions. A byte-pair model's encoding is defined by merge order and not by a
best sum: short units are folded by merges over the same edges, and for units of any length the Viterbi fold takes only
edges that may follow each other, which leaves one path.

Texts travel as numbers of units. The encodings of frequent units, bounded in number and length, are broadcast; all others
are encoded where they fall and joined to their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex as re
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, partitions, slices, text_of

SEPARATOR = "▁"
#: Frequent units whose encodings are broadcast, their characters at most, and the share of rows that they are chosen from.
FREQUENT, SHORT, SHARE = 400_000, 32, 16
#: Distinct units that a task counts before it hands them on.
HELD = 100_000
#: Rows that are decoded at once.
ROWS = 200
#: A byte that no UTF-8 text holds.
BREAK = b"\xff"
#: Loose pieces of a model whose other pieces are merged in one pass, at most.
LOOSE = 200
#: Boundaries that fit a 64-bit mask; positions of a block of the fold; characters of a part of a long unit.
MASK, BLOCK, PART = 61, 64, 256
#: What a character without a piece costs more than the worst piece of a unigram model.
UNKNOWN = 10.0
LETTER = re.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """A piece table: (piece, id, score) of the normal pieces, and the ids of the byte pieces in order of their byte."""

    pieces: list[tuple[str, int, float]] = field(repr=False)
    bytes_from: int | None
    unknown: int
    kind: str
    prefix: bool = True

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def unit(self) -> str:
        """Where no piece mixes letters and other characters, units end between them too."""
        mixed = any(len({bool(LETTER.match(c)) for c in p.lstrip(SEPARATOR)}) > 1 for p, _, _ in self.pieces)
        if any(SEPARATOR in p.lstrip(SEPARATOR) for p, _, _ in self.pieces):
            raise ValueError("a piece holds a separator after other characters")
        rest = f"[^{SEPARATOR}]+" if mixed else rf"(?:\p{{L}}+|[^\p{{L}}{SEPARATOR}]+)"
        return f"{SEPARATOR}*{rest}|{SEPARATOR}+"

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Each piece's place in the order of merges; equal scores share one."""
        order = {s: i for i, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return {p: order[s] for p, _, s in self.pieces}

    @cached_property
    def loose(self) -> set[int]:
        """Ranks of the pieces that may be merged later than at their turn: tied ones, and those not made of two earlier ones.

        Merges inside a piece don't depend on what is around it. If the merges of its text that come before its own leave
        two symbols, it can be merged at its turn if its ends still stand, or never.
        """
        ranks, shared = self.ranks, Counter(self.ranks.values())

        def symbols(piece: str) -> int:
            n, live = len(piece), set(range(len(piece) + 1))
            found = sorted((ranks[piece[i:j]], i, j) for i in range(n) for j in range(i + 2, n + 1) if piece[i:j] in ranks)
            for _, i, j in found[: found.index((ranks[piece], 0, n))]:
                if i in live and j in live:
                    live -= set(range(i + 1, j))
            return len(live) - 1

        return {r for p, r in ranks.items() if len(p) > 1 and (shared[r] > 1 or symbols(p) != 2)}

    def texts(self) -> list[bytes]:
        """Each id's bytes, the separator as a space; control pieces have none."""
        out = [b""] * (1 + max([i for _, i, _ in self.pieces] + ([self.bytes_from + 255] if self.bytes_from is not None else []) + [self.unknown]))
        for p, i, _ in self.pieces:
            out[i] = p.replace(SEPARATOR, " ").encode()
        for b in range(256 if self.bytes_from is not None else 0):
            out[self.bytes_from + b] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    """Read a model file on the driver. Byte-pair models score their pieces by falling whole numbers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    first = next((i for i in range(n) if sp.is_byte(i)), None)
    kind = "bpe" if all(s == int(s) for _, _, s in pieces) else "unigram"
    return Model(pieces, first, sp.unk_id(), kind, sp.encode("a", out_type=str)[0].startswith(SEPARATOR))


def as_unigram(model: Model) -> Model:
    """The same pieces as a unigram model: by rule, a piece's chance falls with its place in the file's order (Zipf's law)."""
    score = {p: -math.log(r + 2) for p, r in model.ranks.items()}
    return Model([(p, i, score[p]) for p, i, _ in model.pieces], model.bytes_from, model.unknown, "unigram", model.prefix)


def _byte_ids(model: Model, c: Column) -> Column:
    """Ids of a character that no piece holds."""
    if model.bytes_from is None:
        return F.array(F.lit(model.unknown))
    raw = F.encode(c, "UTF-8")
    one = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + model.bytes_from
    return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), one)


def _start(x: Column) -> Column:
    return F.shiftright(x, 26).bitwiseAND(F.lit(63)).cast("int")


def _size(x: Column) -> Column:
    return F.shiftright(x, 20).bitwiseAND(F.lit(63)).cast("int")


def _one(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _ends(x: Column) -> Column:
    return _one(_start(x)).bitwiseOR(_one(_start(x) + _size(x)))


def _inner(x: Column) -> Column:
    return _one(_start(x) + _size(x)) - _one(_start(x) + 1)


def _span(x: Column) -> Column:
    """All boundaries from an edge's start to its end."""
    return _one(_start(x) + _size(x) + 1) - _one(_start(x))


def _merged(packed: Column, n: Column, model: Model) -> Column:
    """Boundaries left, as bits of a long, when adjacent symbols have been merged, best edge first.

    One pass over the edges in order; only where a piece may be merged later than at its turn, the best one is searched
    again after each merge.
    """
    every = _one(n + 1) - 1
    wide = F.filter(packed, lambda x: _size(x) >= 2)

    def turn(b: Column, x: Column) -> Column:
        return F.when(b.bitwiseAND(_ends(x)) == _ends(x), b.bitwiseAND(F.bitwise_not(_inner(x)))).otherwise(b)

    def step(acc: Column, _: Column) -> Column:
        # the best edge whose ends both stand with one boundary between them; edges that lost an end are left out
        def merge(live: Column) -> Column:
            gone = F.get(F.filter(live, lambda x: F.bit_count(acc["b"].bitwiseAND(x["inner"])) == 1), F.lit(0))["inner"]
            left = lambda g: F.struct(F.coalesce(acc["b"].bitwiseAND(F.bitwise_not(g)), acc["b"]).alias("b"), F.when(g.isNull(), F.slice(live, 1, 0)).otherwise(live).alias("m"))
            return let(gone, left)

        return F.when(F.size(acc["m"]) == 0, acc).otherwise(let(F.filter(acc["m"], lambda x: acc["b"].bitwiseAND(x["ends"]) == x["ends"]), merge))

    marked = F.transform(wide, lambda x: F.struct(_ends(x).alias("ends"), _inner(x).alias("inner")))
    fold = lambda m: F.aggregate(F.sequence(F.lit(1), F.least(F.size(m), n - 1)), F.struct(every.alias("b"), m.alias("m")), step, lambda acc: acc["b"])
    search = let(marked, lambda m: F.when((F.size(m) == 0) | (n < 2), every).otherwise(fold(m)))
    if len(model.loose) > LOOSE:
        return search
    late = F.exists(wide, lambda x: F.shiftright(x, 32).isin(sorted(model.loose))) if model.loose else F.lit(False)
    return F.when(late, search).otherwise(F.aggregate(wide, every, turn))


def _bits(b: Column, n: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("getbit", b, i) == 1)


def _substrings(units: DataFrame, model: Model) -> DataFrame:
    """The columns of ``units``, s, k, piece: every substring of at most a piece's length, and an empty one at each unit's end."""
    n = F.length("unit")
    own = units.columns
    begun = units.select(*own, F.explode(F.sequence(F.lit(0), n)).alias("s"))
    size = F.explode(F.when(F.col("s") < n, F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("s")))).otherwise(F.array(F.lit(0)))).alias("k")
    return begun.select(*own, "s", size).select(*own, "s", "k", F.substring("unit", F.col("s") + 1, F.col("k")).alias("piece"))


def _lattice(units: DataFrame, model: Model) -> DataFrame:
    """The columns of ``units`` and e: the edges of short units of a byte-pair model, best first. An edge is one long: rank, place, length, id."""
    # bounded by the model file, whatever the corpus holds; the empty piece, first in order, keeps units that match nothing else
    table = units.sparkSession.createDataFrame([("", -1 << 40), *((p, model.ranks[p] << 32 | i) for p, i, _ in model.pieces)], "piece string, code long")
    own, parts = units.columns, _substrings(units, model)
    place = F.shiftleft(F.col("s").cast("long"), 26).bitwiseOR(F.shiftleft(F.col("k").cast("long"), 20))
    edges = parts.join(F.broadcast(table), "piece").select(*own, F.col("code").bitwiseOR(place).alias("edge"))
    return edges.groupBy(*own).agg(F.sort_array(F.collect_list("edge")).alias("e"))


def _short(units: DataFrame, model: Model) -> DataFrame:
    """Units of a byte-pair model whose boundaries fit a mask."""
    n = F.length("unit")

    def slow(b: Column) -> Column:
        """Ids where some character has no piece."""

        def one(i: Column, end: Column) -> Column:
            wanted = F.shiftleft(i.cast("long"), 26).bitwiseOR(F.shiftleft((end - i).cast("long"), 20))
            same = lambda w: F.get(F.filter("e", lambda x: x.bitwiseAND(F.lit(0xFFF00000)) == w), F.lit(0))
            return let(let(wanted, same), lambda x: F.when(x.isNotNull(), F.array(x.bitwiseAND(F.lit(0xFFFFF)).cast("int"))).otherwise(_byte_ids(model, F.substring("unit", i + 1, end - i))))

        return let(_bits(b, n), lambda at: F.flatten(F.transform(F.slice(at, 2, F.size(at) - 1), lambda end, i: one(F.get(at, i), end))))

    def ids(b: Column) -> Column:
        # the edges between neighbouring boundaries, in order, without the empty piece
        left = F.filter(F.slice("e", 2, F.size("e")), lambda x: b.bitwiseAND(_span(x)) == _ends(x))
        in_order = F.sort_array(F.transform(left, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))
        whole = lambda x: F.when(F.size(x) == F.bit_count(b) - 1, F.transform(x, lambda i: i.bitwiseAND(F.lit(0xFFFFF)).cast("int"))).otherwise(slow(b))
        return let(in_order, whole)

    return _lattice(units, model).select(*units.columns, let(_merged(F.col("e"), n, model), ids).alias("ids"))


def _long_edges(units: DataFrame, model: Model) -> DataFrame:
    """(key, t, k, piece, id, cost): every edge that ends at t, with k characters; characters without a piece have id -1.

    Units are cut into overlapping parts first, so that no substring is searched from the start of a long unit.
    """
    unknown = UNKNOWN - min((s for _, _, s in model.pieces), default=0.0)
    table = units.sparkSession.createDataFrame([(p, i, -s if model.kind == "unigram" else 0.0) for p, i, s in model.pieces], "piece string, id int, cost double")
    n, at = F.length("unit"), F.sequence(F.lit(0), F.length("unit") - 1, F.lit(PART))
    cut = lambda i: F.struct(i.alias("at"), F.least(F.lit(PART), n - i).alias("own"), F.substring(F.col("unit"), i + 1, F.lit(PART + model.longest - 1)).alias("part"))
    parts = units.select("key", F.inline(F.transform(at, cut)))
    begun = parts.select("key", "at", "part", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("s"))
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("part") - F.col("s")))).alias("k")
    pieces = begun.select("key", "at", "part", "s", k).select("key", (F.col("at") + F.col("s") + F.col("k")).alias("t"), "k", F.substring("part", F.col("s") + 1, F.col("k")).alias("piece"))
    known = pieces.join(F.broadcast(table), "piece", "left").filter("id is not null or k = 1")
    return known.select("key", "t", "k", "piece", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("cost", F.lit(unknown)).alias("cost"))


def _followed(edges: DataFrame, model: Model) -> DataFrame:
    """Edges with ``before``: the lengths, as bits, of the edges that may stand before them; 0 means the unit's start.

    In a byte-pair encoding two neighbours are the encoding of the text of both, and a path of such neighbours is the
    encoding of the whole. So distinct pairs of neighbouring pieces are encoded as short units.
    """
    ends = edges.select("key", F.col("t").alias("s"), F.col("piece").alias("a"))
    starts = edges.withColumn("s", F.col("t") - F.col("k"))
    pairs = starts.join(ends, ["key", "s"], "left").filter("a is not null or s = 0").withColumn("a", F.coalesce("a", F.lit("")))
    texts = pairs.select("a", F.col("piece").alias("b")).distinct().withColumn("unit", F.concat("a", "b"))
    cut = _lattice(texts.select("unit").distinct(), model).select("unit", _merged(F.col("e"), F.length("unit"), model).alias("cut"))
    apart = F.lit(1).cast("long").bitwiseOR(_one(F.length("a"))).bitwiseOR(_one(F.length("unit")))
    valid = texts.join(cut, "unit").filter(F.col("cut") == apart).select("a", F.col("b").alias("piece"))
    bit = _one(F.length("a"))
    return pairs.join(valid, ["a", "piece"]).groupBy("key", "t", "k", "piece", "id", "cost").agg(F.bit_or(bit).alias("before"))


def _viterbi(blocks: Column, longest: int) -> Column:
    """The best edge into each position; blocks hold positions in order, each with the edges that end there.

    One fold over blocks, and inside it one over positions. The state is a window of the last positions, so a step costs
    the same in a unit of any length.
    """

    def position(acc: Column, edges: Column) -> Column:
        def reached(e: Column) -> Column:
            old = F.get(acc, F.size(acc) - e["k"])
            fits = (e["before"] == -1) | (_one(old["k"]).bitwiseAND(e["before"]) != 0)
            return F.when(fits, F.struct((old["cost"] + e["cost"]).alias("cost"), e["k"].alias("k"), e["id"].alias("id"), e["raw"].alias("raw")))

        return F.array_append(acc, F.array_min(F.transform(edges, reached)))

    def block(acc: Column, positions: Column) -> Column:
        done = F.aggregate(positions, acc["window"], position)

        def keep(rows: Column) -> Column:
            new = F.slice(rows, F.size(acc["window"]) + 1, F.size(positions))
            return F.struct(F.slice(rows, F.greatest(F.lit(1), F.size(rows) - longest + 1), longest).alias("window"), F.array_append(acc["out"], new).alias("out"))

        return let(done, keep)

    state = "struct<cost:double,k:int,id:int,raw:string>"
    first = F.array(F.struct(F.lit(0.0), F.lit(0), F.lit(-1), F.lit(None).cast("string")).cast(state))
    none = F.array().cast(f"array<array<{state}>>")
    return F.aggregate(blocks, F.struct(first.alias("window"), none.alias("out")), block, lambda acc: F.flatten(acc["out"]))


def _path(best: Column, n: Column) -> Column:
    """The edges of the best path, from the end back to the start; collected in blocks, as they were made."""

    def step(acc: Column, _: Column) -> Column:
        x = F.get(best, acc["at"] - 1)
        return F.when(acc["at"] <= 0, acc).otherwise(F.struct((acc["at"] - x["k"]).alias("at"), F.array_append(acc["out"], F.struct(x["id"].alias("id"), x["raw"].alias("raw"))).alias("out")))

    def block(acc: Column, _: Column) -> Column:
        fresh = F.struct(acc["at"].alias("at"), F.array().cast("array<struct<id:int,raw:string>>").alias("out"))
        took = F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), fresh, step)
        return let(took, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

    begun = F.struct(n.alias("at"), F.array().cast("array<array<struct<id:int,raw:string>>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(n / BLOCK).cast("int")), begun, block, lambda acc: F.reverse(F.flatten(acc["out"])))


def _short_best(units: DataFrame, model: Model) -> DataFrame:
    """Short units of a unigram model. Their edges are grouped by the unit itself, so that only units move and no edge does."""
    unknown, own = UNKNOWN - min((s for _, _, s in model.pieces), default=0.0), units.columns
    table = units.sparkSession.createDataFrame([(p, i, -s) for p, i, s in model.pieces], "piece string, id int, cost double")
    known = _substrings(units, model).filter("k > 0").join(F.broadcast(table), "piece", "left").filter("id is not null or k = 1")
    edge = F.struct((F.col("s") + F.col("k")).alias("t"), F.coalesce("cost", F.lit(unknown)).alias("cost"), "k", F.coalesce("id", F.lit(-1)).alias("id"))
    edges = known.select(*own, edge.alias("edge")).groupBy(*own).agg(F.collect_list("edge").alias("e"))
    whole = lambda x: F.struct(x["cost"].alias("cost"), x["k"].alias("k"), x["id"].alias("id"), F.lit(-1).cast("long").alias("before"), F.when(x["id"] < 0, F.substring(F.col("unit"), x["t"], F.lit(1))).alias("raw"))
    into = F.transform(F.sequence(F.lit(1), F.length("unit")), lambda t: F.transform(F.filter("e", lambda x: x["t"] == t), whole))
    return edges.select(*own, _ids_of_path(F.array(into), model).alias("ids"))


def _ids_of_path(blocks: Column, model: Model) -> Column:
    one = lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(_byte_ids(model, x["raw"]))
    return F.flatten(F.transform(let(_viterbi(blocks, model.longest), lambda best: _path(best, F.size(best))), one))


def _general(units: DataFrame, model: Model) -> DataFrame:
    """Units of any length, in time that grows in proportion to it."""
    if model.kind == "bpe" and 2 * model.longest > MASK:
        raise ValueError(f"a piece of a byte-pair model has more than {MASK // 2} characters")
    # distinct rows and edges as they are: an exchange of all columns, which every branch below reads; keys are never null,
    # or a filter would be pushed below it
    keyed = units.withColumn("key", F.coalesce(F.md5(F.encode("unit", "UTF-8")), F.lit(""))).distinct()
    edges = _long_edges(keyed.select("key", "unit"), model).distinct()
    edges = _followed(edges, model) if model.kind == "bpe" else edges.withColumn("before", F.lit(-1).cast("long"))
    raw = F.when(F.col("id") < 0, F.col("piece")).alias("raw")
    into = edges.groupBy("key", "t").agg(F.collect_list(F.struct("cost", "k", "id", "before", raw)).alias("edges"))
    blocks = into.groupBy("key", F.floor((F.col("t") - 1) / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("t", "edges"))).alias("x"))
    lattice = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("b", F.col("x.edges").alias("x")))).alias("blocks"))
    return keyed.join(lattice.select("key", _ids_of_path(F.col("blocks.x"), model).alias("ids")), "key").select(*units.columns, "ids")


def encode_units(units: DataFrame, model: Model, n: Column | None = None) -> DataFrame:
    """``units`` with ids, for a table of distinct units, none of them empty; further columns have one value a unit.

    ``n`` is the length of a unit, if the table knows it already.
    """
    if model.kind == "bpe" and len(model.texts()) > 1 << 20:
        return _general(units, model)
    short, fold = (F.length("unit") if n is None else n) <= MASK, _short if model.kind == "bpe" else _short_best
    return fold(units.filter(short), model).unionByName(_general(units.filter(~short), model))


def _units(text: str, model_prefix: bool, find) -> list[str]:
    if not text:
        return []
    return find((SEPARATOR if model_prefix else "") + text.replace(" ", SEPARATOR))


def _frequent(docs: DataFrame, model: Model, most: int) -> pa.Table:
    """The most frequent short units of a share of the rows, with their encodings: ``most`` units of SHORT characters at most.

    This only decides which encodings travel to the workers beforehand; every other unit of any row is encoded and joined.
    """
    pattern, prefix = model.unit, model.prefix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(pattern).findall, Counter()

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

        for batch in batches:
            for texts in slices([batch.column(0)]):
                for t in texts.to_pylist():
                    seen.update(_units(t, prefix, find))
                if len(seen) > HELD:
                    yield hand_on()
                    seen.clear()
        yield hand_on()

    some = docs.select(text_of().alias("body")).filter(F.pmod(F.xxhash64("body"), F.lit(SHARE)) == 0)
    counts = some.mapInArrow(count, "unit string, n long").filter(F.length("unit") <= SHORT).groupBy("unit").agg(F.sum("n").alias("n"))
    often = materialise(counts.orderBy(F.desc("n"), "unit").limit(most))
    # dealt first: the one file of often would be one task, which would sort all edges; in order, so that most words of a text
    # have small numbers
    dealt = often.select("unit").repartition(partitions(docs.sparkSession), "unit")
    return encode_units(dealt, model).join(often, "unit").orderBy(F.desc("n"), "unit").select("unit", "ids").toArrow()


class Known:
    """Encodings of the frequent units as flat arrays: where each one starts, how many ids it has, and all ids.

    ``width`` is the bytes of an id in the encodings of other units.
    """

    def __init__(self, coded: pa.ChunkedArray, width: int) -> None:
        self.width = width
        chunks = [c for c in coded.chunks if len(c)]
        self.sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks] or [np.zeros(0)]).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate([c.flatten().to_numpy() for c in chunks] or [np.zeros(0)]).astype(np.int32)

    def fill(self, codes: list[np.ndarray], found: pa.ListArray) -> pa.ListArray:
        """Ids of texts: codes below the number of frequent units mean these, the others the text's own rare units.

        What was found of a text is one binary a rare unit: its number in the text in four bytes, then its ids.
        """
        n, own = len(self.sizes), found.flatten()
        held = np.where(found.is_valid().to_numpy(zero_copy_only=False), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        cut = (np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int32)).astype(np.int64) // self.width
        data = np.frombuffer(own.buffers()[2] if len(own) else b"", f">u{self.width}").astype(np.int64)
        head = 4 // self.width
        slot = sum(data[cut[:-1] + i] << 8 * self.width * (head - 1 - i) for i in range(head))
        order = np.lexsort((slot, np.repeat(np.arange(len(held)), held)))
        every = np.concatenate((self.sizes, (np.diff(cut) - head)[order]))
        starts = np.concatenate((self.starts, len(self.ids) + (cut[:-1] + head)[order]))
        flat = np.concatenate((self.ids, data.astype(np.int32)))
        words = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
        code = np.concatenate([*codes, np.zeros(0, np.int32)]).astype(np.int64)
        code += np.where(code >= n, np.repeat(np.cumsum(held) - held, words), 0)
        count = every[code]
        ends = np.cumsum(count)
        places = np.arange(int(count.sum())) + np.repeat(starts[code] - (ends - count), count)
        rows = np.concatenate(([0], np.cumsum(words)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends))[rows].astype(np.int32)), pa.array(flat[places]))


def _packed(number: Column, width: int) -> Column:
    """A number's bytes in hexadecimal, highest first."""
    return F.lpad(F.hex(number), 2 * width, "0")


def encode(docs: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """Return ``docs`` with ``ids`` (array of int) added: the encoding of each whole text.

    Null and empty texts have no ids. Texts and units of any length are encoded, in time that grows in proportion to them.
    Repeated rows each get theirs; an empty table gives an empty result; an ``ids`` column of the input is replaced,
    and other columns pass through.
    """
    return _encoded(docs.drop("ids"), model, frequent, docs.drop("ids").columns, [], "array<int>", lambda ids: ids).withColumnRenamed("__out", "ids")


def _encoded(docs: DataFrame, model: Model, frequent: int, keep: list[str], asked: list[str], shape: str, finish: Callable[..., pa.Array]) -> DataFrame:
    """The columns ``keep`` and ``__out``: ``finish`` of the ids, and of the columns ``asked``, in the worker that makes the ids."""
    pattern, prefix = model.unit, model.prefix
    known, width = _frequent(docs, model, frequent), 2 if len(model.texts()) <= 1 << 16 else 4
    # as one binary: a worker that waits for its next task holds no table of words
    numbers = docs.sparkSession.sparkContext.broadcast(BREAK.join([u.encode() for u in known["unit"].to_pylist()]))
    table = docs.sparkSession.sparkContext.broadcast(Known(known["ids"], width))

    @F.arrow_udf("struct<codes:binary,rare:binary>")
    def number(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Each text as numbers of frequent units, and its rare units, which are numbered on from there."""
        known = {u.decode(): i for i, u in enumerate(numbers.value.split(BREAK) if numbers.value else ())}
        find, get, first, pack = re.compile(pattern).findall, known.get, len(known), zstandard.ZstdCompressor(level=1).compress
        for some in slices(texts):
            codes, rare = [], []
            for t in some.to_pylist():
                units = _units(t, prefix, find)
                c = np.fromiter(map(get, units, repeat(-1)), dtype=np.int32, count=len(units))
                gaps, own = np.flatnonzero(c < 0), {}
                c[gaps] = [own.setdefault(units[i], first + len(own)) for i in gaps.tolist()]
                codes.append(pack(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes()))
                rare.append(pack(BREAK.join([u.encode() for u in own])) if own else None)
            yield pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(rare, pa.binary())], ["codes", "rare"])
        del known, get
        pa.default_memory_pool().release_unused()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rare units of each row, and their numbers there."""
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 2000):
            own = [[] if x is None else open_(x).split(BREAK) for x in batch.column("__rare").to_pylist()]
            sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            slot = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            row = np.repeat(batch.column("__row").to_numpy(), sizes)
            units = pa.array([u for x in own for u in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([units, pa.array(row), pa.array(slot.astype(np.int32))], ["unit", "row", "slot"])
        pa.default_memory_pool().release_unused()

    @F.arrow_udf(shape)
    def fill(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        open_ = zstandard.ZstdDecompressor().decompress
        for codes, found, _, *more in batches:
            for lo in range(0, len(codes), ROWS):
                planes = [np.frombuffer(open_(x), np.uint8).reshape(4, -1) for x in codes.slice(lo, ROWS).to_pylist()]
                ids = table.value.fill([np.ascontiguousarray(p.T).view(np.int32).reshape(-1) for p in planes], found.slice(lo, ROWS))
                yield finish(ids, *[x.slice(lo, ROWS) for x in more])
        pa.default_memory_pool().release_unused()

    # rows are dealt by number, so that no text or copy of it crowds a task; both branches below read this one exchange
    dealt = (
        docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__c", number(text_of()))
        .select(*dict.fromkeys([*keep, *asked]), "__row", F.col("__c.codes").alias("__codes"), F.col("__c.rare").alias("__rare")).repartition("__row")
    )
    # one exchange by unit serves short and long units and the join back: places are asked for in all of them, and lengths
    # are aggregated, or columns and filters would be pushed below the exchange and it would be made again
    wanted = dealt.mapInArrow(unpack, "unit string not null, row long not null, slot int not null").repartition("unit")
    first = wanted.groupBy("unit").agg(F.min("row").alias("first"), F.min("slot").alias("least"), F.max(F.length("unit")).alias("n"))
    ids = F.array_join(F.transform("ids", lambda i: _packed(i, width)), "").alias("packed")
    coded = encode_units(first, model, F.when(F.col("first").isNotNull() & F.col("least").isNotNull(), F.col("n"))).select(F.col("unit").alias("own"), "first", "least", ids)
    own = (F.col("unit") == F.col("own")) & (F.col("first") <= F.col("row")) & (F.col("least") <= F.col("slot"))
    placed = wanted.join(coded, own).select("row", "slot", "packed")
    entry = F.unhex(F.concat(_packed(F.col("slot"), 4), "packed"))
    found = placed.select(F.col("row").alias("__row"), entry.alias("entry")).groupBy("__row").agg(F.collect_list("entry").alias("__found"))
    # all columns are asked for, or the exchange would be pruned and made twice
    whole = F.col("__rare").isNotNull()
    return dealt.join(found, "__row", "left").select(*keep, fill("__codes", "__found", whole, *asked).alias("__out"))


def _texts(ids: pa.ListArray, pieces: pa.BinaryArray, lead: bool) -> list[bytes | None]:
    """The bytes of each list of ids. The pieces taken lie one after the other in one buffer."""
    known = ids.is_valid().to_pylist()
    sizes = np.where(known, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    taken = pieces.take(ids.flatten())
    at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1][np.concatenate(([0], np.cumsum(sizes)))]
    raw = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b""
    first = [a + bool(lead and z > a and raw[a : a + 1] == b" ") for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [raw[a:z] if ok else None for a, z, ok in zip(first, at[1:].tolist(), known, strict=True)]


def decode(coded: DataFrame, model: Model) -> DataFrame:
    """Return ``coded`` with ``decoded`` added: the text of ``ids``; null ids give a null text, bad bytes U+FFFD."""
    pieces: Broadcast = coded.sparkSession.sparkContext.broadcast(model.texts())
    lead = model.prefix

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array(pieces.value, pa.binary())
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                yield pa.array([x if x is None else x.decode("utf-8", "replace") for x in _texts(batch.slice(lo, ROWS), table, lead)], pa.string())

    return coded.withColumn("decoded", text("ids"))


def round_trip(docs: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """Return doc_id, n_ids (long), ids, and round_trip: whether they decode to the text, with separators as spaces.

    A text itself doesn't move, only its digest; ids are decoded where they are made. Null texts count as empty ones,
    which decode to themselves. Repeated rows each get a row; an empty table gives an empty result.
    """
    pieces, lead = model.texts(), model.prefix

    def compared(ids: pa.ListArray, digest: pa.Array) -> pa.Array:
        texts = _texts(ids, pa.array(pieces, pa.binary()), lead)
        same = [hashlib.md5(t.decode("utf-8", "replace").encode()).digest() == d for t, d in zip(texts, digest.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "same"])

    plain = F.unhex(F.md5(F.encode(F.replace(text_of(), F.lit(SEPARATOR), F.lit(" ")), "UTF-8")))
    digested = docs.select("doc_id", "text", plain.alias("__digest"))
    coded = _encoded(digested, model, frequent, ["doc_id"], ["__digest"], "struct<ids:array<int>,same:boolean>", compared)
    return coded.select("doc_id", F.size("__out.ids").cast("long").alias("n_ids"), "__out.ids", F.col("__out.same").alias("round_trip"))
