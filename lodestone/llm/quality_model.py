"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins. Cyclic boosting visits one feature after the other and adds a shallow tree over its bins
to that feature's lookup table; pairs of features that explain what is left get tables of their own. Scoring looks up
bins and adds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .toxicity import held_out, labelled

#: Labelled rows that a model is fitted on, at most.
MAX_ROWS = 8000
BINS, PAIR_BINS = 24, 8
FEATURES = ("words", "word_length", "symbols", "capitals", "distinct", "repeats", "top_share", "same_lines", "marks", "digits", "short_words")
SYMBOLS = b"#*$%&|<>"


def features(text: str) -> list[float]:
    """Measurements of one whole text; a text without words has zeros."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = Counter(words)
    drop = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    return [
        float(np.log1p(n)), size / n, drop(SYMBOLS), drop(bytes(range(65, 91))) * n / size, len(kinds) / n**0.9,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(kinds.values()) / n,
        1 - len(set(lines)) / len(lines), drop(b"!?.,;:"), drop(b"0123456789"), sum(len(w) < 2 for w in words) / n,
    ]


@dataclass(frozen=True)
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features: one addition of looked-up values for each table."""
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins: splits that gain most, then a Newton step for each leaf."""
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        gains = [(worth(a, c) + worth(c, b) - worth(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)]
        if not gains or (best := max(gains))[0] <= 1e-9:
            break
        _, a, c, b = best
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _corner(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a table into four parts, and its gain."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            quad = lambda s: (s[a, b], s[a, -1] - s[a, b], s[-1, b] - s[a, b], s[-1, -1] - s[a, -1] - s[-1, b] + s[a, b])  # noqa: B023, E731
            gain = sum(x * x / (y + ridge) for x, y in zip(quad(gs), quad(hs), strict=True))
            if gain > best + 1e-9:
                best, v = gain, [-x / (y + ridge) for x, y in zip(quad(gs), quad(hs), strict=True)]
                out = np.zeros_like(g)
                out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return best, out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, pairs: int = 4, rate: float = 0.2) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges, pair_edges = ([_cuts(x[:, j], b) for j in range(x.shape[1])] for b in (BINS, PAIR_BINS))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return Model(base, edges, tables, [], pair_edges, [])
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)))
            table += step
            z += step[at[j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_corner(grid(*p, g), grid(*p, h))[0])[:pairs]
    pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in ranked]
    for _ in range(rounds // 3):
        for (i, j), table in zip(ranked, pair_tables, strict=True):
            g, h = slopes()
            step = rate * _corner(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return Model(base, edges, tables, ranked, pair_edges, pair_tables)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows; only their features come to the driver."""

    @F.arrow_udf("array<double>")
    def measured(text: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in text.to_pylist()], pa.list_(pa.float64()))

    rows = labelled(docs, labels, "quality", max_rows).select("doc_id", "y", measured("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in rows], dtype=float))


def classify(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """Return ``docs`` with score and predicted (int) added.

    Null and empty texts have zero features and get the score those have. Repeated rows score alike; an empty table
    gives an empty result; input columns of these names are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(texts):
            x = np.array([features(t) for t in batch.to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x), pa.float64())

    return docs.drop("score", "predicted").withColumn("score", run(text_of())).withColumn("predicted", (F.col("score") >= limit).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """Fit on ``labels`` and score ``docs``: what ``classify`` returns, and held_out; without usable labels all scores are one half."""
    return classify(docs, fit(docs, labels), limit).withColumn("held_out", held_out())
