"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's score is a logistic function of the words in it, the document's is the
chance that at least one sentence is toxic, and only the document's label is known in training. Sentences without any
weighed word say nothing, however many there are: a document has one base chance in their place. The sentence with the
highest score is where the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

#: Labelled rows that a model is fitted on, at most; and words that it weighs, at most.
MAX_ROWS, MAX_WORDS = 8000, 2000
#: The least share of toxic documents among those that hold a word that is weighed.
PURE = 0.5
#: The largest bias: in long clean texts, sentences with words of little weight must not add up.
BIAS = -9.0
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """What is weighed: words, and their first four and five letters where more follow."""
    words = set(WORD.findall(text))
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows (doc_id, text, y), the first by hash of doc_id, none of them held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    some = rows.filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(some), "doc_id")


@dataclass(frozen=True)
class Model:
    bias: float
    words: dict[str, float]

    def sentence(self, s: str) -> float:
        """A sentence's score; 0 without a weighed word."""
        own = [self.words[w] for w in terms(s) if w in self.words]
        return float(1 / (1 + np.exp(-self.bias - sum(own)))) if own else 0.0

    def score(self, text: str) -> tuple[float, int | None, float]:
        """The document's score, and the index and score of its worst sentence; None where no sentence has a word."""
        text = text.lower()
        base = float(1 / (1 + np.exp(-self.bias)))
        if self.words.keys().isdisjoint(terms(text)):
            return base, None, base
        p = np.array([self.sentence(s) for s in SENTENCE.split(text)])
        return float(1 - (1 - base) * np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), int(p.argmax()), float(p.max())


def _candidates(rows: DataFrame, max_words: int) -> list[str]:
    """Words that stand in more toxic documents than chance would have it, strongest first; equal texts count once."""

    @F.arrow_udf("array<string>")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(terms(t.lower())) for t in texts.to_pylist()], pa.list_(pa.string()))

    once = rows.select("text", "y").distinct()
    sizes = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = (F.lit(float(sizes.get(k, 0) or 1)) for k in (0, 1))
    counts = once.select("y", F.explode(held("text")).alias("word")).groupBy("word").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1"))
    gain = (F.col("c1") / toxic - F.col("c0") / clean) / F.sqrt(F.col("c1") / (toxic * toxic) + F.col("c0") / (clean * clean))
    often = counts.filter((F.col("c1") >= 5) & (F.col("c1") >= PURE * (F.col("c0") + F.col("c1")))).select("word", gain.alias("gain")).filter("gain > 3")
    return [r["word"] for r in often.orderBy(F.desc("gain"), "word").limit(max_words).collect()]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Fit on a bounded sample of labelled rows. Without words that tell the classes apart, every score is near zero.

    Texts stay on the executors: words are counted there, and what comes back of a text is its label and, for each
    sentence that holds candidates, their numbers.
    """
    rows = labelled(docs, labels, "toxic", max_rows)
    words = _candidates(rows, max_words)
    if not words:
        return Model(BIAS, {})
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    @F.arrow_udf("array<array<int>>")
    def bag(texts: pa.Array) -> pa.Array:
        at = shared.value
        own = lambda s: sorted({at[w] for w in terms(s) if w in at})
        return pa.array([[x for s in SENTENCE.split(t.lower()) if (x := own(s))] for t in texts.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return train(sorted((r["bag"], r["y"]) for r in rows.select("y", bag("text").alias("bag")).collect()), words)


def train(bags: list[tuple[list[list[int]], int]], words: list[str], rounds: int = 800, ridge: float = 1e-5) -> Model:
    """Gradient steps on the likelihood of the document labels; a bag holds the numbers of the words of each sentence."""
    doc, sent, word, n = [], [], [], 0  # a row of each sentence with a word, and one of each document
    for d, (sentences, _) in enumerate(bags):
        for own in sentences:
            sent += [n] * len(own)
            word += own
            doc.append(d)
            n += 1
        doc.append(d)
        n += 1
    doc, sent, word = np.array(doc), np.array(sent, dtype=int), np.array(word, dtype=int)
    y = np.array([y for _, y in bags], dtype=float)
    theta = np.concatenate(([BIAS], np.zeros(len(words))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        z = theta[0] + np.bincount(sent, theta[1 + word], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags))
        none = np.exp(q)
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)[doc] * p / len(bags)
        grad = np.concatenate(([pull.sum()], np.bincount(word, pull[sent], minlength=len(words)) + ridge * theta[1:]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        theta[0] = min(theta[0], BIAS)
    return Model(float(theta[0]), {w: float(x) for w, x in zip(words, theta[1:], strict=True) if abs(x) > 0.05})


def score(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """Return ``docs`` with score, predicted (int), and sentence and offence: the worst sentence's number and text.

    Null and empty texts score as those without a weighed word. ``sentence`` counts pieces between sentence ends from 0;
    it and ``offence`` are null unless the document is predicted toxic. Repeated rows score alike; an empty table
    gives an empty result; input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = "struct<score:double,predicted:int,sentence:int,offence:string>"

    @F.arrow_udf(shape)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        for batch in slices(texts):
            out = []
            for t in batch.to_pylist():
                s, i, _ = held.score(t)
                bad = s >= limit
                out.append({"score": s, "predicted": int(bad), "sentence": i if bad else None, "offence": SENTENCE.split(t.lower())[i] if bad and i is not None else None})
            yield pa.array(out, pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("sentence", pa.int32()), ("offence", pa.string())]))

    names = ("score", "predicted", "sentence", "offence")
    return docs.drop(*names).withColumn("__toxic", run(text_of())).select(*[c for c in docs.columns if c not in names], *[f"__toxic.{c}" for c in names])


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """Fit on ``labels`` and score ``docs``: what ``score`` returns, and held_out; without usable labels all scores are near zero."""
    return score(docs, fit(docs, labels), limit).withColumn("held_out", held_out())
