"""The five stages of the pipeline in a row against plain versions, with nulls, repeats and empty tables."""

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_corpus import MODEL, SHAPE, lower, plain_components, plain_fingerprint, plain_verify, prose

import corpus_pipeline
from lodestone.llm import decontamination

TOXIC, LINE = ("vile", "nasty", "rotten"), "A line that many share."


def tables():
    rng = random.Random(21)
    made, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = ". ".join(prose(rng, rng.randint(5, 12), 3000) for _ in range(rng.randint(3, 8)))
        made.append((k, f"{text} {rng.choice(TOXIC)} {rng.choice(TOXIC)}." if bad else text))
        labels.append((k, 1, int(bad)))
    items = [(i, " ".join(f"q{(i * 7 + j) % 90}" for j in range(20))) for i in range(6)]
    fresh = lambda: prose(rng, 60, 3000)
    leak = lambda i: f"{fresh()} {items[i][1]} {fresh()}"
    made += [(None, leak(0)), (None, fresh()), (None, fresh()), (500, leak(1)), (500, fresh()), (500, fresh()), (501, leak(2))]
    made += [(7, made[1][1]), (None, made[2][1]), made[3], made[3], (502, "vile nasty. " + fresh()), (None, None), (503, ""), (504, None)]
    made += [(600 + k, f"{fresh()}\n{LINE}\n{fresh()}") for k in range(12)]
    return made, items, labels


def plain_pipeline(made, items):
    import sentencepiece

    rows = [(i, t or "") for i, t in made if not any(w in (t or "") for w in TOXIC)]
    count = Counter(k for _, t in rows for k in {lower(x.strip()) for x in t.split("\n")} if k)
    rows = [(i, "\n".join(x for x in t.split("\n") if count[lower(x.strip())] < 10)) for i, t in rows]
    root = plain_components({plain_fingerprint(t) for _, t in rows}, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, t in rows:
        at = root[plain_fingerprint(t)]
        first[at] = min(first.get(at, (True, 0, "")), (i is None, i or 0, t)) if at in first else (i is None, i or 0, t)
    rows = [(None if none else i, t) for none, i, t in first.values()]
    whole = [decontamination.tokens(t) for _, t in items]
    rows = [(i, t) for i, t in rows if not any(plain_verify(x, decontamination.tokens(t), 0.8, 0.6) for x in whole)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return Counter((i, tuple(sp.encode(t))) for i, t in rows)


def write(spark, where, made, items, labels):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], SHAPE).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_pipeline_against_plain_stages(spark, tmp_path):
    made, items, labels = tables()
    got = corpus_pipeline.run(spark, write(spark, tmp_path, made, items, labels)).collect()
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == plain_pipeline(made, items)


def test_pipeline_of_empty_tables(spark, tmp_path):
    _, items, labels = tables()
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "docs", [], items, labels)).count() == 0
    made = [(1, "some words of a text"), (None, "others")]
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "rest", made, [], [])).count() == 2
