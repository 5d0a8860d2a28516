"""Each corpus operator against a brute-force version on small tables with nulls, empties, ties, repeats and odd columns."""

import random
import re
import sys
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import duck, rows

from lodestone.llm import decontamination, graph, license_scan, line_dedup, pieces, quality_model, quality_rules, registry, sharding, simhash, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = registry.MODEL_PATH


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def prose(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0]] * 12 + [texts[1] + " tail", "x " + texts[2], None, None, "", " \n\t ", "É Ç MIT License"]
    common = "A line that many share.\n"
    texts += [f"{common}{prose(rng, 30)}\n  a LINE that many share. \n" for _ in range(11)]
    texts += [prose(rng, 6000), "a" * 3000, "ab " * 900, "Licensed under the Apache License, Version 2.0. MIT license MIT license"]
    texts += ["GNU General Public License, version 3", "mit\x00license", "all rights reserved"]
    ids = [*range(len(texts) - 3), None, None, 5]
    out = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]
    return [*out, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())


def odd(docs):
    """The same rows with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    names = ("n", "words", "body", "hash", "key", "bits", "score", "predicted", "ids", "kept", "spans", "n_lines", "size", "row", "part", "unit", "held_out", "fp", "label")
    return docs.withColumns({n: F.lit("clash") for n in names})


def clauses(rng):
    """Licence clauses whole, edited a little, edited too much, cut at the file's start, and without their key phrases."""
    out = []
    for t in license_scan.CLAUSES:
        words_ = t.phrase.split()
        telling = [i for i, _ in t.words]
        for spoilt in (0, len(telling) - t.least, len(telling) - t.least + 1):
            w = list(words_)
            for i in rng.sample(telling, spoilt):
                w[i] = "other"
            text = f"{prose(rng, 9)} {' '.join(w)}, {prose(rng, 5)}. {'. '.join(t.must)}"
            out += [text, text.upper()] if spoilt else [text]
        out += [f"{t.phrase} {prose(rng, 5)}", f"{' '.join(words_[2:])}; {' / '.join(t.must)}", f"{t.phrase} {' '.join(t.must)} {t.phrase}"]
    return out


def test_license_scan(spark, docs, empty):
    texts = clauses(random.Random(17))
    made = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)], SHAPE))
    got = sorted(map(tuple, license_scan.scan_licenses(odd(made)).collect()), key=str)
    want, kinds = [], Counter()
    for i, t in [*[r[:2] for r in corpus()], *[(1000 + i, t) for i, t in enumerate(texts)]]:
        w = dict(enumerate(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))))
        at = lambda p: [k for k in w if [w.get(k + j) for j in range(len(p.split()))] == p.split()]  # noqa: B023, E731
        best = lambda x: max(sum(w.get(s + j) == y for j, y in x.words) for s in range(-40, len(w) + 1))  # noqa: B023, E731
        held = {x: best(x) for x in (*license_scan.BASE, *license_scan.OWN)}
        held = {x: n for x, n in held.items() if n >= x.least and all(map(at, x.must))}
        base = [p for x in license_scan.BASE for p in at(x.phrase)]
        named = lambda ts: ",".join(sorted({x.label for x in ts}))
        score = max((n / (len(x.words) + 1) for x, n in held.items()), default=0.0)
        kinds.update(held.keys())
        want.append((i, len(w), len(base), min(base, default=None), max(base, default=None), named(x for x in held if x in license_scan.BASE), named(held), score))
    assert got == sorted(want, key=str)
    assert all(2 <= kinds[x] < len(texts) for x in license_scan.CLAUSES)
    assert license_scan.scan_licenses(empty).count() == 0


def plain_fingerprint(t):
    w = words(lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(values), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize("crowd", [64, 1])
def test_near_duplicates(docs, empty, crowd):
    got = Counter(map(tuple, simhash.near_duplicates(odd(docs), crowd=crowd).collect()))
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in corpus()]
    root = plain_components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_connect_dense_balls(spark, crowd):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes, crowd=crowd)).collect()}
    plain = plain_components({signed(v) for v in values}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {v: roots.get(v, v) for v in plain} == plain


def test_components_of_a_hub(spark):
    links = spark.createDataFrame([(500, i) for i in range(1, 3000) if i != 500] + [(5000, 5001)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 3000), 1), 5000: 5000, 5001: 5000}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert graph.components(links.filter("false")).count() == 0


def plain_substrings(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", gone)]
        out.append((len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), spans))
    return out


@pytest.mark.parametrize("crowd,anchors", [(150_000, 1 << 23), (3, 1 << 23), (150_000, 0)])
def test_substring_dedup(docs, empty, spark, monkeypatch, crowd, anchors):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "MAX_ANCHORS", anchors)
    rng = random.Random(8)
    block = prose(rng, 60)
    texts = [t for _, t, *_ in corpus()] + [f"{prose(rng, 20)} {block[k:]} {prose(rng, 30)}" for k in range(5)] + [block[:199], block[:200]]
    made = odd(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in substring_dedup.dedup_substrings(made).collect()}
    assert got == dict(enumerate(plain_substrings(texts)))
    assert substring_dedup.dedup_substrings(empty).count() == 0


def moved(monkeypatch, made):
    """What dedup_substrings gives, and the fragments that it moves to be ordered."""
    held, ordered = [], substring_dedup._ordered
    monkeypatch.setattr(substring_dedup, "_ordered", lambda fragments, buckets: held.append(fragments) or ordered(fragments, buckets))
    rows = substring_dedup.dedup_substrings(made).collect()
    return {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows}, held[0]


@pytest.mark.parametrize("crowd", [150_000, 3])
def test_substring_dedup_moves_no_bytes_for_a_join(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    monkeypatch.setattr(substring_dedup, "MAX_ANCHORS", 0)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1 << 9, raising=False)
    rng = random.Random(9)
    texts = [prose(rng, 300) for _ in range(12)]
    texts += [t[: rng.randint(300, 900)] + prose(rng, 40) for t in texts] + [texts[0], texts[0] + "."]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    got, fragments = moved(monkeypatch, made)
    assert got == dict(enumerate(plain_substrings(texts)))
    plan = fragments._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 8  # some passes, in four forms of the plan


def test_substring_dedup_moves_one_of_equal_fragments(spark, monkeypatch):
    rng = random.Random(10)
    block = prose(rng, 200)
    texts = [f"{prose(rng, 20)} {block} {prose(rng, 30)}" for _ in range(30)] + [prose(rng, 900), "ab " * 900]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got, fragments = moved(monkeypatch, made)
    assert got == dict(enumerate(plain_substrings(texts)))
    whole = fragments.filter("bytes is not null")
    assert whole.count() == whole.dropDuplicates(["place", "bytes"]).count() > 0
    # copies in other tasks, with other keys or the same or none
    alone = [prose(rng, 150) for _ in range(20)]
    ids = [*range(100), *[3] * 20, *[None] * 20]
    copies = spark.createDataFrame(list(zip(ids, alone * 7, strict=True)), "doc_id long, text string").repartition(7).cache()
    rows = substring_dedup.dedup_substrings(copies).collect()
    assert len(rows) == 140 and all(r["kept"] == b"" and [tuple(x) for x in r["spans"]] == [(0, r["n_bytes"])] for r in rows)
    monkeypatch.undo()
    _, fragments = moved(monkeypatch, copies.filter("doc_id is not null and doc_id <> 3").cache())
    assert fragments.filter("bytes is not null").count() == 0


def test_filters_hold_every_hash(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_ANCHORS", 256)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1 << 10)
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 4000, dtype=np.int64)
    inside, outside = h[:2000].view(np.uint64), h[2000:].view(np.uint64)
    hashes = spark.createDataFrame([(int(x),) for x in h[:2000]], "hash long")
    held = [x.value for x in substring_dedup._filters(hashes, 2000)]
    assert len(held) == 8 and all(len(x.bytes) <= 4 * 128 for x in held)
    assert (sum(x.has(inside).astype(int) for x in held) == 1).all() and sum(x.has(outside).sum() for x in held) < 100
    one = [x.value for x in substring_dedup._filters(hashes, 2000, one=True)]
    assert len(one) == 1 and len(one[0].bytes) == 4 * 128 and one[0].has(inside).all()


def test_windows_over_random_fragments():
    rng = random.Random(2)
    for _ in range(30):
        cuts, place, windows = [], [], []
        for _ in range(rng.randint(1, 30)):
            left, extra = rng.randint(0, 6), rng.randint(0, 6)
            n = rng.randint(max(1, left + 1 - 4), left + 1 + extra)
            cuts.append(bytes(rng.choice(b"ab") for _ in range(n + 8 - 1)))
            place.append(min(left, n + 8 - 2))
            windows.append(n)
        got = substring_dedup.repeated_windows(np.array(place), np.array(windows), cuts, 8)
        held = Counter((p - i, c[i : i + 8]) for p, n, c in zip(place, windows, cuts, strict=True) for i in range(n))
        for j, (p, n, c) in enumerate(zip(place, windows, cuts, strict=True)):
            for i in range(n):
                if p - i >= 0:
                    assert got[p - i, j] == (held[p - i, c[i : i + 8]] > 1)


def test_quality_rules(docs, empty):
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert quality_rules.quality_rules(docs).columns[:8] == first
    got = quality_rules.quality_rules(odd(docs)).collect()
    seen = Counter()
    for r in got:
        seen[r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]] += 1
    want = Counter()
    for i, t, *_ in corpus():
        w, t = words(t or ""), t or ""
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base] += 1
    assert seen == want
    assert quality_rules.quality_rules(empty).count() == 0


def test_policies_read_the_ledger_alone(docs):
    ledger = quality_rules.ledger(docs).cache()
    for p in quality_rules.POLICIES:
        kept = quality_rules.apply_policy(ledger, p).collect()
        base = quality_rules.POLICIES[0].mask
        assert all(r["kept"] == (r["failed"] & (p.mask | base) == 0) for r in kept)
    table = {(r["policy"], r["version"], r["rule"]): (r["failed"], r["only_this"]) for r in quality_rules.ablations(ledger).collect()}
    bits = [r["failed"] for r in ledger.collect()]
    rule, policy = quality_rules.RULES[0], quality_rules.POLICIES[1]
    assert table["default", 1, rule.name] == (sum(b >> rule.bit & 1 for b in bits), sum(b & policy.mask == 1 << rule.bit for b in bits))
    assert all(x == (0, 0) for x in ((r["failed"], r["only_this"]) for r in quality_rules.ablations(ledger.filter("false")).collect()))


def bench_items(rng):
    return [(k, prose(rng, rng.randint(10, 50), 3000)) for k in range(25)] + [(90, None), (91, ""), (92, "w1 w2"), (None, prose(rng, 20, 3000))]


def test_decontamination_recall_against_brute_force(spark, docs, empty):
    rng = random.Random(6)
    items, made, planted = bench_items(rng), [], set()
    for k in range(150):
        parts = [prose(rng, rng.randint(0, 90), 3000)]
        if k % 3 == 0:
            i, t = items[k % 25]
            w = t.split()
            if k % 2 and len(w) >= 20:  # a paraphrase: a few words changed, the answer kept
                for j in rng.sample(range(len(w) - 5), len(w) // 6):
                    w[j] = "other"
            parts.append(" ".join(w).upper())
            planted.add((k, i))
        parts.append(prose(rng, rng.randint(0, 90), 3000))
        made.append((k, " ".join(parts)))
    table = spark.createDataFrame([*made, (None, None), (777, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(odd(table), odd(benchmark)).collect()}
    brute = set()
    for d, t in made:
        seq = decontamination.tokens(t)
        for i, text in items:
            own = decontamination.tokens(text or "")
            if len(own) < decontamination.LEAST_WORDS:
                if own and any(seq[lo : lo + len(own)] == own for lo in range(len(seq))):
                    brute.add((d, i))
                continue
            at = {w: n for n, w in enumerate(sorted(set(own) | set(seq)))}
            item = decontamination.Item(i, [at[w] for w in own])
            for lo in range(0, len(seq), 32):
                part = np.array([at[w] for w in seq[lo : lo + 128]])
                hit = np.isin(part, item.words)
                if item.verify(np.flatnonzero(hit), part[hit], 0.8, 0.6):
                    brute.add((d, i))
                    break
    assert planted <= brute and len(brute & got.keys()) >= 0.9 * len(brute)
    assert planted <= got.keys() and got.keys() <= brute
    left = {r["doc_id"] for r in decontamination.decontaminate(table, benchmark).collect()}
    assert left == ({d for d, _ in made} | {None, 777}) - {d for d, _ in got}
    assert decontamination.contaminated(empty, benchmark).count() == 0 == decontamination.contaminated(table, benchmark.filter("false")).count()


def test_a_large_benchmark_in_parts_with_short_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PART_WORDS", 60_000)
    monkeypatch.setattr(decontamination, "PIECES", 700)
    rng = random.Random(18)
    items = [(k, prose(rng, rng.randint(8, 40), 5000)) for k in range(5000)] + [(5000 + k, f"short{k} w{k} item") for k in range(6)] + [(None, "odd pair"), (None, prose(rng, 30, 5000))]
    made = [(k, f"{prose(rng, 50, 5000)} {items[-1 - k % 30 * 60][1]} {prose(rng, 50, 5000)}") for k in range(60)]
    made += [(100 + k, f"{prose(rng, 20, 5000)} Short{k} W{k} item. {prose(rng, 3, 5000)}") for k in range(6)] + [(200, "short1 w1 and item"), (201, "an odd pair"), (None, "odd, pair")]
    found = decontamination.contaminated(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["rule"], r["overlap"]) for r in found.collect()}
    want = {(k, items[-1 - k % 30 * 60][0]) for k in range(60)} | {(100 + k, 5000 + k) for k in range(6)} | {(201, None), (None, None)}
    assert want <= got.keys() and all(got[100 + k, 5000 + k] == ("exact", 1.0) for k in range(6)) and got[None, None][0] == "exact"
    assert not [x for x in got if x[0] is None or x[0] >= 100 and x not in want if x[0] is not None]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_verify(item, text, copy, paraphrase):
    """The best share over all spans of at most twice the item's length, by tables."""
    n, best = len(item), 0
    for lo in range(len(text)):
        part = text[lo : lo + 2 * n]
        found = plain_lcs(item, part)
        if found >= copy * n or found >= paraphrase * n and plain_lcs(item[-4:], part) == 4:
            best = max(best, found)
    return (best / n, "copy" if best >= copy * n else "paraphrase") if best else None


def test_words_split_at_bytes():
    rng = random.Random(19)
    parts = ["Ab", "é", "É", "ß", "Σ", "ς", "İ", "ǅ", "½", "٣", "日本", "🙂", "e\u0301", "\u00ad", "\u200d", "\u00a0", "\u2028", "_", "-", "'", " ", "\n", "\x00", "\x1c", "\x7f", "9"]
    for text in ["", *parts, *("".join(rng.choices(parts, k=rng.randint(2, 30))) for _ in range(3000))]:
        assert decontamination.raw_tokens(text) == [w.encode() for w in decontamination.tokens(text)], text


def test_verify_finds_the_best_span():
    rng, kinds = random.Random(12), Counter()
    for k in range(1500):
        n = rng.randint(8, 14)
        item = [rng.randrange(40) for _ in range(n)]
        own = [x if rng.random() > 0.15 else 99 for x in item]
        stray = [[rng.choice([99, 99, 99, *item]) for _ in range(rng.randint(0, 30))] for _ in range(3)]
        cut = rng.randint(0, n)
        text = stray[0] + own[:cut] + (stray[1] if k % 3 == 0 else []) + own[cut:] + stray[2]
        at = np.flatnonzero([x != 99 for x in text])
        got = decontamination.Item(0, item).verify(at, np.array(text)[at], 0.8, 0.6)
        want = plain_verify(item, text, 0.8, 0.6)
        assert (got and got[:2]) == want
        if got:
            part = text[got[2] : got[3] + 1]
            assert len(part) <= 2 * n and plain_lcs(item, part) == round(got[0] * n)
        kinds[want and want[1]] += 1
    assert min(kinds[k] for k in ("copy", "paraphrase", None)) > 100


def test_edited_copy_beside_a_stray_word(spark):
    rng = random.Random(13)
    item = [f"q{i}" for i in range(20)]
    other = [prose(rng, 100, 3000) for _ in range(60)]
    edited = {0: ["q0", *["pad"] * 40, "other", *item[1:]], 1: [*item[:-1], "other", *["pad"] * 40, "q19"], 2: ["q0", *["pad"] * 30, *item[1:19], *["pad"] * 30, "q19"]}
    made = [(k, f"{t} {' '.join(edited.get(k, []))} {t}") for k, t in enumerate(other)]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, prose(rng, 20, 3000))], "item_id long, text string")
    got = {r["doc_id"]: r["overlap"] for r in decontamination.contaminated(spark.createDataFrame(made, "doc_id long, text string"), benchmark).filter("item_id = 7").collect()}
    assert got == {0: 0.95, 1: 0.95, 2: 0.9}


def test_long_items_are_searched_in_pieces(spark):
    rng = random.Random(14)
    items = [(k, prose(rng, n, 3000)) for k, n in enumerate((1, 32, 64, 65, 97, 200, 4000))]
    edited = [w if rng.random() > 0.1 else "other" for w in items[6][1].split()]
    made = [(k, f"{prose(rng, 45, 3000)} {t} {prose(rng, 45, 3000)}") for k, t in items] + [(7, f"{prose(rng, 300, 3000)} {' '.join(edited)}")]
    made += [(10 + k, prose(rng, 300, 3000)) for k in range(60)]
    found = decontamination.contaminated(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in found.collect()}
    got = {k: x for k, x in got.items() if k[1]}  # item 0 is a single word
    assert got.keys() == {(k, k) for k in range(1, 7)} | {(7, 6)} and all(got[k, k] == 1 for k in range(1, 7))
    for n in range(1, 400):
        assert {i for lo in decontamination._places(n) for i in range(lo, lo + 64)} >= set(range(n))


def test_copies_of_long_items_of_common_words(spark):
    rng = random.Random(15)
    items = [(k, prose(rng, 1300, 1500)) for k in range(6)]
    made = [(k, f"{prose(rng, 45, 1500)} {t} {prose(rng, 45, 1500)}") for k, t in items] + [(10 + k, prose(rng, 300, 1500)) for k in range(60)]
    found = decontamination.contaminated(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["overlap"]) for r in found.collect()} == {(k, k, 1.0) for k in range(6)}


def test_lcs_by_bits():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(decontamination.Item._masks(a), len(a), b)[-1] == t[-1][-1]


def labelled_corpus(spark):
    rng = random.Random(9)
    made = []
    for k in range(600):
        parts = [prose(rng, rng.randint(3, 12)) for _ in range(rng.randint(2, 8))]
        bad = k % 4 == 0
        if bad:
            parts[rng.randrange(len(parts))] += f" {rng.choice(['vile', 'nasty', 'rotten'])} {rng.choice(['vile', 'nasty'])}"
        junk = k % 5 == 0
        made.append((k, (" ### ".join if junk else ". ".join)(parts) + ".", int(bad), int(not junk)))
    table = spark.createDataFrame([(k, t) for k, t, *_ in made] + [(None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, t) for k, _, t, q in made] + [(9000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return made, table, labels


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 4 == 2


def test_toxicity_on_held_out_rows(spark, empty):
    made, table, labels = labelled_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(odd(table), odd(labels)).collect()}
    assert all(r["held_out"] == held(k) for k, r in got.items())
    rows = [(got[k], y, t) for k, t, y, _ in made if held(k)]
    assert np.mean([r["predicted"] == y for r, y, _ in rows]) > 0.97
    found = [r for r, y, _ in rows if y and r["predicted"]]
    assert all(re.search("vile|nasty|rotten", r["offence"]) for r in found) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[None]["predicted"] == 0 == got[9000]["predicted"]
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(table.repartition(7), labels).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-9 for k, r in got.items())
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(table, labels.filter("false")).count() == 602


def test_toxicity_of_clean_texts_of_any_length(spark):
    made, _, labels = labelled_corpus(spark)
    model = toxicity.fit(spark.createDataFrame([(k, t) for k, t, *_ in made], "doc_id long, text string"), labels)
    clean = [f"w{k % 97} w{k % 89} w{k % 83}" for k in range(50_000)]
    texts = [". ".join(clean), "\n".join(clean), ". ".join([*clean[:30_000], "vile nasty", *clean[30_000:]])]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r["predicted"], r["sentence"]) for r in got] == [(0, None), (0, None), (1, 30_000)]
    assert model.score(texts[0])[0] == model.score("w1 w2")[0] < 0.01
    weighed = toxicity.Model(-9.0, {"vile": 12.0, "mild": -2.0})
    assert weighed.score("w1. " * 50_000 + "mild.")[0] < 0.01 and weighed.score("w1. " * 50_000 + "vile.")[1] == 50_000


def test_toxicity_scores_against_a_row_loop(spark, docs):
    made, table, labels = labelled_corpus(spark)
    model = toxicity.fit(table, labels)
    assert {"vile", "nasty", "rotten"} <= model.words.keys()
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for r in toxicity.score(table.unionByName(docs.select("doc_id", "text")), model).collect():
        none, worst = 1 - sigmoid(model.bias), None
        for k, sentence in enumerate(re.split(r"[.!?\n]+", (r["text"] or "").lower())):
            held = {x for w in re.findall(r"[^\W\d_]+", sentence) for x in (w, *([w[:4] + "*"] if len(w) > 4 else []), *([w[:5] + "*"] if len(w) > 5 else []))}
            own = [model.words[x] for x in held if x in model.words]
            if own:
                p = sigmoid(model.bias + sum(own))
                none *= 1 - p
                worst = max(worst or (p, k), (p, k), key=lambda x: (x[0], -x[1]))
        assert abs(r["score"] - (1 - none)) < 1e-9 and r["predicted"] == int(1 - none >= 0.3)
        assert r["sentence"] == (worst[1] if r["predicted"] else None)


def test_quality_scores_against_a_row_loop(spark, docs):
    made, table, labels = labelled_corpus(spark)
    model = quality_model.fit(table, labels)
    for r in quality_model.classify(table.unionByName(docs.select("doc_id", "text")), model).collect():
        x = quality_model.features(r["text"] or "")
        bin_of = lambda edges, v: sum(e <= v for e in edges)
        z = model.base + sum(t[bin_of(model.edges[j], x[j])] for j, t in enumerate(model.tables))
        z += sum(t[bin_of(model.pair_edges[i], x[i]), bin_of(model.pair_edges[j], x[j])] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)


def test_ties_of_feature_cuts():
    x = np.array([[0.0, 1.0]] * 50 + [[2.0, 1.0]] * 50)
    model = quality_model.train(x, x[:, 0] / 2)
    assert (model.score(x) > 0.5).tolist() == [False] * 50 + [True] * 50


def test_quality_on_held_out_rows(spark, empty):
    made, table, labels = labelled_corpus(spark)
    got = {r["doc_id"]: r for r in quality_model.quality(odd(table), labels).collect()}
    assert np.mean([got[k]["predicted"] == q for k, _, _, q in made if held(k)]) > 0.97
    assert all(r["held_out"] == held(k) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert quality_model.quality(empty, labels).count() == 0 and quality_model.quality(table, labels.filter("false")).count() == 602


def test_pairwise_tables_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert np.mean((quality_model.train(x, y).score(x) > 0.5) == y) > 0.9


@pytest.mark.parametrize("most,size,keep", [(1 << 22, 32 << 20, "none"), (-1, -1, "none"), (1 << 22, -1, "first"), (-1, 32 << 20, "first")])
def test_line_dedup(docs, empty, monkeypatch, most, size, keep):
    monkeypatch.setattr(line_dedup, "MAX_HASHES", most)
    monkeypatch.setattr(line_dedup, "MAX_BYTES", size)
    data = corpus()
    keys = lambda t: [lower(x.strip(" \t\n\r\x0b\x0c")) for x in (t or "").split("\n")]
    count = Counter(k for _, t, *_ in data for k in set(keys(t)) if k)
    first = {}
    for i, t, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, k in enumerate(keys(t)):
            first.setdefault(k, (i, n))
    want = Counter()
    for i, t, *_ in data:
        left = [x for n, (x, k) in enumerate(zip((t or "").split("\n"), keys(t), strict=True)) if count[k] < 10 or keep == "first" and first[k] == (i, n)]
        want[i, "\n".join(left), len(keys(t)), len(keys(t)) - len(left)] += 1
    got = line_dedup.dedup_lines(odd(docs), keep=keep).select("doc_id", "text", "n_lines", "n_dropped").collect()
    if keep == "none":
        assert Counter(map(tuple, got)) == want
    else:  # rows that share a doc_id may each hold its first line
        assert sum(r["n_dropped"] for r in got) == sum(k[3] * n for k, n in want.items())
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.load(MODEL)


@pytest.mark.parametrize("frequent", [pieces.FREQUENT, 20])
def test_pieces_equal_the_reference_encoder(docs, empty, model, frequent):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    extra = ["日本語 text", "é é ½ 🙂", " lead  and\ttabs \n", "▁sep", "<s> </s>", "x" * 130 + " " * 80, "日本語" * 40, "🙂" * 100, "\x00a"]
    table = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate([t for _, t, *_ in corpus()] + extra)], "doc_id long, text string")
    got = pieces.decode(pieces.encode(odd(table), model, frequent), model).select("text", "ids", "decoded").collect()
    for r in got:
        text = r["text"] or ""
        assert list(r["ids"]) == sp.encode(text), text[:80]
        assert r["decoded"] == text.replace("▁", " ")
    assert len(got) == table.count() and pieces.encode(empty, model).count() == 0


def test_units_of_a_hundred_thousand_letters(spark, model):
    import sentencepiece

    rng = random.Random(16)
    texts = ["a" * 100_000, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert all(list(r["ids"]) == sp.encode(r["text"]) for r in got)


def test_rows_are_coded_once(docs, model):
    plan = pieces.round_trip(docs, model)
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in plan.collect())
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_frequent_units_are_dealt_before_their_lattices(spark, docs, model, monkeypatch):
    seen, made = [], pieces.encode_units
    monkeypatch.setattr(pieces, "SHARE", 1)
    monkeypatch.setattr(pieces, "encode_units", lambda units, *more: seen.append(units) or made(units, *more))
    assert len(pieces._frequent(docs, model, 400)) == 400
    assert seen[0].rdd.getNumPartitions() == 4 and max(map(len, seen[0].rdd.glom().collect())) < 200


def test_viterbi_of_a_unigram_model(spark):
    rng = random.Random(7)
    table = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("c", -2.2), ("▁a", -3.1), ("ab", -2.9), ("bc", -3.3), ("abc", -4.4), ("ca", -2.7), ("▁ab", -4.0)]
    model = pieces.Model([(p, i + 1, s) for i, (p, s) in enumerate(table)], None, 0, "unigram")
    score = dict(table)
    texts = ["".join(rng.choice("abcz ") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    coded = pieces.encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model)
    cost = lambda ids: sum(score[table[i - 1][0]] if i else min(score.values()) - 10.0 for i in ids)
    for r in coded.collect():
        t = "▁" + r["text"].replace(" ", "▁")
        best = [0.0] + [-1e18] * len(t)
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - 3), j):
                s = score.get(t[i:j], min(score.values()) - 10.0 if j - i == 1 else None)
                best[j] = max(best[j], best[i] + s) if s is not None else best[j]
        assert abs(cost(r["ids"]) - best[-1]) < 1e-9, t


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_unigram_edges_of_short_units_stay_in_place(spark, model):
    rng = random.Random(17)
    units = sorted({"▁" + "".join(rng.choice("etaoinshré日🙂") for _ in range(rng.randint(1, 20))) for _ in range(500)})
    uni, table = pieces.as_unigram(model), spark.createDataFrame([(u,) for u in units], "unit string")
    before = shuffled(spark)
    got = {r["unit"]: list(r["ids"]) for r in pieces.encode_units(table.repartition(3, "unit"), uni).collect()}
    assert shuffled(spark) - before <= 2 * len(units)
    assert got == {r["unit"]: list(r["ids"]) for r in pieces._general(table, uni).collect()}
    long = spark.createDataFrame([("▁" + "ab日" * 40,), ("▁ab",)], "unit string")
    assert {r["unit"]: list(r["ids"]) for r in pieces.encode_units(long, uni).collect()} == {r["unit"]: list(r["ids"]) for r in pieces._general(long, uni).collect()}


def test_sharding(docs, empty):
    data = corpus()
    got = sharding.shard_documents(odd(docs)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data)
    load, of = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        of.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for k, s in of.items() if k != (8, 0)) and set(load) <= set(range(24))
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    rng = random.Random(19)
    many = docs.sparkSession.createDataFrame([(i, prose(rng, rng.randint(5, 60))) for i in range(1500)], "doc_id long, text string")
    sizes = sharding.shard_documents(many).groupBy("shard").sum("size").collect()
    assert len(sizes) == 24 and max(r[1] for r in sizes) - min(r[1] for r in sizes) <= 60 * 5
    assert sharding.shard_documents(empty).count() == 0


def test_longest_first_is_near_equal():
    rng = random.Random(1)
    sizes = [(str(i), rng.randint(1, 1000)) for i in range(5000)]
    load, at = Counter(), sharding.longest_first(sizes, 24)
    for name, size in sizes:
        load[at[name]] += size
    assert max(load.values()) - min(load.values()) <= 1000
