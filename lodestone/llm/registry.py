"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, line_dedup, pieces, quality_model, quality_rules, sharding, simhash, substring_dedup, toxicity
from .common import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies over one ledger: what each rule rejects, and what it alone rejects."""
    return quality_rules.ablations(materialise(quality_rules.ledger(table(spark, sf_dir, "documents"))))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "sentence", "offence")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


#: A public byte-pair model; the setting names any other SentencePiece model file.
MODEL_PATH, MODEL_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.lodestone.sentencepiece.model"


def model_path(spark: SparkSession) -> str:
    return spark.conf.get(MODEL_SETTING, MODEL_PATH)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load(model_path(spark)))


def sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public pieces as a unigram model, so that every lattice goes through the Viterbi fold."""
    model = pieces.as_unigram(pieces.load(model_path(spark)))
    return pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_quality_model": op10_quality_model,
    "quality_ablations": quality_ablations,
    "sentencepiece_unigram": sentencepiece_unigram,
}


def _license_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    base, every = license_scan.BASE, (*license_scan.BASE, *license_scan.OWN)
    at = {(t.phrase, t.share): k for k, t in enumerate(license_scan.sought(every))}
    values = ", ".join(f"({k}, {i}, '{w}', {t.least})" for k, t in enumerate(license_scan.sought(every)) for i, w in t.words)
    held = lambda t: " AND ".join(f"coalesce(m[{at[key]}], 0) > 0" for key in ((t.phrase, t.share), *[(p, license_scan.Fraction(1)) for p in t.must]))
    named = lambda ts: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {held(t)} THEN '{t.label}' END" for t in ts) + "], lambda x: x IS NOT NULL))), ',')"
    score = "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN {held(t)} THEN m[{at[t.phrase, t.share]}]::DOUBLE / {len(t.words) + 1} ELSE 0.0 END" for t in every) + ")"
    bases = ", ".join(str(at[t.phrase, t.share]) for t in base)
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{license_scan.WORD}') AS w FROM documents),
tokens AS (SELECT r, i - 1 AS i, w[i] AS x FROM words, unnest(range(1, len(w) + 1)) AS u(i)),
sought(k, j, x, least) AS (VALUES {values}),
places AS (SELECT r, k, i - j AS s, count(*) AS n FROM tokens JOIN sought USING (x) GROUP BY r, k, s, least HAVING count(*) >= least),
best AS (SELECT r, k, max(n) AS n, count(*) AS c, min(s) AS a, max(s) AS z FROM places GROUP BY r, k),
found AS (
  SELECT r, map(list(k), list(n)) AS m, sum(c) FILTER (k IN ({bases})) AS c,
    min(a) FILTER (k IN ({bases})) AS a, max(z) FILTER (k IN ({bases})) AS z FROM best GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce({named(base)}, '') AS base_labels, coalesce({named(every)}, '') AS labels, {score} AS score
FROM words LEFT JOIN found USING (r)"""


def _measured_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)
    n = quality_rules.WINDOW
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (SELECT r, i, list_slice(w, i + 1, i + {n}) AS k FROM words, unnest(range(len(w) - {n - 1})) AS u(i)),
twice AS (SELECT r, i FROM windows WHERE len(k) = {n} QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (SELECT r, sum(least({n}, coalesce(nxt - i, {n}))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(regexp_extract_all(body, '[A-Z]'))::BIGINT AS n_upper
  FROM words LEFT JOIN covered USING (r)),
marked AS (SELECT *, ({bits})::BIGINT AS failed FROM measured)"""


def _quality_sql() -> str:
    base, policy = quality_rules.POLICIES[0].mask, quality_rules.POLICIES[1].mask
    return f"{_measured_sql()}\nSELECT *, failed & {base} <> 0 AS base_failed, failed & {base | policy} = 0 AS kept FROM marked"


def _ablations_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{p.name}' AS policy, {p.version}::INT AS version, '{r.name}' AS rule, count(*) FILTER (failed & {1 << r.bit} <> 0) AS failed, "
        f"count(*) FILTER (failed & {p.mask} = {1 << r.bit}) AS only_this FROM marked"
        for p in quality_rules.POLICIES for r in quality_rules.RULES if r.name in p.rules
    )
    return f"{_measured_sql()}\n{rows}"


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT r, i, l[i] AS line,
    translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM docs, unnest(range(1, len(l) + 1)) AS u(i)),
gone AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM lines WHERE k NOT IN (SELECT k FROM gone) GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""

ORACLE_SQL = {
    "op1_license_scan": _license_sql(),
    "op4_quality_rules": _quality_sql(),
    "quality_ablations": _ablations_sql(),
    "op7_line_dedup": LINES_SQL,
}
