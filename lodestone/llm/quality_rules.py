"""Quality rules: a ledger with one failure bit for each rule, to which versioned policies are applied later.

Every rule is evaluated once for each document. The ledger keeps the measurements and the bitmask, so a new policy
or an ablation reads the ledger and never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, text_of, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """One rule: its bit in the ledger and the condition under which a document fails it."""

    name: str
    bit: int
    fails: str


#: Conditions over the measurements, in integers only.
RULES = (
    Rule("too_few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", 2, "2 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "10 * word_chars < 15 * n_words"),
    Rule("long_words", 5, "word_chars > 25 * n_words"),
    Rule("shouting", 6, "4 * n_upper > 3 * word_chars"),
)
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = (
    Policy("base", 1, BASE),
    Policy("default", 1, (*BASE, "many_symbols", "repeated_lines")),
    Policy("default", 2, tuple(r.name for r in RULES)),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in a text.

    Windows whose 64-bit hash stands alone are left out first; the others are sorted and compared by their words.
    """

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column, key: str) -> Column:
        """Places whose key stands beside them too; ``s`` is sorted by key."""
        same = lambda x, i: (F.get(s, i - 1)[key] == x[key]) | (F.get(s, i + 1)[key] == x[key])
        return F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])

    def count(h: Column) -> Column:
        hashed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        spelled = lambda at: F.sort_array(F.transform(at, lambda p: F.struct(F.slice(words, p + 1, WINDOW).alias("w"), p.alias("p"))))
        places = let(let(let(hashed, lambda s: repeated(s, "h")), spelled), lambda s: F.sort_array(repeated(s, "w")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, count)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """Measure each document once: doc_id, the measurements, and ``failed``, the bitmask of the rules it fails.

    Null and empty texts have no words and fail ``too_few_words``. Repeated rows each get a row; an empty table
    gives an empty ledger; columns other than doc_id and text are not read.
    """
    lines = F.filter(F.split(F.col("body"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = (
        docs.select("doc_id", text_of().alias("body"))
        .withColumns({"words": words_of(F.col("body")), "lines": lines})
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("words")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.regexp_count("body", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        )
    )
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def apply_policy(kept: DataFrame, policy: Policy) -> DataFrame:
    """Add base_failed and kept, from the bits alone."""
    base = next(p for p in POLICIES if p.name == "base").mask
    fails = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return kept.withColumns({"base_failed": fails(base), "kept": ~fails(base | policy.mask)})


def ablations(kept: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each rule of it: documents that fail the rule, and those that only this rule rejects."""
    sums, names = [], []
    for p in policies:
        for r in (r for r in RULES if r.name in p.rules):
            own = F.col("failed").bitwiseAND(F.lit(p.mask))
            names.append((p.name, p.version, r.name))
            sums += [
                F.sum((own.bitwiseAND(F.lit(1 << r.bit)) != 0).cast("long")).alias(f"f{len(names)}"),
                F.sum((own == (1 << r.bit)).cast("long")).alias(f"o{len(names)}"),
            ]
    row = kept.agg(*sums)
    parts = [
        F.struct(F.lit(a).alias("policy"), F.lit(b).alias("version"), F.lit(c).alias("rule"), F.coalesce(f"f{i}", F.lit(0)).alias("failed"), F.coalesce(f"o{i}", F.lit(0)).alias("only_this"))
        for i, (a, b, c) in enumerate(names, 1)
    ]
    return row.select(F.inline(F.array(*parts)))


def quality_rules(docs: DataFrame, policy: Policy = POLICIES[1]) -> DataFrame:
    """Write the ledger of ``docs`` once and apply ``policy`` to it.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept, then n_lines, n_upper
    and failed. Null and empty texts have no words and aren't kept; repeated rows each get a row; an empty table gives an
    empty result; only doc_id and text are read.
    """
    applied = apply_policy(materialise(ledger(docs)), policy)
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return applied.select(*first, *[c for c in applied.columns if c not in first])
