"""License scans: a positional index of rare words.

Each file keeps the positions of the telling words of licence texts. Document frequencies over the whole corpus rank a
template's words, rarest first. A template that must stand whole is found by shifting the postings of its words by their
places in it and intersecting them in that order. One that may differ in places is looked up under its rarest words: of
a match with at most m words missing, one of the m + 1 rarest is always in place, so the postings of these give all
starts that can match; each start is held against the postings of all words. A label counts only if the template's
mandatory phrases stand in the file too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialise, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The share of a clause's telling words that must stand in place.
SHARE = Fraction(4, 5)
#: Words that tell nothing; in a clause they may be any word. Phrases are taken whole.
STOP = frozenset("a above all an and any are as at be by for from has have in into is it may must no not of on or out shall that the their this to under use was which with you your".split())


@dataclass(frozen=True)
class Template:
    """A licence's text, phrases that a file must hold as well, and the share of telling words that must be in place."""

    label: str
    phrase: str
    must: tuple[str, ...] = ()
    share: Fraction = Fraction(1)

    @property
    def words(self) -> tuple[tuple[int, str], ...]:
        """Places and words that are looked up."""
        return tuple((i, w) for i, w in enumerate(self.phrase.split()) if self.share == 1 or w not in STOP)

    @property
    def least(self) -> int:
        return math.ceil(self.share * len(self.words))


def _clause(label: str, text: str, *must: str) -> Template:
    return Template(label, text, must, SHARE)


#: The base phrases and their labels.
BASE = (Template("mit", "mit license"), Template("apache", "apache license"), Template("gpl", "general public license"))
#: Further labels of this operator: phrases that name a licence.
NAMES = (
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-3.0", "general public license version 3", ("gnu",)),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("cc-by", "cc by"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nc-4.0", "cc by nc 4 0", ("licensed under",)),
    Template("cc-by-sa", "cc by sa"),
    Template("creative-commons", "creative commons"),
    Template("proprietary", "all rights reserved"),
)
#: Clauses of public licence texts, with the phrases that tell one from its kin.
CLAUSES = (
    _clause("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "above copyright notice", "without warranty of any kind"),
    _clause("bsd-2-text", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "binary form must reproduce"),
    _clause("bsd-3-text", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "source code must retain", "binary form must reproduce"),
    _clause("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license version 2 0"),
    _clause("gpl-2-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license", "version 2 of the license"),
    _clause("gpl-3-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license", "version 3 of the license"),
    _clause("lgpl-text", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    _clause("agpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    _clause("mpl-2.0-text", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    _clause("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee"),
    _clause("cc-by-text", "you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon the material for any purpose even commercially", "attribution"),
    _clause("cc0-text", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "public domain"),
    _clause("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "public domain"),
)
OWN = (*NAMES, *CLAUSES)


def sought(templates: tuple[Template, ...]) -> list[Template]:
    """All that is looked up, once each: templates, and mandatory phrases as templates that must stand whole."""
    found = {(t.phrase, t.share): t for t in templates}
    for t in templates:
        for p in t.must:
            found.setdefault((p, Fraction(1)), Template("", p))
    return [found[k] for k in sorted(found)]


def _vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in sought(templates) for _, w in t.words})


def postings(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, n_words and, for each telling word that a file holds, its ascending positions."""
    vocabulary = _vocabulary(templates)
    words = F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), F.lit(0))
    marked = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(w.alias("w"), i.alias("p")))), lambda x: x.isNotNull())

    def of_word(hits: Column) -> Column:
        at = lambda w: F.transform(F.filter(hits, lambda x: x["w"] == w), lambda x: x["p"].cast("long"))
        return F.transform(F.array_distinct(F.transform(hits, lambda x: x["w"])), lambda w: F.struct(w.alias("w"), at(w).alias("at")))

    return (
        docs.select("doc_id", words.alias("words"))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), marked.alias("hits"))
        .select("doc_id", "n_words", let(F.col("hits"), of_word).alias("postings"))
    )


def rarity(index: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each telling word over all files; one number for each word of the templates."""
    held = index.select(F.explode("postings").alias("x")).groupBy(F.col("x.w").alias("w")).count()
    found = {r["w"]: r["count"] for r in held.collect()}
    n = index.count()
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) for w in vocabulary}


def _matches(t: Template, idf: dict[str, float]) -> Column:
    """Starts of the template and how many of its words stand in place there: array<struct<s, n>>."""
    ranked = sorted(t.words, key=lambda x: (-idf[x[1]], x[0]))
    shifted = lambda i, w: F.transform(F.col(f"at_{w}"), lambda p: p - F.lit(i))
    spare = len(t.words) - t.least
    none = F.lit([]).cast("array<struct<s:bigint,n:int>>")
    if not spare:
        at = shifted(*ranked[0])
        for i, w in ranked[1:]:
            at = F.array_intersect(at, shifted(i, w))
        found = F.transform(at, lambda s: F.struct(s.alias("s"), F.lit(len(t.words)).alias("n")))
        return F.when(F.size(f"at_{ranked[0][1]}") == 0, none).otherwise(found)
    starts = F.array_distinct(F.concat(*[shifted(i, w) for i, w in ranked[: spare + 1]]))
    held = lambda s: sum((F.array_contains(F.col(f"at_{w}"), s + F.lit(i)).cast("int") for i, w in t.words), F.lit(0))
    counted = F.transform(starts, lambda s: F.struct(s.alias("s"), held(s).alias("n")))
    some = F.greatest(*[F.size(f"at_{w}") for _, w in ranked[: spare + 1]], F.lit(0)) > 0
    return F.when(some, F.filter(counted, lambda x: x["n"] >= t.least)).otherwise(none)


def scan_licenses(docs: DataFrame, base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN) -> DataFrame:
    """Return doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row.

    ``score`` is the largest k / (n + 1) over the templates whose labels were found: k of the n words that are looked up
    stand in place; 0 if none was found. A clause may begin before a file's first word. Null and empty texts have no
    words, no places and empty labels. Repeated rows each get a row; an empty table gives an empty result; only doc_id
    and text are read.
    """
    templates = (*base, *own)
    vocabulary, looked_for = _vocabulary(templates), sought(templates)
    index = materialise(postings(docs, templates))
    idf = rarity(index, vocabulary)
    none = F.lit([]).cast("array<bigint>")
    of_word = lambda w: F.get(F.filter("postings", lambda x: x["w"] == w), F.lit(0))["at"]
    looked_up = {f"at_{w}": F.coalesce(of_word(w), none) for w in vocabulary}
    found = index.select("doc_id", "n_words", "postings").withColumns(looked_up)
    found = found.select("doc_id", "n_words", *[_matches(t, idf).alias(f"m{i}") for i, t in enumerate(looked_for)])
    names = {(t.phrase, t.share): f"m{i}" for i, t in enumerate(looked_for)}
    col = lambda p, share=Fraction(1): F.col(names[p, share])
    held = {}
    for t in templates:
        held[t] = F.size(col(t.phrase, t.share)) > 0
        for p in t.must:
            held[t] = held[t] & (F.size(col(p)) > 0)
    places = F.transform(F.concat(*[col(t.phrase) for t in base]), lambda x: x["s"])
    named = lambda ts: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(held[t], F.lit(t.label)) for t in ts])))), ",")
    share = lambda t: F.array_max(F.transform(col(t.phrase, t.share), lambda x: x["n"])) / F.lit(len(t.words) + 1)
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        named(base).alias("base_labels"), named(templates).alias("labels"),
        F.greatest(F.lit(0.0), *[F.when(held[t], share(t)) for t in templates]).alias("score"),
    )
