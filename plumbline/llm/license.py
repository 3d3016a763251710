"""Licence scans by a positional rare-token index (Spark expressions only).

The text is tokenised once. A document goes on if, for some template, enough of its words occur at all. For those documents
the corpus-wide document frequency of the licence words tells which words of a template are the rarest (highest IDF). The
positions of all these anchors are collected once for each document; they give candidate places, the other words are looked up
at their relative positions, and a template counts where enough of them agree and its mandatory key phrase stands at its own
place in the aligned template.

Defined cases: null texts are empty; no words: zero counts, null places, empty labels, score 0; equal frequencies: the word
that comes first in the template is the anchor; repeated rows and null ids are kept; an empty table gives an empty result;
other columns are ignored. Phrases are given in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import materialize

# The next three tables are fixed values.
#: A word of lower-cased text: everything but ASCII other than digits and a-z (as a positive class, which is matched much faster).
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"

BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, wording, mandatory key phrase
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3", "public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
]

#: Share of a long template's words that must stand at their relative positions.
AGREE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool
    agree: float


def templates(base: dict[str, str] = BASE_PHRASES, more: list = TEMPLATES, agree: float = AGREE) -> list[Template]:
    exact = [Template(label, tuple(p.split()), tuple(p.split()), True, 1.0) for p, label in base.items()]
    return exact + [Template(label, tuple(p.split()), tuple(k.split()), False, 1.0 if len(p.split()) < 8 else agree) for label, p, k in more]


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _possible(present: Column, t: Template) -> Column:
    """All words of the key phrase, and enough of the template's, occur somewhere."""
    own = list(dict.fromkeys(t.words))
    missing = _may_miss(t)
    key = list(dict.fromkeys(t.key))
    return (F.size(F.array_intersect(present, _strings(own))) >= len(own) - missing) & (F.size(F.array_intersect(present, _strings(key))) == len(key))


def index(docs: DataFrame, found: list[Template]) -> DataFrame:
    """doc_id, n_words, present (licence words that occur) and, for documents in which a template is possible, all words.

    Lower-casing knows one character beyond A-Z that becomes an ASCII letter, the Kelvin sign; it is replaced beforehand.
    """
    vocabulary = sorted({w for t in found for w in t.words})
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("ĸ")))
    split = docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    known = split.select("doc_id", "words", F.array_intersect("words", _strings(vocabulary)).alias("present"))
    possible = F.lit(False)
    for t in found:
        possible = possible | _possible(F.col("present"), t)
    return known.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(possible, F.col("words")).alias("words"))


def _may_miss(t: Template) -> int:
    return int(len(t.words) * (1 - t.agree) + 1e-9)


def anchors(indexed: DataFrame, found: list[Template]) -> list[list[int]]:
    """Places of the rarest words in each template, by document frequency over the corpus: one more than may be missing, so
    that every place where enough words agree has an anchor."""
    frequency = {r[0]: r[1] for r in indexed.select(F.explode("present").alias("w")).groupBy("w").count().collect()}  # licence words only
    return [sorted(range(len(t.words)), key=lambda i, t=t: (frequency.get(t.words[i], 0), i))[: _may_miss(t) + 1] for t in found]


def _postings(words: Column, anchor_words: list[str]) -> Column:
    """The document's positional index of the anchors: array of (w, i), by position."""
    listed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.filter(listed, lambda x: x["w"].isin(anchor_words))


def _places(words: Column, postings: Column, t: Template, places: list[int]) -> Column:
    """Starts at which the template aligns, key phrase included, with their agreement: array of (start, agree)."""
    n = len(t.words)
    key_at = next(o for o in range(n) if t.words[o : o + len(t.key)] == t.key)

    def starts(k: int) -> Column:
        return F.transform(F.filter(postings, lambda x: x["w"] == t.words[k]), lambda x: x["i"] - k)

    posting = F.filter(F.array_distinct(F.concat(*[starts(k) for k in places])), lambda s: s > -n)
    agree = lambda s: F.aggregate(F.transform(_strings(t.words), lambda w, j: F.when(F.get(words, s + j) == w, F.lit(1)).otherwise(F.lit(0))), F.lit(0), lambda a, x: a + x)
    scored = F.transform(posting, lambda s: F.struct(s.cast("long").alias("start"), (agree(s) / n).alias("agree")))
    keyed = lambda x: (x["start"] + key_at >= 0) & (F.slice(words, F.greatest(x["start"] + key_at + 1, F.lit(1)).cast("int"), F.lit(len(t.key))) == _strings(t.key))
    return F.filter(scored, lambda x: (x["agree"] >= t.agree - 1e-9) & (x["start"] >= 0 if t.base else keyed(x)))


def scan(docs: DataFrame, found: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = found or templates()
    indexed = materialize(index(docs, found))
    rare = anchors(indexed, found)
    empty = F.array().cast("array<struct<start:long,agree:double>>")
    anchor_words = sorted({t.words[i] for t, own in zip(found, rare, strict=True) for i in own})
    rows = indexed.withColumn("postings", _postings(F.col("words"), anchor_words))
    for k, (t, own) in enumerate(zip(found, rare, strict=True)):
        places = _places(F.col("words"), F.col("postings"), t, own)
        rows = rows.withColumn(f"p{k}", F.when(F.col("words").isNotNull() & _possible(F.col("present"), t), places).otherwise(empty))
    hit, base_hit = [], []
    for k, t in enumerate(found):
        ok = F.size(f"p{k}") > 0
        hit.append((t, ok, F.array_max(F.transform(f"p{k}", lambda x: x["agree"]))))
        if t.base:
            base_hit.append((t, k))
    starts = F.flatten(F.array(*[F.transform(f"p{k}", lambda x: x["start"]) for _, k in base_hit]))
    join = lambda pairs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*pairs)))), ",")
    base_labels = join([F.when(F.size(f"p{k}") > 0, F.lit(t.label)) for t, k in base_hit])
    labels = join([F.when(ok, F.lit(t.label)) for t, ok, _ in hit])
    score = F.coalesce(F.greatest(*[F.when(ok, best) for _, ok, best in hit], F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("starts", starts)
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        base_labels.alias("base_labels"), labels.alias("labels"), score.cast("double").alias("score"),
    )
