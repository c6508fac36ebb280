"""License scan by a positional index of rare words, in DataFrame functions alone.

The templates' words get their inverse document frequencies from all documents. Each template posts its
rarest key words with their places in the template. A file looks up the posted words among its own; each hit, less
the posted place, is a start that this posting allows. The starts of a template's postings are intersected, and only
where all agree are the template's mandatory key words compared by position. All of it happens within a row, so no key
can become hot; the one shuffle carries document counts of the templates' words.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned alike; a
file that is not text in any of the licences' languages simply has no hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolith.llm.common import ascii_lower, free_names

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Key words that a template posts: those with the largest inverse document frequencies.
POSTED = 2


@dataclass(frozen=True)
class Template:
    """A licence line; the words from `key` on, `size` of them, must all be there."""

    label: str
    words: tuple[str, ...]
    key: int
    size: int

    @property
    def key_words(self) -> tuple[str, ...]:
        return self.words[self.key : self.key + self.size]


def template(label: str, line: str, key: str) -> Template:
    words, own = tuple(line.split()), tuple(key.split())
    at = next(k for k in range(len(words)) if words[k : k + len(own)] == own)
    return Template(label, words, at, len(own))


# The base phrases, then lines of well-known licences with their mandatory words.
BASE = (
    template("cc-by", "cc by", "cc by"),
    template("gpl", "general public license", "general public license"),
    template("reserved", "all rights reserved", "all rights reserved"),
)
LINES = (
    template("agpl-3.0", "gnu affero general public license version 3", "affero general public license version 3"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words_of(text):
    """The words of a text, in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def inverse_frequencies(words: DataFrame, templates) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) + 1 of each template word; `words` has one array column w."""
    known = sorted({w for t in templates for w in t.words})
    present = F.array_append(F.array_intersect("w", F.array(*map(F.lit, known))), "")
    rows = words.select(F.explode(present).alias("word")).groupBy("word").count().collect()  # as many rows as template words
    counts = {r["word"]: r["count"] for r in rows}
    n = counts.get("", 0)
    return {w: log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in known}


def scan_licenses(docs: DataFrame, text: str = "text", base=BASE, lines=LINES) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, score and `places` (label, first word).

    Columns of these names are replaced. A score is the largest share, by inverse document frequency, of a
    found template's words that stand at their places.
    """
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    templates = [*base, *lines]
    idf = inverse_frequencies(docs.select(words_of(F.col(f"`{text}`")).alias("w")), templates)
    posted = [sorted(range(t.key, t.key + t.size), key=lambda k, t=t: (-idf[t.words[k]], k))[:POSTED] for t in templates]
    rare = sorted({t.words[k] for t, ks in zip(templates, posted, strict=True) for k in ks})

    w_, hits, base_, more = free_names(docs.columns, "__w", "__hits", "__base", "__more")
    own = docs.select(*rest, words_of(F.col(f"`{text}`")).alias(w_))
    w = F.col(w_)
    hit = F.transform(w, lambda x, i: F.when(x.isin(rare), F.struct(x.alias("word"), i.alias("at"))))
    own = own.withColumn(hits, F.when(F.arrays_overlap(w, F.array(*map(F.lit, rare))), F.array_compact(hit)))

    def places(t: Template, ks: list[int]):
        """Starts, and shares, of the template where its key words stand."""
        word = lambda s, k: F.get(w, s + k) == F.lit(t.words[k])
        allowed = lambda k: F.transform(F.filter(hits, lambda h: h["word"] == t.words[k]), lambda h: h["at"] - k)
        starts = reduce(F.array_intersect, map(allowed, ks))
        others = [k for k in range(t.key, t.key + t.size) if k not in ks]
        if others:
            starts = F.filter(starts, lambda s: F.coalesce(reduce(and_, (word(s, k) for k in others)), F.lit(False)))
        total = sum(idf[x] for x in t.words)
        share = lambda s: sum((F.when(word(s, k), idf[x]).otherwise(0.0) for k, x in enumerate(t.words)), F.lit(0.0)) / total
        return F.transform(starts, lambda s: F.struct(F.lit(t.label).alias("label"), (s + t.key).cast("long").alias("word"), (F.lit(1.0) if t.size == len(t.words) else share(s)).alias("share")))

    none = F.expr("CAST(array() AS array<struct<label:string,word:bigint,share:double>>)")
    found = lambda some, posts: F.when(F.col(hits).isNull(), none).otherwise(F.concat(*(places(t, ks) for t, ks in zip(some, posts, strict=True))))
    own = own.withColumn(base_, found(base, posted[: len(base)])).withColumn(more, found(lines, posted[len(base) :]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    everything = F.concat(base_, more)
    return own.select(
        *rest, F.size(w).cast("long").alias("n_words"), F.size(base_).cast("long").alias("n_base"),
        F.array_min(F.transform(base_, lambda p: p["word"])).alias("first_word"), F.array_max(F.transform(base_, lambda p: p["word"])).alias("last_word"),
        names(F.col(base_)).alias("base_labels"), names(everything).alias("labels"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(everything, lambda p: p["share"])), F.lit(0.0))), 6).alias("score"),
        F.transform(everything, lambda p: F.struct(p["label"].alias("label"), p["word"].alias("word"))).alias("places"),
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Places of the base phrases, and all labels, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "places")


def sql() -> str:
    """The same rows in DuckDB: every place of every template is compared, without an index."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = [*BASE, *LINES]
    cols, names, scores = [], [], []
    for n, t in enumerate(templates):
        cols.append(f"list_filter(range(0, greatest(0, len(w) - {t.size - 1})), lambda i: w[i + 1:i + {t.size}] = {q(t.key_words)}) AS p{n}")
        names.append(f"CASE WHEN len(p{n}) > 0 THEN ['{t.label}'] ELSE [] END")
        terms = " + ".join(f"(CASE WHEN i + {k - t.key + 1} >= 1 AND w[i + {k - t.key + 1}] = '{x}' THEN idf['{x}'] ELSE 0.0 END)" for k, x in enumerate(t.words))
        total = " + ".join(f"idf['{x}']" for x in t.words)
        scores.append(f"CASE WHEN len(p{n}) > 0 THEN 1.0 END" if t.size == len(t.words) else f"list_max(list_transform(p{n}, lambda i: ({terms}) / ({total})))")
    known = sorted({x for t in templates for x in t.words})
    some = lambda ns: "list_sort(list_distinct(list_concat(" + ", ".join(ns) + ")))"
    base = "list_concat(p0, p1, p2)"
    return f"""
WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT x.word, count(d.word) AS n FROM (SELECT unnest({q(known)}) AS word) x LEFT JOIN (SELECT unnest(list_distinct(w)) AS word FROM a) d ON d.word = x.word GROUP BY x.word),
g AS (SELECT map_from_entries(list((word, ln((1 + (SELECT count(*) FROM a)) / (1 + n)) + 1))) AS idf FROM f),
p AS (SELECT doc_id, w, {", ".join(cols)} FROM a)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({base}) AS BIGINT) AS n_base,
  list_min({base}) AS first_word, list_max({base}) AS last_word,
  array_to_string({some(names[:3])}, ',') AS base_labels, array_to_string({some(names)}, ',') AS labels,
  round(least(1.0, coalesce(greatest({", ".join(scores)}), 0.0)), 6) AS score
FROM p, g"""
