"""License scans by a positional rare-token index, in DataFrame functions only.

Every template is a posting list: for each of its words, the places where it stands. The corpus
says how rare each licence word is. A file looks up the rarest licence words that it shares with a
template; each meeting of a word in the file and in the template votes for the distance between
the two places, and the best distance tells how much of the template stands in one piece. The
label is given when that share is large enough and the template's key phrases are in the file.

Defined cases: a null text is an empty one; every row is scanned by itself, so copies and repeated
ids change nothing but the word counts; a text without licence words has no label and score 0.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed phrases that are always reported, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Fixed wording of public licence notices: label, notice, phrases without which it does not count.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files",
     ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license",
     ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("unencumbered software",)),
)
RARE_WORDS = 8
LEAST_SHARE = 0.6

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = "(?<![^ ])(?:" + "|".join(PHRASES) + ")(?![^ ])"


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalized(docs: DataFrame) -> DataFrame:
    """(doc_id, line): the words of every whole text, lower-cased (A-Z), one blank apart."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")),
                        string.ascii_uppercase, string.ascii_lowercase)
    return docs.select("doc_id", F.trim(F.regexp_replace(lower, _BETWEEN, " ")).alias("line"))


def word_rarity(lines: DataFrame, words: list[str]) -> dict[str, int]:
    """Documents that hold each licence word; one row per word reaches the driver."""
    held = F.array_intersect(F.split("line", " "), _strings(words))
    rows = lines.select(F.explode(held).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _has_phrase(phrase: str) -> Column:
    return F.contains(F.concat(F.lit(" "), F.col("line"), F.lit(" ")), F.lit(f" {phrase} "))


def _share(notice: str, rarest: list[str]) -> Column:
    """Largest part of the looked-up postings that agree on one distance."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(notice.split()):
        at.setdefault(w, []).append(i)
    postings = F.create_map(*[x for w in at for x in (
        F.lit(w), F.array(*[F.lit(i) for i in at[w]]))])
    mine = _strings([w for w in rarest if w in at])
    looked = F.slice(F.array_intersect(mine, F.col("_held")), 1, RARE_WORDS)
    met = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                   lambda e: F.array_contains(looked, e["w"]))
    apart = F.array_sort(F.flatten(F.transform(met, lambda e: F.transform(
        F.element_at(postings, e["w"]), lambda q: e["i"] - q))))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"),
                     F.lit(0).alias("best"))

    def step(a, d):
        run = F.when(a["last"] == d, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(d.alias("last"), run.alias("run"),
                        F.greatest(a["best"], run).alias("best"))

    best = F.aggregate(apart, start, step, lambda a: a["best"])
    size = F.aggregate(looked, F.lit(0), lambda n, w: n + F.size(F.element_at(postings, w)))
    return F.when(size > 0, best / size).otherwise(F.lit(0.0))


def scan(docs: DataFrame, templates=TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    words = vocabulary(templates)
    lines = normalized(docs)
    seen = word_rarity(lines, words)
    rarest = sorted(words, key=lambda w: (seen.get(w, 0), w))
    rows = lines.withColumn("_words", F.when(F.col("line") != "", F.split("line", " ")))
    rows = rows.withColumn("_held", F.array_intersect("_words", _strings(words)))
    base = F.when(F.contains("line", F.lit("license")),
                  F.regexp_extract_all("line", F.lit(_BASE), 0))
    rows = rows.withColumn("_base", F.coalesce(base, F.array().cast("array<string>")))
    rows = rows.withColumn("_between", F.when(F.size("_base") > 0, F.split("line", _BASE, -1)))

    # A template is looked up only where all words of its key phrases are held.
    checks = []
    for label, notice, keys in templates:
        needed = sorted({w for k in keys for w in k.split()})
        may = F.size(F.array_intersect("_held", _strings(needed))) == len(needed)
        for k in keys:
            may = may & _has_phrase(k)
        share = F.when(may, _share(notice, rarest)).otherwise(F.lit(0.0))
        checks.append(F.struct(F.lit(label).alias("label"), share.alias("share")))
    rows = rows.withColumn("_found", F.when(
        F.size("_held") > 0, F.filter(F.array(*checks), lambda c: c["share"] >= least_share)))

    n_words = F.coalesce(F.size("_words"), F.lit(0)).cast("long")
    n_words = F.when(F.col("_words").isNull(), F.lit(0).cast("long")).otherwise(n_words)
    any_base = F.size("_base") > 0
    base_labels = F.array_sort(F.array_distinct(F.transform(
        "_base", lambda p: F.element_at(F.create_map(*[
            F.lit(x) for pair in PHRASES.items() for x in pair]), p))))
    more = F.transform(F.coalesce("_found", F.array().cast("array<struct<label:string,"
                                                           "share:double>>")),
                       lambda c: c["label"])
    best = F.array_max(F.transform("_found", lambda c: c["share"]))
    return rows.select(
        "doc_id", n_words.alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.when(any_base, _blanks(F.get("_between", F.lit(0)))).cast("long").alias("first_word"),
        F.when(any_base, n_words - _blanks(F.element_at("_between", -1))
               - _blanks(F.element_at("_base", -1)) - 1).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",")
        .alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(any_base, F.lit(1.0)).otherwise(
            F.lit(0.0))).alias("score"))
