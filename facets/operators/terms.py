"""Terms of documents: counting, vocabularies, TF-IDF, top terms and word frequencies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facets.constants import (LABEL_TERMS, SEED, STOP_WORDS, TFIDF_MAX_DF, TFIDF_MAX_FEATURES,
                              TFIDF_MIN_DF)
from facets.operators.counting import common_terms, ranked, weighted_vectors
from facets.operators.rows import sample_exact, sample_per_group
from facets.session import attach


def with_terms(df: DataFrame, text: str = "clean_text", stop_words=STOP_WORDS,
               name: str = "terms") -> DataFrame:
    """Words of two letters or more without stop words, then the pairs of neighbouring words."""
    words = F.filter(F.split(text, " "),
                     lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))
    more = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_words", 1, more), F.slice("_words", 2, more),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return (df.withColumn("_words", words)
            .withColumn(name, F.concat("_words", pairs)).drop("_words"))


def term_counts(df: DataFrame, text: str = "clean_text", keep=("Id",),
                stop_words=STOP_WORDS) -> DataFrame:
    """Rows (kept columns, term, tf) of every document.

    Each document is counted inside its own row, from run lengths of its sorted terms, so counting
    shuffles nothing.
    """
    sorted_terms = (with_terms(df.select(*keep, text), text, stop_words).drop(text)
                    .where(F.size("terms") > 0)
                    .withColumn("_t", F.sort_array("terms")).drop("terms"))
    # A run starts where a term differs from the one before it, and ends where the next one starts.
    cells = F.arrays_zip(
        F.col("_t").alias("term"), F.concat(F.array(F.lit("")), F.col("_t")).alias("before"),
        F.sequence(F.lit(1), F.size("_t")).alias("start"))
    runs = (sorted_terms
            .withColumn("_z", cells)
            .withColumn("_s", F.filter("_z", lambda c: c["term"] != c["before"]))
            .withColumn("_end", F.concat(F.slice("_s.start", 2, F.size("_t")),
                                         F.array(F.size("_t") + 1))))
    rows = F.explode(F.arrays_zip(F.col("_s.term").alias("term"), F.col("_s.start").alias("start"),
                                  F.col("_end").alias("end")))
    return (runs.select(*keep, rows.alias("_run"))
            .select(*keep, "_run.term", (F.col("_run.end") - F.col("_run.start")).alias("tf")))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = TFIDF_MIN_DF,
               max_df: float = TFIDF_MAX_DF,
               max_features: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """The ``max_features`` commonest terms within the document-frequency bounds.

    Columns: term, cf (occurrences), df (documents), idx (alphabetical position), idf.
    """
    kept = (counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
            .where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
            .orderBy(F.desc("cf"), "term").limit(max_features))
    # At most `max_features` rows from here on.
    return kept.withColumns({
        "idx": F.row_number().over(Window.orderBy("term")) - 1,
        "idf": F.ln(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1})


def tfidf_vectors(df: DataFrame, text: str = "clean_text", key: str = "Id",
                  stop_words=STOP_WORDS, min_df: int = TFIDF_MIN_DF,
                  max_df: float = TFIDF_MAX_DF, max_features: int = TFIDF_MAX_FEATURES):
    """Unit-length TF-IDF rows as (key, indices, values), and the vocabulary.

    Weights are (1 + ln tf) * idf with the smoothed idf. Documents without a vocabulary term have
    no row. The vocabulary is collected (its size is bounded by ``max_features``) and broadcast, and
    each vector is built where its text lies.
    """
    common, sizes = common_terms(df, text, None, max_features, min_df, max_df, stop_words)
    n_docs = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    vocab = df.sparkSession.createDataFrame(
        [(r["term"], r["cf"], r["df"], i, math.log((1 + n_docs) / (1 + r["df"])) + 1)
         for i, r in enumerate(sorted(common.collect(), key=lambda r: r["term"].encode()))],
        "term string, cf long, df long, idx int, idf double")
    known = [(r["term"], r["idf"]) for r in vocab.orderBy("idx").collect()]
    return weighted_vectors(df, text, key, known, stop_words), vocab


def tfidf(df: DataFrame, text: str = "clean_text", key: str = "Id", **settings) -> DataFrame:
    """TF-IDF in long form: one row (key, term, weight) per document and vocabulary term."""
    vectors, vocab = tfidf_vectors(df, text, key, **settings)
    cells = vectors.select(key, F.explode(F.arrays_zip("indices", "values")).alias("_c"))
    return (cells.select(key, F.col("_c.indices").alias("idx"), F.col("_c.values").alias("weight"))
            .join(F.broadcast(vocab.select("idx", "term")), "idx")
            .select(key, "term", "weight"))


def top_terms(df: DataFrame, group: str = "cluster", text: str = "clean_text", n: int = 15,
              max_features: int = 3000, min_df: int = 1, stop_words=STOP_WORDS) -> DataFrame:
    """The terms found in most documents of each group, from its commonest ``max_features`` terms.

    One count serves all groups: columns group, rank, term, df.
    """
    common, _ = common_terms(df, text, group, max_features, min_df, 1.0, stop_words)
    return (ranked(common.drop("rank"), "g", [F.desc("df"), F.col("term")], n)
            .select(F.col("g").alias(group), "rank", "term", "df"))


def label_terms(df: DataFrame, group: str = "cluster", text: str = "clean_text",
                n: int = LABEL_TERMS, min_rows: int = 5, stop_words=STOP_WORDS) -> DataFrame:
    """One row per group with its term list, or a marker where there is none to give."""
    best = top_terms(df, group, text, n, 2000, 2, stop_words)
    lists = best.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))),
                    lambda t: t["term"]).alias("_terms"))
    sizes = df.groupBy(group).agg(F.count("*").alias("_rows"))
    terms = (F.when(F.col("_rows") < min_rows, F.array(F.lit("insufficient data")))
             .otherwise(F.coalesce("_terms", F.array(F.lit("error")))))
    return sizes.join(lists, group, "left").select(group, terms.alias("terms"))


def word_freq(df: DataFrame, text: str = "Text", top: int = 120, group: str | None = None,
              sample: int | None = None, seed: int = SEED, key: str = "Id",
              stop_words=STOP_WORDS, merge_plurals: bool = True) -> DataFrame:
    """Most frequent words, overall or per group, of all rows or of an exact sample.

    A word starts with a letter, digit or underscore and may go on with apostrophes; a trailing
    ``'s`` is dropped, as are plain numbers and stop words. With ``merge_plurals`` a word ending in
    a single ``s`` counts for the word without it where that occurs too.
    """
    part = group or "_all"
    if group is None:
        df = df.withColumn("_all", F.lit(0))
    cols = df.select(part, key, text)
    if sample is not None:
        # Draw keys only, then fetch their texts where they lie: no text is sorted or moved.
        keys = cols.select(part, key)
        drawn = (sample_exact(keys, sample, seed, key) if group is None
                 else sample_per_group(keys, group, sample, seed, key))
        cols = attach(cols, drawn.select(key), key, "left_semi")
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_']*"), F.lit(0))
    # Count the words as they stand first: the rules below then see each distinct word once.
    words = (cols.select(part, F.explode(found).alias("_w"))
             .groupBy(part, "_w").agg(F.count("*").alias("_n"))
             .withColumn("term", F.regexp_replace("_w", "'s$", ""))
             .where((F.col("term") != "") & ~F.col("term").rlike(r"^\p{N}+$")
                    & ~F.col("term").isin(*stop_words)))
    counts = words.groupBy(part, "term").agg(F.sum("_n").alias("n"))
    if merge_plurals:
        counts = _merge_plurals(counts, part)
    out = ranked(counts, part, [F.desc("n"), F.col("term")], top)
    return out.select(*([group] if group else []), "rank", F.col("term").alias("word"), "n")


def _merge_plurals(counts: DataFrame, part: str) -> DataFrame:
    """Give the count of ``words`` to ``word`` where both occur, in one grouping.

    Every word is entered under itself; one ending in a single ``s`` also under its stem, any other
    also under its plural, to tell the plural that it gives way.
    """
    is_plural = F.col("term").rlike("[^s]s$")
    under_stem = F.struct(F.expr("substring(term, 1, length(term) - 1)").alias("word"),
                          F.lit("plural").alias("role"))
    under_plural = F.struct(F.concat("term", F.lit("s")).alias("word"),
                            F.lit("stem").alias("role"))
    itself = F.struct(F.col("term").alias("word"), F.lit("self").alias("role"))
    entries = F.array(itself, F.when(is_plural, under_stem).otherwise(under_plural))
    met = (counts.select(part, "n", F.inline(entries))
           .groupBy(part, "word").agg(
               F.sum(F.when(F.col("role") == "self", F.col("n"))).alias("_own"),
               F.sum(F.when(F.col("role") == "plural", F.col("n"))).alias("_given"),
               F.max(F.col("role") == "stem").alias("_has_stem")))
    gives_way = F.col("_has_stem") & F.col("word").rlike("[^s]s$")
    return (met.where(F.col("_own").isNotNull() & ~gives_way)
            .select(part, F.col("word").alias("term"),
                    (F.col("_own") + F.coalesce("_given", F.lit(0))).alias("n")))
