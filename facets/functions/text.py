"""Text columns, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.constants import BLANKS, CATEGORY_RULES, CLEAN_STEPS, DEFAULT_CATEGORY


def clean(col: Column) -> Column:
    """Lower case; tags, links and everything but a-z become single blanks; trimmed."""
    out = F.lower(col)
    for pattern in CLEAN_STEPS:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def with_word_count(df: DataFrame, text: str = "Text", name: str = "word_count") -> DataFrame:
    """Number of blank-separated words. Splitting leaves an empty string at an edge blank."""
    # A column of its own, so that the text is split once and not once per mention.
    split = df.withColumn("_parts", F.split(text, f"[{BLANKS}]+"))
    last_is_empty = (F.size("_parts") > 1) & (F.element_at("_parts", -1) == "")
    words = (F.size("_parts")
             - F.when(F.element_at("_parts", 1) == "", 1).otherwise(0)
             - F.when(last_is_empty, 1).otherwise(0))
    return split.withColumn(name, words).drop("_parts")


def with_lengths(df: DataFrame, text: str = "Text", summary: str = "Summary") -> DataFrame:
    return with_word_count(df, text).withColumns({
        "text_length": F.length(text), "summary_length": F.length(summary)})


def with_clean_text(df: DataFrame, summary: str = "Summary", text: str = "Text") -> DataFrame:
    joined = F.concat(F.coalesce(summary, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return df.withColumn("clean_text", clean(joined))


def truncate(col: str | Column, n: int) -> Column:
    return F.substring(col, 1, n)


def with_category(df: DataFrame, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY,
                  summary: str = "Summary", text: str = "Text") -> DataFrame:
    """First rule whose keyword occurs anywhere (substring match) in summary and text."""
    body = F.lower(F.concat(F.coalesce(summary, F.lit("")), F.lit(" "),
                            F.coalesce(text, F.lit(""))))
    branch = None
    for name, words in rules:
        hit = None
        for word in words:
            found = F.contains(F.col("_body"), F.lit(word))
            hit = found if hit is None else hit | found
        branch = F.when(hit, name) if branch is None else branch.when(hit, name)
    return (df.withColumn("_body", body)
            .withColumn("category", branch.otherwise(default))
            .drop("_body"))
