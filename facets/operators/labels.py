"""Label prompts, label responses and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import (LABEL_REVIEWS, LABEL_TERMS, PROMPT_BODY, PROMPT_HEAD, PROMPT_TAIL,
                              SEED)
from facets.operators.profile import group_cards
from facets.operators.rows import draw, sample_per_group
from facets.operators.terms import label_terms
from facets.session import attach

_FIELDS = ("label", "description", "sentiment")


def sample_reviews(df: DataFrame, group: str = "cluster", n: int = 2, length: int = 220,
                   seed: int = SEED) -> DataFrame:
    """A few representative reviews of each group: score, summary and the start of the text."""
    few = sample_per_group(df.select("Id", group, "Score", "Summary", "Text"), group, n, seed)
    return few.withColumn("Text", F.substring("Text", 1, length))


def label_prompts(df: DataFrame, group: str = "cluster", text: str = "clean_text",
                  n_terms: int = LABEL_TERMS, n_reviews: int = LABEL_REVIEWS, seed: int = SEED,
                  subject: str = "product reviews") -> DataFrame:
    """One prompt per group from its size, mean rating, terms and a few sampled reviews."""
    few = sample_reviews(df, group, n_reviews, 200, seed)
    line = F.format_string('  - [%d★] "%s..."', "Score", "Text")
    quotes = few.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct(draw("Id", seed).alias("_draw"), "Id", line.alias("line")))),
        lambda q: q["line"]), "\n").alias("_quotes"))
    terms = label_terms(df, group, text, n_terms)
    body = F.format_string(
        PROMPT_BODY,
        F.col(group).cast("string"), F.format_number("n_reviews", 0), F.col("avg_rating"),
        F.array_join(F.slice("terms", 1, n_terms), ", "), "_quotes")
    return (group_cards(df, group).join(terms, group).join(quotes, group)
            .select(group, F.concat(F.lit(PROMPT_HEAD.format(subject=subject)), body,
                                    F.lit(PROMPT_TAIL)).alias("prompt")))


def parse_labels(responses: DataFrame, group: str = "cluster") -> DataFrame:
    """Responses (group, response) to label fields.

    Code fences are dropped. A response that is no JSON becomes ``Unknown``; a key missing from a
    valid one stays null, for ``attach_labels`` to fill.
    """
    bare = F.trim(F.regexp_replace("response", "```(json)?", ""))
    fields = F.from_json("_json", "label string, description string, sentiment string")
    bad = F.try_parse_json("_json").isNull()
    unknown = {"label": "Unknown", "description": "unparseable response", "sentiment": "Unknown"}
    return (responses.withColumn("_json", bare).withColumn("_f", fields)
            .select(group, *[F.when(bad, unknown[f]).otherwise(F.col(f"_f.{f}")).alias(f)
                             for f in _FIELDS]))


def attach_labels(df: DataFrame, labels: DataFrame, group: str = "cluster") -> DataFrame:
    """Label fields on every row; a group without a label is called ``C`` and its number."""
    defaults = {"label": F.concat(F.lit("C"), F.col(group)), "description": F.lit(""),
                "sentiment": F.lit("")}
    joined = attach(df, labels.select(group, *_FIELDS), group, "left")
    return joined.select(*df.columns, *[F.coalesce(f, defaults[f]).alias(f"cluster_{f}")
                                        for f in _FIELDS])
