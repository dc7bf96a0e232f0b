"""From raw reviews to the table every report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from facets.constants import SEED
from facets.functions.numeric import with_calendar, with_helpfulness, with_numeric_features
from facets.functions.text import with_clean_text, with_lengths
from facets.operators.rows import dedup_keep_first, drop_missing, sample_exact

DEDUP_KEYS = ("UserId", "Time", "Text")


def clean_reviews(raw: DataFrame, *, n_samples: int | None = None, seed: int = SEED) -> DataFrame:
    """De-duplicated, complete, optionally sampled reviews with text, time and numeric columns.

    Copies go before incomplete rows: if the first copy lacks a summary, the others do not return.
    """
    kept = drop_missing(dedup_keep_first(raw, DEDUP_KEYS))
    sampled = sample_exact(kept, n_samples, seed)
    columns = with_helpfulness(with_lengths(with_calendar(sampled)))
    return with_numeric_features(with_clean_text(columns))
