"""Calendar and numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.constants import HOLIDAY_MONTHS


def with_calendar(df: DataFrame, time_col: str = "Time") -> DataFrame:
    """Epoch seconds to a UTC date-time, year, month and quarter, whatever the session's zone."""
    epoch = F.expr(
        f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {time_col})")
    return (df.withColumn("Date", epoch)
            .withColumns({"Year": F.year("Date"), "Month": F.month("Date"),
                          "Quarter": F.quarter("Date")}))


def with_helpfulness(df: DataFrame, num: str = "HelpfulnessNumerator",
                     den: str = "HelpfulnessDenominator") -> DataFrame:
    return df.withColumn("helpfulness_ratio", F.col(num).cast("double") / (F.col(den) + 1))


def with_numeric_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "log_word_count": F.log1p("word_count"),
        "log_summary_length": F.log1p("summary_length"),
        "log_total_votes": F.log1p("HelpfulnessDenominator"),
        "rating_norm": (F.col("Score") - 1) / F.lit(4.0),
    })


def clip(col: str | Column, lo, hi) -> Column:
    """Bound a value to [lo, hi]; null stays null."""
    value = F.col(col) if isinstance(col, str) else col
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def with_holiday_flag(df: DataFrame, month: str = "Month") -> DataFrame:
    return df.withColumn("is_holiday", F.col(month).isin(*HOLIDAY_MONTHS))
