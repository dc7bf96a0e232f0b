"""Reports over years and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facets.functions.numeric import with_holiday_flag
from facets.operators.profile import pivot_share
from facets.operators.rows import keep_frequent


def drift_share(df: DataFrame, cluster_col: str = "cluster", values=None,
                min_count: int = 30) -> DataFrame:
    """Share of each cluster in each year, for years with enough rows; one column per cluster."""
    return pivot_share(keep_frequent(df, "Year", min_count), "Year", cluster_col, values, "c")


def drift_rating(df: DataFrame, cluster_col: str = "cluster", values=None,
                 min_count: int = 30) -> DataFrame:
    """Mean rating of each cluster in each year; null where a cluster has no rows."""
    kept = keep_frequent(df, "Year", min_count)
    wide = kept.groupBy("Year").pivot(cluster_col, values).agg(F.avg("Score"))
    return wide.select("Year", *[F.col(f"`{c}`").alias(f"c{c}")
                                 for c in wide.columns if c != "Year"])


def drift_stack(df: DataFrame, cluster_col: str = "cluster", values=None,
                min_count: int = 30) -> DataFrame:
    """Long form of ``drift_share`` with the running baseline of a stacked area."""
    shares = drift_share(df, cluster_col, values, min_count)
    names = [c for c in shares.columns if c != "Year"]
    rows = shares.unpivot("Year", names, "_name", "pct")
    order = Window.partitionBy("Year").orderBy(cluster_col)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn(cluster_col, F.substring("_name", 2, 20).cast("int")).drop("_name")
            .select("Year", cluster_col, "pct",
                    F.coalesce(F.sum("pct").over(below), F.lit(0.0)).alias("base"),
                    F.sum("pct").over(through).alias("top")))


def complaint_cluster(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """The cluster with the lowest mean score, the lowest id on a tie."""
    means = df.groupBy(cluster_col).agg(F.avg("Score").alias("avg_score"),
                                        F.count("*").alias("n_reviews"))
    first = F.min(F.struct("avg_score", cluster_col, "n_reviews")).alias("_f")
    return means.agg(first).select(f"_f.{cluster_col}", "_f.avg_score", "_f.n_reviews")


def monthly_volume(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Rows of the complaint cluster in each of the twelve months, zeros included."""
    worst = complaint_cluster(df, cluster_col).select(cluster_col).scalar()
    counted = (df.where((F.col(cluster_col) == worst) & F.col("Month").between(1, 12))
               .groupBy("Month").agg(F.count("*").alias("n")))  # at most twelve rows
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("Month"))
    filled = months.join(F.broadcast(counted), "Month", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    return with_holiday_flag(filled)
