"""Row filters, de-duplication, sampling and a global row index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facets.constants import SEED
from facets.session import attach, cut, small_rows

# Spark trims each partition to the first n rows of a group before the shuffle up to this n.
_GROUP_LIMIT = 1000
_LAST_BUCKET = "ffff"


def dedup_keep_first(df: DataFrame, keys, order_by: str = "Id") -> DataFrame:
    """Keep, for each key, the row with the smallest ``order_by``; null keys equal each other.

    ``order_by`` is unique. An aggregation, not a window: copies collapse before the shuffle, so a
    key that holds a large part of the table sends one row per input partition. Texts take part as
    fixed-width hashes and stay out of the aggregation; the chosen rows are then picked by id.
    """
    kinds = dict(df.dtypes)
    hashed = [(F.sha2(c, 256) if kinds[c] == "string" else F.col(c)).alias(f"_k{i}")
              for i, c in enumerate(keys)]
    first = (df.select(*hashed, F.col(order_by).alias("_first"))
             .groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_first").alias("_first")))
    return df.join(first.select("_first"), F.col(order_by) == F.col("_first"), "left_semi")


def drop_missing(df: DataFrame, cols=("Text", "Summary")) -> DataFrame:
    return df.na.drop(subset=list(cols))


def keep_frequent(df: DataFrame, col: str, min_count: int = 30) -> DataFrame:
    """Rows whose value in ``col`` occurs at least ``min_count`` times."""
    frequent = df.groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count)
    return attach(df, frequent.select(col), col, "left_semi")


def draw(key: str, seed: int) -> Column:
    """A fixed pseudo-random text per key: sorting by it is a shuffle no partitioning changes."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _bucket(drawn: str) -> Column:
    return F.substring(drawn, 1, 4)


def sample_exact(df: DataFrame, n: int | None = None, seed: int = SEED,
                 key: str = "Id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniform without replacement; ``key`` is unique.

    A count per hash bucket (at most 65,536 of them) shows how far down the order the sample
    reaches, so only rows up to that bucket are ordered.
    """
    if n is None:
        return df
    drawn = df.withColumn("_draw", draw(key, seed))
    counts = drawn.groupBy(_bucket("_draw").alias("_bucket")).agg(F.count("*").alias("_n"))
    reach = counts.withColumn(
        "_upto", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)))
    last = reach.where(F.col("_upto") >= n).agg(
        F.coalesce(F.min("_bucket"), F.lit(_LAST_BUCKET))).scalar()
    return (drawn.where(_bucket("_draw") <= last)
            .orderBy("_draw", key).limit(n).drop("_draw"))


def sample_per_group(df: DataFrame, group: str, n: int, seed: int = SEED,
                     key: str = "Id") -> DataFrame:
    """Exactly ``min(n, group rows)`` rows of every group."""
    drawn = df.withColumn("_draw", draw(key, seed))
    if n > _GROUP_LIMIT:
        # Find each group's last hash bucket first, so that a large group is not sorted whole.
        counts = drawn.groupBy(group, _bucket("_draw").alias("_bucket")).agg(
            F.count("*").alias("_n"))
        order = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        last = (counts.withColumn("_upto", F.sum("_n").over(order))
                .groupBy(group)
                .agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_bucket"))),
                                F.lit(_LAST_BUCKET)).alias("_last")))
        drawn = (attach(drawn, last, group, "left")
                 .where(F.col("_last").isNull() | (_bucket("_draw") <= F.col("_last")))
                 .drop("_last"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_draw", key))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_draw", "_rank")


def with_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given total order, without one task seeing them all.

    Rows are range-partitioned and sorted; each partition's start is the count of those before it.
    """
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright("_at", 33),
                      "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .select("_part", "_start"))
    return (attach(placed, starts, "_part")
            .withColumn(name, F.col("_start") + F.col("_row"))
            .drop("_at", "_part", "_row", "_start"))


def numbered(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """``with_index`` for a table that is usually small: one sorted task if counted to be so."""
    rows = small_rows(df)
    if rows is None:
        return with_index(df, *order, name=name)
    fixed = df.sparkSession.createDataFrame(rows, df.schema)
    return fixed.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
