"""Review tables in, result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facets.constants import MISSING_MARKS
from facets.sources.csv import read_csv

REVIEW_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()),
    T.StructField("ProductId", T.StringType()),
    T.StructField("UserId", T.StringType()),
    T.StructField("HelpfulnessNumerator", T.IntegerType()),
    T.StructField("HelpfulnessDenominator", T.IntegerType()),
    T.StructField("Score", T.IntegerType()),
    T.StructField("Time", T.LongType()),
    T.StructField("Summary", T.StringType()),
    T.StructField("Text", T.StringType()),
])


def null_missing(df: DataFrame) -> DataFrame:
    """Turn every spelling of a missing value in a text column into null."""
    return df.select([
        F.when(~F.col(f.name).isin(*MISSING_MARKS), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Read a review CSV: quoted fields may hold line breaks and doubled quotes.

    Known columns get their declared type, a value that does not parse becomes null, and further
    columns pass through as text. A large file is read by many tasks (``sources.csv``).
    """
    raw = read_csv(spark, path)
    types = {f.name: f.dataType for f in REVIEW_SCHEMA}
    typed = null_missing(raw)
    return typed.select([
        F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in typed.columns
    ])


def reviews_from_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The review schema built from the order and document tables, plus a stand-in ``cluster``.

    One review per document: the order with the same key gives user, score and time, its line items
    give the votes.
    """
    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    order = table("orders")
    day = "unix_date(cast(o_orderdate as date)) * 86400L"
    clock = "hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate)"
    buyers = order.select(
        F.col("o_orderkey").alias("Id"), "o_custkey", F.expr(f"{day} + {clock}").alias("Time"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("Score"))
    votes = table("lineitem").groupBy(F.col("l_orderkey").alias("Id")).agg(
        F.count("*").alias("den"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("num"))
    parts = table("part").agg(F.count("*")).scalar()
    return (
        table("documents").select(F.col("doc_id").alias("Id"), F.col("text").alias("Text"))
        .join(buyers, "Id")
        .join(votes, "Id", "left")
        .select(
            "Id",
            F.concat(F.lit("P"), F.col("Id") % parts).alias("ProductId"),
            F.concat(F.lit("U"), F.col("o_custkey")).alias("UserId"),
            F.coalesce("num", F.lit(0)).cast("int").alias("HelpfulnessNumerator"),
            F.coalesce("den", F.lit(0)).cast("int").alias("HelpfulnessDenominator"),
            "Score", "Time",
            F.substring("Text", 1, 60).alias("Summary"),
            "Text",
            (F.col("o_custkey") % 5).cast("int").alias("cluster"),
        )
    )


def write_assigned(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the enriched table; CSV comes with a header and quoting that ``read_reviews`` reads."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                   ignoreTrailingWhiteSpace=False)
    else:
        writer.format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write every named result table as Parquet under one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_report(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows before and after cleaning, date range, products, users, clean-text facts.

    ``kept`` carries ``Date`` and ``clean_text``.
    """
    facts = kept.agg(
        F.count("*").alias("rows_kept"),
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
        F.count_distinct("ProductId").alias("products"),
        F.count_distinct("UserId").alias("users"),
        F.avg(F.length("clean_text")).alias("avg_clean_length"),
        F.min_by(F.substring("clean_text", 1, 150), "Id").alias("example"),
    )
    rows_read = raw.agg(F.count("*")).scalar()
    return facts.select(rows_read.alias("rows_read"), "*")
