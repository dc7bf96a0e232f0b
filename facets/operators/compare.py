"""Agreement between groupings and the table of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two label columns, one row ``ari``, from the table of their pairs."""
    def pairs(n):
        return n.cast("double") * (n.cast("double") - 1) / 2

    table = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    # Each cell is counted for itself, for its row and for its column.
    counts = table.select("n", F.inline(F.array(
        F.struct(F.lit("ab").alias("side"), F.struct("a", "b").alias("key")),
        F.struct(F.lit("a").alias("side"),
                 F.struct("a", F.lit(None).cast(dict(table.dtypes)["b"]).alias("b")).alias("key")),
        F.struct(F.lit("b").alias("side"),
                 F.struct(F.lit(None).cast(dict(table.dtypes)["a"]).alias("a"), "b").alias("key")),
    ))).groupBy("side", "key").agg(F.sum("n").alias("n"))
    sums = counts.agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, pairs(F.col("n")))), F.lit(0.0)).alias(s)
          for s in ("ab", "a", "b")],
        F.sum(F.when(F.col("side") == "ab", F.col("n"))).alias("rows"))
    expected = F.coalesce(
        F.try_divide(F.col("a") * F.col("b"), pairs(F.col("rows"))), F.lit(0.0))
    ceiling = (F.col("a") + F.col("b")) / 2
    return sums.select(F.coalesce(
        F.try_divide(F.col("ab") - expected, ceiling - expected), F.lit(1.0)).alias("ari"))


def compare_methods(df: DataFrame, groupings: dict[str, str], scores: dict[str, float],
                    graph: str | None = None, q: float | None = None) -> DataFrame:
    """One small table: per method silhouette and number of clusters (noise left out), then the
    agreement of every pair of methods, then modularity.

    ``groupings`` maps a method name to its label column, ``scores`` to its silhouette.
    """
    names = list(groupings)
    sizes = df.agg(*[F.count_distinct(F.when(F.col(groupings[m]) != -1, F.col(groupings[m])))
                     .alias(f"_{i}") for i, m in enumerate(names)]).first()
    rows = []
    for i, method in enumerate(names):
        score = scores.get(method)
        rows.append((method, "clusters", float(sizes[i])))
        if score is not None:
            rows.append((method, "silhouette", float(score)))
    for i, first in enumerate(names):
        for second in names[i + 1:]:
            ari = adjusted_rand(df, groupings[first], groupings[second]).first()[0]
            rows.append((f"{first} vs {second}", "ari", float(ari)))
    if q is not None:
        rows.append((graph or "graph", "modularity", float(q)))
    return df.sparkSession.createDataFrame(rows, "method string, measure string, value double")
