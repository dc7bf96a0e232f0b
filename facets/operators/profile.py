"""Summary, distribution and profile reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facets.constants import SEED
from facets.functions.numeric import clip
from facets.operators.rows import sample_exact
from facets.session import cut


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def summary_stats(df: DataFrame) -> DataFrame:
    voted = F.col("HelpfulnessDenominator") > 0
    return df.agg(
        F.count("*").alias("n_reviews"),
        F.avg("Score").alias("avg_score"),
        F.percentile("word_count", F.lit(0.5)).alias("median_words"),
        F.count_if(voted).alias("n_voted"),
        _share(voted).alias("pct_voted"),
    )


def rating_distribution(df: DataFrame, stars=(1, 2, 3, 4, 5)) -> DataFrame:
    """Count and share of every star value, zero rows included, from one aggregated row."""
    one = df.agg(F.count("*").alias("_all"),
                 *[F.count_if(F.col("Score") == s).alias(f"_{s}") for s in stars])
    cells = ", ".join(f"{s}, _{s}" for s in stars)
    return (one.select("_all", F.expr(f"stack({len(stars)}, {cells}) as (Score, n)"))
            .select("Score", "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct")))


def histogram(df: DataFrame, col: str, bins: int, lo=None, hi=None) -> DataFrame:
    """Equal-width bins over the observed range (after clipping); the last bin is right-closed."""
    value = F.col(col) if lo is None else clip(col, lo, hi)
    values = df.select(value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    least, most = values.agg(F.min("_v"), F.max("_v")).first()
    if least is None:
        least, most = 0.0, 1.0
    elif least == most:
        least, most = least - 0.5, most + 0.5
    width = (most - least) / bins
    at = F.least(F.floor((F.col("_v") - least) / width), F.lit(bins - 1)).alias("bin")
    counted = values.groupBy(at).agg(F.count("*").alias("n"))  # at most `bins` rows
    return (df.sparkSession.range(bins).select(F.col("id").alias("bin"))
            .join(F.broadcast(counted), "bin", "left")
            .select("bin", (F.lit(least) + F.col("bin") * width).alias("lower"),
                    (F.lit(least) + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def by_year(df: DataFrame) -> DataFrame:
    return df.groupBy("Year").agg(F.count("*").alias("n_reviews"),
                                  F.avg("Score").alias("avg_score"))


def star_share_by(df: DataFrame, key: str = "Year") -> DataFrame:
    return df.groupBy(key).agg(_share(F.col("Score") == 5).alias("pct_5star"),
                               _share(F.col("Score") == 1).alias("pct_1star"))


def box_stats(df: DataFrame, value: str = "word_count", group: str = "Score",
              lo=0, hi=500) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers, outlier count and median notch per group.

    Everything follows from the count of each (group, value), so the large table is read once.
    """
    counts = cut(df.select(F.col(group), clip(value, lo, hi).alias("_v"))
                 .where(F.col("_v").isNotNull())
                 .groupBy(group, "_v").agg(F.count("*").alias("_n")))
    box = counts.groupBy(group).agg(
        F.sum("_n").alias("n"),
        F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n")).alias("_q"))
    box = box.select(group, "n", *[F.col("_q")[i].alias(q)
                                   for i, q in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    notch = 1.57 * (F.col("q3") - F.col("q1")) / F.sqrt("n")
    # Both sides are counts of distinct values, written once above.
    spread = counts.join(box, group).groupBy(group, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("_low"),
        F.max(F.when(inside, F.col("_v"))).alias("_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"))
    return spread.select(
        group, "n", "q1", "median", "q3",
        F.least(F.col("_low").cast("double"), "q1").alias("whisker_low"),
        F.greatest(F.col("_high").cast("double"), "q3").alias("whisker_high"),
        "n_outliers",
        (F.col("median") - notch).alias("notch_low"),
        (F.col("median") + notch).alias("notch_high"))


def correlation(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, in one aggregation."""
    cols = list(cols)
    pairs = list(combinations(range(len(cols)), 2))
    # A constant column has no correlation; its variance is zero.
    wanted = [F.when(F.var_pop(c) > 0, 1.0).alias(f"r_{i}_{i}") for i, c in enumerate(cols)]
    wanted += [F.corr(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs]
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            low, high = min(i, j), max(i, j)
            cells.append(f"'{a}', '{b}', r_{low}_{high}")
    return df.agg(*wanted).select(
        F.expr(f"stack({len(cells)}, {', '.join(cells)}) as (a, b, r)"))


def group_sizes(df: DataFrame, col: str) -> DataFrame:
    sizes = cut(df.groupBy(col).agg(F.count("*").alias("n")))  # the large table is read once
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select(col, "n", (F.col("n") * 100.0 / total).alias("pct"))


def profile(df: DataFrame, by: str = "cluster", share: bool = False) -> DataFrame:
    """One row per group. With ``share`` the vote mean gives way to the share of all rows."""
    wanted = [
        F.count("*").alias("n_reviews"),
        F.avg("Score").alias("avg_rating"),
        _share(F.col("Score") == 5).alias("pct_5star"),
        _share(F.col("Score") == 1).alias("pct_1star"),
        F.avg("word_count").alias("avg_words"),
        F.avg("helpfulness_ratio").alias("avg_helpfulness"),
    ]
    if not share:
        return df.groupBy(by).agg(*wanted, F.avg("HelpfulnessDenominator").alias("avg_votes"))
    groups = cut(df.groupBy(by).agg(*wanted))
    total = groups.agg(F.sum("n_reviews")).scalar()
    return groups.withColumn("pct_reviews", F.col("n_reviews") * 100.0 / total)


def group_cards(df: DataFrame, by: str = "cluster") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_reviews"), F.avg("Score").alias("avg_rating"),
                              F.avg("word_count").alias("avg_words"))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Display variant of a report: fractional columns rounded half to even."""
    return df.select([F.bround(c, digits).alias(c) if t == "double" else F.col(c)
                      for c, t in df.dtypes])


# Columns of ``profile`` that are set against each other on one scale.
SCALED = ("avg_rating", "pct_5star", "pct_1star", "avg_words", "avg_helpfulness", "avg_votes")


def minmax_scale(df: DataFrame, cols) -> DataFrame:
    """Scale columns to [0, 1] over all rows; a constant column gives null."""
    bounds = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                               for c in cols]).alias("_b")).scalar()
    return df.withColumns({
        c: (F.col(c) - bounds[c]["lo"]) / F.nullif(bounds[c]["hi"] - bounds[c]["lo"], F.lit(0.0))
        for c in cols})


def pivot_share(df: DataFrame, row: str, col: str, values=None, prefix: str = "") -> DataFrame:
    """Counts of ``col`` values per ``row`` as percentages of the row; naming the values saves a
    pass over the data."""
    if values is None:
        values = [r[0] for r in df.select(col).distinct().orderBy(col).collect()]
    wide = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    names = [n for n in wide.columns if n != row]
    filled = {n: F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names}
    total = sum(filled[n] for n in names[1:]) + filled[names[0]] if len(names) > 1 \
        else filled[names[0]]
    return wide.select(row, *[
        F.try_divide(filled[n] * 100.0, total).alias(f"{prefix}{n}") for n in names])


def noise_report(df: DataFrame, col: str = "dbscan_cluster") -> DataFrame:
    noise = F.col(col) == -1
    return df.agg(F.count_distinct(F.when(~noise, F.col(col))).alias("n_clusters"),
                  F.count_if(noise).alias("n_noise"), _share(noise).alias("pct_noise"))


def explained_variance(ratios: DataFrame, levels=(80, 90)) -> DataFrame:
    """Running sum of ``ratio`` over components ``pc`` and the first component reaching a level."""
    # A table of components: a fixed, small number of rows.
    running = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ratios.select("pc", (F.col("ratio") * 100).alias("pct"),
                        (F.sum("ratio").over(running) * 100).alias("cum_pct"))
    return out.withColumns({
        f"reaches_{level}": (F.col("cum_pct") >= level) & (F.col("cum_pct") - F.col("pct") < level)
        for level in levels})


def helpfulness_scatter(df: DataFrame, n: int | None = 3000, seed: int = SEED) -> DataFrame:
    voted = df.where(F.col("HelpfulnessDenominator") > 2).select(
        "Id", clip("word_count", 0, 700).alias("words"), "helpfulness_ratio", "Score")
    return sample_exact(voted, n, seed)
