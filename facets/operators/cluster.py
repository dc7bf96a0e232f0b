"""K-Means, choice of k, and hierarchical grouping."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import (FINAL_MAX_ITER, FINAL_RESTARTS, K_RANGE, SEED, SWEEP_MAX_ITER,
                              SWEEP_RESTARTS, SWEEP_SAMPLE)
from facets.operators.centers import Fit, assign_nearest, fit_many
from facets.operators.hierarchy import cut_tree, ward_tree
from facets.operators.neighbors import silhouettes
from facets.operators.rows import numbered
from facets.session import attach, cut


def _best(fits: list[Fit]) -> Fit:
    return min(fits, key=lambda f: f.cost)


def _relabel(df: DataFrame, raw: str, id_col: str, name: str) -> DataFrame:
    """Number groups from 0 by falling size, then by smallest id; there are few groups."""
    sizes = df.groupBy(raw).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).collect()
    order = sorted(sizes, key=lambda r: (-r["n"], r["first"]))
    place = {r[raw]: i for i, r in enumerate(order)}
    places = F.array(*[F.lit(place.get(g, -1)) for g in range(max(place) + 1)])
    return df.withColumn(name, F.get(places, F.col(raw))).drop(raw)


def kmeans(df: DataFrame, vec: str, k: int, restarts: int = FINAL_RESTARTS,
           max_iter: int = FINAL_MAX_ITER, seed: int = SEED, id_col: str = "Id",
           name: str = "cluster"):
    """Best of several K-Means fits: the table with ``name`` added, and the fit."""
    fit = _best(fit_many(df, vec, [(k, seed + r) for r in range(restarts)], max_iter, id_col))
    rows = df.select("*", F.col(vec).cast("array<double>").alias("_v"))
    marked = assign_nearest(rows, fit.centers, "_v", "_label").drop("_v", "_label_dist")
    return _relabel(cut(marked), "_label", id_col, name), fit


def sweep_k(df: DataFrame, vec: str, ks=K_RANGE, restarts: int = SWEEP_RESTARTS,
            max_iter: int = SWEEP_MAX_ITER, sample: int | None = SWEEP_SAMPLE, seed: int = SEED,
            id_col: str = "Id") -> DataFrame:
    """Inertia and silhouette per k: (k, inertia, silhouette).

    All restarts of all k advance together, and one pass over the pairs of sampled rows scores the
    groupings of all k.
    """
    ks = list(ks)
    runs = [(k, seed + r) for k in ks for r in range(restarts)]
    fits = fit_many(df, vec, runs, max_iter, id_col)
    labelled, costs, names = df.select(id_col, F.col(vec).cast("array<double>").alias(vec)), [], []
    for i, k in enumerate(ks):
        fit = _best(fits[i * restarts:(i + 1) * restarts])
        costs.append(fit.cost)
        names.append(f"_k{k}")
        labelled = assign_nearest(labelled, fit.centers, vec, names[-1]).drop(f"{names[-1]}_dist")
    scores = {r["grouping"]: r["silhouette"]
              for r in silhouettes(cut(labelled), id_col, vec, names, sample, seed).collect()}
    return df.sparkSession.createDataFrame(
        [(k, float(costs[i]), float(scores[i])) for i, k in enumerate(ks)],
        "k int, inertia double, silhouette double")


def best_k(sweep: DataFrame) -> int:
    """The k with the highest silhouette, the smallest on a tie."""
    return sweep.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).first()[0]


def _ward_merges(sizes: np.ndarray, sums: np.ndarray, k: int) -> list[int]:
    """Merge groups, always the pair that adds least variance, until k are left."""
    sizes, sums = sizes.astype("f8"), sums.astype("f8")
    owner = list(range(len(sizes)))
    alive = list(range(len(sizes)))
    while len(alive) > k:
        n, centre = sizes[alive], sums[alive] / sizes[alive][:, None]
        gap = ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
        cost = gap * np.outer(n, n) / (n[:, None] + n[None])
        cost[np.tril_indices(len(alive))] = np.inf
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        keep, gone = alive[i], alive[j]
        sizes[keep] += sizes[gone]
        sums[keep] += sums[gone]
        owner = [keep if o == gone else o for o in owner]
        alive.remove(gone)
    return owner


def ward(df: DataFrame, vec: str, k: int, micro: int = 200, method: str = "ward",
         seed: int = SEED, id_col: str = "Id", name: str = "agg_cluster") -> DataFrame:
    """Hierarchical groups: rows go to at most ``micro`` small groups, which Ward's rule merges.

    Ward's criterion needs only the size and sum of a group, so merging works on a table of at most
    ``micro`` rows. ``method='exact'`` merges the distinct vectors themselves and refuses more than
    ``micro`` of them; ``method='rows'`` merges any number of them in rounds, and leaves rows without
    a finite vector out. ``method='bisecting'`` splits top-down with Spark's bisecting K-Means instead.
    """
    if method == "rows":
        roots = cut_tree(*ward_tree(df, vec, seed), k)
        key = F.transform(F.col(vec).cast("array<double>"), lambda x: x + F.lit(0.0))
        # Hashes are cheap to sort; the vectors themselves decide.
        marked = df.withColumn("_key", key).withColumn("_hash", F.xxhash64("_key"))
        roots = roots.toDF("_key", "_root").withColumn("_hash", F.xxhash64("_key"))
        raw = cut(marked.join(roots, ["_hash", "_key"]).drop("_hash", "_key"))
        order = raw.groupBy("_root").agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
        places = numbered(order, F.desc("n"), F.col("first"), name=name)
        return attach(raw, places.select("_root", F.col(name).cast("int").alias(name)),
                      "_root").drop("_root")
    if method == "bisecting":
        rows = df.withColumn("_v", array_to_vector(vec))
        model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_raw").fit(rows)
        return _relabel(model.transform(rows).drop("_v"), "_raw", id_col, name)
    if method == "exact":
        few = df.select(vec).distinct().limit(micro + 1).collect()
        if len(few) > micro:
            raise ValueError(f"more than {micro} distinct vectors")
        spots = sorted(tuple(r[0]) for r in few)
        table = df.sparkSession.createDataFrame(
            [(list(s), i) for i, s in enumerate(spots)], f"{vec} array<double>, _micro int")
        grouped = df.join(F.broadcast(table), vec)
    else:
        grouped, _ = kmeans(df, vec, micro, 1, 20, seed, id_col, "_micro")
    grouped = cut(grouped)
    size = {r["_micro"]: r["count"] for r in grouped.groupBy("_micro").count().collect()}
    total = np.zeros((max(size) + 1, df.select(F.size(vec)).first()[0]))
    cells = grouped.select("_micro", F.posexplode(vec).alias("_at", "_x"))
    for r in cells.groupBy("_micro", "_at").agg(F.sum("_x").alias("s")).collect():
        total[r["_micro"], r["_at"]] = r["s"]
    ids = sorted(size)
    merged = _ward_merges(np.array([size[i] for i in ids]), total[ids], k)
    target = dict(zip(ids, merged))
    places = F.array(*[F.lit(target.get(g, -1)) for g in range(max(size) + 1)])
    out = _relabel(grouped.withColumn("_raw", F.get(places, F.col("_micro"))).drop("_micro"),
                   "_raw", id_col, name)
    return out
