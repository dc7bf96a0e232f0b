"""Similarity graphs, connected components, communities and modularity."""

from __future__ import annotations

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import GRAPH_NEIGHBORS, SEED
from facets.operators.moves import connected_parts, local_moves
from facets.operators.neighbors import knn
from facets.operators.rows import numbered
from facets.session import cut


def unit_length(df: DataFrame, vec: str, name: str) -> DataFrame:
    """Vectors scaled to length one; a zero vector stays as it is."""
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v * v))
    return (df.withColumn("_len", length)
            .withColumn(name, F.when(F.col("_len") > 0, F.transform(
                vec, lambda v: v / F.col("_len"))).otherwise(F.col(vec)))
            .drop("_len"))


def knn_graph(df: DataFrame, id_col: str, vec_col: str, k: int = GRAPH_NEIGHBORS,
              **search) -> DataFrame:
    """Undirected similarity edges (src < dst, weight) between nearest neighbours.

    On unit vectors the weight is 1 - d^2 / 2 cut to [0, 1]; of the two directions the larger one
    counts, and edges of weight zero vanish. ``search`` goes to ``knn``.
    """
    vectors = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    near = knn(unit_length(vectors, "v", "u"), "id", "u", k, **search)
    weight = F.least(F.greatest(1 - F.col("dist") * F.col("dist") / 2, F.lit(0.0)), F.lit(1.0))
    return (near.select(F.least("id", "nbr").alias("src"), F.greatest("id", "nbr").alias("dst"),
                        weight.alias("weight"))
            .groupBy("src", "dst").agg(F.max("weight").alias("weight"))
            .where(F.col("weight") > 0))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components: (id, component), named by the smallest id in them.

    Every round hooks each remaining root to its smallest neighbour, follows the hooks to their end
    by doubling, and contracts the graph, so the edge table shrinks until no edge is left.
    """
    labels = nodes.select("id", F.col("id").alias("component"))
    links = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    links = cut(links.union(links.select("dst", "src")).distinct())
    while not links.isEmpty():
        hooks = cut(links.groupBy("src").agg(F.min("dst").alias("low"))
                    .select("src", F.least("src", "low").alias("root")))
        moving = True
        while moving:
            above = hooks.select(F.col("src").alias("root"), F.col("root").alias("up"))
            jumped = cut(hooks.join(above, "root").select(
                "src", F.col("up").alias("root"),
                (F.col("up") != F.col("root")).alias("moved")))
            moving = not jumped.where("moved").isEmpty()
            hooks = jumped.drop("moved")
        step = hooks.select(F.col("src").alias("component"), "root")
        labels = cut(labels.join(step, "component", "left")
                     .select("id", F.coalesce("root", "component").alias("component")))
        ends = hooks.select(F.col("src").alias("dst"), F.col("root").alias("b"))
        links = cut(links.join(hooks.select("src", F.col("root").alias("a")), "src")
                    .join(ends, "dst")
                    .where(F.col("a") != F.col("b"))
                    .select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    return labels


def modularity(edges: DataFrame, labels: DataFrame, label: str = "community") -> DataFrame:
    """One row ``q``: over communities, inner weight over m minus squared degree share.

    ``edges`` holds each undirected edge once; ``labels`` has ``id`` and the community.
    """
    total = edges.agg(F.sum("weight")).scalar()
    a = labels.select(F.col("id").alias("src"), F.col(label).alias("ca"))
    b = labels.select(F.col("id").alias("dst"), F.col(label).alias("cb"))
    ends = edges.join(a, "src").join(b, "dst")
    shares = ends.select(F.inline(F.array(
        F.struct(F.col("ca").alias("c"), F.col("weight").alias("degree"),
                 F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inner")),
        F.struct(F.col("cb").alias("c"), F.col("weight").alias("degree"),
                 F.lit(0.0).alias("inner")))))
    per = shares.groupBy("c").agg(F.sum("degree").alias("d"), F.sum("inner").alias("l"))
    return (per.select(F.col("l") / total - F.pow(F.col("d") / (2 * total), 2.0).alias("part"))
            .toDF("part").agg(F.sum("part").alias("q")))


def _local_moves(links: DataFrame, two_m: float, min_gain: float, seed: int):
    """Move nodes to neighbouring communities while modularity grows; (id, comm) and modularity.

    ``links`` has both directions of every edge and inner weights as loops. In a round only a
    hashed half of the nodes moves, so that two neighbours do not keep swapping places. Rounds end
    when no node wants to move, or when several in a row brought no gain; each state is scored in
    the round that follows it, the last one too.
    """
    return local_moves(links, two_m, min_gain, seed)


def _connected(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Split communities that moves have torn apart into their connected parts.

    Two parts without an edge between them only lower modularity together, so no split lowers it.
    """
    return connected_parts(links, moved)


def louvain(edges: DataFrame, nodes: DataFrame, min_gain: float = 1e-7, seed: int = SEED,
            name: str = "community", method: str = "louvain", groups: int = 10) -> DataFrame:
    """Communities of a weighted undirected graph: (id, community), every node labelled.

    Levels of local moves, refinement and contraction, all as joins and groupings, until one brings
    no gain. Every community is connected. Communities are numbered from 0 by falling size, then
    smallest id; a node without edges is its own community.
    ``method='pic'`` is Spark's power iteration clustering into ``groups`` groups.
    """
    if method == "pic":
        model = PowerIterationClustering(k=groups, weightCol="weight")
        found = model.assignClusters(edges.select("src", "dst", "weight"))
        labels = nodes.join(found.select("id", F.col("cluster").alias("comm")), "id", "left")
        labels = labels.select("id", F.coalesce(
            F.col("comm").cast("string"), F.concat(F.lit("n"), F.col("id"))).alias("comm"))
        return _numbered_communities(labels, name)
    weighted = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    links = cut(weighted.union(weighted.select("dst", "src", "weight"))
                .groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = nodes.select("id", F.col("id").alias("comm"))
    two_m = links.agg(F.sum("weight")).first()[0]
    last, level = None, 0
    while two_m:
        moved, q = _local_moves(links, two_m, min_gain, seed + 1000 * level)
        level += 1
        if last is not None and q - last < min_gain:
            break
        last = q
        moved = cut(_connected(links, moved))
        step = moved.select(F.col("id").alias("comm"), F.col("comm").alias("up"))
        labels = cut(labels.join(step, "comm", "left")
                     .select("id", F.coalesce("up", "comm").alias("comm")))
        if moved.where(F.col("id") != F.col("comm")).isEmpty():
            break
        a = moved.select(F.col("id").alias("src"), F.col("comm").alias("a"))
        b = moved.select(F.col("id").alias("dst"), F.col("comm").alias("b"))
        links = cut(links.join(a, "src").join(b, "dst").groupBy(
            F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
    return _numbered_communities(labels, name)


def _numbered_communities(labels: DataFrame, name: str) -> DataFrame:
    sizes = labels.groupBy("comm").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    places = numbered(sizes, F.desc("n"), F.col("first"), name=name)
    return labels.join(places.select("comm", F.col(name).cast("int").alias(name)), "comm").select(
        "id", name)
