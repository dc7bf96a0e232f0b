"""Density clustering of points in the plane or in space.

Points fall into grid cells so small that all points of one cell lie within ``eps`` of each other.
A cell with ``min_samples`` points therefore needs no comparison at all: its points are core points
of one cluster, however many they are. Only points of sparser cells are compared one by one, with
neighbouring cells, and cells are linked through their bounding boxes.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.constants import DBSCAN_MIN_SAMPLES
from facets.operators.graph import components
from facets.operators.neighbors import distance_curve, k_distance, suggest_eps
from facets.operators.rows import numbered
from facets.session import cut, small_rows

# Rows of a cell per join key.
SALT_ROWS = 50_000
# Pairs of distinct points that one task compares at once; larger pairs of parts are split first.
# Both ways end in the same comparison, so the answer does not depend on it.
PAIR_POINTS = 10_000


def _distance(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), "
                  "double(0), (s, v) -> s + v))")


def _offsets(dims: int, side: float, eps: float) -> list[list[int]]:
    """Steps to the cells that can hold a point within ``eps``."""
    reach = math.ceil(eps / side)
    steps = []
    for step in product(range(-reach, reach + 1), repeat=dims):
        gap = math.sqrt(sum((max(abs(s) - 1, 0) * side) ** 2 for s in step))
        if gap <= eps * (1 + 1e-9):
            steps.append(list(step))
    return steps


def _around(cell: str, steps: list[list[int]]) -> Column:
    """One row for each of the cells at the given steps from ``cell``."""
    listed = ", ".join(f"array({', '.join(map(str, step))})" for step in steps)
    return F.expr(f"explode(transform(array({listed}), "
                  f"step -> zip_with({cell}, step, (c, o) -> c + bigint(o))))")


def _part(side: float) -> Column:
    return F.expr(f"transform(at, v -> floor(v / {side!r}D))")


def _grid(df: DataFrame, id_col: str, coords, side: float) -> DataFrame:
    at = F.array(*[F.col(c).cast("double") for c in coords])
    return (df.select(F.col(id_col).alias("id"), at.alias("at"))
            .withColumn("cell", _part(side)))


def _hot_cells(points: DataFrame):
    """Cells with more than SALT_ROWS rows and the number of parts each is split into, or None."""
    hot = (points.groupBy("cell").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
           .where(F.col("parts") > 1))
    rows = small_rows(hot)
    if rows is None:
        return cut(hot)
    return F.broadcast(points.sparkSession.createDataFrame(rows, hot.schema)) if rows else None


def eps_join(left: DataFrame, right: DataFrame, eps: float, dims: int, side: float,
             columns: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Rows of ``left`` (id, at, cell) with each point of ``right`` (at, cell, columns) within eps.

    An equality join on neighbouring cells. The ``hot`` cells of ``right`` are split by a hash, and
    the left rows meant for them are copied to every part, so no key holds a large share.
    """
    around = left.select(*[c for c in left.columns if c != "cell"],
                         _around("cell", _offsets(dims, side, eps)).alias("cell"))
    points = right.select("cell", "id", F.col("at").alias("_at"),
                          *[F.col(c).alias(f"_{c}") for c in columns])
    keys = ["cell"]
    if hot is not None:
        keys = ["cell", "_salt"]
        parts = F.coalesce("parts", F.lit(1))
        around = around.join(hot, "cell", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        points = points.join(hot, "cell", "left").withColumn(
            "_salt", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    return (around.join(points.drop("id"), keys).where(_distance("at", "_at") <= eps)
            .drop(*keys))


def _core_flags(df: DataFrame, id_col: str, coords, eps: float, min_samples: int):
    """All points as (id, at, cell, is_core), the cell side, and the hot cells."""
    dims = len(coords)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    points = cut(_grid(df, id_col, coords, side))
    hot = _hot_cells(points)
    dense = points.groupBy("cell").agg((F.count("*") >= min_samples).alias("dense"))
    # A cell with very many points is a skewed key here, which adaptive execution splits.
    known = points.join(dense, "cell")
    sparse = known.where(~F.col("dense")).select("id", "at", "cell")
    met = eps_join(sparse, points, eps, dims, side, [], hot)
    cores = met.groupBy("id").agg((F.count("*") >= min_samples).alias("_near"))
    flagged = known.join(cores, "id", "left").select(
        "id", "at", "cell", (F.col("dense") | F.coalesce("_near", F.lit(False))).alias("is_core"))
    return cut(flagged), side, hot


def core_points(df: DataFrame, id_col: str, coords, eps: float,
                min_samples: int = DBSCAN_MIN_SAMPLES) -> DataFrame:
    """(id, is_core): whether at least ``min_samples`` points, itself included, lie within eps."""
    return _core_flags(df, id_col, coords, eps, min_samples)[0].select("id", "is_core")


def _parts(side: float, level: int) -> Column:
    """Part of a cell cut ``level`` times into quarters, counted from the cell's corner.

    Quarters scale by a power of two, which is exact, so a part's own part is its number over 4.
    """
    return F.expr(f"zip_with(at, cell, (v, c) -> "
                  f"floor((v - c * {side!r}D) / {side!r}D * {4.0 ** level!r}D))")


def _boxes(parted: DataFrame, dims: int) -> DataFrame:
    """Bounding box and number of distinct points of each (cell, part)."""
    return parted.groupBy("cell", "part").agg(
        F.expr(f"array({', '.join(f'min(at[{d}])' for d in range(dims))})").alias("lo"),
        F.expr(f"array({', '.join(f'max(at[{d}])' for d in range(dims))})").alias("hi"),
        F.count("*").alias("n"))


def _gap(near: bool, dims: int) -> Column:
    """Smallest or largest distance between two boxes (a_lo, a_hi) and (b_lo, b_hi)."""
    width = ("greatest(a_lo[{d}] - b_hi[{d}], b_lo[{d}] - a_hi[{d}], double(0))" if near
             else "greatest(a_hi[{d}] - b_lo[{d}], b_hi[{d}] - a_lo[{d}])")
    return F.expr(f"sqrt({' + '.join(f'pow({width.format(d=d)}, 2)' for d in range(dims))})")


def _linked_cells(core: DataFrame, dims: int, side: float, eps: float) -> DataFrame:
    """Pairs of cells (a, b) with core points within ``eps`` of each other.

    Copies of a point count once. Boxes settle most pairs. Where they do not, a pair of parts with
    few points is compared point by point and any other is cut into quarters, until all are settled;
    parts end as single points, so every pair is.
    """
    steps = [s for s in _offsets(dims, side, eps) if s > [0] * dims]
    spots = cut(core.select("cell", "at").distinct())

    def side_of(boxes, name):
        return boxes.select(F.col("cell").alias(name), F.col("part").alias(f"{name}_part"),
                            F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"),
                            F.col("n").alias(f"{name}_n"))

    def ends(parted, name, at):
        return parted.select(F.col("cell").alias(name), F.col("part").alias(f"{name}_part"),
                             F.col("at").alias(at))

    level, slack, linked = 0, eps * 1e-12, None
    parted = spots.withColumn("part", _parts(side, 0))
    boxes = _boxes(parted, dims)
    pairs = side_of(boxes, "a").select("*", _around("a", steps).alias("b")).join(
        side_of(boxes, "b"), "b")
    while True:
        judged = cut(pairs.where(_gap(True, dims) <= eps + slack).select(
            "a", "b", "a_part", "b_part", (_gap(False, dims) <= eps - slack).alias("sure"),
            (F.col("a_n") * F.col("b_n") <= PAIR_POINTS).alias("few")))
        sure = judged.where("sure").select("a", "b").distinct()
        unsettled = judged.where(~F.col("sure")).join(sure, ["a", "b"], "left_anti")
        met = (unsettled.where("few").select("a", "b", "a_part", "b_part")
               .join(ends(parted, "a", "p"), ["a", "a_part"])
               .join(ends(parted, "b", "q"), ["b", "b_part"])
               .where(_distance("p", "q") <= eps).select("a", "b").distinct())
        found = sure.union(met)
        linked = cut(found if linked is None else linked.union(found))
        owners = cut(unsettled.where(~F.col("few")).join(linked, ["a", "b"], "left_anti").select(
            "a", "b", F.col("a_part").alias("a_up"), F.col("b_part").alias("b_up")))
        if owners.isEmpty():
            return linked.distinct()
        level += 1
        parted = spots.withColumn("part", _parts(side, level))
        finer = _boxes(parted, dims)
        a = side_of(finer, "a").withColumn("a_up", F.transform("a_part", lambda v: F.floor(v / 4)))
        b = side_of(finer, "b").withColumn("b_up", F.transform("b_part", lambda v: F.floor(v / 4)))
        pairs = owners.join(a, ["a", "a_up"]).join(b, ["b", "b_up"])


def dbscan(df: DataFrame, id_col: str, coords, eps: float | None = None,
           min_samples: int = DBSCAN_MIN_SAMPLES, name: str = "dbscan_cluster") -> DataFrame:
    """Density clusters: (id, is_core, cluster), noise being -1.

    Clusters are numbered by their smallest core id; a border point takes the lowest-numbered
    cluster it touches. Without ``eps`` the knee of the k-distance curve sets it.
    """
    if eps is None:
        eps = suggest_eps(distance_curve(k_distance(df, id_col, coords, min_samples))).first()[0]
    dims = len(coords)
    flagged, side, hot = _core_flags(df, id_col, coords, eps, min_samples)
    core = flagged.where("is_core")
    # A cell stands in the graph as its smallest core id, so a component is named by that id too.
    reps = core.groupBy("cell").agg(F.min("id").alias("rep"))
    links = _linked_cells(core, dims, side, eps)
    edges = (links.join(reps.select(F.col("cell").alias("a"), F.col("rep").alias("src")), "a")
             .join(reps.select(F.col("cell").alias("b"), F.col("rep").alias("dst")), "b")
             .select("src", "dst"))
    parts = components(edges, reps.select(F.col("rep").alias("id")))
    numbers = numbered(parts.select("component").distinct(), F.col("component"), name=name)
    cells = (reps.join(parts.withColumnRenamed("id", "rep"), "rep").join(numbers, "component")
             .select("cell", F.col(name).cast("int").alias(name)))
    core_labels = cut(core.join(cells, "cell"))
    border = eps_join(flagged.where(~F.col("is_core")).select("id", "at", "cell"), core_labels,
                      eps, dims, side, [name], hot).groupBy("id").agg(F.min(f"_{name}").alias(name))
    outside = flagged.where(~F.col("is_core")).join(border, "id", "left").select(
        "id", "is_core", F.coalesce(name, F.lit(-1)).alias(name))
    return core_labels.select("id", "is_core", name).union(outside)
