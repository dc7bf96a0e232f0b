"""Nearest neighbours (exact, or through trained cells), distance curves and silhouettes.

Vectors meet in pairs of blocks of about ``BLOCK_ROWS`` rows. A block pair is one task-sized unit of
work whose distances stay inside a numpy call; only each row's best candidates, or one sum per row
and label, come out of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facets.constants import DBSCAN_MIN_SAMPLES, FINAL_SAMPLE, GRAPH_NEIGHBORS, SEED
from facets.operators.centers import assign_nearest, exact, fit_many, share, squares, stack
from facets.operators.rows import draw, sample_exact, with_index
from facets.session import attach, cut, ship_package

BLOCK_ROWS = 2000
MAX_PIVOTS = 1024
# Held blocks grow to so many times BLOCK_ROWS or so many bytes, asking blocks to a part of that;
# small tables are spread over so many blocks of either side.
MOST_BLOCKS, ASKING_SHARE, SPREAD = 32, 2, 8
_HELD_BYTES = 1 << 25
# Distances held at once.
_CELLS = 1 << 23
# Trained cells: lists looked through for a point, rows a cell learns from, passes over them.
PROBES = 16
TRAIN_ROWS = 256
TRAIN_PASSES = 10


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances, recomputed from differences where the expanded square would lose digits."""
    gaps = squares(a, b)
    row, col = np.nonzero(
        gaps < 1e-4 * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None]))
    out = np.sqrt(gaps)
    for lo in range(0, len(row), 65_536):
        r, c = row[lo:lo + 65_536], col[lo:lo + 65_536]
        out[r, c] = exact(a[r], b[c])
    return out


def _pairs(left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel`` (Arrow tables) on every left and right block that agree in (cell, lb, rb)."""
    keys = ["cell", "lb", "rb"]
    # Both sides may stem from one table; fresh names keep their columns apart.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    ship_package(left.sparkSession)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow table as rows of a matrix."""
    flat = pc.list_flatten(column).combine_chunks()
    return np.asarray(flat.to_numpy(zero_copy_only=False), "f8").reshape(len(column), -1)


def block_rows(n: int, width: int) -> tuple[int, int]:
    """Rows of an asking and of a held block for ``n`` rows of vectors of ``width`` numbers.

    Every row is copied once for each block of the other side, so blocks grow with the table, up to
    a bound in bytes.
    """
    most = max(1, min(MOST_BLOCKS, _HELD_BYTES // (8 * max(1, width) * BLOCK_ROWS)))
    grown = max(BLOCK_ROWS, n // SPREAD)
    return (min(max(1, most // ASKING_SHARE) * BLOCK_ROWS, grown), min(most * BLOCK_ROWS, grown))


def meet(routed: DataFrame, cells: DataFrame, size, width: int, kernel, schema: str) -> DataFrame:
    """Let every asking row meet all rows of the cells it was sent to, a pair of blocks at a time.

    ``routed`` has the asking rows with the array ``cells`` of cells to look through, ``cells`` the
    held rows with their ``cell``; both have a key ``rep``, and ``size`` counts each cell's rows.
    Where rows have to look through most cells anyway, small cells are bundled, so that a row is
    copied for few large blocks and not for every cell.
    """
    size = np.asarray(size, "i8")
    asked, n = np.zeros(len(size) + 1, "i8"), int(size.sum())
    # One row per cell; the one past the last counts the asking rows.
    everywhere = F.explode(F.concat("cells", F.array(F.lit(len(size)))))
    for r in routed.select(everywhere.alias("cell")).groupBy("cell").count().collect():
        asked[r["cell"]] = r["count"]
    asked, n_asking = asked[:-1], int(asked[-1])
    ask_rows, held_rows = block_rows(n, width)
    bundle = np.arange(len(size))
    if asked.sum() > n_asking * np.count_nonzero(size) / 2:
        bundle = (np.cumsum(size) - size) // held_rows
        asked = np.where(np.bincount(bundle, asked) > 0, n_asking, 0)
        size = np.bincount(bundle, size).astype("i8")
        place = F.array(*[F.lit(int(x)).cast("int") for x in bundle])
        routed = routed.withColumn("cells", F.array_distinct(F.transform(
            "cells", lambda c: F.get(place, c))))
        cells = cells.withColumn("cell", F.get(place, F.col("cell")))
    blocks = routed.sparkSession.createDataFrame(
        [(c, math.ceil(asked[c] / ask_rows), math.ceil(size[c] / held_rows))
         for c in range(len(size)) if size[c] and asked[c]],
        "cell int, n_lb int, n_rb int")  # one row per cell
    asking = routed.withColumn("cell", F.explode("cells")).drop("cells")
    return _pairs(_split(asking.join(F.broadcast(blocks), "cell"), "lb", "rb", 1),
                  _split(cells.join(F.broadcast(blocks), "cell"), "rb", "lb", 2), kernel, schema)


def _distinct_points(points: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: smallest id, and its ``k`` smallest ids in order.

    However many copies a vector has, Spark trims them to k per input partition before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return (points.withColumn("_r", rank).where(F.col("_r") <= k)
            .groupBy("vec").agg(F.min("id").alias("rep"),
                                F.sort_array(F.collect_list("id")).alias("ids")))


def closest(a: np.ndarray, b: np.ndarray, k: int):
    """(row, column, distance): for each row of ``a`` what may be its ``k`` nearest rows of ``b``.

    Distances are exact; a row may have more than ``k`` columns, in no order. Squares in single
    precision, with both lengths folded into the product, choose the candidates: the smallest of
    some columns bounds what is worth measuring, give or take the rounding of the product.
    """
    kept = min(k, len(b))
    middle = b.mean(axis=0)
    if not np.isfinite(middle).all():
        middle = 0.0
    x, y = a - middle, b - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    scale = math.sqrt(max(xx.max(), yy.max())) or 1.0
    single = math.isfinite(scale)
    if single:
        x, y, xx, yy = x / scale, y / scale, xx / scale ** 2, yy / scale ** 2
        left = np.hstack([x, xx[:, None], np.ones((len(x), 1))]).astype("f4")
        right = np.hstack([-2 * y, np.ones((len(y), 1)), yy[:, None]]).astype("f4")
        error = 4 * (x.shape[1] + 8) * np.finfo("f4").eps * (xx + yy.max()) + 1e-30
    folds = max(1, len(b) // max(16 * kept, 512))
    step, found = max(1, _CELLS // len(b)), []
    for lo in range(0, len(a), step):
        at = slice(lo, lo + step)
        hit = None
        if single:
            approx = left[at] @ right.T
            few = len(b) // folds
            least = approx[:, :few * folds].reshape(len(approx), folds, few).min(axis=1)
            bound = np.partition(least, kept - 1, axis=1)[:, kept - 1] + error[at]
            hit = np.flatnonzero(approx <= bound[:, None].astype("f4"))
        if hit is None or len(hit) > 8 * kept * len(approx) + 4096:
            # Too close together for single precision: full lengths, a sliver of rounding.
            approx = squares(x[at], y)
            bound = np.partition(approx, kept - 1, axis=1)[:, kept - 1]
            hit = np.flatnonzero(approx <= (bound + 1e-9 * (xx[at] + yy.max()))[:, None])
        row, col = np.divmod(hit, len(b))
        found.append((row + lo, col, exact(a[row + lo], b[col])))
    return tuple(map(np.concatenate, zip(*found)))


def _candidate_kernel(k: int):
    """Of a member block, the ids and distances of the ``k`` nearest of each query, in order."""
    def kernel(queries: pa.Table, members: pa.Table) -> pa.Table:
        names, kind = ["rep", "dists", "nbrs"], queries.schema.field("rep").type
        if not len(queries) or not len(members):
            return pa.table([pa.array([], kind), pa.array([], pa.list_(pa.float64())),
                             pa.array([], pa.list_(kind))], names)
        members = members.sort_by("rep")
        row, col, dist = closest(matrix(queries["vec"]), matrix(members["vec"]), k)
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, dist = row[near], col[near], dist[near]
        copies = pc.list_value_length(members["ids"]).to_numpy()
        ids = pc.list_flatten(members["ids"]).combine_chunks()
        if len(ids) == len(copies):
            pick = col
        else:
            # A vector offers all its ids; at one distance the smaller id comes first.
            starts, times = np.cumsum(copies) - copies, copies[col]
            pick = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pick += np.repeat(starts[col], times)
            row, dist = np.repeat(row, times), np.repeat(dist, times)
            place = np.empty(len(ids), "i8")
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            order = np.lexsort((place[pick], dist, row))
            row, dist, pick = row[order], dist[order], pick[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, dist, pick = row[near], dist[near], pick[near]
        ends = pa.array(np.searchsorted(row, np.arange(len(queries) + 1)), pa.int32())
        return pa.table([queries["rep"].combine_chunks(),
                         pa.ListArray.from_arrays(ends, pa.array(dist)),
                         pa.ListArray.from_arrays(ends, ids.take(pa.array(pick)))], names)
    return kernel


def _pivots(reps: DataFrame, n: int) -> np.ndarray:
    count = max(1, min(MAX_PIVOTS, math.ceil(n / BLOCK_ROWS)))
    chosen = reps.select(F.col("rep"), "vec").orderBy(draw("rep", SEED), "rep").limit(count)
    return np.array([row["vec"] for row in chosen.collect()], "f8")


def _cell_bounds(cells: DataFrame, n_cells: int, k: int):
    """Per cell: rows, radius, and the k smallest distances from its pivot to its rows."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("cell_dist"))
    near = (cells.select("cell", "cell_dist").withColumn("_r", rank).where(F.col("_r") <= k)
            .groupBy("cell").agg(F.sort_array(F.collect_list("cell_dist")).alias("near")))
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("cell_dist").alias("radius"))
    size, radius = np.zeros(n_cells, "i8"), np.full(n_cells, -np.inf)
    nearest = np.full((n_cells, k), np.inf)
    for row in stats.join(near, "cell").collect():  # one row per pivot
        size[row["cell"]], radius[row["cell"]] = row["n"], row["radius"]
        nearest[row["cell"], :len(row["near"])] = row["near"]
    return size, radius, nearest


def _route(cells: DataFrame, pivots, radius, nearest, k: int) -> DataFrame:
    """(rep, vec, cells): the cells that can hold one of a point's k nearest, by triangle inequality.

    Distance to pivot plus a row's distance from that pivot bounds the distance to the row, so the
    k-th smallest such sum over all cells bounds the k-th neighbour. A cell farther than that, minus
    its radius, cannot contribute.
    """
    shared = share(cells, (pivots, radius, nearest))

    def send(batches):
        pivots, radius, nearest = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo:lo + 256]
                to_pivot = np.sqrt(squares(stack(part["vec"]), pivots))
                sums = (to_pivot[:, :, None] + nearest[None]).reshape(len(part), -1)
                reach = np.partition(sums, k - 1, axis=1)[:, k - 1] if sums.shape[1] >= k \
                    else np.full(len(part), np.inf)
                slack = 1e-6 * (1 + to_pivot)
                row, cell = np.nonzero(to_pivot - radius[None] <= reach[:, None] + slack)
                yield part.assign(cells=np.split(
                    cell.astype("i4"), np.searchsorted(row, np.arange(1, len(part)))))

    key = dict(cells.dtypes)["rep"]
    ship_package(cells.sparkSession)
    return cells.select("rep", "vec").mapInPandas(
        send, f"rep {key}, vec array<double>, cells array<int>")


def _train_cells(reps: DataFrame, n_cells: int, seed: int) -> np.ndarray:
    """Centres of ``n_cells`` cells, fitted on ``TRAIN_ROWS`` rows a cell at most."""
    rows = sample_exact(reps.select("rep", "vec"), TRAIN_ROWS * n_cells, seed, "rep")
    return fit_many(rows, "vec", [(n_cells, seed)], TRAIN_PASSES, "rep")[0].centers


def _probe(cells: DataFrame, centers: np.ndarray, held: np.ndarray, need: int,
           probes: int) -> DataFrame:
    """(rep, vec, cells): the ``probes`` nearest lists, and further ones until they hold ``need`` rows."""
    shared = share(cells, (centers, held))

    def send(batches):
        centers, held = shared.value
        few = min(probes, len(centers))
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo:lo + 256]
                gaps = squares(stack(part["vec"]), centers)
                chosen = np.zeros(gaps.shape, bool)
                near = np.argpartition(gaps, few - 1, axis=1)[:, :few]
                np.put_along_axis(chosen, near, True, axis=1)
                for short in np.flatnonzero(held[near].sum(axis=1) < need):
                    order = np.argsort(gaps[short], kind="stable")
                    reach = np.searchsorted(np.cumsum(held[order]), need) + 1
                    chosen[short, order[:reach]] = True
                row, cell = np.nonzero(chosen)
                yield part.assign(cells=np.split(
                    cell.astype("i4"), np.searchsorted(row, np.arange(1, len(part)))))

    key = dict(cells.dtypes)["rep"]
    ship_package(cells.sparkSession)
    return cells.select("rep", "vec").mapInPandas(
        send, f"rep {key}, vec array<double>, cells array<int>")


def _split(df: DataFrame, mine: str, other: str, salt: int) -> DataFrame:
    """Spread each cell's rows over its own blocks and copy them to every block of the other side.

    The ``_blocks`` table gives both block counts of a cell.
    """
    hashed = F.xxhash64(F.lit(salt), "rep")
    return (df.withColumn(mine, F.pmod(hashed, F.col(f"n_{mine}")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
            .drop("n_lb", "n_rb"))


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = GRAPH_NEIGHBORS,
        include_self: bool = False, method: str = "exact", n_cells: int | None = None,
        probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """``k`` nearest neighbours by Euclidean distance: (id, rank, nbr, dist).

    Ties go to the smaller id. Copies of a vector are searched once, and large cells are split into
    blocks on both sides, so no task holds a whole cell.

    ``method="exact"``: pivot cells and the triangle inequality decide which blocks a point has to
    meet. Every point is compared with all blocks that could matter: nothing is approximated.

    ``method="cells"``: inverted lists over ``n_cells`` trained cells (None: the square root of the
    number of distinct vectors). Every point looks through its ``probes`` nearest lists, and through
    further ones until they hold enough rows for ``k`` neighbours. Work is the rows of the probed
    lists; recall grows with ``probes``, and all lists give the exact result. The method is the
    caller's choice and never changes with the size of the table.
    """
    if method not in ("exact", "cells"):
        raise ValueError(f"unknown method: {method}")
    spark = df.sparkSession
    need = k if include_self else k + 1
    points = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    reps = cut(_distinct_points(points, need))
    n = reps.count()
    if n == 0:
        return points.select("id", F.lit(0).alias("rank"), F.col("id").alias("nbr"),
                             F.lit(0.0).alias("dist"))
    if method == "cells":
        centers = _train_cells(reps, min(n, n_cells or math.ceil(math.sqrt(n))), seed)
        cells = cut(assign_nearest(reps, centers))
        size, held = np.zeros(len(centers), "i8"), np.zeros(len(centers), "i8")
        for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias(
                "held")).collect():  # one row per cell
            size[r["cell"]], held[r["cell"]] = r["n"], r["held"]
        routed = cut(_probe(cells, centers, held, need, probes))
    else:
        centers = _pivots(reps, n)
        cells = cut(assign_nearest(reps, centers))
        size, radius, nearest = _cell_bounds(cells, len(centers), need)
        routed = cut(_route(cells, centers, radius, nearest, need))
    key = dict(reps.dtypes)["rep"]
    found = meet(routed, cells.select("rep", "vec", "ids", "cell"), size, centers.shape[1],
                 _candidate_kernel(need), f"rep {key}, dists array<double>, nbrs array<{key}>")
    offers = F.flatten(F.collect_list(F.arrays_zip(
        F.col("dists").alias("dist"), F.col("nbrs").alias("nbr"))))
    best = found.groupBy("rep").agg(F.slice(F.sort_array(offers), 1, need).alias("near"))
    with_near = reps.select("rep", "vec", F.size("ids").alias("_copies")).join(best, "rep")
    if reps.where(F.size("ids") > 1).isEmpty():
        owners = with_near.select(F.col("rep").alias("id"), "near")
    else:
        # A vector with very many copies is a skewed key of `points`; adaptive execution splits it.
        owners = points.join(with_near, "vec").select("id", "near")
    others = F.col("near") if include_self else F.filter(
        "near", lambda p: p["nbr"] != F.col("id"))
    return (owners.select("id", F.posexplode(F.slice(others, 1, k)).alias("_at", "_p"))
            .select("id", (F.col("_at") + 1).alias("rank"), F.col("_p.nbr").alias("nbr"),
                    F.col("_p.dist").alias("dist")))


def k_distance(df: DataFrame, id_col: str, coords, k: int = DBSCAN_MIN_SAMPLES,
               **search) -> DataFrame:
    """Distance of every point to its k-th neighbour, itself being the first: (id, dist).

    ``search`` goes to ``knn``: its method, cells and probes.
    """
    vec = df.select(F.col(id_col).alias("id"),
                    F.array(*[F.col(c).cast("double") for c in coords]).alias("vec"))
    near = knn(vec, "id", "vec", k, include_self=True, **search)
    return near.where(F.col("rank") == k).select("id", "dist")


def distance_curve(distances: DataFrame, block: int = 100_000) -> DataFrame:
    """Distances in falling order with the second derivative of the scaled curve: (idx, dist, d2).

    The curve is scaled to [0, 1] both ways; derivatives are central, one-sided at the ends. Rows
    are numbered without a global sort in one task, and looked at in stretches that overlap by two.
    """
    curve = with_index(distances.select("id", "dist"), F.desc("dist"), F.col("id"))
    n, low, high = curve.agg(F.count("*"), F.min("dist"), F.max("dist")).first()
    if n < 2:
        return curve.select("idx", "dist", F.lit(0.0).alias("d2"))
    step = 1.0 / (n - 1)
    at = F.floor(F.col("idx") / block)
    stretches = F.array_distinct(F.array(at, F.floor((F.col("idx") - 2) / block),
                                         F.floor((F.col("idx") + 2) / block)))
    halo = (curve.withColumn("y", (F.col("dist") - low) / F.lit(high - low + 1e-9))
            .withColumn("_block", F.explode(stretches)))
    order = Window.partitionBy("_block").orderBy("idx")

    def slope(value: str):
        before, after = F.lag(value).over(order), F.lead(value).over(order)
        return (F.when(F.col("idx") == 0, (after - F.col(value)) / step)
                .when(F.col("idx") == n - 1, (F.col(value) - before) / step)
                .otherwise((after - before) / (2 * step)))

    return (halo.withColumn("_g", slope("y")).withColumn("d2", slope("_g"))
            .where(F.col("_block") == at).select("idx", "dist", "d2"))


def suggest_eps(curve: DataFrame) -> DataFrame:
    """Knee of the curve: the first index in its first half where the bend is largest."""
    half = curve.agg(F.floor(F.count("*") / 2)).scalar()
    return (curve.where(F.col("idx") < half)
            .agg(F.max(F.struct("d2", -F.col("idx"), "dist")).alias("_m"))
            .select(F.col("_m.dist").alias("eps"), (-F.col("_m.col2")).alias("idx")))


def _spread_kernel(rows: pa.Table, others: pa.Table) -> pa.Table:
    """Sum of distances from every row to the rows of each label in the other block.

    ``labels`` holds one label per grouping; distances serve all groupings.
    """
    out, key = [], rows.schema.field("rep").type
    if len(rows) and len(others):
        a, b = matrix(rows["vec"]), matrix(others["vec"])
        mine, theirs = (np.stack(t["labels"].to_pandas().to_numpy()) for t in (rows, others))
        found = [np.unique(theirs[:, g], return_inverse=True) for g in range(theirs.shape[1])]
        totals = [np.zeros((len(a), len(labels))) for labels, _ in found]
        for to in range(0, len(b), BLOCK_ROWS):
            part = slice(to, to + BLOCK_ROWS)
            members = [np.equal.outer(at[part], np.arange(len(labels))).astype("f8")
                       for labels, at in found]
            for lo in range(0, len(a), 256):
                gap = _distances(a[lo:lo + 256], b[part])
                for total, member in zip(totals, members):
                    total[lo:lo + 256] += gap @ member
        reps = rows["rep"].combine_chunks()
        for g, ((labels, _), total) in enumerate(zip(found, totals)):
            out.append(pa.table({
                "rep": reps.take(pa.array(np.repeat(np.arange(len(a)), len(labels)))),
                "grouping": pa.array(np.full(total.size, g), pa.int32()),
                "label": pa.array(np.repeat(mine[:, g], len(labels)), pa.int32()),
                "other": pa.array(np.tile(labels, len(a)), pa.int32()), "total": total.ravel()}))
    return pa.concat_tables(out) if out else pa.schema(
        [("rep", key), ("grouping", pa.int32()), ("label", pa.int32()), ("other", pa.int32()),
         ("total", pa.float64())]).empty_table()


def silhouette_rows(df: DataFrame, id_col: str, vec_col: str, labels,
                    sample: int | None = FINAL_SAMPLE, seed: int = SEED) -> DataFrame:
    """Euclidean silhouette of every sampled row under each grouping: (id, grouping, label,
    silhouette), ``grouping`` being the position in ``labels``.

    A row alone in its cluster scores 0. Without a sample every row meets every other one.
    """
    rows = cut(sample_exact(
        df.select(F.col(id_col).alias("rep"), F.col(vec_col).cast("array<double>").alias("vec"),
                  F.array(*[F.col(c).cast("int") for c in labels]).alias("labels")),
        sample, seed, "rep"))
    sizes = (rows.select(F.posexplode("labels").alias("grouping", "other"))
             .groupBy("grouping", "other").agg(F.count("*").alias("size")))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    ask_rows, held_rows = block_rows(n, width)
    # A row answers with a sum for each label.
    ask_rows = min(ask_rows, max(BLOCK_ROWS, _CELLS // max(1, sizes.count())))
    placed = rows.withColumns({"cell": F.lit(0), "n_lb": F.lit(max(1, math.ceil(n / ask_rows))),
                               "n_rb": F.lit(max(1, math.ceil(n / held_rows)))})
    key = dict(rows.dtypes)["rep"]
    sums = _pairs(_split(placed, "lb", "rb", 1), _split(placed, "rb", "lb", 2), _spread_kernel,
                  f"rep {key}, grouping int, label int, other int, total double")
    per_label = sums.groupBy("rep", "grouping", "label", "other").agg(F.sum("total").alias("total"))
    own = F.col("label") == F.col("other")
    means = attach(per_label, sizes, ["grouping", "other"]).groupBy("rep", "grouping", "label").agg(
        F.max(F.when(own, F.col("size"))).alias("_size"),
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    score = F.coalesce(F.when(F.col("_size") > 1, F.try_divide(
        F.col("b") - F.col("a"), F.greatest("a", "b"))), F.lit(0.0))
    return means.select(F.col("rep").alias("id"), "grouping", "label", score.alias("silhouette"))


def silhouettes(df: DataFrame, id_col: str, vec_col: str, labels,
                sample: int | None = FINAL_SAMPLE, seed: int = SEED) -> DataFrame:
    """Mean silhouette of each grouping, all from one pass over the pairs of blocks."""
    return silhouette_rows(df, id_col, vec_col, labels, sample, seed).groupBy("grouping").agg(
        F.avg("silhouette").alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vec_col: str, label: str,
               sample: int | None = FINAL_SAMPLE, seed: int = SEED,
               method: str = "euclidean") -> DataFrame:
    """Mean silhouette: one row; null with fewer than two clusters under ``squared``.

    ``euclidean`` compares the rows of the sample with each other. ``squared`` takes squared
    distances, whose means follow from one sum of vectors per cluster, so all rows count.
    """
    if method == "euclidean":
        return silhouettes(df, id_col, vec_col, [label], sample, seed).select("silhouette")
    if method != "squared":
        raise ValueError(f"unknown method: {method}")
    rows = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                     F.col(label).cast("double").alias("prediction"))
    found = None
    if rows.select("prediction").distinct().limit(2).count() == 2:
        found = float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows))
    return df.sparkSession.createDataFrame([(found,)], "silhouette double")
