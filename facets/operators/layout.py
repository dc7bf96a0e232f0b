"""Two-dimensional maps that keep neighbourhoods: stochastic neighbour embedding by blocks.

Every distinct vector is pulled towards its nearest neighbours, by weights that give each row the
same effective number of them, and pushed away from all others. The pull of a row needs only its own
k neighbours, so no row of the neighbour table grows with its popularity. The push depends on where
the map is crowded: rows are counted on a grid of fixed size, the field of that grid is one
convolution, and all rows read it from a broadcast of bounded size.

Rows lie in blocks of neighbours on the starting map. A round sends each block the spots its rows
refer to, as one array from every other block, takes a few steps inside the block, and writes the new
spots, an array for each block. Rounds, not rows, decide the number of jobs. Counts on the grid are whole numbers and blocks depend on the data alone, so the map
does not depend on how the table is partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.operators.centers import share, stack
from facets.operators.features import map2d
from facets.operators.neighbors import BLOCK_ROWS, knn
from facets.operators.rows import with_index
from facets.session import cut, ship_package

PERPLEXITY = 35.0
ROUNDS = 20
# Steps inside a block between two exchanges.
STEPS = 12
GRID = 256
# A row counts as this many units on the grid, split among four corners.
_UNITS = 1 << 20
_RATE = 1 / 3
_MOMENTUM = 0.8
_LONGEST_STEP = 2.0


def pull_weights(distances: np.ndarray, perplexity: float) -> np.ndarray:
    """Gaussian weights over each row's neighbours whose entropy is that of ``perplexity`` ones.

    Rows of the result add up to one. With fewer neighbours than that the weights are equal.
    """
    gaps = distances ** 2
    gaps = gaps - gaps.min(axis=1, keepdims=True)
    wanted = math.log(min(perplexity, gaps.shape[1]))
    low, high = np.full(len(gaps), -40.0), np.full(len(gaps), 40.0)
    scale = np.maximum(gaps.mean(axis=1, keepdims=True), 1e-300)
    for _ in range(60):
        middle = (low + high) / 2
        weights = np.exp(-gaps / scale * np.exp(middle)[:, None])
        weights /= weights.sum(axis=1, keepdims=True)
        entropy = -(weights * np.log(np.maximum(weights, 1e-300))).sum(axis=1)
        wide = entropy > wanted
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return weights


def pulls(near: DataFrame, perplexity: float = PERPLEXITY) -> DataFrame:
    """(id, nbrs, pull) from ``knn``: neighbours in order, and their weights."""
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr", "dist")))
                                   .alias("near"))
    lists = lists.select("id", F.col("near.nbr").alias("nbrs"), F.col("near.dist").alias("dists"))

    def weigh(batches):
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[lo:lo + BLOCK_ROWS]
                yield pd.DataFrame({"id": part["id"], "nbrs": part["nbrs"], "pull": list(
                    pull_weights(stack(part["dists"]), perplexity))})

    key = dict(near.dtypes)["id"]
    ship_package(near.sparkSession)
    return lists.mapInPandas(weigh, f"id {key}, nbrs array<{key}>, pull array<double>")


class Frame:
    """A square grid over the map; rows are split among the four corners around them."""

    def __init__(self, low: np.ndarray, span: float, size: int):
        self.size, self.cell = size, max(span, 1e-9) / (size - 3)
        self.origin = low - self.cell

    def corners(self, spots: np.ndarray):
        """Cell numbers and shares, four for each row."""
        at = np.clip((spots - self.origin) / self.cell, 0, self.size - 1.001)
        base = at.astype(np.int64)
        part = at - base
        cells, shares = [], []
        for dx in (0, 1):
            for dy in (0, 1):
                cells.append((base[:, 0] + dx) * self.size + base[:, 1] + dy)
                shares.append(np.abs(1 - dx - part[:, 0]) * np.abs(1 - dy - part[:, 1]))
        return np.stack(cells, 1), np.stack(shares, 1)

    def field(self, counts: np.ndarray) -> np.ndarray:
        """The push at every grid point, from how many rows each holds: (size * size, 2).

        A push is the sum over all rows of q^2 times their difference, over the mean of q, where q
        is 1 / (1 + d^2).
        """
        n, size = counts.sum(), self.size
        offset = np.fft.fftfreq(2 * size, 1 / (2 * size)) * self.cell
        q = 1 / (1 + offset[:, None] ** 2 + offset[None] ** 2)
        held = np.fft.rfft2(counts.reshape(size, size), (2 * size, 2 * size))

        def spread(kernel):
            return np.fft.irfft2(held * np.fft.rfft2(kernel))[:size, :size].ravel()

        mean = max((counts * spread(q)).sum() - n, 1e-9) / n
        push = [spread(q * q * offset[:, None]), spread(q * q * offset[None])]
        return np.stack(push, 1) / mean


def _frame(spots: DataFrame, size: int) -> Frame:
    x0, x1, y0, y1 = spots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return Frame(np.array([x0, y0]), max(x1 - x0, y1 - y0), size)


def _counts(spots: DataFrame, frame: Frame) -> np.ndarray:
    """Rows on each grid point; the driver gets at most one number per point."""
    def deposit(batches):
        units = np.zeros(frame.size ** 2, np.int64)
        for batch in batches:
            cells, shares = frame.corners(batch[["x", "y"]].to_numpy())
            np.add.at(units, cells, np.rint(shares * _UNITS).astype(np.int64))
        held = np.flatnonzero(units)
        yield pd.DataFrame({"cell": held, "units": units[held]})

    found = spots.select("x", "y").mapInPandas(deposit, "cell long, units long")
    counts = np.zeros(frame.size ** 2)
    for r in found.groupBy("cell").agg(F.sum("units").alias("units")).collect():
        counts[r["cell"]] = r["units"] / _UNITS
    return counts


def _packed(key, nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: where its rows and their neighbours stand among the spots sent to it."""
    nodes = nodes.sort_values("id")
    ids = np.concatenate(wanted.sort_values("source")["ids"].to_numpy())
    order = np.argsort(ids, kind="stable")

    def place(wanted_ids):
        return order[np.searchsorted(ids, wanted_ids, sorter=order)].astype("i4")

    near = place(np.stack(nodes["nbrs"].to_numpy()))
    # A neighbour's rank is the slow axis, so that steps add up whole columns of rows.
    return pd.DataFrame({"block": [key[0]], "mine": [place(nodes["id"].to_numpy())],
                         "near": [near.T.ravel()], "pull": [stack(nodes["pull"]).T.ravel()]})


def _stepper(shared, steps: int):
    """Move the rows of a block; rows of other blocks stay where the round found them."""
    def move(key, block: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        frame, field = shared.value
        sent = sent.sort_values("source")
        x, y = (np.concatenate(sent[c].to_numpy()).astype("f8") for c in ("x", "y"))
        mine, near, pull, vx, vy = (block[c].iloc[0] for c in ("mine", "near", "pull", "vx", "vy"))
        near, pull = near.reshape(-1, len(mine)), pull.reshape(-1, len(mine))
        speed = np.stack([vx, vy], 1)
        for _ in range(steps):
            here = np.stack([x[mine], y[mine]], 1)
            gap_x, gap_y = here[:, 0] - x[near], here[:, 1] - y[near]
            weight = pull / (1 + (gap_x ** 2 + gap_y ** 2))
            pulled = np.stack([(weight * gap_x).sum(axis=0), (weight * gap_y).sum(axis=0)], 1)
            cells, shares = frame.corners(here)
            pushed = (field[cells] * shares[:, :, None]).sum(axis=1)
            speed = _MOMENTUM * speed - _RATE * (pulled - pushed)
            length = np.sqrt((speed ** 2).sum(axis=1, keepdims=True))
            speed = speed * np.minimum(1, _LONGEST_STEP / np.maximum(length, 1e-300))
            x[mine], y[mine] = (here + speed).T
        return pd.DataFrame({"block": [key[0]], "x": [x[mine]], "y": [y[mine]],
                             "vx": [speed[:, 0]], "vy": [speed[:, 1]]})
    return move


def _blocks(start: DataFrame, n: int) -> DataFrame:
    """(id, block, x, y, vx, vy): the starting map, scaled, in blocks of neighbours.

    Rounding takes away what the order of sums left in the components.
    """
    spread = start.agg(F.stddev_pop("map_x")).first()[0] or 1.0
    scaled = cut(start.select("id", F.round(F.col("map_x") / spread, 6).alias("x"),
                              F.round(F.col("map_y") / spread, 6).alias("y")))
    low, high = scaled.agg(F.min("y"), F.max("y")).first()
    height = max(high - low, 1e-6) / math.ceil(math.sqrt(n / BLOCK_ROWS))
    ordered = with_index(scaled, F.floor((F.col("y") - low) / height), F.col("x"), F.col("id"))
    still = F.lit(0.0)
    return ordered.select("id", F.floor(F.col("idx") / BLOCK_ROWS).alias("block"), "x", "y",
                          still.alias("vx"), still.alias("vy"))


def neighbor_map(df: DataFrame, id_col: str, vec_col: str, perplexity: float = PERPLEXITY,
                 k: int | None = None, rounds: int = ROUNDS, steps: int = STEPS,
                 grid: int = GRID, **search) -> DataFrame:
    """Map coordinates (id, map_x, map_y) of all rows; rows with the same vector share a spot.

    ``perplexity`` is the effective number of neighbours that pull a row, ``k`` (None: three times
    as many) the number looked at. ``rounds`` times ``steps`` is the number of steps. ``search``
    goes to ``knn``: its method, cells and probes. Coordinates are only defined up to the choice of
    the starting map, which is the first two principal components. Fewer than three distinct
    vectors lie on their starting map; null vectors get null coordinates.
    """
    rows = cut(df.select(F.col(id_col).alias("id"),
                         F.col(vec_col).cast("array<double>").alias("vec")))
    reps = cut(rows.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.min("id").alias("id")))
    n = reps.count()
    if n < 3:
        one = F.lit(0.0).alias("map_x"), F.lit(0.0).alias("map_y")
        spots = reps.select("id", *one) if n < 2 else map2d(reps, "vec").select(
            "id", "map_x", F.coalesce("map_y", F.lit(0.0)).alias("map_y"))
    else:
        spots = _settle(reps, n, perplexity, k or math.ceil(3 * perplexity), rounds, steps, grid,
                        search)
    placed = reps.join(spots, "id").select("vec", "map_x", "map_y")
    return rows.join(placed, "vec", "left").select("id", "map_x", "map_y")


def _settle(reps: DataFrame, n: int, perplexity: float, k: int, rounds: int, steps: int,
            grid: int, search: dict) -> DataFrame:
    # One-dimensional vectors have no second component.
    start = cut(map2d(reps, "vec").select(
        "id", "map_x", F.coalesce("map_y", F.lit(0.0)).alias("map_y")))
    spots = cut(_blocks(start, n))
    near = pulls(knn(reps, "id", "vec", min(k, n - 1), **search), perplexity)
    nodes = cut(near.join(spots.select("id", "block"), "id"))
    # From here on a block is one row, its rows in the order of their ids.
    listed = F.sort_array(F.collect_list(F.struct("id", "x", "y", "vx", "vy")))
    state = cut(spots.groupBy("block").agg(listed.alias("_rows")).select(
        "block", *[F.col(f"_rows.{c}").alias(c) for c in ("id", "x", "y", "vx", "vy")]))
    members, state = state.select("block", "id"), state.drop("id")
    held = members.select(F.col("block").alias("source"), F.posexplode("id").alias("place", "id"))
    # A spot is sent to each block that refers to it, once; between two blocks they go as one row.
    wanted = (nodes.select("block", F.explode(F.concat("nbrs", F.array("id"))).alias("id")).distinct()
              .join(held, "id").groupBy("block", "source")
              .agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("_rows")))
    wanted = cut(wanted.select("block", "source", F.col("_rows.place").alias("places"),
                               F.col("_rows.id").alias("ids")))
    blocks = cut(nodes.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(
        _packed, "block long, mine array<int>, near array<int>, pull array<double>"))
    for _ in range(rounds):
        rows = state.select(F.inline(F.arrays_zip("x", "y")))
        frame = _frame(rows, grid)
        shared = share(state, (frame, frame.field(_counts(rows, frame))))
        at = state.select(F.col("block").alias("source"), "x", "y")
        sent = wanted.join(at, "source").select("block", "source", *[
            F.expr(f"transform(places, p -> get({c}, p))").alias(c) for c in ("x", "y")])
        moving = blocks.join(state.select("block", "vx", "vy"), "block")
        state = cut(moving.groupBy("block").cogroup(sent.groupBy("block"))
                    .applyInPandas(_stepper(shared, steps), state.schema))
        shared.unpersist()
    return members.join(state, "block").select(
        F.inline(F.arrays_zip("id", F.col("x").alias("map_x"), F.col("y").alias("map_y"))))


def neighborhood_kept(df: DataFrame, id_col: str, vec_col: str, coords=("map_x", "map_y"),
                      k: int = 10, **search) -> DataFrame:
    """Mean share of each row's ``k`` nearest rows that are among its ``k`` nearest on the map."""
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                         F.array(*[F.col(c).cast("double") for c in coords]).alias("spot")))
    near = knn(rows, "id", "vec", k, **search).select("id", "nbr", F.lit(1).alias("kept"))
    seen = knn(rows, "id", "spot", k, **search).select("id", "nbr")
    return seen.join(near, ["id", "nbr"], "left").agg(
        (F.count("kept") / F.count("*")).alias("kept"))
