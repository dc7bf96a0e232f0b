"""Ward's tree over single rows, grown by merging all mutual nearest pairs at once.

Ward's distance can only grow when other groups merge. So two groups that are each other's nearest
may merge at once, wherever else merges happen, and the merges found are those of the sequential
tree; cutting it at k groups takes back the k - 1 highest.

For the same reason a list of all pairs that cost at most some reach stays whole while groups merge:
a new group can only be that near to a group to which one of its parts was that near. So a pass over
the pairs of blocks lists the pairs up to a reach, drawn from a sample so that their number is
bounded, and one task merges along the list until no pair within reach is left. Fewer groups and a
larger reach make the next pass. Groups lie in blocks by nearest pivot, and pieces of blocks that are
farther apart than the reach are left out. The last groups that fit one block make their passes in
one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import SEED
from facets.operators import neighbors
from facets.operators.centers import few_at_once, share, squares
from facets.operators.neighbors import matrix
from facets.operators.rows import with_index
from facets.session import cut, ship_package

# Most groups of a block; below this many groups the rest of the tree is made in one place.
BLOCK_ROWS = 32_000
LAST_GROUPS = 2_000
# Groups whose distances to all others choose a reach, and the pairs it shall leave to a group; most
# pairs that are listed, and bytes of the groups in them, as one task holds these.
ASKED, NEAR = 512, 16
MOST_LINKS = 3 << 20
_LINKED_BYTES = 5 << 25
# Groups in a piece of a block, and its bytes where it travels as one row; distances held at once.
_PIECE = 2048
_PIECE_BYTES = 1 << 20
_CELLS = 1 << 22
_STEP = 1 << 14
# Slack of the bounds, which the expanded square computes with a rounding error.
_SLACK = 1e-9
_LINK = "hi long, lo long, d double"
# Sums of groups travel as bytes.
_MERGED = "a long, b long, parent long, height double, n double, total binary"


def _cost(gap, n, m):
    """Variance that a merge adds, from the squared distance of the centres and both sizes."""
    return gap * (n * m / (n + m))


def _exact(x, n, row, y, m, col):
    """Costs of pairs of rows of two blocks, from sums and sizes."""
    out = np.empty(len(row))
    for lo in range(0, len(row), _STEP):
        r, c = row[lo:lo + _STEP], col[lo:lo + _STEP]
        gap = ((x[r] / n[r, None] - y[c] / m[c, None]) ** 2).sum(axis=-1)
        out[lo:lo + _STEP] = _cost(gap, n[r], m[c])
    return out


def _pieces(centre, n, size):
    """(rows, middle, radius, least size) of the pieces of a block."""
    out = []
    for lo in range(0, len(n), size):
        at = slice(lo, lo + size)
        middle = centre[at].mean(axis=0)
        out.append((at, middle, math.sqrt(((centre[at] - middle) ** 2).sum(axis=1).max()),
                    n[at].min()))
    return out


def _apart(middle, radius, least, others, radii, leasts, reach):
    """Whether no pair of two pieces, or blocks, costs ``reach`` or less."""
    gap = np.sqrt(((others - middle) ** 2).sum(axis=-1))
    size = np.sqrt((middle ** 2).sum()) + np.sqrt((others ** 2).sum(axis=-1))
    return gap - radius - radii > (
        np.sqrt(reach * (1 / least + 1 / leasts)) + 1e-6 * (size + radius + radii))


def _folded(y, near, unit: float):
    """(middle, side of the product, longest) of a piece, for ``_candidates``."""
    middle = y.mean(axis=0)
    gap = y - middle
    yy = (gap * gap).sum(axis=1)
    side = np.hstack([gap * (-2 / math.sqrt(unit)), np.ones((len(y), 1)),
                      ((yy - near) / unit)[:, None]])
    return middle, side.astype("f4"), yy.max() + near.max()


def _candidates(x, near, y, other_near, folded, unit: float):
    """(row, column) of what may have a squared distance of at most the sum of both bounds.

    The bounds and both lengths are folded into one product in single precision, which lets through
    what its rounding cannot tell; where that is much, the expanded square in full precision chooses.
    """
    middle, side, longest = folded
    x = x - middle
    xx = (x * x).sum(axis=1)
    scale, hit = xx.max() + near.max() + longest, None
    if np.isfinite(scale) and scale > 1e-30 * unit:
        mine = np.hstack([x * (1 / math.sqrt(unit)), ((xx - near) / unit)[:, None],
                          np.ones((len(x), 1))]).astype("f4")
        error = 4 * (x.shape[1] + 8) * float(np.finfo("f4").eps) * scale / unit
        hit = np.flatnonzero(mine @ side.T <= np.float32(error))
    if hit is None or len(hit) > len(x) * len(y) // 64:
        y = y - middle
        rough = xx[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None]
        hit = np.flatnonzero(~(rough > near[:, None] + other_near[None] + _SLACK * scale))
    return np.divmod(hit, len(y))


def _first(d, hi, lo, most: int):
    """Positions of the ``most`` cheapest pairs; equal costs go to the pair of older groups."""
    return np.lexsort((lo, hi, d))[:most]


def _close(ids, n, total, other_ids, m, other_total, reach: float):
    """(row, column, cost) of the pairs of two blocks that cost at most ``reach``, each pair once.

    One more than ``MOST_LINKS`` says that there are more; these are then the cheapest.
    """
    same = ids is other_ids
    x, y = total / n[:, None], other_total / m[:, None]
    mine, others = _pieces(x, n, _PIECE), _pieces(y, m, _PIECE)
    middles, radii, leasts = (np.array([p[i] for p in others]) for i in (1, 2, 3))
    # Lengths from any middle, and bounds, in a unit that single precision can hold.
    unit = 4 * max((x * x).sum(axis=1).max(), (y * y).sum(axis=1).max()) + reach / n.min()
    unit = unit if np.isfinite(unit) and unit > 0 else 1.0
    folded = [_folded(y[p[0]], reach / m[p[0]], unit) for p in others]
    bounds, other_bounds = reach / n, reach / m
    found, held = [], 0

    def join():
        return [np.concatenate(c) for c in zip(*found)] if found else \
            [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)]

    for at, middle, radius, least in mine:
        far = _apart(middle, radius, least, middles, radii, leasts, reach)
        for (to, *_), fold, away in zip(others, folded, far):
            if away or same and to.stop <= at.start:
                continue
            row, col = _candidates(x[at], bounds[at], y[to], other_bounds[to], fold, unit)
            row, col = row + at.start, col + to.start
            if same:
                once = row < col
                row, col = row[once], col[once]
            d = _exact(total, n, row, other_total, m, col)
            near = d <= reach
            found.append((row[near], col[near], d[near]))
            held += int(near.sum())
            if held > 2 * MOST_LINKS:
                row, col, d = join()
                a, b = ids[row], other_ids[col]
                kept = _first(d, np.maximum(a, b), np.minimum(a, b), MOST_LINKS + 1)
                found, held, reach = [(row[kept], col[kept], d[kept])], len(kept), d[kept].max()
    row, col, d = join()
    if len(d) > MOST_LINKS + 1:
        a, b = ids[row], other_ids[col]
        kept = _first(d, np.maximum(a, b), np.minimum(a, b), MOST_LINKS + 1)
        row, col, d = row[kept], col[kept], d[kept]
    return row, col, d


def _sampled(asked, ids, n, total):
    """(cost, asker) of the cheapest pairs between the asked groups and those of a block."""
    ask_ids, ask_n, ask_total = asked
    spots, most = ask_total / ask_n[:, None], ASKED * NEAR
    best, who = np.empty(0), np.empty(0, "i4")
    step = max(1, _CELLS // len(ask_ids))
    for lo in range(0, len(ids), step):
        at = slice(lo, lo + step)
        rough = _cost(squares(spots, total[at] / n[at, None]), ask_n[:, None], n[None, at])
        rough[ask_ids[:, None] == ids[None, at]] = np.inf
        pick = np.argpartition(rough.ravel(), most)[:most] if rough.size > most \
            else np.arange(rough.size)
        row, col = np.divmod(pick, rough.shape[1])
        other = ask_ids[row] != ids[at][col]
        row, col = row[other], col[other] + lo
        best = np.r_[best, _exact(ask_total, ask_n, row, total, n, col)]
        who = np.r_[who, row.astype("i4")]
        if len(best) > most:
            pick = np.argpartition(best, most)[:most]
            best, who = best[pick], who[pick]
    return best, who


def _reach(cost, who, n_asked: int, count: int, width: int) -> float:
    """The highest sampled cost that leaves bounded numbers of pairs, and of groups in them."""
    order = np.argsort(cost, kind="stable")[:n_asked * NEAR]
    cost, who = cost[order], who[order]
    if not len(cost) or not np.isfinite(cost[0]):
        raise ValueError("distances overflow")
    new = np.zeros(len(who))
    new[np.unique(who, return_index=True)[1]] = 1
    links = np.arange(1, len(who) + 1) / n_asked * count / 2
    linked = np.cumsum(new) / n_asked * count
    fit = np.isfinite(cost) & (links <= MOST_LINKS) & (linked * 8 * width <= _LINKED_BYTES)
    return float(cost[max(1, int(fit.sum())) - 1])


def _merge(ids, n, total, height, u, v, d, most: float, turn: int, n_start: int):
    """Merge mutual nearest pairs, in rounds, until no listed pair costs ``most`` or less.

    Groups change in place, a pair lives on where its older group was: (a, b, parent, height), who is
    left, and the number of the next round.
    """
    left, merged = np.ones(len(ids), bool), []
    while len(u):
        low = np.full(len(ids), np.inf)
        np.minimum.at(low, u, d)
        np.minimum.at(low, v, d)
        at = np.flatnonzero((d == low[u]) | (d == low[v]))
        at = at[_first(d[at], np.maximum(ids[u[at]], ids[v[at]]),
                       np.minimum(ids[u[at]], ids[v[at]]), len(at))]
        place, best = np.arange(len(at)), np.full(len(ids), len(at))
        np.minimum.at(best, u[at], place)
        np.minimum.at(best, v[at], place)
        at = at[(best[u[at]] == place) & (best[v[at]] == place)]
        older = ids[u[at]] < ids[v[at]]
        a, b = np.where(older, u[at], v[at]), np.where(older, v[at], u[at])
        parent = turn * n_start + ids[a] % n_start
        height[a] = np.maximum(d[at], np.maximum(height[a], height[b]))
        merged.append((ids[a], ids[b], parent, height[a]))
        total[a] += total[b]
        n[a] += n[b]
        ids[a], left[b] = parent, False
        # Pairs of a merged group are pairs of what it became, and cost anew.
        to, new = np.arange(len(ids)), np.zeros(len(ids), bool)
        to[b], new[a] = a, True
        u, v = to[u], to[v]
        changed = new[u] | new[v]
        p, q = np.minimum(u[changed], v[changed]), np.maximum(u[changed], v[changed])
        p, q = np.divmod(np.unique(p[p != q] * len(ids) + q[p != q]), len(ids))
        cost = _exact(total, n, p, total, n, q)
        p, q, cost = p[cost <= most], q[cost <= most], cost[cost <= most]
        u, v, d = np.r_[u[~changed], p], np.r_[v[~changed], q], np.r_[d[~changed], cost]
        turn += 1
    if not merged:
        raise ValueError("distances overflow")
    return [np.concatenate(c) for c in zip(*merged)], left, turn


def _sums(column) -> np.ndarray:
    """A matrix of the vectors that an Arrow column holds as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "f8").reshape(len(column), -1)


def _columns(groups: pa.Table):
    """Ids, sizes, sums and heights in the order of ids, to write to."""
    ids = groups["id"].to_numpy()
    order = np.argsort(ids)
    place = np.empty(len(ids), "i8")
    place[order] = np.arange(len(ids))
    total, lo = None, 0
    for chunk in groups["total"].chunks:
        part = _sums(chunk)
        total = np.empty((len(ids), part.shape[1])) if total is None else total
        total[place[lo:lo + len(chunk)]] = part
        lo += len(chunk)
    return ids[order], groups["n"].to_numpy()[order], total, groups["height"].to_numpy()[order]


def _merged_table(merged, ids, n, total) -> pa.Table:
    """Merges, the last one of a group with what the group is now."""
    a, b, parent, height = merged
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, parent, sorter=order), len(ids) - 1)]
    last = ids[at] == parent
    at = at[last]
    sums = np.full(len(parent), None, object)
    for i, row in zip(np.flatnonzero(last), at):
        sums[i] = total[row].tobytes()
    sizes = np.full(len(parent), np.nan)
    sizes[last] = n[at]
    return pa.table({"a": a, "b": b, "parent": parent, "height": height, "n": sizes,
                     "total": pa.array(sums, pa.binary())})


def _started(batches):
    """Groups of one distinct vector each."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.table(batch)
            n = rows["n"].to_numpy().astype("f8")
            total = matrix(rows["centre"]) * n[:, None]
            yield from pa.table({"id": rows["id"], "n": n, "total": [t.tobytes() for t in total],
                                 "height": np.zeros(len(n))}).to_batches()


def _along(reach: float, turn: int, n_start: int):
    """Merge along a list of pairs: kernel for the linked groups and the list."""
    def kernel(groups: pa.Table, links: pa.Table) -> pa.Table:
        ids, n, total, height = _columns(groups)
        u, v = (np.searchsorted(ids, links[c].to_numpy()) for c in ("lo", "hi"))
        merged, left, _ = _merge(ids, n, total, height, u, v, links["d"].to_numpy(), reach, turn,
                                 n_start)
        return _merged_table(merged, ids[left], n[left], total[left])
    return kernel


def _alone(last: int, seed: int, turn: int, n_start: int):
    """Merge all groups of a table until ``last`` are left: kernel for one place."""
    def kernel(groups: pa.Table) -> pa.Table:
        ids, n, total, height = _columns(groups)
        rng, next_, found = np.random.default_rng(seed), turn, []
        while len(ids) > last:
            at = rng.choice(len(ids), min(ASKED, len(ids)), replace=False)
            cost, who = _sampled((ids[at], n[at], total[at]), ids, n, total)
            reach = _reach(cost, who, len(at), len(ids), total.shape[1])
            u, v, d = _close(ids, n, total, ids, n, total, reach)
            if len(d) > MOST_LINKS:
                kept = _first(d, np.maximum(ids[u], ids[v]), np.minimum(ids[u], ids[v]), MOST_LINKS)
                u, v, d = u[kept], v[kept], d[kept]
                reach = np.nextafter(d.max(), -np.inf)
            merged, left, next_ = _merge(ids, n, total, height, u, v, d, reach, next_, n_start)
            ids, n, total, height = ids[left], n[left], total[left], height[left]
            found.append(merged)
        return _merged_table([np.concatenate(c) for c in zip(*found)], ids, n, total)
    return kernel


def _in_line(spots: np.ndarray) -> np.ndarray:
    """Order that keeps near spots together: halves along the longest way, again and again."""
    if len(spots) <= 2:
        return np.arange(len(spots))
    gaps = spots - spots.mean(axis=0)
    end = gaps[(gaps * gaps).sum(axis=1).argmax()]
    order = np.argsort(gaps @ end, kind="stable")
    half = len(order) // 2
    return np.r_[order[:half][_in_line(spots[order[:half]])],
                 order[half:][_in_line(spots[order[half:]])]]


def _packed(groups: DataFrame, spots: np.ndarray, count: int, size: int) -> DataFrame:
    """Groups in blocks of about ``size``, those around near spots together; a row holds a piece.

    The JVM copies a row several times on its way, so that a block as one row would not fit it.
    """
    shared = share(groups, spots[_in_line(spots)])

    def mark(batches):
        spots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch)
            centre = _sums(rows["total"]) / rows["n"].to_numpy()[:, None]
            step = max(1, _CELLS // len(spots))
            cell = np.concatenate([squares(centre[lo:lo + step], spots).argmin(axis=1)
                                   for lo in range(0, len(centre), step)])
            yield from rows.append_column("cell", pa.array(cell.astype("i4"))).to_batches()

    def pack(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        ids, n, total = rows["id"].to_numpy(), rows["n"].to_numpy(), _sums(rows["total"])
        parts = math.ceil(len(ids) / (1.25 * size))
        for i, at in enumerate(np.array_split(np.arange(len(ids)), parts)):
            (_, middle, radius, least), = _pieces(total[at] / n[at, None], n[at], len(at))
            for lo in range(0, len(at), rows_of_piece):
                to = at[lo:lo + rows_of_piece]
                yield pa.RecordBatch.from_pylist([{
                    "part": TaskContext.get().partitionId(), "nr": i, "piece": lo,
                    "ids": ids[to].tobytes(), "n": n[to].tobytes(), "total": total[to].tobytes(),
                    "middle": middle.tolist(), "radius": radius, "least": least}], about)

    rows_of_piece = max(1, min(_PIECE, _PIECE_BYTES // (8 * max(1, spots.shape[1]))))
    about = pa.schema([("part", pa.int32()), ("nr", pa.int32()), ("piece", pa.int32()),
                       ("ids", pa.binary()), ("n", pa.binary()), ("total", pa.binary()),
                       ("middle", pa.list_(pa.float64())), ("radius", pa.float64()),
                       ("least", pa.float64())])
    ship_package(groups.sparkSession)
    marked = cut(groups.select("id", "n", "total").mapInArrow(
        mark, "id long, n double, total binary, cell int"))
    parts = math.ceil(count / size)
    return cut(marked.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")
               .mapInArrow(pack, "part int, nr int, piece int, ids binary, n binary, total binary, "
                                 "middle array<double>, radius double, least double"))


def _unpacked(pieces: list[dict], width: int):
    """Ids, sizes and sums of the groups of a block."""
    pieces = sorted(pieces, key=lambda p: p["piece"])
    ids, n, total = (np.frombuffer(b"".join(p[c] for p in pieces), t)
                     for c, t in (("ids", "i8"), ("n", "f8"), ("total", "f8")))
    return ids, n, total.reshape(-1, width)


def _links(blocks: DataFrame, asked, count: int, width: int):
    """(pairs of groups that cost at most a reach, the reach)."""
    spark = blocks.sparkSession
    shared = share(blocks, asked)

    def sample(batches):
        cost, who = np.empty(0), np.empty(0, "i4")
        for batch in batches:
            for piece in batch.to_pylist():
                more = _sampled(shared.value, *_unpacked([piece], width))
                cost, who = np.r_[cost, more[0]], np.r_[who, more[1]]
                if len(cost) > ASKED * NEAR:
                    pick = np.argpartition(cost, ASKED * NEAR)[:ASKED * NEAR]
                    cost, who = cost[pick], who[pick]
        if len(cost):
            yield pa.RecordBatch.from_pylist([{"cost": cost.tobytes(), "who": who.tobytes()}])

    def kernel(mine: pa.Table, others: pa.Table) -> pa.Table:
        block, other = mine.to_pylist(), others.to_pylist()
        a = _unpacked(block, width)
        same = (block[0]["part"], block[0]["nr"]) == (other[0]["part"], other[0]["nr"])
        b = a if same else _unpacked(other, width)
        row, col, d = _close(*a, *b, reach)
        p, q = a[0][row], b[0][col]
        return pa.table({"hi": np.maximum(p, q), "lo": np.minimum(p, q), "d": d})

    packed = blocks.select("piece", "ids", "n", "total")
    with few_at_once(spark):
        found = packed.mapInArrow(sample, "cost binary, who binary").collect()  # bounded for a task
    reach = _reach(np.concatenate([np.frombuffer(r["cost"], "f8") for r in found]),
                   np.concatenate([np.frombuffer(r["who"], "i4") for r in found]),
                   len(asked[0]), count, width)
    # One row per block.
    about = sorted(blocks.where(F.col("piece") == 0)
                   .select("part", "nr", "middle", "radius", "least").collect())
    middle, radius, least = (np.array([r[c] for r in about]) for c in ("middle", "radius", "least"))
    meeting = []
    for i, r in enumerate(about):
        near = ~_apart(middle[i], radius[i], least[i], middle[i:], radius[i:], least[i:], reach)
        meeting += [(0, i, j, r["part"], r["nr"], about[j]["part"], about[j]["nr"])
                    for j in (np.flatnonzero(near) + i).tolist()]
    pairs = spark.createDataFrame(
        meeting, "cell int, lb int, rb int, part int, nr int, to_part int, to_nr int")
    sides = blocks.select("part", "nr", "piece", "ids", "n", "total")
    left = sides.join(F.broadcast(pairs.drop("to_part", "to_nr")), ["part", "nr"])
    right = sides.join(F.broadcast(pairs.select(
        "cell", "lb", "rb", F.col("to_part").alias("part"), F.col("to_nr").alias("nr"))),
        ["part", "nr"])
    with few_at_once(spark):
        links = cut(neighbors._pairs(left, right, kernel, _LINK))
    if links.count() > MOST_LINKS:
        links = cut(with_index(links, F.col("d"), F.col("hi"), F.col("lo"))
                    .where(F.col("idx") < MOST_LINKS).drop("idx"))
        # All pairs below the highest cost are listed, but perhaps not all of that cost.
        reach = float(np.nextafter(links.agg(F.max("d")).first()[0], -np.inf))
    return links, reach


def _pass(groups: DataFrame, count: int, width: int, seed: int, turn: int,
          n_start: int) -> DataFrame:
    """Merges up to a reach, from all pairs of blocks."""
    chosen = (groups.orderBy(F.xxhash64(F.lit(seed + turn), "id"), "id").limit(ASKED)
              .select("id", "n", "total").collect())
    asked = (np.array([r["id"] for r in chosen]), np.array([r["n"] for r in chosen], "f8"),
             np.array([np.frombuffer(r["total"], "f8") for r in chosen]))
    size = max(1, min(BLOCK_ROWS, neighbors.block_rows(count, width)[1]))
    blocks = _packed(groups, asked[2] / asked[1][:, None], count, size)
    links, reach = _links(blocks, asked, count, width)
    ends = links.select(F.explode(F.array("hi", "lo")).alias("id")).distinct()
    linked = groups.join(ends, "id", "left_semi").withColumn("place", F.lit(0))
    return cut(linked.groupBy("place").cogroup(
        links.withColumn("place", F.lit(0)).groupBy("place")).applyInArrow(
            _along(reach, turn, n_start), _MERGED))


def _finish(rows, n_start: int) -> list[tuple]:
    """Merges of the last groups, the cheapest pair first: (child, other child, parent, height).

    Every group knows its cheapest partner among the later ones; a merge asks again only for those
    whose partner it took.
    """
    rows = sorted(rows, key=lambda r: r["id"])
    most, have = 2 * len(rows), len(rows)
    ids = np.array([r["id"] for r in rows] + [0] * have)
    n, high = np.ones(most), np.zeros(most)
    n[:have], high[:have] = [r["n"] for r in rows], [r["height"] for r in rows]
    total = np.zeros((most, len(rows[0]["total"]) // 8))
    total[:have] = [np.frombuffer(r["total"], "f8") for r in rows]
    centre, alive = total / n[:, None], np.arange(most) < have
    low, partner = np.full(most, np.inf), np.zeros(most, int)

    def ask(i):
        later = np.flatnonzero(alive[i + 1:have]) + i + 1
        if len(later):
            cost = _cost(((centre[i] - centre[later]) ** 2).sum(-1), n[i], n[later])
            low[i], partner[i] = cost.min(), later[cost.argmin()]
        else:
            low[i] = np.inf

    for i in range(have):
        ask(i)
    merges, turn = [], int(ids.max()) // n_start + 1
    while alive.sum() > 1:
        i = int(low.argmin())
        if not np.isfinite(low[i]):
            raise ValueError("distances overflow")
        j, k = int(partner[i]), have
        high[k] = max(low[i], high[i], high[j])
        ids[k] = turn * n_start + ids[i] % n_start
        merges.append((int(ids[i]), int(ids[j]), int(ids[k]), float(high[k])))
        n[k], total[k] = n[i] + n[j], total[i] + total[j]
        centre[k] = total[k] / n[k]
        alive[[i, j]], low[[i, j]] = False, np.inf
        held = np.flatnonzero(alive)
        alive[k], have = True, have + 1
        taken = np.isin(partner[held], (i, j))
        cost = _cost(((centre[held] - centre[k]) ** 2).sum(-1), n[held], n[k])
        nearer = held[cost < low[held]]
        low[nearer], partner[nearer] = cost[cost < low[held]], k
        for at in held[taken]:
            ask(at)
        turn += 1
    return merges


def ward_tree(df: DataFrame, vec: str, seed: int = SEED, last: int = LAST_GROUPS):
    """Ward's whole tree: (leaves, merges).

    ``leaves`` has every distinct vector without null or non-finite entries, with its ``id`` from 0 on and its number of rows ``n``.
    ``merges`` has (a, b, parent, height): the groups a and b become the group ``parent``, and
    ``height`` is the variance that adds (no lower than the heights below it). Ids grow towards
    the root.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("centre"))
    # Adding zero turns the negative zero into the positive one, which groups alike.
    rows = rows.select(F.transform("centre", lambda x: x + F.lit(0.0)).alias("centre"))
    finite = F.forall("centre", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    counted = rows.where(F.coalesce(finite, F.lit(False))).groupBy("centre").agg(F.count("*").alias("n"))
    leaves = cut(with_index(counted, F.col("centre"), name="id").select("id", "n", "centre"))
    n_start = leaves.count()
    ship_package(df.sparkSession)
    groups = leaves.mapInArrow(_started, "id long, n double, total binary, height double")
    spark = df.sparkSession
    count, turn, merges = n_start, 1, []
    width, widest = leaves.agg(F.min(F.size("centre")), F.max(F.size("centre"))).first()
    if width != widest:
        raise ValueError("vectors of different lengths")
    few = min(BLOCK_ROWS, neighbors.block_rows(0, width or 0)[1] * neighbors.SPREAD)
    while count > last:
        if count <= few:
            found = cut(groups.withColumn("place", F.lit(0)).groupBy("place").applyInArrow(
                _alone(last, seed, turn, n_start), _MERGED))
        else:
            groups = cut(groups)
            found = _pass(groups, count, width, seed, turn, n_start)
        merges.append(found.select("a", "b", "parent", "height"))
        gone = found.select(F.explode(F.array("a", "b")).alias("id"))
        groups = groups.join(gone, "id", "left_anti").union(
            found.where(F.col("total").isNotNull()).select("parent", "n", "total", "height"))
        done, highest = found.agg(F.count("*"), F.max("parent")).first()
        count -= done
        turn = highest // n_start + 1
    rest = groups.select("id", "n", "total", "height").collect()  # at most ``last`` groups
    final = _finish(rest, n_start) if rest else []
    out = spark.createDataFrame(final, "a long, b long, parent long, height double")
    for table in merges:
        out = out.union(table)
    return leaves, cut(out)


def cut_tree(leaves: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(centre, root): the group of every leaf when the k - 1 highest merges are taken back.

    Every group looks up the end of its parent's way until all ways end at a root.
    """
    high = [r["parent"] for r in merges.orderBy(F.desc("height"), F.desc("parent"))
            .limit(k - 1).collect()]
    low = merges.where(~F.col("parent").isin(high)) if high else merges
    ways = cut(low.select(F.explode(F.array("a", "b")).alias("id"), F.col("parent").alias("root"),
                          F.lit(True).alias("moved")))
    while not ways.where("moved").isEmpty():
        ends = ways.select(F.col("id").alias("root"), F.col("root").alias("end"))
        ways = cut(ways.join(ends, "root", "left").select(
            "id", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
    return leaves.join(ways.drop("moved"), "id", "left").select(
        "centre", F.coalesce("root", "id").alias("root"))
