"""Rounds over a weighted graph that lies in blocks: local moves and connected parts.

A block is one row that holds the links of its nodes as arrays, and what one block has to tell
another in a round is one row too, so a round is two shuffles of few rows however many links there
are. Nodes are dealt to blocks by hash. A link stands in both directions, so the nodes that a block
tells another one about are those that the other one has links to: both list them by id, and only
their values travel. The totals of a community are added up in the block of the node it is named by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.session import cut, ship_package

# Links of a block, and rounds that are one job.
BLOCK_LINKS = 1 << 18
JOB_ROUNDS = 6
# Rounds without gain after which moves end.
PATIENCE = 3

_SCHEMA = "block int, src int, done boolean, q double, parts array<binary>"
_STATE = -1
# A block: its nodes; its links as places of both ends, ends being listed by block and id; the nodes
# that other blocks (and itself) have links to; and round, best score, rounds without gain, end.
_FIELDS = (("ids", "i8"), ("degree", "f8"), ("loop", "f8"), ("node", "i4"), ("end", "i4"),
           ("weight", "f8"), ("end_block", "i4"), ("told_block", "i4"), ("told", "i4"),
           ("comm", "i8"), ("before", "i8"), ("best", "i8"), ("around", "i8"), ("tally", "f8"))
_M = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M[1]
    h = (h ^ (h >> np.uint64(29))) * _M[2]
    return h ^ (h >> np.uint64(32))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(ids: np.ndarray, first: int | None = None) -> np.ndarray:
    """``F.xxhash64`` of long ids, or of an int and the ids, bit for bit."""
    seed = np.full(1, 42, np.uint64)
    if first is not None:
        h = (seed + _M[4] + np.uint64(4)) ^ (np.full(1, first & 0xFFFFFFFF, np.uint64) * _M[0])
        seed = _mixed(_turned(h, 23) * _M[1] + _M[2])
    h = seed + _M[4] + np.uint64(8)
    h = h ^ (_turned(np.asarray(ids, "i8").view("u8") * _M[1], 31) * _M[0])
    return _mixed(_turned(h, 27) * _M[0] + _M[3])


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    return (hashed(ids).view("i8") % n).astype("i4")


def _built(links: pa.Table) -> dict:
    src, dst, to, weight, comm = (links[c].to_numpy() for c in ("src", "dst", "to", "weight", "comm"))
    ids, first, node = np.unique(src, return_index=True, return_inverse=True)
    comm, loops = comm[first], src == dst
    state = {"ids": ids, "degree": np.bincount(node, weight, len(ids)),
             "loop": np.bincount(node[loops], weight[loops], len(ids))}
    node, dst, to, weight = node[~loops], dst[~loops], to[~loops], weight[~loops]
    order = np.lexsort((node, dst, to))
    node, dst, to, weight = node[order], dst[order], to[order], weight[order]
    new = np.r_[True, (dst[1:] != dst[:-1]) | (to[1:] != to[:-1])][:len(dst)]
    told = np.unique(to.astype("i8") * len(ids) + node)
    return state | {
        "node": node, "end": np.cumsum(new) - 1, "weight": weight, "end_block": to[new],
        "told_block": told // max(1, len(ids)), "told": told % max(1, len(ids)),
        "comm": comm, "before": comm, "best": comm, "around": np.zeros(new.sum(), "i8"),
        "tally": np.array([0, np.nan, 0, 0.0])}


def _values(state: dict, values: np.ndarray, to: int) -> np.ndarray:
    low, high = np.searchsorted(state["told_block"], [to, to + 1])
    return values[state["told"][low:high]]


def _hear(state: dict, messages: list, part: int = 0) -> np.ndarray:
    """What the other blocks told about the ends of this block's links."""
    around = np.empty(len(state["end_block"]), "i8")
    for src, parts in messages:
        low, high = np.searchsorted(state["end_block"], [src, src + 1])
        around[low:high] = np.frombuffer(parts[part], "i8")
    return around


def _tell(state: dict, me: int, n: int, score) -> list:
    """To every block: where its ends are, what this block adds to communities at home there, which
    blocks see these, and this block's part of the score."""
    comms, at = np.unique(state["comm"], return_inverse=True)
    totals = np.bincount(at, state["degree"], len(comms))
    seen = np.unique(np.r_[at[state["told"]] * n + state["told_block"], np.arange(len(comms)) * n + me])
    home, out = _home(comms, n), []
    for to in range(n):
        mine, wanted = home == to, seen[home[seen // n] == to]
        out.append((to, [_values(state, state["comm"], to), comms[mine], totals[mine],
                         comms[wanted // n], (wanted % n).astype("i4"), np.array(score, "f8")]))
    return out


def _settled(state: dict, messages: list, me: int, n: int, two_m: float, min_gain: float) -> list:
    """Judge the round that ended; add up the communities at home here for the blocks that see them."""
    step, best_q, stale, _ = state["tally"]
    if step:
        inner, square, wanting = np.sum([np.frombuffer(p[5], "f8") for _, p in messages], axis=0)
        q = inner / two_m - square / two_m ** 2
        if np.isnan(best_q) or q > best_q + min_gain:
            state["best"], best_q, stale = state["before"], q, 0
        else:
            stale += 1
        end = wanting == 0 or stale >= PATIENCE
        state["tally"] = np.array([step, best_q, stale, end])
        if end:
            return []
    state["around"] = _hear(state, messages)
    comms, adds, wanted, by = (np.concatenate([np.frombuffer(p[i], kind) for _, p in messages])
                               for i, kind in ((1, "i8"), (2, "f8"), (3, "i8"), (4, "i4")))
    names, at = np.unique(comms, return_inverse=True)
    totals = np.bincount(at, adds, len(names))
    place = np.searchsorted(names, wanted)
    pairs = np.unique(by.astype("i8") * max(1, len(names)) + place)
    block, place = np.divmod(pairs, max(1, len(names)))
    return [(int(to), [names[place[block == to]], totals[place[block == to]]])
            for to in np.unique(block)]


def _moved(state: dict, messages: list, me: int, n: int, two_m: float, seed: int) -> list:
    """Let the half of the nodes whose turn it is go where modularity grows most."""
    names = np.concatenate([np.frombuffer(p[0], "i8") for _, p in messages])
    totals = np.concatenate([np.frombuffer(p[1], "f8") for _, p in messages])
    order = np.argsort(names)
    names, totals = names[order], totals[order]
    step, size = int(state["tally"][0]), len(names)
    degree, loop, comm = state["degree"], state["loop"], state["comm"]
    own = np.searchsorted(names, comm)
    pairs, at = np.unique(state["node"].astype("i8") * size + np.searchsorted(
        names, state["around"])[state["end"]], return_inverse=True)
    k_in = np.bincount(at, state["weight"], len(pairs))
    node, to = np.divmod(pairs, size)
    gain, inside = k_in - degree[node] * totals[to] / two_m, to == own[node]
    k_own = np.bincount(node[inside], k_in[inside], len(comm))
    node, to, gain = node[~inside], to[~inside], gain[~inside]
    order = np.lexsort((to, -gain, node))
    first = order[np.r_[True, node[order][1:] != node[order][:-1]][:len(order)]]
    best, target = np.full(len(comm), -np.inf), own.copy()
    best[node[first]], target[node[first]] = gain[first], to[first]
    tot = totals[own]
    wants = best > k_own - degree * (tot - degree) / two_m + 1e-12
    turn = hashed(state["ids"], seed + step) & np.uint64(1) == 0
    state["before"] = comm
    state["comm"] = np.where(wants & turn, names[target], comm)
    state["tally"] = state["tally"] + [1, 0, 0, 0]
    return _tell(state, me, n, (np.sum(k_own + loop), np.sum(degree * tot), wants.sum()))


def _parted(state: dict, messages: list, me: int, n: int) -> list:
    """Take the smallest name among neighbours of one's community, inside the block to the end."""
    if state["tally"][0] == 0:  # the communities come first
        around = _hear(state, messages)
        same = state["comm"][state["node"]] == around[state["end"]]
        state["node"], state["end"] = state["node"][same], state["end"][same]
        state["best"], changed = state["ids"], True
    else:
        state["around"] = _hear(state, messages)
        changed = any(np.frombuffer(p[1], "f8")[0] for _, p in messages)
        state["tally"] = np.array([1, 0, 0, not changed])
        if not changed:
            return []
        changed = False
        low, high = np.searchsorted(state["end_block"], [me, me + 1])
        while True:
            label = state["best"].copy()
            np.minimum.at(label, state["node"], state["around"][state["end"]])
            if (label == state["best"]).all():
                break
            state["best"], changed = label, True
            state["around"][low:high] = _values(state, label, me)
    state["tally"] = np.array([1, 0, 0, 0.0])
    return [(to, [_values(state, state["best"], to), np.array([changed], "f8")]) for to in range(n)]


def _rows(me: int, state: dict, messages: list) -> pa.Table:
    packed = [[np.ascontiguousarray(state[name], kind).tobytes() for name, kind in _FIELDS]]
    packed += [[x.tobytes() for x in parts] for _, parts in messages]
    count, tally = len(messages), state["tally"]
    return pa.table({"block": pa.array([me] + [to for to, _ in messages], pa.int32()),
                     "src": pa.array([_STATE] + [me] * count, pa.int32()),
                     "done": pa.array([bool(tally[3])] + [None] * count, pa.bool_()),
                     "q": pa.array([float(tally[1])] + [None] * count, pa.float64()),
                     "parts": pa.array(packed, pa.list_(pa.binary()))})


def _unpacked(parts: list) -> dict:
    return {name: np.frombuffer(raw, kind) for (name, kind), raw in zip(_FIELDS, parts)}


def _step(kernel):
    """``kernel`` on a block and what the others told it; a block at its end stays as it is."""
    def run(rows: pa.Table) -> pa.Table:
        found = sorted(zip(rows["src"].to_pylist(), rows["parts"].to_pylist()), key=lambda r: r[0])
        if not found or found[0][0] != _STATE:  # a block without nodes
            return rows.slice(0, 0)
        me, state = rows["block"][0].as_py(), _unpacked(found[0][1])
        return _rows(me, state, [] if state["tally"][3] else kernel(state, found[1:], me))
    return run


def _alone(kernels):
    """All rounds of a graph that is one block, in one call."""
    def run(rows: pa.Table) -> pa.Table:
        state, *told = [r["parts"] for r in sorted(rows.to_pylist(), key=lambda r: r["src"])]
        state = _unpacked(state)
        while True:
            for kernel in kernels:
                told = [[x.tobytes() for x in p] for _, p in kernel(state, [(0, p) for p in told], 0)]
                if state["tally"][3]:
                    return _rows(0, state, [])
    return run


def _rounds(links: DataFrame, n: int, start, kernels) -> DataFrame:
    """Lay out ``links`` (src, dst, weight, comm) in ``n`` blocks and go on until all are at the end."""
    def build(rows: pa.Table) -> pa.Table:
        me, state = rows["block"][0].as_py(), _built(rows)
        return _rows(me, state, start(state, me))

    def apply(df: DataFrame, kernel) -> DataFrame:
        return df.repartition(n, "block").groupBy("block").applyInArrow(kernel, _SCHEMA)

    ship_package(links.sparkSession)
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    placed = links.select(
        F.pmod(F.xxhash64(src), F.lit(n)).cast("int").alias("block"), src.alias("src"),
        dst.alias("dst"), F.pmod(F.xxhash64(dst), F.lit(n)).cast("int").alias("to"),
        F.col("weight").cast("double").alias("weight"), F.col("comm").cast("long").alias("comm"))
    state = apply(placed, build)
    if n == 1:
        return cut(apply(state, _alone(kernels)))
    while True:
        for _ in range(JOB_ROUNDS):
            for kernel in kernels:
                state = apply(state, _step(kernel))
        state = cut(state)
        if state.where((F.col("src") == _STATE) & ~F.col("done")).isEmpty():
            return state


def _named(state: DataFrame) -> DataFrame:
    def read(batches):
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                found = _unpacked(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["ids"]), pa.array(found["best"])], ["id", "comm"])

    return state.where(F.col("src") == _STATE).select("parts").mapInArrow(read, "id long, comm long")


def block_count(links: DataFrame) -> int:
    return max(1, math.ceil(links.count() / BLOCK_LINKS))


def local_moves(links: DataFrame, two_m: float, min_gain: float, seed: int):
    """(id, comm) of the best state of all rounds, every node starting alone, and its modularity."""
    n = block_count(links)
    state = _rounds(links.withColumn("comm", F.col("src")), n,
                    lambda state, me: _tell(state, me, n, (0.0, 0.0, 0.0)),
                    [lambda s, told, me: _settled(s, told, me, n, two_m, min_gain),
                     lambda s, told, me: _moved(s, told, me, n, two_m, seed)])
    return _named(state), state.where(F.col("src") == _STATE).agg(F.min("q")).first()[0]


def connected_parts(links: DataFrame, moved: DataFrame) -> DataFrame:
    """(id, comm): the connected parts of each community of ``moved``, named by their smallest id."""
    alone = moved.select(F.col("id").alias("src"), F.col("id").alias("dst"),
                         F.lit(0.0).alias("weight"), "comm")
    known = (links.select("src", "dst", "weight").join(
        moved.select(F.col("id").alias("src"), "comm"), "src").unionByName(alone))
    n = block_count(links)
    return _named(_rounds(known, n, lambda state, me: [
        (to, [_values(state, state["comm"], to)]) for to in range(n)],
        [lambda s, told, me: _parted(s, told, me, n)]))
