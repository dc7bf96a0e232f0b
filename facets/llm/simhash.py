"""SimHash near-duplicates: fingerprints of word shingles, linked through a pigeonring filter.

A fingerprint is cut into ``m = bits + 1`` segments standing in a ring. If two fingerprints differ
in at most ``bits`` bits, there is a segment from which every chain of 1, 2, ... consecutive
segments keeps its summed difference within ``length * bits / m``: the first segment is equal, the
first two together differ in at most one bit, and so on. Equality of the first segment and of one
half of the second is a join key; the longer chains prune what meets under it; what is left gets
the full check.

Defined cases: a null text has no words, like an empty one, and the fingerprint zero; fewer words
than a shingle make one shingle of them all; rows with the same id and rows with a null id each
keep a row (a null id names a component only if it has no other).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.llm.batches import texts, tidy
from facets.operators.graph import components
from facets.session import attach, cut, ship_package

SHINGLE = 3
MAX_BITS = 2
SEED = 42
WIDTH = 64
# Fingerprints of one key that are compared with each other at once; fuller keys go the other way.
FULL_KEY = 256
_BLOCK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is set if it is set in more than half of the shingle hashes.

    Words are split at ASCII blanks after lower-casing A-Z; hashes of long texts are counted in
    blocks, so memory beside the text stays bounded.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    lasts = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, n, _BLOCK):
        size = min(_BLOCK, n - at)
        hashes = np.fromiter(
            (digest(line[a:b], SEED) for a, b in zip(starts[at:at + size].tolist(),
                                                     lasts[at:at + size].tolist())),
            np.uint64, size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fingerprint of every row's whole text as a signed long."""
    ship_package(docs.sparkSession)

    def kernel(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))],
                             np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found)], ["doc_id", "text_hash", "fp"])
        tidy()

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                   "text_hash long, fp long")


def _segments(bits: int) -> list[tuple[int, int]]:
    """Borders of the ``bits + 1`` segments."""
    edges = [WIDTH * i // (bits + 1) for i in range(bits + 2)]
    return list(zip(edges[:-1], edges[1:]))


def _mask(low: int, high: int) -> int:
    return ((1 << high) - 1) ^ ((1 << low) - 1)


def _signed(value: int) -> int:
    return value - (1 << WIDTH) if value >> (WIDTH - 1) else value


def _chains(bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For every key: its mask, and (mask, budget) of the chains from its segment on."""
    ring = _segments(bits)
    m = len(ring)
    out = []
    for i in range(m):
        chain = [(0, 0)]
        for length in range(1, m + 1):
            mask = chain[-1][0] | _mask(*ring[(i + length - 1) % m])
            chain.append((mask, length * bits // m))
        low, high = ring[(i + 1) % m]
        # Two segments differ in at most one bit: one half of the second is the same.
        halves = [_mask(low, (low + high) // 2), _mask((low + high) // 2, high)] if m > 1 else [0]
        for half in halves:
            out.append((_mask(*ring[i]) | half, chain[2:] or [(_mask(0, WIDTH), bits)]))
    return out


def _linked(fps: np.ndarray, chain) -> list[tuple[int, int]]:
    """Links that connect all fingerprints of one key which differ in few enough bits."""
    x = fps.view(np.uint64)
    a, b = np.triu_indices(len(x), 1)
    apart = x[a] ^ x[b]
    for mask, budget in chain:
        keep = np.bitwise_count(apart & np.uint64(mask)) <= budget
        a, b, apart = a[keep], b[keep], apart[keep]
    root = list(range(len(x)))

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = find(i), find(j)
        if p != q:
            root[q] = p
            out.append((int(fps[i]), int(fps[j])))
    return out


def _compare(buckets: DataFrame, chains) -> DataFrame:
    """(src, dst) within every row of (slot, fps)."""
    def kernel(batches):
        for batch in batches:
            links = []
            for slot, fps in zip(batch.column(0).to_pylist(), batch.column(1)):
                links += _linked(fps.values.to_numpy(), chains[slot])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return buckets.select("slot", "fps").mapInArrow(kernel, "src long, dst long")


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, full_key: int = FULL_KEY) -> DataFrame:
    """(src, dst): links between distinct fingerprints, enough to connect all within ``bits`` bits.

    Keys with more than ``full_key`` fingerprints are not compared among themselves. Their members
    spell out every fingerprint at half the distance; who shares one is compared. There are at
    most as many members of such a group as ways to flip that many bits, so no group grows with
    the data.
    """
    chains = _chains(bits)
    keyed = fps.select("fp", F.inline(F.array(*[
        F.struct(F.lit(slot).alias("slot"),
                 F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for slot, (mask, _) in enumerate(chains)])))
    full = cut(keyed.groupBy("slot", "key").agg(F.count("*").alias("n"))
               .where(F.col("n") > full_key).select("slot", "key"))

    def buckets(rows: DataFrame) -> DataFrame:
        return (rows.groupBy("slot", "key").agg(F.collect_list("fp").alias("fps"))
                .where(F.size("fps") > 1))

    if full.isEmpty():
        return _compare(buckets(keyed), [c for _, c in chains])
    near = _compare(buckets(attach(keyed, full, ["slot", "key"], "left_anti")),
                    [c for _, c in chains])
    flips = [sum(1 << i for i in places) for n in range((bits + 1) // 2 + 1)
             for places in combinations(range(WIDTH), n)]
    members = attach(keyed, full, ["slot", "key"], "left_semi").select("fp").distinct()
    spelled = members.select(
        F.lit(0).alias("slot"), "fp",
        F.explode(F.array(*[F.lit(_signed(f)) for f in flips])).alias("flip")).select(
        "slot", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    return near.union(_compare(buckets(spelled), [[(_mask(0, WIDTH), bits)]]))


def hex_digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of every row.

    ``component_id`` is the smallest id reachable through links, ``component`` a fingerprint that
    all rows of the group name, also where ids are null. Copies share a fingerprint, which stands in the link search once.
    """
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut(fingerprint_links(nodes.select("fp"), bits).distinct())
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    groups = components(edges, ends.distinct()).select(F.col("id").alias("fp"), "component")
    grouped = (nodes.join(groups, "fp", "left")
               .select("fp", "first", F.coalesce("component", "fp").alias("component")))
    names = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The documents whose id names their group; of rows that share such an id one stays.

    Rows are chosen by id and a hash of the text, so texts cross the network once, in the final
    join.
    """
    found = near_duplicates(docs, shingle, bits)
    first = F.min(F.struct("text_hash", "copies")).alias("first")
    keep = cut(found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
               .groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
               .groupBy("component", "doc_id").agg(first)
               .select(F.col("doc_id").alias("keep"), F.col("first.text_hash").alias("keep_hash"),
                       (F.col("first.copies") > 1).alias("many")))
    # The row travels as one value, so that its column names cannot clash.
    rows = docs.select(F.col("doc_id").alias("id"),
                       F.xxhash64(F.col("text").cast("string")).alias("hash"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def chosen(many: bool) -> DataFrame:
        ids = keep.where(F.col("many") == many)
        return rows.join(ids, F.col("id").eqNullSafe(F.col("keep"))
                         & (F.col("hash") == F.col("keep_hash")), "left_semi")

    kept = chosen(False).select("row.*")
    if keep.where("many").isEmpty():
        return kept
    one = chosen(True).groupBy("id", "hash").agg(F.first("row").alias("row"))
    return kept.union(one.select("row.*"))
