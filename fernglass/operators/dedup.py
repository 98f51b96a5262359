"""Exact and near duplicates: one keeper per cluster.

Items have path, file_size, perceptual_hash and content_signature (null: none; 0 counts as none). Exact copies
share size and signature. Of what is left, items whose hashes are within `radius` bits are linked, and clusters
are the components of the links. A cluster keeps its largest item, then the one with the shortest path, then the
first path."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_slice, known, slices, utf16_length
from ..plans.shared import cut
from .components import connected_components

RADIUS = 5
#: Hashes of a tile whose distances to another tile's are counted at once.
TILE = 8192
#: Hashes up to which the few wide slices are the cheaper blocking.
FEW = 50_000
#: Hashes of one key that are compared one by one; more are blocked again by their other bits.
CROWD = 512
#: Rows that a task sorts into keys and compares at once.
ROWS = 1 << 20


def keeper_order() -> Column:
    """The least of a group is its keeper."""
    return F.struct((-F.col("file_size")).alias("size"), utf16_length(F.col("path")).alias("length"), F.col("path").alias("path"))


def best_of(items: DataFrame, *group: str) -> DataFrame:
    """(group, keeper): by partial aggregation, so a group of any size makes no hot task."""
    return items.groupBy(*group).agg(F.min(keeper_order()).alias("_k")).select(*group, F.col("_k.path").alias("keeper"))


def exact_tier(items: DataFrame) -> DataFrame:
    """`items` with `representative`: the path that stands for its exact group (its own without a signature)."""
    signed = items.withColumns({"content_signature": known(F.col("content_signature")), "perceptual_hash": known(F.col("perceptual_hash"))})
    best = best_of(signed.where("content_signature is not null"), "file_size", "content_signature")
    joined = signed.join(best, ["file_size", "content_signature"], "left")
    return joined.withColumn("representative", F.coalesce("keeper", "path")).drop("keeper")


def _key_slices(radius: int, scheme: str) -> list[list[tuple[int, int]]]:
    """The slices (offset, width) that each key consists of."""
    if scheme == "slices":
        return [[part] for part in slices(64, radius + 1)]
    if scheme == "triples" and radius <= 5:
        return [list(c) for c in combinations(slices(64, 8), 3)]
    raise ValueError(f"no blocking {scheme!r} for radius {radius}")


def blocking_keys(h: Column, radius: int, scheme: str) -> Column:
    """array of (part, value) such that hashes within `radius` bits share one: by the pigeonhole principle.

    "slices": radius + 1 slices, one of which stays clean. "triples": 8 slices, of which any radius up to 5 leaves
    three clean, so one key per three slices: more keys, each 24 bits wide and so far more selective."""
    keys = _key_slices(radius, scheme)

    def value(parts: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for offset, width in parts:
            out = F.shiftleft(out, width).bitwiseOR(hash_slice(h, offset, width))
        return out

    return F.array(*[F.struct(F.lit(k).alias("part"), value(parts).alias("value")) for k, parts in enumerate(keys)])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(np.append(starts, len(key)))


def _close_pairs(h: np.ndarray, key: np.ndarray, fixed: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within `radius` bits among the hashes of equal key, `h` (distinct) being sorted by `key`; `fixed` are the bits
    on which hashes of a key agree. Crowded keys are blocked together by slices of their other bits, one of which stays
    clean; a key to which that leaves half of its pairs or more is compared as it is, so no pair is looked at over and over."""
    starts, sizes = _runs(key)
    crowded = sizes > CROWD
    last = np.repeat(starts + np.where(crowded, 0, sizes - 1), sizes)
    at, d = np.flatnonzero(np.arange(len(h)) < last), 1
    while len(at):
        near = at[np.bitwise_count(h[at] ^ h[at + d]) <= radius]
        if len(near):
            yield h[near], h[near + d]
        d += 1
        at = at[at + d <= last[at]]
    if not crowded.any():
        return
    part, sizes = h[np.repeat(crowded, sizes)], sizes[crowded]
    bits = [b for b in range(64) if not fixed >> b & 1]
    masks = [sum(1 << b for b in bits[k :: radius + 1]) for k in range(radius + 1)]
    own = np.repeat(np.arange(len(sizes)), sizes)
    left = np.zeros(len(sizes))
    for mask in masks:
        value = part & np.uint64(fixed | mask)
        order = np.argsort(value)
        at, n = _runs(value[order])
        left += np.bincount(own[order[at]], n * (n - 1) / 2, len(sizes))
    again = 2 * left < sizes * (sizes - 1) / 2
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(~again).tolist():
        yield from _all_close_pairs(part[ends[k] - sizes[k] : ends[k]], radius)
    if not again.any():
        return
    part = part[again[own]]
    for k, mask in enumerate(masks):
        value = part & np.uint64(fixed | mask)
        order = np.argsort(value)
        for a, b in _close_pairs(part[order], value[order], fixed | mask, radius):
            first = _first_shared(a ^ b, masks[:k])
            yield a[first], b[first]


def _all_close_pairs(h: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within `radius` bits among all of `h`, in tiles that stay in a processor's cache."""
    for s in range(0, len(h), 256):
        for t in range(s, len(h), 2048):
            i, j = np.nonzero(np.bitwise_count(h[s : s + 256, None] ^ h[t : t + 2048]) <= radius)
            once = s + i < t + j
            yield h[s + i[once]], h[t + j[once]]


def _first_shared(differing: np.ndarray, earlier: list[int]) -> np.ndarray:
    """Whether pairs with these bits `differing` share none of the `earlier` keys."""
    first = np.ones(len(differing), bool)
    for mask in earlier:
        first &= (differing & np.uint64(mask)) != 0
    return first


def near_pairs(hashes: DataFrame, radius: int = RADIUS, scheme: str | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct hashes (column `h`) within `radius` bits.

    Hashes are dealt by blocking keys, and those of one key compared in arrays; a key of many hashes is blocked again by
    the other bits where that leaves fewer pairs to look at. Equal hashes are one vertex, so copies cannot make a hot key; a
    pair that shares several keys is reported at its first shared one only, which needs no distinct over the
    candidates. Without a `scheme`, more than FEW hashes are blocked by "triples": more keys, with fewer hashes each."""
    distinct = cut(hashes.select("h").where("h is not null").distinct())
    if scheme is None:
        scheme = "triples" if radius <= 5 and distinct.count() > FEW else "slices"
    masks = [sum(((1 << width) - 1) << offset for offset, width in key) for key in _key_slices(radius, scheme)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            for part, mask in enumerate(masks):
                value = h & np.uint64(mask).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), part, np.int32)), pa.array(value), pa.array(h)], names=["part", "value", "h"])

    def compared(part: np.ndarray, value: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            k = int(part[s])
            for a, b in _close_pairs(h[s:e].view(np.uint64), value[s:e], masks[k], radius):
                first = _first_shared(a ^ b, masks[:k])
                a, b = a[first].view(np.int64), b[first].view(np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, limit = 0, ROWS
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= limit:  # the last key may go on
                part, value, h = (np.concatenate(c) for c in zip(*held, strict=True))
                goes_on = (part == part[-1]) & (value == value[-1])
                whole = int(goes_on.argmax())
                if whole:
                    yield from compared(part[:whole], value[:whole], h[:whole])
                held, rows = [[part[whole:], value[whole:], h[whole:]]], len(h) - whole
                limit = max(ROWS, 2 * rows)
        if rows:
            yield from compared(*(np.concatenate(c) for c in zip(*held, strict=True)))

    dealt = distinct.mapInArrow(keyed, "part int, value long, h long").repartition("part", "value").sortWithinPartitions("part", "value")
    return dealt.mapInArrow(run, "a long, b long")


def distance_counts(hashes: DataFrame, tile: int = TILE) -> DataFrame:
    """(distance, pairs): how many pairs of rows of `hashes(h)` are at each distance.

    All pairs are compared, since their number is what is asked for: rows are dealt to tiles of about `tile` hashes, and
    each cell of the grid of tiles is a task's work, of which it sends on the counts. The work is quadratic, as the
    question is; memory is bounded by two tiles. Null hashes take no part."""
    rows = cut(hashes.select("h").where("h is not null").withColumn("at", F.monotonically_increasing_id()))
    tiles = max(1, -(-rows.count() // tile))
    own = F.pmod(F.xxhash64("at"), F.lit(tiles)).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    dealt = met.select("h", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        left = part["h"][~part["second"]].to_numpy().view(np.uint64)
        alone = key[0] == key[1]
        right = left if alone else part["h"][part["second"]].to_numpy().view(np.uint64)
        counts = np.zeros(65, np.int64)
        for s in range(0, len(left), 256):
            counts += np.bincount(np.bitwise_count(left[s : s + 256, None] ^ right).ravel(), minlength=65)
        if alone:  # every pair was met twice, and every row with itself
            counts[0] -= len(left)
            counts //= 2
        return pd.DataFrame({"distance": np.flatnonzero(counts).astype(np.int32), "n": counts[counts > 0]})

    found = dealt.groupBy("a", "b").applyInPandas(run, "distance int, n long")
    return found.groupBy("distance").agg(F.sum("n").alias("pairs"))


def near_clusters(hashes: DataFrame, radius: int = RADIUS, scheme: str | None = None) -> DataFrame:
    """(h, cluster) of every hash that has a neighbour: cluster is the smallest hash of its component."""
    pairs = near_pairs(hashes, radius, scheme)
    return connected_components(pairs, "a", "b").select(F.col("node").alias("h"), F.col("component").alias("cluster"))


def deduplicate(items: DataFrame, radius: int = RADIUS, scheme: str | None = None) -> DataFrame:
    """`items` with is_duplicate, keeper_path (followed through both tiers) and tier (keeper, exact, near).

    Items without a hash are never linked; an exact copy of one still goes."""
    exact = cut(exact_tier(items))
    stand = exact.where("representative = path and perceptual_hash is not null")
    clusters = near_clusters(stand.select(F.col("perceptual_hash").alias("h")), radius, scheme)
    placed = stand.join(clusters, F.col("perceptual_hash") == F.col("h"), "left").withColumn("cluster", F.coalesce("cluster", "perceptual_hash"))
    winners = best_of(placed, "cluster")
    keepers = placed.join(winners, "cluster").select(F.col("path").alias("representative"), F.col("keeper").alias("keeper_path"))
    out = exact.join(keepers, "representative", "left").withColumn("keeper_path", F.coalesce("keeper_path", "representative"))
    tier = F.when(F.col("path") != F.col("representative"), "exact").when(F.col("path") != F.col("keeper_path"), "near").otherwise("keeper")
    return out.withColumns({"is_duplicate": F.col("path") != F.col("keeper_path"), "tier": tier}).select(
        *items.columns, "is_duplicate", "keeper_path", "tier"
    )


def summary(result: DataFrame) -> DataFrame:
    """(total, keepers, duplicates) in one row."""
    gone = F.count_if("is_duplicate")
    return result.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - gone).alias("keepers"), gone.alias("duplicates"))
