"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.shared import cut as _cut

#: Most edges (16 bytes each) that one task labels in memory; larger graphs are labelled in rounds over the cluster.
LOCAL_EDGES = 1 << 20


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", cut: Callable[[DataFrame], DataFrame] = _cut, local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """(node, component) with component = the smallest node of its component, for every node of an edge.

    A graph of at most `local_edges` edges (counted, not guessed) with integer nodes is labelled by one task in arrays.
    Larger ones take alternating large-star and small-star rounds: every node links its larger neighbours, then its
    smaller ones, to the smallest neighbour it knows. The number of edges never grows, a hub's edges shrink to one
    per neighbour in the first round, and the number of rounds is logarithmic in practice. Each round is written to
    shared storage, which ends its lineage. Nulls and self-loops make no edge; repeated edges count once; no edges
    give an empty result."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if isinstance(pairs.schema["u"].dataType, LongType) and pairs.count() <= local_edges:
        return cut(pairs.repartition(1).mapInArrow(_label, "node long, component long"))
    state = _fingerprint(pairs)
    while state[0]:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _fingerprint(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(roots.select("component", "component").distinct())


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, component of each) of the edges u - v: ends of an edge hang on the lesser of their roots until all agree."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        found = labels(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])


def _fingerprint(pairs: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal for equal edge sets."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
