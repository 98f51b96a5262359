"""Exact top-k by inner product: tiles of queries times tiles of candidates, merged as a tree.

The query block of a grid cell is held, candidate tiles stream past it: one matrix product per tile, a partial
selection, and a merge with the lists so far. Cells come from a grid of `query_parts` x `candidate_parts`, so a
query row is sent to `candidate_parts` cells and a candidate to `query_parts`; neither side is ever broadcast or
collected. Lists are merged in two levels of windows over at most k rows a cell.

Edge cases: null vectors and vectors with a null or non-finite component take no part (empty ones neither);
vectors of different lengths are compared only with their equals; rows that repeat an id and vector count once;
rows that share an id with the query are never its candidates; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives an empty result. Components whose scaled value no double holds count
as non-finite. Scores are exact and ranked exactly at any size; one beyond 64 bits is returned as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffles, sorted_groups, table

#: Candidates and queries in one matrix product, and queries that a grid cell holds on average.
TILE, ROWS, CELL_QUERIES = 2048, 1024, 8192
#: Stands for "no candidate" among 64-bit scores, which `products` keeps above it; its negative is an int64 too.
NONE = -((1 << 63) - 1)
#: Scores beyond 64 bits also travel as bytes of this many, offset by half their range, so that they compare like numbers.
WIDE = 288


def integer_vectors(rows: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, vec) with floor(scale * x) of every usable vector, as whole doubles: all above 2**53 are whole already."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * float(scale))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(id_column).isNotNull()).filter(finite)
    vec = F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v) + F.lit(0.0))
    return usable.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec"))


_whole_numbers = np.frompyfunc(int, 1, 1)


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles: through float64 where no sum can pass 2**53, in int64 where none can reach
    the mark NONE, else as Python's integers of any size."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0)) * max(1, queries.shape[1])
    if most < 1 << 53:
        return (queries @ tile.T).astype(np.int64)
    if most < 1 << 62:
        return queries.astype(np.int64) @ tile.astype(np.int64).T
    return _whole_numbers(queries) @ _whole_numbers(tile).T


def _select(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best by (score descending, id ascending); ids and scores are of one shape."""
    if scores.dtype == object:
        rows = [sorted(zip(r, i, strict=True), key=lambda x: (-x[0], x[1]))[:k] for r, i in zip(scores, ids.tolist(), strict=True)]
        best = np.empty((len(rows), min(k, scores.shape[1])), object)
        best[:] = [[score for score, _ in r] for r in rows]
        return np.array([[i for _, i in r] for r in rows], np.int64).reshape(best.shape), best
    if scores.shape[1] > k:  # keep all that tie with the k-th, then order exactly
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        width = int((scores >= floor[:, None]).sum(axis=1).max())
        if width < scores.shape[1]:
            at = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _reported(score: int) -> tuple[int, bytes | None]:
    """A score as the nearest long, and as bytes if it is not below the longs' limits."""
    limit = (1 << 63) - 1
    if abs(score) < limit:
        return score, None
    return max(-limit - 1, min(limit, score)), (score + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big")


def without_repeats(part: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Drop rows equal to the row before (the part is sorted by kind, id and vec); `last` is the row before the part."""
    keep = np.ones(len(part), bool)
    for n, row in enumerate(zip(part["kind"], part["id"], part["vec"], strict=True)):
        if last is not None and row[0] == last[0] and row[1] == last[1] and np.array_equal(row[2], last[2]):
            keep[n] = False
        last = row
    return part[keep], last


class Block:
    """Queries of one vector length in one cell, with their best candidates so far."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.vectors = np.array([v for _, v in rows], np.float64)
        self.top_ids = self.top = np.zeros((len(rows), 0), np.int64)

    def meet(self, tile_ids: np.ndarray, tile: np.ndarray, k: int) -> None:
        scores = products(self.vectors, tile)
        same = self.ids[:, None] == tile_ids
        if scores.dtype == object or self.top.dtype == object:
            scores, self.top = scores.astype(object), self.top.astype(object)
            self.top[self.top == NONE] = -math.inf
            scores[same] = -math.inf
        else:
            scores[same] = NONE
        ids, top = _select(np.broadcast_to(tile_ids, scores.shape), scores, k)
        self.top_ids, self.top = _select(np.hstack([self.top_ids, ids]), np.hstack([self.top, top]), k)

    def found(self, cell: int) -> pd.DataFrame:
        query_ids, vec_ids, top = np.repeat(self.ids, self.top.shape[1]), self.top_ids.ravel(), self.top.ravel()
        real = top != (-math.inf if top.dtype == object else NONE)
        scores, wide = top[real], None
        if top.dtype == object:
            reported = [_reported(score) for score in scores]
            scores, wide = np.array([score for score, _ in reported], np.int64), [w for _, w in reported]
        return pd.DataFrame({"query_id": query_ids[real], "cell": cell, "vec_id": vec_ids[real], "score": scores, "wide": wide})


def search_cells(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (cell,), parts in sorted_groups(batches, ["cell"]):
            held: dict[int, list[tuple[int, np.ndarray]]] = {}
            blocks: dict[int, list[Block]] = {}
            last = None
            for part in parts:
                part, last = without_repeats(part, last)
                is_query = part["kind"].to_numpy() == 0
                for i, v in zip(part["id"][is_query], part["vec"][is_query], strict=True):
                    held.setdefault(len(v), []).append((i, v))
                rest = part[~is_query]
                if len(rest) and not blocks:
                    blocks = {d: [Block(rows[s : s + ROWS]) for s in range(0, len(rows), ROWS)] for d, rows in held.items()}
                sizes = rest["vec"].map(len).to_numpy()
                for d, of_length in blocks.items():
                    own = rest[sizes == d]
                    for s in range(0, len(own), TILE):
                        tile = own.iloc[s : s + TILE]
                        vectors = np.stack(tile["vec"].to_numpy())
                        for block in of_length:
                            block.meet(tile["id"].to_numpy(np.int64), vectors, k)
            for block in (b for of_length in blocks.values() for b in of_length):
                yield block.found(cell)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, candidate_parts: int, query_parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors(id, vec)` that `is_query` picks, against all rows."""
    if query_parts is None:
        query_parts = -(-vectors.filter(is_query).count() // CELL_QUERIES) or 1
    vectors = vectors.withColumn("_row", F.xxhash64("id", "vec"))
    row_c = F.pmod(F.col("_row"), F.lit(candidate_parts))
    row_q = F.pmod(F.shiftright("_row", 20), F.lit(query_parts))
    candidates = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("_q"), row_c.alias("_c"), F.lit(1).alias("kind"), "id", "vec"
    )
    queries = vectors.filter(is_query).select(
        row_q.alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(candidate_parts - 1))).alias("_c"), F.lit(0).alias("kind"), "id", "vec"
    )
    cells = queries.unionByName(candidates).select((F.col("_q") * candidate_parts + F.col("_c")).cast("long").alias("cell"), "kind", "id", "vec")
    dealt = cells.repartition(candidate_parts * query_parts, "cell").sortWithinPartitions("cell", "kind", "id", "vec")
    found = dealt.mapInPandas(search_cells(k), "query_id long, cell long, vec_id long, score long, wide binary")
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.desc_nulls_last("wide"), "vec_id")
    branch = found.withColumn("branch", F.col("cell") % 16).withColumn("rank", F.row_number().over(best("query_id", "branch"))).filter(F.col("rank") <= k)
    merged = branch.withColumn("rank", F.row_number().over(best("query_id"))).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return top_k(vectors, F.col("id") % 50 == 0, k, candidate_parts=shuffles(spark))
