"""Fixed-size arrays summed over a whole table: each task sends its array in blocks, blocks are combined as streams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import sorted_groups

#: Cells of a block.
BLOCK = 1 << 16


def blocks_of(array: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The blocks of an array that hold anything, compressed."""
    for k in range(0, len(array), BLOCK):
        part = array[k : k + BLOCK]
        if part.any():
            yield k // BLOCK, zlib.compress(part.tobytes(), 1)


def combined(blocks: DataFrame, size: int, kind: str, how: str, finish=None) -> np.ndarray:
    """`blocks(block int, data binary)` combined by the ufunc `how` into one array of `size` cells on the driver.

    `size` is a constant of the caller and so bounds what is collected. `finish` maps a combined block to what is
    sent, for instance to fewer bytes a cell."""
    ufunc = getattr(np, how)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (block,), parts in sorted_groups(batches, ["block"]):
            total = None
            for part in parts:
                for data in part["data"]:
                    array = np.frombuffer(zlib.decompress(data), kind)
                    total = array.copy() if total is None else ufunc(total, array)
            out = total if finish is None else finish(total)
            yield pd.DataFrame({"block": [block], "data": [zlib.compress(out.tobytes(), 1)]})

    rows = (
        blocks.repartition(max(1, min(size // BLOCK, 64)), "block")
        .sortWithinPartitions("block")
        .mapInPandas(run, "block int, data binary")
        .collect()
    )
    out: np.ndarray | None = None
    for row in rows:
        part = np.frombuffer(zlib.decompress(row["data"]), kind if finish is None else np.uint8)
        if out is None:
            out = np.zeros(size, part.dtype)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return np.zeros(size, kind if finish is None else np.uint8) if out is None else out
