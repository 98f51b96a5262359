"""A bounded parallel map: order kept, nulls dropped, the first exception ends it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parallel_map(rows: DataFrame, column: str, mapper: Callable, kind: str, workers: int) -> DataFrame:
    """(position, result) of `mapper` on every value of `column`, in at most `workers` tasks at a time; null results go.

    `position` follows the order of `rows`; sort by it where order matters."""
    placed = rows.select(F.monotonically_increasing_id().alias("position"), F.col(column).alias("value")).coalesce(max(1, workers))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, r) for p, v in zip(batch["position"], batch["value"], strict=True) if (r := mapper(v)) is not None]
            yield pd.DataFrame(found, columns=["position", "result"])

    return placed.mapInPandas(run, f"position long, result {kind}")
