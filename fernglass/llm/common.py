"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, shared_dir  # noqa: F401  re-exported

#: Words of the data contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that Spark's readers open (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(rows: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `rows` is called so."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered(rows: DataFrame, column: str = "doc_id") -> DataFrame:
    """`column` as a long that pandas can hold exactly, with `no_id` where it is null."""
    return rows.withColumns({column: F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")), "no_id": F.col(column).isNull()})


def renulled(column: str = "doc_id") -> Column:
    return F.when(~F.col("no_id"), F.col(column)).alias(column)


def shuffles(spark: SparkSession, times: int = 1) -> int:
    """A number of partitions that follows the size the cluster was set up for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * times)


def sorted_groups(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
    """Walk a partition that is sorted by `key`: one (key, slices) at a time, without holding a group whole.

    The slices of a group must be used up before the next group is asked for."""
    source = iter(batches)
    pending: list[pd.DataFrame] = []

    def pull() -> pd.DataFrame | None:
        while True:
            if pending:
                return pending.pop()
            batch = next(source, None)
            if batch is None:
                return None
            if len(batch):
                return batch

    def slices(of: tuple) -> Iterator[pd.DataFrame]:
        while (batch := pull()) is not None:
            same = pd.Series(True, index=batch.index)
            for name, value in zip(key, of, strict=True):
                same &= batch[name] == value
            n = len(batch) if same.all() else int(same.to_numpy().argmin())
            if n < len(batch):
                pending.append(batch.iloc[n:].reset_index(drop=True))
            if n:
                yield batch.iloc[:n]
            if n < len(batch):
                return

    while (batch := pull()) is not None:
        of = tuple(batch[name].iloc[0] for name in key)
        pending.append(batch)
        mine = slices(of)
        yield of, mine
        for _ in mine:  # whatever the caller left over
            pass
