"""Incremental analysis of a landing table of scanned files, as a stream.

Each micro-batch probes the cache, analyses the misses and appends them under the batch's id; a batch that is run
again writes the same entries under the same sequence, and loading takes one of them. No watermark applies:
copies may arrive at any time, so the cache itself is the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import SCANNED
from ..operators import fpcache
from ..sources.extract import extract


def landing(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of scanned rows written as Parquet under `path`; at most `files_per_batch` files in a batch."""
    return spark.readStream.schema(SCANNED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fingerprints(
    scanned: DataFrame, cache_path: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] = extract
) -> StreamingQuery:
    """Keep the cache at `cache_path` up with a stream of scanned rows; ends when all that has landed is done."""

    def step(batch: DataFrame, number: int) -> None:
        probed = fpcache.probe(batch, fpcache.load(batch.sparkSession, cache_path))
        fpcache.append(analyse(probed.where("not hit").select("path", "file_size", "last_modified")), cache_path, number)

    return scanned.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
