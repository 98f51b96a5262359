"""A whole run: scan, analyse what the cache does not know, find duplicates, plan, apply, report."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Settings, settings_from_file
from .operators import dedup, fpcache, layout
from .operators.apply import apply, destination_listing
from .plans.shared import cut
from .sources.extract import add_picture_hashes, extract
from .sources.listing import scan


#: Files that are analysed between two writes of the cache.
ROUND = 50_000


def items_of(spark: SparkSession, settings: Settings) -> tuple[DataFrame, dict[str, int]]:
    """The analysed items of a source tree and the counts of the scan. Only a completed scan prunes the cache."""
    scanned = cut(scan(spark, settings.source or ""))
    cache = fpcache.load(spark, settings.cache_file) if settings.use_cache else fpcache.empty(spark)
    probed = cut(fpcache.probe(scanned, cache))
    misses = probed.where("not hit").select("path", "file_size", "last_modified")
    # Misses are analysed in rounds of about ROUND files, and each round is kept in the cache before the next one begins:
    # a run that fails goes on from there.
    rounds = max(1, -(-misses.count() // ROUND)) if settings.use_cache else 1
    computed = fpcache.empty(spark)
    for k in range(rounds):
        part = misses.where(F.pmod(F.xxhash64("path"), F.lit(rounds)) == k)
        made = extract(part.repartition(max(1, settings.workers or spark.sparkContext.defaultParallelism)), settings.sign_all, decode=False)
        made = cut(add_picture_hashes(cut(made), settings.source))
        if settings.use_cache and not made.isEmpty():
            fpcache.append(made, settings.cache_file, time.time_ns())
        computed = computed.unionByName(made.select(computed.columns))
    items = cut(fpcache.merged(probed, computed))
    if settings.use_cache:
        if os.path.isdir(settings.cache_file):
            spare = f"{settings.cache_file}.new"
            if fpcache.compact(spark, settings.cache_file, spare, scanned, settings.source):
                old = f"{settings.cache_file}.old"
                os.rename(settings.cache_file, old)
                os.rename(spare, settings.cache_file)
                _remove(old)
    counts = probed.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("hit").alias("cache_hits")).first().asDict()
    return items, counts


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder)


def run(spark: SparkSession, settings: Settings, allow_overwrite: bool = False) -> dict[str, float]:
    """Counts of the run: scanned, cache_hits, duplicates, filed, failed, seconds."""
    began = time.monotonic()
    items, counts = items_of(spark, settings)
    result = cut(dedup.deduplicate(items))
    planned = cut(layout.plan(result, settings, destination_listing(spark, settings.destination or "")))
    done = cut(apply(planned, settings, allow_overwrite))
    filed = done.agg(F.count_if("done").alias("filed"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
    return counts | {"duplicates": result.where("is_duplicate").count()} | filed | {"seconds": round(time.monotonic() - began, 3)}


def report(counts: dict[str, float]) -> str:
    width = max(map(len, counts))
    return "\n".join(f"{name.replace('_', ' '):<{width}} : {value}" for name, value in counts.items())


def main(arguments: list[str]) -> int:
    try:
        settings = settings_from_file(arguments[0] if arguments else "config.properties")
    except (OSError, ValueError) as e:
        print(f"cannot read the configuration: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("fernglass").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(report(run(spark, settings, "--overwrite" in arguments)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
