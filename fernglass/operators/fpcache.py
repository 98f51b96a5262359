"""The fingerprint cache: known analyses by path, valid while size and modification time stay the same.

Stored as Parquet (`seq` orders writes; the last of a path counts) with a tab-separated form for exchange. Failed
analyses are cached like others, so they are not tried again until the file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import known, under_root

ENTRY = ["path", "file_size", "last_modified", "exif_millis", "perceptual_hash", "content_signature"]
#: The order of the tab-separated fields; the path is last, as it may hold tabs.
TSV = ["perceptual_hash", "file_size", "last_modified", "exif_millis", "content_signature", "path"]
SCHEMA = "path string, file_size bigint, last_modified bigint, exif_millis bigint, perceptual_hash bigint, content_signature bigint"


def last_wins(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The row of each key with the highest sequence; map-side, so a key written often is no hot task."""
    rest = [c for c in rows.columns if c not in (key, sequence)]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("_r"), F.max(sequence).alias(sequence))
    return picked.select(key, sequence, *[F.col("_r")[c].alias(c) for c in rest]).select(rows.columns)


def probe(scanned: DataFrame, cache: DataFrame) -> DataFrame:
    """`scanned` with the cached values and `hit`. A hit needs equal path, size and modification time."""
    held = cache.select(*ENTRY, F.lit(True).alias("hit"))
    joined = scanned.join(held, ["path", "file_size", "last_modified"], "left")
    return joined.withColumn("hit", F.coalesce("hit", F.lit(False)))


def merged(probed: DataFrame, computed: DataFrame) -> DataFrame:
    """Hits as they were and misses as computed."""
    return probed.where("hit").select(ENTRY).unionByName(computed.select(ENTRY))


def prune(cache: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """The cache without the paths under `root` that a complete scan of it did not see."""
    inside = under_root(F.col("path"), root)
    alive = cache.where(inside).join(seen.select("path").distinct(), "path", "left_semi")
    return cache.where(~inside).unionByName(alive.select(cache.columns))


def parse_tsv(lines: DataFrame, line: str = "value", sequence: str | None = None) -> DataFrame:
    """Entries of tab-separated lines; lines with too few fields or with non-numbers are dropped."""
    parts = F.split(F.col(line), "\t", 6)
    columns = {c: F.get(parts, k) if c == "path" else F.get(parts, k).try_cast("long") for k, c in enumerate(TSV)}
    rows = lines.where(F.size(parts) == 6).select(*[v.alias(c) for c, v in columns.items()], *([sequence] if sequence else []))
    whole = rows.where(" and ".join(f"{c} is not null" for c in TSV))
    dates = F.when(F.col("exif_millis") != -1, F.col("exif_millis"))
    return whole.withColumns(
        {"exif_millis": dates, "perceptual_hash": known(F.col("perceptual_hash")), "content_signature": known(F.col("content_signature"))}
    ).select(*ENTRY, *([sequence] if sequence else []))


def format_tsv(cache: DataFrame) -> DataFrame:
    """(value): one line an entry; none is 0 for hashes and signatures and -1 for dates."""
    none = {"exif_millis": -1, "perceptual_hash": 0, "content_signature": 0}
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(str(none.get(c, "")))) for c in TSV]
    return cache.select(F.concat_ws("\t", *fields).alias("value"))


def load_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated cache file; of lines for one path the last counts."""
    lines = spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id())
    return last_wins(parse_tsv(lines, sequence="_seq"), "path", "_seq").drop("_seq")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet cache at `path`, or an empty one."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # Spark tells a missing path only by its error class
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return empty(spark)
        raise
    return last_wins(rows.select(*ENTRY, "seq"), "path", "seq").drop("seq")


def append(entries: DataFrame, path: str, sequence: int) -> None:
    """Add entries as one write; task commits bound what a failure loses."""
    entries.select(*ENTRY, F.lit(sequence).cast("long").alias("seq")).write.mode("append").parquet(path)


def compact(spark: SparkSession, path: str, target: str, seen: DataFrame | None = None, root: str | None = None) -> bool:
    """Write the live entries to `target` if the cache at `path` holds superseded or pruned ones; tells whether it did."""
    live = load(spark, path)
    if seen is not None and root is not None:
        live = prune(live, seen, root)
    if live.count() >= spark.read.parquet(path).count():
        return False
    live.withColumn("seq", F.lit(0).cast("long")).write.mode("overwrite").parquet(target)
    return True

