"""Where every item goes: dated names under the destination, with rules for missing dates and taken names.

The plan is a DataFrame with `dest_path` (null: not filed) and `action` (file, rename, overwrite, skip, error); files
are touched only when a plan is applied. Items take names in the order is_duplicate, path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dated, effective_date, file_name, with_slashes
from ..model import Collision, NoDate, Settings
from ..plans.shared import cut

ORDER = ("is_duplicate", "path")


def target(settings: Settings) -> Column:
    """The name an item would have if nothing stood there."""
    fixed = F.col("exif_millis").isNull() & F.lit(settings.no_date is NoDate.FIXED_DIR)
    date = effective_date(F.col("exif_millis"), F.col("last_modified"))
    name = file_name(F.col("path"))
    root = (settings.destination or "").rstrip("/")
    base = F.when(F.col("is_duplicate"), F.lit(f"{root}/{settings.duplicates_dir}")).otherwise(F.lit(root))
    folder = F.when(fixed, F.lit(settings.no_date_dir)).otherwise(dated(date, settings.dir_format))
    stem = F.when(fixed, F.regexp_replace(name, r"(?s)\.[^.]*$", "")).otherwise(dated(date, settings.file_format))
    ending = F.regexp_extract(name, r"(?s)\.([^.]*)$", 1)  # the case of the letters stays
    return F.concat(with_slashes(F.concat_ws("/", base, folder, stem)), F.lit("."), ending)


def numbered_name(bare: Column, n: Column) -> Column:
    """`bare` with _001 and so on before its ending; n = 0 is `bare` itself."""
    stem, ending = F.regexp_extract(bare, r"(?s)^(.*)\.([^./]*)$", 1), F.regexp_extract(bare, r"(?s)^(.*)\.([^./]*)$", 2)
    return F.when(n == 0, bare).otherwise(F.format_string("%s_%03d.%s", stem, n, ending))


def numbered_readings(names: DataFrame) -> DataFrame:
    """(bare, n): each `dest_path` that reads as the n-th name of another one."""
    path = F.col("dest_path")
    pattern = r"(?s)^(.*)_(\d{3,9})\.([^./]*)$"
    n = F.regexp_extract(path, pattern, 2).try_cast("int")
    bare = F.concat(F.regexp_extract(path, pattern, 1), F.lit("."), F.regexp_extract(path, pattern, 3))
    read = names.where(path.rlike(pattern)).select(bare.alias("bare"), n.cast("long").alias("n"), path.alias("p"))
    return read.where((F.col("n") >= 1) & (numbered_name(F.col("bare"), F.col("n")) == F.col("p"))).select("bare", "n")


def taken_numbers(existing: DataFrame) -> DataFrame:
    """(bare, n): each existing path as a bare name, and as the n-th name of another where it reads so."""
    whole = existing.select(F.col("dest_path").alias("bare"), F.lit(0).cast("long").alias("n"))
    return whole.unionByName(numbered_readings(existing)).distinct()


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` with part and r, the rank (from 0) among the items that want one `bare` name; and (bare, part, first): the
    first rank of each part. Items are dealt by ranges of (bare, ORDER), so a name that very many want is ranked by many
    tasks; the ranges are written once, since ranks and counts have to see the same ones."""
    spread = cut(rows.repartitionByRange("bare", *ORDER).withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("bare", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("bare").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(counts.select("bare", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("bare", "part").orderBy(*ORDER)
    ranked = spread.withColumn("r", F.row_number().over(inside)).join(parts, ["bare", "part"])
    return ranked.withColumn("r", (F.col("first") + F.col("r") - 1).cast("long")).drop("first"), parts


def plan(items: DataFrame, settings: Settings, existing: DataFrame | None = None) -> DataFrame:
    """`items` (path, last_modified, exif_millis, is_duplicate) with dest_path and action.

    A bare name goes to the first item that wants it, if it is free. The others take the free numbers of that name in
    order; a number is taken if such a file stands, and if any item wants that name as its bare one, so no two items
    ever get one name. The r-th free number comes from ranks alone: with taken numbers o1 < o2 < ..., it is r (from 0)
    plus how many o_k - (k - 1) are at most r. So items and taken numbers are merged in one window per part of a name,
    and no array of taken names is built. Items of equal order take neighbouring names; other columns pass through."""
    spark = items.sparkSession
    if existing is None:
        existing = spark.createDataFrame([], "dest_path string")
    undated = F.col("exif_millis").isNull()
    stopped = undated & F.lit(settings.no_date is NoDate.STOP)
    skipped = undated & F.lit(settings.no_date is NoDate.SKIP)
    first = F.when(stopped, "error").when(skipped, "skip")
    row = F.struct(*items.columns).alias("row")
    rows = items.select(row, *ORDER, first.alias("action"), F.when(first.isNull(), target(settings)).alias("bare"))
    staying = rows.where("action is not null").select("row", F.lit(None).cast("string").alias("dest_path"), "action")
    ranked, parts = _ranked(rows.where("action is null").select("row", *ORDER, "bare"))
    if settings.collision is Collision.INCREASE:
        wanted = parts.select(F.col("bare").alias("dest_path")).distinct()
        taken = taken_numbers(existing).union(numbered_readings(wanted)).distinct()
        shifted = taken.withColumn("r", F.col("n") - F.row_number().over(Window.partitionBy("bare").orderBy("n")) + 1)
        # Each taken number falls into the part whose ranks it shifts first; a part starts with how many came before it.
        marks = parts.select("bare", "part", F.col("first").alias("r"), F.lit(0).alias("_taken")).unionByName(
            shifted.select("bare", F.lit(None).cast("int").alias("part"), "r", F.lit(1).alias("_taken"))
        )
        so_far = Window.partitionBy("bare").orderBy("r", "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marks = marks.select("bare", F.last("part", ignorenulls=True).over(so_far).alias("part"), "r", "_taken", F.sum("_taken").over(so_far).alias("_before"))
        marks = marks.where("part is not null").select("bare", "part", "r", F.lit(1).alias("_mark"), "_taken", "_before")
        merged = ranked.withColumns({"_mark": F.lit(0), "_taken": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
        order = Window.partitionBy("bare", "part").orderBy("r", F.desc("_mark"), "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = F.col("r") + F.coalesce(F.last("_before", ignorenulls=True).over(order), F.lit(0))
        named = merged.withColumn("n", n).where("_mark = 0")
        placed = named.withColumns({"dest_path": numbered_name(F.col("bare"), F.col("n")), "action": F.when(F.col("n") == 0, "file").otherwise("rename")})
    else:
        standing = existing.select(F.col("dest_path").alias("bare"), F.lit(True).alias("_held")).distinct()
        held = ranked.join(standing, "bare", "left")
        clash = F.coalesce("_held", F.lit(False)) | (F.col("r") > 0)
        action = {Collision.SKIP: "skip", Collision.STOP: "error", Collision.OVERWRITE: "overwrite"}[settings.collision]
        keeps = ~clash | F.lit(settings.collision is Collision.OVERWRITE)
        placed = held.withColumns({"dest_path": F.when(keeps, F.col("bare")), "action": F.when(clash, action).otherwise("file")})
    return placed.select("row", "dest_path", "action").unionByName(staying).select("row.*", "dest_path", "action")


def filed(planned: DataFrame) -> DataFrame:
    """Counts by action in one row, as a run reports them."""
    names = ("file", "rename", "overwrite", "skip", "error")
    return planned.agg(*[F.count_if(F.col("action") == a).alias(a) for a in names])
