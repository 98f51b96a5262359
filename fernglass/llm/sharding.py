"""Jump consistent hashing of rows to shards, and gapless slots inside each shard.

Law: the key and the number of shards decide. With one more shard a row either stays or moves to the new
shard (a share of 1/(n+1)). No ring table exists; a row's shard is computed from its key alone.

Edge cases: a null key counts as key 0; a null text has size 1 and checksum 0, as the empty text; equal keys
share a shard; repeated rows get slots of their own; an empty table gives an empty result. Input columns other
than the named ones are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, table, text_or_empty

#: Fixed multiplier of the generator in the published jump hash, in two 32-bit halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
#: Parts of a shard that are numbered independently; bounds the offset table at shards * PARTS rows.
PARTS = 1024
M32 = 0xFFFFFFFF


def _mul32(a: Column, b: int) -> Column:
    """Low 32 bits of a * b for 32-bit values, never above 2**49 on the way."""
    return (a * (b & 0xFFFF) + F.shiftleft((a * (b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(M32))


def step(state: Column) -> Column:
    """The generator's next state, as struct(hi, lo) of unsigned 32-bit halves held in longs: overflow-free under ANSI."""
    hi, lo = state["hi"], state["lo"]
    upper = lo * (LOW >> 16)
    low = lo * (LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(upper, 16) + _mul32(hi, LOW) + _mul32(lo, HIGH)
    return F.struct(high.bitwiseAND(F.lit(M32)).alias("hi"), low.bitwiseAND(F.lit(M32)).alias("lo"))


def start(key: Column) -> Column:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(M32).cast("long")).alias("lo"))


def jump(key: Column, shards: int) -> Column:
    """The shard of `key` among `shards`, 0 to shards-1. Every jump goes up by one at least, so `shards` rounds do."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    begin = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), start(key).alias("s"))

    def advance(acc: Column, _: Column) -> Column:
        def after(state: Column) -> Column:
            odds = F.lit(float(1 << 31)) / (F.shiftright(state["hi"], 1) + 1).cast("double")
            return F.struct(acc["j"].alias("b"), F.floor((acc["j"] + 1).cast("double") * odds).alias("j"), state.alias("s"))

        return F.when(acc["j"] < shards, let(step(acc["s"]), after)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, advance, lambda acc: acc["b"].cast("int"))


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id", parts: int = PARTS) -> DataFrame:
    """Add `shard`, `grown_shard` (with one more shard) and `slot` (gapless from 0 in each shard).

    A shard is numbered in `parts` independent pieces: the rows of a piece are counted first (a column-pruned
    pass with map-side sums), running totals give each piece its first slot, and only then are rows numbered
    inside their piece. No task holds a whole shard. The offsets are at most shards * parts rows, which is the
    proven bound under which they are broadcast."""
    placed = rows.withColumns(
        {
            "shard": jump(F.col(key), shards),
            "grown_shard": jump(F.col(key), shards + 1),
            "_part": let(step(start(F.col(key))), lambda s: F.shiftright(s["hi"], 1) % parts).cast("int"),
        }
    )
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    plain = [f.name for f in rows.schema if f.name != key and isinstance(f.dataType, T.AtomicType)]
    inside = Window.partitionBy("shard", "_part").orderBy(key, *plain)
    numbered = placed.withColumn("_at", F.row_number().over(inside) - 1)
    slotted = numbered.join(F.broadcast(offsets), ["shard", "_part"])
    return slotted.withColumn("slot", F.col("_first") + F.col("_at")).drop("_part", "_first", "_at")


def op8_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
    )
    return shard_rows(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
