"""The registered queries of the media operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as c
from .functions import content
from .model import Collision, NoDate, Settings
from .operators import dedup, fpcache, layout
from .operators.components import connected_components
from .plans.shared import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- names, kinds and dates -------------------------------------------------------------------------------------

#: Name stems and endings dealt to documents: mixed case, none, leading dot, several dots.
ENDINGS = (".JPG", ".jpg", ".tar.gz", "", ".Mp4", ".png", ".txt", ".MTS", ".", ".heic")
NAMED_SQL = f"""
named AS (SELECT doc_id, n_chars,
  CASE WHEN doc_id % 13 = 0 THEN '.jpg' ELSE 'f' || doc_id || list_extract([{", ".join(f"'{e}'" for e in ENDINGS)}], (doc_id % 10 + 1)::int) END AS name,
  n_chars * 100000 AS size, doc_id * 1000000000 AS mtime FROM documents)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 10 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 13 == 0, ".jpg").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ending))
    return read(spark, sf_dir, "documents").select(
        "doc_id", name.alias("name"), (F.col("n_chars") * 100_000).alias("size"), (F.col("doc_id") * 1_000_000_000).alias("mtime")
    )


@query(f"""WITH {NAMED_SQL}, e AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM named)
SELECT doc_id, name, ext, ext IN ('mp4','avi','3gp','mov','wmv','mts') AS film,
  size <= 104857600 AND ext NOT IN ('mp4','avi','3gp','mov','wmv','mts') AS decodable,
  CASE WHEN mtime < 631152000000 THEN mtime + 7 ELSE mtime END AS believable FROM e
WHERE ext IN ('heic','heif','jpg','jpeg','png','mp4','avi','3gp','mov','wmv','mts')""")
def scan_supported_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return (
        _named(spark, sf_dir)
        .where(c.is_supported(name))
        .select(
            "doc_id", "name", c.extension(name).alias("ext"), c.is_film(name).alias("film"),
            c.is_decodable(name, F.col("size")).alias("decodable"), c.believable_mtime(F.col("mtime"), F.col("mtime") + 7).alias("believable"),
        )
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items: no capture date for each fifth."""
    stamp = F.unix_millis(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("in/IMG_"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".JPG").otherwise(".mp4")).alias("path"),
        stamp.alias("last_modified"),
        F.when(F.col("event_id") % 5 != 0, stamp + F.col("event_id") % 1000 * 1000).alias("exif_millis"),
        (F.col("event_id") % 7 == 0).alias("is_duplicate"),
    )


EVENTS_SQL = """
ev AS (SELECT event_id, 'in/IMG_' || event_id || CASE WHEN event_id % 2 = 0 THEN '.JPG' ELSE '.mp4' END AS path,
  (epoch_us(ts) // 1000) AS last_modified, CASE WHEN event_id % 5 <> 0 THEN (epoch_us(ts) // 1000) + event_id % 1000 * 1000 END AS exif_millis,
  event_id % 7 = 0 AS is_duplicate FROM events),
it AS (SELECT *, coalesce(exif_millis, last_modified) AS d, regexp_extract(path, '([^/]*)$', 1) AS name FROM ev)"""


@query(f"WITH {EVENTS_SQL} SELECT event_id, d AS effective_millis, exif_millis IS NOT NULL AS has_date FROM it")
def effective_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir)
    date = c.effective_date(F.col("exif_millis"), F.col("last_modified"))
    return items.select("event_id", date.alias("effective_millis"), F.col("exif_millis").isNotNull().alias("has_date"))


# --- exact and near duplicates ----------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: size n_chars, signature from md5(text), and a 64-bit fingerprint of the words.

    Bit b >= 1 is set where the words of bucket b are more than the mean of buckets 1 to 63. Counted inside the row."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % 64
    signature = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", signature.alias("content_signature"), F.transform(words, bucket).alias("b"))
    counts = docs.select("doc_id", "n_chars", "content_signature", F.explode_outer("b").alias("b")).groupBy("doc_id", "n_chars", "content_signature", "b").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum(F.when(F.col("b") > 0, F.col("n"))).over(Window.partitionBy("doc_id"))
    bit = F.when((F.col("b") > 0) & (F.col("n") * 63 > F.col("s")), F.expr("shiftleft(1L, b)")).otherwise(F.lit(0).cast("long"))
    return (
        counts.withColumn("s", total)
        .groupBy("doc_id")
        .agg(F.first("n_chars").alias("file_size"), F.bit_or(bit).alias("perceptual_hash"), F.first("content_signature").alias("content_signature"))
        .withColumn("path", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    )


DOCS_SQL = """
tok AS (SELECT doc_id, ('0x' || left(md5(w), 2))::int % 64 AS b FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''),
cnt AS (SELECT doc_id, b, count(*) AS n FROM tok GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) FILTER (b > 0) AS s FROM cnt GROUP BY 1),
u AS (SELECT doc_id, sum(CASE WHEN b > 0 AND 63 * n > s THEN (1::hugeint) << b ELSE 0 END) AS u FROM cnt JOIN s USING (doc_id) GROUP BY 1),
items AS (SELECT d.doc_id, '/docs/' || d.doc_id || '.txt' AS path, n_chars AS file_size,
  (CASE WHEN coalesce(u, 0) >= 9223372036854775808::hugeint THEN u - 18446744073709551616::hugeint ELSE coalesce(u, 0) END)::bigint AS perceptual_hash,
  ('0x' || left(md5(text), 15))::bigint AS content_signature FROM documents d LEFT JOIN u USING (doc_id)),
ranked AS (SELECT *, first_value(path) OVER (PARTITION BY file_size, content_signature ORDER BY length(path), path) AS representative FROM items),
reps AS (SELECT * FROM ranked WHERE path = representative AND perceptual_hash <> 0),
hs AS (SELECT DISTINCT perceptual_hash AS h FROM reps),
pairs AS (SELECT a.h AS a, b.h AS b FROM hs a JOIN hs b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 5),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)"""
CLUSTER_SQL = """
walk AS (SELECT h AS node, h AS seen FROM hs UNION SELECT walk.node, edges.b FROM walk JOIN edges ON walk.seen = edges.a),
cl AS (SELECT node AS h, min(seen) AS cluster FROM walk GROUP BY 1),
kept AS (SELECT representative, first_value(path) OVER (PARTITION BY cluster ORDER BY file_size DESC, length(path), path) AS keeper FROM reps JOIN cl ON perceptual_hash = h),
result AS (SELECT r.doc_id, r.path, coalesce(keeper, r.representative) AS keeper_path,
  r.path <> coalesce(keeper, r.representative) AS is_duplicate,
  CASE WHEN r.path <> r.representative THEN 'exact' WHEN r.path <> coalesce(keeper, r.representative) THEN 'near' ELSE 'keeper' END AS tier
  FROM ranked r LEFT JOIN kept USING (representative))"""


@query(f"WITH {DOCS_SQL} SELECT doc_id, perceptual_hash, lpad(lower(to_hex(perceptual_hash)), 16, '0') AS hash_text FROM items")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "perceptual_hash", c.hash_text(F.col("perceptual_hash")).alias("hash_text"))


@query("""SELECT n_chars AS file_size, ('0x' || left(md5(text), 15))::bigint AS content_signature, count(*) AS members
FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("content_signature")
    docs = read(spark, sf_dir, "documents").select(F.col("n_chars").alias("file_size"), signature)
    return docs.groupBy("file_size", "content_signature").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def _plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("file_size"),
        F.lit(None).cast("long").alias("perceptual_hash"),
        F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("content_signature"),
    )


@query("""SELECT doc_id, first_value('/docs/' || doc_id || '.txt') OVER (PARTITION BY n_chars, md5(text) ORDER BY length('' || doc_id), '' || doc_id) AS representative
FROM documents""")
def exact_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_tier(_plain_items(spark, sf_dir)).select("doc_id", "representative")


@query(f"""WITH {DOCS_SQL}, parts AS (SELECT unnest([{{'p': 0, 'o': 0, 'w': 11}}, {{'p': 1, 'o': 11, 'w': 11}}, {{'p': 2, 'o': 22, 'w': 11}}, {{'p': 3, 'o': 33, 'w': 11}}, {{'p': 4, 'o': 44, 'w': 10}}, {{'p': 5, 'o': 54, 'w': 10}}]) AS x)
SELECT doc_id, x.p AS part, (perceptual_hash >> x.o) & ((1 << x.w) - 1) AS value FROM items, parts""")
def hash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = dedup.blocking_keys(F.col("perceptual_hash"), 5, "slices")
    return _documents(spark, sf_dir).select("doc_id", F.inline(keys))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::double * 1000)::bigint) AS q FROM embeddings),
e AS (SELECT vec_id, unnest(list_slice(q, 2, 64)) AS x, unnest(range(1, 64)) AS b, list_sum(list_slice(q, 2, 64)) AS s FROM v),
h AS (SELECT vec_id, sum(CASE WHEN 63 * x > s THEN (1::hugeint) << b ELSE 0 END) AS h FROM e GROUP BY 1)
SELECT bit_count(xor(a.h, b.h))::int AS distance, count(*) AS pairs FROM h a JOIN h b ON a.vec_id < b.vec_id GROUP BY 1""")
def hamming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of vectors have hashes at each distance. The count of all pairs is the feature, so all of them are
    compared, in tiles of a grid; a task sends on 65 counts."""
    q = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    vec = read(spark, sf_dir, "embeddings").select("vec_id", F.slice(q, 2, 63).alias("q"))
    s = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    bits = lambda total: F.aggregate(
        F.transform("q", lambda x, k: F.when(x * 63 > total, F.expr("1L")).otherwise(F.lit(0).cast("long"))),
        F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).alias("b")),
        lambda acc, bit: F.struct(acc["h"].bitwiseOR(F.call_function("shiftleft", bit, acc["b"])).alias("h"), (acc["b"] + 1).alias("b")),
        lambda acc: acc["h"],
    )
    hashes = vec.withColumn("s", s).select("vec_id", bits(F.col("s")).alias("h"))
    return dedup.distance_counts(hashes.select("h"))


def _stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = dedup.exact_tier(cut(_documents(spark, sf_dir)))  # written, as both sides of the tier's join read it
    return exact.where("representative = path and perceptual_hash is not null").select(F.col("perceptual_hash").alias("h"))


@query(f"WITH {DOCS_SQL} SELECT a, b FROM pairs")
def near_pairs_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_stand_ins(spark, sf_dir), scheme="slices")


@query(f"WITH {DOCS_SQL} SELECT a, b FROM pairs")
def near_pairs_wide_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_stand_ins(spark, sf_dir), scheme="triples")


@query(f"WITH RECURSIVE {DOCS_SQL}, {CLUSTER_SQL} SELECT h, cluster FROM cl WHERE h IN (SELECT a FROM edges)")
def near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(dedup.near_pairs(_stand_ins(spark, sf_dir)), "a", "b").select(F.col("node").alias("h"), F.col("component").alias("cluster"))


@query(f"WITH RECURSIVE {DOCS_SQL}, {CLUSTER_SQL} SELECT doc_id, is_duplicate, keeper_path, tier FROM result")
def dedup_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(cut(_documents(spark, sf_dir))).select("doc_id", "is_duplicate", "keeper_path", "tier")


@query(f"WITH RECURSIVE {DOCS_SQL}, {CLUSTER_SQL} SELECT count(*) AS total, count(*) FILTER (NOT is_duplicate) AS keepers, count(*) FILTER (is_duplicate) AS duplicates FROM result")
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.summary(dedup.deduplicate(cut(_documents(spark, sf_dir))))


@query("""SELECT doc_id, first_value('/docs/' || doc_id || '.txt') OVER (PARTITION BY n_chars, md5(text), CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -1 END
ORDER BY length('' || doc_id), '' || doc_id) AS keeper_path FROM documents""")
def zero_hash_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No item has a hash, and each third has no signature: those are never anybody's copies."""
    items = _plain_items(spark, sf_dir).withColumns(
        {"perceptual_hash": F.lit(0).cast("long"), "content_signature": F.when(F.col("doc_id") % 3 != 0, F.col("content_signature")).otherwise(F.lit(0).cast("long"))}
    )
    return dedup.deduplicate(items).select("doc_id", "keeper_path")


# --- the fingerprint cache --------------------------------------------------------------------------------------

CACHE_SQL = """
sc AS (SELECT '/photos' || CASE WHEN doc_id % 4 = 0 THEN '2' ELSE '' END || '/' || doc_id AS path, n_chars AS file_size, doc_id * 10 AS last_modified, doc_id FROM documents),
ca AS (SELECT path, file_size + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS file_size, last_modified + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS last_modified,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 7 END AS exif_millis, doc_id * 3 + 1 AS perceptual_hash, doc_id + 9 AS content_signature FROM sc WHERE doc_id % 3 <> 0)"""


def _scan_and_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    folder = F.when(i % 4 == 0, "/photos2/").otherwise("/photos/")
    scan = read(spark, sf_dir, "documents").select("doc_id", F.concat(folder, i.cast("string")).alias("path"), F.col("n_chars").alias("file_size"), (i * 10).alias("last_modified"))
    cache = scan.where(i % 3 != 0).select(
        "path",
        (F.col("file_size") + F.when(i % 11 == 0, 1).otherwise(0)).alias("file_size"),
        (F.col("last_modified") + F.when(i % 17 == 0, 1).otherwise(0)).alias("last_modified"),
        F.when(i % 5 != 0, i * 7).alias("exif_millis"),
        (i * 3 + 1).alias("perceptual_hash"),
        (i + 9).alias("content_signature"),
    )
    return scan, cache


@query(f"""WITH {CACHE_SQL} SELECT sc.doc_id, ca.path IS NOT NULL AS hit, ca.exif_millis, ca.perceptual_hash, ca.content_signature
FROM sc LEFT JOIN ca ON sc.path = ca.path AND sc.file_size = ca.file_size AND sc.last_modified = ca.last_modified""")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, cache = _scan_and_cache(spark, sf_dir)
    return fpcache.probe(scan, cache).select("doc_id", "hit", "exif_millis", "perceptual_hash", "content_signature")


@query(f"""WITH {CACHE_SQL} SELECT count(*) AS scanned, count(ca.path) AS cache_hits FROM sc
LEFT JOIN ca ON sc.path = ca.path AND sc.file_size = ca.file_size AND sc.last_modified = ca.last_modified""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, cache = _scan_and_cache(spark, sf_dir)
    return fpcache.probe(scan, cache).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("hit").alias("cache_hits"))


@query(f"""WITH {CACHE_SQL} SELECT sc.path, sc.file_size, coalesce(ca.perceptual_hash, -sc.doc_id) AS perceptual_hash FROM sc
LEFT JOIN ca ON sc.path = ca.path AND sc.file_size = ca.file_size AND sc.last_modified = ca.last_modified""")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, cache = _scan_and_cache(spark, sf_dir)
    probed = fpcache.probe(scan, cache)
    computed = probed.where("not hit").withColumn("perceptual_hash", -F.col("doc_id"))
    return fpcache.merged(probed, computed).select("path", "file_size", "perceptual_hash")


@query(f"""WITH {CACHE_SQL} SELECT path FROM ca WHERE NOT starts_with(path, '/photos/') OR path IN (SELECT path FROM sc WHERE doc_id % 2 = 0)""")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, cache = _scan_and_cache(spark, sf_dir)
    return fpcache.prune(cache, scan.where("doc_id % 2 = 0"), "/photos").select("path")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def cache_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpcache.last_wins(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"""WITH {CACHE_SQL} SELECT path || chr(9) || 'x' AS path, file_size, exif_millis, perceptual_hash FROM ca""")
def cache_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = _scan_and_cache(spark, sf_dir)
    tabbed = cache.withColumn("path", F.concat("path", F.lit("\tx")))
    broken = cache.select(F.explode(F.array(F.lit("1\t2\t3"), F.concat(F.lit("a\t1\t2\t3\t4\t"), F.col("path")))).alias("value"))
    lines = fpcache.format_tsv(tabbed).unionByName(broken)
    return fpcache.parse_tsv(lines).select("path", "file_size", "exif_millis", "perceptual_hash")


# --- layout -----------------------------------------------------------------------------------------------------


@query(f"""WITH {EVENTS_SQL} SELECT event_id, '/dst/' || CASE WHEN is_duplicate THEN 'duplicates/' ELSE '' END || strftime(make_timestamp(d * 1000), '%Y/%Y_%m/%Y%m%d_%H%M%S')
 || '.' || regexp_extract(name, '\\.([^.]*)$', 1) AS target FROM it""")
def dated_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", layout.target(Settings(destination="/dst")).alias("target"))


def _no_date(name: str, rule: NoDate, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        settings = Settings(destination="/dst", no_date=rule)
        return layout.plan(_events(spark, sf_dir), settings).select("event_id", "dest_path", "action")

    run.__name__ = name
    query(f"WITH {EVENTS_SQL}, {PLANNED_SQL} {sql}")(run)


#: Every event with a date has a dated name, numbered where several want it; `loose` are the others.
PLANNED_SQL = """
base AS (SELECT *, '/dst/' || CASE WHEN is_duplicate THEN 'duplicates/' ELSE '' END AS root, strftime(make_timestamp(d * 1000), '%Y/%Y_%m/%Y%m%d_%H%M%S') AS stem,
  regexp_extract(name, '\\.([^.]*)$', 1) AS ext FROM it),
every AS (SELECT event_id, root || stem AS s, ext, row_number() OVER (PARTITION BY root, stem, ext ORDER BY is_duplicate, path) - 1 AS n FROM base),
dated AS (SELECT event_id, root || stem AS s, ext, row_number() OVER (PARTITION BY root, stem, ext ORDER BY is_duplicate, path) - 1 AS n FROM base WHERE exif_millis IS NOT NULL),
loose AS (SELECT * FROM base WHERE exif_millis IS NULL)"""
_PLACED = "SELECT event_id, CASE WHEN n = 0 THEN s || '.' || ext ELSE s || printf('_%03d.', n) || ext END AS dest_path, CASE WHEN n = 0 THEN 'file' ELSE 'rename' END AS action FROM"
_no_date("noexif_skip", NoDate.SKIP, f"{_PLACED} dated UNION ALL SELECT event_id, NULL, 'skip' FROM loose")
_no_date("noexif_stop", NoDate.STOP, f"{_PLACED} dated UNION ALL SELECT event_id, NULL, 'error' FROM loose")
_no_date("noexif_modified", NoDate.MODIFIED_DATE, f"{_PLACED} every")
_no_date("noexif_fixed", NoDate.FIXED_DIR, f"{_PLACED} dated UNION ALL SELECT event_id, root || 'noExif/' || name, 'file' FROM loose")


ORDERS_SQL = """
o AS (SELECT o_orderkey, 'in/' || lpad('' || o_orderkey, 9, '0') || '.jpg' AS path, '/dst/' || strftime(o_orderdate, '%Y/%Y_%m/%Y%m%d_%H%M%S') || '.jpg' AS bare FROM orders),
names AS (SELECT DISTINCT bare FROM o),
ex AS (SELECT bare AS dest_path FROM names WHERE ('0x' || left(md5(bare), 4))::int % 3 = 0
  UNION SELECT replace(bare, '.jpg', '_002.jpg') FROM names WHERE ('0x' || left(md5(bare), 4))::int % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY path) - 1 AS r FROM o),
held AS (SELECT r.*, bare IN (SELECT dest_path FROM ex) AS t0, replace(bare, '.jpg', '_002.jpg') IN (SELECT dest_path FROM ex) AS t2 FROM r)"""


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as items, and names that stand already: some bare ones, and some _002 ones with a gap before."""
    items = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("in/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".jpg")).alias("path"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last_modified"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("exif_millis"),
        F.lit(False).alias("is_duplicate"),
    )
    names = items.select(layout.target(Settings(destination="/dst")).alias("bare")).distinct()
    draw = F.conv(F.substring(F.md5("bare"), 1, 4), 16, 10).cast("int")
    second = F.regexp_replace("bare", r"\.jpg$", "_002.jpg")
    existing = names.where(draw % 3 == 0).select(F.col("bare").alias("dest_path")).unionByName(names.where(draw % 2 == 0).select(second.alias("dest_path")))
    return items, existing


def _collision(name: str, rule: Collision, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items, existing = _orders(spark, sf_dir)
        return layout.plan(items, Settings(destination="/dst", collision=rule), existing).select("o_orderkey", "dest_path", "action")

    run.__name__ = name
    query(f"WITH {ORDERS_SQL} {sql}")(run)


_collision(
    "collision_increase",
    Collision.INCREASE,
    """, k AS (SELECT *, list_filter(range(0, r + 3), lambda x: NOT (x = 0 AND t0) AND NOT (x = 2 AND t2))[r + 1] AS n FROM held)
SELECT o_orderkey, CASE WHEN n = 0 THEN bare ELSE replace(bare, '.jpg', printf('_%03d.jpg', n)) END AS dest_path, CASE WHEN n = 0 THEN 'file' ELSE 'rename' END AS action FROM k""",
)
_collision("collision_skip", Collision.SKIP, "SELECT o_orderkey, CASE WHEN r = 0 AND NOT t0 THEN bare END AS dest_path, CASE WHEN r = 0 AND NOT t0 THEN 'file' ELSE 'skip' END AS action FROM held")
_collision("collision_stop", Collision.STOP, "SELECT o_orderkey, CASE WHEN r = 0 AND NOT t0 THEN bare END AS dest_path, CASE WHEN r = 0 AND NOT t0 THEN 'file' ELSE 'error' END AS action FROM held")
_collision("collision_overwrite", Collision.OVERWRITE, "SELECT o_orderkey, bare AS dest_path, CASE WHEN r = 0 AND NOT t0 THEN 'file' ELSE 'overwrite' END AS action FROM held")


@query("""WITH it AS (SELECT o_orderkey, 'img' || (o_orderkey // 8) AS stem, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) - 1 AS k FROM orders),
named AS (SELECT *, stem || CASE WHEN k = 2 THEN '_001' ELSE '' END AS wanted FROM it),
r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY o_orderkey) - 1 AS r, max(k) OVER (PARTITION BY stem) >= 2 AS numbered FROM named),
n AS (SELECT *, CASE WHEN k = 2 THEN 0 ELSE list_filter(range(0, r + 4), lambda x: x <> 2 AND NOT (x = 1 AND numbered))[r + 1] END AS n FROM r)
SELECT o_orderkey, '/dst/noExif/' || wanted || CASE WHEN n = 0 THEN '' ELSE printf('_%03d', n) END || '.jpg' AS dest_path, CASE WHEN n = 0 THEN 'file' ELSE 'rename' END AS action FROM n""")
def collision_with_numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several items want one name, one of them wants the first numbered name as its own, and the second one stands."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("img"), F.floor(F.col("o_orderkey") / 8).cast("string")).alias("stem"))
    k = F.row_number().over(Window.partitionBy("stem").orderBy("o_orderkey")) - 1
    name = F.concat("stem", F.when(k == 2, "_001").otherwise(""), F.lit(".jpg"))
    items = orders.select(
        "o_orderkey", "stem", F.concat_ws("/", F.lit("in"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), name).alias("path"),
        F.lit(0).cast("long").alias("last_modified"), F.lit(None).cast("long").alias("exif_millis"), F.lit(False).alias("is_duplicate"),
    )
    existing = orders.select(F.concat(F.lit("/dst/noExif/"), F.col("stem"), F.lit("_002.jpg")).alias("dest_path")).distinct()
    return layout.plan(items, Settings(destination="/dst", no_date=NoDate.FIXED_DIR), existing).select("o_orderkey", "dest_path", "action")


@query()
def content_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content signature of every text's bytes, as for files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 64):
                part = batch.iloc[s : s + 64]
                samples = [content.sampled(b[: content.SAMPLE], b[-content.SAMPLE :], len(b)) for b in map(bytes, part["data"])]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "signature": content.signatures(samples)})

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    return read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", data).mapInPandas(run, "doc_id long, signature long")


@query()
def picture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perceptual hash of every vector, its components as a grey picture of eight columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [content.perceptual_hash(np.asarray(v, float)[: len(v) // 8 * 8].reshape(-1, 8)) for v in batch["embedding"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "perceptual_hash": hashes})

    vectors = read(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)")
    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, perceptual_hash long")


@query(f"WITH {ORDERS_SQL} SELECT o_orderkey, t0 AS taken FROM held")
def existing_target_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, existing = _orders(spark, sf_dir)
    taken = layout.taken_numbers(existing).where("n = 0").select("bare", F.lit(True).alias("taken"))
    wanted = items.withColumn("bare", layout.target(Settings(destination="/dst")))
    return wanted.join(taken, "bare", "left").select("o_orderkey", F.coalesce("taken", F.lit(False)).alias("taken"))


@query(f"""WITH {ORDERS_SQL} SELECT count(*) FILTER (r = 0 AND NOT t0) AS "file", 0::bigint AS "rename", 0::bigint AS "overwrite", count(*) FILTER (NOT (r = 0 AND NOT t0)) AS "skip", 0::bigint AS "error" FROM held""")
def filing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, existing = _orders(spark, sf_dir)
    return layout.filed(layout.plan(items, Settings(destination="/dst", collision=Collision.SKIP), existing))
