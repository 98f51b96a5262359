"""Analysis of files in one Arrow-batched pass: a file is read once and gives date, signature and hash.

A failure while reading the date leaves all three empty, as does any other failure; films and files above the
decode limit are read at their ends only and have no hash, and no signature unless `sign_all` is set."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import extension, file_name, is_decodable, known
from ..functions.content import SAMPLE, capture_millis, decode_png, perceptual_hash, sampled, signatures
from ..model import DECODE_LIMIT, FILMS, ITEM

log = logging.getLogger(__name__)
#: Bytes at a film's ends in which its header is looked for.
FILM_ENDS = 4 << 20
#: Files analysed together; bounds the memory of their samples.
TOGETHER = 64
#: Most pictures that are read by their paths, which the driver holds.
LISTED = 10_000


def _read_ends(path: str, size: int, ends: int) -> tuple[bytes, bytes]:
    with open(path, "rb") as file:
        head = file.read(ends)
        file.seek(max(0, size - ends))
        return head, file.read(ends)


def analyse(path: str, size: int, sign_all: bool = False, decode: bool = True) -> tuple[int | None, int, bytes | None]:
    """(capture date, perceptual hash, bytes to sign) of one file."""
    try:
        if path.rsplit(".", 1)[-1].lower() in FILMS or size > DECODE_LIMIT:
            head, tail = _read_ends(path, size, FILM_ENDS)
            date = capture_millis(head)
            date = capture_millis(head[:12] + tail) if date is None and b"mvhd" in tail else date
            return date, 0, sampled(head, tail, size) if sign_all else None
        with open(path, "rb") as file:
            content = file.read()
        date = capture_millis(content)
        return date, perceptual_hash(decode_png(content)) if decode else 0, sampled(content[:SAMPLE], content[-SAMPLE:], len(content))
    except Exception as e:  # one unreadable file is no reason to stop
        log.warning("cannot analyse %s: %s", path, e)
        return None, 0, None


def extract(scanned: DataFrame, sign_all: bool = False, decode: bool = True) -> DataFrame:
    """`scanned` as items. Only plain PNGs are decoded here (if `decode`); `add_picture_hashes` decodes in the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), TOGETHER):
                part = batch.iloc[s : s + TOGETHER][["path", "file_size", "last_modified"]]
                found = [analyse(p, n, sign_all, decode) for p, n in zip(part["path"], part["file_size"], strict=True)]
                signed = [k for k, (_, _, sample) in enumerate(found) if sample is not None]
                values = pd.array([None] * len(found), "Int64")
                if signed:
                    values[signed] = signatures([found[k][2] for k in signed])
                yield part.assign(
                    exif_millis=pd.array([date for date, _, _ in found], "Int64"),
                    perceptual_hash=pd.array([h or None for _, h, _ in found], "Int64"),
                    content_signature=values,
                )

    return scanned.mapInPandas(run, ITEM)


def _pictures(spark: SparkSession, places: str | list[str]) -> DataFrame:
    """(path, _hash) of the JPEG and PNG files at `places`, decoded in the JVM."""
    kinds = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", kinds).option("dropInvalid", "true").load(places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = []
            for r in batch.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                hashes.append(perceptual_hash(pixels[:, :, 2::-1] if r.nChannels >= 3 else pixels))
            yield pd.DataFrame({"path": batch["path"], "_hash": hashes})

    # The source writes percent signs for what a URI cannot hold, but leaves plus signs, which url_decode would read as spaces.
    plain = F.regexp_replace(F.regexp_replace("image.origin", "^file:/+", "/"), r"\+", "%2B")
    return found.select(F.url_decode(plain).alias("path"), "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "path string, _hash long")


def add_picture_hashes(items: DataFrame, root: str) -> DataFrame:
    """Fill the missing hashes of pictures under the decode limit; one row an item, whatever its name holds.

    Up to LISTED pictures are read by their paths; for more of them the whole tree is read once and joined. Nothing is
    read if no picture lacks its hash."""
    spark = items.sparkSession
    name = file_name(F.col("path"))
    lacking = items.where(F.col("perceptual_hash").isNull() & extension(name).isin("jpg", "jpeg", "png") & is_decodable(name, F.col("file_size"))).select("path")
    listed = [r.path for r in lacking.limit(LISTED + 1).collect()]
    if not listed:
        return items
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for path in listed]
    hashes = _pictures(spark, root if len(listed) > LISTED else literal).join(lacking.distinct(), "path", "left_semi").dropDuplicates(["path"])
    joined = items.join(hashes, "path", "left")
    return joined.withColumn("perceptual_hash", F.coalesce("perceptual_hash", known(F.col("_hash")))).select(items.columns)
