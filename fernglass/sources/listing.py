"""Listing of a source tree: every supported file with size and modification time, no content read.

The driver lists the root only; each folder below is walked by a task, so a tree of any size is listed in parallel
and no list of all files is ever held in one place. Links are not followed, neither to folders nor to files; a
folder or file that cannot be read is left out with a warning; a missing root is an error."""

from __future__ import annotations

import logging
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import KINDS, OLDEST_MTIME, SCANNED

log = logging.getLogger(__name__)
#: Files in a batch of rows.
BATCH = 4096


def supported(name: str) -> bool:
    stem, dot, ending = name.rpartition(".")
    return bool(stem and dot) and ending.lower() in KINDS


def attributes(path: str) -> tuple[str, int, int] | None:
    """(path, size, mtime in ms) of a plain file; an unbelievable mtime gives way to the creation time."""
    try:
        found = os.lstat(path)
    except OSError as e:
        log.warning("cannot read %s: %s", path, e)
        return None
    if not stat.S_ISREG(found.st_mode):
        return None
    millis = found.st_mtime_ns // 1_000_000
    if millis < OLDEST_MTIME:
        born = getattr(found, "st_birthtime", None)
        millis = int(born * 1000) if born is not None else found.st_ctime_ns // 1_000_000
    return path, found.st_size, millis


def walk(folder: str, deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """The supported files below `folder`, or right in it."""
    for at, folders, names in os.walk(folder, onerror=lambda e: log.warning("cannot list %s: %s", e.filename, e), followlinks=False):
        folders.sort()
        for name in sorted(names):
            if supported(name) and (row := attributes(os.path.join(at, name))):
                yield row
        if not deep:
            return


def _batched(rows: Iterator[tuple[str, int, int]]) -> Iterator[pd.DataFrame]:
    held: list[tuple[str, int, int]] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pd.DataFrame(held, columns=["path", "file_size", "last_modified"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["path", "file_size", "last_modified"])


def scan(spark: SparkSession, root: str, split_depth: int = 2) -> DataFrame:
    """(path, file_size, last_modified) of the supported files under `root`.

    Folders down to `split_depth` levels become units of work; the deepest are walked whole."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder {root}")
    units, level = [], [os.path.abspath(root)]
    for depth in range(split_depth + 1):
        units += [(folder, depth == split_depth) for folder in level]
        if depth < split_depth:
            level = [e.path for folder in level for e in _folders(folder)]
    count = min(len(units), 4 * spark.sparkContext.defaultParallelism)
    work = spark.createDataFrame(units, "folder string, deep boolean").repartition(count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, deep in batch.itertuples(index=False):
                yield from _batched(walk(folder, deep))

    return work.mapInPandas(run, SCANNED)


def _folders(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as entries:
            return sorted((e for e in entries if e.is_dir(follow_symlinks=False)), key=lambda e: e.name)
    except OSError as e:
        log.warning("cannot list %s: %s", folder, e)
        return []
