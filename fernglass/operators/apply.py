"""Carrying a plan out: files are moved or copied by tasks, each reports what became of it."""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Settings

RESULT = "path string, dest_path string, action string, done boolean, error string"


def _put(partial: str, dest: str, replace: bool) -> None:
    """Give a finished file its name; without `replace` a file that stands there stays and FileExistsError is raised."""
    if replace:
        os.replace(partial, dest)
        return
    try:
        os.link(partial, dest)
    except FileExistsError:
        raise
    except OSError:  # no hard links here: reserve the name, then fill it
        os.close(os.open(dest, os.O_CREAT | os.O_EXCL))
        os.replace(partial, dest)
        return
    os.unlink(partial)


def _copy(path: str, dest: str, replace: bool) -> None:
    partial = f"{dest}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(path, partial)
        _put(partial, dest, replace)
    finally:
        if os.path.lexists(partial):
            os.unlink(partial)


def file_one(path: str, dest: str, move: bool, replace: bool, size: int | None = None, modified: int | None = None) -> str | None:
    """Move or copy one file; returns what went wrong. Names are settled by the plan, so tasks never race. A task that
    runs again finds its own earlier work and takes it as done: a copy by equal content, byte by byte; a move, whose
    source is gone, by the recorded size and modification time of the item. Anything else in its place is an error."""
    try:
        if os.path.lexists(dest):
            if not os.path.lexists(path):
                stands = os.stat(dest)
                own = size is not None and stands.st_size == size and (modified is None or abs(stands.st_mtime_ns // 1_000_000 - modified) <= 2)
                return None if move and own else f"{path} is gone"
            if os.path.samefile(path, dest):
                return None
            if not replace:
                if not filecmp.cmp(path, dest, shallow=False):
                    return f"{dest} exists"
                if move:
                    os.unlink(path)
                return None
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        if not move:
            _copy(path, dest, replace)
        elif os.stat(path).st_dev == os.stat(os.path.dirname(dest)).st_dev:
            _put(path, dest, replace)
        else:
            _copy(path, dest, replace)
            os.unlink(path)
        return None
    except OSError as e:
        return str(e)


def apply(planned: DataFrame, settings: Settings, allow_overwrite: bool = False) -> DataFrame:
    """(path, dest_path, action, done, error). In a dry run nothing is touched and every placed item counts as done.

    Rows of one target run one after the other in one task, in the plan's order, so the last of them stays. Rows
    without a target are not filed; null sizes and dates only mean that a repeated move is not recognised."""
    rows = planned.select("path", "dest_path", "action")
    if settings.dry_run:
        return rows.select("*", F.col("dest_path").isNotNull().alias("done"), F.lit(None).cast("string").alias("error"))
    given = lambda name, kind: (F.col(name) if name in planned.columns else F.lit(None)).cast(kind).alias(f"_{name}")
    rows = planned.select("path", "dest_path", "action", given("file_size", "long"), given("last_modified", "long"), given("is_duplicate", "boolean"))
    spot = F.coalesce("dest_path", "path")
    rows = rows.repartition(spot).sortWithinPartitions(spot, F.col("action") == "overwrite", "_is_duplicate", "path").drop("_is_duplicate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for path, dest, action, size, modified in batch.itertuples(index=False):
                size, modified = (None if pd.isna(x) else int(x) for x in (size, modified))
                if dest is None:
                    errors.append("not placed")
                elif action == "overwrite" and not allow_overwrite:
                    errors.append("overwriting has to be allowed")
                else:
                    errors.append(file_one(path, dest, settings.move_files, action == "overwrite", size, modified))
            yield batch[["path", "dest_path", "action"]].assign(done=[e is None for e in errors], error=errors)

    return rows.mapInPandas(run, RESULT)


def destination_listing(spark, root: str) -> DataFrame:
    """(dest_path): every file that stands under the destination."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                for at, _, names in os.walk(folder):
                    if names:
                        yield pd.DataFrame({"dest_path": [os.path.join(at, n) for n in names]})

    folders = [e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=False)] if os.path.isdir(root) else []
    if not folders:
        return spark.createDataFrame([], "dest_path string")
    return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(len(folders)).mapInPandas(run, "dest_path string")
