"""Listing of folder trees in rounds of Spark tasks.

Each round lists the folders that the round before has found, each folder in one task, and writes what is in them; the
driver only asks whether there are more. A folder that links lead to again is listed once, so cycles end.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.sources.shared import materialise

ENTRIES = "path string, resolved string, is_folder boolean, length long, modified long"
MOST_ROUNDS = 1000  # levels of folders
ROWS = 10_000  # entries of a folder that leave a task at once


def _system(place: str):
    """The file system of a path or URI, the place in it, and what a path of it begins with outside."""
    from pyarrow import fs

    if ":/" not in place:
        return fs.LocalFileSystem(), place, ""
    system, inner = fs.FileSystem.from_uri(place)
    if isinstance(system, fs.LocalFileSystem):
        return system, inner, ""
    ending = inner.rstrip("/")
    return system, inner, place[: place.rfind(ending)] if ending else place.rstrip("/")


def is_known(place: str) -> bool:
    """Whether tasks can list this place themselves; patterns are for Spark's reader."""
    import pyarrow as pa

    if set(place) & set("*?[{"):
        return False
    try:
        _system(place)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def entry(place: str, info, prefix: str) -> tuple:
    """One row of ENTRIES; links are followed where the file system is a local one."""
    from pyarrow import fs

    resolved = os.path.realpath(info.path) if prefix == "" else prefix + info.path
    size = info.size if info.is_file else None
    modified = None if info.mtime_ns is None else info.mtime_ns // 1000
    return prefix + info.path, resolved, info.type == fs.FileType.Directory, size, modified


def _local_entries(inner: str) -> Iterator[tuple]:
    """Rows of ENTRIES of a local folder as it is read; only links are resolved one by one."""
    resolved = os.path.realpath(inner)
    with os.scandir(inner) as found:
        for e in found:
            place, real = os.path.join(inner, e.name), os.path.join(resolved, e.name)
            try:
                if e.is_symlink():
                    real = os.path.realpath(place)
                state = e.stat()
            except OSError:  # a link to nowhere, or gone meanwhile
                continue
            is_file = stat.S_ISREG(state.st_mode)
            yield place, real, stat.S_ISDIR(state.st_mode), state.st_size if is_file else None, state.st_mtime_ns // 1000


def list_folder(place: str) -> Iterator[tuple]:
    """What is in one folder; nothing if it cannot be read."""
    from pyarrow import fs

    try:
        system, inner, prefix = _system(place)
        if prefix == "" and isinstance(system, fs.LocalFileSystem):
            yield from _local_entries(inner)
            return
        infos = system.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
    except OSError:
        return
    yield from (entry(place, i, prefix) for i in infos if i.type != fs.FileType.NotFound)


def root_entry(place: str) -> list[tuple]:
    """A starting point itself, if it is there."""
    from pyarrow import fs

    system, inner, prefix = _system(place)
    info = system.get_file_info(inner.rstrip("/") or "/")
    return [] if info.type == fs.FileType.NotFound else [entry(place, info, prefix)]


def walk(spark: SparkSession, roots, recursive: bool = True, tasks: int | None = None) -> DataFrame:
    """Every file in and below `roots` (paths or URIs of files or folders): path, resolved, length, modificationTime.

    `resolved` is the path without links. A file that several paths lead to has a row for each of them, a folder is
    listed by one of the paths that lead to it only. Files without a byte are listed as well. Roots that are not there raise.
    """
    starts = [roots] if isinstance(roots, str) else list(roots)
    first = []
    for place in starts:
        found = root_entry(place)
        if not found:
            raise FileNotFoundError(place)
        first += found
    tasks = tasks or spark.sparkContext.defaultParallelism
    level = spark.createDataFrame(first, ENTRIES)
    known: DataFrame | None = None
    parts = [level.filter("not is_folder")]

    def listed(batches):
        for batch in batches:
            for place in batch["path"]:
                rows = list_folder(place)
                while some := list(islice(rows, ROWS)):
                    yield pd.DataFrame(some, columns=["path", "resolved", "is_folder", "length", "modified"]).astype(
                        {"length": "Int64", "modified": "Int64"}
                    )

    for depth in range(MOST_ROUNDS):
        folders = level.filter("is_folder").groupBy("resolved").agg(F.min("path").alias("path"))
        if known is not None:
            folders = folders.join(known, "resolved", "left_anti")
        folders = materialise(folders.repartition(tasks, "path"), "folders")
        if folders.isEmpty():
            break
        known = folders.select("resolved") if known is None else known.union(folders.select("resolved"))
        level = materialise(folders.select("path").mapInPandas(listed, ENTRIES), f"level-{depth}")
        parts.append(level.filter("not is_folder"))
        if not recursive:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("path", "resolved", "length", F.timestamp_millis(F.floor(F.col("modified") / 1000)).alias("modificationTime"))
