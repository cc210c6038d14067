"""Keyed tables that change by whole snapshots.

A snapshot is a numbered manifest that names, for each bucket of the keys, the one folder of parquet that holds it. A
change set rewrites the buckets that it touches into new folders and then adds the next manifest in one atomic step, so
a write that ends half-way leaves the last snapshot as it was, and a reader keeps the snapshot that it began with. Rows
known to be new may be added in folders beside the buckets. No key is in two folders, and files are never changed in place. Manifests go through the Hadoop file system of the location, so any store works whose rename
fails if the target exists.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.sources.shared import materialise

ATTEMPTS = 8  # of a write that others overtake
FOLD = 16  # folders of added rows that become one


class Overtaken(RuntimeError):
    """Other writers changed the same buckets again and again."""


@dataclass(frozen=True)
class Store:
    """Where a table is, its columns, and the key that a row is replaced by. `buckets` must not change later."""

    location: str
    schema: str
    key: tuple[str, ...] = ("path",)
    buckets: int = 64

    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def known(self, df: DataFrame) -> DataFrame:
        """Rows that have a whole key."""
        for c in self.key:
            df = df.filter(F.col(c).isNotNull())
        return df


@dataclass(frozen=True)
class Manifest:
    """One snapshot: folder of each bucket (others are empty), the last batch that each stream has written, and the folders
    of added rows with the number of times that their rows were folded."""

    version: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    added: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "folders": self.folders, "batches": self.batches, "added": self.added})

    def has(self, batch: tuple[str, int] | None) -> bool:
        """Whether a snapshot up to this one is of that batch of that stream."""
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]

    def next(self, folders: dict[int, str], added: dict[str, int], batch: tuple[str, int] | None) -> Manifest:
        return Manifest(self.version + 1, folders, self.batches | ({batch[0]: batch[1]} if batch else {}), added)

    @staticmethod
    def of(text: str) -> Manifest:
        made = json.loads(text)
        return Manifest(made["version"], {int(k): v for k, v in made["folders"].items()}, made["batches"], made.get("added", {}))


class _Files:
    """The few file operations that are needed, on the file system of a location."""

    def __init__(self, spark: SparkSession, location: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(location).getFileSystem(self.conf)

    def path(self, place: str):
        return self.jvm.org.apache.hadoop.fs.Path(place)

    def exists(self, place: str) -> bool:
        return self.fs.exists(self.path(place))

    def names(self, place: str) -> list[str]:
        if not self.exists(place):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(place))]

    def read(self, place: str) -> str:
        stream = self.fs.open(self.path(place))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, place: str) -> bool:
        """Give `place` this content in one step; False if it exists already."""
        draft = self.path(f"{place.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails if the target is there
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(place)), options)
            return True
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def delete(self, place: str) -> None:
        self.fs.delete(self.path(place), True)


def _place(store: Store, version: int) -> str:
    return f"{store.location}/manifests/{version:012d}.json"


def versions(spark: SparkSession, store: Store) -> list[int]:
    """Numbers of the snapshots that are there."""
    names = _Files(spark, store.location).names(f"{store.location}/manifests")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, store: Store, version: int | None = None, known: Manifest | None = None) -> Manifest:
    """A snapshot, the last one if none is named. Before the first write it is empty, with number 0.

    As long as `known`, a snapshot seen before, is the last one, nothing is listed or read for it.
    """
    if version is None and known is not None and known.version:
        files = _Files(spark, store.location)
        # In this order: where the next one is gone again, so is this one, as the oldest go first.
        if not files.exists(_place(store, known.version + 1)) and files.exists(_place(store, known.version)):
            return known
    if version is None:
        there = versions(spark, store)
        version = there[-1] if there else 0
    return Manifest.of(_Files(spark, store.location).read(_place(store, version))) if version else Manifest()


def _rows(spark: SparkSession, store: Store, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).parquet(*[f"{store.location}/{f}" for f in folders])


def read(spark: SparkSession, store: Store, at: Manifest | None = None) -> DataFrame:
    """The rows of a snapshot. What is read stays the same, whatever is written meanwhile."""
    at = manifest(spark, store) if at is None else at
    return _rows(spark, store, [*(at.folders[b] for b in sorted(at.folders)), *at.added])


def _largest(store: Store, changes: DataFrame, stays: Column) -> DataFrame:
    """One row of each key of a change set, none of keys with a null, and whether it stays."""
    rest = [c for c in store.columns() if c not in store.key]
    body = F.max(F.struct(stays.alias("__stays"), *[F.col(c) for c in rest])).alias("__row")
    return store.known(changes).groupBy(*store.key).agg(body).select(*store.key, "__row.*")


def add_rows(spark: SparkSession, store: Store, rows: DataFrame, at: Manifest, batch: tuple[str, int]) -> Manifest:
    """Write a batch of a stream as the snapshot after `at`, in which the caller has found none of its keys.

    It is written beside the buckets, of which none is read or written; `FOLD` such folders become one, and `FOLD` of
    those again, so a row is written a few times in all, however many batches there are. If another writer was first,
    the rows are a change set like any other (see `apply_changes`).
    """
    if at.has(batch):
        return at
    folder = f"data/{uuid.uuid4().hex}"
    _largest(store, rows, F.lit(True)).select(*store.columns()).write.parquet(f"{store.location}/{folder}")
    made = at.next(at.folders, _folded(spark, store, at.added | {folder: 0}), batch)
    if _Files(spark, store.location).publish(made.text(), _place(store, made.version)):
        return made
    return apply_changes(spark, store, _rows(spark, store, [folder]), batch=batch)


def _folded(spark: SparkSession, store: Store, added: dict[str, int], times: int = 0) -> dict[str, int]:
    """Folders of added rows, where `FOLD` of them whose rows were folded as often are one."""
    alike = [f for f, n in added.items() if n == times]
    if len(alike) < FOLD:
        return added
    folder = f"data/{uuid.uuid4().hex}"
    _rows(spark, store, alike).hint("rebalance").write.parquet(f"{store.location}/{folder}")
    return _folded(spark, store, {f: n for f, n in added.items() if n != times} | {folder: times + 1}, times + 1)


def apply_changes(
    spark: SparkSession, store: Store, changes: DataFrame, deleted: Column | None = None, batch: tuple[str, int] | None = None
) -> Manifest:
    """Write a change set as the next snapshot: rows replace those of their key or are added, those that `deleted` marks go.

    Of several rows of one key the largest counts, rows with a null in the key none. Only buckets that a change falls
    into are read and written, or all of them where rows were added beside them, which are then dealt out. `batch` names a stream and the number of its batch: a batch that a snapshot has already is
    not written again. Writers that touch other buckets do not disturb each other; else the change set is merged anew
    with what the other has written. A change set without rows makes a snapshot only if it belongs to a batch.
    """
    columns = store.columns()
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    one = materialise(_largest(store, changes, ~gone).withColumn("__bucket", store.bucket()), "changes")
    touched = [r[0] for r in one.select("__bucket").distinct().collect()]  # at most `buckets` numbers
    base, written = manifest(spark, store), None
    files = _Files(spark, store.location)
    for _ in range(ATTEMPTS):
        if base.has(batch) or (not touched and not batch):
            return base
        due = touched if not (touched and base.added) else list(range(store.buckets))
        if touched and written is None:
            written = _merge(spark, store, base, one, due, columns, files)
        folders = {b: f for b, f in base.folders.items() if b not in due} | (written or {})
        made = base.next(folders, {} if touched else base.added, batch)
        if files.publish(made.text(), _place(store, made.version)):
            return made
        now = manifest(spark, store)
        if now.added != base.added or any(now.folders.get(b) != base.folders.get(b) for b in due):
            written = None
        base = now
    raise Overtaken(store.location)


def _merge(spark, store: Store, base: Manifest, one: DataFrame, due: list[int], columns: list[str], files: _Files) -> dict[int, str]:
    """The buckets that are due with the changes and the added rows in new folders; buckets without rows have none."""
    folder = f"data/{uuid.uuid4().hex}"
    old = _rows(spark, store, [*(base.folders[b] for b in due if b in base.folders), *base.added])
    kept = old.join(one.select(*store.key), list(store.key), "left_anti").withColumn("__bucket", store.bucket())
    new = one.filter("__stays").select(*columns, "__bucket")
    whole = kept.select(*columns, "__bucket").unionByName(new).repartition(len(due), "__bucket")
    whole.write.partitionBy("__bucket").parquet(f"{store.location}/{folder}")
    names = files.names(f"{store.location}/{folder}")
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}


def expire(spark: SparkSession, store: Store, keep: int = 2) -> None:
    """Remove all but the last `keep` snapshots, and the folders that none of those names.

    Folders of writes that ended half-way go too. To be called when nothing is being written or read from older snapshots.
    """
    files = _Files(spark, store.location)
    there = versions(spark, store)
    kept = there[-max(keep, 1) :]
    named = {f for v in kept for m in [manifest(spark, store, v)] for f in (*m.folders.values(), *m.added)}
    for v in there[: -max(keep, 1)]:
        files.delete(_place(store, v))
    for commit in files.names(f"{store.location}/data"):
        if f"data/{commit}" in named:
            continue
        buckets = [f"data/{commit}/{n}" for n in files.names(f"{store.location}/data/{commit}")]
        if not named & set(buckets):
            files.delete(f"{store.location}/data/{commit}")
        else:
            for b in buckets:
                if "__bucket=" in b and b not in named:
                    files.delete(f"{store.location}/{b}")
