"""Continuous pick-up of new files as a stream into a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.functions.names import MEDIA_EXTENSIONS, base_name, has_extension
from framewright.sources import snapshots
from framewright.sources.files import normal_path, read_files, spread, with_sha256
from framewright.sources.shared import materialise
from framewright.sources.snapshots import Manifest, Store

BINARY = "path string, modificationTime timestamp, length long, content binary"
LISTED = ("path", "name_lower", "size", "mtime")


def ingested(location: str, buckets: int = 64) -> Store:
    """The table of picked-up files at `location`."""
    return Store(location, "path string, name_lower string, size bigint, mtime timestamp, sha256 string", ("path",), buckets)


def _listed(files: DataFrame, extensions) -> DataFrame:
    return files.select(normal_path("path").alias("path"), "modificationTime", "length").filter(has_extension("path", extensions)).select(
        "path", F.lower(base_name("path")).alias("name_lower"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
    )


def _unknown(spark: SparkSession, listing: DataFrame, store: Store) -> DataFrame:
    """Listed files that the table does not have with that size and time."""
    return listing.join(snapshots.read(spark, store), ["path", "size", "mtime"], "left_anti").select(*LISTED)


def _there(spark: SparkSession, listing: DataFrame, store: Store, at: Manifest) -> DataFrame:
    """What a snapshot has of the listed paths. The listing of a batch goes to where the table is, which is not shuffled."""
    return snapshots.read(spark, store, at).select("path", "size", "mtime").join(F.broadcast(listing.select("path")), "path", "left_semi")


def _hashed(new: DataFrame) -> DataFrame:
    return with_sha256(new).select(*LISTED, "sha256")


def pick_up(
    spark: SparkSession,
    folder: str,
    store: Store,
    checkpoint: str,
    extensions=MEDIA_EXTENSIONS,
    glob: str | None = None,
    files_per_batch: int = 10_000,
    max_age: str = "3650d",
    interval: str | None = None,
) -> StreamingQuery:
    """Start a stream that hashes the files which arrive in `folder` and adds them to `store`.

    Without an `interval` it takes what is there, in batches of `files_per_batch`, and ends; with one it goes on. Each
    batch becomes one snapshot that carries the stream's id and the batch's number, so a batch that is repeated after a
    failure writes nothing twice, and one that ended half-way has left nothing. A new checkpoint goes over all files again,
    but opens only those that the table does not have. A batch writes its own rows and, unless it has a path of the table with
    another size or time, none of the table's.

    The stream itself remembers paths, on the driver (some hundred bytes each), for `max_age` before the newest file: a file that
    was rewritten, or is older than that, is for `catch_up`. Files without a byte are not listed by either.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", max_age)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    last = None  # snapshot that this stream has seen

    def write(rows: DataFrame, number: int) -> None:
        nonlocal last
        session = rows.sparkSession
        batch = (session.sparkContext.getLocalProperty("sql.streaming.queryId"), number)
        last = at = snapshots.manifest(session, store, known=last)
        if at.has(batch):
            return
        rows.persist()  # a narrow listing, read twice
        try:
            there = _there(session, rows, store, at)
            if there.count():
                new = rows.join(there, ["path", "size", "mtime"], "left_anti")
                last = snapshots.apply_changes(session, store, _hashed(spread(new)), batch=batch)
            else:
                last = snapshots.add_rows(session, store, _hashed(rows), at, batch)
        finally:
            rows.unpersist()

    writer = _listed(reader.load(folder), extensions).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()


def catch_up(spark: SparkSession, folder: str, store: Store, extensions=MEDIA_EXTENSIONS, glob: str | None = None) -> None:
    """Bring the table to what is in `folder` now: files that a stream does not see, rewritten ones too, and none that are gone.

    Only files that are not in the table with their size and time are opened.
    """
    found = materialise(_listed(read_files(spark, folder, glob=glob), extensions), "listed")
    new = _hashed(spread(_unknown(spark, found, store))).withColumn("__gone", F.lit(False))
    at = snapshots.manifest(spark, store)
    gone = snapshots.read(spark, store, at).join(found.select("path"), "path", "left_anti").withColumn("__gone", F.lit(True))
    snapshots.apply_changes(spark, store, new.unionByName(gone), deleted=F.col("__gone"))
