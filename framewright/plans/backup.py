"""The backup comparison: two trees and their metadata -> a transfer plan."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.names import MEDIA_EXTENSIONS, folder, stem, suffix
from framewright.operators import reconcile
from framewright.sources import files, snapshots, tags
from framewright.sources.shared import materialise
from framewright.sources.snapshots import Store


def tree(spark: SparkSession, root: str, extensions=MEDIA_EXTENSIONS, use_hash: bool = False) -> DataFrame:
    """Inventory of one tree, with hashes only if wanted (only then the files are opened)."""
    catalog = files.scan_media(spark, root, extensions=extensions)
    if not use_hash:
        return reconcile.file_index(catalog)
    return reconcile.file_index(catalog.join(files.file_hashes(catalog), "path", "left"), sha256="sha256")


def tree_store(location: str, key: str, name: str) -> Store:
    """The snapshots of one tree (`name`) of one scan (`key`)."""
    return Store(f"{location}/trees/{key}/{name}", "path string, name_lower string, size bigint, mtime timestamp, sha256 string")


def metadata_store(location: str, key: str) -> Store:
    """The metadata read so far for one scan."""
    meta = ", ".join(f"{c} string" for c in reconcile.META)
    return Store(f"{location}/metadata/{key}", f"path string, size bigint, mtime timestamp, {meta}")


def refreshed_tree(spark: SparkSession, root: str, location: str, key: str, name: str, extensions=MEDIA_EXTENSIONS) -> DataFrame:
    """Inventory with hashes in which only files that are new or changed since the last run are opened.

    What is new, changed or deleted is applied to the snapshots at `location` as one change set; what comes back is
    pinned to the snapshot that this made.
    """
    store = tree_store(location, key, name)
    stored = snapshots.read(spark, store)
    scan = reconcile.file_index(files.scan_media(spark, root, extensions=extensions))
    fresh = materialise(reconcile.incremental_hash(scan, stored, files.file_hashes).drop("hash_reused"), "snapshot")
    changes = reconcile.sync_index(fresh, stored).filter("change <> 'same'")
    made = snapshots.apply_changes(spark, store, changes, deleted=F.col("change") == "deleted")
    return snapshots.read(spark, store, made)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Folder, stem, suffix and size of everything below a destination."""
    found = files.list_files(spark, root)
    return found.select(folder("path").alias("folder"), stem("path").alias("stem"), suffix("path").alias("suffix"), F.col("length").alias("size"))


def compare(imported: DataFrame, backup: DataFrame, backup_root: str, records: DataFrame, existing: DataFrame, plan: reconcile.TransferPlan, use_hash: bool = False) -> DataFrame:
    """What the backup has and the import tree has not, with its destination."""
    own = reconcile.exclude_subtree(imported, backup_root)
    missing = reconcile.missing_files(backup, own, use_hash)
    return reconcile.plan_transfer(missing, records, existing, plan)


def records(missing: DataFrame) -> DataFrame:
    """Tag records of the given files; only they are opened."""
    return tags.metadata_records(files.probe_files(missing, ()))


def cached_metadata(spark: SparkSession, missing: DataFrame, location: str, key: str) -> DataFrame:
    """The metadata of the given files: from the cache where path, size and time are those of the last run, else from the file.

    What is read is added to the cache, but for files that could not be opened: they are tried again by the next run.
    """
    store = metadata_store(location, key)
    cache = snapshots.read(spark, store).withColumn("scan_key", F.lit(key))
    looked_up = materialise(reconcile.metadata_cache_lookup(missing.select("path", "size", "mtime"), cache, key), "looked-up")
    misses = looked_up.filter("not cache_hit").select("path", "size", "mtime")
    probed = materialise(files.probe_files(misses, ()), "probed")
    opened = probed.select("path", F.col("tags").isNotNull().alias("__opened"))
    read = reconcile.file_metadata(misses, tags.metadata_records(probed))
    read = materialise(read.join(opened, "path"), "metadata")  # both the answer and the change set
    snapshots.apply_changes(spark, store, read.filter("__opened").drop("__opened"))
    return looked_up.filter("cache_hit").drop("cache_hit").unionByName(read.drop("__opened"))


def incremental_plan(
    spark: SparkSession, import_root: str, backup_root: str, location: str, plan: reconcile.TransferPlan, extensions=MEDIA_EXTENSIONS
) -> DataFrame:
    """Two folders -> what the backup has and the import tree has not, with destinations, through the index at `location`.

    Hashes and metadata of unchanged files come from the last run; only other files are opened. Both trees and the
    metadata move on by one snapshot each, or stay where nothing changed.
    """
    key = hashlib.sha1(f"{import_root.lower()}|{backup_root.lower()}".encode()).hexdigest()  # as index.scan_key
    ours = refreshed_tree(spark, import_root, location, key, "import", extensions)
    theirs = refreshed_tree(spark, backup_root, location, key, "backup", extensions)
    own = reconcile.exclude_subtree(ours, backup_root)
    missing = reconcile.missing_files(theirs, own, use_hash=True)
    described = cached_metadata(spark, missing, location, key)
    return reconcile.plan_described(described, listing(spark, plan.output_root), plan)
