"""Tables that change by whole snapshots (S9, R6), continuous pick-up (S13) and cached metadata (R7, R8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import reconcile as rc
from framewright.plans import backup
from framewright.queries.base import query, table
from framewright.queries.containers import KINDS_SQL, landed_containers
from framewright.queries.files import TREE_SQL, tree
from framewright.queries.inputs import FOLDER_BYTES_SQL, folder_bytes
from framewright.sources import snapshots
from framewright.sources.shared import shared_folder
from framewright.streaming import continuous

def ident():
    """The document that a path of the tree stands for."""
    return F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("bigint")


@query(
    "s9_snapshots",
    f"""WITH {TREE_SQL} SELECT 1 AS version, path, name_lower, size, sha256 FROM backup WHERE doc_id % 5 <> 0
    UNION ALL SELECT 2, path, name_lower, size + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, sha256 FROM backup WHERE doc_id % 7 <> 0""",
)
def s9_snapshots(spark, sf):
    """A tree is written, then what a scan finds new, changed and deleted is applied; a reader of the first snapshot keeps it."""
    store = backup.tree_store(shared_folder(spark, "store"), "k1", "backup")
    everything = tree(spark, sf).withColumn("mtime", F.timestamp_seconds("mtime"))
    first = snapshots.apply_changes(spark, store, everything.filter(ident() % 5 != 0))
    before = snapshots.read(spark, store)
    scan = everything.filter(ident() % 7 != 0).withColumn("size", F.col("size") + F.when(ident() % 3 == 0, 1).otherwise(0))
    changes = rc.sync_index(scan, before).filter("change <> 'same'")
    second = snapshots.apply_changes(spark, store, changes, deleted=F.col("change") == "deleted")
    rows = [snapshots.read(spark, store, m).withColumn("version", F.lit(m.version)) for m in (first, second)]
    return rows[0].unionByName(rows[1]).select("version", "path", "name_lower", "size", "sha256")


@query("s13_continuous", FOLDER_BYTES_SQL)
def s13_continuous(spark, sf):
    """Files arrive in three rounds; the stream starts again from its checkpoint after each."""
    root, location, checkpoint = (shared_folder(spark, f"stream-{part}") for part in ("files", "table", "checkpoint"))
    docs = table(spark, sf, "documents").select("text", "lang", "source")
    third = F.crc32(F.col("text").cast("binary")) % 3
    store = continuous.ingested(location)
    for k in range(3):
        docs.filter(third == k).write.mode("append").partitionBy("lang", "source").text(root)
        continuous.pick_up(spark, root, store, checkpoint, extensions=(".txt",), files_per_batch=100).awaitTermination()
    return folder_bytes(snapshots.read(spark, store), "size")


@query(
    "r7_cached_metadata",
    f"""WITH {KINDS_SQL} SELECT name, k % 3 <> 1 AS cached, CASE WHEN movie THEN replace(left(made, 10), ':', '-') ELSE printf('2024-05-%02d', 1 + k % 28) END AS date_str,
      'exif' AS date_source, trim(p_type) AS model, CASE WHEN movie THEN '' ELSE trim(p_name) END AS lens,
      CASE WHEN movie THEN '' ELSE p_size || 'mm' END AS focal, CASE WHEN movie THEN 'video' ELSE 'photo' END AS media FROM named""",
)
def r7_cached_metadata(spark, sf):
    """Metadata of the same files asked for twice; every third file has another size by then and is read again."""
    location = shared_folder(spark, "metadata")
    listing = landed_containers(spark, sf)
    backup.cached_metadata(spark, listing, location, "k1")
    k = F.regexp_extract("path", r"/([0-9]+)[.][^/]*$", 1).cast("bigint")
    changed = listing.withColumn("size", F.col("size") + F.when(k % 3 == 1, 1).otherwise(0))
    cache = snapshots.read(spark, backup.metadata_store(location, "k1")).withColumn("scan_key", F.lit("k1"))
    hits = rc.metadata_cache_lookup(changed.select("path", "size", "mtime"), cache, "k1").select("path", F.col("cache_hit").alias("cached"))
    again = backup.cached_metadata(spark, changed, location, "k1").join(hits, "path")
    return again.select(names.base_name("path").alias("name"), "cached", *rc.META)
