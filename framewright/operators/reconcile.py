"""Reconciliation of file tables: what is missing, what changed, where it goes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators.spread import with_running_total

UNKNOWN_DATE = "1970-01-01"  # fixed value: date of a file without any


# ---- inventories -------------------------------------------------------------------------------


def exclude_subtree(files: DataFrame, root: str, path="path") -> DataFrame:
    """Drop files inside `root`, comparing path components without case."""
    inside = F.lower(F.col(path)).startswith(root.rstrip("/").lower() + "/")
    return files.filter(~inside)


def file_index(catalog: DataFrame, path="path", size="length", mtime="modificationTime", sha256=None) -> DataFrame:
    digest = F.col(sha256) if sha256 else F.lit(None).cast("string")
    return catalog.select(
        F.col(path).alias("path"),
        F.lower(names.base_name(path)).alias("name_lower"),
        F.col(size).cast("bigint").alias("size"),
        F.col(mtime).alias("mtime"),
        digest.alias("sha256"),
    )


def _match_keys(use_hash: bool) -> list[str]:
    return ["name_lower", "size", "sha256"] if use_hash else ["name_lower", "size"]


def _matched(backup: DataFrame, imported: DataFrame, use_hash: bool, how: str) -> DataFrame:
    """Join by name and size, and by hash if wanted; two unknown hashes count as equal."""
    keys = _match_keys(use_hash)
    there = imported.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = (F.col("name_lower") == F.col("__name_lower")) & (F.col("size") == F.col("__size"))
    if use_hash:
        same = same & F.col("sha256").eqNullSafe(F.col("__sha256"))
    return backup.join(there, same, how)


def missing_files(backup: DataFrame, imported: DataFrame, use_hash: bool = False) -> DataFrame:
    """Backup rows without an import row of equal name and size (and hash)."""
    return _matched(backup, imported, use_hash, "left_anti")


def present_files(backup: DataFrame, imported: DataFrame, use_hash: bool = False) -> DataFrame:
    return _matched(backup, imported, use_hash, "left_semi")


def _renamed(df: DataFrame, columns: list[str], prefix: str, key="path") -> DataFrame:
    return df.select(key, *[F.col(c).alias(prefix + c) for c in columns])


def incremental_hash(scan: DataFrame, index: DataFrame, contents: DataFrame | Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Give every scanned row its hash: the stored one if size and mtime are unchanged, else a fresh one.

    `contents` makes (path, sha256) of the stale rows that it is given, as `sources.files.file_hashes` does, or is
    a table (path, content); unchanged rows are never read. None means hashing is off, then unchanged rows keep
    their stored hash and the rest has none. `hash_reused` tells which is which.
    """
    old = _renamed(index, ["size", "mtime", "sha256"], "old_").withColumn("__known", F.lit(True))
    unchanged = F.coalesce(F.col("__known") & (F.col("old_size") == F.col("size")) & (F.col("old_mtime") == F.col("mtime")), F.lit(False))
    stored = F.when(unchanged, F.col("old_sha256"))
    seen = scan.drop("sha256").join(old, "path", "left").withColumn("stored", stored)
    keep = [c for c in scan.columns if c != "sha256"]
    if contents is None:
        return seen.select(*keep, F.col("stored").alias("sha256"), F.lit(False).alias("hash_reused"))
    reused = seen.filter(F.col("stored").isNotNull())
    stale = seen.filter(F.col("stored").isNull()).select(*keep)
    if callable(contents):
        hashes = contents(stale)
    else:
        hashes = contents.join(stale.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"))
    fresh = stale.join(hashes, "path", "left")
    return reused.select(*keep, F.col("stored").alias("sha256"), F.lit(True).alias("hash_reused")).unionByName(
        fresh.select(*keep, "sha256", F.lit(False).alias("hash_reused"))
    )


def sync_index(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Classify every path of the scan and the stored index: new, changed, deleted or same.

    The new snapshot is everything but the deleted rows.
    """
    columns = ["name_lower", "size", "mtime", "sha256"]
    now = _renamed(scan, columns, "new_").withColumn("__now", F.lit(True))
    old = _renamed(index, columns, "old_").withColumn("__old", F.lit(True))
    same = (F.col("new_size") == F.col("old_size")) & (F.col("new_mtime") == F.col("old_mtime"))
    for c in ("name_lower", "sha256"):
        same = same & F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}"))
    return now.join(old, "path", "full_outer").select(
        "path",
        *[F.when(F.col("__now"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in columns],
        F.when(F.col("__old").isNull(), "new").when(F.col("__now").isNull(), "deleted").when(same, "same").otherwise("changed").alias("change"),
    )


# ---- metadata ----------------------------------------------------------------------------------

META = ("date_str", "date_source", "model", "lens", "focal", "media")


def metadata_cache_lookup(files: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Files with the metadata cached by the scan `key`; `cache_hit` only if path, size and mtime are all equal."""
    stored = cache.filter(F.col("scan_key") == key).select("path", "size", "mtime", *META, F.lit(True).alias("__hit"))
    return files.join(stored, ["path", "size", "mtime"], "left").select(
        *files.columns, *META, F.coalesce("__hit", F.lit(False)).alias("cache_hit")
    )


def metadata_cache_upsert(cache: DataFrame, fresh: DataFrame, keys=("scan_key", "path")) -> DataFrame:
    """Last write wins per key; a whole row moves together."""
    columns = [c for c in cache.columns if c not in keys]
    both = cache.withColumn("__turn", F.lit(0)).unionByName(fresh.withColumn("__turn", F.lit(1)))
    return (
        both.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), "__turn").alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns])
        .select(*cache.columns)
    )


def capture_date(tags: list, mtime) -> tuple[Column, Column]:
    """(date text, source): first valid yyyy-MM-dd of `tags`, else the modification day, else unknown."""
    valid = [
        F.when(F.col(t).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_date(F.col(t), "yyyy-M-d").isNotNull(), F.col(t))
        for t in tags
    ]
    exif = F.coalesce(*valid)
    day = F.date_format(F.col(mtime), "yyyy-MM-dd")
    return (
        F.coalesce(exif, day, F.lit(UNKNOWN_DATE)),
        F.when(exif.isNotNull(), "exif").when(day.isNotNull(), "filesystem").otherwise("unknown"),
    )


def lens_label(*candidates) -> Column:
    return names.sanitize_part(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in candidates], F.lit("")))


def file_metadata(files: DataFrame, records: DataFrame, path="path", mtime="mtime") -> DataFrame:
    """Files joined with their tag records (one per path) -> the META columns."""
    joined = files.join(records, path, "left")
    date, source = capture_date(["DateTimeOriginal", "CreateDate", "MediaCreateDate"], mtime)
    return joined.select(
        *files.columns,
        date.alias("date_str"),
        source.alias("date_source"),
        names.sanitize_part("Model").alias("model"),
        lens_label("LensModel", "LensID", "LensSpec").alias("lens"),
        names.format_focal("FocalLength").alias("focal"),
        names.media_kind(path).alias("media"),
    )


# ---- destinations ------------------------------------------------------------------------------


@dataclass(frozen=True)
class TransferPlan:
    """How destination folders and names are built."""

    output_root: str
    folder_date: bool = False
    folder_focal: bool = False
    folder_model: bool = False
    folder_lens: bool = False
    folder_media: bool = False
    name_date: bool = False
    name_model: bool = False
    name_lens: bool = False
    name_focal: bool = False
    separator: str = "_"
    prefix: str = ""
    suffix: str = ""


def subfolder_parts(plan: TransferPlan) -> Column:
    """Chosen folder levels, joined by '/'; an empty value becomes 'unknown' (a date never is)."""
    def level(column: Column) -> Column:
        return F.when(F.coalesce(column, F.lit("")) == "", "unknown").otherwise(column)

    parts = []
    if plan.folder_date:
        parts.append(F.col("date_str"))
    for wanted, column in (
        (plan.folder_focal, names.sanitize_part("focal")),
        (plan.folder_model, names.sanitize_part("model")),
        (plan.folder_lens, names.sanitize_part("lens")),
        (plan.folder_media, F.col("media")),
    ):
        if wanted:
            parts.append(level(column))
    return F.concat_ws("/", *parts) if parts else F.lit("")


def _trimmed(text: str, separator: str) -> str:
    """`text` without leading and trailing separators."""
    return re.sub(rf"\A(?:{re.escape(separator)})+|(?:{re.escape(separator)})+\Z", "", text) if separator else text


def build_name(stem: Column, plan: TransferPlan) -> Column:
    """The wanted parts of a name in their order, joined by the separator; an empty result falls back to the stem."""
    return names.bound(stem, lambda known: _built_name(known, plan))


def _built_name(stem: Column, plan: TransferPlan) -> Column:
    prefix, suffix = _trimmed(plan.prefix, plan.separator), _trimmed(plan.suffix, plan.separator)
    parts = (
        (plan.name_date, F.col("date_str")),
        (prefix, F.lit(prefix)),
        (True, stem),
        (suffix, F.lit(suffix)),
        (plan.name_model, F.col("model")),
        (plan.name_lens, F.col("lens")),
        (plan.name_focal, F.col("focal")),
    )
    shown = [part if part is stem else F.nullif(part, F.lit("")) for wanted, part in parts if wanted]
    name = names.sanitize_part(F.concat_ws(plan.separator, *shown))
    return names.bound(name, lambda made: F.when(made == "", stem).otherwise(made))


def collision_number(
    requests: DataFrame, taken: DataFrame, order: list[str], number="number", settled: str | None = None
) -> DataFrame:
    """Number every request for a target (folder, stem, suffix) so that all final names differ.

    Requests count up from 0 in `order`; numbers whose name already exists in `taken` (folder, stem,
    suffix), or which another row asks for as its own natural name, are skipped. Names compare without
    case. A popular name does not end in one task: both counts run in range-partitioned chunks.
    Rows whose boolean column `settled` is true keep number 0 and take no part.
    """
    key = ["__folder", "__stem", "__suffix"]
    lowered = lambda df: df.withColumns({k: F.lower(F.col(k.strip("_"))) for k in key})
    asked, on_disk = lowered(requests), lowered(taken)
    # A name 'x_3' occupies number 3 of 'x'; a name on disk also occupies number 0 of itself.
    base, digits = (F.regexp_extract("__stem", r"^(.+)_([1-9][0-9]{0,17})$", i) for i in (1, 2))
    numbered = lambda df: df.filter(digits != "").select(
        "__folder", base.alias("__stem"), "__suffix", digits.cast("bigint").alias("__at")
    )
    occupied = (
        numbered(asked)
        .unionAll(numbered(on_disk))
        .unionAll(on_disk.select(*key, F.lit(0).cast("bigint").alias("__at")))
        .distinct()
    )
    columns = requests.columns
    none = lambda c: F.lit(None).cast(requests.schema[c].dataType).alias(c)
    kind = F.lit(1) if settled is None else F.when(F.col(settled), 2).otherwise(1)
    lined_up = asked.select(*columns, *key, kind.alias("__kind"), F.lit(0).cast("bigint").alias("__at")).unionByName(
        occupied.select(*[none(c) for c in columns], *key, F.lit(0).alias("__kind"), "__at")
    )
    ranked = with_running_total(lined_up, [*key, "__kind"], ["__at", *order], F.lit(1).cast("bigint"), "__rank")
    # The i-th occupied number t leaves t - i free numbers below it: it pushes up every request from there on.
    placed = ranked.withColumn(
        "__place", F.when(F.col("__kind") == 0, F.col("__at") - F.col("__rank") + 1).otherwise(F.col("__rank") - 1)
    )
    pushes = F.when(F.col("__kind") == 0, 1).otherwise(0)
    pushed = with_running_total(placed, key, ["__place", "__kind", "__at", *order], pushes, "__pushed")
    free = F.when(F.col("__kind") == 1, F.col("__place") + F.col("__pushed")).otherwise(0)
    return pushed.filter("__kind > 0").select(*columns, free.alias(number))


def resolve_destination(requests: DataFrame, listing: DataFrame, order: list[str]) -> DataFrame:
    """Requests (folder, stem, suffix, size, ...) -> dest_path and already.

    A natural target of the same size is already there; everything else gets its first free name.
    `listing` has folder, stem, suffix and size of the files at the destination.
    """
    key = ["__f", "__s", "__x"]
    lowered = lambda df: df.withColumns({"__f": F.lower("folder"), "__s": F.lower("stem"), "__x": F.lower("suffix")})
    there = lowered(listing).select(*key, "size").distinct().withColumn("__there", F.lit(True))
    marked = lowered(requests).join(there, [*key, "size"], "left").select(
        *requests.columns, F.coalesce("__there", F.lit(False)).alias("already")
    )
    numbered = collision_number(marked, listing.select("folder", "stem", "suffix"), order, settled="already")
    dest = names.join_path("folder", names.numbered("stem", "suffix", "number"))
    return numbered.select(*requests.columns, dest.alias("dest_path"), "already")


def destination_request(files: DataFrame, plan: TransferPlan, path="path") -> DataFrame:
    """Add folder, stem and suffix of the natural target."""
    sub = subfolder_parts(plan)
    return files.withColumns(
        {
            "folder": F.concat_ws("/", F.lit(plan.output_root), F.nullif(sub, F.lit(""))),
            "stem": build_name(names.stem(path), plan),
            "suffix": names.suffix(path),
        }
    )


PLAN = ("path", "size", *META, "dest_path", "status")


def plan_transfer(missing: DataFrame, records: DataFrame, listing: DataFrame, plan: TransferPlan) -> DataFrame:
    """Missing files (path, size, mtime) -> metadata, destination and status 'missing' or 'present'."""
    return plan_described(file_metadata(missing.select("path", "size", "mtime"), records), listing, plan)


def plan_described(described: DataFrame, listing: DataFrame, plan: TransferPlan) -> DataFrame:
    """The same for files whose metadata is known."""
    resolved = resolve_destination(destination_request(described, plan), listing, ["path"])
    return resolved.withColumn("status", F.when(F.col("already"), "present").otherwise("missing")).select(*PLAN)


def replan_diff(old_plan: DataFrame, listing: DataFrame, plan: TransferPlan) -> DataFrame:
    """Plan the kept rows again (only missing and present ones) and tell which rows changed."""
    open_rows = old_plan.filter(F.col("status").isin("missing", "present"))
    request = destination_request(open_rows.withColumnsRenamed({"dest_path": "old_dest", "status": "old_status"}), plan)
    again = resolve_destination(request, listing, ["path"]).withColumn("status", F.when(F.col("already"), "present").otherwise("missing"))
    return again.select(
        *PLAN,
        ((F.col("dest_path") != F.col("old_dest")) | (F.col("status") != F.col("old_status"))).alias("changed"),
    )


def transfer_manifest(old_plan: DataFrame, listing: DataFrame, plan: TransferPlan, mode: str, use_hash: bool = False) -> DataFrame:
    """Rows still 'missing' -> action and final destination; nothing is moved.

    With hashing, `old_plan` and `listing` carry sha256: an equal file at the target is skipped and a
    different one of the same size makes the row take the next free name. Without, same size is enough.
    """
    if mode not in ("copy", "move"):
        raise ValueError(f"unknown mode {mode!r}")
    pending = old_plan.filter(F.col("status") == "missing").drop("dest_path", "status")
    request = destination_request(pending, plan)
    # What counts as 'the same file' is the size, or size and hash together.
    alike = (lambda df: F.struct(F.col("size"), F.col("sha256"))) if use_hash else (lambda df: F.struct("size"))
    columns = [c for c in request.columns if c != "size"]
    resolved = resolve_destination(
        request.select(*columns, alike(request).alias("size"), F.col("size").alias("__bytes")),
        listing.select("folder", "stem", "suffix", alike(listing).alias("size")),
        ["path"],
    )
    return resolved.select(
        "path", "date_str", "date_source", F.col("__bytes").alias("size"), "dest_path",
        F.when(F.col("already"), "skipped").otherwise({"copy": "copied", "move": "moved"}[mode]).alias("status"),
    )


def scan_summary(imported: DataFrame, backup: DataFrame, missing: DataFrame, described: DataFrame) -> DataFrame:
    """Counts of a run as (counter, n) rows: files per tree, missing, reused hashes, dated by metadata.

    Each input is read once.
    """
    rows, reused = F.count(F.lit(1)), F.count_if("hash_reused")

    def counters(df: DataFrame, **found) -> DataFrame:
        totals = df.agg(*[c.alias(name) for name, c in found.items()])
        return totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in found])).alias("x"))

    lines = (
        counters(imported, import_files=rows, reused_hashes=reused)
        .unionAll(counters(backup, backup_files=rows, reused_hashes=reused))
        .unionAll(counters(missing, missing_files=rows))
        .unionAll(counters(described, dated_by_metadata=F.count_if(F.col("date_source") == "exif")))
    )
    return lines.groupBy("x.counter").agg(F.sum("x.n").alias("n"))


def keep_reject_manifest(selected: DataFrame, target: str, listing: DataFrame, path="path") -> DataFrame:
    """Selected rows -> target path, numbered where names clash (nothing is moved)."""
    request = selected.withColumns({"folder": F.lit(target), "stem": names.stem(path), "suffix": names.suffix(path)})
    numbered = collision_number(request, listing.select("folder", "stem", "suffix"), [path])
    return numbered.select(
        *selected.columns, names.join_path("folder", names.numbered("stem", "suffix", "number")).alias("target_path")
    )
