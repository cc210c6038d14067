"""Rename matching, list assignment and selections by an external quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators.reconcile import collision_number

SAMPLE_OF_UNMATCHED = 5


def _per_base(files: DataFrame, path: str, pick) -> DataFrame:
    return files.groupBy(names.camera_base(path).alias("base_name")).agg(pick(path).alias("path"))


def rename_matches(developed: DataFrame, raw: DataFrame, path="path") -> DataFrame:
    """One row per camera identity on both sides; the raw file takes the developed file's stem."""
    left = _per_base(developed, path, F.min).withColumnRenamed("path", "developed_path")
    right = _per_base(raw, path, F.max).withColumnRenamed("path", "raw_path")
    return (
        left.join(right, "base_name")
        .select(
            "base_name",
            names.base_name("raw_path").alias("raw_filename"),
            "raw_path",
            F.concat(names.stem("developed_path"), names.suffix("raw_path")).alias("new_filename"),
        )
        .orderBy("base_name")
    )


def rename_unmatched(developed: DataFrame, raw: DataFrame, path="path") -> DataFrame:
    """Per side: how many identities have no partner, and the first few of them in order."""
    left = _per_base(developed, path, F.min).withColumnRenamed("path", "__developed")
    right = _per_base(raw, path, F.min).withColumnRenamed("path", "__raw")
    side = F.when(F.col("__developed").isNull(), "raw_without_developed").when(F.col("__raw").isNull(), "developed_without_raw")
    alone = left.join(right, "base_name", "full_outer").select("base_name", side.alias("side")).filter("side is not null")
    totals = alone.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("side").orderBy("base_name"))  # kept to its first rows in every task
    first = (
        alone.withColumn("place", place)
        .filter(F.col("place") <= SAMPLE_OF_UNMATCHED)
        .groupBy("side")
        .agg(F.array_join(F.array_sort(F.collect_list("base_name")), ", ").alias("sample"))
    )
    both = developed.sparkSession.createDataFrame([("raw_without_developed",), ("developed_without_raw",)], "side string")
    return both.join(totals.join(first, "side"), "side", "left").select(
        "side", F.coalesce("n", F.lit(0)).alias("unmatched"), "sample"
    )


def rename_manifest(mappings: DataFrame, target_files: DataFrame, overwrite: bool, name="name") -> DataFrame:
    """status 'skipped' where the new name exists and may not be overwritten, else 'done'."""
    existing = target_files.select(F.col(name).alias("new_filename"), F.lit(True).alias("__exists")).distinct()
    status = F.lit("done") if overwrite else F.when(F.col("__exists"), "skipped").otherwise("done")
    return mappings.join(existing, "new_filename", "left").select(*mappings.columns, status.alias("status"))


def assign_components(lists: DataFrame, source: DataFrame, target_root: str, path="path") -> DataFrame:
    """List lines (component, line_no, filename) -> source and target path; NULL source = not found.

    A file may stand in several lists; adaptive execution splits the most listed names.
    """
    files = source.groupBy(names.base_name(path).alias("filename")).agg(F.min(path).alias("src_path"))
    return lists.join(files, ["filename"], "left").select(
        "component",
        "line_no",
        "filename",
        "src_path",
        F.when(F.col("src_path").isNotNull(), names.join_path(F.lit(target_root), "component", "filename")).alias("dst_path"),
    )


def component_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("component").agg(
        F.count("src_path").alias("assigned"), F.count_if(F.col("src_path").isNull()).alias("missing")
    )


def quality_summary(scores: DataFrame, quality="quality") -> DataFrame:
    q = F.col(quality)
    return scores.agg(
        F.count(q).alias("n"), F.min(q).alias("min_quality"), F.max(q).alias("max_quality"), F.avg(q).alias("mean_quality")
    )


def below_threshold(scores: DataFrame, threshold: float, catalog: DataFrame) -> DataFrame:
    """Rows under the threshold, each with whether its file exists (name column `filename`)."""
    there = catalog.select("filename").distinct().withColumn("__there", F.lit(True))
    bad = scores.filter(F.col("quality") < threshold)
    return bad.join(there, ["filename"], "left").select(
        *scores.columns, F.coalesce("__there", F.lit(False)).alias("on_disk")
    )


def threshold_summary(scores: DataFrame, threshold: float, catalog: DataFrame) -> DataFrame:
    """Counts: bad, remaining, removable and failed (listed but not on disk)."""
    there = catalog.select("filename").distinct().withColumn("__there", F.lit(True))
    bad = F.col("quality") < threshold
    return scores.join(there, ["filename"], "left").agg(
        F.count_if(bad).alias("bad"),
        F.count_if(~bad).alias("remaining"),
        F.count_if(bad & F.col("__there").isNotNull()).alias("removable"),
        F.count_if(bad & F.col("__there").isNull()).alias("failed"),
    )


def orphaned_raws(raw: DataFrame, developed: DataFrame, path="path") -> DataFrame:
    """Raw files whose stem (with case) no developed file has."""
    stems = developed.select(names.stem(path).alias("__stem")).distinct()
    marked = raw.withColumn("__stem", names.stem(path))
    return marked.join(stems, ["__stem"], "left_anti").select(*raw.columns).orderBy(path)


def removal_manifest(selected: DataFrame, mode: str, listing: DataFrame, path="path") -> DataFrame:
    """Action per selected file; 'move' goes to `_removed/` beside it, numbered where taken."""
    if mode in ("trash", "delete"):
        return selected.withColumns({"action": F.lit(mode), "target_path": F.lit(None).cast("string")})
    if mode != "move":
        raise ValueError(f"unknown mode {mode!r}")
    request = selected.withColumns(
        {"folder": names.join_path(names.folder(path), F.lit("_removed")), "stem": names.stem(path), "suffix": names.suffix(path)}
    )
    return collision_number(request, listing.select("folder", "stem", "suffix"), [path]).select(
        *selected.columns,
        F.lit(mode).alias("action"),
        names.join_path("folder", names.numbered("stem", "suffix", "number")).alias("target_path"),
    )
