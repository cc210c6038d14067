"""The batch quality run: rasters -> measures -> scores -> set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.config import DEFAULTS, QualityParams
from framewright.functions.names import IMAGE_EXTENSIONS
from framewright.operators import consistency, measures, overlap
from framewright.schemas import EXIF, with_error_defaults, with_missing_defaults
from framewright.sources import files, tags
from framewright.sources.shared import materialise


WANTED = ("blocks", *measures.MEASURES)


def image_stats(
    rasters: DataFrame, carry: list[str], orientation: str | None = None, p: QualityParams = DEFAULTS, keypoints: bool = False
) -> DataFrame:
    """The one pass over the pixels: carried columns, visible size and statistics of each image, with its keypoints if wanted.

    `orientation` names a raster column with the tag 1-8 (NULL counts as upright).
    """
    if orientation:
        width, height = measures.visible_size("width", "height", orientation)
    else:
        width, height = F.col("width"), F.col("height")
    sized = rasters.withColumns({"shown_w": width, "shown_h": height})
    return measures.pixel_stats(sized, [*carry, "shown_w", "shown_h"], orientation, p, WANTED, keypoints)


def rows_of_stats(stats: DataFrame, carry: list[str], meta: DataFrame | None = None, p: QualityParams = DEFAULTS) -> DataFrame:
    """Statistics of images -> full result rows. `meta` (path, exif, md5, file_size, ...) is joined here, to narrow rows only."""
    measured = measures.derive_measures(stats, p, WANTED).select(
        *carry, "shown_w", "shown_h", "is_error", "stat_height", "stat_width", *WANTED
    )
    described = measured if meta is None else measured.join(meta, "path")
    if "exif" not in described.columns:
        described = described.withColumn("exif", F.lit(None).cast(EXIF))
    scored = measures.score_rows(described, p).withColumnsRenamed({"shown_w": "width", "shown_h": "height"})
    return with_missing_defaults(with_error_defaults(scored.drop("blocks", "stat_height", "stat_width")))


def quality_rows(
    rasters: DataFrame, carry: list[str], meta: DataFrame | None = None, orientation: str | None = None, p: QualityParams = DEFAULTS
) -> DataFrame:
    """Rasters -> full result rows, one per image."""
    return rows_of_stats(image_stats(rasters, carry, orientation, p), carry, meta, p)


def set_run(results: DataFrame, set_cols: list[str], p: QualityParams = DEFAULTS) -> DataFrame:
    """Result rows -> the same rows with duplicates and drift flags of their set."""
    flat = results.withColumns({"exif_iso": F.col("exif.iso"), "exif_aperture": F.col("exif.aperture")})
    return consistency.set_consistency(
        flat, set_cols, iso="exif_iso", aperture="exif_aperture", is_error="is_error", p=p
    ).drop("exif_iso", "exif_aperture")


def file_facts(spark: SparkSession, paths, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """path, file_size, md5 and exif of every wanted file, from one pass over its bytes."""
    listing = files.scan_media(spark, paths, extensions=extensions).select("path", F.col("length").alias("file_size"))
    probed = materialise(files.probe_files(listing, ("md5",)), "probed")
    exif = tags.normalise_metadata(tags.tag_rows(probed))
    return listing.join(probed.select("path", "md5"), "path", "left").join(exif, "path", "left")


def quality_run(spark: SparkSession, paths, p: QualityParams = DEFAULTS, with_overlap: bool = False) -> DataFrame:
    """Files and folders -> checked result rows of one capture set.

    Each image is decoded once: its statistics and keypoints are written to the shared folder by one stage, and later
    ones read the columns that they need. Only images of pairs that hardly match are decoded again, for the second detector.
    """
    facts = materialise(file_facts(spark, paths), "facts")
    pictures = files.load_rasters(spark, paths).drop("is_error")
    with_overlap = with_overlap and p.overlap_check
    carry = ["path", "load_note"]
    stats = materialise(image_stats(pictures, carry, "turn_tag", p, keypoints=with_overlap), "stats")
    rows = materialise(rows_of_stats(stats, carry, facts, p).withColumn("set_id", F.lit(0)), "rows")
    checked = set_run(rows, ["set_id"], p)
    if not with_overlap:
        return checked
    pairs = overlap.sequence_pairs(rows, ["set_id"], ["path"], is_error="is_error")
    found = overlap.matched_overlap(pairs, overlap.features_of_stats(stats), pictures, orientation="turn_tag", p=p)
    return overlap.attach_overlap(checked, found)
