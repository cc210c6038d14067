"""Export, histogram, counts, filters and rankings over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.config import DEFAULTS, QualityParams
from framewright.functions import names
from framewright.functions.scoring import status_label
from framewright.operators.spread import with_row_number

HISTOGRAM_BINS = 60
BAND_MARGIN = 0.15

# The export's columns in their order, with source column, factor and digits.
EXPORT_ROUNDED = {
    "quality_score": ("composite_score", 1, 4),
    "clip_high_pct": ("clip_high", 100, 3),
    "clip_low_pct": ("clip_low", 100, 3),
    "feature_density": ("feature_density", 1, 3),
    "feature_uniformity": ("feature_uniformity", 1, 4),
    "vignetting": ("vignetting", 1, 4),
    "expo_dev": ("expo_dev", 1, 3),
    "wb_kelvin": ("wb_kelvin", 1, 0),
    "wb_gain_rg": ("wb_gain_rg", 1, 3),
    "wb_gain_bg": ("wb_gain_bg", 1, 3),
    "wb_dev": ("wb_dev", 1, 4),
    "luma_median": ("luma_median", 1, 1),
    "dynamic_range": ("dynamic_range", 1, 1),
    "iso_dev_stops": ("iso_dev_stops", 1, 3),
    "aperture_dev_stops": ("aperture_dev_stops", 1, 3),
    "overlap_inlier_ratio": ("overlap_inlier_ratio", 1, 4),
    "peak_sharpness": ("peak_sharpness", 1, 2),
    "sharpness_spread": ("sharpness_spread", 1, 4),
    "mb_delta_conc": ("mb_delta_conc", 1, 4),
    "mb_lag_aniso": ("mb_lag_aniso", 1, 4),
    "mb_penalty": ("mb_penalty", 1, 4),
    "laplacian_variance": ("laplacian_variance", 1, 2),
    "sobel_variance": ("sobel_variance", 1, 2),
    "sobel_var_x": ("sobel_var_x", 1, 2),
    "sobel_var_y": ("sobel_var_y", 1, 2),
    "sobel_aniso": ("sobel_aniso", 1, 4),
    "tenengrad": ("tenengrad", 1, 2),
    "gradient_p95": ("gradient_p95", 1, 2),
    "edge_density": ("edge_density", 1, 4),
    "noise_level": ("noise_level", 1, 2),
    "contrast": ("contrast", 1, 2),
    "brightness": ("brightness", 1, 2),
    "saturation": ("saturation", 1, 2),
}
EXPORT_COLUMNS = (
    "filename", "path", "status", "quality_score", "is_blurry", "exposure_ok", "clipping_ok",
    "clip_high_pct", "clip_low_pct", "feature_density", "low_features", "feature_uniformity",
    "uneven_features", "vignetting", "has_vignetting", "slow_shutter", "duplicate_of", "ev",
    "expo_dev", "exposure_outlier", "wb_kelvin", "wb_gain_rg", "wb_gain_bg", "wb_dev", "wb_outlier",
    "luma_median", "dynamic_range", "low_dynamic_range", "iso_dev_stops", "high_iso",
    "aperture_dev_stops", "aperture_outlier", "overlap_next", "overlap_matches",
    "overlap_inlier_ratio", "is_error", "load_backend", "load_note", "peak_sharpness",
    "sharpness_spread", "mb_delta_conc", "mb_lag_aniso", "mb_penalty", "soft_motion_blur",
    "laplacian_variance", "sobel_variance", "sobel_var_x", "sobel_var_y", "sobel_aniso", "tenengrad",
    "gradient_p95", "edge_density", "noise_level", "contrast", "brightness", "saturation",
    "exif_make", "exif_model", "exif_aperture", "exif_shutter", "exif_iso", "exif_focal_length",
    "exif_datetime", "exif_gps", "file_size_mb", "width", "height",
)


def _shown(field: str) -> Column:
    """A value as text; small numbers are written out, and from 1e-4 down with a two-digit exponent."""
    value = F.col(f"exif.{field}")
    text = names.bound(value, _number_text) if field in ("aperture", "shutter", "iso", "focal_length") else value.cast("string")
    return F.coalesce(text, F.lit(""))


def _number_text(value: Column) -> Column:
    text = value.cast("string")
    plain = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), "0+$", "")
    short = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.0e", "e"), r"e-(\d)$", "e-0$1")
    size = F.abs(value)
    return F.when((size > 0) & (size < 1e-4), short).when((size > 0) & (size < 1e-3), plain).otherwise(text)


def export_rows(df: DataFrame) -> DataFrame:
    """The 67 flat export columns; NULLs become the export's sentinels (0, -1 and empty text)."""
    special = {
        "filename": names.base_name("path"),
        "status": status_label(),
        "duplicate_of": F.coalesce(F.col("duplicate_of"), F.lit("")),
        "ev": F.bround(F.coalesce(F.col("ev"), F.lit(0.0)), 3),
        "overlap_next": F.bround(F.coalesce(F.col("overlap_next"), F.lit(-1.0)), 4),
        "exif_gps": F.coalesce(
            F.concat(F.col("exif.gps.lat").cast("string"), F.lit(", "), F.col("exif.gps.lon").cast("string")), F.lit("")
        ),
        "file_size_mb": F.bround(F.col("file_size") / (1024 * 1024), 2),
    }
    special |= {f"exif_{f}": _shown(f) for f in ("make", "model", "aperture", "shutter", "iso", "focal_length", "datetime")}
    out = []
    for name in EXPORT_COLUMNS:
        if name in special:
            column = special[name]
        elif name in EXPORT_ROUNDED:
            source, factor, digits = EXPORT_ROUNDED[name]
            column = F.bround(F.col(source) * factor, digits)
        else:
            column = F.col(name)
        out.append(column.alias(name))
    return df.select(*out)


def histogram_band(centre: Column, p: QualityParams = DEFAULTS) -> Column:
    return (
        F.when(centre < p.blur_threshold - BAND_MARGIN, "red")
        .when(centre > p.blur_threshold + BAND_MARGIN, "green")
        .otherwise("yellow")
    )


def score_histogram(df: DataFrame, score="composite_score", is_error="is_error", bins: int = HISTOGRAM_BINS, p: QualityParams = DEFAULTS) -> DataFrame:
    """Counts of `bins` equal bins of [0,1] (the last one closed), empty bins included, with their band."""
    counted = (
        df.filter(~F.col(is_error) & F.col(score).between(0.0, 1.0))
        .groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        histogram_band((F.col("bin") + 0.5) / bins, p).alias("band"),
    )


def status_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of counters over the decoded images (errors are counted apart)."""
    ok = ~F.col("is_error")
    duplicate = F.coalesce(F.col("duplicate_of"), F.lit("")) != ""
    flagged = [F.col(c) for c in (
        "is_blurry", "low_features", "exposure_outlier", "wb_outlier", "low_dynamic_range", "high_iso",
        "aperture_outlier", "soft_motion_blur",
    )]
    clean = F.col("exposure_ok") & F.col("clipping_ok") & ~duplicate
    for flag in flagged:
        clean = clean & ~flag
    counters = {
        "total": ok,
        "clean": ok & clean,
        "blurry": ok & F.col("is_blurry"),
        "exposure": ok & ~F.col("exposure_ok"),
        "clipping": ok & ~F.col("clipping_ok"),
        "few_features": ok & F.col("low_features"),
        "duplicates": ok & duplicate,
        "expo_drift": ok & F.col("exposure_outlier"),
        "wb_drift": ok & F.col("wb_outlier"),
        "high_iso": ok & F.col("high_iso"),
        "soft_motion": ok & F.col("soft_motion_blur"),
        "errors": F.col("is_error"),
    }
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(name) for name, c in counters.items()])


def threshold_filter(df: DataFrame, mode: str = "slider", threshold: float = 0.0, score="composite_score") -> DataFrame:
    if mode == "all":
        return df
    if mode == "blurry":
        return df.filter(F.col("is_blurry"))
    if mode == "slider":
        return df.filter(F.col(score) >= threshold)
    raise ValueError(f"unknown filter mode {mode!r}")


def range_select(df: DataFrame, low: float, high: float, score="composite_score") -> DataFrame:
    return df.filter(F.col(score).between(low, high))


def range_count(df: DataFrame, low: float, high: float, score="composite_score") -> DataFrame:
    return df.agg(F.count_if(F.col(score).between(low, high)).alias("selected"))


def rank_by_quality(df: DataFrame, score="composite_score", path="path") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(path))


def best(df: DataFrame, score="composite_score", path="path") -> DataFrame:
    """The top row, as a TakeOrdered and not as a full sort."""
    return rank_by_quality(df, score, path).limit(1)


def overlap_report(df: DataFrame, set_cols: list[str], order: list[str], p: QualityParams = DEFAULTS) -> DataFrame:
    """Ordinal in capture order and the shown overlap: 'n/a', '?' (too few inliers) or a percentage."""
    inliers = F.floor(F.col("overlap_matches") * F.col("overlap_inlier_ratio"))
    overlap = F.col("overlap_next")
    reliable = overlap.isNotNull() & (inliers >= p.min_reliable_inliers)
    ordered = with_row_number(df.filter(~F.col("is_error")), set_cols, order, "ordinal")
    return ordered.withColumns(
        {
            "overlap_text": F.when(overlap.isNull(), "n/a")
            .when(~reliable, "?")
            .otherwise(F.format_string("%.1f", F.bround(overlap * 100, 1))),
            "overlap_class": F.when(
                reliable, F.when(overlap < 0.30, "low").when(overlap > 0.90, "redundant").otherwise("good")
            ),
            "matches_text": F.when(F.col("overlap_matches") != 0, F.col("overlap_matches").cast("string")).otherwise("–"),
            "inlier_text": F.when(
                F.col("overlap_inlier_ratio") > 0, F.format_string("%.0f", F.bround(F.col("overlap_inlier_ratio") * 100, 0))
            ).otherwise("–"),
        }
    )


def run_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_blurry").alias("blurry"))


def drop_vanished(results: DataFrame, catalog: DataFrame, path="path") -> DataFrame:
    """Keep results whose file is still in a fresh listing."""
    return results.join(catalog.select(path), path, "left_semi")
