"""Fixed row types: nothing is inferred and nothing is user-defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXIF = T.StructType(
    [
        T.StructField("make", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("orientation", T.IntegerType()),
        T.StructField("aperture", T.DoubleType()),
        T.StructField("shutter", T.DoubleType()),
        T.StructField("iso", T.DoubleType()),
        T.StructField("focal_length", T.DoubleType()),
        T.StructField("datetime", T.StringType()),
        T.StructField(
            "gps", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
        ),
    ]
)

# Columns of a result row with the value an undecodable image carries.
# Unknown ev and overlap are NULL inside the engine; the export writes 0 and -1 for them.
QUALITY_DEFAULTS: tuple[tuple[str, str, object], ...] = (
    ("peak_sharpness", "double", 0.0),
    ("sharpness_spread", "double", 0.0),
    ("laplacian_variance", "double", 0.0),
    ("sobel_variance", "double", 0.0),
    ("edge_density", "double", 0.0),
    ("noise_level", "double", 0.0),
    ("contrast", "double", 0.0),
    ("brightness", "double", 0.0),
    ("saturation", "double", 0.0),
    ("composite_score", "double", 0.0),
    ("is_blurry", "boolean", True),
    ("exposure_ok", "boolean", False),
    ("mb_delta_conc", "double", 0.0),
    ("mb_lag_aniso", "double", 1.0),
    ("mb_penalty", "double", 0.0),
    ("soft_motion_blur", "boolean", False),
    ("slow_shutter", "boolean", False),
    ("feature_density", "double", 0.0),
    ("low_features", "boolean", False),
    ("feature_uniformity", "double", 1.0),
    ("uneven_features", "boolean", False),
    ("vignetting", "double", 1.0),
    ("has_vignetting", "boolean", False),
    ("clip_high", "double", 0.0),
    ("clip_low", "double", 0.0),
    ("clipping_ok", "boolean", True),
    ("luma_median", "double", 0.0),
    ("dynamic_range", "double", 0.0),
    ("wb_kelvin", "double", 0.0),
    ("wb_gain_rg", "double", 1.0),
    ("wb_gain_bg", "double", 1.0),
    ("ev", "double", None),
    ("low_dynamic_range", "boolean", False),
    ("sobel_var_x", "double", 0.0),
    ("sobel_var_y", "double", 0.0),
    ("sobel_aniso", "double", 1.0),
    ("tenengrad", "double", 0.0),
    ("gradient_p95", "double", 0.0),
    ("width", "int", 0),
    ("height", "int", 0),
    ("file_size", "bigint", 0),
)

# Set-level columns, with their value before (or without) a set comparison.
SET_DEFAULTS: tuple[tuple[str, str, object], ...] = (
    ("duplicate_of", "string", None),
    ("expo_dev", "double", 0.0),
    ("exposure_outlier", "boolean", False),
    ("wb_dev", "double", 0.0),
    ("wb_outlier", "boolean", False),
    ("iso_dev_stops", "double", 0.0),
    ("high_iso", "boolean", False),
    ("aperture_dev_stops", "double", 0.0),
    ("aperture_outlier", "boolean", False),
    ("overlap_next", "double", None),
    ("overlap_matches", "int", 0),
    ("overlap_inlier_ratio", "double", 0.0),
)


def default(value, kind: str) -> Column:
    return F.lit(value).cast(kind)


def with_error_defaults(df, is_error: str = "is_error"):
    """Give undecodable rows the default of every measured column; other columns stay."""
    known = {name: (kind, value) for name, kind, value in QUALITY_DEFAULTS if name in df.columns}
    return df.select(
        *[
            F.when(F.col(is_error), default(known[c][1], known[c][0])).otherwise(F.col(c)).alias(c)
            if c in known
            else F.col(c)
            for c in df.columns
        ]
    )


def with_missing_defaults(df, exif: bool = True):
    """Complete a partial row (a table with some of the measures) to the full result row."""
    have = set(df.columns)
    added = {}
    for name, kind, value in (*QUALITY_DEFAULTS, *SET_DEFAULTS):
        if name not in have:
            added[name] = default({"exposure_ok": True}.get(name, value), kind)
    for name, value in (("is_error", F.lit(False)), ("load_backend", F.lit("jvm")), ("load_note", F.lit("")), ("md5", F.lit(""))):
        if name not in have:
            added[name] = value
    if exif and "exif" not in have:
        added["exif"] = F.lit(None).cast(EXIF)
    return df.withColumns(added)
