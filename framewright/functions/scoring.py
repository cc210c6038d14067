"""Scores, flags and labels over one measured row; plain expressions, so Catalyst compiles them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.config import DEFAULTS, QualityParams


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_total(values) / F.size(values))


def topk_mean(blocks, fraction: float) -> Column:
    """Mean of the sharpest share of blocks, at least two of them."""
    b = _col(blocks)
    n = F.size(b)
    k = F.least(n, F.greatest(F.lit(2), F.bround(n * F.lit(float(fraction)), 0).cast("int")))
    top = F.slice(F.sort_array(b, asc=False), F.lit(1), F.greatest(k, F.lit(1)))
    return F.when(n > 0, array_total(top) / k)


def _has_signal(blocks: Column) -> Column:
    return (F.size(blocks) > 0) & (F.array_max(blocks) >= 1e-10)


def peak_sharpness(blocks, longest_side, p: QualityParams = DEFAULTS) -> Column:
    b = _col(blocks)
    scale = F.greatest(F.lit(1.0), F.lit(float(p.analysis_dim)) / F.greatest(F.lit(1), _col(longest_side)))
    return F.when(_has_signal(b), topk_mean(b, p.topk_fraction) * scale * scale).otherwise(0.0)


def log_score(peak, p: QualityParams = DEFAULTS) -> Column:
    low = F.log10(F.lit(max(p.blur_floor, 1e-6)))
    high = F.log10(F.lit(max(p.sharp_ref, p.blur_floor + 1e-6)))
    x = _col(peak)
    return F.when(x > 0, clip01((F.log10(F.greatest(x, F.lit(1e-6))) - low) / (high - low))).otherwise(0.0)


def sharpness_spread(blocks, p: QualityParams = DEFAULTS) -> Column:
    b = _col(blocks)
    peak = topk_mean(b, p.topk_fraction)
    return F.when(_has_signal(b) & (peak > 0), F.least(F.lit(1.0), array_mean(b) / peak)).otherwise(0.0)


def noise_penalised(score, noise, p: QualityParams = DEFAULTS) -> Column:
    if p.noise_penalty_max <= 0 or p.noise_ref <= 0:
        return _col(score)
    return _col(score) * (1.0 - p.noise_penalty_max * clip01(_col(noise) / p.noise_ref))


def _ramp(value: Column, none_at: float, full_at: float) -> Column:
    """Evidence in [0,1] growing from `none_at` to `full_at`, in whichever direction that is."""
    if abs(full_at - none_at) <= 1e-12:
        return F.lit(0.0)
    return clip01((value - none_at) / (full_at - none_at))


def motion_evidence(score, delta_conc, lag_aniso, p: QualityParams = DEFAULTS) -> Column:
    if not p.motion_blur_check:
        return F.lit(0.0)
    both = _ramp(_col(delta_conc), p.mb_delta_good, p.mb_delta_bad) * _ramp(
        _col(lag_aniso), p.mb_lag_good, p.mb_lag_bad
    )
    return F.when(_col(score) > 0, both).otherwise(0.0)


def motion_penalised(score, evidence, p: QualityParams = DEFAULTS) -> Column:
    s, e = _col(score), _col(evidence)
    return F.when(e > 0, F.greatest(F.lit(0.0), s * (1.0 - e * p.motion_blur_penalty_max))).otherwise(s)


def final_score(score) -> Column:
    return clip01(_col(score))


def is_blurry(score, p: QualityParams = DEFAULTS) -> Column:
    return _col(score) < p.blur_threshold


def soft_motion(score, evidence, p: QualityParams = DEFAULTS) -> Column:
    return F.lit(p.motion_blur_soft_check) & (_col(evidence) >= p.soft_mb_floor) & ~is_blurry(score, p)


def exposure_ok(brightness, contrast, p: QualityParams = DEFAULTS) -> Column:
    return (_col(contrast) >= p.min_contrast) & _col(brightness).between(p.min_brightness, p.max_brightness)


def low_features(density, p: QualityParams = DEFAULTS) -> Column:
    return F.lit(p.feature_check) & (_col(density) < p.min_feature_density)


def uneven_features(density, uniformity, p: QualityParams = DEFAULTS) -> Column:
    return (
        F.lit(p.feature_check)
        & (_col(uniformity) < p.min_feature_uniformity)
        & (_col(density) >= p.min_feature_density)
    )


def has_vignetting(ratio, p: QualityParams = DEFAULTS) -> Column:
    return _col(ratio) < p.min_vignetting


def clipping_ok(high, low, p: QualityParams = DEFAULTS) -> Column:
    if not p.clip_check:
        return F.lit(True)
    return (_col(high) <= p.max_clip_high) & (_col(low) <= p.max_clip_low)


def low_dynamic_range(tonal_span, p: QualityParams = DEFAULTS) -> Column:
    return F.lit(p.low_dynamic_range_check) & (_col(tonal_span) < p.min_dynamic_range)


def ev100(aperture, shutter, iso) -> Column:
    """Scene exposure value at ISO 100; NULL where any of the three is missing or not positive."""
    n, t, i = _col(aperture), _col(shutter), _col(iso)
    return F.when((n > 0) & (t > 0) & (i > 0), F.log2((n * n) / (t * (i / 100.0))))


def slow_shutter(shutter, focal_length) -> Column:
    t, f = _col(shutter), _col(focal_length)
    return F.coalesce(F.when((t > 0) & (f > 0), t > 1.0 / f), F.lit(False))


# Label texts, in the order in which they are shown.
ERROR_LABEL = "⚫ Error"
SHARP_LABEL = "🟢 Sharp"
REJECT_HEAD = "🔴 "
WARN_HEAD = "🟡 "
SLOW_SHUTTER_TAIL = " · slow shutter"
PROBLEM_TEXTS = (
    ("blurry_motion", "Blurry (Motion)"),
    ("blurry_plain", "Blurry"),
    ("soft_motion_blur", "Soft (Motion)"),
    ("exposure_bad", "Exposure"),
    ("clipping_bad", "Clipping"),
    ("low_features", "Few Features"),
    ("uneven_features", "Uneven Features"),
    ("has_vignetting", "Vignetting"),
    ("is_duplicate", "Duplicate"),
    ("exposure_outlier", "Expo drift"),
    ("wb_outlier", "WB drift"),
    ("low_dynamic_range", "Flat"),
    ("high_iso", "Hi-ISO"),
    ("aperture_outlier", "Aperture drift"),
)


def status_label() -> Column:
    """Combined label of a result row (columns as in `schemas.QUALITY_DEFAULTS`)."""
    blurry = F.col("is_blurry")
    conditions = {
        "blurry_motion": blurry & (F.col("mb_penalty") > 0),
        "blurry_plain": blurry & ~(F.col("mb_penalty") > 0),
        "soft_motion_blur": F.col("soft_motion_blur") & ~blurry,
        "exposure_bad": ~F.col("exposure_ok"),
        "clipping_bad": ~F.col("clipping_ok"),
        "is_duplicate": F.coalesce(F.col("duplicate_of"), F.lit("")) != "",
    }
    problems = F.concat_ws(
        " + ", *[F.when(conditions.get(key, F.col(key)), F.lit(text)) for key, text in PROBLEM_TEXTS]
    )
    return (
        F.when(F.col("is_error"), ERROR_LABEL)
        .when(problems == "", SHARP_LABEL)
        .otherwise(
            F.concat(
                F.when(blurry, REJECT_HEAD).otherwise(WARN_HEAD),
                problems,
                F.when(blurry & F.col("slow_shutter"), SLOW_SHUTTER_TAIL).otherwise(""),
            )
        )
    )
