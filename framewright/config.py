"""Parameters of the quality measures, passed explicitly and turned into literals by Catalyst."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QualityParams:
    # Calibrated defaults and check limits.
    analysis_dim: int = 2048
    grid_size: int = 8
    topk_fraction: float = 0.10
    blur_floor: float = 30.0
    sharp_ref: float = 600.0
    blur_threshold: float = 0.5
    noise_penalty_max: float = 0.15
    noise_ref: float = 25.0
    min_contrast: float = 18.0
    min_brightness: float = 22.0
    max_brightness: float = 232.0
    motion_blur_check: bool = True
    mb_delta_good: float = 0.15
    mb_delta_bad: float = 0.20
    mb_lag_good: float = 0.21
    mb_lag_bad: float = 0.10
    motion_blur_penalty_max: float = 0.95
    motion_blur_soft_check: bool = True
    soft_mb_floor: float = 0.20
    feature_check: bool = True
    min_feature_density: float = 2.0
    min_feature_uniformity: float = 0.05
    min_vignetting: float = 0.50
    overlap_check: bool = True
    sift_n_features: int = 5000
    sift_ratio: float = 0.75
    sift_ransac_px: float = 5.0
    clip_check: bool = True
    max_clip_high: float = 0.02
    max_clip_low: float = 0.25
    exposure_consistency: bool = True
    exposure_outlier_ev: float = 0.5
    exposure_outlier_luma: float = 0.25
    low_dynamic_range_check: bool = True
    min_dynamic_range: float = 55.0
    wb_consistency: bool = True
    wb_gain_dev_max: float = 0.15
    iso_consistency: bool = True
    iso_dev_stops_max: float = 2.0
    aperture_consistency: bool = True
    aperture_dev_stops_max: float = 0.5

    # Calibration constants of the corner and overlap estimates.
    corner_response_min: float = 0.0002
    min_reliable_inliers: int = 8
    fallback_below_matches: int = 20
    fallback_ratio: float = 0.80
    # White-balance medians count error rows (with neutral gains) unless switched off.
    wb_counts_errors: bool = True


DEFAULTS = QualityParams()
