"""Per-image measures: one pass over the pixels, everything else in column expressions.

`pixel_stats` reads each raster once and returns counts, sums and short vectors; no pixel leaves
that stage. `derive_measures` turns them into the measures, `score_rows` into scores and flags.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.config import DEFAULTS, QualityParams
from framewright.functions import features as ft
from framewright.functions import photometry as ph
from framewright.functions import pixels as px
from framewright.functions import scoring as sc

RASTER = ("height", "width", "n_channels", "data")
STAT_ROWS, KEYPOINT_ROWS = 256, 16  # rows that leave the pixel pass at once: about 20 kB each, with keypoints up to 1 MB

_LONGS, _DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
PIXEL_STATS: tuple[tuple[str, T.DataType], ...] = (
    ("is_error", T.BooleanType()),
    ("stat_height", T.IntegerType()),
    ("stat_width", T.IntegerType()),
    ("cdf_green", _LONGS),
    ("cdf_blue", _LONGS),
    ("cdf_red", _LONGS),
    ("cdf_highest", _LONGS),
    ("cdf_lowest", _LONGS),
    ("cdf_residual", _LONGS),
    ("saturation_total", T.LongType()),
    ("lap_total", T.LongType()),
    ("lap_squares", T.LongType()),
    ("blocks", _DOUBLES),
    ("grad_totals", _DOUBLES),  # sums of gx, gx², gy, gy², |g|
    ("gradient_p95", T.DoubleType()),
    ("edge_pixels", T.LongType()),
    ("corner_mean", T.DoubleType()),
    ("centre_mean", T.DoubleType()),
    ("corners", T.LongType()),
    ("corner_cells", _LONGS),
    ("band_low", _DOUBLES),
    ("band_high", _DOUBLES),
    ("lag_blocks", _DOUBLES),
    ("lag_energy", _DOUBLES),
)


#: What `functions.features` finds in an image, packed in one row.
FEATURE_TYPES = tuple(
    (name, T.BinaryType() if name == "descriptors" else T.ArrayType(T.FloatType())) for name in ft.FEATURES
)


# Which part of the pixel pass each measure needs; parts nobody asks for are not computed.
PARTS = {
    "laplacian_variance": ("laplacian",),
    "sobel_variance": ("gradient",),
    "sobel_var_x": ("gradient",),
    "sobel_var_y": ("gradient",),
    "sobel_aniso": ("gradient",),
    "tenengrad": ("gradient",),
    "gradient_p95": ("gradient",),
    "edge_density": ("edges",),
    "noise_level": ("residual",),
    "contrast": ("histograms",),
    "brightness": ("histograms",),
    "saturation": ("saturation",),
    "feature_density": ("corners",),
    "feature_uniformity": ("corners",),
    "vignetting": ("patches",),
    "clip_high": ("extremes",),
    "clip_low": ("extremes",),
    "luma_median": ("histograms",),
    "dynamic_range": ("histograms",),
    "wb_kelvin": ("histograms",),
    "wb_gain_rg": ("histograms",),
    "wb_gain_bg": ("histograms",),
    "mb_delta_conc": ("spectrum",),
    "mb_lag_aniso": ("lags", "laplacian"),
}
MEASURES = tuple(PARTS)


def _needed_parts(wanted, p: QualityParams) -> set[str]:
    parts = {part for name in wanted for part in PARTS.get(name, ("laplacian",))}
    off = set()
    off |= set() if p.clip_check else {"extremes"}
    off |= set() if p.feature_check else {"corners"}
    off |= set() if p.motion_blur_check else {"spectrum", "lags"}
    return parts - off


def _measure(bgr: np.ndarray, green: np.ndarray, parts: set[str], p: QualityParams) -> dict:
    out = {"is_error": False, "stat_height": green.shape[0], "stat_width": green.shape[1]}
    if "histograms" in parts:
        for name, channel in (("blue", 0), ("green", 1), ("red", 2)):
            out[f"cdf_{name}"] = px.cumulative_counts(bgr[:, :, channel])
    if parts & {"extremes", "saturation"}:
        highest, lowest = px.channel_extremes(bgr)
        if "extremes" in parts:
            out["cdf_highest"], out["cdf_lowest"] = px.cumulative_counts(highest), px.cumulative_counts(lowest)
        if "saturation" in parts:
            out["saturation_total"] = px.saturation_total(highest, lowest)
    if "residual" in parts:
        out["cdf_residual"] = px.cumulative_counts(px.blur_residual(green))
    if "laplacian" in parts:
        lap = px.laplacian(green)
        out["lap_total"] = int(lap.sum(dtype=np.int64))
        out["lap_squares"] = int((lap.astype(np.int64) ** 2).sum())
        out["blocks"] = px.block_variances(lap, max(2, p.grid_size))
        if "lags" in parts:
            out["lag_blocks"] = px.block_variances(lap, px.LAG_GRID)
            out["lag_energy"] = px.lag_energies(green)
    if "gradient" in parts:
        gx, gy = (g.astype(np.int64) for g in px.sobel(green))
        xx, yy = gx * gx, gy * gy
        norm = np.sqrt(xx + yy)
        out["grad_totals"] = [float(a.sum()) for a in (gx, xx, gy, yy, norm)]
        out["gradient_p95"] = float(np.percentile(norm, 95))
    if "edges" in parts:
        mu, sigma = float(green.mean()), float(green.std())
        out["edge_pixels"] = px.edge_pixels(green, max(0, int(mu - sigma)), min(255, int(mu + sigma)))
    if "patches" in parts:
        out["corner_mean"], out["centre_mean"] = px.corner_means(green)
    if "corners" in parts:
        out["corners"], out["corner_cells"] = px.corner_counts(green, p.corner_response_min)
    if "spectrum" in parts:
        out["band_low"], out["band_high"] = px.band_energies(green)
    return out


def in_pieces(batches, rows: int):
    """Batches cut to so many rows: statistics of small rasters are larger than their pixels, so a full batch would hold far more."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


class Held:
    """Planes of small images, held until they come to as many pixels as are worked on together."""

    def __init__(self, find):
        self.find, self.takers, self.greens = find, [], []

    def add(self, taker, green: np.ndarray) -> None:
        """`taker` is called with what is found in this plane."""
        self.takers.append(taker)
        self.greens.append(green)
        if sum(g.size for g in self.greens) >= ft.STACK:
            self.work()

    def work(self) -> None:
        for taker, found in zip(self.takers, self.find(self.greens), strict=True):
            taker(found)
        self.takers, self.greens = [], []


def pixel_stats(
    df: DataFrame, carry: list[str], orientation: str | None = None, p: QualityParams = DEFAULTS, wanted=MEASURES, keypoints: bool = False
) -> DataFrame:
    """Rasters (columns height, width, n_channels, data) -> carried columns and PIXEL_STATS, with `keypoints` also FEATURE_TYPES.

    Rows without pixels become error rows. The pixels are dropped in the same stage.
    """
    parts = _needed_parts(wanted, p) | ({"keypoints"} if keypoints else set())
    made = PIXEL_STATS + (FEATURE_TYPES if keypoints else ())
    columns = [*carry, *RASTER] + ([orientation] if orientation else [])
    schema = T.StructType(
        [df.schema[c] for c in carry] + [T.StructField(name, kind) for name, kind in made]
    )
    names = [name for name, _ in made]

    def one_pass(batches):
        for batch in in_pieces(batches, KEYPOINT_ROWS if keypoints else STAT_ROWS):
            rows, held = [], Held(lambda greens: ft.packed_keypoints(greens, p.sift_n_features))
            for row in batch.itertuples(index=False):
                ok = row.data is not None and row.height > 0 and row.width > 0
                if ok:
                    image = px.decode_plane(row.data, int(row.height), int(row.width), int(row.n_channels))
                    turn = getattr(row, orientation) if orientation else None
                    if turn is not None and turn == turn and turn != 1:
                        image = px.orient(image, int(turn))
                    image = px.area_downsample(image, p.analysis_dim)
                    green = np.ascontiguousarray(image[:, :, 1])
                    rows.append(_measure(image, green, parts, p))
                    if keypoints:
                        held.add(rows[-1].update, green)
                else:
                    rows.append({"is_error": True})
            held.work()
            stats = pd.DataFrame(rows, columns=names).astype(object)
            stats = stats.where(stats.notna(), None)
            yield pd.concat([batch[carry].reset_index(drop=True), stats], axis=1)

    return df.select(*columns).mapInPandas(one_pass, schema)


def green_plane(data, n_channels=3) -> Column:
    """Every n-th byte of an interleaved raster, from the second on (P1), as an array of numbers."""
    return F.transform(
        F.sequence(F.lit(0), (F.octet_length(data) / n_channels).cast("int") - 1),
        lambda i: F.conv(F.hex(F.substring(data, i * n_channels + 2, F.lit(1))), 16, 10).cast("int"),
    )


def depth_to_uint8(values, kind: str) -> Column:
    """Numeric raster arrays to 0-255: 'uint8' as is, 'uint16' by its high byte, else by its own range."""
    v = F.col(values) if isinstance(values, str) else values
    if kind == "uint8":
        return F.transform(v, lambda x: x.cast("int"))
    if kind == "uint16":
        return F.transform(v, lambda x: F.shiftright(x.cast("int"), 8))
    low, high = F.array_min(v).cast("bigint"), F.array_max(v).cast("bigint")
    return F.when(high - low <= 0, F.transform(v, lambda x: F.lit(0))).otherwise(
        F.transform(
            v, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - low) / (high - low) * 255.0))).cast("int")
        )
    )


def visible_size(width, height, orientation) -> tuple[Column, Column]:
    w, h = F.col(width), F.col(height)
    swapped = F.coalesce(F.col(orientation).isin(5, 6, 7, 8), F.lit(False))
    return F.when(swapped, h).otherwise(w), F.when(swapped, w).otherwise(h)


def _lag_anisotropy() -> Column:
    """Weakest over strongest direction, pooled over the sharpest tenth of 64 cells."""
    k = max(2, round(px.LAG_GRID**2 * 0.10))
    n = len(px.LAGS)
    fields = ", ".join(f"'d{d}', element_at(lag_energy, i * {n} + {d + 1})" for d in range(n))
    top = f"slice(sort_array(transform(lag_blocks, (s, i) -> named_struct('sharp', s, {fields})), false), 1, {k})"
    pooled = ", ".join(f"aggregate(top, 0D, (total, x) -> total + x.d{d})" for d in range(n))
    directions = f"transform(array({top}), top -> array({pooled}))[0]"
    return F.expr(
        f"transform(array({directions}), d -> if(array_max(d) < 1e-6, 1D, array_min(d) / array_max(d)))[0]"
    )


def _dominant_share(band: str) -> Column:
    total = f"aggregate({band}, 0D, (total, x) -> total + x)"
    return F.expr(f"if({total} > 0, array_max({band}) / {total}, 0D)")


def _derived(p: QualityParams) -> dict:
    """How each measure follows from the statistics; built only when asked for."""
    n = F.col("stat_height") * F.col("stat_width")
    total = lambda i: F.element_at("grad_totals", i)
    return {
        "laplacian_variance": lambda: ph.variance("lap_total", "lap_squares", n),
        "sobel_variance": lambda: ph.variance(total(5), total(2) + total(4), n),
        "sobel_var_x": lambda: ph.variance(total(1), total(2), n),
        "sobel_var_y": lambda: ph.variance(total(3), total(4), n),
        "sobel_aniso": lambda: ph.smaller_over_larger(
            ph.variance(total(1), total(2), n), ph.variance(total(3), total(4), n)
        ),
        "tenengrad": lambda: (total(2) + total(4)) / n,
        "edge_density": lambda: F.col("edge_pixels") / n,
        "noise_level": lambda: ph.percentile("cdf_residual", 0.5),
        "contrast": lambda: ph.deviation("cdf_green"),
        "brightness": lambda: ph.mean("cdf_green"),
        "saturation": lambda: F.col("saturation_total") / n,
        "feature_density": lambda: F.coalesce(F.col("corners") / (n / 1000.0), F.lit(0.0)),
        "feature_uniformity": lambda: F.expr(
            "coalesce(array_min(corner_cells) / nullif(array_max(corner_cells), 0), 1D)"
        ),
        "vignetting": lambda: F.expr("if(centre_mean < 1, 1D, corner_mean / centre_mean)"),
        "clip_high": lambda: F.coalesce(ph.share_at_least("cdf_highest", 253), F.lit(0.0)),
        "clip_low": lambda: F.coalesce(ph.share_at_most("cdf_lowest", 2), F.lit(0.0)),
        "luma_median": lambda: ph.percentile("cdf_green", 0.5),
        "dynamic_range": lambda: ph.percentile("cdf_green", 0.95) - ph.percentile("cdf_green", 0.05),
        "wb_kelvin": lambda: ph.kelvin("white_red", "white_green", "white_blue"),
        "wb_gain_rg": lambda: ph.white_gains("white_red", "white_green", "white_blue")[0],
        "wb_gain_bg": lambda: ph.white_gains("white_red", "white_green", "white_blue")[1],
        "mb_delta_conc": lambda: F.coalesce(_dominant_share("band_high") - _dominant_share("band_low"), F.lit(0.0)),
        "mb_lag_aniso": lambda: F.coalesce(_lag_anisotropy(), F.lit(1.0)),
    }


def derive_measures(stats: DataFrame, p: QualityParams = DEFAULTS, wanted=MEASURES) -> DataFrame:
    """Statistics of the pixel pass -> the wanted measures, added as columns."""
    out = stats
    if any(name.startswith("wb_") for name in wanted):
        # The white point feeds three measures: name it first.
        out = out.withColumns({f"white_{c}": ph.percentile(f"cdf_{c}", 0.95) for c in ("red", "green", "blue")})
    derived = _derived(p)
    return out.withColumns({name: derived[name]() for name in wanted if name in derived})


def image_measures(
    df: DataFrame, carry: list[str], orientation: str | None = None, p: QualityParams = DEFAULTS, wanted=MEASURES
) -> DataFrame:
    """Rasters -> carried columns, is_error, analysis size and the wanted measures ('blocks' is one, too)."""
    stats = pixel_stats(df, carry, orientation, p, wanted)
    return derive_measures(stats, p, wanted).select(*carry, "is_error", "stat_height", "stat_width", *wanted)


def score_rows(df: DataFrame, p: QualityParams = DEFAULTS) -> DataFrame:
    """Measured rows (with an `exif` struct) -> scores and per-image flags; staged so that each is named once."""
    longest = F.greatest("stat_height", "stat_width")
    scored = (
        df.withColumns(
            {
                "peak_sharpness": sc.peak_sharpness("blocks", longest, p),
                "sharpness_spread": sc.sharpness_spread("blocks", p),
            }
        )
        .withColumn("__score", sc.noise_penalised(sc.log_score("peak_sharpness", p), "noise_level", p))
        .withColumn("mb_penalty", sc.motion_evidence("__score", "mb_delta_conc", "mb_lag_aniso", p))
        .withColumn("composite_score", sc.final_score(sc.motion_penalised("__score", "mb_penalty", p)))
    )
    return scored.withColumns(
        {
            "is_blurry": sc.is_blurry("composite_score", p),
            "soft_motion_blur": sc.soft_motion("composite_score", "mb_penalty", p),
            "exposure_ok": sc.exposure_ok("brightness", "contrast", p),
            "low_features": sc.low_features("feature_density", p),
            "uneven_features": sc.uneven_features("feature_density", "feature_uniformity", p),
            "has_vignetting": sc.has_vignetting("vignetting", p),
            "clipping_ok": sc.clipping_ok("clip_high", "clip_low", p),
            "low_dynamic_range": sc.low_dynamic_range("dynamic_range", p),
            "ev": sc.ev100("exif.aperture", "exif.shutter", "exif.iso"),
            "slow_shutter": sc.slow_shutter("exif.shutter", "exif.focal_length"),
        }
    ).drop("__score")
