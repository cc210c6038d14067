"""Comparison of every image with its set: duplicates and drift from the set's exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.config import DEFAULTS, QualityParams
from framewright.operators.medians import exact_medians

MIN_SET_ROWS = 3


def mark_duplicates(df: DataFrame, hash_col: str = "md5", path_col: str = "path") -> DataFrame:
    """`duplicate_of` = lowest path with the same non-empty hash, NULL on that first row itself."""
    copies = (
        df.filter(F.col(hash_col) != "")
        .groupBy(hash_col)
        .agg(F.min(path_col).alias("__first_path"), F.count(F.lit(1)).alias("__copies"))
        .filter(F.col("__copies") > 1)
        .drop("__copies")
    )
    keep = [c for c in df.columns if c != "duplicate_of"]
    return df.select(*keep).join(copies, hash_col, "left").select(
        *keep,
        F.when(F.col(path_col) != F.col("__first_path"), F.col("__first_path")).alias("duplicate_of"),
    )


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def set_medians(df: DataFrame, set_cols: list[str], measures: dict[str, Column]) -> DataFrame:
    """Exact median and count of each measure per set (robust_median)."""
    return exact_medians(df, set_cols, measures)


def _compare(df: DataFrame, set_cols: list[str], path_col: str, measures: dict[str, Column], out) -> DataFrame:
    """Attach the set's medians to each row, compute the output columns and drop the medians."""
    named = {f"__{k}": v for k, v in measures.items()}
    stats = set_medians(df, set_cols, named)
    # Sets too small for every check are left out: they have nothing to compare with.
    stats = stats.filter(F.array_max(F.array(*[F.col(f"n_{m}") for m in named])) >= MIN_SET_ROWS)
    outputs: dict[str, Column] = {}
    for make in out:
        outputs.update(make)
    keep = [c for c in df.columns if c not in outputs]
    return df.select(*keep).join(stats, set_cols, "left").select(
        *keep, *[c.alias(name) for name, c in outputs.items()]
    )


def _enough(name: str) -> Column:
    return F.coalesce(F.col(f"n___{name}"), F.lit(0)) >= MIN_SET_ROWS


def _exposure(ev: str, luma: str, p: QualityParams):
    """EV decides as soon as three rows of the set have one; only otherwise brightness does."""
    by_ev = _enough("ev")
    by_luma = ~by_ev & _enough("luma") & (F.col("__luma") > 0)
    ev_dev = F.when(F.col(ev) > 0, F.col(ev) - F.col("__ev"))
    luma_dev = F.when(F.col(luma) > 0, (F.col(luma) - F.col("__luma")) / F.col("__luma"))
    dev = F.coalesce(F.when(by_ev, ev_dev).when(by_luma, luma_dev), F.lit(0.0))
    limit = F.when(by_ev, F.lit(p.exposure_outlier_ev)).otherwise(F.lit(p.exposure_outlier_luma))
    return {"expo_dev": dev, "exposure_outlier": F.abs(dev) > limit}


def _white(rg: str, bg: str, p: QualityParams):
    dev = F.when(_enough("rg"), F.hypot(F.col(rg) - F.col("__rg"), F.col(bg) - F.col("__bg"))).otherwise(0.0)
    return {"wb_dev": dev, "wb_outlier": dev > p.wb_gain_dev_max}


def _stops(value: str, name: str) -> Column:
    usable = _enough(name) & (F.col(value) > 0) & (F.col(f"__{name}") > 0)
    return F.when(usable, F.log2(F.col(value) / F.col(f"__{name}"))).otherwise(0.0)


def _iso(iso: str, p: QualityParams):
    dev = _stops(iso, "iso")
    return {"iso_dev_stops": dev, "high_iso": dev > p.iso_dev_stops_max}


def _aperture(aperture: str, p: QualityParams):
    dev = _stops(aperture, "aperture")
    return {"aperture_dev_stops": dev, "aperture_outlier": F.abs(dev) > p.aperture_dev_stops_max}


def exposure_drift(df, set_cols, ev="ev", luma="luma_median", path_col="path", p: QualityParams = DEFAULTS):
    measures = {"ev": _positive(ev), "luma": _positive(luma)}
    return _compare(df, set_cols, path_col, measures, [_exposure(ev, luma, p)])


def wb_drift(df, set_cols, rg="wb_gain_rg", bg="wb_gain_bg", path_col="path", is_error=None, p: QualityParams = DEFAULTS):
    """Distance of the white gains from the set's; error rows count with gains 1,1 unless switched off."""
    return _compare(df, set_cols, path_col, _gain_measures(rg, bg, is_error, p), [_white(rg, bg, p)])


def _gain_measures(rg, bg, is_error, p):
    counts = F.lit(True) if p.wb_counts_errors or is_error is None else ~F.col(is_error)
    return {"rg": F.when(counts, F.col(rg)), "bg": F.when(counts, F.col(bg))}


def iso_drift(df, set_cols, iso="iso", path_col="path", p: QualityParams = DEFAULTS):
    return _compare(df, set_cols, path_col, {"iso": _positive(iso)}, [_iso(iso, p)])


def aperture_drift(df, set_cols, aperture="aperture", path_col="path", p: QualityParams = DEFAULTS):
    return _compare(df, set_cols, path_col, {"aperture": _positive(aperture)}, [_aperture(aperture, p)])


def set_drift(
    df: DataFrame,
    set_cols: list[str],
    *,
    path_col="path",
    ev="ev",
    luma="luma_median",
    rg="wb_gain_rg",
    bg="wb_gain_bg",
    iso="iso",
    aperture="aperture",
    is_error=None,
    p: QualityParams = DEFAULTS,
) -> DataFrame:
    """All drift checks that are switched on; every median of the set comes from one pass and one join."""
    measures: dict[str, Column] = {}
    outputs = []
    if p.exposure_consistency:
        measures |= {"ev": _positive(ev), "luma": _positive(luma)}
        outputs.append(_exposure(ev, luma, p))
    if p.wb_consistency:
        measures |= _gain_measures(rg, bg, is_error, p)
        outputs.append(_white(rg, bg, p))
    if p.iso_consistency:
        measures["iso"] = _positive(iso)
        outputs.append(_iso(iso, p))
    if p.aperture_consistency:
        measures["aperture"] = _positive(aperture)
        outputs.append(_aperture(aperture, p))
    return _compare(df, set_cols, path_col, measures, outputs) if measures else df


def set_consistency(df: DataFrame, set_cols: list[str], *, path_col="path", hash_col="md5", **columns) -> DataFrame:
    """Duplicates and all drift checks (keyword columns as in `set_drift`)."""
    return set_drift(mark_duplicates(df, hash_col, path_col), set_cols, path_col=path_col, **columns)
