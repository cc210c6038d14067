"""Scores and flags (C1-C17) over `embeddings` as block grids and `lineitem` as measured rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import scoring as sc
from framewright.plans.quality import quality_rows
from framewright.queries.base import query, rounded, table
from framewright.queries.rasters import embedding_rasters
from framewright.schemas import with_error_defaults, with_missing_defaults

def blocks():
    return F.transform("embedding", lambda x: F.abs(x.cast("double")) * 1000)


# Embedding as an 8 x 8 grid of block variances; the longest side grows with the label.
GRID_SQL = """
grid AS (
  SELECT vec_id, label, 512 * (1 + label % 8) AS longest,
         list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 1000) AS blocks
  FROM embeddings),
top AS (
  SELECT *, list_avg(list_reverse_sort(blocks)[1:CAST(least(len(blocks), greatest(2, round_even(len(blocks) * 0.1, 0))) AS INTEGER)]) AS topk
  FROM grid),
peaks AS (
  SELECT *, topk * power(greatest(1.0, 2048.0 / longest), 2) AS peak FROM top)
"""
LOG_SCORE_SQL = """greatest(0.0, least(1.0, (log10(greatest(peak, 1e-6)) - log10(30.0)) / (log10(600.0) - log10(30.0))))"""


def grid(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", (512 * (1 + F.col("label") % 8)).alias("longest"), blocks().alias("blocks")
    )


@query("c1_topk_mean", f"WITH {GRID_SQL} SELECT vec_id, round(topk, 6) AS topk FROM peaks")
def c1(spark, sf):
    return grid(spark, sf).select("vec_id", rounded(sc.topk_mean("blocks", 0.10)).alias("topk"))


@query("c2_resolution_normalise", f"WITH {GRID_SQL} SELECT vec_id, longest, round(peak, 5) AS peak FROM peaks")
def c2(spark, sf):
    return grid(spark, sf).select("vec_id", "longest", rounded(sc.peak_sharpness("blocks", "longest"), 5).alias("peak"))


@query("c3_log_score", f"WITH {GRID_SQL} SELECT vec_id, round({LOG_SCORE_SQL}, 6) AS score FROM peaks")
def c3(spark, sf):
    peaks = grid(spark, sf).select("vec_id", sc.peak_sharpness("blocks", "longest").alias("peak"))
    return peaks.select("vec_id", rounded(sc.log_score("peak")).alias("score"))


@query("c4_sharpness_spread", f"WITH {GRID_SQL} SELECT vec_id, round(least(1.0, list_avg(blocks) / topk), 6) AS spread FROM peaks")
def c4(spark, sf):
    return grid(spark, sf).select("vec_id", rounded(sc.sharpness_spread("blocks")).alias("spread"))


# lineitem as measured rows: every measure is a scaled column.
KEYS = ["l_orderkey", "l_linenumber"]
MEASURED_SQL = """
m AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS score, l_quantity AS noise, l_tax * 3 AS delta, l_quantity / 100 AS lag FROM lineitem),
f AS (SELECT *, CASE WHEN score > 0 THEN
        greatest(0.0, least(1.0, (delta - 0.15) / (0.20 - 0.15))) * greatest(0.0, least(1.0, (lag - 0.21) / (0.10 - 0.21)))
      ELSE 0.0 END AS evidence FROM m),
p AS (SELECT *, CASE WHEN evidence > 0 THEN greatest(0.0, score * (1.0 - evidence * 0.95)) ELSE score END AS penalised FROM f)
"""


def measured(spark, sf):
    return table(spark, sf, "lineitem").select(
        *KEYS,
        (F.col("l_discount") * 10).alias("score"),
        F.col("l_quantity").alias("noise"),
        (F.col("l_tax") * 3).alias("delta"),
        (F.col("l_quantity") / 100).alias("lag"),
    )


def judged(spark, sf):
    rows = measured(spark, sf).withColumn("evidence", sc.motion_evidence("score", "delta", "lag"))
    return rows.withColumn("penalised", sc.motion_penalised("score", "evidence"))


@query(
    "c5_noise_penalty",
    f"WITH {MEASURED_SQL} SELECT l_orderkey, l_linenumber, round(score * (1.0 - 0.15 * greatest(0.0, least(1.0, noise / 25.0))), 6) AS score FROM m",
)
def c5(spark, sf):
    return measured(spark, sf).select(*KEYS, rounded(sc.noise_penalised("score", "noise")).alias("score"))


@query(
    "c6_motion_penalty",
    f"WITH {MEASURED_SQL} SELECT l_orderkey, l_linenumber, round(evidence, 6) AS evidence, round(penalised, 6) AS penalised FROM p",
)
def c6(spark, sf):
    return judged(spark, sf).select(*KEYS, rounded("evidence").alias("evidence"), rounded("penalised").alias("penalised"))


@query(
    "c7_soft_motion",
    f"WITH {MEASURED_SQL} SELECT l_orderkey, l_linenumber, evidence >= 0.20 AND penalised >= 0.5 AS soft FROM p",
)
def c7(spark, sf):
    return judged(spark, sf).select(*KEYS, sc.soft_motion("penalised", "evidence").alias("soft"))


@query(
    "c8_final_score",
    f"""WITH {MEASURED_SQL} SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, penalised)), 6) AS final,
    penalised < 0.5 AS blurry FROM p""",
)
def c8(spark, sf):
    rows = judged(spark, sf).withColumn("final", sc.final_score("penalised"))
    return rows.select(*KEYS, rounded("final").alias("final"), sc.is_blurry("final").alias("blurry"))


@query(
    "c9_exposure_ok",
    """SELECT l_orderkey, l_linenumber, l_quantity >= 18 AND l_extendedprice % 256 >= 22 AND l_extendedprice % 256 <= 232 AS ok FROM lineitem""",
)
def c9(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, sc.exposure_ok(F.col("l_extendedprice") % 256, "l_quantity").alias("ok"))


@query(
    "c10_feature_flags",
    """SELECT l_orderkey, l_linenumber, l_quantity / 10 < 2.0 AS low, l_tax < 0.05 AND l_quantity / 10 >= 2.0 AS uneven,
    l_discount * 10 < 0.5 AS vignetted FROM lineitem""",
)
def c10(spark, sf):
    density = F.col("l_quantity") / 10
    return table(spark, sf, "lineitem").select(
        *KEYS,
        sc.low_features(density).alias("low"),
        sc.uneven_features(density, "l_tax").alias("uneven"),
        sc.has_vignetting(F.col("l_discount") * 10).alias("vignetted"),
    )


@query("c11_clipping_ok", "SELECT l_orderkey, l_linenumber, l_discount / 2 <= 0.02 AND l_tax * 5 <= 0.25 AS ok FROM lineitem")
def c11(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, sc.clipping_ok(F.col("l_discount") / 2, F.col("l_tax") * 5).alias("ok"))


@query("c12_low_dynamic_range", "SELECT l_orderkey, l_linenumber, l_quantity * 2 < 55.0 AS flat FROM lineitem")
def c12(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, sc.low_dynamic_range(F.col("l_quantity") * 2).alias("flat"))


@query(
    "c13_ev100",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 AND l_extendedprice > 0
    THEN round(log2((l_quantity * l_quantity) / (l_discount / 10 * (l_extendedprice / 10 / 100.0))), 6) END AS ev FROM lineitem""",
)
def c13(spark, sf):
    ev = sc.ev100("l_quantity", F.col("l_discount") / 10, F.col("l_extendedprice") / 10)
    return table(spark, sf, "lineitem").select(*KEYS, rounded(ev).alias("ev"))


@query(
    "c14_slow_shutter",
    """SELECT l_orderkey, l_linenumber, l_discount > 0 AND l_quantity > 0 AND l_discount > 1.0 / l_quantity AS slow FROM lineitem""",
)
def c14(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, sc.slow_shutter("l_discount", "l_quantity").alias("slow"))


# lineitem as full result rows: flags come from predicates on its columns.
RESULT_SQL = """
r AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS composite_score, l_returnflag = 'R' AND l_linenumber = 1 AS is_error,
    l_discount * 10 < 0.5 AS is_blurry, CASE WHEN l_quantity > 40 THEN l_tax ELSE 0.0 END AS mb_penalty,
    l_quantity BETWEEN 10 AND 20 AS soft_motion_blur, l_tax < 0.07 AS exposure_ok, l_quantity < 45 AS clipping_ok,
    l_linenumber = 2 AS low_features, l_linenumber = 3 AS uneven_features, l_linenumber = 4 AS has_vignetting,
    CASE WHEN l_suppkey % 9 = 0 THEN 'copy' END AS duplicate_of, l_extendedprice > 50000 AS exposure_outlier,
    l_partkey % 11 = 0 AS wb_outlier, l_partkey % 13 = 0 AS low_dynamic_range, l_suppkey % 7 = 0 AS high_iso,
    l_linestatus = 'O' AS aperture_outlier, l_quantity > 25 AS slow_shutter
  FROM lineitem)
"""


def result_rows(spark, sf, extra=()):
    q = F.col
    return table(spark, sf, "lineitem").select(
        *KEYS,
        *extra,
        (q("l_discount") * 10).alias("composite_score"),
        ((q("l_returnflag") == "R") & (q("l_linenumber") == 1)).alias("is_error"),
        sc.is_blurry(q("l_discount") * 10).alias("is_blurry"),
        F.when(q("l_quantity") > 40, q("l_tax")).otherwise(0.0).alias("mb_penalty"),
        q("l_quantity").between(10, 20).alias("soft_motion_blur"),
        (q("l_tax") < 0.07).alias("exposure_ok"),
        (q("l_quantity") < 45).alias("clipping_ok"),
        (q("l_linenumber") == 2).alias("low_features"),
        (q("l_linenumber") == 3).alias("uneven_features"),
        (q("l_linenumber") == 4).alias("has_vignetting"),
        F.when(q("l_suppkey") % 9 == 0, "copy").alias("duplicate_of"),
        (q("l_extendedprice") > 50000).alias("exposure_outlier"),
        (q("l_partkey") % 11 == 0).alias("wb_outlier"),
        (q("l_partkey") % 13 == 0).alias("low_dynamic_range"),
        (q("l_suppkey") % 7 == 0).alias("high_iso"),
        (q("l_linestatus") == "O").alias("aperture_outlier"),
        (q("l_quantity") > 25).alias("slow_shutter"),
    )


STATUS_SQL = """
CASE WHEN is_error THEN '⚫ Error' ELSE coalesce(
  CASE WHEN is_blurry THEN '🔴 ' ELSE '🟡 ' END || nullif(concat_ws(' + ',
    CASE WHEN is_blurry AND mb_penalty > 0 THEN 'Blurry (Motion)' WHEN is_blurry THEN 'Blurry' END,
    CASE WHEN soft_motion_blur AND NOT is_blurry THEN 'Soft (Motion)' END,
    CASE WHEN NOT exposure_ok THEN 'Exposure' END, CASE WHEN NOT clipping_ok THEN 'Clipping' END,
    CASE WHEN low_features THEN 'Few Features' END, CASE WHEN uneven_features THEN 'Uneven Features' END,
    CASE WHEN has_vignetting THEN 'Vignetting' END, CASE WHEN duplicate_of IS NOT NULL THEN 'Duplicate' END,
    CASE WHEN exposure_outlier THEN 'Expo drift' END, CASE WHEN wb_outlier THEN 'WB drift' END,
    CASE WHEN low_dynamic_range THEN 'Flat' END, CASE WHEN high_iso THEN 'Hi-ISO' END,
    CASE WHEN aperture_outlier THEN 'Aperture drift' END), '')
  || CASE WHEN is_blurry AND slow_shutter THEN ' · slow shutter' ELSE '' END, '🟢 Sharp') END
"""


@query("c15_status_label", f"WITH {RESULT_SQL} SELECT l_orderkey, l_linenumber, {STATUS_SQL} AS status FROM r")
def c15(spark, sf):
    return result_rows(spark, sf).select(*KEYS, sc.status_label().alias("status"))


@query(
    "c16_error_defaults",
    """WITH e AS (SELECT *, l_returnflag = 'R' AS is_error FROM lineitem)
    SELECT l_orderkey, l_linenumber, is_error, CASE WHEN is_error THEN 0.0 ELSE l_quantity END AS brightness,
    CASE WHEN is_error THEN 1.0 ELSE l_tax END AS mb_lag_aniso, CASE WHEN is_error THEN true ELSE l_discount < 0.05 END AS is_blurry,
    CASE WHEN is_error THEN false ELSE true END AS exposure_ok, CASE WHEN is_error THEN 1.0 ELSE l_discount END AS vignetting,
    CASE WHEN is_error THEN NULL ELSE l_extendedprice END AS ev, CASE WHEN is_error THEN true ELSE l_tax < 0.03 END AS clipping_ok,
    md5(l_shipdate::DATE::VARCHAR) AS md5 FROM e""",
)
def c16(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        *KEYS,
        (F.col("l_returnflag") == "R").alias("is_error"),
        F.col("l_quantity").alias("brightness"),
        F.col("l_tax").alias("mb_lag_aniso"),
        (F.col("l_discount") < 0.05).alias("is_blurry"),
        F.lit(True).alias("exposure_ok"),
        F.col("l_discount").alias("vignetting"),
        F.col("l_extendedprice").alias("ev"),
        (F.col("l_tax") < 0.03).alias("clipping_ok"),
        F.md5(F.date_format("l_shipdate", "yyyy-MM-dd").cast("binary")).alias("md5"),
    )
    return with_error_defaults(rows)


@query("c17_quality_row")
def c17(spark, sf):
    """The whole row of every embedding as a raster; its parts are checked one by one under p* and c*."""
    return quality_rows(embedding_rasters(spark, sf), ["path"]).drop("exif")


def labelled_results(rows):
    """Complete rows that carry only some of the result columns."""
    return with_missing_defaults(rows)
