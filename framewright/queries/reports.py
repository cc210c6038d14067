"""Export, histogram, counts, filters and rankings (X1-X11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import report
from framewright.operators.reconcile import keep_reject_manifest
from framewright.queries.base import query, rounded, spread_scan, table
from framewright.queries.numbering import numbering_sql
from framewright.queries.scores import KEYS, RESULT_SQL, STATUS_SQL, labelled_results, result_rows
from framewright.queries.sets import CAPTURES_SQL, captures
from framewright.schemas import EXIF, QUALITY_DEFAULTS

# The export of lineitem as result rows: measures that no predicate sets keep their defaults.
EXPORT_DEFAULTS = {
    name: value
    for name, (source, factor, digits) in report.EXPORT_ROUNDED.items()
    for known, _, value in QUALITY_DEFAULTS
    if known == source
}


def _export_sql() -> str:
    given = {
        "filename": "printf('%d_%d.jpg', l_orderkey, l_linenumber)",
        "path": "printf('/sets/%s/%d_%d.jpg', l_returnflag, l_orderkey, l_linenumber)",
        "status": STATUS_SQL,
        "quality_score": "round_even(composite_score, 4)",
        "duplicate_of": "coalesce(duplicate_of, '')",
        "ev": "round_even(coalesce(ev, 0.0), 3)",
        "overlap_next": "coalesce(overlap_next, -1.0)",
        "mb_penalty": "round_even(mb_penalty, 4)",
        "load_backend": "'jvm'",
        "load_note": "''",
        "exif_make": "l_returnflag",
        "exif_model": "''",
        "exif_aperture": "CAST(l_quantity AS VARCHAR)",
        "exif_shutter": "coalesce(CAST(CASE WHEN l_tax > 0 THEN l_tax / CASE l_linenumber WHEN 1 THEN 80 WHEN 2 THEN 1000 ELSE 1 END END AS VARCHAR), '')",
        "exif_iso": "CAST(CAST(l_linenumber * 100 AS DOUBLE) AS VARCHAR)",
        "exif_focal_length": "''",
        "exif_datetime": "strftime(l_shipdate, '%Y:%m:%d')",
        "exif_gps": "CASE WHEN l_linenumber > 4 THEN concat(CAST(l_quantity AS VARCHAR), ', ', CAST(l_tax AS VARCHAR)) ELSE '' END",
        "file_size_mb": "round_even(l_partkey * 1000 / 1048576.0, 2)",
        "brightness": "round_even(l_quantity, 2)",
        "overlap_inlier_ratio": "0.0",
        "overlap_matches": "0",
        "width": "l_linenumber",
        "height": "CAST(l_quantity AS INTEGER)",
        "expo_dev": "0.0",
        "wb_dev": "0.0",
        "iso_dev_stops": "0.0",
        "aperture_dev_stops": "0.0",
    }
    out = []
    for name in report.EXPORT_COLUMNS:
        if name not in given and name in EXPORT_DEFAULTS:
            given[name] = f"CAST({EXPORT_DEFAULTS[name]} AS DOUBLE)"
        elif name in given and given[name] in ("0.0",):
            given[name] = "CAST(0.0 AS DOUBLE)"
        out.append(f"{given.get(name, name)} AS {name}")
    return ", ".join(out)


EXPORT_SQL = f"""
WITH {RESULT_SQL.replace('FROM lineitem)', ', l_returnflag, l_shipdate, l_quantity, l_tax, l_partkey, CASE WHEN l_tax > 0 THEN l_extendedprice / 100000 END AS ev, CASE WHEN l_linenumber < 3 THEN round_even(l_discount, 4) END AS overlap_next FROM lineitem)')}
SELECT {_export_sql()} FROM r
"""


def export_input(spark, sf):
    item = F.col
    rows = result_rows(spark, sf, extra=["l_returnflag", "l_shipdate", "l_quantity", "l_tax", "l_partkey", "l_extendedprice", "l_discount"])
    rows = spread_scan(rows, "l_orderkey")  # 67 wide columns are made of each row
    exif = F.struct(
        item("l_returnflag").alias("make"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("int").alias("orientation"),
        item("l_quantity").alias("aperture"),
        F.when(item("l_tax") > 0, item("l_tax") / F.when(item("l_linenumber") == 1, 80).when(item("l_linenumber") == 2, 1000).otherwise(1)).alias("shutter"),
        (item("l_linenumber") * 100).cast("double").alias("iso"),
        F.lit(None).cast("double").alias("focal_length"),
        F.date_format("l_shipdate", "yyyy:MM:dd").alias("datetime"),
        F.when(item("l_linenumber") > 4, F.struct(item("l_quantity").alias("lat"), item("l_tax").alias("lon"))).alias("gps"),
    ).cast(EXIF)
    return labelled_results(
        rows.withColumns(
            {
                "path": F.format_string("/sets/%s/%d_%d.jpg", "l_returnflag", "l_orderkey", "l_linenumber"),
                "exif": exif,
                "ev": F.when(item("l_tax") > 0, item("l_extendedprice") / 100000),
                "overlap_next": F.when(item("l_linenumber") < 3, item("l_discount")),
                "file_size": item("l_partkey") * 1000,
                "brightness": item("l_quantity"),
                "width": item("l_linenumber").cast("int"),
                "height": item("l_quantity").cast("int"),
            }
        )
    )


@query("x1_export_rows", EXPORT_SQL)
def x1(spark, sf):
    return report.export_rows(export_input(spark, sf))


HISTOGRAM_SQL = """
hist AS (
  SELECT b.bin, count(l_orderkey) AS n, CASE WHEN (b.bin + 0.5) / 60 < 0.5 - 0.15 THEN 'red' WHEN (b.bin + 0.5) / 60 > 0.5 + 0.15 THEN 'green' ELSE 'yellow' END AS band
  FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 60) t(i)) b
  LEFT JOIN (SELECT l_orderkey, CAST(least(59, floor(l_discount * 10 * 60)) AS INTEGER) AS bin FROM lineitem WHERE l_discount * 10 BETWEEN 0 AND 1 AND NOT (l_returnflag = 'R' AND l_linenumber = 1)) s ON s.bin = b.bin
  GROUP BY b.bin)
"""


@query("x2_score_histogram", f"WITH {HISTOGRAM_SQL} SELECT bin, n, band FROM hist")
def x2(spark, sf):
    return report.score_histogram(result_rows(spark, sf))


@query("x3_histogram_band", f"WITH {HISTOGRAM_SQL} SELECT band, count(*) AS bins, CAST(sum(n) AS BIGINT) AS images FROM hist GROUP BY band")
def x3(spark, sf):
    bins = report.score_histogram(result_rows(spark, sf))
    return bins.groupBy("band").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("images"))


@query(
    "x4_status_counts",
    f"""WITH {RESULT_SQL} SELECT count(*) FILTER (NOT is_error) AS total,
    count(*) FILTER (NOT is_error AND NOT is_blurry AND exposure_ok AND clipping_ok AND NOT low_features AND duplicate_of IS NULL AND NOT exposure_outlier
      AND NOT wb_outlier AND NOT low_dynamic_range AND NOT high_iso AND NOT aperture_outlier AND NOT soft_motion_blur) AS clean,
    count(*) FILTER (NOT is_error AND is_blurry) AS blurry, count(*) FILTER (NOT is_error AND NOT exposure_ok) AS exposure,
    count(*) FILTER (NOT is_error AND NOT clipping_ok) AS clipping, count(*) FILTER (NOT is_error AND low_features) AS few_features,
    count(*) FILTER (NOT is_error AND duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (NOT is_error AND exposure_outlier) AS expo_drift,
    count(*) FILTER (NOT is_error AND wb_outlier) AS wb_drift, count(*) FILTER (NOT is_error AND high_iso) AS high_iso,
    count(*) FILTER (NOT is_error AND soft_motion_blur) AS soft_motion, count(*) FILTER (is_error) AS errors FROM r""",
)
def x4(spark, sf):
    return report.status_counts(result_rows(spark, sf))


@query(
    "x5_threshold_filter",
    f"""WITH {RESULT_SQL} SELECT 'slider' AS mode, l_orderkey, l_linenumber FROM r WHERE composite_score >= 0.5
    UNION ALL SELECT 'all', l_orderkey, l_linenumber FROM r UNION ALL SELECT 'blurry', l_orderkey, l_linenumber FROM r WHERE is_blurry""",
)
def x5(spark, sf):
    rows = result_rows(spark, sf)
    shown = [
        report.threshold_filter(rows, mode, 0.5).select(F.lit(mode).alias("mode"), *KEYS) for mode in ("slider", "all", "blurry")
    ]
    return shown[0].unionAll(shown[1]).unionAll(shown[2])


@query("x6_range_select", f"WITH {RESULT_SQL} SELECT l_orderkey, l_linenumber, composite_score FROM r WHERE composite_score BETWEEN 0.2 AND 0.6")
def x6(spark, sf):
    return report.range_select(result_rows(spark, sf), 0.2, 0.6).select(*KEYS, "composite_score")


@query("x6_range_count", f"WITH {RESULT_SQL} SELECT count(*) AS selected FROM r WHERE composite_score BETWEEN 0.2 AND 0.6")
def x6_count(spark, sf):
    return report.range_count(result_rows(spark, sf), 0.2, 0.6)


@query("x7_rank_by_quality", "SELECT o_orderkey AS path, o_totalprice AS composite_score FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def x7(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("composite_score"))
    return report.rank_by_quality(rows)


@query("x7_best", "SELECT o_orderkey AS path, o_totalprice AS composite_score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def x7_best(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("composite_score"))
    return report.best(rows)


@query(
    "x8_overlap_report",
    f"""WITH {CAPTURES_SQL}, o AS (SELECT user_id, ts, event_id, CASE WHEN k % 10 <> 0 THEN (CAST(k AS BIGINT) * 7 % 145) / 144.0 END AS overlap,
      CAST(k AS BIGINT) AS matches, (CAST(k AS BIGINT) % 9) / 8.0 AS ratio FROM cap WHERE event_type <> 'error')
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal,
      CASE WHEN overlap IS NULL THEN 'n/a' WHEN floor(matches * ratio) < 8 THEN '?' ELSE printf('%.1f', overlap * 100) END AS overlap_text,
      CASE WHEN overlap IS NULL OR floor(matches * ratio) < 8 THEN NULL WHEN overlap < 0.30 THEN 'low' WHEN overlap > 0.90 THEN 'redundant' ELSE 'good' END AS overlap_class,
      CASE WHEN matches <> 0 THEN CAST(matches AS VARCHAR) ELSE '–' END AS matches_text,
      CASE WHEN ratio > 0 THEN printf('%.0f', ratio * 100) ELSE '–' END AS inlier_text FROM o""",
)
def x8(spark, sf):
    k = F.col("k").cast("bigint")
    rows = captures(spark, sf).select(
        "event_id",
        "user_id",
        "ts",
        (F.col("event_type") == "error").alias("is_error"),
        F.when(k % 10 != 0, (k * 7 % 145) / 144.0).alias("overlap_next"),
        k.alias("overlap_matches"),
        ((k % 9) / 8.0).alias("overlap_inlier_ratio"),
    )
    shown = report.overlap_report(rows, ["user_id"], ["ts", "event_id"])
    return shown.select("event_id", "ordinal", "overlap_text", "overlap_class", "matches_text", "inlier_text")


@query("x9_run_summary", f"WITH {RESULT_SQL} SELECT count(*) AS total, count(*) FILTER (is_blurry) AS blurry FROM r")
def x9(spark, sf):
    return report.run_summary(result_rows(spark, sf))


@query("x10_drop_vanished", "SELECT doc_id AS path, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def x10(spark, sf):
    """Results of all documents; a fresh listing finds the labelled ones."""
    results = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "n_chars")
    return report.drop_vanished(results, table(spark, sf, "labels").select(F.col("doc_id").alias("path")))


# Parts as selected photos, named by product: many ask for the same name, and the target folder
# already has some of these names.
PHOTOS_SQL = """
photos AS (SELECT p_partkey, printf('/shoot/%s/%06d/%s%s.jpg', p_brand, p_partkey, p_name,
    CASE p_partkey % 10 WHEN 0 THEN '_1' WHEN 1 THEN '_2' ELSE '' END) AS path FROM part),
kept AS (SELECT DISTINCT '/keep' AS folder, p_name || CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN '_3' ELSE '_5' END AS stem, '.JPG' AS suffix FROM part WHERE p_size % 10 < 3)
"""


def photos(spark, sf):
    tail = F.when(F.col("p_partkey") % 10 == 0, "_1").when(F.col("p_partkey") % 10 == 1, "_2").otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey", F.format_string("/shoot/%s/%06d/%s%s.jpg", F.col("p_brand"), F.col("p_partkey"), F.col("p_name"), tail).alias("path")
    )


def kept_listing(spark, sf):
    tail = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 10 == 1, "_3").otherwise("_5")
    names_there = table(spark, sf, "part").filter(F.col("p_size") % 10 < 3)
    return names_there.select(F.lit("/keep").alias("folder"), F.concat("p_name", tail).alias("stem"), F.lit(".JPG").alias("suffix")).distinct()


@query(
    "x11_keep_reject_manifest",
    f"""WITH {PHOTOS_SQL}, req AS (SELECT path, '/keep' AS folder, regexp_extract(path, '([^/]*)\\.jpg$', 1) AS stem, '.jpg' AS suffix FROM photos),
    {numbering_sql('req', 'kept', 'path')}
    SELECT path, folder || '/' || stem || CASE WHEN number > 0 THEN '_' || number ELSE '' END || suffix AS target_path FROM numbered""",
)
def x11(spark, sf):
    return keep_reject_manifest(photos(spark, sf).select("path"), "/keep", kept_listing(spark, sf))


@query(
    "v6_collision_number",
    f"""WITH {PHOTOS_SQL}, req AS (SELECT p_partkey, path, '/keep' AS folder, regexp_extract(path, '([^/]*)\\.jpg$', 1) AS stem, '.jpg' AS suffix FROM photos),
    {numbering_sql('req', 'kept', 'path')}
    SELECT p_partkey, stem, number FROM numbered""",
)
def v6(spark, sf):
    from framewright.operators.reconcile import collision_number

    request = photos(spark, sf).withColumns({"folder": F.lit("/keep"), "stem": names.stem("path"), "suffix": names.suffix("path")})
    return collision_number(request, kept_listing(spark, sf), ["path"]).select("p_partkey", "stem", "number")
