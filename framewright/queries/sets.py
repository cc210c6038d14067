"""Set comparison and overlap (G1-G16), mostly over `events` as capture sequences, and the flagship run."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.config import QualityParams
from framewright.functions import scoring as sc
from framewright.operators import consistency, overlap
from framewright.queries.base import query, rounded, spread_scan, table
from framewright.queries.rasters import page_rasters
from framewright.queries.scores import LOG_SCORE_SQL, STATUS_SQL, blocks
from framewright.schemas import with_missing_defaults


@query(
    "g1_mark_duplicates",
    """WITH d AS (SELECT doc_id, printf('/docs/%s/%08d', source, doc_id) AS path, CASE WHEN n_chars % 10 = 0 THEN '' ELSE md5(text) END AS md5 FROM documents),
    f AS (SELECT md5, min(path) AS first_path FROM d WHERE md5 <> '' GROUP BY md5)
    SELECT doc_id, d.path, CASE WHEN d.path <> first_path THEN first_path END AS duplicate_of FROM d LEFT JOIN f ON d.md5 = f.md5""",
)
def g1(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.format_string("/docs/%s/%08d", "source", "doc_id").alias("path"),
        F.when(F.col("n_chars") % 10 == 0, "").otherwise(F.md5(F.col("text").cast("binary"))).alias("md5"),
    )
    return consistency.mark_duplicates(docs).select("doc_id", "path", "duplicate_of")


# events as captured images: the set is the event type, values come from `value` and props.k.
CAPTURES_SQL = """
cap AS (
  SELECT event_id, event_type, user_id, ts, printf('/cap/%08d', event_id) AS path, value * 2 AS luma,
    CASE WHEN event_type IN ('error', 'click') THEN k / 10.0 - 1.0 END AS ev, CASE WHEN k % 5 <> 0 THEN k * 50.0 END AS iso,
    1.0 + k / 20.0 AS aperture, 0.5 + k / 100.0 AS rg, 0.8 + value / 100.0 AS bg, md5(concat(user_id, '-', CAST(k AS BIGINT))) AS md5, k
  FROM (SELECT *, CAST(props ->> '$.k' AS DOUBLE) AS k FROM events))
"""


def captures(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    k = F.col("k")
    return events.select(
        "event_id",
        "event_type",
        "user_id",
        "ts",
        F.format_string("/cap/%08d", "event_id").alias("path"),
        (F.col("value") * 2).alias("luma"),
        F.when(F.col("event_type").isin("error", "click"), k / 10.0 - 1.0).alias("ev"),
        F.when(k % 5 != 0, k * 50.0).alias("iso"),
        (1.0 + k / 20.0).alias("aperture"),
        (0.5 + k / 100.0).alias("rg"),
        (0.8 + F.col("value") / 100.0).alias("bg"),
        F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-"), k.cast("bigint").cast("string")).cast("binary")).alias("md5"),
        "k",
    )


@query(
    "g2_robust_median",
    f"""WITH {CAPTURES_SQL} SELECT event_type, round(coalesce(median(luma), 0.0), 6) AS median_luma, count(luma) AS n_luma,
    round(coalesce(median(iso), 0.0), 6) AS median_iso, count(iso) AS n_iso FROM cap GROUP BY event_type""",
)
def g2(spark, sf):
    found = consistency.set_medians(captures(spark, sf), ["event_type"], {"luma": F.col("luma"), "iso": F.col("iso")})
    return found.select(
        "event_type",
        rounded(F.coalesce("luma", F.lit(0.0))).alias("median_luma"),
        "n_luma",
        rounded(F.coalesce("iso", F.lit(0.0))).alias("median_iso"),
        "n_iso",
    )


MEDIANS_SQL = (
    CAPTURES_SQL
    + """,
med AS (
  SELECT event_type, median(ev) FILTER (ev > 0) AS m_ev, count(*) FILTER (ev > 0) AS n_ev, median(luma) FILTER (luma > 0) AS m_luma,
    count(*) FILTER (luma > 0) AS n_luma, median(rg) AS m_rg, median(bg) AS m_bg, count(*) AS n,
    median(iso) FILTER (iso > 0) AS m_iso, count(*) FILTER (iso > 0) AS n_iso,
    median(aperture) FILTER (aperture > 0) AS m_ap, count(*) FILTER (aperture > 0) AS n_ap
  FROM cap GROUP BY event_type),
dev AS (
  SELECT cap.*,
    CASE WHEN n_ev >= 3 THEN CASE WHEN ev > 0 THEN ev - m_ev ELSE 0.0 END
         WHEN n_luma >= 3 AND m_luma > 0 AND luma > 0 THEN (luma - m_luma) / m_luma ELSE 0.0 END AS expo_dev,
    CASE WHEN n_ev >= 3 THEN 0.5 ELSE 0.25 END AS expo_limit,
    CASE WHEN n >= 3 THEN sqrt(power(rg - m_rg, 2) + power(bg - m_bg, 2)) ELSE 0.0 END AS wb_dev,
    CASE WHEN n_iso >= 3 AND iso > 0 THEN log2(iso / m_iso) ELSE 0.0 END AS iso_dev_stops,
    CASE WHEN n_ap >= 3 AND aperture > 0 THEN log2(aperture / m_ap) ELSE 0.0 END AS aperture_dev_stops
  FROM cap JOIN med USING (event_type))
"""
)


@query(
    "g3_exposure_drift",
    f"WITH {MEDIANS_SQL} SELECT event_id, round(expo_dev, 6) AS expo_dev, abs(expo_dev) > expo_limit AS exposure_outlier FROM dev",
)
def g3(spark, sf):
    rows = consistency.exposure_drift(captures(spark, sf), ["event_type"], luma="luma")
    return rows.select("event_id", rounded("expo_dev").alias("expo_dev"), "exposure_outlier")


@query("g4_wb_drift", f"WITH {MEDIANS_SQL} SELECT event_id, round(wb_dev, 6) AS wb_dev, wb_dev > 0.15 AS wb_outlier FROM dev")
def g4(spark, sf):
    rows = consistency.wb_drift(captures(spark, sf), ["event_type"], rg="rg", bg="bg")
    return rows.select("event_id", rounded("wb_dev").alias("wb_dev"), "wb_outlier")


@query("g5_iso_drift", f"WITH {MEDIANS_SQL} SELECT event_id, round(iso_dev_stops, 6) AS iso_dev_stops, iso_dev_stops > 2.0 AS high_iso FROM dev")
def g5(spark, sf):
    rows = consistency.iso_drift(captures(spark, sf), ["event_type"])
    return rows.select("event_id", rounded("iso_dev_stops").alias("iso_dev_stops"), "high_iso")


@query(
    "g6_aperture_drift",
    f"""WITH {MEDIANS_SQL} SELECT event_id, round(aperture_dev_stops, 6) AS aperture_dev_stops, abs(aperture_dev_stops) > 0.5 AS aperture_outlier FROM dev""",
)
def g6(spark, sf):
    rows = consistency.aperture_drift(captures(spark, sf), ["event_type"])
    return rows.select("event_id", rounded("aperture_dev_stops").alias("aperture_dev_stops"), "aperture_outlier")


@query(
    "g7_set_consistency",
    f"""WITH {MEDIANS_SQL}, f AS (SELECT md5, min(path) AS first_path FROM cap GROUP BY md5)
    SELECT event_id, CASE WHEN path <> first_path THEN first_path END AS duplicate_of,
      round(expo_dev, 6) AS expo_dev, abs(expo_dev) > expo_limit AS exposure_outlier, round(wb_dev, 6) AS wb_dev, wb_dev > 0.15 AS wb_outlier,
      round(iso_dev_stops, 6) AS iso_dev_stops, iso_dev_stops > 2.0 AS high_iso,
      round(aperture_dev_stops, 6) AS aperture_dev_stops, abs(aperture_dev_stops) > 0.5 AS aperture_outlier
    FROM dev JOIN f USING (md5)""",
)
def g7(spark, sf):
    rows = consistency.set_consistency(captures(spark, sf), ["event_type"], luma="luma", rg="rg", bg="bg")
    devs = ("expo_dev", "wb_dev", "iso_dev_stops", "aperture_dev_stops")
    return rows.select(
        "event_id",
        "duplicate_of",
        *[rounded(d).alias(d) for d in devs],
        "exposure_outlier",
        "wb_outlier",
        "high_iso",
        "aperture_outlier",
    )


@query(
    "g8_sequence_pairs",
    f"""WITH {CAPTURES_SQL}, s AS (SELECT user_id, path, lead(path) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_path FROM cap WHERE event_type <> 'error')
    SELECT user_id, path, next_path FROM s WHERE next_path IS NOT NULL""",
)
def g8(spark, sf):
    rows = captures(spark, sf).withColumn("is_error", F.col("event_type") == "error")
    return overlap.sequence_pairs(rows, ["user_id"], ["ts", "event_id"], is_error="is_error").select("user_id", "path", "next_path")


@query(
    "g8_single_sequence",
    f"""WITH {CAPTURES_SQL}, s AS (SELECT path, lead(path) OVER (ORDER BY path) AS next_path FROM cap)
    SELECT path, next_path FROM s WHERE next_path IS NOT NULL""",
)
def g8_single(spark, sf):
    """All captures as one set: the successor window is split by ranges of the path."""
    return overlap.sequence_pairs(captures(spark, sf), [], ["path"]).select("path", "next_path")


@query("g9_detect_keypoints")
def g9(spark, sf):
    """Keypoints of whole pages as rasters."""
    found = overlap.keypoint_table(overlap.detect_keypoints(page_rasters(spark, sf)))
    return found.select("path", "kp_id", "x", "y", F.octet_length("descriptor").alias("dimensions"))


# 50 neighbouring embeddings stand for the keypoints of one image, consecutive images for pairs.
@query(
    "g10_ratio_match",
    """WITH e AS (SELECT vec_id, vec_id // 50 AS image, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    d AS (SELECT a.image AS path, b.image AS next_path, a.vec_id AS kp_id, b.vec_id AS next_kp_id, list_distance(a.v, b.v) AS distance
      FROM e a JOIN e b ON b.image = a.image + 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY distance, next_kp_id) AS rank, lead(distance) OVER (PARTITION BY kp_id ORDER BY distance, next_kp_id) AS second FROM d)
    SELECT path, next_path, kp_id, next_kp_id, round(distance, 6) AS distance FROM r WHERE rank = 1 AND distance < 0.9 * second""",
)
def g10(spark, sf):
    keypoints = spread_scan(table(spark, sf, "embeddings"), "vec_id").select(
        F.floor(F.col("vec_id") / 50).alias("path"), F.col("vec_id").alias("kp_id"), F.col("embedding").alias("descriptor")
    )
    images = keypoints.select("path").distinct()
    pairs = images.select("path", (F.col("path") + 1).alias("next_path"))
    found = overlap.ratio_match(pairs, keypoints, ratio=0.9)
    return found.select("path", "next_path", "kp_id", "next_kp_id", rounded("distance").alias("distance"))


# 32 points per embedding, moved by a known homography; every eighth point is displaced far away.
@query(
    "g11_estimate_homography",
    """SELECT vec_id AS path, vec_id + 1 AS next_path, 32 AS matches, 28 AS inliers_a, 28 AS inliers_b,
    CAST(1.0 + label * 0.01 AS DOUBLE) AS scale, CAST(10.0 + vec_id % 17 AS DOUBLE) AS shift_x, CAST(5.0 - label AS DOUBLE) AS shift_y FROM embeddings""",
)
def g11(spark, sf):
    vectors = spread_scan(table(spark, sf, "embeddings"), "vec_id", 2000)
    points = vectors.select(
        F.col("vec_id").alias("path"),
        (F.col("vec_id") + 1).alias("next_path"),
        (1.0 + F.col("label") * 0.01).alias("scale"),
        (10.0 + F.col("vec_id") % 17).alias("shift_x"),
        (5.0 - F.col("label")).alias("shift_y"),
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
                (F.element_at("embedding", i * 2 + 1).cast("double") * 1000).alias("x"),
                (F.element_at("embedding", i * 2 + 2).cast("double") * 1000).alias("y"),
            ))
        ).alias("i", "p"),
    )
    stray = F.when(F.col("i") % 8 == 0, 400.0 + 37.0 * F.col("i")).otherwise(0.0)
    matches = points.select(
        "path",
        "next_path",
        F.col("p.x").alias("x1"),
        F.col("p.y").alias("y1"),
        (F.col("p.x") * F.col("scale") + F.col("shift_x") + stray).alias("x2"),
        (F.col("p.y") * F.col("scale") + F.col("shift_y") - stray * 2).alias("y2"),
    )
    found = overlap.estimate_homographies(matches)
    h = lambda i: F.element_at("h_b", i)
    return found.select(
        "path",
        "next_path",
        "matches",
        "inliers_a",
        "inliers_b",
        rounded(h(1), 3).alias("scale"),
        rounded(h(3), 2).alias("shift_x"),
        rounded(h(6), 2).alias("shift_y"),
    )


HOMOGRAPHY_SQL = """
h AS (SELECT o_orderkey, 0.8 + (o_custkey % 40) / 100.0 AS m0, (o_orderkey % 7) / 50.0 AS m1, CAST(o_custkey % 300 AS DOUBLE) AS m2,
  (o_orderkey % 5) / 60.0 AS m3, 0.9 + (o_orderkey % 20) / 100.0 AS m4, -CAST(o_custkey % 200 AS DOUBLE) AS m5,
  (o_orderkey % 3) / 100000.0 AS m6, (o_custkey % 4) / 100000.0 AS m7, 1.0 AS m8 FROM orders),
pts AS (SELECT h.*, (i % 12) * (640 / 12.0) AS x, (i // 12) * (480 / 12.0) AS y FROM h, range(0, 144) t(i)),
warped AS (SELECT o_orderkey, (m0 * x + m1 * y + m2) / (m6 * x + m7 * y + m8) AS u, (m3 * x + m4 * y + m5) / (m6 * x + m7 * y + m8) AS v FROM pts)
"""


@query(
    "g12_grid_overlap",
    f"""WITH {HOMOGRAPHY_SQL} SELECT o_orderkey, round(count_if(u BETWEEN 0 AND 800 AND v BETWEEN 0 AND 600) / 144.0, 6) AS overlap
    FROM warped GROUP BY o_orderkey""",
)
def g12(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    h = F.array(
        0.8 + (c % 40) / 100.0, (o % 7) / 50.0, (c % 300).cast("double"),
        (o % 5) / 60.0, 0.9 + (o % 20) / 100.0, -(c % 200).cast("double"),
        (o % 3) / 100000.0, (c % 4) / 100000.0, F.lit(1.0),
    )
    rows = spread_scan(table(spark, sf, "orders"), "o_orderkey").select(
        "o_orderkey", h.alias("h"), F.lit(640).alias("w1"), F.lit(480).alias("h1"), F.lit(800).alias("w2"), F.lit(600).alias("h2")
    )
    return rows.select("o_orderkey", rounded(overlap.grid_overlap("h", "w1", "h1", "w2", "h2")).alias("overlap"))


DIRECTIONS_SQL = """
dirs AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS overlap_a, l_tax * 12 AS overlap_b, CAST(l_quantity AS BIGINT) % 13 AS inliers_a, l_partkey % 13 AS inliers_b,
  CAST(l_quantity AS BIGINT) AS matches FROM lineitem),
chosen AS (
  SELECT *, CASE WHEN inliers_a >= 8 AND inliers_b >= 8 THEN greatest(overlap_a, overlap_b)
      WHEN inliers_a >= inliers_b THEN CASE WHEN inliers_a >= 4 THEN overlap_a ELSE 0.0 END
      ELSE CASE WHEN inliers_b >= 4 THEN overlap_b ELSE 0.0 END END AS overlap, greatest(inliers_a, inliers_b) AS inliers FROM dirs)
"""


def directions(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 10).alias("overlap_a"),
        (F.col("l_tax") * 12).alias("overlap_b"),
        (F.col("l_quantity").cast("bigint") % 13).alias("inliers_a"),
        (F.col("l_partkey") % 13).alias("inliers_b"),
        F.col("l_quantity").cast("bigint").alias("matches"),
    )


def chosen(spark, sf):
    share, inliers = overlap.choose_overlap()
    return directions(spark, sf).withColumns({"overlap": share, "inliers": inliers})


@query("g13_choose_overlap", f"WITH {DIRECTIONS_SQL} SELECT l_orderkey, l_linenumber, round(overlap, 6) AS overlap, inliers FROM chosen")
def g13(spark, sf):
    return chosen(spark, sf).select("l_orderkey", "l_linenumber", rounded("overlap").alias("overlap"), "inliers")


@query(
    "g14_overlap_gate",
    f"""WITH {DIRECTIONS_SQL} SELECT l_orderkey, l_linenumber, round(CASE WHEN inliers < 8 THEN 0.0 ELSE least(1.0, overlap) END, 6) AS overlap_next,
    round(CASE WHEN matches > 0 THEN inliers / matches ELSE 0.0 END, 6) AS inlier_ratio FROM chosen""",
)
def g14(spark, sf):
    share, ratio = overlap.overlap_gate("overlap", "matches", "inliers")
    return chosen(spark, sf).select("l_orderkey", "l_linenumber", rounded(share).alias("overlap_next"), rounded(ratio).alias("inlier_ratio"))


@query(
    "g15_overlap_fallback",
    """WITH a AS (SELECT o_orderkey, o_totalprice % 1 AS overlap, o_custkey % 40 AS matches, o_custkey % 11 AS inliers FROM orders),
    b AS (SELECT o_orderkey, (o_totalprice + 0.25) % 1 AS overlap, o_orderkey % 25 AS matches, o_orderkey % 12 AS inliers FROM orders
      WHERE o_custkey % 40 < 20 AND o_orderkey % 3 > 0)
    SELECT a.o_orderkey, round(CASE WHEN b.inliers > a.inliers THEN b.overlap ELSE a.overlap END, 6) AS overlap,
      CASE WHEN b.inliers > a.inliers THEN b.matches ELSE a.matches END AS matches,
      CASE WHEN b.inliers > a.inliers THEN b.inliers ELSE a.inliers END AS inliers FROM a LEFT JOIN b USING (o_orderkey)""",
)
def g15(spark, sf):
    """Weak pairs (under 20 matches) have a second result, but not all of them."""
    orders = table(spark, sf, "orders")
    row = lambda share, matches, inliers: ["o_orderkey", share.alias("overlap"), matches.alias("matches"), inliers.alias("inliers")]
    c, o, price = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")
    first = orders.select(*row(price % 1, c % 40, c % 11))
    second = orders.filter((c % 40 < 20) & (o % 3 > 0)).select(*row((price + 0.25) % 1, o % 25, o % 12))
    best = overlap.overlap_fallback(first, second, ["o_orderkey"])
    return best.select("o_orderkey", rounded("overlap").alias("overlap"), "matches", "inliers")


@query("g16_pair_overlap")
def g16(spark, sf):
    """Consecutive pages as image pairs: keypoints, matches, homographies, fallback and gate."""
    rasters = page_rasters(spark, sf)
    pairs = overlap.sequence_pairs(rasters.select("path"), [], ["path"])
    found = overlap.pair_overlap(pairs, rasters)
    return found.select(
        "path", "next_path", rounded("overlap_next").alias("overlap_next"), "overlap_matches", rounded("overlap_inlier_ratio").alias("inlier_ratio")
    )


# ---- flagship: block grids -> score -> drift of the set -> label -> counts ----------------------

LABEL_RUN_SQL = f"""
WITH grid AS (
  SELECT vec_id, label, 2048 AS longest, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 1000) AS blocks,
    1.0 + CAST(embedding[1] AS DOUBLE) AS rg, 1.0 + CAST(embedding[2] AS DOUBLE) AS bg, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) * 255)) AS luma FROM embeddings),
top AS (SELECT *, list_avg(list_reverse_sort(blocks)[1:6]) AS peak FROM grid),
scored AS (SELECT *, {LOG_SCORE_SQL} AS composite_score FROM top),
med AS (SELECT label, median(luma) FILTER (luma > 0) AS m_luma, count(*) FILTER (luma > 0) AS n_luma, median(rg) AS m_rg, median(bg) AS m_bg, count(*) AS n FROM scored GROUP BY label),
dev AS (SELECT scored.*, CASE WHEN n_luma >= 3 AND m_luma > 0 AND luma > 0 THEN (luma - m_luma) / m_luma ELSE 0.0 END AS expo_dev,
    CASE WHEN n >= 3 THEN sqrt(power(rg - m_rg, 2) + power(bg - m_bg, 2)) ELSE 0.0 END AS wb_dev FROM scored JOIN med USING (label)),
r AS (SELECT *, false AS is_error, composite_score < 0.5 AS is_blurry, 0.0 AS mb_penalty, false AS soft_motion_blur, true AS exposure_ok, true AS clipping_ok,
    false AS low_features, false AS uneven_features, false AS has_vignetting, CAST(NULL AS VARCHAR) AS duplicate_of, abs(expo_dev) > 0.25 AS exposure_outlier,
    wb_dev > 0.15 AS wb_outlier, false AS low_dynamic_range, false AS high_iso, false AS aperture_outlier, false AS slow_shutter FROM dev),
s AS (SELECT *, {STATUS_SQL} AS status FROM r)
SELECT label, status, count(*) AS images, round(avg(composite_score), 6) AS mean_score, count(*) FILTER (is_blurry) AS blurry,
  count(*) FILTER (exposure_outlier) AS expo_drift, count(*) FILTER (wb_outlier) AS wb_drift FROM s GROUP BY label, status
"""


def label_results(spark, sf):
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 255)
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        blocks().alias("blocks"),
        (1.0 + F.element_at("embedding", 1).cast("double")).alias("wb_gain_rg"),
        (1.0 + F.element_at("embedding", 2).cast("double")).alias("wb_gain_bg"),
        F.array_max(size).alias("luma_median"),
    )
    rows = rows.withColumn("peak_sharpness", sc.peak_sharpness("blocks", F.lit(2048)))
    scored = rows.select(
        F.format_string("/vectors/%08d.png", "vec_id").alias("path"),
        "label",
        "peak_sharpness",
        sc.log_score("peak_sharpness").alias("composite_score"),
        sc.sharpness_spread("blocks").alias("sharpness_spread"),
        "wb_gain_rg",
        "wb_gain_bg",
        "luma_median",
        F.lit("").alias("md5"),
    )
    results = with_missing_defaults(scored.withColumns({"is_blurry": sc.is_blurry("composite_score"), "exposure_ok": F.lit(True)}))
    checks = QualityParams(iso_consistency=False, aperture_consistency=False)
    return consistency.set_drift(results, ["label"], p=checks)


@query("label_run", LABEL_RUN_SQL)
def label_run(spark, sf):
    labelled = label_results(spark, sf).withColumn("status", sc.status_label())
    return labelled.groupBy("label", "status").agg(
        F.count(F.lit(1)).alias("images"),
        rounded(F.avg("composite_score")).alias("mean_score"),
        F.count_if("is_blurry").alias("blurry"),
        F.count_if("exposure_outlier").alias("expo_drift"),
        F.count_if("wb_outlier").alias("wb_drift"),
    )
