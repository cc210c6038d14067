"""Rename matching, list assignment and the external quality filter (N1-N4, L1, E1-E4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import matching
from framewright.queries.base import query, rounded, table
from framewright.queries.numbering import numbering_sql

# Parts as developed files, orders as raw files: the same camera names in several spellings.
SIDES_SQL = """
dev AS (SELECT printf('/jpg/%s/%s', p_brand, CASE p_partkey % 8 WHEN 0 THEN printf('img_%04d_hand.jpg', p_partkey) WHEN 1 THEN printf('DSC_%d.JPG', p_partkey)
    WHEN 2 THEN printf('image%d-a.jpeg', p_partkey) WHEN 3 THEN printf('_MG_%d.jpg', p_partkey) WHEN 4 THEN printf('P%07d_x.jpg', p_partkey)
    WHEN 5 THEN printf('%05d.jpg', p_partkey) WHEN 6 THEN printf('trip_%d_north.jpg', p_partkey) ELSE printf('solo%d.jpg', p_partkey) END) AS path FROM part),
raw AS (SELECT printf('/raw/%d/%s', o_custkey % 30, CASE o_orderkey % 8 WHEN 0 THEN printf('IMG_%04d.cr3', o_orderkey) WHEN 1 THEN printf('dsc_%d.NEF', o_orderkey)
    WHEN 2 THEN printf('IMAGE%d.cr2', o_orderkey) WHEN 3 THEN printf('_mg_%d.dng', o_orderkey) WHEN 4 THEN printf('p%07d.arw', o_orderkey)
    WHEN 5 THEN printf('%05d_b.cr3', o_orderkey) WHEN 6 THEN printf('TRIP_%d.cr3', o_orderkey) ELSE printf('Solo%d.cr3', o_orderkey) END) AS path FROM orders WHERE o_orderkey % 5 > 0)
"""
NAME = "regexp_extract(path, '([^/]*)$', 1)"
STEM = f"regexp_replace({NAME}, '\\.[^.]*$', '')"
BASE = f"""upper(coalesce(nullif(regexp_extract({STEM}, '(?i)^(image\\d+|IMG_\\d+|DSC_\\d+|_MG_\\d+|P\\d{{4,}}|\\d{{4,}})', 1), ''),
  CASE WHEN contains({STEM}, '_') THEN split_part({STEM}, '_', 1) || '_' || split_part({STEM}, '_', 2) END, {STEM}))"""
BASES_SQL = (
    SIDES_SQL
    + f""",
dev_base AS (SELECT {BASE} AS base_name, min(path) AS path FROM dev GROUP BY 1),
raw_base AS (SELECT {BASE} AS base_name, max(path) AS path FROM raw GROUP BY 1),
pairs AS (
  SELECT d.base_name, regexp_extract(r.path, '([^/]*)$', 1) AS raw_filename, r.path AS raw_path,
    regexp_replace(regexp_extract(d.path, '([^/]*)$', 1), '\\.[^.]*$', '') || regexp_extract(r.path, '(\\.[^.]*)$', 1) AS new_filename
  FROM dev_base d JOIN raw_base r USING (base_name))
"""
)


def _spelled(n, patterns):
    out = None
    for i, pattern in enumerate(patterns[:-1]):
        text = F.format_string(pattern, n)
        out = F.when(n % 8 == i, text) if out is None else out.when(n % 8 == i, text)
    return out.otherwise(F.format_string(patterns[-1], n))


def developed(spark, sf):
    n = F.col("p_partkey")
    name = _spelled(n, ["img_%04d_hand.jpg", "DSC_%d.JPG", "image%d-a.jpeg", "_MG_%d.jpg", "P%07d_x.jpg", "%05d.jpg", "trip_%d_north.jpg", "solo%d.jpg"])
    return table(spark, sf, "part").select(F.concat(F.lit("/jpg/"), "p_brand", F.lit("/"), name).alias("path"))


def raws(spark, sf):
    """Without a fifth of the orders, so that some developed files have no partner."""
    return all_raws(spark, sf).filter(F.col("o_orderkey") % 5 > 0).select("path")


def all_raws(spark, sf):
    n = F.col("o_orderkey")
    name = _spelled(n, ["IMG_%04d.cr3", "dsc_%d.NEF", "IMAGE%d.cr2", "_mg_%d.dng", "p%07d.arw", "%05d_b.cr3", "TRIP_%d.cr3", "Solo%d.cr3"])
    folder = F.format_string("/raw/%d/", F.col("o_custkey") % 30)
    return table(spark, sf, "orders").select("o_orderkey", F.concat(folder, name).alias("path"))


@query("n1_base_name", f"WITH {SIDES_SQL.replace(' WHERE o_orderkey % 5 > 0', '')} SELECT path, {BASE} AS base_name FROM (SELECT path FROM dev UNION ALL SELECT path FROM raw)")
def n1(spark, sf):
    return developed(spark, sf).unionAll(all_raws(spark, sf).select("path")).select("path", names.camera_base("path").alias("base_name"))


@query("n2_rename_matches", f"WITH {BASES_SQL} SELECT * FROM pairs")
def n2(spark, sf):
    return matching.rename_matches(developed(spark, sf), raws(spark, sf))


def _unmatched_sql(side: str, mine: str, other: str) -> str:
    alone = f"SELECT base_name FROM {mine} ANTI JOIN {other} USING (base_name)"
    return f"""SELECT '{side}' AS side, (SELECT count(*) FROM ({alone})) AS unmatched,
      (SELECT string_agg(base_name, ', ' ORDER BY base_name) FROM ({alone} ORDER BY base_name LIMIT 5)) AS sample"""


@query(
    "n3_rename_unmatched",
    f"""WITH {BASES_SQL} {_unmatched_sql('raw_without_developed', 'raw_base', 'dev_base')}
    UNION ALL {_unmatched_sql('developed_without_raw', 'dev_base', 'raw_base')}""",
)
def n3(spark, sf):
    return matching.rename_unmatched(developed(spark, sf), raws(spark, sf))


@query(
    "n4_rename_manifest",
    f"""WITH {BASES_SQL}, there AS (SELECT DISTINCT {STEM} || '.cr3' AS name FROM dev WHERE length(path) % 2 = 0)
    SELECT base_name, raw_filename, raw_path, new_filename, CASE WHEN new_filename IN (SELECT name FROM there) THEN 'skipped' ELSE 'done' END AS status FROM pairs""",
)
def n4(spark, sf):
    dev = developed(spark, sf)
    there = dev.filter(F.length("path") % 2 == 0).select(F.concat(names.stem("path"), F.lit(".cr3")).alias("name"))
    return matching.rename_manifest(matching.rename_matches(dev, raws(spark, sf)), there, overwrite=False)


# Customers' orders as image lists (one per market segment), customers in even nations as the source folder.
LISTS_SQL = """
lines AS (SELECT c_mktsegment AS component, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) AS line_no, printf('IMG_%06d.jpg', o_custkey) AS filename
  FROM orders JOIN customer ON o_custkey = c_custkey),
source AS (SELECT printf('/src/IMG_%06d.jpg', c_custkey) AS src_path, printf('IMG_%06d.jpg', c_custkey) AS filename FROM customer WHERE c_nationkey % 2 = 0),
assigned AS (SELECT lines.*, src_path, CASE WHEN src_path IS NOT NULL THEN '/sorted/' || component || '/' || filename END AS dst_path FROM lines LEFT JOIN source USING (filename))
"""


def list_lines(spark, sf):
    from framewright.sources.lists import parse_image_lists

    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = orders.select(
        F.format_string("/lists/%s.imagelist", "c_mktsegment").alias("list_path"),
        F.col("o_orderkey").alias("line_order"),
        F.format_string("  D:\\shots\\day\\IMG_%06d.jpg ", "o_custkey").alias("line"),
    )
    return parse_image_lists(lines)


def list_source(spark, sf):
    return table(spark, sf, "customer").filter("c_nationkey % 2 = 0").select(F.format_string("/src/IMG_%06d.jpg", "c_custkey").alias("path"))


@query("l1_assign_components", f"WITH {LISTS_SQL} SELECT component, line_no, filename, src_path, dst_path FROM assigned")
def l1(spark, sf):
    return matching.assign_components(list_lines(spark, sf), list_source(spark, sf), "/sorted")


@query(
    "l1_component_counts",
    f"WITH {LISTS_SQL} SELECT component, count(src_path) AS assigned, count(*) - count(src_path) AS missing FROM assigned GROUP BY component",
)
def l1_counts(spark, sf):
    return matching.component_counts(matching.assign_components(list_lines(spark, sf), list_source(spark, sf), "/sorted"))


# Parts as cameras of an external project with a quality each; labelled documents as the files on disk.
SCORES_SQL = """
scores AS (SELECT CAST(p_partkey AS VARCHAR) AS camera_id, printf('IMG_%05d.jpg', p_partkey) AS filename, p_size / 50.0 AS quality FROM part),
disk AS (SELECT DISTINCT printf('IMG_%05d.jpg', doc_id) AS filename FROM labels)
"""


def scores(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("camera_id"),
        F.format_string("IMG_%05d.jpg", "p_partkey").alias("filename"),
        (F.col("p_size") / 50.0).alias("quality"),
    )


def disk(spark, sf):
    return table(spark, sf, "labels").select(F.format_string("IMG_%05d.jpg", "doc_id").alias("filename"))


@query(
    "e1_quality_summary",
    f"WITH {SCORES_SQL} SELECT count(*) AS n, CAST(min(quality) AS DOUBLE) AS min_quality, CAST(max(quality) AS DOUBLE) AS max_quality, round(avg(quality), 6) AS mean_quality FROM scores",
)
def e1(spark, sf):
    return matching.quality_summary(scores(spark, sf)).withColumn("mean_quality", rounded("mean_quality"))


@query(
    "e2_below_threshold",
    f"WITH {SCORES_SQL} SELECT camera_id, filename, CAST(quality AS DOUBLE) AS quality, filename IN (SELECT filename FROM disk) AS on_disk FROM scores WHERE quality < 0.5",
)
def e2(spark, sf):
    return matching.below_threshold(scores(spark, sf), 0.5, disk(spark, sf))


@query(
    "e2_threshold_summary",
    f"""WITH {SCORES_SQL} SELECT count(*) FILTER (quality < 0.5) AS bad, count(*) FILTER (quality >= 0.5) AS remaining,
    count(*) FILTER (quality < 0.5 AND filename IN (SELECT filename FROM disk)) AS removable,
    count(*) FILTER (quality < 0.5 AND filename NOT IN (SELECT filename FROM disk)) AS failed FROM scores""",
)
def e2_summary(spark, sf):
    return matching.threshold_summary(scores(spark, sf), 0.5, disk(spark, sf))


@query(
    "e3_orphaned_raws",
    f"WITH {SIDES_SQL} SELECT path FROM raw WHERE {STEM} NOT IN (SELECT {STEM} FROM dev) ORDER BY {NAME}",
)
def e3(spark, sf):
    return matching.orphaned_raws(raws(spark, sf), developed(spark, sf)).orderBy(names.base_name("path"), "path")


# Raw files by product name in one folder per brand, removed ones already numbered there.
REMOVAL_SQL = """
sel AS (SELECT p_partkey, printf('/raw/%s/%s.cr3', p_brand, p_name) AS path FROM part),
req AS (SELECT p_partkey, path, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/_removed' AS folder, regexp_extract(path, '([^/]*)\\.cr3$', 1) AS stem, '.cr3' AS suffix FROM sel),
taken AS (SELECT DISTINCT printf('/raw/%s/_removed', p_brand) AS folder, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_2' END AS stem, '.cr3' AS suffix FROM part WHERE p_size % 6 < 2)
"""


@query(
    "e4_removal_manifest",
    f"""WITH {REMOVAL_SQL}, {numbering_sql('req', 'taken', 'path, p_partkey')}
    SELECT path, 'move' AS action, folder || '/' || stem || CASE WHEN number > 0 THEN '_' || number ELSE '' END || suffix AS target_path FROM numbered""",
)
def e4(spark, sf):
    parts = table(spark, sf, "part")
    selected = parts.select(F.format_string("/raw/%s/%s.cr3", "p_brand", "p_name").alias("path"))
    tail = F.when(F.col("p_size") % 2 == 0, "").otherwise("_2")
    taken = parts.filter("p_size % 6 < 2").select(
        F.format_string("/raw/%s/_removed", "p_brand").alias("folder"), F.concat("p_name", tail).alias("stem"), F.lit(".cr3").alias("suffix")
    )
    return matching.removal_manifest(selected, "move", taken.distinct())
