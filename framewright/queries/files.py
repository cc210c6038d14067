"""File reconciliation (R1-R20): documents as file trees, orders and parts as their metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import reconcile as rc
from framewright.queries.base import query, table
from framewright.queries.numbering import numbering_sql
from framewright.sources.shared import materialise

# Documents as the backup tree; the import tree is what remains of it, under many shared names.
TREE_SQL = """
files AS (
  SELECT doc_id, printf('/vault/%s/%06d/%s_%d.jpg', source, doc_id, upper(source), doc_id % 50) AS path, n_chars AS size,
    1600000000 + doc_id * 60 AS mtime, sha256(text) AS sha256 FROM documents),
backup AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS name_lower FROM files),
imported AS (SELECT * FROM backup WHERE doc_id % 7 <> 0)
"""


def tree(spark, sf):
    docs = table(spark, sf, "documents")
    base = F.concat(F.upper("source"), F.lit("_"), (F.col("doc_id") % 50).cast("string"))
    catalog = docs.select(
        "doc_id",
        F.format_string("/vault/%s/%06d/%s.jpg", F.col("source"), F.col("doc_id"), base).alias("path"),
        F.col("n_chars").alias("length"),
        (1600000000 + F.col("doc_id") * 60).alias("modificationTime"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )
    return rc.file_index(catalog, sha256="digest")


def imported(spark, sf):
    ident = F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("bigint")
    return tree(spark, sf).filter(ident % 7 != 0)


@query(
    "r1_exclude_subtree",
    f"WITH {TREE_SQL} SELECT path, size FROM backup WHERE NOT starts_with(lower(path), '/vault/src3/')",
)
def r1(spark, sf):
    return rc.exclude_subtree(tree(spark, sf), "/VAULT/Src3").select("path", "size")


@query("r2_file_index", f"WITH {TREE_SQL} SELECT path, name_lower, size, mtime, sha256 FROM backup")
def r2(spark, sf):
    return tree(spark, sf)


def _match(negated: bool, keys: str) -> str:
    word = "NOT EXISTS" if negated else "EXISTS"
    on = " AND ".join(f"i.{k} = b.{k}" for k in keys.split())
    return f"WITH {TREE_SQL} SELECT path, name_lower, size FROM backup b WHERE {word} (SELECT 1 FROM imported i WHERE {on})"


@query("r3_missing_files", _match(True, "name_lower size"))
def r3(spark, sf):
    return rc.missing_files(tree(spark, sf), imported(spark, sf)).select("path", "name_lower", "size")


@query("r3_missing_files_by_hash", _match(True, "name_lower size sha256"))
def r3_hash(spark, sf):
    return rc.missing_files(tree(spark, sf), imported(spark, sf), use_hash=True).select("path", "name_lower", "size")


@query("r4_present_files", _match(False, "name_lower size"))
def r4(spark, sf):
    return rc.present_files(tree(spark, sf), imported(spark, sf)).select("path", "name_lower", "size")


# The stored index is an older state: some sizes and times differ, some files are unknown, some are gone.
INDEX_SQL = (
    TREE_SQL
    + """,
stored AS (
  SELECT doc_id, path, name_lower, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 11 = 0 THEN mtime - 5 ELSE mtime END AS mtime,
    CASE WHEN doc_id % 13 <> 0 THEN sha256 END AS sha256 FROM backup WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, path || '.old', name_lower || '.old', size, mtime, sha256 FROM backup WHERE doc_id % 9 = 0)
"""
)


def stored_index(spark, sf):
    ident = F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("bigint")
    rows = tree(spark, sf).withColumn("doc_id", ident)
    d = F.col("doc_id")
    older = rows.filter(d % 4 != 0).withColumns(
        {
            "size": F.when(d % 5 == 0, F.col("size") + 1).otherwise(F.col("size")),
            "mtime": F.when(d % 11 == 0, F.col("mtime") - 5).otherwise(F.col("mtime")),
            "sha256": F.when(d % 13 != 0, F.col("sha256")),
        }
    )
    gone = rows.filter(d % 9 == 0).withColumns(
        {"path": F.concat("path", F.lit(".old")), "name_lower": F.concat("name_lower", F.lit(".old"))}
    )
    return older.unionByName(gone).drop("doc_id")


def contents(spark, sf):
    docs = table(spark, sf, "documents")
    base = F.concat(F.upper("source"), F.lit("_"), (F.col("doc_id") % 50).cast("string"))
    return docs.select(
        F.format_string("/vault/%s/%06d/%s.jpg", F.col("source"), F.col("doc_id"), base).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )


@query(
    "r5_incremental_hash",
    f"""WITH {INDEX_SQL} SELECT b.path, b.size, b.sha256, s.sha256 IS NOT NULL AND s.size = b.size AND s.mtime = b.mtime AS hash_reused
    FROM backup b LEFT JOIN stored s ON s.path = b.path""",
)
def r5(spark, sf):
    found = rc.incremental_hash(tree(spark, sf), stored_index(spark, sf), contents(spark, sf))
    return found.select("path", "size", "sha256", "hash_reused")


@query(
    "r5_hashing_off",
    f"""WITH {INDEX_SQL} SELECT b.path, CASE WHEN s.size = b.size AND s.mtime = b.mtime THEN s.sha256 END AS sha256
    FROM backup b LEFT JOIN stored s ON s.path = b.path""",
)
def r5_off(spark, sf):
    return rc.incremental_hash(tree(spark, sf), stored_index(spark, sf), None).select("path", "sha256")


@query(
    "r6_sync_index",
    f"""WITH {INDEX_SQL} SELECT coalesce(b.path, s.path) AS path, CASE WHEN b.path IS NOT NULL THEN b.size ELSE s.size END AS size,
      CASE WHEN s.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted'
        WHEN b.size = s.size AND b.mtime = s.mtime AND b.name_lower IS NOT DISTINCT FROM s.name_lower AND b.sha256 IS NOT DISTINCT FROM s.sha256 THEN 'same' ELSE 'changed' END AS change
    FROM backup b FULL JOIN stored s ON s.path = b.path""",
)
def r6(spark, sf):
    return rc.sync_index(tree(spark, sf), stored_index(spark, sf)).select("path", "size", "change")


# Orders as files with tag records, some dates invalid, empty or missing.
RECORDS_SQL = """
rec AS (
  SELECT o_orderkey, printf('/backup/%06d/IMG_%d%s', o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.CR3' ELSE '.jpg' END) AS path,
    CAST(o_totalprice AS BIGINT) AS size, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS mtime,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2001-02-30' WHEN 2 THEN '' END AS "DateTimeOriginal",
    CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') END AS "CreateDate",
    CASE WHEN o_orderkey % 7 = 0 THEN '1999-12-31' END AS "MediaCreateDate",
    o_orderstatus || ': "' || o_orderpriority || '".' AS "Model", CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS "LensModel",
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'id/' || o_orderstatus END AS "LensID", 'spec*' || (o_orderkey % 9) AS "LensSpec",
    CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 200) || ' mm' WHEN 1 THEN (o_custkey % 200) || ',5MM' WHEN 2 THEN (o_custkey % 90) || '.0 mm (35)' WHEN 3 THEN 'wide|angle' WHEN 4 THEN '' END AS "FocalLength"
  FROM orders)
"""
FOCAL_SQL = """
CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 200) || 'mm' WHEN 1 THEN (o_custkey % 200) || '.5mm' WHEN 2 THEN (o_custkey % 90) || 'mm' WHEN 3 THEN 'wide_angle' ELSE '' END
"""


def sanitize_sql(text: str) -> str:
    return rf"""regexp_replace(regexp_replace(translate(coalesce({text}, ''), '<>:"/\|?*', '_________'), '^\s+|\s+$', '', 'g'), '\.+$', '')"""


DESCRIBED_SQL = (
    RECORDS_SQL
    + f""",
dated AS (
  SELECT *, coalesce(CASE WHEN try_strptime("DateTimeOriginal", '%Y-%m-%d') IS NOT NULL THEN "DateTimeOriginal" END,
      CASE WHEN try_strptime("CreateDate", '%Y-%m-%d') IS NOT NULL THEN "CreateDate" END,
      CASE WHEN try_strptime("MediaCreateDate", '%Y-%m-%d') IS NOT NULL THEN "MediaCreateDate" END) AS exif_date FROM rec),
described AS (
  SELECT o_orderkey, path, size, mtime, coalesce(exif_date, strftime(mtime, '%Y-%m-%d'), '1970-01-01') AS date_str,
    CASE WHEN exif_date IS NOT NULL THEN 'exif' WHEN mtime IS NOT NULL THEN 'filesystem' ELSE 'unknown' END AS date_source,
    {sanitize_sql('"Model"')} AS model, {sanitize_sql('''coalesce(nullif("LensModel", ''), nullif("LensID", ''), nullif("LensSpec", ''), '')''')} AS lens,
    {FOCAL_SQL.replace('o_custkey', '(SELECT o_custkey FROM orders o WHERE o.o_orderkey = dated.o_orderkey)')} AS focal,
    CASE WHEN lower(path) LIKE '%.mp4' THEN 'video' ELSE 'photo' END AS media FROM dated)
"""
)


def tag_records(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ending = F.when(o % 3 == 0, ".MP4").when(o % 3 == 1, ".CR3").otherwise(".jpg")
    customer = lambda mod: (c % mod).cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.format_string("/backup/%06d/IMG_%d%s", c, o, ending).alias("path"),
        F.rint("o_totalprice").cast("bigint").alias("size"),
        F.when(o % 5 != 0, F.col("o_orderdate")).alias("mtime"),
        F.when(o % 4 == 0, day).when(o % 4 == 1, "2001-02-30").when(o % 4 == 2, "").alias("DateTimeOriginal"),
        F.when(o % 3 == 0, "n/a").when(o % 3 == 1, F.date_format(F.date_add("o_orderdate", 40), "yyyy-MM-dd")).alias("CreateDate"),
        F.when(o % 7 == 0, "1999-12-31").alias("MediaCreateDate"),
        F.concat("o_orderstatus", F.lit(': "'), "o_orderpriority", F.lit('".')).alias("Model"),
        F.when(o % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("LensModel"),
        F.when(o % 3 != 0, F.concat(F.lit("id/"), F.col("o_orderstatus"))).alias("LensID"),
        F.concat(F.lit("spec*"), (o % 9).cast("string")).alias("LensSpec"),
        F.when(o % 6 == 0, F.concat(customer(200), F.lit(" mm")))
        .when(o % 6 == 1, F.concat(customer(200), F.lit(",5MM")))
        .when(o % 6 == 2, F.concat(customer(90), F.lit(".0 mm (35)")))
        .when(o % 6 == 3, "wide|angle")
        .when(o % 6 == 4, "")
        .alias("FocalLength"),
    )


TAGS = ["DateTimeOriginal", "CreateDate", "MediaCreateDate", "Model", "LensModel", "LensID", "LensSpec", "FocalLength"]


def described(spark, sf):
    rows = tag_records(spark, sf)
    return rc.file_metadata(rows.select("o_orderkey", "path", "size", "mtime"), rows.select("path", *TAGS))


# The cache was filled from older sizes and times; reads that failed are not in it.
CACHE_SQL = (
    DESCRIBED_SQL
    + """,
cache AS (SELECT path, CASE WHEN o_orderkey % 5 = 1 THEN size + 1 ELSE size END AS size, mtime, date_str, date_source, model, lens, focal, media
  FROM described WHERE o_orderkey % 3 <> 0 AND mtime IS NOT NULL)
"""
)


def cache(spark, sf):
    rows = described(spark, sf).filter((F.col("o_orderkey") % 3 != 0) & F.col("mtime").isNotNull())
    size = F.when(F.col("o_orderkey") % 5 == 1, F.col("size") + 1).otherwise(F.col("size"))
    return rows.withColumn("size", size).select("path", "size", "mtime", *rc.META)


@query(
    "r7_metadata_cache_lookup",
    f"""WITH {CACHE_SQL} SELECT rec.path, c.date_str, c.model, c.lens, c.focal, c.media, c.path IS NOT NULL AS cache_hit
    FROM rec LEFT JOIN cache c ON c.path = rec.path AND c.size = rec.size AND c.mtime = rec.mtime""",
)
def r7(spark, sf):
    files = tag_records(spark, sf).select("path", "size", "mtime")
    mine = cache(spark, sf).withColumn("scan_key", F.lit("k"))
    other = mine.withColumns({"scan_key": F.lit("other"), "model": F.lit("of another scan")})
    return rc.metadata_cache_lookup(files, mine.unionByName(other), "k").select("path", "date_str", "model", "lens", "focal", "media", "cache_hit")


@query(
    "r8_metadata_cache_upsert",
    f"""WITH {CACHE_SQL}, fresh AS (SELECT path, size, mtime, date_str, date_source, model, lens, focal, media FROM described WHERE o_orderkey % 4 = 0)
    SELECT path, size, date_str, date_source, model, lens, focal, media FROM fresh
    UNION ALL SELECT path, size, date_str, date_source, model, lens, focal, media FROM cache WHERE path NOT IN (SELECT path FROM fresh)""",
)
def r8(spark, sf):
    old = cache(spark, sf).withColumn("scan_key", F.lit("k"))
    fresh = described(spark, sf).filter(F.col("o_orderkey") % 4 == 0).select("path", "size", "mtime", *rc.META, F.lit("k").alias("scan_key"))
    return rc.metadata_cache_upsert(old, fresh).select("path", "size", *rc.META)


@query("r9_capture_date", f"WITH {DESCRIBED_SQL} SELECT o_orderkey, date_str, date_source FROM described")
def r9(spark, sf):
    date, source = rc.capture_date(TAGS[:3], "mtime")
    return tag_records(spark, sf).select("o_orderkey", date.alias("date_str"), source.alias("date_source"))


@query("r10_lens_label", f"WITH {DESCRIBED_SQL} SELECT o_orderkey, lens, model FROM described")
def r10(spark, sf):
    return tag_records(spark, sf).select(
        "o_orderkey", rc.lens_label("LensModel", "LensID", "LensSpec").alias("lens"), names.sanitize_part("Model").alias("model")
    )


@query("r11_media_kind", f"WITH {DESCRIBED_SQL} SELECT o_orderkey, media FROM described")
def r11(spark, sf):
    return tag_records(spark, sf).select("o_orderkey", names.media_kind("path").alias("media"))


@query("r12_sanitize_part", f"SELECT page_id, {sanitize_sql('url')} AS safe_url, {sanitize_sql('html')} AS safe_html FROM pages")
def r12(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", names.sanitize_part("url").alias("safe_url"), names.sanitize_part("html").alias("safe_html")
    )


@query("r13_format_focal", f"SELECT o_orderkey, {FOCAL_SQL} AS focal FROM orders")
def r13(spark, sf):
    return tag_records(spark, sf).select("o_orderkey", names.format_focal("FocalLength").alias("focal"))


FOLDERS = rc.TransferPlan("/out", folder_date=True, folder_focal=True, folder_model=True, folder_lens=True, folder_media=True)


@query(
    "r14_subfolder_parts",
    f"""WITH {DESCRIBED_SQL} SELECT o_orderkey, date_str || '/' || CASE WHEN focal = '' THEN 'unknown' ELSE focal END || '/' || CASE WHEN model = '' THEN 'unknown' ELSE model END
    || '/' || CASE WHEN lens = '' THEN 'unknown' ELSE lens END || '/' || media AS folder FROM described""",
)
def r14(spark, sf):
    return described(spark, sf).select("o_orderkey", rc.subfolder_parts(FOLDERS).alias("folder"))


NAMES = rc.TransferPlan("/out", name_date=True, name_model=True, name_lens=True, name_focal=True, separator="-", prefix="--trip-", suffix="-final--")


@query(
    "r15_build_name",
    f"""WITH {DESCRIBED_SQL} SELECT o_orderkey, {sanitize_sql("concat_ws('-', date_str, 'trip', 'IMG_' || o_orderkey, 'final', nullif(model, ''), nullif(lens, ''), nullif(focal, ''))")} AS name FROM described""",
)
def r15(spark, sf):
    return described(spark, sf).select("o_orderkey", rc.build_name(names.stem("path"), NAMES).alias("name"))


# Parts as missing files: folders by type, names by product, so most targets are wanted more than once.
REQUEST_SQL = """
parts AS (SELECT p_partkey, printf('/backup/%s/%06d/%s%s.jpg', p_brand, p_partkey, p_name, CASE p_partkey % 10 WHEN 0 THEN '_1' WHEN 1 THEN '_2' ELSE '' END) AS path,
    CAST(p_size * 10 AS BIGINT) AS size, p_type FROM part),
req AS (SELECT p_partkey, path, '/out/' || p_type AS folder, regexp_extract(path, '([^/]*)\\.jpg$', 1) AS stem, '.jpg' AS suffix, size FROM parts),
lst AS (SELECT '/out/' || p_type AS folder, p_name || CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN '_3' ELSE '_5' END AS stem, '.JPG' AS suffix, CAST(max(p_size) * 10 AS BIGINT) AS size,
    sha256(CAST(max(p_size) * 10 AS VARCHAR)) AS sha256 FROM part WHERE p_size % 10 < 3 GROUP BY ALL)
"""
RESOLVED_SQL = (
    REQUEST_SQL
    + f""",
marked AS (SELECT req.*, EXISTS (SELECT 1 FROM lst WHERE lower(lst.folder) = lower(req.folder) AND lower(lst.stem) = lower(req.stem) AND lower(lst.suffix) = lower(req.suffix) AND lst.size = req.size) AS already FROM req),
todo AS (SELECT * FROM marked WHERE NOT already),
{numbering_sql('todo', 'lst', 'path')},
resolved AS (
  SELECT p_partkey, path, size, folder || '/' || stem || suffix AS dest_path, already FROM marked WHERE already
  UNION ALL SELECT p_partkey, path, size, folder || '/' || stem || CASE WHEN number > 0 THEN '_' || number ELSE '' END || suffix, already FROM numbered)
"""
)


def part_files(spark, sf):
    tail = F.when(F.col("p_partkey") % 10 == 0, "_1").when(F.col("p_partkey") % 10 == 1, "_2").otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        F.format_string("/backup/%s/%06d/%s%s.jpg", F.col("p_brand"), F.col("p_partkey"), F.col("p_name"), tail).alias("path"),
        (F.col("p_size") * 10).cast("bigint").alias("size"),
    )


def existing(spark, sf):
    tail = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 10 == 1, "_3").otherwise("_5")
    there = table(spark, sf, "part").filter(F.col("p_size") % 10 < 3)
    return (
        there.groupBy(F.concat(F.lit("/out/"), "p_type").alias("folder"), F.concat("p_name", tail).alias("stem"), F.lit(".JPG").alias("suffix"))
        .agg((F.max("p_size") * 10).cast("bigint").alias("size"))
        .withColumn("sha256", F.sha2(F.col("size").cast("string").cast("binary"), 256))
    )


@query("r16_resolve_destination", f"WITH {RESOLVED_SQL} SELECT p_partkey, dest_path, already FROM resolved")
def r16(spark, sf):
    request = part_files(spark, sf).select(
        "p_partkey",
        "path",
        F.concat(F.lit("/out/"), "p_type").alias("folder"),
        names.stem("path").alias("stem"),
        names.suffix("path").alias("suffix"),
        "size",
    )
    return rc.resolve_destination(request, existing(spark, sf), ["path"]).select("p_partkey", "dest_path", "already")


# Tag records of the part files: the model is the type, so the folder comes out of the metadata.
BY_MODEL = rc.TransferPlan("/out", folder_model=True)


def part_records(spark, sf):
    none = F.lit(None).cast("string")
    return part_files(spark, sf).select(
        "path",
        F.when(F.col("p_partkey") % 2 == 0, "2024-03-05").alias("DateTimeOriginal"),
        none.alias("CreateDate"),
        none.alias("MediaCreateDate"),
        F.col("p_type").alias("Model"),
        none.alias("LensModel"),
        none.alias("LensID"),
        none.alias("LensSpec"),
        F.lit("35mm").alias("FocalLength"),
    )


def missing_parts(spark, sf):
    return part_files(spark, sf).select("path", "size", F.timestamp_seconds(F.lit(1699963200)).alias("mtime"))


def planned(spark, sf):
    return rc.plan_transfer(missing_parts(spark, sf), part_records(spark, sf), existing(spark, sf), BY_MODEL)


@query(
    "r17_plan_transfer",
    f"""WITH {RESOLVED_SQL} SELECT path, size, CASE WHEN p_partkey % 2 = 0 THEN '2024-03-05' ELSE '2023-11-14' END AS date_str,
    CASE WHEN p_partkey % 2 = 0 THEN 'exif' ELSE 'filesystem' END AS date_source, p_type AS model, '' AS lens, '35mm' AS focal, 'photo' AS media,
    dest_path, CASE WHEN already THEN 'present' ELSE 'missing' END AS status FROM resolved JOIN part USING (p_partkey)""",
)
def r17(spark, sf):
    return planned(spark, sf)


@query(
    "r18_replan_diff",
    f"""WITH {RESOLVED_SQL} SELECT path, dest_path, CASE WHEN already THEN 'present' ELSE 'missing' END AS status,
    dest_path <> folder0 OR CASE WHEN already THEN 'present' ELSE 'missing' END <> status0 AS changed
    FROM resolved JOIN (SELECT p_partkey, folder || '/' || stem || suffix AS folder0, 'missing' AS status0 FROM req) USING (p_partkey)""",
)
def r18(spark, sf):
    """The old plan gave every file its natural name, as if the destination had been empty."""
    old = rc.file_metadata(missing_parts(spark, sf), part_records(spark, sf)).withColumns(
        {
            "dest_path": names.join_path(F.lit("/out"), F.col("model"), names.base_name("path")),
            "status": F.lit("missing"),
        }
    )
    return rc.replan_diff(old, existing(spark, sf), BY_MODEL).select("path", "dest_path", "status", "changed")


def pending(spark, sf):
    rows = rc.file_metadata(missing_parts(spark, sf), part_records(spark, sf))
    ident = F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("bigint")
    digest = F.when(ident % 3 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(
        F.sha2(F.col("size").cast("string").cast("binary"), 256)
    )
    return rows.withColumns({"dest_path": F.lit(""), "status": F.lit("missing"), "sha256": digest})


@query(
    "r19_transfer_manifest",
    f"""WITH {RESOLVED_SQL} SELECT path, size, dest_path, CASE WHEN already THEN 'skipped' ELSE 'copied' END AS status FROM resolved""",
)
def r19(spark, sf):
    found = rc.transfer_manifest(pending(spark, sf).drop("sha256"), existing(spark, sf), BY_MODEL, "copy")
    return found.select("path", "size", "dest_path", "status")


R19_HASH_SQL = RESOLVED_SQL.replace("AND lst.size = req.size)", "AND lst.size = req.size AND p_partkey % 3 <> 0)")


@query(
    "r19_transfer_manifest_by_hash",
    f"""WITH {R19_HASH_SQL} SELECT path, size, dest_path, CASE WHEN already THEN 'skipped' ELSE 'moved' END AS status FROM resolved""",
)
def r19_hash(spark, sf):
    found = rc.transfer_manifest(pending(spark, sf), existing(spark, sf), BY_MODEL, "move", use_hash=True)
    return found.select("path", "size", "dest_path", "status")


@query(
    "r20_scan_summary",
    f"""WITH {INDEX_SQL}, {DESCRIBED_SQL}, hashed AS (SELECT b.doc_id, s.sha256 IS NOT NULL AND s.size = b.size AND s.mtime = b.mtime AS hash_reused FROM backup b LEFT JOIN stored s ON s.path = b.path)
    SELECT 'import_files' AS counter, count(*) AS n FROM hashed WHERE doc_id % 7 <> 0
    UNION ALL SELECT 'backup_files', count(*) FROM hashed
    UNION ALL SELECT 'missing_files', count(*) FROM backup b WHERE NOT EXISTS (SELECT 1 FROM imported i WHERE i.name_lower = b.name_lower AND i.size = b.size)
    UNION ALL SELECT 'reused_hashes', count(*) FILTER (hash_reused) + count(*) FILTER (hash_reused AND doc_id % 7 <> 0) FROM hashed
    UNION ALL SELECT 'dated_by_metadata', count(*) FILTER (date_source = 'exif') FROM described""",
)
def r20(spark, sf):
    index, body = stored_index(spark, sf), contents(spark, sf)
    ours = materialise(rc.incremental_hash(imported(spark, sf), index, body), "import")
    theirs = materialise(rc.incremental_hash(tree(spark, sf), index, body), "backup")
    return rc.scan_summary(ours, theirs, rc.missing_files(theirs, ours), described(spark, sf))
