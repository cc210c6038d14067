"""Sources and sinks (S1-S13). Files are written by Spark from the tables into the shared folder."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from framewright.functions import names
from framewright.operators import reconcile as rc
from framewright.operators.report import export_rows
from framewright.plans import backup
from framewright.queries.base import query, spread_files, spread_scan, table
from framewright.queries.files import DESCRIBED_SQL, TREE_SQL, described, tree
from framewright.queries.png import png_file
from framewright.queries.rasters import PIXELS_SQL, embedding_rasters
from framewright.queries.reports import EXPORT_SQL, export_input
from framewright.sources import archive, files, index, lists, sinks, tags
from framewright.sources.shared import shared_folder
from framewright.streaming import ingest

LISTING_SQL = """
one AS (SELECT doc_id, printf('/Set/%s/IMG_%d', source, doc_id) || CASE doc_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.Tiff' END AS path, n_chars AS length FROM documents),
listing AS (SELECT path, length FROM one UNION ALL SELECT upper(path), length FROM one WHERE doc_id IN (SELECT doc_id FROM labels))
"""


@query(
    "s1_scan_media",
    f"""WITH {LISTING_SQL} SELECT min(path) AS path, arg_min(length, path) AS length FROM listing
    WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|tif|tiff|bmp|gif|webp)$') GROUP BY lower(path)""",
)
def s1(spark, sf):
    docs = table(spark, sf, "documents")
    n = F.col("doc_id") % 6
    ending = F.when(n == 0, ".jpg").when(n == 1, ".JPG").when(n == 2, ".png").when(n == 3, ".txt").when(n == 4, "").otherwise(".Tiff")
    one = docs.select("doc_id", F.concat(F.lit("/Set/"), "source", F.lit("/IMG_"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("n_chars").alias("length"))
    again = one.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("path", F.upper("path"))
    return files.catalog_from_listing(one.unionByName(again).select("path", "length"))


def landed_documents(spark, sf):
    """Documents as text files, one folder per language and source."""
    root = shared_folder(spark, "landed")
    table(spark, sf, "documents").select("text", "lang", "source").write.partitionBy("lang", "source").text(root)
    return root


FOLDER_BYTES_SQL = """
SELECT lang, source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang, source
"""


def folder_bytes(catalog, size):
    return catalog.groupBy(
        F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"), F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source")
    ).agg(F.sum(size).alias("bytes"))


@query("s1_scan_folders", FOLDER_BYTES_SQL)
def s1_folders(spark, sf):
    """A recursive scan of real files; their content is never read."""
    return folder_bytes(files.scan_media(spark, landed_documents(spark, sf), extensions=(".txt",)), "length")


@query(
    "s2_load_rasters",
    f"""WITH {PIXELS_SQL}, sums AS (SELECT vec_id, vec_id % 10 = 3 AS is_error, sum(g)::BIGINT AS green, sum(b)::BIGINT AS blue, sum(r)::BIGINT AS red FROM px GROUP BY vec_id)
    SELECT printf('%08d.png', vec_id) AS name, CASE WHEN is_error THEN -1 ELSE 8 END AS height, CASE WHEN is_error THEN -1 ELSE 8 END AS width,
      CASE WHEN is_error THEN -1 ELSE 3 END AS n_channels, is_error, CASE WHEN is_error THEN 'image could not be decoded' ELSE '' END AS load_note,
      CASE WHEN NOT is_error THEN blue END AS blue, CASE WHEN NOT is_error THEN green END AS green, CASE WHEN NOT is_error THEN red END AS red FROM sums""",
)
def s2(spark, sf):
    """Embeddings written as PNG files (every tenth one broken) and decoded again by the image source."""

    def encode(batches):
        for batch in batches:
            body = [b"text" if v % 10 == 3 else png_file(8, 8, bytes(d)) for v, d in zip(batch["vec_id"], batch["data"])]
            yield pd.DataFrame({"name": [f"{v:08d}.png" for v in batch["vec_id"]], "content": body})

    root = shared_folder(spark, "rasters")
    pictures = embedding_rasters(spark, sf).select("vec_id", "data").mapInPandas(encode, "name string, content binary")
    files.land_files(pictures, root).write.format("noop").mode("overwrite").save()

    def channel(offset: int):
        byte = lambda i: F.conv(F.hex(F.substring("data", i * 3 + 1 + offset, F.lit(1))), 16, 10).cast("bigint")
        total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), byte), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(F.col("data").isNotNull(), total)

    return files.load_rasters(spark, root).select(
        names.base_name("path").alias("name"), "height", "width", "n_channels", "is_error", "load_note",
        channel(0).alias("blue"), channel(1).alias("green"), channel(2).alias("red"),
    )


@query("s3_content_fingerprint", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def s3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.content_fingerprint(docs)


# ---- parts as photos with metadata: the TIFF structure is put together from the columns ---------


def _u16(c):
    return F.lpad(F.hex(c), 4, "0")


def _u32(c):
    return F.lpad(F.hex(c), 8, "0")


def _entry(tag: int, kind: int, count: int, value):
    return F.concat(F.lit(f"{tag:04X}{kind:04X}{count:08X}"), value)


def _at(offset: int):
    return F.lit(f"{offset:08X}")


def _ascii(c, size: int):
    return F.rpad(F.hex(F.encode(c, "utf-8")), size * 2, "0")


def _ratio(p, q):
    return F.concat(_u32(p), _u32(q))


def tagged_files(spark, sf):
    """path, content: big-endian TIFF headers, every second one inside a JPEG, every tenth file not an image."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    main = [
        _entry(0x010F, 2, 32, _at(74)),
        _entry(0x0110, 2, 32, _at(106)),
        _entry(0x0112, 3, 1, F.concat(_u16(1 + k % 8), F.lit("0000"))),
        _entry(0x8769, 4, 1, _at(138)),
        _entry(0x8825, 4, 1, _at(248)),
    ]
    shot = [
        _entry(0x829A, 5, 1, _at(212)),
        _entry(0x829D, 5, 1, _at(204)),
        _entry(0x8827, 3, 1, F.concat(_u16((k % 50) * 100), F.lit("0000"))),
        _entry(0x9003, 2, 20, _at(228)),
        _entry(0x920A, 5, 1, _at(220)),
    ]
    side = lambda even, odd: F.when(k % 2 == 0, F.lit(even)).otherwise(F.lit(odd))
    gps = [
        _entry(1, 2, 2, side("4E000000", "53000000")),
        _entry(2, 5, 3, _at(302)),
        _entry(3, 2, 2, side("45000000", "57000000")),
        _entry(4, 5, 3, _at(326)),
    ]
    one = F.lit(1).cast("bigint")
    place = lambda d, m, s: F.concat(_ratio(d, one), _ratio(m, one), _ratio(s, one * 10))
    end = F.lit("00000000")
    tiff = F.concat(
        F.lit("4D4D002A00000008"), F.lit("0005"), *main, end,
        _ascii(F.col("p_brand"), 32), _ascii(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), 32),
        F.lit("0005"), *shot, end,
        _ratio(size + 10, one * 10), _ratio(one, size * 10), _ratio(size, one), _ascii(F.lit("2024:05:06 07:08:09"), 20),
        F.lit("0004"), *gps, end,
        place(k % 90, k % 60, k % 600), place(k % 180, k % 59, k % 599),
    )
    jpeg = F.concat(F.lit("FFD8FFE00010"), F.lit("4A46494600010100000100010000"), F.lit("FFE1"), _u16(F.length(tiff) / 2 + 8), F.lit("457869660000"), tiff, F.lit("FFD9"))
    body = F.when(k % 10 == 9, F.hex(F.encode(F.lit("not an image"), "utf-8"))).when(k % 2 == 0, tiff).otherwise(jpeg)
    return spread_scan(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey", F.format_string("/photos/%08d.jpg", k).alias("path"), F.unhex(body).alias("content")
    )


TAGGED_SQL = """
tagged AS (SELECT p_partkey AS k, p_size, printf('/photos/%08d.jpg', p_partkey) AS path, p_brand, ' ' || p_type || ' ' AS p_type FROM part WHERE p_partkey % 10 <> 9)
"""


@query(
    "s4_extract_tags",
    f"""WITH {TAGGED_SQL}
    SELECT path, 'make' AS tag, p_brand AS value FROM tagged UNION ALL SELECT path, 'model', p_type FROM tagged
    UNION ALL SELECT path, 'orientation', CAST(1 + k % 8 AS VARCHAR) FROM tagged
    UNION ALL SELECT path, 'aperture', CAST(CAST((p_size + 10) / 10 AS DOUBLE) AS VARCHAR) FROM tagged
    UNION ALL SELECT path, 'shutter', CAST(CAST(1 AS DOUBLE) / (p_size * 10) AS VARCHAR) FROM tagged
    UNION ALL SELECT path, 'iso', CAST((k % 50) * 100 AS VARCHAR) FROM tagged
    UNION ALL SELECT path, 'focal_length', CAST(CAST(p_size AS DOUBLE) AS VARCHAR) FROM tagged
    UNION ALL SELECT path, 'datetime', '2024:05:06 07:08:09' FROM tagged
    UNION ALL SELECT path, 'lat_ref', CASE WHEN k % 2 = 0 THEN 'N' ELSE 'S' END FROM tagged
    UNION ALL SELECT path, 'lon_ref', CASE WHEN k % 2 = 0 THEN 'E' ELSE 'W' END FROM tagged
    UNION ALL SELECT path, 'lat', concat_ws(' ', CAST(k % 90 AS DOUBLE), CAST(k % 60 AS DOUBLE), CAST((k % 600) / 10 AS DOUBLE)) FROM tagged
    UNION ALL SELECT path, 'lon', concat_ws(' ', CAST(k % 180 AS DOUBLE), CAST(k % 59 AS DOUBLE), CAST((k % 599) / 10 AS DOUBLE)) FROM tagged""",
)
def s4(spark, sf):
    return tags.extract_tags(tagged_files(spark, sf))


@query(
    "s5_normalise_metadata",
    f"""WITH {TAGGED_SQL} SELECT path, p_brand AS make, trim(p_type) AS model, CAST(1 + k % 8 AS INTEGER) AS orientation,
      CAST((p_size + 10) / 10 AS DOUBLE) AS aperture, CAST(1 AS DOUBLE) / (p_size * 10) AS shutter, CASE WHEN k % 50 > 0 THEN CAST((k % 50) * 100 AS DOUBLE) END AS iso,
      CAST(p_size AS DOUBLE) AS focal_length, '2024:05:06 07:08:09' AS datetime,
      round(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (k % 90 + CAST(k % 60 AS DOUBLE) / 60 + CAST((k % 600) / 10 AS DOUBLE) / 3600), 5) AS lat,
      round(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (k % 180 + CAST(k % 59 AS DOUBLE) / 60 + CAST((k % 599) / 10 AS DOUBLE) / 3600), 5) AS lon FROM tagged""",
)
def s5(spark, sf):
    meta = tags.normalise_metadata(tags.extract_tags(tagged_files(spark, sf)))
    plain = ("make", "model", "orientation", "aperture", "shutter", "iso", "focal_length", "datetime")
    return meta.select(
        "path", *[F.col(f"exif.{c}").alias(c) for c in plain], F.round("exif.gps.lat", 5).alias("lat"), F.round("exif.gps.lon", 5).alias("lon")
    )


@query(
    "s6_read_quality_archive",
    """SELECT CAST(p_partkey AS VARCHAR) AS camera_id, printf('IMG_%05d.jpg', p_partkey) AS filename, CAST(p_size / 50.0 AS DOUBLE) AS quality FROM part
    WHERE (p_partkey // 100) % 7 <> 6 AND p_partkey % 9 <> 4 AND p_partkey % 11 <> 5""",
)
def s6(spark, sf):
    """A hundred parts per project archive; some archives are damaged, some cameras lack photo or quality."""
    k = F.col("p_partkey")
    photo = F.when(k % 11 == 5, "").otherwise(F.format_string('<photo path="D:/shots/a&amp;b/IMG_%05d.jpg"/>', k))
    quality = F.when(k % 9 == 4, "").otherwise(
        F.concat(F.lit('<property name="Image/Quality" value="'), (F.col("p_size") / 50.0).cast("string"), F.lit('"/>'))
    )
    camera = F.concat(
        F.format_string('<camera camera_id="%d">', k), photo, F.lit('<meta><property name="Other" value="1"/>'), quality, F.lit("</meta></camera>")
    )
    documents = table(spark, sf, "part").groupBy(F.floor(k / 100).alias("project")).agg(F.collect_list(camera).alias("cameras"))

    def pack(batches):
        for batch in batches:
            for project, cameras in zip(batch["project"], batch["cameras"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("chunk/doc.xml", "<document><frames><frame>" + "".join(cameras) + "</frame></frames></document>")
                body = out.getvalue()
                if project % 7 == 6:  # no archive at all, or one whose compressed bytes are damaged
                    body = b"PK damaged" if project % 2 else body[:60] + b"\xff" * 40 + body[100:]
                rows = [(f"{project}/frame.zip", body), (f"{project}/notes.txt", b"no archive")]
                yield pd.DataFrame(rows, columns=["name", "content"])

    root = shared_folder(spark, "projects")
    files.land_files(documents.mapInPandas(pack, "name string, content binary"), root).write.format("noop").mode("overwrite").save()
    return archive.read_quality_archive(spark, root)


@query(
    "s7_read_image_lists",
    """SELECT source AS component, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS line_no, regexp_extract(line, '([^/\\\\]*)$', 1) AS filename
    FROM (SELECT source, doc_id, i, trim(regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g')) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, 100000) t(i) WHERE i <= len(parts))
    WHERE line <> ''""",
)
def s7(spark, sf):
    """All lines of all documents as list files, one list per source, in document order."""
    lines = table(spark, sf, "documents").select(
        F.format_string("/lists/%s.imagelist", "source").alias("list_path"),
        "doc_id",
        F.posexplode(F.split("text", "\n")).alias("position", "line"),
    )
    return lists.parse_image_lists(lines, order=["doc_id", "position"])


@query("s7_list_files", "SELECT c_mktsegment AS component, count(*) AS lines, max(printf('IMG_%06d.jpg', c_custkey)) AS last_name FROM customer GROUP BY c_mktsegment")
def s7_files(spark, sf):
    """Customers as real list files, one folder per market segment, read back line by line."""
    root = shared_folder(spark, "lists")
    table(spark, sf, "customer").select(
        F.format_string("/a/b/IMG_%06d.jpg", "c_custkey").alias("value"), "c_mktsegment"
    ).write.partitionBy("c_mktsegment").text(root)
    segment = F.regexp_extract("_metadata.file_path", "c_mktsegment=([^/]*)/", 1)
    lines = spark.read.text(root).select(
        F.concat(segment, F.lit(".imagelist")).alias("list_path"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("within"),
        F.col("value").alias("line"),
    )
    found = lists.parse_image_lists(lines, order=["file", "block", "within"])
    return found.groupBy("component").agg(F.max("line_no").alias("lines"), F.max("filename").alias("last_name"))


@query(
    "s8_read_index",
    f"""WITH {TREE_SQL} SELECT path, name_lower, size, sha256 FROM imported""",
)
def s8(spark, sf):
    """Two trees in one index; reading one prunes the other's folder."""
    location = shared_folder(spark, "index")
    ident = F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("bigint")
    index.write_index(tree(spark, sf), location, "k1", "backup")
    index.write_index(tree(spark, sf).filter(ident % 7 != 0), location, "k1", "import")
    return index.read_index(spark, location, "k1", "import").select("path", "name_lower", "size", "sha256")


@query(
    "s9_write_index",
    f"""WITH {TREE_SQL} SELECT 'backup' AS tree, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM backup
    UNION ALL SELECT 'import', count(*), CAST(sum(size + 1) AS BIGINT) FROM imported""",
)
def s9(spark, sf):
    """A second write of one tree replaces that snapshot and leaves the other alone."""
    location = shared_folder(spark, "index")
    ident = F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("bigint")
    everything = tree(spark, sf)
    index.write_index(everything, location, "k1", "backup")
    index.write_index(everything, location, "k1", "import")
    index.write_index(everything.filter(ident % 7 != 0).withColumn("size", F.col("size") + 1), location, "k1", "import")
    return spark.read.parquet(location).groupBy("tree").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("s9_scan_key", "SELECT c_custkey, sha1(lower('/Import/' || c_name) || '|' || lower('/Backup/' || c_mktsegment)) AS scan_key FROM customer")
def s9_key(spark, sf):
    key = index.scan_key(F.concat(F.lit("/Import/"), "c_name"), F.concat(F.lit("/Backup/"), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", key.alias("scan_key"))


def report_plan(spark, sf):
    rows = described(spark, sf)
    return rows.withColumns(
        {
            "dest_path": names.join_path(F.lit("/out"), "date_str", "lens", names.base_name("path")),
            "status": F.when(F.col("o_orderkey") % 2 == 0, "missing").otherwise("present"),
        }
    )


REPORT_SQL = """'/out/' || date_str || '/' || lens || '/' || regexp_extract(path, '([^/]*)$', 1)"""


@query(
    "s10_write_report_csv",
    f"""WITH {DESCRIBED_SQL} SELECT path AS original, date_str AS date, date_source AS source, {REPORT_SQL} AS destination,
    CASE WHEN o_orderkey % 2 = 0 THEN 'missing' ELSE 'present' END AS status FROM described""",
)
def s10(spark, sf):
    location = shared_folder(spark, "report")
    sinks.write_report_csv(report_plan(spark, sf), location)
    schema = ", ".join(f"{c} string" for c in sinks.REPORT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(location)


@query(
    "s11_write_debug_json",
    f"""WITH {DESCRIBED_SQL} SELECT regexp_extract(path, '([^/]*)$', 1) AS file, path, date_str, date_source, {REPORT_SQL} AS dest FROM described""",
)
def s11(spark, sf):
    location = shared_folder(spark, "debug")
    sinks.write_debug_json(report_plan(spark, sf), location)
    return spark.read.schema("file string, path string, date_str string, date_source string, dest string").json(location)


@query("s12_export_quality_csv", f"SELECT * FROM ({EXPORT_SQL}) ORDER BY path")
def s12(spark, sf):
    """The export written as CSV, compressed, and read back with its own types."""
    location = shared_folder(spark, "export")
    results = export_input(spark, sf)
    sinks.export_quality_csv(results, location, compression="gzip")
    read = spark.read.schema(export_rows(results).schema).option("header", True).option("escape", '"').option("emptyValue", "").csv(location)
    texts = [c for c, kind in read.dtypes if kind == "string"]
    return read.fillna("", subset=texts)


@query("s13_ingest_new_files", FOLDER_BYTES_SQL)
def s13(spark, sf):
    """Two runs over a growing folder; the second one opens only what was added."""
    root, location = (shared_folder(spark, f"ingest-{part}") for part in ("files", "index"))
    docs = table(spark, sf, "documents").select("text", "lang", "source")
    early = F.crc32(F.col("text").cast("binary")) % 2 == 0
    for part in (docs.filter(early), docs.filter(~early)):
        part.write.mode("append").partitionBy("lang", "source").text(root)
        ingest.ingest_new_files(spark, root, location, extensions=(".txt",))
    return folder_bytes(spark.read.parquet(location), "size")


@query(
    "s3_backup_plan",
    """SELECT printf('/%d/IMG_%06d.jpg', c_nationkey, c_custkey) AS name, octet_length(encode(c_mktsegment))::BIGINT AS size,
      printf('/photo/IMG_%06d%s.jpg', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '_1' ELSE '' END) AS dest
    FROM customer WHERE c_custkey % 3 = 0""",
)
def s3_backup_plan(spark, sf):
    """Customers as files of a backup tree, two thirds of them imported; every second name is taken at the destination.

    The plan runs twice through one index: the second run opens no unchanged file and says the same.
    """
    root = shared_folder(spark, "backup")
    c = F.col("c_custkey")
    rows = spread_files(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "c_nationkey", F.col("c_mktsegment").cast("binary").alias("content"))
    name = F.format_string("%d/IMG_%06d.jpg", "c_nationkey", c)
    taken = rows.filter(c % 2 == 0).select(F.format_string("photo/IMG_%06d.jpg", c).alias("name"), F.lit(b"other").alias("content"))
    for folder, part in (("backup", rows), ("import", rows.filter(c % 3 != 0))):
        files.land_files(part.select(name.alias("name"), "content"), f"{root}/{folder}").write.format("noop").mode("overwrite").save()
    files.land_files(taken, f"{root}/out").write.format("noop").mode("overwrite").save()
    plan = rc.TransferPlan(f"{root}/out", folder_media=True)
    for _ in range(2):
        found = backup.incremental_plan(spark, f"{root}/import", f"{root}/backup", f"{root}/index", plan)
    return found.select(
        F.regexp_extract("path", "/backup(/[^/]+/[^/]+)$", 1).alias("name"), "size", F.regexp_extract("dest_path", "/out(/.*)$", 1).alias("dest")
    )
