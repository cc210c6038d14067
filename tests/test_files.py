"""Real files: PNG decoding, headers, archives, lists, index, stream, and both end-to-end jobs."""

import hashlib
import io
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import rasters
from framewright.config import QualityParams
from framewright.operators import reconcile as rc
from framewright.plans import backup, quality
from framewright.sources import archive, files, index, lists, snapshots, tags
from framewright.streaming import ingest


def tiff(entries, order="<"):
    """Header with one folder; entries are (tag, kind, count, 4 value bytes)."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries)
    return mark + struct.pack(order + "I", 8) + body + b"\0\0\0\0"


@pytest.fixture(scope="module")
def shoot(tmp_path_factory):
    root = tmp_path_factory.mktemp("shoot")
    (root / "sub").mkdir()
    scene = np.kron(np.random.default_rng(4).integers(0, 256, (24, 56)), np.ones((6, 6))).astype(np.uint8)
    frames = {"a1.png": scene[:, :192], "a2.PNG": scene[:, 48:240], "a3.png": scene[:, 96:288], "sub/copy.png": scene[:, :192]}
    for name, image in frames.items():
        (root / name).write_bytes(rasters.png_bytes(rasters.bgr(image)))
    (root / "flat.png").write_bytes(rasters.png_bytes(np.full((96, 128), 128, np.uint8)))
    (root / "deep.png").write_bytes(rasters.png_bytes(np.full((20, 20), 0x1234, np.uint16)))
    (root / "deep.tif").write_bytes(tiff([(0x0102, 3, 1, b"\x10\0\0\0")]))
    (root / "broken.png").write_bytes(b"text")
    (root / "notes.txt").write_bytes(b"no image")
    return str(root)


def test_scan_and_load(spark, shoot):
    found = {r.path.rsplit("/", 1)[1] for r in files.scan_media(spark, shoot).collect()}
    assert found == {"a1.png", "a2.PNG", "a3.png", "copy.png", "flat.png", "deep.png", "deep.tif", "broken.png"}
    assert not {"copy.png"} & {r.path.rsplit("/", 1)[1] for r in files.scan_media(spark, shoot, recursive=False).collect()}
    loaded = {r.path.rsplit("/", 1)[1]: r for r in files.load_rasters(spark, shoot).collect()}
    assert loaded["flat.png"].n_channels == 1 and loaded["flat.png"].data == bytes([128]) * 96 * 128
    assert (loaded["a1.png"].height, loaded["a1.png"].width, loaded["a1.png"].n_channels) == (144, 192, 3)
    assert loaded["broken.png"].is_error and loaded["broken.png"].data is None
    assert loaded["deep.png"].data == bytes([0x12]) * 400 and loaded["deep.png"].load_note == files.NOTE_DEPTH
    assert loaded["deep.tif"].is_error and loaded["deep.tif"].load_note == files.NOTE_UNDECODABLE, "a header without pixels"
    assert len(loaded) == 8 + 1, "each file once"
    assert "file:" not in loaded["a1.png"].path


def test_measures_and_keypoints_come_from_one_decoding_stage(spark, shoot):
    stats = quality.image_stats(files.load_rasters(spark, shoot).drop("is_error"), ["path"], "turn_tag", keypoints=True)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") == 1 and plan.count("Exchange") == 0
    assert {"blocks", "cdf_green", "kp_x", "descriptors"} <= set(stats.columns)


def test_scan_reads_no_content(spark, shoot):
    plan = files.scan_media(spark, shoot)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_quality_run_with_overlap(spark, shoot):
    p = QualityParams(sift_n_features=800)
    rows = {r.path.rsplit("/", 1)[1]: r for r in quality.quality_run(spark, shoot, p, with_overlap=True).collect()}
    assert "notes.txt" not in rows and len(rows) == 8
    assert rows["broken.png"].is_error and rows["broken.png"].is_blurry and rows["broken.png"].width == 0
    assert rows["broken.png"].load_note == files.NOTE_UNDECODABLE
    assert not rows["a1.png"].is_blurry and rows["flat.png"].is_blurry
    assert rows["copy.png"].duplicate_of.endswith("/a1.png") and rows["a1.png"].duplicate_of is None
    assert rows["a1.png"].overlap_next == pytest.approx(0.75, abs=0.05)  # the scene moves by a quarter
    assert rows["a2.PNG"].overlap_next == pytest.approx(0.75, abs=0.05)
    assert rows["copy.png"].overlap_next is None  # last in path order
    assert rows["a1.png"].file_size > 0 and len(rows["a1.png"].md5) == 32


@pytest.mark.parametrize("order", ["<", ">"])
def test_header_tags_both_byte_orders(spark, order):
    short = lambda v: struct.pack(order + "H", v) + b"\0\0"
    body = tiff([(0x0110, 2, 3, b"X1\0\0"), (0x0112, 3, 1, short(6)), (0x8827, 3, 1, short(400))], order)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xd9"
    rows = [("t.tif", body), ("j.jpg", jpeg), ("cut.jpg", jpeg[:30]), ("x.png", b"nothing"), ("none", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    meta = {r.path: r.exif for r in tags.normalise_metadata(tags.extract_tags(df)).collect()}
    for name in ("t.tif", "j.jpg"):
        assert (meta[name].model, meta[name].orientation, meta[name].iso, meta[name].gps) == ("X1", 6, 400.0, None)
    assert set(meta) <= {"t.tif", "j.jpg", "cut.jpg"}


def test_metadata_rules(spark):
    rows = [
        ("a", "make", "  "), ("a", "iso", "-5"), ("a", "aperture", "nan"), ("a", "shutter", "0.01"), ("a", "focal_length", "x"),
        ("a", "lat", "10.0 30.0 36.0"), ("a", "lat_ref", "south"), ("a", "lon", "20.0 0.0 0.0"), ("a", "lon_ref", "E"),
        ("b", "lat", "1 2 3"), ("b", "lat_ref", "N"), ("b", "orientation", "0"),
    ]
    meta = {r.path: r.exif for r in tags.normalise_metadata(spark.createDataFrame(rows, "path string, tag string, value string")).collect()}
    a = meta["a"]
    assert (a.make, a.iso, a.aperture, a.shutter, a.focal_length) == (None, None, None, 0.01, None)
    assert (a.gps.lat, a.gps.lon) == (-10.51, 20.0)
    assert meta["b"].gps is None and meta["b"].orientation == 1


def test_quality_archive(spark, tmp_path):
    def write(folder, xml, member="doc.xml"):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "frame.zip", "w") as z:
            z.writestr(member, xml)

    camera = '<camera camera_id="{0}"><photo path="D:\\x\\{0}.jpg"/><meta><property name="Image/Quality" value="{1}"/></meta></camera>'
    write("0", "<d><cameras>" + camera.format(1, "0.8") + camera.format(2, "0.3") + '<camera camera_id="3"/>' + camera.format(4, "bad") + "</cameras></d>")
    write("1", "<d/>", member="other.xml")
    (tmp_path / "2").mkdir()
    (tmp_path / "2" / "frame.zip").write_bytes(b"PK broken")
    write("3", "<d>" + camera.format(7, "0.9") + "</d>")
    write("4", "<d><camera camera_id='5'><photo path='a.jpg'></camera></d>")  # not well-formed
    with zipfile.ZipFile(tmp_path / "3" / "frame.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.xml", "<d>" + camera.format(7, "0.9") * 50 + "</d>")
    body = bytearray((tmp_path / "3" / "frame.zip").read_bytes())
    body[45:70] = b"\xff" * 25  # a damaged deflate stream
    (tmp_path / "3" / "frame.zip").write_bytes(bytes(body))
    got = archive.read_quality_archive(spark, str(tmp_path)).collect()
    assert [(r.camera_id, r.filename, r.quality) for r in got] == [("2", "2.jpg", 0.3), ("1", "1.jpg", 0.8)]


def test_image_lists(spark, tmp_path):
    (tmp_path / "north.imagelist").write_text("  /a/1.jpg\n\nC:\\b\\2.jpg  \n \n3.jpg\n")
    (tmp_path / "south.txt").write_text("/a/1.jpg\n")
    got = sorted((r.component, r.line_no, r.filename) for r in lists.read_image_lists(spark, str(tmp_path)).collect())
    assert got == [("north", 1, "1.jpg"), ("north", 2, "2.jpg"), ("north", 3, "3.jpg"), ("south", 1, "1.jpg")]


def test_index_snapshots(spark, tmp_path):
    location = str(tmp_path / "index")
    rows = lambda n: spark.range(n).select(
        F.format_string("/x/%d", "id").alias("path"), F.format_string("%d", "id").alias("name_lower"), F.col("id").alias("size"),
        F.timestamp_seconds("id").alias("mtime"), F.lit(None).cast("string").alias("sha256"))
    index.write_index(rows(5), location, "k", "import")
    index.write_index(rows(9), location, "k", "backup")
    index.write_index(rows(3), location, "k", "import")
    index.write_index(rows(3), location, "k", "import")
    read = lambda t: index.read_index(spark, location, "k", t, index.INDEX_SCHEMA)
    assert read("import").count() == 3 and read("backup").count() == 9
    assert "PartitionFilters: [isnotnull(scan_key" in read("import")._jdf.queryExecution().executedPlan().toString()
    index.write_index(rows(0), location, "k", "import")
    assert read("import").count() == 0 and read("backup").count() == 9
    index.write_index(rows(2), location, "k", "import")
    index.clear_index(spark, location, "k", "import")
    assert read("import").count() == 0 and read("backup").count() == 9


def test_ingest_takes_each_file_once_whatever_its_date(spark, tmp_path):
    inbox, location = (str(tmp_path / n) for n in ("inbox", "index"))
    (tmp_path / "inbox").mkdir()
    run = lambda: ingest.ingest_new_files(spark, inbox, location)
    (tmp_path / "inbox" / "A.JPG").write_bytes(b"one")
    (tmp_path / "inbox" / "a.txt").write_bytes(b"skipped")
    run()
    (tmp_path / "inbox" / "b.cr3").write_bytes(b"two")
    old = tmp_path / "inbox" / "old.jpg"
    old.write_bytes(b"from a card")
    os.utime(old, (1_500_000_000, 1_500_000_000))
    run()
    run()
    got = sorted((r.name_lower, r.size, r.sha256) for r in spark.read.parquet(location).collect())
    assert [g[:2] for g in got] == [("a.jpg", 3), ("b.cr3", 3), ("old.jpg", 11)]
    assert got[2][2] == hashlib.sha256(b"from a card").hexdigest()


def test_unchanged_files_are_not_opened_and_deleted_ones_leave(spark, tmp_path):
    root, location = str(tmp_path / "tree"), str(tmp_path / "index")
    (tmp_path / "tree").mkdir()
    for name, body in {"a.jpg": b"1", "b.jpg": b"22"}.items():
        (tmp_path / "tree" / name).write_bytes(body)
    read = lambda: {r.name_lower: r.sha256 for r in snapshots.read(spark, backup.tree_store(location, "k", "import")).collect()}
    backup.refreshed_tree(spark, root, location, "k", "import")
    assert read()["a.jpg"] == hashlib.sha256(b"1").hexdigest()
    stat = (tmp_path / "tree" / "a.jpg").stat()
    (tmp_path / "tree" / "a.jpg").write_bytes(b"9")  # same size, and the time is set back: not opened again
    os.utime(tmp_path / "tree" / "a.jpg", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (tmp_path / "tree" / "c.jpg").write_bytes(b"333")
    (tmp_path / "tree" / "b.jpg").unlink()
    backup.refreshed_tree(spark, root, location, "k", "import")
    assert read() == {"a.jpg": hashlib.sha256(b"1").hexdigest(), "c.jpg": hashlib.sha256(b"333").hexdigest()}


def test_files_beyond_the_content_limit_are_hashed(spark, tmp_path):
    (tmp_path / "long.mov").write_bytes(b"x" * 5_000_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        rows = backup.tree(spark, str(tmp_path), use_hash=True).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [r.sha256 for r in rows] == [hashlib.sha256(b"x" * 5_000_000).hexdigest()]


def test_unknown_hashes_are_equal(spark):
    kind = "path string, name_lower string, size bigint, sha256 string"
    one, two = (spark.createDataFrame([(p, "a.jpg", 5, None)], kind) for p in ("/x/a.jpg", "/y/a.jpg"))
    assert rc.missing_files(one, two, True).count() == 0 and rc.present_files(one, two, True).count() == 1


def test_backup_comparison(spark, tmp_path):
    for name, body in {"import/x/one.jpg": b"1", "import/backup/two.jpg": b"22", "import/backup/ONE.JPG": b"1", "import/backup/three.mov": b"333", "out/video/three.mov": b"other"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    root, inner, out = (str(tmp_path / n) for n in ("import", "import/backup", "out"))
    for use_hash in (False, True):
        ours, theirs = backup.tree(spark, root, use_hash=use_hash), backup.tree(spark, inner, use_hash=use_hash)
        records = spark.createDataFrame([], "path string, DateTimeOriginal string, CreateDate string, MediaCreateDate string, Model string, LensModel string, LensID string, LensSpec string, FocalLength string")
        plan = rc.TransferPlan(out, folder_media=True)
        got = {r.path.rsplit("/", 1)[1]: r for r in backup.compare(ours, theirs, inner, records, backup.listing(spark, out), plan, use_hash).collect()}
        assert set(got) == {"two.jpg", "three.mov"}
        assert got["three.mov"].dest_path == f"{out}/video/three_1.mov" and got["three.mov"].date_source == "filesystem"
        assert got["two.jpg"].dest_path == f"{out}/photo/two.jpg" and got["two.jpg"].status == "missing"


def test_metadata_records_of_photos_and_movies(spark, tmp_path):
    body = tiff([(0x9004, 2, 20, struct.pack("<I", 38)), (0xA434, 2, 4, b"Z50\0")]) + b"2021:03:04 05:06:07\0"
    (tmp_path / "a.tif").write_bytes(body)
    box = lambda kind, content: struct.pack(">I", 8 + len(content)) + kind + content
    seconds = 3_692_217_600  # 2020-12-31 after 1904
    header = box(b"mvhd", b"\0\0\0\0" + struct.pack(">I", seconds) + bytes(90))
    (tmp_path / "b.mov").write_bytes(box(b"ftyp", b"qt  ") + box(b"mdat", bytes(400_000)) + box(b"moov", header))
    (tmp_path / "c.mp4").write_bytes(b"no boxes")
    listing = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.tif", "b.mov", "c.mp4", "gone.jpg")], "path string")
    rows = {r.path.rsplit("/", 1)[1]: r for r in backup.records(listing).collect()}
    assert (rows["a.tif"].CreateDate, rows["a.tif"].LensModel) == ("2021-03-04", "Z50")
    assert rows["b.mov"].MediaCreateDate == "2020-12-31" and rows["c.mp4"].MediaCreateDate is None
    assert rows["gone.jpg"].Model is None
