"""Listing by rounds, links and cycles; archives read by ranges."""

import zipfile

import pytest

from framewright.sources import archive, files
from framewright.sources.walk import is_known, walk


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "a" / "b" / "c").mkdir(parents=True)
    (root / "empty").mkdir()
    for name in ("one.jpg", "a/two.JPG", "a/b/three.png", "a/b/c/four.jpg", "a/notes.txt"):
        (root / name).write_bytes(b"x" * len(name))
    (root / "a" / "none.jpg").write_bytes(b"")
    (root / "a" / "b" / "up").symlink_to(root)  # a cycle
    (root / "again").symlink_to(root / "a")  # a second way to a folder
    (root / "link.jpg").symlink_to(root / "one.jpg")  # a second name of a file
    (root / "broken.jpg").symlink_to(root / "gone.jpg")
    return root


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_walk_ends_and_lists_each_folder_once(spark, tree):
    found = walk(spark, str(tree), tasks=3).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == sorted(
        ["one.jpg", "link.jpg", "two.JPG", "none.jpg", "notes.txt", "three.png", "four.jpg"]
    )
    sizes = {r.path.rsplit("/", 1)[1]: r.length for r in found}
    assert sizes["none.jpg"] == 0 and sizes["three.png"] == len("a/b/three.png")
    assert all(r.modificationTime is not None for r in found)


def test_a_catalog_has_each_file_once(spark, tree):
    got = files.scan_media(spark, [str(tree), str(tree / "a"), str(tree / "one.jpg"), f"file://{tree}/again"])
    assert names(got) == sorted(["link.jpg", "two.JPG", "none.jpg", "three.png", "four.jpg"]), "the lowest of the paths of a file"
    assert names(files.scan_media(spark, str(tree), recursive=False)) == ["link.jpg"]
    assert names(files.scan_media(spark, str(tree / "a" / "two.JPG"))) == ["two.JPG"]
    assert files.scan_media(spark, str(tree / "empty")).collect() == []


def test_places_that_tasks_cannot_list_go_to_spark(spark, tree):
    assert not is_known("nosuch://x/y") and not is_known(f"{tree}/*.jpg") and is_known(str(tree)) and is_known(f"file://{tree}")
    assert names(files.scan_media(spark, f"{tree}/a/*.JPG")) == ["two.JPG"]
    with pytest.raises(FileNotFoundError):
        files.scan_media(spark, str(tree / "gone"))


def camera(k, photo="IMG.jpg", quality="0.5", more=""):
    return f'<camera camera_id="{k}">{more}<photo path="d:/x/{photo}"/><meta><property name="Image/Quality" value="{quality}"/></meta></camera>'


def put(path, document, member="chunk/doc.xml", pad=0):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        if pad:
            z.writestr(zipfile.ZipInfo("thumbnails.bin"), bytes(pad), zipfile.ZIP_STORED)
        if member:
            z.writestr(member, document)


def test_archives(spark, tmp_path):
    for k in range(6):
        (tmp_path / str(k)).mkdir()
    nested = "<group><camera camera_id='8'><photo path='y.jpg'/><meta><property name='Other' value='9'/></meta></camera>" + camera(9) + "</group>"
    put(tmp_path / "0" / "frame.zip", f"<doc><cameras>{camera(1)}{camera(2, quality='none')}{nested}<camera/></cameras></doc>", pad=3_000_000)
    put(tmp_path / "1" / "frame.zip", "<doc>" + camera(5) + "<cameras>")
    put(tmp_path / "2" / "frame.zip", "", member=None)
    (tmp_path / "3" / "frame.zip").write_bytes(b"PK no archive")
    put(tmp_path / "4" / "frame.zip", "<?xml version='1.0' encoding='iso-8859-1'?><doc>" + camera(3, photo="&#233;.jpg", quality=" 0.25 ") + "</doc>")
    (tmp_path / "5" / "other.zip").write_bytes(b"")
    got = [(r.camera_id, r.filename, r.quality) for r in archive.read_quality_archive(spark, str(tmp_path)).collect()]
    assert got == [("3", "é.jpg", 0.25), ("1", "IMG.jpg", 0.5), ("9", "IMG.jpg", 0.5)]
    bad = {r.path.rsplit("/", 2)[1]: r.problem for r in archive.unreadable_archives(spark, str(tmp_path)).collect()}
    assert set(bad) == {"1", "2", "3"} and "ParseError" in bad["1"] and "no member" in bad["2"] and "BadZipFile" in bad["3"]


def test_many_cameras_are_not_held(tmp_path, monkeypatch):
    """The document of an archive never stands in memory: what is parsed is let go camera by camera."""
    import tracemalloc

    document = "<doc>" + "".join(camera(k, more="<note>" + "y" * 200 + "</note>") for k in range(30_000)) + "</doc>"
    put(tmp_path / "frame.zip", document)
    tracemalloc.start()
    assert sum(1 for r in archive.archive_rows(str(tmp_path / "frame.zip")) if r[4] is None) == 30_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(document) / 5
