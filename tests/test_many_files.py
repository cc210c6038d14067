"""Many files: listed and opened by tasks, in bounded pieces, with the rows that Spark's own reader lists."""

import os

import pandas as pd
import pytest

from framewright.plans import backup
from framewright.queries import containers
from framewright.sources import archive, files, walk


@pytest.fixture
def folder(tmp_path):
    for name in ("a.jpg", "b/c.jpg", "b/_d.jpg", "b/.e.jpg", "_f/g.jpg", ".h/i.jpg", "_k=1/l.jpg", "b/m._COPYING_", "b/n o.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "b/empty.jpg").write_bytes(b"")
    return tmp_path


@pytest.mark.parametrize("scheme", ("", "file://"))
def test_listing_by_tasks_has_the_rows_of_sparks_reader(spark, folder, scheme):
    root = f"{scheme}{folder}"
    mine = sorted(tuple(r) for r in files.list_files(spark, root).collect())
    assert mine == sorted(tuple(r) for r in files.read_files(spark, root).select("path", "modificationTime", "length").collect())
    assert len(mine) == 4


def test_a_large_folder_leaves_its_task_in_pieces(spark, folder, monkeypatch):
    seen = walk.list_folder(str(folder / "b"))
    assert not isinstance(seen, list)
    (folder / "b/link").symlink_to(folder / "a.jpg")
    (folder / "b/nowhere").symlink_to(folder / "gone")
    found = {os.path.basename(r[0]): r for r in seen}
    assert found["link"][1] == str((folder / "a.jpg").resolve()) and found["link"][3] == 5
    assert "nowhere" not in found and len(found) == 7


def _parts(spark, tmp_path, n):
    rows = [(k, f"brand {k}", f"type {k}", f"name {k}", 1 + k % 50) for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_name string, p_size int").coalesce(1).write.parquet(
        f"{tmp_path}/part.parquet"
    )
    return str(tmp_path)


def test_container_files_are_written_and_listed_by_tasks(spark, tmp_path):
    listing = containers.landed_containers(spark, _parts(spark, tmp_path, 2500))
    paths = listing.toPandas()["path"]
    assert len(paths) == 2500
    assert paths.map(os.path.dirname).value_counts().max() <= 1000
    assert "binaryFile" not in listing._jdf.queryExecution().toString()  # Spark's reader would list them on the driver


def test_files_are_opened_by_several_tasks(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"x")
    one = spark.createDataFrame(pd.DataFrame({"path": [str(tmp_path / "x.jpg")] * 50})).coalesce(1)
    assert files.probe_files(one, ("md5",)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.probe_files(one, ("md5",)).count() == 50


def test_destination_and_archives_are_listed_by_tasks(spark, folder):
    for found in (backup.listing(spark, str(folder)), archive.archives_below(spark, str(folder))):
        assert "binaryFile" not in found._jdf.queryExecution().toString()
