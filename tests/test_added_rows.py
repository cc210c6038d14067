"""Batches of a stream are written beside the buckets: none rewrites the table, and folders of added rows stay few."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framewright.sources import snapshots
from framewright.sources.snapshots import Store
from framewright.streaming import continuous


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, size bigint")


def content(spark, s, at=None):
    return sorted((r.path, r["size"]) for r in snapshots.read(spark, s, at).collect())


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "table"), "path string, size bigint", ("path",), 4)


def test_a_stream_does_not_write_the_table_again(spark, tmp_path):
    folder, table = tmp_path / "in", continuous.ingested(str(tmp_path / "table"), 1)
    folder.mkdir()
    for n in range(6):
        (folder / f"{n}.jpg").write_bytes(b"x" * (n + 1))
    continuous.pick_up(spark, str(folder), table, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()
    assert len(snapshots.versions(spark, table)) == 6 and snapshots.read(spark, table).count() == 6
    every = spark.read.schema(table.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/table/data")
    assert every.count() == 6, "each row is written once"


def test_a_new_stream_replaces_rewritten_files_only(spark, tmp_path):
    folder, table = tmp_path / "in", continuous.ingested(str(tmp_path / "table"), 4)
    folder.mkdir()

    def run(where):
        continuous.pick_up(spark, str(folder), table, str(tmp_path / where), files_per_batch=2).awaitTermination()
        return {r.path.rsplit("/", 1)[1]: (r["size"], r.sha256) for r in snapshots.read(spark, table).collect()}

    for n in range(3):
        (folder / f"{n}.jpg").write_bytes(b"x" * (n + 1))
    (folder / "notes.txt").write_bytes(b"no image")
    first = run("one")
    (folder / "1.jpg").write_bytes(b"another")
    (folder / "3.jpg").write_bytes(b"late")
    second = run("two")
    assert snapshots.read(spark, table).count() == 4 and second["1.jpg"][0] == 7 and second["1.jpg"] != first["1.jpg"]
    assert {n: second[n] for n in ("0.jpg", "2.jpg")} == {n: first[n] for n in ("0.jpg", "2.jpg")}


def test_added_folders_are_folded_and_old_snapshots_stay(spark, store, monkeypatch):
    monkeypatch.setattr(snapshots, "FOLD", 2)
    seen = [snapshots.manifest(spark, store)]
    for n in range(7):
        seen.append(snapshots.add_rows(spark, store, rows(spark, (f"p{n}", n), (f"p{n}", n - 1), (None, 9)), seen[-1], ("stream", n)))
    for n, at in enumerate(seen):
        assert content(spark, store, at) == [(f"p{k}", k) for k in range(n)]
    assert sorted(seen[-1].added.values()) == [0, 1, 2] and seen[-1].folders == {}
    assert snapshots.add_rows(spark, store, rows(spark, ("p9", 9)), seen[-1], ("stream", 6)) == seen[-1]
    snapshots.expire(spark, store, keep=1)
    assert snapshots.versions(spark, store) == [7] and content(spark, store) == [(f"p{k}", k) for k in range(7)]
    assert sorted(f"data/{p.name}" for p in Path(store.location, "data").iterdir()) == sorted(seen[-1].added)


def test_changes_deal_added_rows_out(spark, store):
    at = snapshots.apply_changes(spark, store, rows(spark, *[(f"p{n}", n) for n in range(20)]))
    at = snapshots.add_rows(spark, store, rows(spark, ("a", 1), ("b", 2)), at, ("stream", 0))
    none = snapshots.apply_changes(spark, store, rows(spark), batch=("stream", 1))
    assert (none.folders, none.added) == (at.folders, at.added)
    now = snapshots.apply_changes(spark, store, rows(spark, ("a", 7), ("b", 0), ("p3", 33)), deleted=F.col("path") == "b")
    assert now.added == {} and now.batches == {"stream": 1}
    assert dict(content(spark, store)) == {f"p{n}": n for n in range(20)} | {"a": 7, "p3": 33}
    assert len(content(spark, store)) == 21


def test_another_writer_comes_before_added_rows(spark, store):
    at = snapshots.add_rows(spark, store, rows(spark, ("a", 1)), snapshots.manifest(spark, store), ("one", 0))
    snapshots.apply_changes(spark, store, rows(spark, ("b", 1), ("c", 1)))
    assert snapshots.manifest(spark, store, known=at).version == 2
    late = snapshots.add_rows(spark, store, rows(spark, ("b", 5), ("d", 5)), at, ("one", 1))
    assert late.version == 3 and content(spark, store) == [("a", 1), ("b", 5), ("c", 1), ("d", 5)]
    assert snapshots.manifest(spark, store, known=late) is late
    snapshots.apply_changes(spark, store, rows(spark, ("e", 1)))
    snapshots.expire(spark, store, keep=1)
    assert snapshots.manifest(spark, store, known=at).version == 4, "a known snapshot that is gone is not the last one"
