"""Tables that change by whole snapshots: writes that end half-way, other writers, repeated batches."""

import pytest
from pyspark.sql import functions as F

from framewright.plans import backup
from framewright.sources import shared, snapshots
from framewright.sources.snapshots import Store
from framewright.streaming import continuous


def store(tmp_path, buckets=4):
    return Store(str(tmp_path / "table"), "path string, size bigint", ("path",), buckets)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, size bigint")


def content(spark, s, at=None):
    return {r.path: r["size"] for r in snapshots.read(spark, s, at).collect()}


def test_changes_and_pinned_readers(spark, tmp_path):
    s = store(tmp_path)
    assert content(spark, s) == {} and snapshots.versions(spark, s) == []
    one = snapshots.apply_changes(spark, s, rows(spark, ("a", 1), ("b", 2), ("c", 3), (None, 9), ("b", 1)))
    reader = snapshots.read(spark, s)
    two = snapshots.apply_changes(spark, s, rows(spark, ("a", 7), ("b", 0), ("d", 4)), deleted=F.col("path") == "b")
    assert content(spark, s) == {"a": 7, "c": 3, "d": 4} and (one.version, two.version) == (1, 2)
    assert {r.path for r in reader.collect()} == {"a", "b", "c"}, "a reader keeps its snapshot"
    assert content(spark, s, one) == {"a": 1, "b": 2, "c": 3}, "of several rows of a key the largest counts"
    same = snapshots.apply_changes(spark, s, rows(spark))
    assert same == two, "nothing to change makes no snapshot"


def test_only_touched_buckets_are_written(spark, tmp_path):
    s = store(tmp_path, 16)
    one = snapshots.apply_changes(spark, s, rows(spark, *[(f"p{i}", i) for i in range(200)]))
    two = snapshots.apply_changes(spark, s, rows(spark, ("p5", 50)))
    assert len(one.folders) == 16
    assert sum(one.folders[b] != two.folders[b] for b in one.folders) == 1
    all_gone = snapshots.apply_changes(spark, s, snapshots.read(spark, s), deleted=F.lit(True))
    assert all_gone.folders == {} and content(spark, s) == {}


@pytest.mark.parametrize("when", ["before the data", "before the manifest"])
def test_a_write_that_ends_half_way_leaves_the_old_snapshot(spark, tmp_path, monkeypatch, when):
    s = store(tmp_path)
    snapshots.apply_changes(spark, s, rows(spark, ("a", 1), ("b", 2)))

    def fail(*_):
        raise OSError("the process is gone")

    with monkeypatch.context() as patch:
        if when == "before the data":
            patch.setattr(snapshots, "_merge", fail)
        else:
            patch.setattr(snapshots._Files, "publish", fail)
        with pytest.raises(OSError, match="gone"):
            snapshots.apply_changes(spark, s, rows(spark, ("a", 5)))
    assert content(spark, s) == {"a": 1, "b": 2} and snapshots.versions(spark, s) == [1]
    snapshots.apply_changes(spark, s, rows(spark, ("a", 6)))
    assert content(spark, s) == {"a": 6, "b": 2}


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer comes between the reading and the publishing of the first; nothing of either is lost."""
    s = store(tmp_path, 2)
    snapshots.apply_changes(spark, s, rows(spark, ("a", 1)))
    merge, calls = snapshots._merge, []

    def overtaken(*args):
        made = merge(*args)
        calls.append(1)
        if len(calls) == 1:
            snapshots.apply_changes(spark, s, rows(spark, *[(f"other{i}", i) for i in range(8)]))
        return made

    monkeypatch.setattr(snapshots, "_merge", overtaken)
    made = snapshots.apply_changes(spark, s, rows(spark, ("a", 2), ("b", 3)))
    assert made.version == 3 and content(spark, s) == {"a": 2, "b": 3} | {f"other{i}": i for i in range(8)}


def test_a_manifest_is_published_once(spark, tmp_path):
    files = snapshots._Files(spark, str(tmp_path))
    (tmp_path / "m").mkdir()
    assert files.publish("one", f"{tmp_path}/m/1.json") and not files.publish("two", f"{tmp_path}/m/1.json")
    assert files.read(f"{tmp_path}/m/1.json") == "one"
    assert [n for n in files.names(f"{tmp_path}/m") if not n.endswith(".crc")] == ["1.json"]


def test_repeated_batches_write_nothing_twice(spark, tmp_path):
    s = store(tmp_path)
    first = snapshots.apply_changes(spark, s, rows(spark, ("a", 1)), batch=("stream", 0))
    again = snapshots.apply_changes(spark, s, rows(spark, ("a", 99)), batch=("stream", 0))
    assert again == first and content(spark, s) == {"a": 1}
    other = snapshots.apply_changes(spark, s, rows(spark, ("b", 2)), batch=("other", 0))
    assert other.batches == {"stream": 0, "other": 0}
    empty = snapshots.apply_changes(spark, s, rows(spark), batch=("stream", 1))
    assert empty.batches["stream"] == 1 and empty.folders == other.folders


def test_expire(spark, tmp_path):
    s = store(tmp_path)
    for n in range(4):
        snapshots.apply_changes(spark, s, rows(spark, ("a", n), (f"b{n}", n)))
    before = content(spark, s)
    snapshots.expire(spark, s, keep=1)
    assert snapshots.versions(spark, s) == [4] and content(spark, s) == before
    snapshots.apply_changes(spark, s, rows(spark, ("z", 1)))
    assert content(spark, s) == before | {"z": 1}


def test_stream_restarts_repeats_and_catches_up(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    (folder / "deep").mkdir(parents=True)
    table = continuous.ingested(str(tmp_path / "table"), 4)

    def run(where=checkpoint):
        continuous.pick_up(spark, str(folder), table, where, files_per_batch=2).awaitTermination()
        return {r.path.rsplit("/", 1)[1]: r for r in snapshots.read(spark, table).collect()}

    for n in range(5):
        (folder / "deep" / f"{n}.jpg").write_bytes(b"x" * (n + 1))
    (folder / "notes.txt").write_bytes(b"no image")
    assert set(run()) == {f"{n}.jpg" for n in range(5)}
    at = snapshots.manifest(spark, table)
    assert list(at.batches.values()) == [2], "five files in batches of two"
    (folder / "6.JPG").write_bytes(b"late")
    got = run()
    assert len(got) == 6 and got["6.JPG"].name_lower == "6.jpg" and len(got["6.JPG"].sha256) == 64
    # A batch whose end was not noted by the stream runs again; the table has it already.
    at = snapshots.manifest(spark, table)
    last = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == got and snapshots.manifest(spark, table) == at
    # A new stream over the same folder adds nothing either.
    assert run(str(tmp_path / "other")) == got
    # Rewritten and deleted files are for catch_up.
    (folder / "deep" / "1.jpg").write_bytes(b"longer than before")
    (folder / "deep" / "2.jpg").unlink()
    assert run()["1.jpg"]["size"] == 2
    continuous.catch_up(spark, str(folder), table)
    now = {r.path.rsplit("/", 1)[1]: r for r in snapshots.read(spark, table).collect()}
    assert set(now) == set(got) - {"2.jpg"} and now["1.jpg"]["size"] == 18 and now["1.jpg"].sha256 != got["1.jpg"].sha256
    assert now["0.jpg"] == got["0.jpg"]


def test_failed_reads_are_not_cached(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"no tags")
    there = spark.createDataFrame([(str(tmp_path / n), 7) for n in ("a.jpg", "b.jpg")], "path string, size bigint")
    listing = there.withColumn("mtime", F.timestamp_seconds(F.lit(1_600_000_000)))
    for _ in range(2):
        rows_ = backup.cached_metadata(spark, listing, str(tmp_path / "index"), "k").collect()
        assert {(r.path.rsplit("/", 1)[1], r.date_str, r.date_source) for r in rows_} == {
            ("a.jpg", "2020-09-13", "filesystem"), ("b.jpg", "2020-09-13", "filesystem")
        }
        cached = snapshots.read(spark, backup.metadata_store(str(tmp_path / "index"), "k")).collect()
        assert [r.path.rsplit("/", 1)[1] for r in cached] == ["a.jpg"]


def test_release_deletes_what_an_application_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_run_folder", lambda _: str(tmp_path / "mine"))
    (tmp_path / "other").mkdir()
    kept = shared.materialise(rows(spark, ("a", 1)), "part")
    assert kept.count() == 1 and (tmp_path / "mine").is_dir()
    shared.release(spark)
    assert not (tmp_path / "mine").exists() and (tmp_path / "other").is_dir()
