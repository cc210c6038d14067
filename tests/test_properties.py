"""Rules that hold for any input, against plain Python."""

import math
import os.path
import random
import re
import statistics
from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.config import DEFAULTS, QualityParams
from framewright.functions import names, photometry, scoring
from framewright.operators import consistency, overlap, reconcile as rc

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
file_names = st.text(st.sampled_from("ab._-1 2"), min_size=1, max_size=8).filter(lambda s: s.strip(".") != "")


@SLOW
@given(st.lists(file_names, min_size=1, max_size=40))
def test_path_parts(spark, parts):
    df = spark.createDataFrame([(f"/r/{p}",) for p in parts], "p string")
    for r in df.select("p", names.base_name("p").alias("n"), names.stem("p").alias("s"), names.suffix("p").alias("x"), names.folder("p").alias("f")).collect():
        want_stem, want_suffix = os.path.splitext(r.p.rsplit("/", 1)[1])
        if want_suffix == ".":  # a trailing dot is no suffix
            want_stem, want_suffix = want_stem + ".", ""
        assert (r.n, r.s, r.x, r.f) == (r.p.rsplit("/", 1)[1], want_stem, want_suffix, "/r")


@pytest.mark.parametrize(
    "raw, shown",
    [("35.0 mm", "35mm"), ("35", "35mm"), ("24,5mm", "24.5mm"), ("24.123456789", "24.1235mm"), ("0.5", "0.5mm"), ("wide", "wide"),
     ("", ""), (None, ""), ("  ", ""), ("50 mm (75)", "50mm"), ("1d", "1d"), ("a/b", "a_b"), ("1e2", "100mm"), ("-3", "-3mm")],
)
def test_focal(spark, raw, shown):
    assert spark.createDataFrame([(raw,)], "x string").select(names.format_focal("x")).first()[0] == shown


@pytest.mark.parametrize(
    "raw, safe", [('a<b>:"/\\|?*c', "a_b" + "_" * 8 + "c"), ("  x.. ", "x"), ("...", ""), (None, ""), (" y\t", "y"), ("a .", "a ")]
)
def test_sanitize(spark, raw, safe):
    assert spark.createDataFrame([(raw,)], "x string").select(names.sanitize_part("x")).first()[0] == safe


@pytest.mark.parametrize(
    "name, base",
    [("image0001_35mm.jpg", "IMAGE0001"), ("img_12.jpg", "IMG_12"), ("DSC_9-x.nef", "DSC_9"), ("_MG_77.cr2", "_MG_77"), ("P0123.arw", "P0123"),
     ("P012.arw", "P012"), ("2024_x.jpg", "2024"), ("trip_7_b.jpg", "TRIP_7"), ("solo.jpg", "SOLO"), ("123.jpg", "123")],
)
def test_camera_base(spark, name, base):
    assert spark.createDataFrame([(name,)], "x string").select(names.camera_base("x")).first()[0] == base


@SLOW
@given(
    st.lists(st.sampled_from(["a", "A", "a_1", "a_2", "a_1_1", "b", "a_01"]), min_size=1, max_size=25),
    st.lists(st.sampled_from(["a", "a_1", "A_3", "a_1_1", "b_2", "c"]), max_size=6),
)
def test_numbered_names_are_free_and_unique(spark, wanted, there):
    requests = spark.createDataFrame([("/d", s, ".x", f"p{i:03d}") for i, s in enumerate(wanted)], "folder string, stem string, suffix string, path string")
    taken = spark.createDataFrame([("/d", s, ".x") for s in there], "folder string, stem string, suffix string")
    got = rc.collision_number(requests, taken, ["path"]).orderBy("path").collect()
    final = [(r.stem + (f"_{r.number}" if r.number else "")).lower() for r in got]
    occupied = {s.lower() for s in there}
    assert len(got) == len(wanted) and len(set(final)) == len(final) and not set(final) & occupied
    for stem in {s.lower() for s in wanted}:
        numbers = [r.number for r in got if r.stem.lower() == stem]
        assert numbers == sorted(numbers)  # in order of the path
        blocked = {n for n in range(max(numbers) + 1) if (stem + (f"_{n}" if n else "")) in occupied or (n and f"{stem}_{n}" in {s.lower() for s in wanted})}
        assert set(numbers) | blocked >= set(range(max(numbers) + 1))  # no number is left out without reason


def test_missing_and_present_make_up_the_backup(spark):
    rng = random.Random(1)
    rows = lambda n: [(f"/p/{i}", f"n{rng.randrange(9)}", rng.randrange(3), None, None) for i in range(n)]
    kind = "path string, name_lower string, size bigint, mtime timestamp, sha256 string"
    backup, imported = spark.createDataFrame(rows(60), kind), spark.createDataFrame(rows(12), kind)
    missing, present = rc.missing_files(backup, imported), rc.present_files(backup, imported)
    both = sorted(r.path for r in missing.union(present).collect())
    assert both == sorted(r.path for r in backup.collect()) and missing.count() and present.count()
    keys = {(r.name_lower, r.size) for r in imported.collect()}
    assert all((r.name_lower, r.size) not in keys for r in missing.collect())


def test_syncing_twice_changes_nothing(spark):
    kind = "path string, name_lower string, size bigint, mtime bigint, sha256 string"
    old = spark.createDataFrame([("a", "a", 1, 1, None), ("b", "b", 1, 1, "x"), ("c", "c", 1, 1, None)], kind)
    now = spark.createDataFrame([("a", "a", 1, 1, None), ("b", "b", 2, 1, "x"), ("d", "d", 1, 1, None)], kind)
    once = rc.sync_index(now, old)
    assert {r.path: r.change for r in once.collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "new"}
    snapshot = once.filter("change <> 'deleted'").drop("change")
    assert {r.change for r in rc.sync_index(now, snapshot).collect()} == {"same"}


def test_marking_duplicates_is_idempotent_and_ignores_order(spark):
    rows = [(f"p{i}", ["", "h1", "h2", "h3"][i % 4] if i < 30 else f"u{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "path string, md5 string")
    once = consistency.mark_duplicates(df.repartition(5))
    again = consistency.mark_duplicates(once.repartition(3))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    marks = {r.path: r.duplicate_of for r in once.collect()}
    for h in ("h1", "h2", "h3"):
        group = sorted(p for p, x in rows if x == h)
        assert marks[group[0]] is None and all(marks[p] == group[0] for p in group[1:])
    assert all(marks[p] is None for p, x in rows if x == "" or x.startswith("u"))


def test_drift_rules(spark):
    rows = [("s", f"p{i}", ev, luma, rg, 1.0, iso, ap) for i, (ev, luma, rg, iso, ap) in enumerate(
        [(10.0, 100.0, 1.0, 100.0, 4.0), (10.1, 90.0, 1.0, 100.0, 4.0), (11.0, 10.0, 1.3, 800.0, 2.0), (None, 200.0, 1.0, None, None), (-1.0, 0.0, 1.0, 10.0, 8.0)])]
    rows += [("few", "q1", 5.0, 50.0, 9.0, 1.0, 1.0, 1.0), ("few", "q2", 9.0, 90.0, 1.0, 1.0, 900.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, path string, ev double, luma double, rg double, bg double, iso double, aperture double")
    got = {r.path: r for r in consistency.set_drift(df, ["g"], luma="luma", rg="rg", bg="bg").collect()}
    med = statistics.median([10.0, 10.1, 11.0])
    assert got["p2"].expo_dev == pytest.approx(11.0 - med) and got["p2"].exposure_outlier
    assert got["p3"].expo_dev == 0 and not got["p3"].exposure_outlier  # brightness does not step in for a missing EV
    assert got["p4"].expo_dev == 0
    assert got["p2"].wb_outlier and not got["p0"].wb_outlier
    assert got["p2"].high_iso and got["p2"].iso_dev_stops == pytest.approx(3.0)
    assert not got["p4"].high_iso and got["p4"].iso_dev_stops < -2  # one-sided
    assert got["p2"].aperture_outlier and got["p4"].aperture_outlier  # two-sided
    assert not any((r.exposure_outlier, r.wb_outlier, r.high_iso, r.aperture_outlier) != (False,) * 4 for p, r in got.items() if p.startswith("q"))


def test_error_rows_count_in_white_balance_unless_switched_off(spark):
    rows = [(f"p{i}", rg, 1.0, e) for i, (rg, e) in enumerate([(1.0, True), (1.0, True), (1.4, False), (1.4, False), (1.4, False), (1.0, True), (1.0, True)])]
    df = spark.createDataFrame(rows, "path string, wb_gain_rg double, wb_gain_bg double, bad boolean")
    flagged = lambda p: {r.path for r in consistency.wb_drift(df.withColumn("s", F.lit(0)), ["s"], is_error="bad", p=p).collect() if r.wb_outlier}
    assert flagged(DEFAULTS) == {"p2", "p3", "p4"}
    assert flagged(QualityParams(wb_counts_errors=False)) == {"p0", "p1", "p5", "p6"}


def test_scores_do_not_depend_on_the_batch(spark):
    rows = [(i, [float(x % 7 * 40 + i) for x in range(64)], 512 + 100 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, blocks array<double>, longest int")
    score = lambda d: {r.id: r.s for r in d.select("id", scoring.log_score(scoring.peak_sharpness("blocks", "longest")).alias("s")).collect()}
    whole = score(df)
    assert {k: v for k, v in whole.items() if k < 5} == score(df.filter("id < 5").repartition(3))
    blocks, longest = rows[4][1], rows[4][2]
    f = max(1, 2048 / longest)
    peak = statistics.fmean(sorted(blocks)[-6:]) * f * f
    want = (math.log10(peak) - math.log10(30)) / (math.log10(600) - math.log10(30))
    assert whole[4] == pytest.approx(min(1, max(0, want)))


def test_histogram_statistics(spark):
    rng = random.Random(2)
    values = [min(255, int(rng.expovariate(0.02))) for _ in range(501)]
    counts = [values.count(v) for v in range(256)]
    cumulative = [sum(counts[: v + 1]) for v in range(256)]
    df = spark.createDataFrame([(cumulative,)], "c array<bigint>")
    r = df.select(photometry.mean("c").alias("m"), photometry.deviation("c").alias("d"), photometry.percentile("c", 0.95).alias("p"),
                  photometry.share_at_most("c", 2).alias("lo"), photometry.share_at_least("c", 253).alias("hi")).first()
    values.sort()
    at = 500 * 0.95
    assert r.m == pytest.approx(statistics.fmean(values)) and r.d == pytest.approx(statistics.pstdev(values))
    assert r.p == pytest.approx(values[int(at)] + (values[int(at) + 1] - values[int(at)]) * (at % 1))
    assert r.lo == pytest.approx(sum(v <= 2 for v in values) / 501) and r.hi == pytest.approx(sum(v >= 253 for v in values) / 501)


def test_grid_overlap_of_a_shift(spark):
    h = [[1.0, 0, -25.0, 0, 1, 0, 0, 0, 1], [1.0, 0, 0, 0, 1, 0, 0, 0, 0], [1.0, 0, 500.0, 0, 1, 0, 0, 0, 1]]
    df = spark.createDataFrame([(i, [float(x) for x in m]) for i, m in enumerate(h)], "i int, h array<double>").withColumns({k: F.lit(100) for k in ("w1", "h1", "w2", "h2")})
    got = [r[0] for r in df.orderBy("i").select(overlap.grid_overlap("h", "w1", "h1", "w2", "h2")).collect()]
    assert got == [0.75, 0.0, 0.0]


def test_ratio_match_blocks_change_nothing(spark):
    rng = random.Random(8)
    rows = [(image, k, [rng.random() for _ in range(8)]) for image in (0, 1) for k in range(60)]
    keypoints = spark.createDataFrame(rows, "path int, kp_id int, descriptor array<double>")
    pairs = spark.createDataFrame([(0, 1)], "path int, next_path int")
    match = lambda block: sorted((r.kp_id, r.next_kp_id, round(r.distance, 9)) for r in overlap.ratio_match(pairs, keypoints, 0.9, block=block).collect())
    want = []
    for _, k, v in rows[:60]:
        near = sorted((math.dist(v, w), j) for _, j, w in rows[60:])
        if near[0][0] < 0.9 * near[1][0]:
            want.append((k, near[0][1], round(near[0][0], 9)))
    assert match(1000) == match(7) == sorted(want) and want


def test_only_stale_files_are_hashed(spark):
    kind = "path string, name_lower string, size bigint, mtime bigint, sha256 string"
    scan = spark.createDataFrame([(f"p{i}", f"p{i}", i, 0, None) for i in range(9)], kind)
    index = spark.createDataFrame([(f"p{i}", f"p{i}", i + i % 2, 0, "old" if i % 3 else None) for i in range(7)], kind)
    body = spark.createDataFrame([(f"p{i}", bytearray([i])) for i in range(9)], "path string, content binary")
    asked = []

    def by_path(stale):
        asked.extend(r.path for r in stale.collect())
        return body.select("path", F.sha2("content", 256).alias("sha256"))

    run = lambda c: sorted(map(tuple, rc.incremental_hash(scan, index, c).select("path", "sha256", "hash_reused").collect()))
    few = run(body)
    assert {p for p, _, reused in few if reused} == {"p2", "p4"} and all(len(h) == 64 for _, h, reused in few if not reused)
    assert run(by_path) == few and not {"p2", "p4"} & set(asked)
