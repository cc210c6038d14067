"""The skew-safe building blocks against plain Python and against Spark's own windows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from framewright.operators import medians, spread


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 40}", f"p{rng.randrange(10**9):09d}_{i}", rng.randrange(5)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, path string, v int").repartition(7)


def by_group(rows):
    groups = {}
    for g, path, v in rows:
        groups.setdefault(g, []).append((path, v))
    return {g: sorted(x) for g, x in groups.items()}


def test_successor_crosses_chunk_edges(skewed):
    rows, df = skewed
    want = {}
    for g, items in by_group(rows).items():
        for (a, _), b in zip(items, items[1:] + [(None, None)]):
            want[(g, a)] = b[0]
    got = spread.with_successor(df, ["g"], ["path"], {"next_path": "path"}).collect()
    assert {(r.g, r.path): r.next_path for r in got} == want
    assert len(got) == len(rows)


def test_running_total(skewed):
    rows, df = skewed
    want = {}
    for g, items in by_group(rows).items():
        total = 0
        for path, v in items:
            total += v
            want[path] = total
    got = spread.with_running_total(df, ["g"], ["path"], F.col("v"), "total").collect()
    assert {r.path: r.total for r in got} == want


def test_a_single_group_is_split_into_chunks(spark, skewed):
    _, df = skewed
    chunks = spread._in_chunks(df.filter("g = 'hot'"), ["g"], ["path"]).select("__chunk").distinct().count()
    assert chunks >= 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = spread._in_chunks(df.filter("g = 'hot'"), ["g"], ["path"]).select("__chunk").distinct().count()
        assert chunks == 8
        test_successor_crosses_chunk_edges(skewed)
        test_running_total(skewed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_medians_of_odd_values(spark):
    """Sets without values keep their row; infinities, NaN, negative values and a NULL set."""
    inf, nan = float("inf"), float("nan")
    sets = {"none": [None, nan], "up": [1.0, inf, inf], "down": [-inf, -2.0, -1.0, inf], "both": [-inf, inf], None: [-3.0, 5e-324, 1e308, 1e308, nan], "ends": [1e308, 1.5e308]}
    df = spark.createDataFrame([(g, v) for g, values in sets.items() for v in values], "g string, v double")
    got = {r.g: (r.m, r.n_m) for r in medians.exact_medians(df, ["g"], {"m": F.col("v")}).collect()}
    assert got["none"] == (None, 0) and got["up"] == (inf, 3) and got["down"] == (-1.5, 4)
    assert got["both"][1] == 2 and got[None] == (5e307, 4) and got["ends"][1] == 2


def test_no_job_runs_while_a_plan_is_built(spark):
    import __spark_entry__ as contract

    tracker, queries = spark.sparkContext.statusTracker(), contract.queries()
    for name in ("g1_mark_duplicates", "g7_set_consistency", "label_run", "r3_missing_files", "r5_incremental_hash", "r17_plan_transfer", "v6_collision_number"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        queries[name](spark, "/root/testdata/sf0.001")
        # Reading the schema of a table is the only job allowed, and no query reads more than three.
        assert len(tracker.getJobIdsForGroup(f"build-{name}")) <= 3, name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_exact_medians(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 else f"k{i % 25}"
        v = rng.choice([0.0, -1.5, 1e-9, 3.25, rng.uniform(-5, 5), rng.uniform(1.0, 1.0001), None, 2.0**rng.randrange(-3, 9)])
        rows.append((g, v, float(rng.randrange(3))))
    df = spark.createDataFrame(rows, "g string, a double, b double")
    got = {r.g: r for r in medians.exact_medians(df, ["g"], {"ma": F.col("a"), "mb": F.when(F.col("b") > 0, F.col("b"))}).collect()}
    for g in {r[0] for r in rows}:
        a = [x for k, x, _ in rows if k == g and x is not None]
        b = [x for k, _, x in rows if k == g and x > 0]
        assert got[g].ma == statistics.median(a) and got[g].n_ma == len(a)
        assert got[g].mb == statistics.median(b) and got[g].n_mb == len(b)
