"""What a task holds at once, and how long it is, does not follow the size of a batch or of a split."""

import numpy as np
import pandas as pd
import pytest

from framewright.operators import measures, overlap
from framewright.queries.base import spread_scan


class Spy:
    """Stands for a DataFrame and gives back the function of its pandas stage."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInPandas(self, function, _):  # noqa: N802
        return function


def rasters(n):
    data = [bytes((np.arange(64) * (k % 7 + 1) % 256).astype(np.uint8)) for k in range(n)]
    return pd.DataFrame({"path": [f"p{k}" for k in range(n)], "height": 8, "width": 8, "n_channels": 1, "data": data})


@pytest.mark.parametrize(("keypoints", "most"), ((False, measures.STAT_ROWS), (True, measures.KEYPOINT_ROWS)))
def test_statistics_leave_in_pieces(spark, keypoints, most):
    schema = spark.createDataFrame(rasters(1)).schema
    one_pass = measures.pixel_stats(Spy(schema), ["path"], wanted=("brightness",), keypoints=keypoints)
    out = list(one_pass(iter([rasters(1000)])))
    assert max(map(len, out)) <= most and pd.concat(out)["path"].tolist() == rasters(1000)["path"].tolist()


def test_second_detector_leaves_in_pieces(spark):
    detect = overlap.detect_second(Spy(spark.createDataFrame(rasters(1)).schema))
    out = list(detect(iter([rasters(100)])))
    assert max(map(len, out)) <= measures.KEYPOINT_ROWS and sum(map(len, out)) == 100


def test_splits_are_cut_where_rows_are_dear(spark):
    few = spark.range(5000, numPartitions=4)
    assert spread_scan(few, "id").rdd.getNumPartitions() == 4
    assert spread_scan(few, "id", 500).rdd.getNumPartitions() == 10
    assert spread_scan(few, "id", 5000).rdd.getNumPartitions() == 4


def test_homographies_of_many_pairs_need_no_group_each(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for k in range(40):
        a = rng.uniform(-300, 300, (32, 2))
        b = a * (1 + k / 100) + [k, -k]
        b[::8] += rng.uniform(300, 900, (4, 2))
        n = (3, 32)[k % 8 > 0]
        points = np.column_stack([a, b])[:n]
        rows += [(k, k + 1, *map(float, p)) for p in rng.permutation(points)]
        ordered = points[np.lexsort(points.T[::-1])]
        expected[k] = overlap._both_directions(ordered[:, :2], ordered[:, 2:], k, k + 1, overlap.DEFAULTS.sift_ransac_px)
    matches = spark.createDataFrame(rows, "path long, next_path long, x1 double, y1 double, x2 double, y2 double")
    found = overlap.estimate_homographies(matches)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {r["path"]: [r["matches"], r["inliers_a"], r["h_a"], r["inliers_b"], r["h_b"]] for r in found.collect()} == expected
