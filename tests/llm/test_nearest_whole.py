"""The query keeps every row of a repeated id, as its SQL does."""

import random

import duckdb
import numpy as np
import pytest

from framewright.llm import ann
from framewright.llm.base import SQL


@pytest.mark.parametrize("blocks", [(2048, 8192), (16, 32)])
def test_repeated_ids_and_rows_against_the_sql(spark, tmp_path, monkeypatch, blocks):
    """A third of the rows under one id with their own vectors, some ids that ask more than once, and equal rows."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", blocks[1])
    rng = random.Random(8)

    def vector():
        return [rng.randrange(-8, 9) / 4 for _ in range(4)]

    rows = [(i, vector()) for i in range(1, 121)] + [(7, vector()) for _ in range(80)] + [(40, vector()) for _ in range(60)]
    rows += [(9, [2.0, 2.0, 2.0, 2.0])] * 7 + [(60, [1.0, 0.5, 0.25, 0.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL["op3_nearest"]).fetchall()
    con.close()
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op3_nearest(spark, str(tmp_path)).collect()]
    assert sorted((q, r, v, s) for q, r, v, s in want) == sorted((q, int(r), v, s) for q, r, v, s in got)
    assert sum(v == 7 for _, _, v, _ in got) > 6


def test_blocks_are_not_sent_through_the_driver(spark, tmp_path):
    """Blocks of queries are small, but their copies for all blocks of candidates are not: no broadcast may take them."""
    rng = random.Random(9)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = ann.op3_nearest(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "q_c" in plan
    assert not [line for line in plan.splitlines() if "Broadcast" in line and ("q_c" in line or "c_q" in line)]


@pytest.mark.parametrize("spread", [0.0, 30.0])
def test_columns_of_a_tile_leave_what_the_whole_tile_leaves(monkeypatch, spread):
    """The largest of a tile by all its bounds at once, however many columns are multiplied at a time."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 24)), rng.normal(size=(700, 24)) * 10.0 ** rng.uniform(-spread, spread, (700, 1))
    y[300:420] = y[7]
    ids, ones = np.arange(700), np.ones(700, np.int64)
    q, c = ann.block_of(ids[:50] + 300, ids[:50] + 300, ones[:50], x), ann.block_of(ids, ids, ones, y)
    found = []
    for columns in (8192, 64, 5):
        monkeypatch.setattr(ann, "COLUMNS", columns)
        got = ann.tile(q, c, 10)
        found.append(sorted(zip(*(got[n].tolist() for n in ("query_row", "row", "lower", "upper")), strict=True)))
    assert [f[:2] for f in found[0]] == [f[:2] for f in found[1]] == [f[:2] for f in found[2]]
    assert np.allclose(found[0], found[1], rtol=1e-12) and np.allclose(found[0], found[2], rtol=1e-12)
    assert not any(a == b for a, b, _, _ in found[0]) and len(found[0]) >= 500


def test_many_candidates_stand_in_few_blocks():
    assert ann.blocks_of(5, 100, 64, 8) == (1, 1)
    assert ann.blocks_of(2_564, 51_282, 64, 8) == (2, 7)
    assert ann.blocks_of(30_770, 615_384, 64, 6) == (16, 12)
    assert ann.blocks_of(0, 0, 0, 8) == (1, 1)
    assert ann.blocks_of(500_000, 10_000_000, 1024, 8) == (245, 1221)
