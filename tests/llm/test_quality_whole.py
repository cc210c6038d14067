"""The classifier learns from all unlabelled documents and from every label of a rare class."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import quality
from framewright.llm.quality import classify

GOOD = "the people of the village walked along the river and spoke about the harvest of the year".split()
COLUMNS = "doc_id long, text string, source string, lang string"


def good(rng):
    return " ".join(rng.choices(GOOD, k=rng.randint(8, 30)))


def bad(rng):
    return " ".join(rng.choices(["BUY!!!", "$$$", "00", "#1"], k=rng.randint(4, 12)))


def scores(docs, labels):
    return {r.doc_id: r.quality_score for r in classify(docs, labels).collect()}


def test_unlabelled_documents_beyond_ten_thousand_count(spark):
    """Only what comes after the 10,000 smallest hashes differs: what is learnt differs, and not with the partitions."""
    rng = random.Random(1)
    rows = [(i, good(rng) if i % 3 else bad(rng), "a" if i % 3 else "b", "en") for i in range(13_000)]
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    late = {r.doc_id for r in docs.filter("doc_id >= 400").orderBy(place, "doc_id").collect()[10_000:]}
    assert len(late) == 2600
    other = [(i, "| " * 40, "b", "en") if i in late else (i, *rest) for i, *rest in rows]
    first, second = scores(docs, labels), scores(spark.createDataFrame(other, COLUMNS), labels)
    assert sum(first[i] != second[i] for i in range(400)) > 200
    assert scores(docs.repartition(7), labels) == first


def test_a_rare_class_is_fitted_in_full(spark, monkeypatch):
    """Of 3,000 labels 30 are bad; a bound of 100 takes 100 good ones and all the bad ones."""
    monkeypatch.setattr(quality, "LABELLED", 100)
    rng = random.Random(2)
    rows = [(i, bad(rng) if i % 100 == 0 else good(rng), "s", "en") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 100 > 0)) for i in range(3000)] + [(10**6 + i, 1) for i in range(5000)], "doc_id long, quality int")
    out = {r.doc_id: r.good for r in classify(spark.createDataFrame(rows, COLUMNS), labels).collect()}
    assert not any(out[i] for i in range(0, 4000, 100))
    assert np.mean([out[i] for i in range(4000) if i % 100]) > 0.99


@pytest.mark.parametrize("most", [0, 1, 57, 10_000])
def test_the_surest_are_chosen(most):
    """Against a sort of all rows, whatever the rows are dealt into."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=3000), np.zeros(3000)]
    models = [np.array([0.0, 4.0, 0.0]), np.array([0.0, 0.0, 0.0])]
    whole = quality.Rows((x, x), rng.integers(0, quality.CELLS, 3000))
    parts = [quality.Rows((x[k::4], x[k::4]), whole.tie[k::4]) for k in range(4)]
    chosen = quality.choose(lambda f: sum(map(f, parts)), models, [], (most, most))
    got = quality.given(whole, [chosen])
    assert (got[0] == -1).all(), "the second view is sure of nothing"
    for label in (0, 1):
        cells = quality.confidence(models[0], x, label)
        sure = np.flatnonzero(cells >= 0)
        want = sure[np.lexsort((whole.tie[sure], -cells[sure]))][:most]
        taken = np.flatnonzero(got[1] == label)
        assert set(taken) <= set(want) and len(want) - len(taken) <= 2
