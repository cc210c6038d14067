"""Inputs made to break an operator: words built to share a hash, extreme magnitudes, few labels, one id or anchor for all."""

import random
import string
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import ann
from framewright.llm.ann import nearest
from framewright.llm.lines import line_dedup
from framewright.llm.near import near_duplicates
from framewright.llm.quality import classify
from framewright.llm.secrets import find_secrets
from framewright.llm.substrings import substring_dedup
from framewright.llm.words import word_hashes

HEX = "0123456789abcdef"
ALPHABETS = {
    "hex": HEX,
    "upper hex": HEX.upper(),
    "mixed hex": HEX + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "lower base36": string.ascii_lowercase + string.digits,
    "upper base36": string.ascii_uppercase + string.digits,
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that share every polynomial hash modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate({97: "b", 98: "a"})


def test_words_built_to_share_a_hash(docs, by_id):
    a, b = thue_morse(2048)
    rest = " ".join(f"r{i}" for i in range(12))
    got = by_id(substring_dedup(docs((1, f"{a} {rest}"), (2, f"{b} {rest}"))))
    assert [got[i].n_removed for i in (1, 2)] == [0, 0]
    rows = docs((1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} x"), (4, f"{b} x"))
    got = by_id(near_duplicates(rows, words=3, percent=85))
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4]


def test_hashes_of_words():
    """Against one word at a time; words of up to eight bytes never share a hash, blanks of all kinds part them."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijkl\u00e9\u65e5", k=rng.randint(1, 24))) for _ in range(5000)] + ["a" * n for n in range(1, 40)]
    words += [w + "\0" for w in words[:50]]
    texts = [" ".join(words[:2000]), "", "\t\n\x0b\x0c\r ", "\r\n".join(words[2000:])]
    found, counts = word_hashes([t.encode() for t in texts])
    assert counts.tolist() == [2000, 0, 0, len(words) - 2000]
    alone = [int(word_hashes([w.encode()])[0][0]) for w in words]
    assert found.tolist() == alone and len(set(alone)) == len(set(words))
    assert len(word_hashes([])[0]) == len(word_hashes([b""])[0]) == 0
    many = np.unique(word_hashes([" ".join(map(str, range(300_000))).encode()])[0])
    assert len(many) == 300_000


@pytest.mark.parametrize("power", [-160, -40, 0, 100, 160])
def test_nearest_of_large_and_tiny_vectors(spark, power):
    rng = np.random.default_rng(power + 500)
    x = rng.normal(size=(60, 8)) * 10.0**power
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, every_row=True).collect()
    assert len(got) == 60
    for q in (0, 20, 40):
        score = np.zeros(60)
        with np.errstate(over="ignore"):
            for k in range(8):
                score += x[q, k] * x[:, k]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert all(s is None or s == score[v] for _, v, s in mine), "infinities that cancel out have no value"
        if power < 160:
            order = sorted((i for i in range(60) if i != q), key=lambda i: (-score[i], i))[:20]
            assert [v for _, v, _ in mine] == order


def test_nearest_of_mixed_magnitudes(spark, monkeypatch):
    """Candidates of all magnitudes in several blocks, against all products."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 30)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 6)) * 10.0 ** rng.integers(-140, 140, (200, 1)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 10 == 0, k=20).collect()
    assert len(got) == 400
    for q in range(0, 200, 10):
        score = np.zeros(200)
        for k in range(6):
            score += x[q, k] * x[:, k]
        order = sorted((i for i in range(200) if i != q), key=lambda i: (-score[i], i))[:20]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == order


def test_a_vector_that_very_many_rows_share():
    """Of equal vectors only the smallest ids that a list can take are kept in a block."""
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(30, 4)), [400] + [1] * 29, axis=0)
    ids = rng.permutation(len(vectors))
    kept = ann.smallest_of_equal(vectors, ids, 21)
    assert len(kept) == 21 + 29 and set(ids[kept][ids[kept] < 10**9]) >= set(np.sort(ids[:400])[:21])
    assert len(ann.smallest_of_equal(np.array([[0.0, 1.0], [-0.0, 1.0]]), np.array([5, 4]), 1)) == 1


def test_bounds_hold():
    """The true product lies between the bounds, in the unit of the query, and nothing of the nearest is left out."""
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(40, 16)), rng.normal(size=(300, 16)) * 2.0 ** rng.integers(-6, 6, (300, 1))
    ones = lambda n: np.ones(n, np.int64)
    q, c = ann.block_of(np.arange(40), np.arange(1000, 1040), ones(40), x), ann.block_of(np.arange(300), np.arange(300), ones(300), y)
    got = ann.tile(q, c, 10)
    true = (x @ y.T)[got["query_row"], got["row"]] * np.ldexp(1.0, -q["power"][got["query_row"]] - ann.UNIT)
    assert (got["lower"] <= true + 1e-18).all() and (true <= got["upper"] + 1e-18).all()
    kept = set(zip(got["query_row"].tolist(), got["row"].tolist(), strict=True))
    assert all((i, j) in kept for i in range(40) for j in np.argsort(-(x @ y.T)[i])[:10].tolist())
    assert len(kept) < 40 * 40 and q["bits"].dtype == np.int8


@pytest.mark.parametrize("length", [20, 24, 32, 40])
def test_random_secrets_are_found(spark, length):
    """At least 95 of 100 random strings of each alphabet."""
    rng = random.Random(length)
    rows = [(kind, "key " + "".join(rng.choices(letters, k=length)) + " end") for kind, letters in ALPHABETS.items() for _ in range(1000)]
    found = find_secrets(spark.createDataFrame(rows, "kind string, text string").repartition(4))
    share = {r.kind: r.found for r in found.groupBy("kind").agg(F.avg((F.col("spans").contains("entropy")).cast("int")).alias("found")).collect()}
    assert min(share.values()) >= 0.95, share


def test_words_beside_a_secret_do_not_hide_it(docs, by_id):
    key = "q7Gx2LmB9vRk4TzPw8Ns1YcH5dJf3KaQ6eUo0iXy"
    texts = {
        1: f"example_key={key}",
        2: f"docs/example/{key}",
        3: f"https://www.site.org/{key}?x",
        4: f"{key}_placeholder",
        5: "internationalisation-of-the-whole-documentation/version2/chapter12",
        6: "getElementsByClassNameOfAllDescendants and CONSTANT_OF_A_LONG_NAME_IN_CAPITALS",
        7: "550e8400-e29b-41d4-a716-446655440000 and 2024-01-02-03-04-05-06-07",
        8: "id bPxRfiCYbPxRfiEXAMPLEKEY",
        9: "xxxxxxxxxxxxxxxxxxxxxxxxxxxx and 12345678901234567890",
    }
    got = by_id(find_secrets(docs(*texts.items())))
    for i in (1, 2, 3, 4):
        at = texts[i].index(key)
        kind, start, end = got[i].spans.split(":")
        assert kind == "entropy" and at <= int(start) < at + 10 and at + 30 < int(end) <= at + 40, got[i].spans
    assert [got[i].spans for i in (5, 6, 7, 9)] == [""] * 4 and got[8].spans == ""


def test_one_very_long_candidate(docs, by_id):
    letters = string.ascii_letters + string.digits
    text = "".join(random.Random(1).choices(letters, k=200_000))
    began = time.time()
    got = by_id(find_secrets(docs((1, text), (2, "aB3/" * 20_000), (3, "Abc" * 30_000))))
    assert got[1].spans.startswith("entropy:0:") or got[1].spans.startswith("entropy:1:")
    assert got[1].spans.endswith(":200000") and got[3].spans == ""
    assert time.time() - began < 60


def test_many_rows_of_one_id_share_their_lines(spark):
    lines = [f"a common line number {i}" for i in range(50)]
    rows = [(1, "\n".join(lines))] + [(2, "\n".join([*lines[k % 50 :], "own"])) for k in range(1000)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    dropped = got.filter("doc_id = 2").agg(F.max("n_dropped"), F.min("text"), F.max("text"), F.count("*")).first()
    assert tuple(dropped) == (50, "own", "own", 1000)


@pytest.mark.parametrize("bad", [0, 1, 3, 9])
def test_few_labels_of_a_class_are_used(spark, bad):
    good = "A sentence of plain words that reads well. Another one follows it here.\n"
    junk = "$$$ 777 @@@ !!! BUY 999 ### 123\n"
    rows = [(i, junk * (3 + i % 4) if i < bad or i >= 1000 else good * (2 + i % 5), "s", "en") for i in [*range(60), *range(1000, 1020)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i >= bad)) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert all(got[i].good for i in range(bad, 60))
    if bad:
        assert sum(got[i].good for i in range(1000, 1020)) <= 4
    else:
        assert all(r.good for r in got.values())


def test_only_bad_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s", "en") for i in range(30)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0) for i in range(21)], "doc_id long, quality int")
    assert all(r.good for r in classify(docs, labels).collect())


def test_a_text_in_every_task_costs_one_list():
    from framewright.llm.exact import merged_tries

    n = 30_000
    row = {"rep": range(n), "digest": [b"d"] * n, "size": [2] * n, "bytes": [b"ab"] * n, "points": [2] * n, "best": range(n), "n": [1] * n}
    began = time.time()
    out = [r for b in merged_tries(iter([pa.RecordBatch.from_pydict(row)])) for r in b.to_pylist()]
    assert len(out) == n and {(r["keep_id"], r["group_size"]) for r in out} == {(0, n)} and time.time() - began < 5
