"""Spelling variants against all pairs on small vocabularies, and the cases that are easily lost."""

import random
import zlib

import numpy as np
import pytest

from framewright.llm import variants
from framewright.llm.variants import group_variants, near_pairs, one_edit, word_counts


def is_near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced letter, by trying them."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], ratio: int = 10):
    forms, out = {}, {}
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def grouped(spark, words, **options):
    rows = group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), **options).collect()
    assert len(rows) == len(words)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(60):
        w = "".join(rng.choices("abcdefgé", k=rng.randint(1, 9)))
        words[w] = rng.choice([1, 2, 5, 20, 300, 4000, 10**12])
        for _ in range(4):
            at, c = rng.randrange(len(w)), rng.choice("abzß")
            other = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            if other:
                words[other] = rng.choice([1, 2, 30, 300])
    assert grouped(spark, words) == brute(words)


def test_blocks_of_few_words_meet_too():
    """Packing and meeting by hand, with blocks so small that a cell has many."""
    import pyarrow as pa

    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=4)) for _ in range(70)} | {"abcab", "aaaa", "日本語", "日本"})
    counts = {w: 1 + i for i, w in enumerate(words)}
    cells = [variants._key(c) for c in variants._cells(words)]
    order = sorted(range(len(words)), key=lambda i: (cells[i], words[i]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([cells[i] for i in order]), pa.array([words[i] for i in order]), pa.array([counts[words[i]] for i in order])], ["cell", "word", "n"]
    )
    known, variants.BLOCK_WORDS = variants.BLOCK_WORDS, 3
    try:
        blocks = [r for b in variants._pack(iter([batch])) for r in b.to_pylist()]
    finally:
        variants.BLOCK_WORDS = known
    assert max(b["m"] for b in blocks) == 3 and len({b["first"] for b in blocks}) == len(blocks)
    meetings = []
    for home in sorted(blocks, key=lambda b: b["first"]):
        own = {"first": home["first"], "own": home["cell"], **{c: home[c] for c in ("m", "length", "letters", "ns")}}
        meetings.append(own)
        meetings += [own | {"own": v["cell"], **{c: v[c] for c in ("m", "length", "letters", "ns")}} for v in blocks if home["cell"] in v["visits"]]
    near = {}
    for out in variants._meet(iter([pa.RecordBatch.from_pylist(meetings)])):
        for r in out.to_pylist():
            near[r["word"]] = near.get(r["word"], 0) + r["near"]
    want = {w: sum(is_near(w, x) for x in words) for w in words}
    assert near == {w: n for w, n in want.items() if n}


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefghijk": 10_000, "abcdefghijkl": 100_000, "zzz": 5}
    got = grouped(spark, words)
    assert {got[w][1] for w in words if w != "zzz"} == {"abcdefghijkl"} and got["zzz"] == (None, "zzz", 5, 0, None)
    assert got["abcdefg"][0] == "abcdefgh"


def test_ties_nulls_repeats_and_very_long_words(spark):
    long_ = "ab" * 30_000
    rows = [("bcdefgx", 50), ("bcdefgy", 50), ("bcdefgz", 5), (None, 9), ("", 9), ("bcdefgq", None), ("bcdefgx", 10), ("bcdefgy", 10)]
    rows += [(long_, 1), (long_ + "c", 10), (long_[::-1], 7)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r.word: r for r in group_variants(df).collect()}
    assert set(got) == {"bcdefgx", "bcdefgy", "bcdefgz", long_, long_ + "c", long_[::-1]}
    assert (got["bcdefgz"].form, got["bcdefgz"].form_n, got["bcdefgz"].n_near) == ("bcdefgx", 60, 2), "ties go to the smaller word"
    assert got["bcdefgx"].form is None and got[long_].form == long_ + "c" and got[long_[::-1]].n_near == 0
    assert group_variants(df.filter("n > 1000")).collect() == []


def test_word_counts(spark):
    rows = [(1, "Straße STRASSEN, übermäßig? 漢übermäßig×÷ naïveté.", 0), (1, "Straße", 0), (None, "strassen", 0), (2, None, 0), (3, "", 0)]
    rows.append((4, "longwords " * 50_000, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r.n for r in word_counts(docs, slip=0, min_chars=6).collect()}
    assert got == {"straße": 2, "strassen": 2, "übermäßig": 1, "übermäßig×÷": 1, "naïveté": 1, "longwords": 50_000}
    assert word_counts(docs.filter("doc_id > 9")).collect() == []


def test_slips_fall_where_the_hash_says(spark):
    rows = [(i, "Überraschung plain") for i in range(400)]
    got = {r.word: r.n for r in word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    run = "Überraschung"
    for i, _ in rows:
        h = zlib.crc32(f"{i}:{run}".encode())
        w = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
        want[w] = want.get(w, 0) + 1
    assert got == want and len(want) > 3


def test_products_and_edits_agree_with_loops():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(97, 100, (80, k)).astype(np.uint8) for k in (6, 6, 7))
    text = lambda x: bytes(x).decode()
    for right in (b, c):
        i, j = near_pairs(a, right)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [
            (p, q) for p in range(80) for q in range(80) if is_near(text(a[p]), text(right[q]))
        ]
    assert one_edit(np.array([[1, 1]]), np.array([[1, 1, 1]])).tolist() == [True]
