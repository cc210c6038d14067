"""What SQL cannot say: brute force, round trips and held-out accuracy."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import near as near_module
from framewright.llm.ann import nearest
from framewright.llm.bpe import RANKS, Encoder, read_ranks
from framewright.llm.exact import Trie
from framewright.llm.langid import op6_language_id
from framewright.llm.near import estimate, likely, near_duplicates, shingle_sets, sketches
from framewright.llm.quality import op7_quality
from framewright.llm.words import inside, runs, word_hashes

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path(RANKS))


def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(ranks):
    own, library, rng = Encoder(ranks), reference(ranks), random.Random(3)
    alphabets = ["ab", "the", "abcdefghijklmnopqrstuvwxyz", "éàçabc", " ", "-=#", "日本語", " \n\t", "0123", "aA1 -é "]
    for _ in range(400):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([0, 1, 5, 30, 100, 700])))
        ids = own.text(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_query(spark, ranks):
    from framewright.llm.bpe import op2_byte_bpe

    library = reference(ranks)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op2_byte_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_held_out(spark):
    rows = op6_language_id(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = [r.lang == r.lang_pred for r in rows.filter("held_out").collect()]
    assert len(right) > 20 and np.mean(right) >= 0.97


def test_quality_held_out(spark, tmp_path):
    """Half of the labels are hidden from the fit and then predicted."""
    from framewright.llm.quality import classify

    sf = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    shown = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    scored = classify(spark.read.parquet(f"{sf}/documents.parquet"), shown)
    hidden = labels.join(shown, "doc_id", "left_anti").join(scored, "doc_id").collect()
    good = [r.good for r in hidden if r.quality == 1]
    bad = [not r.good for r in hidden if r.quality == 0]
    assert min(len(good), len(bad)) > 10
    assert np.mean(good) >= 0.97 and np.mean(bad) >= 0.9
    assert op7_quality(spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_trie_and_spill():
    rng = random.Random(5)
    keys = {bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(500)}
    trie = Trie()
    for k in keys:
        trie.slot(k).entry = k
    assert {k for k, v in trie.entries() if k == v} == keys
    spilled = dict(trie.spill())
    rest = dict(trie.entries())
    assert spilled and not spilled.keys() & rest.keys() and spilled.keys() | rest.keys() == keys


def test_runs_tell_word_sequences_apart():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "ab", "c"], k=rng.randint(0, 60))).encode() for _ in range(200)]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [len(x.split()) for x in texts]
    words = [w for x in texts for w in x.split()]
    for n in (1, 2, 3, 5, 9, 13):
        seen = defaultdict(set)
        for i, h in enumerate(runs(hashes, n).tolist()):
            seen[h].add(tuple(words[i : i + n]))
        assert all(len(v) == 1 for v in seen.values())
        assert len(seen) == len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
        assert inside(counts, n).sum() == sum(max(0, len(x.split()) - n + 1) for x in texts)


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    errors = []
    for share in (0.3, 0.6, 0.85, 0.95):
        common = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:common], pool[2000 : 3000 - common]])
        s = sketches(np.concatenate([a, b]), np.array([1000, 1000]), 1000)
        true = common / (2000 - common)
        errors.append(abs(estimate(s[:1], s[1:], np.array([1000.0]), np.array([1000.0]))[0] - true))
        both = sketches(np.union1d(a, b), np.array([len(np.union1d(a, b))]), 1000)
        assert (both[0] == np.maximum(s[0], s[1])).all()
    assert max(errors) < 0.06


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [512, 16])
def test_near_against_brute_force(spark, monkeypatch, block):
    """Large groups of copies with few to many edits, in one block and in several."""
    monkeypatch.setattr(near_module, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(4):
        base = rng.choices(vocabulary, k=80)
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], rng.choice(vocabulary)]])
            rows.append((rng.randrange(10**9), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, words=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_with_several_texts_under_one_id(spark):
    """Each id has a text near the others, twice, and one of its own: no crash in shared bands, no link lost."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    copy = base = rng.choices(vocabulary, k=80)
    rows = []
    for i in range(60):
        copy = list(copy if i % 3 == 1 else base)  # every third is one word away from the one before
        for _ in range(1 if i % 3 == 1 else rng.choice([2, 3, 4, 5])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows += [(i, " ".join(copy))] * 2
    alone = [(i, " ".join(f"own{i}x{k}" for k in range(300))) for i in range(60)]
    plain = brute_components(rows, 3, 85)
    df = spark.createDataFrame(rows + alone, "doc_id long, text string")
    out = near_duplicates(df, words=3, percent=85).collect()
    assert len(out) == 180
    assert {r.doc_id: r.component_id for r in out} == plain
    assert 1 < len(set(plain.values())) < len(plain)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = nearest(df, F.col("vec_id") % 20 == 0).collect()
    exact = x.astype(float)
    for q in range(0, 300, 20):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i))
        assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] == order[:20]


def test_pipeline_against_brute_force(spark, ranks):
    """Each stage is judged on its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert kept.columns == columns
    assert 0.7 * docs.count() < kept.count() < docs.count()

    before = sorted(kept.collect())
    left = corpus_pipeline.lines(spark, kept, SF_DIR)
    assert left.columns == columns
    owner = {}
    strip = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))

    for r in before:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), r.doc_id), r.doc_id)
    want = {}
    for r in before:
        lines = (r.text or "").split("\n")
        stays = [x for x in lines if owner.get(key(x), r.doc_id) == r.doc_id]
        if stays or len(stays) == len(lines):
            want[r.doc_id] = "\n".join(stays)
    rows = left.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)

    single = corpus_pipeline.near(spark, left, SF_DIR)
    assert single.columns == columns
    roots = brute_components([(r.doc_id, r.text) for r in rows], 5, 80)
    assert {r.doc_id for r in single.collect()} == set(roots.values())

    mixed = corpus_pipeline.mixing(spark, single, SF_DIR)
    assert mixed.columns == columns
    sizes = {r.doc_id: len((r.text or "").split()) for r in single.collect()}
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    assert sum(n * sizes[i] for i, n in times.items()) <= sum(sizes.values())

    last = corpus_pipeline.run(spark, SF_DIR).collect()
    assert len(last) == sum(times.values())
    library = reference(ranks)
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in last:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])


def test_shingles_of_short_texts():
    sets, sizes = shingle_sets([b"", b"a b", b"A  B", b"a b c", b"a b c a b c"], 3)
    assert sizes.tolist() == [0, 1, 1, 1, 3] and sets[0] == sets[1] != sets[2]


def test_the_climbing_test_agrees_with_the_estimate():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 5, (500, 140)).astype(np.uint16)
    b = np.where(rng.random((500, 140)) < rng.random((500, 1)), a, rng.integers(0, 5, (500, 140))).astype(np.uint16)
    n, m = rng.integers(50, 70, 500).astype(float), rng.integers(50, 70, 500).astype(float)
    value = estimate(a, b, n, m)
    sure = np.abs(value - 0.7) > 1e-3
    assert (likely(a, b, n, m, 0.7) == (value >= 0.7))[sure].all() and 50 < (value >= 0.7).sum() < 450
