"""Source divergence against plain loops, and exactness of its products."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from framewright.llm import divergence
from framewright.llm.divergence import distances, shares, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def share(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        mine = share(counts[lang, source])
        whole = share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in {s for own, s in groups if own == lang} - {source}:
            theirs = share(counts[lang, other])
            pairs.append((sum(abs(mine[t] - theirs[t]) for t in kept), other))
        terms = [(mine[t] - whole[t], t) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


def run(spark, rows, **options):
    made = [(i, *r, 7, "own") for i, r in enumerate(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n int, term string")
    found = source_divergence(docs, **options).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    return got


def test_against_loops(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["Éa", "ÉA", "日本", "naïve"]
    rows = [
        (" ".join(rng.choices(words, weights=[1 + i % 7 for i in range(len(words))], k=rng.randint(0, 60))) + ", Ab-Ab 3x", lang, f"s{rng.randrange(5)}")
        for lang in ("en", "de") for _ in range(70)
    ]
    rows += [(None, "en", "s1"), ("", "en", "empty"), (None, None, None), ("lone text", "", "x"), (" ", "fr", "a"), ("none kept", "fr", "b")]
    rows += [("Ab " * 60_000, "en", "s2")] * 2
    monkeypatch.setattr(divergence, "TERMS", 40)
    assert run(spark, rows, min_docs=30) == brute(rows, 30)
    assert run(spark, rows, min_docs=5, top=3) == brute(rows, 5, 3)


def test_nothing_kept_and_empty_table(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("d", "en", None)]
    got = run(spark, rows)
    assert got == brute(rows, 30) and {r[4] for r in got} == {0} and len(got) == 6
    assert run(spark, []) == set()


def test_more_groups_than_a_tile_and_more_terms_than_a_strip():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (100, 70)) * rng.integers(0, 10**9, (100, 1))
    totals = counts.sum(0).tolist()
    p = np.stack([[1 + 10**9 * (int(c) + 5) // (totals[g] + 500) for c in counts[:, g]] for g in range(70)])
    want = np.abs(p[:, None, :] - p[None, :, :]).sum(2)
    for a in (slice(0, 32), slice(32, 64), slice(64, 70)):
        for b in (slice(0, 32), slice(64, 70)):
            assert (distances(counts, totals, 100, 5, 9, a, b) == want[a, b]).all()


def test_shares_are_exact_at_large_counts():
    counts = np.array([0, 1, 10**15, 5 * 10**16 + 3], np.int64)
    total = 8 * 10**16
    want = [1 + 10**9 * (int(c) + 5) // (total + 5 * 1000) for c in counts]
    assert shares(counts, total, 1000, 5, 9).tolist() == want
