"""Substring dedup by windows of 13 words, after relative Lempel-Ziv parsing.

Every document is a reference block for those with a larger id. The index of the blocks is spread by content:
a run of 13 words is filed under its anchor, the smallest hash of the 5-word runs in it, so
neighbouring runs share an anchor and only one anchor in about five words is looked at in the first round.
Round one finds the anchors that more than one document has; round two looks up the runs under those
anchors and nothing else. These windows decide what is removed; factors (start, length, smallest document that
has it) are derived from them: neighbouring windows with the same smallest holder, not the longest match in
one reference. Runs across the border of two factors are looked up like any other. Every task first merges what
its own documents share, so a passage that a third of the documents hold arrives once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import chunks, cut_up, partitions, query, table, utf8
from framewright.llm.words import inside, mix, runs, sliding_min, word_hashes

ANCHOR_WORDS = 5
PER_TASK = 4  # buckets for each shuffle partition
_SECOND = 0xA24BAED4963EE407  # base of the hash of whole runs; anchors use another
NO_ID, NO_IDS = -(2**63), 2**32  # rows without an id are spread over this many numbers that no id has
PACKED = "bucket int, kind byte, a binary, h binary, d binary"
FOUND = "id long, h binary, r binary"


def _windows(ids: np.ndarray, texts: list[bytes], words: int):
    """(row, anchor, hash) of every run of `words` words."""
    hashes, counts = word_hashes(texts)
    ok = inside(counts, words)
    anchor_words = min(ANCHOR_WORDS, words)
    anchors = sliding_min(runs(hashes, anchor_words), words - anchor_words + 1)
    row = np.repeat(np.arange(len(counts)), counts)[: len(ok)]
    return row[ok], anchors[ok], runs(hashes, words, _SECOND)[ok], counts


def _pack(kind: int, key: np.ndarray, a: np.ndarray, h: np.ndarray, d: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket of `key`, with the entries as packed arrays."""
    bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, a, h, d = bucket[order], a[order], h[order], d[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    cells = cut_up(cuts, a, h, d)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts], pa.int32()),
            pa.array(np.full(len(cuts), kind, np.int8)),
            *[pa.array(c, pa.binary()) for c in cells],
        ],
        ["bucket", "kind", "a", "h", "d"],
    )


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _merged(a: np.ndarray, h: np.ndarray, d: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task sends of its entries: of equal ones the smallest document (kind 0), and for the others that it is not first."""
    if not len(a):
        return
    order = np.lexsort((d, h, a))
    a, h, d = a[order], h[order], d[order]
    fresh = _firsts(a, h, d)
    a, h, d = a[fresh], h[fresh], d[fresh]
    first = _firsts(a, h)
    yield _pack(0, a[first], a[first], h[first], d[first], buckets)
    owner = d[first][np.cumsum(first) - 1]
    if not first.all():
        yield _pack(1, d[~first], owner[~first].view(np.uint64), h[~first], d[~first], buckets)


def _by_bucket(batches: Iterator[pa.RecordBatch]):
    """Entries (kind 0 and kind 1) of one bucket after the other; rows come sorted by bucket."""
    held: list[tuple] = []
    at = None

    def joined(kind):
        mine = [x for x in held if x[0] == kind]
        return [np.frombuffer(b"".join(x[k] for x in mine), t) for k, t in ((1, np.uint64), (2, np.uint64), (3, np.int64))]

    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "a", "h", "d")), strict=True):
            if bucket != at and held:
                yield joined(0), joined(1)
                held = []
            at = bucket
            held.append(tuple(row))
    if held:
        yield joined(0), joined(1)


def _per_document(d: np.ndarray, h: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(d, kind="stable")
    d, h, r = d[order], h[order], r[order] if len(r) else r
    cuts = np.flatnonzero(_firsts(d)) if len(d) else np.empty(0, int)
    cells = cut_up(cuts, h, r)
    return pa.RecordBatch.from_arrays(
        [pa.array(d[cuts], pa.int64()), *[pa.array(c, pa.binary()) for c in cells]], ["id", "h", "r"]
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that at least two documents have, for each of their documents."""
    for (a, h, d), (_, h1, d1) in _by_bucket(batches):
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = _firsts(h) if len(h) else np.empty(0, bool)
        group = np.cumsum(first) - 1
        many = (np.bincount(group) > 1)[group] if len(h) else first
        d, h = np.concatenate([d[many], d1]), np.concatenate([h[many], h1])
        yield _per_document(d, h, np.empty(0, np.int64))


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that start in a smaller document, with the smallest such document."""
    for (a, h, d), (r1, h1, d1) in _by_bucket(batches):
        order = np.lexsort((d, h, a))
        a, h, d = a[order], h[order], d[order]
        first = _firsts(a, h) if len(a) else np.empty(0, bool)
        owner = d[first][np.cumsum(first) - 1] if len(a) else d
        later = d > owner
        yield _per_document(
            np.concatenate([d[later], d1]), np.concatenate([h[later], h1]), np.concatenate([owner[later], r1.view(np.int64)])
        )


def factors(flags: np.ndarray, refs: np.ndarray, words: int) -> list[tuple[int, int, int]]:
    """Greedy parse: (first word, words, document) of the maximal runs of flagged windows with one reference."""
    if not flags.any():
        return []
    at = np.flatnonzero(flags)
    ref = refs[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (ref[1:] != ref[:-1])
    starts = np.flatnonzero(new)
    ends = [*(starts[1:] - 1).tolist(), len(at) - 1]
    return [(int(at[s]), int(at[e] - at[s]) + words, int(ref[s])) for s, e in zip(starts.tolist(), ends, strict=True)]


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 13) -> DataFrame:
    """One row per input row: `doc_id`, `n_words`, `n_removed`, `kept` (words left, joined by one space), `factors`.

    `factors` are (start, length, document) in words; every word that one covers is removed. A run of `words`
    words is removed where the same run also starts in a document with a smaller id, judged on the input;
    runs are told apart by 128 bits, made of 64 of each word. Null and blank texts have no words and stay empty. Rows that repeat an id are
    one document; a row without an id keeps all its words and is no reference. Other columns are not returned.
    Very long texts are read whole, one at a time in a task; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = PER_TASK * partitions(spark)
    # One exchange of the texts, read by all three passes. Its key is never null, else the inner join would filter
    # below the exchange and get one of its own.
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 32))
    placed = docs.select(place.alias("doc_id"), F.col(text).alias("text")).repartition(partitions(spark), "doc_id")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            known = batch.filter(pa.compute.greater_equal(batch.column("doc_id"), NO_ID + NO_IDS))
            ids = known.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            row, anchor, _, _ = _windows(ids, utf8(known.column("text")), words)
            new = _firsts(row, anchor) if len(row) else np.empty(0, bool)
            a, d = anchor[new], ids[row[new]]
            for out in _merged(a, a, d, buckets):
                yield out
                if out.column("kind")[0].as_py() == 1:  # their first holder is shared as well
                    order = np.lexsort((d, a))
                    a1, d1 = a[order], d[order]
                    first = _firsts(a1)
                    several = np.zeros(first.sum(), bool)
                    group = np.cumsum(first) - 1
                    np.logical_or.at(several, group[1:][(d1[1:] != d1[:-1]) & ~first[1:]], True)
                    if several.any():
                        a1, d1 = a1[first][several], d1[first][several]
                        yield _pack(1, d1, a1, a1, d1, buckets)

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            row, anchor, h, _ = _windows(ids, utf8(batch.column("text")), words)
            lists = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column("h").to_pylist()]
            if not len(row):
                continue
            salt = mix(np.arange(len(ids), dtype=np.uint64))
            wanted = np.unique(np.concatenate([mix(x ^ salt[i]) for i, x in enumerate(lists)]))
            mine = mix(anchor ^ salt[row])
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            hit = wanted[at] == mine
            yield from _merged(anchor[hit], h[hit], ids[row[hit]], buckets)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = utf8(batch.column("text"))
            ids = np.arange(len(texts))
            row, _, h, counts = _windows(ids, texts, words)
            begins = np.searchsorted(row, ids)
            ends = np.searchsorted(row, ids, "right")
            gone, kept, parsed = [], [], []
            for i, (hs, rs) in enumerate(zip(batch.column("h").to_pylist(), batch.column("r").to_pylist(), strict=True)):
                tokens = texts[i].split()
                found = []
                if hs:
                    known = np.frombuffer(b"".join(hs), np.uint64)
                    refs = np.frombuffer(b"".join(rs), np.int64)
                    order = np.lexsort((refs, known))
                    known, refs = known[order], refs[order]
                    mine = h[begins[i] : ends[i]]
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    found = factors(known[at] == mine, refs[at], words)
                cover = np.zeros(len(tokens) + 1, np.int64)
                for start, length, _ in found:
                    cover[start] += 1
                    cover[start + length] -= 1
                if found:
                    stays = np.cumsum(cover[:-1]) == 0
                    tokens = [tokens[k] for k in np.flatnonzero(stays).tolist()]
                gone.append(int(counts[i]) - len(tokens))
                kept.append(b" ".join(tokens))
                parsed.append([{"start": s, "length": n, "document": r} for s, n, r in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(
                        parsed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("document", pa.int64())]))
                    ),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "factors"],
            )

    def looked_up(entries: DataFrame, reduce) -> DataFrame:
        found = (
            entries.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, FOUND)
        )
        return found.groupBy("id").agg(F.collect_list("h").alias("h"), F.collect_list("r").alias("r"))

    shared = looked_up(placed.mapInArrow(anchors, PACKED), _shared)
    candidates = placed.join(shared, placed.doc_id == shared.id).select("doc_id", "text", "h")
    copied = looked_up(candidates.mapInArrow(lookups, PACKED), _not_first)
    return (
        placed.join(copied, placed.doc_id == copied.id, "left")
        .select("doc_id", "text", "h", "r")
        .mapInArrow(
            parse,
            "doc_id long, n_words long, n_removed long, kept string, "
            "factors array<struct<start:long,length:long,document:long>>",
        )
        .withColumn("doc_id", F.when(F.col("doc_id") >= NO_ID + NO_IDS, F.col("doc_id")))
    )


@query(
    "op1_substring_dedup",
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), runs AS (
        SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS run
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
    ), owners AS (SELECT run, min(doc_id) AS owner FROM runs GROUP BY run
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM runs JOIN owners USING (run) WHERE doc_id > owner
    ), marks AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(coalesce(g, [])) AS n_removed,
           sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' ')) AS kept_sha256
    FROM words LEFT JOIN marks USING (doc_id)
    """,
)
def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
