"""MinHash near-dedup with SetSketch registers.

Every set of word shingles becomes a row of registers, each the exponent of a truncated exponential minimum;
sketches of parts merge by the register-wise maximum. Equal bands of registers make candidates, the joint
likelihood of two sketches estimates their similarity, and full sets confirm it. A group of copies is never
expanded into pairs: documents with one and the same set are one node, a band ties its documents to its smallest
one only, and what lies in one band but is not yet connected is compared afterwards, in blocks, of which only
the links that tie something new are returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import chunks, cut_up, partitions, query, table, utf8
from framewright.llm.graph import components
from framewright.llm.words import mix, runs, word_hashes
from framewright.sources.shared import materialise

BASE, RATE, TOP = 1.001, 20.0, 65534  # b, a and q of the sketch: registers 0..q+1 fit 16 bits
ROWS = 5  # registers in a band
MISSED = 1e-7  # a pair at the threshold shares no band, or is estimated under the cut, with at most this probability
BLOCK = 512  # documents of a band compared with as many others at once
_FEW = 1 << 16


def bands_for(similarity: float) -> int:
    """Bands needed so that pairs at the threshold are missed no more often than MISSED."""
    return math.ceil(math.log(MISSED) / math.log1p(-(similarity**ROWS)))


def estimate_cut(similarity: float, bands: int) -> float:
    """Estimate under which pairs are not confirmed: what the bands leave of MISSED at the threshold.

    Of two sets of one size the estimate hangs on the number of equal registers only, which is binomial. The cut
    lies half a register under the least number that is confirmed.
    """
    registers, left = bands * ROWS, MISSED - (1 - similarity**ROWS) ** bands
    tail = same = 0
    while True:
        tail += math.comb(registers, same) * similarity**same * (1 - similarity) ** (registers - same)
        if tail > left:
            return (same - 0.5) / registers
        same += 1


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and how many each has."""
    hashes, counts = word_hashes([x.lower() for x in texts])
    every = runs(hashes, words)
    starts = np.cumsum(counts) - counts
    out, sizes = [], []
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        if n >= words:
            mine = every[start : start + n - words + 1]
        elif n:
            mine = runs(hashes[start : start + n], n) ^ np.uint64(n)
        else:
            mine = every[:0]
        mine = np.unique(mine)
        out.append(mine)
        sizes.append(len(mine))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(sizes, np.int64)


def sketches(sets: np.ndarray, sizes: np.ndarray, registers: int) -> np.ndarray:
    """A row of registers for each set; all 0 for an empty one."""
    out = np.zeros((len(sizes), registers), np.uint16)
    full = np.flatnonzero(sizes)
    first = 0
    while first < len(full):  # some 64k shingles at a time stay in the processor's cache
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[full[first:]]), _FEW, "right")))
        rows = full[first:last]
        low = int(sizes[: rows[0]].sum())
        mine = sets[low : low + int(sizes[rows].sum())]
        cuts = np.cumsum(sizes[rows]) - sizes[rows]
        smallest = np.empty((registers, len(rows)), np.uint64)
        factor = mix(np.arange(1, registers + 1, dtype=np.uint64)) | np.uint64(1)
        shift = mix(np.arange(registers + 1, 2 * registers + 1, dtype=np.uint64))
        for k in range(registers):
            smallest[k] = np.minimum.reduceat(mine * factor[k] + shift[k], cuts)
        minimum = -np.log1p(-(smallest.T.astype(np.float64) + 0.5) * 2.0**-64) / RATE
        out[rows] = np.clip(np.floor(1 - np.log(minimum) / math.log(BASE)), 0, TOP + 1)
        first = last
    return out


def _likelihood(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray):
    """Log-likelihood of a similarity, given two sketches and the sizes of their sets; it has one peak.

    It counts the registers that are larger, smaller and equal, whose shares follow from the similarity.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n / (n + m), m / (n + m)

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def at(j):
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        rest = np.maximum(1 - up - down, 1e-300)
        return more * np.log(np.maximum(up, 1e-300)) + less * np.log(np.maximum(down, 1e-300)) + same * np.log(rest)

    return at, np.minimum(u / v, v / u)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely similarity of the sets under each pair of sketches, given the sizes of the sets."""
    at, high = _likelihood(a, b, n, m)
    low = np.zeros(len(n))
    for _ in range(30):
        third = (high - low) / 3
        left = at(low + third) < at(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is at least `least`: the likelihood has one peak, so it is enough that it still climbs there."""
    at, high = _likelihood(a, b, n, m)
    return (high >= least) & (at(np.minimum(least + 1e-4, high)) >= at(np.full(len(n), least - 1e-4)))


def _unpack(column: pa.Array, registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, registers)


def _band_keys(sketch: np.ndarray) -> np.ndarray:
    """64-bit key of each band, telling bands apart."""
    n, registers = sketch.shape
    wide = sketch.astype(np.uint64).reshape(n, registers // ROWS, ROWS)
    key = mix(np.arange(registers // ROWS, dtype=np.uint64))[None, :]
    for k in range(ROWS):
        key = mix(key ^ wide[:, :, k])
    return key


def held(batches: Iterator[pa.RecordBatch], words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each shingle of a chunk once, with a document that has it and whether several do, packed by bucket."""
    for batch in chunks(batches, "text"):
        sets, sizes = shingle_sets(utf8(batch.column("text")), words)
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), sizes)
        sets, first, n = np.unique(sets, return_index=True, return_counts=True)
        bucket = (mix(sets) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [x[order] for x in (sets, ids[first], n > 1)]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        cells = cut_up(cuts, *columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[cuts]), *[pa.array(c, pa.binary()) for c in cells]], ["bucket", "h", "d", "several"]
        )


def held_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of each document no other has, bucket by bucket; rows come sorted by bucket."""

    def counted(rows):
        h, d, several = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, bool), strict=True))
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        alone = first[(n == 1) & ~several[first]]
        ids, lone = np.unique(d[alone], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lone.astype(np.int64))], ["id", "lone"])

    rows, at = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "d", "several")), strict=True):
            if bucket != at and rows:
                yield counted(rows)
                rows = []
            at = bucket
            rows.append(row)
    if rows:
        yield counted(rows)


TILE = ("band", "i", "j", "mine", "id", "root", "lone", "n", "sketch")


def _partners(rows: dict[str, np.ndarray], percent: int, least: float):
    """Positions (first, second) of the pairs of a tile that may be links between what is not yet connected.

    Shingles that no other candidate has bound what two documents can have in common; then the likelihood of
    the sketches decides. A pair is looked at in the first band that it shares, and nowhere else.
    """
    none = np.empty(0, int)
    left, right = np.flatnonzero(rows["mine"] == rows["i"]), np.flatnonzero(rows["mine"] == rows["j"])
    if not len(left) or not len(right) or rows["root"].min() == rows["root"].max():
        return none, none
    sketch, n, u, r, ids = (rows[c] for c in ("sketch", "n", "lone", "root", "id"))
    keys = _band_keys(sketch)
    at = keys.view(np.int64) == rows["band"][0]
    inside = at.any(1)  # not so for a sketch that only shares its id with one of the band
    if not inside.any():
        return none, none
    nth = int(at[inside.argmax()].argmax())
    left, right = left[inside[left]], right[inside[right]]
    first, second = [], []
    for s in range(0, len(left), 128):
        x = left[s : s + 128, None]
        common = np.minimum((n - u)[x], (n - u)[right])
        able = (100 * common >= percent * (n[x] + n[right] - common)) & (r[x] != r[right])
        able &= (ids[x] < ids[right]) if rows["i"][0] == rows["j"][0] else (ids[x] != ids[right])
        p, q = np.nonzero(able)
        p, q = left[p + s], right[q]
        for t in range(0, len(p), 20_000):
            ps, qs = p[t : t + 20_000], q[t : t + 20_000]
            here = (keys[ps] == keys[qs]).argmax(1) == nth
            ps, qs = ps[here], qs[here]
            if len(ps):
                good = likely(sketch[ps], sketch[qs], n[ps].astype(float), n[qs].astype(float), least)
                first.append(ps[good])
                second.append(qs[good])
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def _tiles(batches: Iterator[pa.RecordBatch], registers: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one tile after the other as arrays; they come sorted by tile."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in TILE[:-1]}
        rows["sketch"] = _unpack(batch.column("sketch"), registers)
        if held:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in TILE}
        new = np.ones(len(rows["band"]), bool)
        new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in TILE[:3]], axis=0)
        cuts = np.flatnonzero(new).tolist()
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield {c: x[s:e] for c, x in rows.items()}
        held = {c: x[cuts[-1] :] for c, x in rows.items()}
    if held:
        yield held


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per input row: `doc_id`, `n_shingles`, `component_id`, `kept`.

    Shingles are `words` consecutive words, A-Z lower-cased; a shorter text is one shingle, a text without
    words is empty and linked with nothing. Documents with 100 * common >= percent * united shingles are linked,
    and `component_id` is the smallest document reachable. Rows that repeat an id are one document: links of any of
    them count for all. Rows without an id have no component and are kept. Other columns are not returned.
    Very long texts have all their shingles; an empty table gives no rows.
    """
    spark = docs.sparkSession
    registers = ROWS * bands_for(percent / 100)
    buckets = 4 * partitions(spark)
    least = estimate_cut(percent / 100, registers // ROWS)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2_000_000):
            sets, sizes = shingle_sets(utf8(batch.column("text")), words)
            made = sketches(sets, sizes, registers)
            cuts = np.cumsum(sizes)
            digest = [
                hashlib.blake2b(sets[e - n : e].tobytes(), digest_size=16).digest() if n else None
                for e, n in zip(cuts.tolist(), sizes.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array([x.tobytes() if n else None for x, n in zip(made, sizes.tolist(), strict=True)], pa.binary()),
                ],
                ["doc_id", "n", "digest", "sketch"],
            )

    sketched = materialise(narrow.mapInArrow(sketch, "doc_id long, n long, digest binary, sketch binary"), "sketches")
    owners = materialise(
        sketched.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "owners"
    )
    nodes = (
        sketched.join(owners, ["digest"])
        .filter("doc_id = rep")
        .select("doc_id", "n", "sketch")
        .dropDuplicates(["doc_id", "sketch"])
    )

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_unpack(batch.column("sketch"), registers))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], ["band", "id"]
                )

    # A hot band is pre-aggregated on the map side, and its written owners meet the documents in a plain join.
    in_bands = nodes.select("doc_id", "sketch").mapInArrow(band, "band long, id long")
    centres = materialise(
        in_bands.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("top")).filter("centre < top"), "bands"
    )
    stars = materialise(
        in_bands.join(centres.select("band", "centre"), "band")
        .filter("id <> centre")
        .groupBy("id", "centre")
        .agg(F.count(F.lit(1)).alias("shared")),
        "stars",
    )
    ids = stars.select("id").unionByName(stars.select(F.col("centre").alias("id"))).distinct()
    candidates = nodes.join(ids, nodes.doc_id == ids.id).select("id", "n", "sketch")
    candidates = materialise(candidates.join(narrow, candidates.id == narrow.doc_id).select("id", "n", "sketch", "text"), "candidates")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_b", 1_000_000):
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            rows = likely(*(_unpack(batch.column(c), registers) for c in ("sketch_a", "sketch_b")), n, m, least)
            few = batch.filter(pa.array(rows))
            a, na = shingle_sets(utf8(few.column("text_a")), words)
            b, nb = shingle_sets(utf8(few.column("text_b")), words)
            ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
            linked = []
            for k in range(few.num_rows):
                common = len(np.intersect1d(a[ends_a[k] - na[k] : ends_a[k]], b[ends_b[k] - nb[k] : ends_b[k]], True))
                linked.append(100 * common >= percent * int(na[k] + nb[k] - common))
            yield few.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links."""

        def side(x: str) -> DataFrame:
            return candidates.select(
                F.col("id").alias(f"id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "text")]
            )

        both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
        # Sizes alone rule out what the smaller set cannot reach.
        able = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        columns = ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "text_a", "text_b")
        return both.filter(able).select(*columns).mapInArrow(confirm, "a long, b long")

    # First the one centre that shares most bands with a document, then what is still apart.
    best = stars.groupBy("id").agg(F.max_by("centre", F.struct("shared", -F.col("centre"))).alias("b"))
    links = materialise(confirmed(best.select(F.col("id").alias("a"), "b")), "confirmed")
    roots = materialise(components(links), "roots")

    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        known = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return df.join(known, F.col(column) == F.col("__node"), "left").select(
            *df.columns, F.coalesce("__root", F.col(column)).alias(name)
        )

    lone = (
        candidates.select("id", "text")
        .mapInArrow(lambda batches: held(batches, words, buckets), "bucket int, h binary, d binary, several binary")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(held_once, "id long, lone long")
        .groupBy("id")
        .agg(F.sum("lone").alias("lone"))
        .withColumnRenamed("id", "__lone")
    )
    # Lone shingles are counted per id: with several texts under one id they bound none of them, so they are left out.
    several = owners.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select(F.col("rep").alias("__several"))
    lone = lone.join(several, F.col("__lone") == F.col("__several"), "left_anti")
    apart = rooted(candidates.select("id", "n", "sketch"), "id", "root").join(lone, F.col("id") == F.col("__lone"), "left")
    apart = apart.select("id", "n", "sketch", "root", F.coalesce("lone", F.lit(0)).alias("lone"))
    apart = materialise(apart.dropDuplicates(["id", "sketch"]), "apart")

    def rooted_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_unpack(batch.column("sketch"), registers))
                take = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), batch.column("id").take(take), batch.column("root").take(take)],
                    ["band", "id", "root"],
                )

    members = apart.select("id", "root", "sketch").mapInArrow(rooted_bands, "band long, id long, root long")
    mixed = materialise(
        members.groupBy("band")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held"))
        .filter("low < high")
        .select("band", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")),
        "mixed",
    )
    # Each pair of blocks of a band is a group of at most about 2 * BLOCK rows.
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = (
        members.join(mixed, "band")
        .select("band", "id", block.alias("mine"), other.alias("other"))
        .select("band", "id", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    known = apart.withColumnRenamed("id", "__id")
    # Few bytes but much work: the number of tasks is not left to the size of what they read.
    tiles = (
        tiles.join(known, tiles.id == known["__id"])
        .select(*TILE)
        .repartition(partitions(spark), "band", "i", "j")
        .sortWithinPartitions("band", "i", "j")
    )

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each tile that have a partner worth confirming: never more rows than came in."""
        names, out, size = TILE[:7], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in names], list(names))

        for rows in _tiles(batches, registers):
            a, b = _partners(rows, percent, least)
            if len(a):
                both = np.union1d(a, b)
                out.append({c: rows[c][both] for c in names})
                size += len(both)
            if size > 10_000:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    def spanning(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Confirmed links of a tile that tie what is not yet tied: fewer than it has rows."""
        rows = {c: pdf[c].to_numpy() for c in TILE[:-1]}
        rows["sketch"] = np.frombuffer(b"".join(pdf.sketch), np.uint16).reshape(-1, registers)
        a, b = _partners(rows, percent, least)
        found, roots_ = [], {}

        def root(x: int) -> int:
            while roots_.get(x, x) != x:
                x = roots_[x]
            return x

        if len(a):
            sets, sizes = shingle_sets([x.encode() for x in pdf.text], words)
            names, place = np.unique(sets, return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            ids, roots_of = rows["id"], rows["root"]
            for x in np.unique(a).tolist():
                mark = np.zeros(len(names), np.int64)
                mark[place[starts[x] : starts[x] + sizes[x]]] = 1
                common = np.add.reduceat(mark[place], starts)
                linked = 100 * common >= percent * (sizes + sizes[x] - common)
                for y in b[(a == x) & linked[b]].tolist():
                    p, q = root(roots_of[x]), root(roots_of[y])
                    if p != q:
                        roots_[max(p, q)] = min(p, q)
                        found.append((ids[x], ids[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    hopeful = tiles.mapInArrow(promising, "band long, i int, j int, mine int, id long, root long, lone long")
    texts = candidates.withColumnRenamed("id", "__id")
    more = materialise(
        hopeful.join(texts, hopeful.id == texts["__id"])
        .groupBy("band", "i", "j")
        .applyInPandas(spanning, "a long, b long")
        .distinct(),
        "confirmed",
    )
    if not more.isEmpty():
        roots = materialise(components(links.unionByName(more)), "roots")
    # From a row to the node of its set, from there to its root; rows that repeat an id take the smallest.
    placed = rooted(
        sketched.select("doc_id", "n", "digest").join(owners.select("digest", "rep"), "digest", "left"), "rep", "root"
    ).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("root"))
    return placed.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"),
    )


@query(
    "op8_near_dedup",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s
        FROM words
    ), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
    ), common AS (
        SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
        FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
            AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id
    ), links AS (SELECT i, j FROM common WHERE 100 * c >= 85 * (n + m - c)
    ), reach AS (
        SELECT doc_id AS i, doc_id AS j FROM sets UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i
    ), roots AS (SELECT i, min(j) AS root FROM reach GROUP BY i)
    SELECT doc_id, len(s) AS n_shingles, root AS component_id, doc_id = root AS kept
    FROM sets JOIN roots ON doc_id = i
    """,
)
def op8_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
