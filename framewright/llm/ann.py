"""Nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks of 8-bit vectors with their scales and the lengths of their rounding errors,
and only those blocks travel, those of the candidates once: every tile of one block of each is a matrix product, whose errors
the lengths bound. What can still be among the nearest of a query over all its tiles is computed again in double precision from
the original vectors, and the lists are merged by heaps. The result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import partitions, query, table
from framewright.sources.shared import materialise

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192  # vectors; bounds what a task holds
BLOCK_BYTES = 1 << 23  # of a block of candidates, if there are so many that every core has blocks of CANDIDATE_BLOCK
STRIPE, COLUMNS = 256, 8192  # queries and candidates multiplied at once
EXACT_SUM = 1 << 24  # integers below this are exact in single precision
UNIT = 16  # powers of two that bounds stay below the largest number, so that sums of them do not overflow


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by powers of two so that their largest component is below 1, and the powers."""
    power = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -power[:, None]), power


def quantised(x: np.ndarray):
    """8-bit vectors, scales, lengths of the errors and of the rounded vectors."""
    scale = np.maximum(np.abs(x).max(1) / 127, 1e-300)
    q = np.rint(x / scale[:, None])
    rounded = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(x - rounded, axis=1), np.linalg.norm(rounded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _first(k: int, query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the k best of each query id, in order."""
    order = np.lexsort((vec_id, -score, query_id))
    ordered = query_id[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


#: What a block has for each of its vectors, and the kinds of numbers: the place of its row, its id, how many equal rows it
#: stands for, its power of two, scale, lengths of its error, of the rounded and of the scaled vector, and the 8 bits of each component.
FIELDS = {"row": np.int64, "id": np.int64, "times": np.int64, "power": np.int64, "scale": float, "error": float, "rounded": float, "length": float, "bits": np.int8}
PACKED = "block int, dim int, " + ", ".join(f"{c} binary" for c in FIELDS)
PAIRS = "query_row long, row long, lower double, upper double"


def block_of(row: np.ndarray, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The vectors of a block without their components in full precision."""
    x, power = scaled(vectors)
    bits, scale, error, rounded = quantised(x)
    values = (row, ids, times, power, scale, error, rounded, np.linalg.norm(x, axis=1), bits)
    return {c: np.ascontiguousarray(v, kind) for (c, kind), v in zip(FIELDS.items(), values, strict=True)}


def _kth_largest(group: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th largest value of each of n groups, -inf for those of fewer."""
    order = np.lexsort((-value, group))
    starts = np.searchsorted(group[order], np.arange(n + 1))
    last = starts[:-1] + k - 1
    return np.where(last < starts[1:], value[order][np.minimum(last, len(order) - 1)], -np.inf) if len(order) else np.full(n, -np.inf)


def tile(queries: dict[str, np.ndarray], candidates: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """Pairs of a query and a candidate that may be among the query's k nearest of this tile, with bounds of their product.

    A query's own scale is left out, so bounds are for comparing the candidates of one query only. What overflows
    nowhere may underflow, but is rounded the same way on both sides. Bounds are made of the first COLUMNS candidates, and
    then only of those whose product, with the largest slack of their columns, reaches the k-th lower bound so far.
    """
    q, c = queries, candidates
    parts = []
    most = q["bits"].shape[1] * 127 * 127
    kind = np.float32 if most < EXACT_SUM else np.float64
    right, unit = c["bits"].astype(kind).T, np.ldexp(1.0, c["power"] - UNIT)
    weight = c["scale"] * unit
    rounded, error = c["rounded"] * unit, (c["error"] + 1e-12 * c["rounded"]) * unit
    for s in range(0, len(q["id"]), STRIPE):
        e = min(s + STRIPE, len(q["id"]))
        left, least = q["bits"][s:e].astype(kind), np.full(e - s, -np.inf)
        rows, columns, lowers, uppers = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for t in range(0, len(c["id"]), COLUMNS):
            some = slice(t, t + COLUMNS)
            dots = left @ right[:, some]
            heaviest = weight[some].max()
            if t and heaviest > 1e-250:
                slack = q["error"][s:e] * rounded[some].max() + q["length"][s:e] * error[some].max()
                # Products in units of the heaviest column; what single precision may lose is far below the millionth part
                reach = (least - slack * (1 + 1e-9)) / (q["scale"][s:e] * heaviest) - 1e-6 * most
                with np.errstate(over="ignore"):
                    reach = reach.astype(kind)
                i, j = np.nonzero(dots * (weight[some] / heaviest).astype(kind) >= reach[:, None])
                near = dots[i, j].astype(np.float64) * q["scale"][s + i] * c["scale"][t + j]
                j += t
                # |xy - x'y'| <= |x - x'| |y'| + |x| |y - y'|, and a little for the rounding of the sums themselves
                slack = q["error"][s + i] * c["rounded"][j] + q["length"][s + i] * (c["error"][j] + 1e-12 * c["rounded"][j])
                lower, upper = (near - slack) * unit[j], (near + slack) * unit[j]
                kept = (upper >= least[i]) & (q["id"][s + i] != c["id"][j])
                i, j, lower, upper = i[kept], j[kept], lower[kept], upper[kept]
            else:
                near = dots.astype(np.float64) * q["scale"][s:e, None] * c["scale"][some]
                slack = q["error"][s:e, None] * c["rounded"][some] + q["length"][s:e, None] * (c["error"][some] + 1e-12 * c["rounded"][some])
                own = q["id"][s:e, None] == c["id"][None, some]
                lower = np.where(own, -np.inf, (near - slack) * unit[some])
                upper = np.where(own, -np.inf, (near + slack) * unit[some])
                n = lower.shape[1]
                if n > k:
                    least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
                i, j = np.nonzero((upper >= least[:, None]) & ~own)
                lower, upper, j = lower[i, j], upper[i, j], j + t
            rows, columns = np.concatenate([rows, i]), np.concatenate([columns, j])
            lowers, uppers = np.concatenate([lowers, lower]), np.concatenate([uppers, upper])
            least = np.maximum(least, _kth_largest(rows, lowers, k, e - s))
            kept = uppers >= least[rows]
            rows, columns, lowers, uppers = rows[kept], columns[kept], lowers[kept], uppers[kept]
        parts.append((q["row"][s + rows], c["row"][columns], lowers, uppers))
    names = [x.split()[0] for x in PAIRS.split(", ")]
    return {n: np.concatenate(x) for n, x in zip(names, zip(*parts, strict=True), strict=True)}


def _whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows in pieces that hold all rows of each of their keys; they come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1] for c in keys]
        same = np.logical_and.reduce([np.asarray(pa.compute.equal(batch.column(c), x)) for c, x in zip(keys, last, strict=True)])
        start = int(np.argmax(same))
        if start or (held and [held[-1].column(c)[held[-1].num_rows - 1] for c in keys] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, start)], batch.schema)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def smallest_of_equal(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` smallest ids of each vector, in order."""
    order = np.argsort(ids, kind="stable")
    whole = np.ascontiguousarray(vectors[order] + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, group = np.unique(whole, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    rank[by_group] = np.arange(len(group)) - np.searchsorted(group[by_group], group[by_group])
    return np.sort(order[rank < most])


def _pack(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Sorted rows of vectors to one row for each block, of equal vectors with the `most` smallest ids only."""
    for piece in _whole_groups(batches, "block", "dim"):
        blocks, dims = (piece.column(c).to_numpy() for c in ("block", "dim"))
        cuts = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(dims, prepend=-1) != 0)).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
            part = piece.slice(s, e - s)
            vectors = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
            vectors, facts = vectors.astype(np.float64), [part.column(c).to_numpy() for c in ("row", "id", "times")]
            if most is not None:
                kept = smallest_of_equal(vectors, facts[1], most)
                vectors, facts = vectors[kept], [x[kept] for x in facts]
            made = block_of(*facts, vectors)
            cells = [pa.array([x.tobytes()], pa.binary()) for x in made.values()]
            yield pa.RecordBatch.from_arrays([pa.array([blocks[s]], pa.int32()), pa.array([dims[s]], pa.int32()), *cells], ["block", "dim", *FIELDS])


def blocks_of(asking: int, n: int, dim: int, cores: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of candidates.

    A tile leaves k pairs or more of each of its queries, so candidates stand in few blocks, but in two a core or more as
    long as those are not below CANDIDATE_BLOCK, and none is much above BLOCK_BYTES.
    """
    largest = max(CANDIDATE_BLOCK, BLOCK_BYTES // (dim + 64))
    down = max(math.ceil(n / largest), min(math.ceil(n / CANDIDATE_BLOCK), 2 * cores))
    return max(1, math.ceil(asking / QUERY_BLOCK)), max(1, down)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every_row: bool = False,
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` of the k rows of largest inner product for each query row.

    A query's own id is no candidate. Vectors that are null, all zero, or hold null or non-finite components take
    no part, and vectors meet only those of their own length. Ties go to the smaller id. With `every_row`, every row is
    a candidate and every asking row asks, however often its id or its vector is repeated: a query id has one list over
    all its rows. Without it, rows that repeat an id (and a length) count once, with the smallest of their vectors, and
    ask if one of them does. With fewer than k candidates all are returned; an empty table gives no rows. Vectors may be of any
    magnitude; a product that is no finite number has that value, or none (null) where infinities cancel out.
    """
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("dim"), is_query.alias("asks"), bad.alias("bad")
    ).filter("id is not null and vector is not null and not bad and exists(vector, x -> x <> 0)")
    if every_row:
        # Only equal rows are combined, and counted: many rows of one id are dealt to all blocks.
        rows = rows.groupBy("id", "dim", "vector").agg(F.count(F.lit(1)).alias("there"), F.count_if("asks").alias("asking"))
    else:
        # Combined before the shuffle, so that a block holds each id once, however often it is repeated.
        rows = rows.groupBy("id", "dim").agg(
            F.min("vector").alias("vector"), F.lit(1).cast("long").alias("there"), F.bool_or("asks").cast("long").alias("asking")
        )
    # Single precision is kept as it is, at half the size; every product is of numbers in double precision.
    single = rows.schema["vector"].dataType.elementType == T.FloatType()
    exact = F.col("vector") if single else F.transform("vector", lambda x: x.cast("double"))
    rows = rows.select("id", "dim", exact.alias("vector"), "there", "asking", F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("asking") > 0).alias("asking"), F.max("dim").alias("dim")).first()
    across, down = blocks_of(counts["asking"], counts["n"], counts["dim"] or 0, vectors.sparkSession.sparkContext.defaultParallelism)
    deals = partitions(vectors.sparkSession)

    def packed(df: DataFrame, times: str, n: int, side: str, most: int | None) -> DataFrame:
        """The blocks of one side."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _pack(batches, most)

        block = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block")
        dealt = df.select("row", "id", "dim", "vector", F.col(times).alias("times"), block).repartition(deals, "block", "dim")
        blocks = materialise(dealt.sortWithinPartitions("block", "dim", "row").mapInArrow(pack, PACKED), "blocks")
        return blocks.select(F.col("block").alias(f"{side}_block"), F.col("dim").alias(f"{side}_dim"), *[F.col(c).alias(f"{side}_{c}") for c in FIELDS])

    # Equal vectors tie, and ties go to the smaller ids: no list takes more than k of them besides the query's own.
    there = packed(rows, "there", down, "c", k + 1)
    # The blocks of queries go to every block of candidates. How much that makes is unknown to the planner, which would
    # send them all through the driver for a broadcast; so both sides are dealt out by the block, and merged.
    asked = packed(rows.filter("asking > 0"), "asking", across, "q", None)
    asked = asked.withColumn("q_c", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    tasks = max(deals, 4 * down)
    meeting = (F.col("q_c") == F.col("c_block")) & (F.col("q_dim") == F.col("c_dim"))
    tiles = asked.repartition(tasks, "q_c", "q_dim").join(there.repartition(tasks, "c_block", "c_dim").hint("merge"), meeting)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                dim = batch.column("q_dim")[at].as_py()
                sides = []
                for side in "qc":
                    one = {c: np.frombuffer(batch.column(f"{side}_{c}")[at].as_py(), kind) for c, kind in FIELDS.items()}
                    sides.append(one | {"bits": one["bits"].reshape(-1, dim)})
                found = tile(*sides, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], list(found))

    def still_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all tiles of a query: the pairs whose upper bound reaches the k-th largest lower one."""
        for piece in _whole_groups(batches, "query_row"):
            row, lower = piece.column("query_row").to_numpy(), piece.column("lower").to_numpy()
            order = np.lexsort((-lower, row))
            starts = np.flatnonzero(np.diff(row[order], prepend=-1))
            sizes = np.diff([*starts, len(row)])
            least = np.where(sizes >= k, lower[order][np.minimum(starts + k, len(row)) - 1], -np.inf)
            group = np.empty(len(row), np.int64)
            group[order] = np.repeat(np.arange(len(starts)), sizes)
            kept = piece.column("upper").to_numpy() >= least[group]
            yield from piece.filter(pa.array(kept)).select(["query_row", "row"]).combine_chunks().to_batches()

    pairs = tiles.mapInArrow(multiply, PAIRS).repartition(deals, "query_row").sortWithinPartitions("query_row")
    pairs = pairs.mapInArrow(still_near, "query_row long, row long")
    left = rows.filter("asking > 0").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), "asking", F.col("vector").alias("x"))
    right = rows.select("row", F.col("id").alias("vec_id"), "there", F.col("vector").alias("y"))
    times = F.least(F.col("asking") * F.col("there"), F.lit(k)).cast("long").alias("times")
    both = pairs.join(right, "row").join(left, "query_row").select("query_id", "vec_id", times, "x", "y")
    lists = "query_id long, vec_id long, score double, times long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of the original vectors; of those at hand the k best of a query."""
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("x")))
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x, y = (part.column(c).flatten().to_numpy().astype(np.float64, copy=False).reshape(-1, dim) for c in ("x", "y"))
                with np.errstate(over="ignore", invalid="ignore"):
                    value = products(x, y)
                ids, others, times = (part.column(c).to_numpy() for c in ("query_id", "vec_id", "times"))
                best = _first(k, ids, others, value)
                yield pa.RecordBatch.from_arrays([pa.array(c[best]) for c in (ids, others, value, times)], ["query_id", "vec_id", "score", "times"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One heap over the lists of a query."""
        for piece in _whole_groups(batches, "query_id"):
            ids = piece.column("query_id").to_numpy()
            others, scores, times = (piece.column(c).to_pylist() for c in ("vec_id", "score", "times"))
            cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)).tolist()
            out: list[tuple] = []
            for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                best = heapq.nsmallest(k, ((np.isnan(v), -v, i, n) for v, i, n in zip(scores[s:e], others[s:e], times[s:e], strict=True)))
                best = [(i, -v) for _, v, i, n in best for _ in range(n)][:k]
                out += [(int(ids[s]), rank, i, None if np.isnan(v) else v) for rank, (i, v) in enumerate(best, 1)]
            kinds = (("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    scored = both.mapInArrow(score, lists).repartition(deals, "query_id").sortWithinPartitions("query_id")
    return scored.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


@query(
    "op3_nearest",
    """
    WITH v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op3_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, every_row=True)
