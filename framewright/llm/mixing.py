"""Mixing sources to target weights by weighted fair queueing.

Every document, in an order shuffled by a hash of its id, gets a virtual finish time: the words of its
source up to and with it, divided by the source's target. Repeats follow one whole source later. All are
sorted by that time and cut where the budget ends. Running sums are taken inside fixed slices of the
hash (or of time) and joined to the sums of the slices before, so a source that holds a third of all rows is
as parallel as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.base import query, table
from framewright.sources.shared import materialise

SLICES = 4096  # slices of the hash per source, and of one unit of virtual time
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """`source`, `source_size`, `target` from one row per source (`source`, `source_size`).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; a
    target above `most` times its size is set to that, and what is over goes to the others by weight.
    Sorted by size against weight the capped ones come first, so one running sum finds them.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy()  # one row per source
    ranked = sizes.withColumn("nth", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "weight", weight.cast("long")
    )
    cap = F.col("source_size") * most
    before = everything.orderBy(F.col("ratio"), F.col("nth")).rowsBetween(W.unboundedPreceding, -1)
    marked = (
        ranked.withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", cap * F.col("rest_weight") < F.col("rest") * F.col("weight"))
    )
    taken = F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(everything), F.lit(0))
    taken_weight = F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    share = (F.col("weight") * (F.col("total") - taken)).cast("double") / (F.col("all_weight") - taken_weight)
    return marked.select(
        "source", "source_size", "total", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: `doc_id`, `size` (words), `source_size`, `target`, `taken` (words taken, with repeats).

    The budget is the sum of all sizes. Null texts have size 0; documents of size 0 are never taken.
    A null source is a source of its own, a null id is placed by its text. Repeated rows each get their own place.
    The order hangs on ids and sizes only, so that reruns agree. An empty table gives an empty result.
    Columns named in `carry` are returned too; the others are not, so their names do not matter.
    """
    sized = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))).alias("key"),
            *carry,
        ).withColumn("slice", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * SLICES / 2**32).cast("int")),
        "sized",
    )
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_repeats)
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))

    def named(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(F.col("source").alias("s"), *[F.col(c).alias(f"_{c}") if c == "slice" else F.col(c) for c in columns])

    offsets = slices.join(named(targets, "source_size", "total", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    found = sized.join(
        named(offsets, "slice", "before", "source_size", "total", "target"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("_slice")),
    )
    placed = materialise(
        found.withColumn("through", F.col("before") + F.sum("size").over(within)).select(
            "doc_id", "key", "size", "source_size", "total", "target", "through", *carry
        ),
        "placed",
    )

    def finish(nth) -> Column:
        return (F.col("through") + F.col("source_size") * nth) / F.col("target")

    rounds = (
        placed.filter("size > 0 and target > 0")
        .select("*", F.explode(F.array(*[F.lit(n) for n in range(max_repeats)])).alias("nth"))
        .withColumn("finish", finish(F.col("nth")))
        .withColumn("part", F.least(F.floor(F.col("finish") * SLICES), F.lit(2 * SLICES)).cast("int"))
    )
    order = ("finish", "key", "doc_id", "size", "nth")
    parts = rounds.groupBy("part").agg(F.sum("size").alias("part_size"), F.first("total").alias("total"))
    upto = F.sum("part_size").over(W.partitionBy().orderBy("part").rowsBetween(W.unboundedPreceding, 0))  # at most 2 * SLICES + 1 rows
    edge = parts.withColumn("upto", upto).filter("upto > total").orderBy("part").first()
    taken = F.lit(max_repeats)  # without an edge the budget takes everything
    if edge is not None:
        before = edge["upto"] - edge["part_size"]
        running = F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        cut = (
            rounds.filter(F.col("part") == edge["part"])
            .withColumn("running", running + before)
            .filter(F.col("running") > edge["total"])
            .orderBy(*order)
            .first()
        )

        def precedes(nth: int) -> Column:
            """Whether repeat `nth` of a row comes before the first one over the budget."""
            answer = F.lit(nth) < cut["nth"]
            for c, v in zip(reversed(order[:-1]), [cut[c] for c in reversed(order[:-1])], strict=True):
                value = finish(F.lit(nth)) if c == "finish" else F.coalesce(F.col(c), F.lit("" if c == "key" else -(2**63)))
                v = -(2**63) if v is None else v
                answer = (value < v) | ((value == v) & answer)
            return answer

        taken = sum((precedes(n).cast("int") for n in range(max_repeats)), F.lit(0))
    return placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), taken * F.col("size")).otherwise(0).cast("long").alias("taken"),
        *carry,
    )


@query(
    "op9_mixing",
    r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               md5(CAST(doc_id AS VARCHAR)) AS key
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
        FROM sized GROUP BY source
    ), running AS (
        SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS rest,
               sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
        FROM sources
        WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), capped AS (SELECT *, 3 * source_size * rest_weight < rest * weight AS c FROM running
    ), targets AS (
        SELECT source, source_size, sum(source_size) OVER () AS total,
               CASE WHEN c THEN 3.0::DOUBLE * source_size
                    ELSE (weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (c) OVER (), 0)))::DOUBLE
                         / (sum(weight) OVER () - coalesce(sum(weight) FILTER (c) OVER (), 0))::DOUBLE END AS target
        FROM capped
    ), placed AS (
        SELECT d.doc_id, d.key, d.size, t.source_size, t.total, t.target,
               sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS through
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ), rounds AS (
        SELECT *, (through + source_size * nth)::DOUBLE / target AS finish
        FROM placed, (SELECT unnest([0, 1, 2]) AS nth) WHERE size > 0 AND target > 0
    ), cut AS (
        SELECT doc_id, size, sum(size) OVER (ORDER BY finish, key, doc_id, size, nth ROWS UNBOUNDED PRECEDING) <= total AS inside
        FROM rounds
    ), taken AS (SELECT doc_id, sum(size) FILTER (inside) AS taken FROM cut GROUP BY doc_id)
    SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
    FROM placed p LEFT JOIN taken t USING (doc_id)
    """,
)
def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
