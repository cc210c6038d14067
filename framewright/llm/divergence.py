"""Source divergence audit: how far the term shares of the sources of a language lie apart.

A share hangs on a term's count alone, and few different counts ("levels") occur. In a block of terms every group
gets an indicator column for each of its levels; the product of the indicators with their own transpose is, for every
two groups at once, the joint table of their levels. Joint tables times the prices of two levels, the distance of
the shares they stand for, add up to the distance of the groups. All of it is integers, and exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.base import chunks, partitions, query, table, utf8
from framewright.sources.shared import materialise

TERMS = 512  # terms of all languages in a block, about
STRIP = 32  # terms multiplied at once: no group has more levels in it
TILE = 32  # groups on either side of a product
FLUSH = 300_000  # counted terms that a task holds

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """`lang`, `source`, `term`, `n` (occurrences), `df` (rows that hold it); the empty term stands for the group itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def flush() -> Iterator[pa.RecordBatch]:
            for (own, of), (n, df) in found.items():
                columns = [pa.array([own] * len(df), pa.string()), pa.array([of] * len(df), pa.string()), pa.array(list(df), pa.binary())]
                counts = [pa.array([n[t] for t in df], pa.int64()), pa.array(list(df.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *counts], ["lang", "source", "term", "n", "df"])
            found.clear()

        held = 0
        for batch in chunks(batches, "text"):
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, x in zip(groups, utf8(batch.column("text")), strict=True):
                terms = x.translate(_FOLD).split()
                n, df = found[group]
                held -= len(df)
                n.update(terms)
                df.update({b"", *terms})
                held += len(df)
            if held >= FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    parts = narrow.mapInArrow(count, "lang string, source string, term binary, n long, df long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(counts: np.ndarray, total: int, terms: int, prior: int, parts: int) -> np.ndarray:
    """1 + floor(10**parts * (count + prior) / (total + prior * terms)), a digit at a time; exact while the divisor is below 9e17."""
    divisor = np.int64(total + prior * terms)
    rest, out = counts + np.int64(prior), np.zeros(len(counts), np.int64)
    out, rest = rest // divisor, rest % divisor
    for _ in range(parts):
        rest = rest * 10
        out, rest = out * 10 + rest // divisor, rest % divisor
    return out + 1


def _columns(counts: np.ndarray, totals: list[int], terms: int, prior: int, parts: int):
    """One-hot columns (group, level) of a strip of terms, where each group's begin, and the price of each column."""
    hot, starts, prices = [], [], []
    at = 0
    for g, total in enumerate(totals):
        levels, which = np.unique(counts[:, g], return_inverse=True)
        block = np.zeros((len(counts), len(levels)), np.float32)
        block[np.arange(len(counts)), which] = 1
        hot.append(block)
        starts.append(at)
        at += len(levels)
        prices.append(shares(levels, total, terms, prior, parts))
    return np.concatenate(hot, axis=1), np.array(starts), np.concatenate(prices)


def distances(counts: np.ndarray, totals: list[int], terms: int, prior: int, parts: int, a: slice, b: slice) -> np.ndarray:
    """Summed distances of the shares of groups `a` and `b` over the terms (rows) of `counts`."""
    out = np.zeros((len(totals[a]), len(totals[b])), np.int64)
    for s in range(0, len(counts), STRIP):
        strip = counts[s : s + STRIP]
        left, la, pa_ = _columns(strip[:, a], totals[a], terms, prior, parts)
        right, lb, pb = (left, la, pa_) if a == b else _columns(strip[:, b], totals[b], terms, prior, parts)
        joint = (left.T @ right).astype(np.int64)  # exact: no count is above STRIP
        joint *= np.abs(pa_[:, None] - pb[None, :])
        out += np.add.reduceat(np.add.reduceat(joint, la, axis=0), lb, axis=1)
    return out


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = 30,
    prior: int = 5,
    digits: int = 9,
    top: int = 50,
) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank` for each group (lang, source).

    Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, of which only A-Z are lower-cased; a language keeps those in at
    least `min_docs` of its rows (V of them). A group gives each kept term the share
    p = 1 + floor(10**digits * (count + prior) / (N + prior * V)), N being its count of kept terms. Part `pair` has every
    other source of the language as item and the sum of |p - p of that source| as value (0 where nothing is kept). Part
    `term` has the `top` kept terms of the group whose p is above that of the whole language, and by how much.
    Ranks go by value, largest first, ties by item.

    Null texts, languages and sources count as empty ones; a group without terms is a group. Very long texts are
    counted whole, repeated rows count each, other columns are not read, an empty table gives no rows. What meets
    in one task is a block of about 512 terms with one count for each source of its language that has it.
    """
    spark = docs.sparkSession
    deals = partitions(spark)
    counted = materialise(term_counts(docs, text, lang, source), "counted")
    by_term = counted.filter("term <> ''").groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("held")
    )
    kept = materialise(by_term.filter(F.col("df") >= min_docs).drop("df"), "kept")
    single = kept.select("lang", "term", F.col("n").alias("whole"), F.explode("held").alias("h")).select("lang", "term", "whole", "h.*")
    sums = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sums = sums.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("whole")).withColumnRenamed("lang", "l")
    members = counted.filter("term = ''").select("lang", "source")
    members = members.join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
    groups = members.select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
    langs = langs.join(of_lang, F.col("lang") == F.col("l"), "left").select("lang", "groups", F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), "whole")
    langs = materialise(langs, "langs")

    n_blocks = max(1, -(-kept.count() // TERMS))
    block = F.pmod(F.xxhash64("lang", "term"), F.lit(n_blocks)).alias("block")
    blocks = kept.groupBy("lang", block).agg(F.collect_list("held").alias("helds"))
    facts = langs.select(F.col("lang").alias("l"), "groups", "terms")
    filled = blocks.join(facts, F.col("lang") == F.col("l")).select("lang", "block", "groups", "terms", "helds")
    # The whole result of a language without kept terms: its groups are all at distance 0.
    bare = langs.filter("terms = 0").select(
        "lang", F.lit(0).cast("long").alias("block"), "groups", "terms", F.expr("CAST(array() AS array<array<struct<source:string,n:long>>>)").alias("helds")
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                name, terms = row.column("lang")[0].as_py(), row.column("terms")[0].as_py()
                groups = row.column("groups").flatten()
                names, totals = groups.field("source").to_pylist(), groups.field("total").to_pylist()
                helds = row.column("helds").flatten()
                held, sizes = helds.flatten(), helds.value_lengths().to_numpy(zero_copy_only=False)
                place = {x: i for i, x in enumerate(names)}
                counts = np.zeros((len(helds), len(names)), np.int64)
                at = np.array([place[x] for x in held.field("source").to_pylist()], np.int64)
                counts[np.repeat(np.arange(len(helds)), sizes.astype(np.int64)), at] = held.field("n").to_numpy(zero_copy_only=False)
                for i in range(0, len(names), TILE):
                    for j in range(i, len(names), TILE):
                        a, b = slice(i, min(i + TILE, len(names))), slice(j, min(j + TILE, len(names)))
                        value = distances(counts, totals, terms, prior, digits, a, b)
                        x, y = np.nonzero(np.triu(np.ones(value.shape, bool), 1) if i == j else np.ones(value.shape, bool))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(x), pa.string()),
                                pa.array([names[i + t] for t in x.tolist()], pa.string()),
                                pa.array([names[j + t] for t in y.tolist()], pa.string()),
                                pa.array(value[x, y], pa.int64()),
                            ],
                            ["lang", "a", "b", "value"],
                        )

    dealt = filled.unionByName(bare).repartition(deals, "lang", "block")
    tiles = dealt.mapInArrow(multiply, "lang string, a string, b string, value long")
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", sides.alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    def share(count: str, total: str):
        top_ = F.lit(10**digits).cast("decimal(19,0)") * (F.col(count) + prior).cast("decimal(19,0)")
        return top_, (F.col(total) + prior * F.col("terms")).cast("decimal(19,0)")

    kinds = langs.select(F.col("lang").alias("l"), "terms", F.col("whole").alias("all"), F.explode("groups").alias("g")).select(
        "l", "terms", "all", F.col("g.source").alias("s"), F.col("g.total").alias("total")
    )
    found = single.join(kinds, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")))
    for name, count, total in (("p", "n", "total"), ("q", "whole", "all")):
        up, down = share(count, total)
        found = found.withColumn("__up", up).withColumn("__down", down).withColumn(name, F.expr("`__up` div `__down`"))
    terms = found.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


@query(
    "op12_source_divergence",
    r"""
    WITH docs AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), groups AS (SELECT DISTINCT lang, source FROM docs
    ), found AS (
        SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
    ), kept AS (
        SELECT lang, term, count(*) AS whole FROM found GROUP BY ALL HAVING count(DISTINCT id) >= 30
    ), counts AS (
        SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
    ), full_counts AS (
        SELECT g.lang, g.source, k.term, k.whole, coalesce(c.n, 0) AS n,
               sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
               count(*) OVER (PARTITION BY g.lang, g.source) AS v
        FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
    ), langs AS (SELECT lang, sum(whole) AS total FROM kept GROUP BY lang
    ), shared AS (
        SELECT f.*, 1 + (1000000000::HUGEINT * (n + 5)) // (f.total + 5 * v) AS p,
               1 + (1000000000::HUGEINT * (whole + 5)) // (l.total + 5 * v) AS q
        FROM full_counts f JOIN langs l USING (lang)
    ), pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM shared WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM parts
    )
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
)
def op12_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))
