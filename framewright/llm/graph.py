"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.sources.shared import materialise


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the edges."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.max(F.hash("a", "b")).alias("m")
    ).first()
    return tuple(row)


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest of a node and its neighbours, for each node `a` of `edges`. Combined before the shuffle."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).select(F.col("a").alias("node"), "low")


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node reachable) for every node of `links` (`a`, `b`: long).

    A large star ties the larger neighbours of a node to its smallest one, a small star the smaller ones
    and itself; both keep connectivity and settle after a number of rounds that grows with the logarithm of
    the size. Each round is an aggregation and a join, so a node with very many links is no single group.
    Links of a node to itself and repeated links change nothing; nulls are left out; no links give no rows.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = materialise(edges.distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_smallest(both), F.col("a") == F.col("node"))
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        low = _smallest(large)
        small = (
            large.join(low, F.col("a") == F.col("node"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        edges = materialise(small, "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
