"""Running totals and successors that stay parallel when one key holds most of the rows.

None of these collects a group: an ordered window runs inside range-partitioned chunks, of which only the
edges are stitched together. Joins need nothing of the kind: adaptive execution splits their hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SPREAD = 1 << 20


def _in_chunks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Range-partition by group and order, so that a large group covers several partitions in order."""
    return df.repartitionByRange(*by, *order).withColumn("__chunk", F.spark_partition_id())


def _edge_group(is_edge: Column, by: list[str], order: list[str]) -> Column:
    """Window group of a row: -1 for chunk edges, anything else for the rest (whose value is unused)."""
    return F.when(is_edge, F.lit(-1).cast("bigint")).otherwise(
        F.pmod(F.xxhash64(*by, *order), F.lit(_SPREAD).cast("bigint"))
    )


def with_successor(df: DataFrame, by: list[str], order: list[str], pick: dict[str, str]) -> DataFrame:
    """Add columns of the following row of the same group: {new column: column of the next row}.

    `order` must be unique within a group. Rows without a successor get NULL.
    """
    payload = F.struct(*[F.col(src).alias(new) for new, src in pick.items()])
    within = W.partitionBy(*by, "__chunk").orderBy(*order)
    local = (
        _in_chunks(df, by, order)
        .withColumn("__next", F.lead(payload).over(within))
        .withColumn("__first", F.lag(F.lit(1)).over(within).isNull())
        .withColumn("__last", F.col("__next").isNull())
    )
    edges = local.withColumn("__edge", _edge_group(F.col("__first") | F.col("__last"), by, order))
    across = W.partitionBy(*by, "__edge").orderBy(*order)
    joined = edges.withColumn(
        "__next", F.when(F.col("__last"), F.lead(payload).over(across)).otherwise(F.col("__next"))
    )
    return joined.select(*df.columns, *[F.col(f"__next.{new}").alias(new) for new in pick])


def with_running_total(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the running sum of `value` (this row included) within the group, in `order`."""
    chunk = W.partitionBy(*by, "__chunk")
    ordered = chunk.orderBy(*order)
    local = (
        _in_chunks(df.withColumn("__value", value), by, order)
        .withColumn("__sum", F.sum("__value").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("__first", F.lag(F.lit(1)).over(ordered).isNull())
        .withColumn("__all", F.sum("__value").over(chunk))
        .withColumn("__edge", _edge_group(F.col("__first"), by, order))
    )
    across = W.partitionBy(*by, "__edge").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        local.withColumn(
            "__before",
            F.when(F.col("__first"), F.coalesce(F.sum("__all").over(across), F.lit(0))),
        )
        .withColumn(name, F.col("__sum") + F.max("__before").over(chunk))
        .select(*df.columns, name)
    )


def with_row_number(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return with_running_total(df, by, order, F.lit(1).cast("bigint"), name)
