"""Exact medians per set without holding a large set in one task.

Equal values are counted first and collapse on the map side. The counts are placed in 65,536 bins per binade; the
bin that holds the middle ranks is found from bin totals, and only the distinct values of that bin are
ordered. Every window here is over bins or over the values of one bin, so a set with a third of all
rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BINS = 65536
_LAST = (1100 + 1100) * _BINS  # beyond the bins of all finite numbers


def _bin(value: Column) -> Column:
    """A number that never decreases when `value` grows; infinities have the first and the last bin."""
    size = F.abs(value)
    binade = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), binade) - 1.0) * _BINS)
    place = (binade + 1100) * _BINS + F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), inside))
    return (
        F.when(value == 0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), (F.signum(value) * _LAST).cast("bigint"))
        .otherwise((F.signum(value) * place).cast("bigint"))
    )


def exact_medians(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row per set with `<name>` (median, NULL if no value) and `n_<name>` (count) per measure.

    A measure is an expression; its NULL and NaN values are left out. A set without any value keeps its row.
    """
    long = df.select(
        F.struct(*by).alias("__set"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("m"), F.nullif(expression.cast("double"), F.lit(float("nan"))).alias("v"))
                    for name, expression in measures.items()
                ]
            )
        ).alias("x"),
    ).select("__set", F.col("x.m").alias("__m"), F.col("x.v").alias("__v"))
    # A set of NULLs is one row here, so that it is not lost.
    counted = long.groupBy("__set", "__m", "__v").agg(F.count(F.lit(1)).alias("__c"))
    group = ["__set", "__m"]
    known = counted.filter(F.col("__v").isNotNull()).withColumn("__bin", _bin(F.col("__v")))
    bins = known.groupBy(*group, "__bin").agg(F.sum("__c").alias("__c"))
    through = F.sum("__c").over(W.partitionBy(*group).orderBy("__bin").rowsBetween(W.unboundedPreceding, 0))
    middle = (
        bins.withColumn("__through", through)
        .withColumn("__n", F.sum("__c").over(W.partitionBy(*group)))
        .withColumn("__low", F.floor((F.col("__n") + 1) / 2))
        .withColumn("__high", F.floor(F.col("__n") / 2) + 1)
        .withColumn("__before", F.col("__through") - F.col("__c"))
        .filter((F.col("__before") < F.col("__high")) & (F.col("__through") >= F.col("__low")))
        .drop("__c", "__through")
    )
    upto = F.col("__before") + F.sum("__c").over(
        W.partitionBy(*group, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    )
    ranked = known.join(middle, [*group, "__bin"]).withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__c"))
    empty = counted.filter(F.col("__v").isNull()).select(
        *group, F.lit(None).cast("double").alias("__v"), *[F.lit(None).cast("bigint").alias(c) for c in ("__n", "__low", "__high", "__from", "__upto")]
    )
    holds = lambda rank: F.max(F.when(F.col(rank).between(F.col("__from") + 1, F.col("__upto")), F.col("__v")))
    found = (
        ranked.select(*empty.columns)
        .unionByName(empty)
        .groupBy("__set")
        .pivot("__m", list(measures))
        # Both ranks in one value: no sum, which opposite infinities would spoil and large values overflow.
        .agg(
            F.when(holds("__low") == holds("__high"), holds("__low"))
            .otherwise((holds("__low") + holds("__high")) / 2)
            .alias("median"),
            F.max("__n").alias("n"),
        )
    )
    return found.select(
        *[F.col("__set")[c].alias(c) for c in by],
        *[F.col(f"{name}_median").alias(name) for name in measures],
        *[F.coalesce(F.col(f"{name}_n"), F.lit(0).cast("bigint")).alias(f"n_{name}") for name in measures],
    )
