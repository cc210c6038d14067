"""From raw documents to token ids: quality, repeated lines, near copies, mix of sources, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to the shared folder
and reads again for the next one. All but the last return the columns of `documents`, extra ones as they came.
Nulls, empty texts and repeated rows are treated as the operators say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.bpe import bpe
from framewright.llm.lines import line_dedup
from framewright.llm.mixing import mix
from framewright.llm.near import near_duplicates
from framewright.llm.quality import classify
from framewright.sources.shared import materialise

#: No SQL: the first stage is a fitted classifier and the last one a tokenizer. Tested against brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """`docs` with columns that an operator would replace renamed, and what selects all columns by their old names."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(aside), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    docs, columns = _aside(docs, "quality_score", "good")
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("good").select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller one has; those that lose every line go. `n_chars` is counted anew."""
    docs, columns = _aside(docs, "n_lines", "n_dropped")
    left = line_dedup(docs)
    emptied = (F.col("n_dropped") > 0) & (F.col("n_dropped") == F.col("n_lines"))
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.filter(~emptied).withColumn("n_chars", counted).select(*columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8. Rows without an id stay."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that are not taken go, one that is taken n times comes n times.

    Rows are told apart by a number that is written with them, so repeated and missing ids are rows like any other.
    """
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    times = (F.col("taken") / F.col("size")).cast("int")
    taken = mix(rows, carry=("__row",)).filter("taken > 0").select(F.col("__row").alias("__taken"), times.alias("__times"))
    nth = F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__nth")
    return rows.join(taken, F.col("__row") == F.col("__taken")).select(*docs.columns, nth).drop("__nth")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    out = bpe(docs.select("doc_id", "source", "text"))
    return out.select(
        "doc_id",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixing), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
