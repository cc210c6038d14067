"""Image lists: text files with one path per line; the file stem names the component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.names import base_name, stem, strip
from framewright.operators.spread import with_row_number


def parse_image_lists(lines: DataFrame, list_path="list_path", order: list[str] | None = None, line="line") -> DataFrame:
    """Lines -> component, line_no (among non-blank lines), filename."""
    order = order or ["line_order"]
    kept = lines.withColumn("__text", strip(line)).filter(F.col("__text") != "")
    counted = with_row_number(kept, [list_path], order, "line_no")
    return counted.select(stem(list_path).alias("component"), "line_no", base_name("__text").alias("filename"))


def read_image_lists(spark: SparkSession, paths) -> DataFrame:
    """Lines keep the order of their file: block start first, then position within the block."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("list_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("within"),
        F.col("value").alias("line"),
    )
    return parse_image_lists(lines, "list_path", ["block", "within"])
