"""Report writers. Text is UTF-8 without a byte-order mark, in one folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.names import base_name
from framewright.operators.report import export_rows

FILE_ROWS = 500_000  # rows of a compressed file

# Column names of the difference report.
REPORT_COLUMNS = {
    "original": "path",
    "date": "date_str",
    "source": "date_source",
    "destination": "dest_path",
    "status": "status",
}


def report_rows(plan: DataFrame) -> DataFrame:
    return plan.select(*[F.col(source).alias(name) for name, source in REPORT_COLUMNS.items()])


def write_report_csv(plan: DataFrame, location: str) -> None:
    report_rows(plan).write.option("header", True).option("escape", '"').csv(location)


def debug_rows(plan: DataFrame) -> DataFrame:
    return plan.select(base_name("path").alias("file"), "path", "date_str", "date_source", F.col("dest_path").alias("dest"))


def write_debug_json(plan: DataFrame, location: str) -> None:
    debug_rows(plan).write.json(location)


def export_quality_csv(results: DataFrame, location: str, compression: str | None = None) -> None:
    """The export as plain text, or compressed (`gzip`), as most of its 67 columns repeat.

    Compressed files are read by one task each, so they end after `FILE_ROWS` rows.
    """
    out = export_rows(results).write.option("header", True).option("escape", '"')
    if compression:
        out = out.option("maxRecordsPerFile", FILE_ROWS)
    out.csv(location, compression=compression)
