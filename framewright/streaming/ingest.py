"""Pick-up of files added or changed since the last run.

What is known is told by the index alone, not by a stream's memory of file ages: a file that arrives with an old
date (from a memory card, say) is found like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.names import MEDIA_EXTENSIONS, base_name, has_extension
from framewright.sources import index
from framewright.sources.files import file_hashes, read_files

INGESTED = "path string, name_lower string, size bigint, mtime timestamp, sha256 string"


def new_files(spark: SparkSession, folder: str, location: str, extensions=MEDIA_EXTENSIONS, glob: str | None = None) -> DataFrame:
    """Listed files whose path, size and time the index at `location` does not have; no file is opened."""
    found = read_files(spark, folder, glob=glob).filter(has_extension("path", extensions))
    listing = found.select(
        "path",
        F.lower(base_name("path")).alias("name_lower"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )
    if not index.exists(spark, location):
        return listing
    return listing.join(spark.read.schema(INGESTED).parquet(location), ["path", "size", "mtime"], "left_anti").select(*listing.columns)


def ingest_new_files(spark: SparkSession, folder: str, location: str, extensions=MEDIA_EXTENSIONS, glob: str | None = None) -> None:
    """Hash what is new and append it to the index at `location`; a run that fails leaves nothing behind.

    A file that was rewritten comes as one more row with its new size and time.
    """
    new = new_files(spark, folder, location, extensions, glob)
    new.join(file_hashes(new), "path", "left").select("path", "name_lower", "size", "mtime", "sha256").write.mode("append").parquet(location)
