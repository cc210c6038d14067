"""Scan index and metadata cache as partitioned parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = (
    "path string, name_lower string, size bigint, mtime timestamp, sha256 string, updated_at timestamp, "
    "scan_key string, tree string"
)


def exists(spark: SparkSession, location: str) -> bool:
    """Whether anything has been written at `location`."""
    try:
        spark.read.schema("x int").parquet(location)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def scan_key(import_root, backup_root) -> Column:
    """Stable key of a pair of roots."""
    return F.sha1(F.concat_ws("|", F.lower(import_root), F.lower(backup_root)).cast("binary"))


def write_index(snapshot: DataFrame, location: str, key: str, tree: str) -> None:
    """Replace the snapshot of one (scan_key, tree), by nothing if it is empty, and leave all others as they are."""
    columns = [c for c in snapshot.columns if c not in ("scan_key", "tree", "updated_at")]
    stamped = snapshot.select(*columns, F.current_timestamp().alias("updated_at"))
    stamped.write.mode("overwrite").parquet(f"{location}/scan_key={key}/tree={tree}")


def write_metadata(rows: DataFrame, location: str, key: str) -> None:
    """Replace the cached metadata of one scan (path, size, mtime and the described columns)."""
    rows.drop("scan_key").write.mode("overwrite").parquet(f"{location}/scan_key={key}")


def read_metadata(spark: SparkSession, location: str, schema: str | None = None) -> DataFrame:
    """The cached metadata of all scans, with their scan_key; a condition on it prunes folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(location)


def clear_index(spark: SparkSession, location: str, key: str, tree: str) -> None:
    """Leave no rows of one snapshot."""
    empty = spark.createDataFrame([], INDEX_SCHEMA).drop("scan_key", "tree")
    empty.write.mode("overwrite").parquet(f"{location}/scan_key={key}/tree={tree}")


def read_index(spark: SparkSession, location: str, key: str, tree: str, schema: str | None = None) -> DataFrame:
    """Rows of one snapshot; both conditions prune folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(location).filter((F.col("scan_key") == key) & (F.col("tree") == tree)).drop("scan_key", "tree")
