"""What the operators share: the registry of their queries, table access and small Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BLANKS = " \t\n\x0b\x0c\r"  # the characters [\x20\x09-\x0D]; also what bytes.split() and bytes.strip() take
CHUNK_BYTES = 8_000_000  # text that a task works on at once


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most `most` bytes of text, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def cut_up(cuts: np.ndarray, *arrays: np.ndarray) -> list[list[bytes]]:
    """The bytes of each array from each cut to the next one. An array may be empty for nothing at all."""
    starts = cuts.tolist()
    return [[x[s:e].tobytes() for s, e in zip(starts, [*starts[1:], None], strict=False)] for x in arrays]


def hex_digest(column) -> Column:
    """Lowercase hex SHA-256 of a string or binary column."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)
