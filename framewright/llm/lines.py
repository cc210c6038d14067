"""Line dedup: repeated lines stay only in the document with the smallest id.

Lines are exploded as hashes of their keys, the documents of a hash are counted in one aggregation, and
the hashes to drop go back to their documents, which are put together again by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import chunks, hex_digest, query, table, utf8
from framewright.sources.shared import materialise


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, A-Z lower-cased line; None for a key under `min_chars` code points."""
    key = line.strip().lower()  # both act on ASCII only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """`docs` with the text that is left and `n_lines`, `n_dropped` (long) of each row.

    A text is split at \\n. Lines whose key has at least `min_chars` code points and is found in at
    least `min_docs` documents are dropped, except in the smallest document holding the key.
    Null and empty texts are one empty line and come back as they are. Rows that repeat an id are one
    document. A row without an id is left as it is and counts for no other. Other columns are kept,
    whatever their names, unless they are called `n_lines` or `n_dropped`, which are replaced. Very long texts and lines
    are read whole; an empty table gives no rows.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids, found = [], []
            for i, x in zip(batch.column("id").to_pylist(), utf8(batch.column("text")), strict=True):
                mine = {line_key(line, min_chars) for line in x.split(b"\n")} - {None}
                ids += [i] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "key"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    held = narrow.filter("id is not null and text is not null").mapInArrow(keys, "id long, key binary")
    # Map-side combining leaves one row per task of a line that a third of the documents share. Its owner is
    # written, so that the join is one of two plain shuffled sides, of which adaptive execution splits such a line.
    many = F.count_distinct("id") if min_docs > 2 else F.when(F.min("id") < F.max("id"), 2).otherwise(1)
    shared = held.groupBy("key").agg(F.min("id").alias("owner"), many.alias("docs")).filter(F.col("docs") >= min_docs)
    shared = materialise(shared.select("key", "owner"), "lines")
    drops = (
        held.join(shared, "key")
        .filter(F.col("id") > F.col("owner"))
        .groupBy("id")
        .agg(F.collect_set("key").alias("__drop"))  # rows that repeat an id share one list
    )
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    at = kept.index(text)
    schema = T.StructType(
        [*[docs.schema[c] for c in kept], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            texts, lines, dropped = [], [], []
            for x, drop in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                parts, gone = (x or "").split("\n"), set(drop or ())
                left = parts
                if gone:
                    left = [line for line in parts if line_key(line.encode(), min_chars) not in gone]
                texts.append(x if x is None else "\n".join(left))
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            columns = batch.columns[: len(kept)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*kept, "n_lines", "n_dropped"]
            )

    drops = drops.withColumnRenamed("id", "__id")
    joined = docs.select(*kept).join(drops, F.col(doc_id).cast("long") == F.col("__id"), "left")
    return joined.select(*kept, "__drop").mapInArrow(rebuild, schema)


@query(
    "op5_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
        FROM documents
    ), keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), owners AS (
        SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2
    ), marked AS (
        SELECT k.*, o.owner IS NOT NULL AND k.doc_id > o.owner AS gone FROM keyed k LEFT JOIN owners o USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op5_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_dropped", hex_digest(F.coalesce("text", F.lit(""))).alias("kept_sha256")
    )
