"""Exact dedup by owners in Patricia tries.

Texts without blanks go into compressed radix tries over their full bytes. Every task first builds a trie
of what it reads, so that of a text it holds many times one row travels; those rows meet in partitions by
length and content hash, where tries over the full bytes decide equality, whatever the hash says.
A trie that outgrows its bound spills its largest subtree, that is, hands its entries on as partial results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import BLANKS, chunks, query, table, utf8
from framewright.sources.shared import materialise

TRIE_BYTES = 64_000_000
MEMBERS = 100_000  # copies of one text that a task holds before it hands them on


class Node:
    __slots__ = ("edges", "entry")

    def __init__(self):
        self.edges: dict[int, list] = {}  # first byte -> [label, child]
        self.entry = None


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Byte strings, each with one entry at its terminal node."""

    def __init__(self):
        self.root, self.held = Node(), 0

    def slot(self, key: bytes) -> Node:
        """The terminal node of `key`, made if need be."""
        node, rest = self.root, key
        while rest:
            edge = node.edges.get(rest[0])
            if edge is None:
                child = Node()
                node.edges[rest[0]] = [rest, child]
                self.held += len(rest) + 200
                return child
            label, child = edge
            if rest.startswith(label):
                node, rest = child, rest[len(label) :]
                continue
            n = common(label, rest)
            middle = Node()
            middle.edges[label[n]] = [label[n:], child]
            node.edges[rest[0]] = [label[:n], middle]
            self.held += 200
            node, rest = middle, rest[n:]
        return node

    def entries(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        todo = [(node or self.root, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node.entry is not None:
                yield prefix, node.entry
            todo += [(child, prefix + label) for label, child in node.edges.values()]

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Cut off the largest subtree below the root and yield its entries."""
        size = {k: sum(len(key) for key, _ in self.entries(child, label)) for k, (label, child) in self.root.edges.items()}
        if not size:
            return
        label, child = self.root.edges.pop(max(size, key=size.get))
        yield from self.entries(child, label)
        self.held = sum(len(key) + 200 for key, _ in self.entries())


def better(a: tuple, b: tuple) -> tuple:
    """The owner of two (code points, doc_id): most code points, then smallest id."""
    return a if (-a[0], a[1]) <= (-b[0], b[1]) else b


def local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; the first holder of a text in the task carries text, best owner and count of all."""
    names = ["id", "rep", "digest", "size", "bytes", "points", "best", "n"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    serial = 0

    def rows(entries):
        out = []
        for key, (rep, best, members) in entries:
            digest = hashlib.sha256(key).digest()
            for k, i in enumerate(members):
                own = (key, best[0], best[1], len(members)) if k == 0 else (None, None, None, None)
                out.append((i, rep, digest, len(key), *own))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names
        )

    trie = Trie()
    for batch in chunks(batches, "text"):
        ids, points, place = (batch.column(c).to_pylist() for c in ("id", "points", "place"))
        for i, n, x, p in zip(ids, points, utf8(batch.column("text")), place, strict=True):
            node = trie.slot(x.translate(None, BLANKS.encode()))
            owner = (n, i)
            if node.entry is None:
                node.entry = ((p << 33) + serial, owner, [i])
                serial += 1
            else:
                rep, best, members = node.entry
                members.append(i)
                node.entry = (rep, better(best, owner), members)
                trie.held += 50
                if len(members) >= MEMBERS:
                    yield rows([(x.translate(None, BLANKS.encode()), node.entry)])
                    trie.held -= 50 * len(members)
                    node.entry = None
        while trie.held > TRIE_BYTES and trie.root.edges:
            yield rows(trie.spill())
            trie.held += 50 * sum(len(members) for _, (_, _, members) in trie.entries())
    yield rows(trie.entries())


def merged_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner and size for each representative; rows come sorted by length and hash, so a trie holds one such pair."""
    trie, at = Trie(), None

    def flush():
        for _, (best, n, held) in trie.entries():
            for s in range(0, len(held), MEMBERS):
                reps = held[s : s + MEMBERS]
                columns = (reps, [best[1]] * len(reps), [n] * len(reps))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "keep_id", "group_size"])

    for batch in batches:
        for size, digest, key, rep, points, best, n in zip(
            *(batch.column(c).to_pylist() for c in ("size", "digest", "bytes", "rep", "points", "best", "n")), strict=True
        ):
            if (size, digest) != at:
                if at is not None:
                    yield from flush()
                trie, at = Trie(), (size, digest)
            node = trie.slot(key)
            owner, count, held = node.entry or ((points, best), 0, [])
            held.append(rep)
            node.entry = (better(owner, (points, best)), count + n, held)
    if at is not None:
        yield from flush()


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when they are identical after deleting blanks; null counts as empty. The row with
    the most code points, then the smallest id stays. A repeated row counts as often as it occurs
    and all rows of the staying id are kept. Rows without an id are groups of their own text like any other,
    ordered after all ids; other columns are not returned. Very long texts are compared in all their bytes; an empty
    table gives no rows.
    """
    narrow = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("id"),
        F.col(text).alias("text"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"),
        F.spark_partition_id().cast("long").alias("place"),
    )
    local = materialise(
        narrow.mapInArrow(
            local_tries, "id long, rep long, digest binary, size long, bytes binary, points long, best long, n long"
        ),
        "tries",
    )
    owners = (
        local.filter("bytes is not null")
        .repartition("size", "digest")
        .sortWithinPartitions("size", "digest")
        .mapInArrow(merged_tries, "rep long, keep_id long, group_size long")
    )
    joined = local.select("id", "rep", "digest").join(owners, "rep")
    real = lambda c: F.nullif(F.col(c), F.lit(2**63 - 1))
    return joined.select(
        real("id").alias(doc_id),
        real("keep_id").alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query(
    "op4_exact_dedup",
    r"""
    WITH bare AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM bare WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    """,
)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
