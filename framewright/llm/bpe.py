"""Byte-level BPE encoding and decoding by monoid tree reduction.

The pieces of a text are encoded each on its own. A piece is halved down to short leaves, which are merged
directly; two neighbours are joined by looking at their border. A row of tokens is the encoding of its
bytes exactly if every two neighbouring tokens are the encoding of their own bytes. So if the two tokens at the
border pass that test, the rows are simply concatenated; else a window around the border is encoded anew
and grows until both of its own borders pass, which proves that nothing outside can change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import chunks, query, table

RANKS = "byte_bpe_50k.tiktoken"
LEAF_BYTES = 24
CACHED_PIECES = 300_000  # per Python worker; the cache is emptied when it is full
CHUNK_BYTES = 4_000_000


class Encoder:
    """The encoding of pieces under one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging of a short string: again and again the leftmost pair of the lowest rank."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best = at = None
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[x] for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their own bytes."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHED_PIECES:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both rows together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            data = b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b]))
            middle = self.merge(data) if len(data) <= 2 * LEAF_BYTES else self.halves(data)
            if (a == 0 or self.stable(left[a - 1], middle[0])) and (b == len(right) or self.stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            if a == 0 and b == len(right):
                return middle
            width *= 2

    def halves(self, data: bytes) -> list[int]:
        """Encode by halving; rows of the tree are kept in a stack, so that depth is no recursion of Python."""
        rows = [self.merge(data[i : i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(rows) > 1:
            rows = [self.join(rows[i], rows[i + 1]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        return rows[0] if rows else []

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.merge(data) if len(data) <= LEAF_BYTES else self.halves(data)

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers, remembered."""
        ids = self.pieces.get(text)
        if ids is None:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            ids = np.array(self.encode(text.encode()), "<u4").tobytes()
            if len(text) <= 64:
                self.pieces[text] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        known, piece = self.pieces.get, self.piece
        return b"".join([known(x) or piece(x) for x in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids: those of the halves, concatenated."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, with its caches."""
    return Encoder(read_ranks(path))


def bpe(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with `n_tokens`, `ids` (binary, little-endian unsigned 32-bit) and `decoded` (binary) of each row.

    Null and empty texts have no tokens. The file at `path` must be there on every executor, as with an
    installed package. Rows are encoded one by one, so repeated rows and nulls elsewhere do not matter; input
    columns with the three new names are replaced, others stay. Very long texts are encoded whole; an empty table gives no rows.
    """
    path = path or public_tokenizers.path(RANKS)
    new = ("n_tokens", "ids", "decoded")
    kept = [c for c in docs.columns if c.lower() not in new]
    schema = T.StructType(
        [
            *[docs.schema[c] for c in kept],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("decoded", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in chunks(batches, text, CHUNK_BYTES):
            ids = [codec.text(x) if x else b"" for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(map(codec.decode, ids), pa.binary()),
                ],
                [*kept, *new],
            )

    return docs.select(*kept).mapInArrow(run, schema)


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    out = bpe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
