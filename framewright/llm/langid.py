"""Language ID by bit-sliced Bloom filters of n-grams.

Each slot of one filter holds a bit per language, so that one look at the slots of an n-gram gives every language that
has it. Which n-grams a language has comes from counts over all documents learned from. A text is decided by
counting, for each language, the n-grams whose bit is set, less those that the filling of the filter lets one expect.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import chunks, query, table
from framewright.llm.words import mix

SLOTS = 1 << 20  # of the filter, which is this many words of 32 languages whatever the input's size
HASHES = 2
RARE = 2e-5  # a language has an n-gram if at least this share of its n-grams is that one,
LEANING = 0.3  # and this part of the share that it has in the language where it is most common
BITS = 32
CHUNK_BYTES = 4_000_000
_DENSE = 1 << 22


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for all that are no letters."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams (3 times 21 bits, 0 for what is no letter) with a letter in the middle, and each one's text."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    sizes = np.array([len(x) + 2 for x in codes], np.int64)
    flat = np.zeros(int(sizes.sum()), np.uint32)
    starts = np.cumsum(sizes) - sizes
    for s, x in zip(starts.tolist(), codes, strict=True):
        flat[s + 1 : s + 1 + len(x)] = x
    flat = _letters()[flat].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    middle = flat[1:-1] > 0
    packed = (flat[:-2] << np.uint64(42)) | (flat[1:-1] << np.uint64(21)) | flat[2:]
    return packed[middle], owner[1:-1][middle]


def slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and their counts; by a dense table where few letters occur."""
    letters = np.unique(grams & np.uint64(0x1FFFFF)) if len(grams) else grams
    letters = np.union1d(letters, np.unique((grams >> np.uint64(21)) & np.uint64(0x1FFFFF)))
    letters = np.union1d(letters, np.unique(grams >> np.uint64(42)))
    n = len(letters)
    if n**3 > _DENSE:
        return np.unique(grams, return_counts=True)
    place = np.zeros(int(letters[-1]) + 1 if n else 1, np.int64)
    place[letters.astype(np.int64)] = np.arange(n)
    a, b, c = (place[((grams >> np.uint64(s)) & np.uint64(0x1FFFFF)).astype(np.int64)] for s in (42, 21, 0))
    counts = np.bincount((a * n + b) * n + c)
    at = np.flatnonzero(counts)
    found = (letters[at // (n * n)] << np.uint64(42)) | (letters[at // n % n] << np.uint64(21)) | letters[at % n]
    return found, counts[at]


def learn(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """The languages, and the filter: words x SLOTS masks.

    Only totals per language and the filled slots come to the driver: a row per language and at most
    SLOTS rows for each 32 languages, whatever the size of the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            langs = batch.column("lang").to_pylist()
            grams, owner = trigrams([x or "" for x in batch.column("text").to_pylist()])
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])[owner]
            for k, name in enumerate(names):
                found, n = _counted(grams[of == k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    known = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # One row per trigram with its count in each language: a few hundred languages at most.
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("held"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    words = -(-len(langs) // BITS)
    place = {x: i for i, x in enumerate(langs)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, masks = [], []
            for gram, held in zip(batch.column("gram").to_pylist(), batch.column("held").to_pylist(), strict=True):
                shares = [(x["n"] / totals[x["lang"]], place[x["lang"]]) for x in held]
                most = max(s for s, _ in shares)
                mask = sum(1 << i for s, i in shares if s >= RARE and s >= LEANING * most)
                for w in range(words):
                    if part := mask >> (w * BITS) & 0xFFFFFFFF:
                        grams.append(gram)
                        masks.append((w, part))
            at = slots(np.array(grams, np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(at)),
                    pa.array([w for w, _ in masks] * HASHES, pa.int64()),
                    pa.array([m for _, m in masks] * HASHES, pa.int64()),
                ],
                ["slot", "word", "mask"],
            )

    filled = (
        by_gram.mapInArrow(fill, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    ).toPandas()
    table_ = np.zeros((max(words, 1), SLOTS), np.uint32)
    table_[filled.word.to_numpy(np.int64), filled.slot.to_numpy(np.int64)] = filled["mask"].to_numpy(np.uint32)
    return langs, table_


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (0 to 1: the part of its n-grams that the language has).

    A text that is null or has no letter is `und` with score 0, as is every text if nothing was learned. Ties go to the
    first language by code point. Each row is judged by its whole text alone, so repeated rows and other columns do not
    matter; columns of the two new names are replaced. An empty table gives no rows.
    """
    langs, masks = model
    shared = docs.sparkSession.sparkContext.broadcast(masks)  # of fixed size
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = T.StructType(
        [*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    filled = [(masks[i // BITS] >> np.uint32(i % BITS) & np.uint32(1)).mean() ** HASHES for i in range(len(langs))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in chunks(batches, text, CHUNK_BYTES):
            grams, owner = trigrams([x or "" for x in batch.column(text).to_pylist()])
            n = np.bincount(owner, minlength=batch.num_rows)
            hits = np.zeros((len(langs), batch.num_rows))
            at = slots(grams)
            for w in range(-(-len(langs) // BITS)):
                mask = table_[w][at[0]]
                for more in at[1:]:
                    mask = mask & table_[w][more]
                for i in range(w * BITS, min(len(langs), (w + 1) * BITS)):
                    mine = (mask >> np.uint32(i % BITS)) & np.uint32(1)
                    hits[i] = np.bincount(owner, mine, minlength=batch.num_rows)
            false = np.array(filled)[:, None]
            real = np.clip((hits - n * false) / (1 - np.minimum(false, 0.999)) / np.maximum(n, 1), 0, 1)
            best = real.argmax(0) if len(langs) else np.zeros(batch.num_rows, int)
            known = (n > 0) & bool(langs)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]),
                    pa.array([float(real[b, j]) if k else 0.0 for j, (b, k) in enumerate(zip(best.tolist(), known.tolist(), strict=True))]),
                ],
                [*kept, "lang_pred", "score"],
            )

    return docs.select(*kept).mapInArrow(predict, schema)


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(rest == 0, F.lit(True)))
    model = learn(docs.filter("not held_out"), "text", "lang")
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
