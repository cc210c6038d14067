"""Spelling variants: words that are one letter apart, each tied to a much more frequent neighbour.

Words become vectors of letter counts, filed in blocks by their length and by how many letters fall in each of a few
groups of the alphabet. One edit moves a word into the same or an adjacent block only, so a block meets the few blocks
beside it. Each meeting is a NumPy product of two count matrices (a block of the Gram matrix), which gives all squared
distances at once; pairs at most two apart are kept, and their letters are compared to verify the edit.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.base import chunks, partitions, query, table
from framewright.sources.shared import materialise

GROUPS = 6  # of letters, by code point modulo this; a block is a length and a count of each group
BLOCK_WORDS, BLOCK_LETTERS = 4096, 1 << 20  # bounds of a packed block, or one word
STRIPE_CELLS = 1 << 22  # cells of a product that are held at once
FLUSH = 200_000  # distinct words that a task counts before it hands them on
EXACT_SUM = 1 << 24  # integers below this are exact in single precision

# Bytes of Latin-1 text: letters stay, A-Z lower-cased, all else (and '?', which stands for characters beyond) parts words.
_LATIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, slip: int = 31) -> DataFrame:
    """`word`, `n`: occurrences of the words of all texts with at least `min_chars` letters.

    Words are maximal runs `[A-Za-z\\u00C0-\\u00FF]+`, of which only A-Z are lower-cased. Where `slip` divides the
    crc32 h of `<doc_id>:<run>`, the run loses its letter h % length (0 for `slip`: no run does). Null and empty
    texts have no words; a null id counts as an empty one. Very long texts are cut into words like any other, whole.
    Repeated rows count each. Other columns are not read; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in chunks(batches, "text"):
            for own, x in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs = x.encode("latin-1", "replace").translate(_LATIN).split()
                start = zlib.crc32(f"{own or ''}:".encode())
                for run, n in Counter([r for r in runs if len(r) >= min_chars]).items():
                    if slip:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % slip == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_chars:
                                continue
                    found[run] = found.get(run, 0) + n
                if len(found) >= FLUSH:
                    yield flush()
        yield flush()

    texts = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).filter("text is not null")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cells(words: list[str]) -> list[tuple[int, ...]]:
    """Letters of each word by group."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS)
    return list(map(tuple, counts.reshape(-1, GROUPS).tolist()))


def _key(cell) -> str:
    return ",".join(map(str, cell))


def _visits(cell: tuple[int, ...]) -> list[str]:
    """The block itself, those one replaced letter away (one of each two directions) and those one letter longer."""

    def moved(*steps: tuple[int, int]) -> str | None:
        out = list(cell)
        for i, d in steps:
            out[i] += d
        return _key(out) if min(out) >= 0 else None

    out = [_key(cell)]
    out += [moved((i, 1), (j, -1)) for i, j in combinations(range(GROUPS), 2)]
    out += [moved((i, 1)) for i in range(GROUPS)]
    return [x for x in out if x]


def _letters(row: dict) -> np.ndarray:
    """Code points of a packed block: a row per word. One byte each where all are below 256, else four."""
    kind = np.uint8 if len(row["letters"]) == row["m"] * row["length"] else np.uint32
    return np.frombuffer(row["letters"], kind).reshape(row["m"], row["length"])


def letter_counts(letters: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Counts of the letters of `alphabet` (sorted) in each row."""
    at = np.searchsorted(alphabet, letters)
    known = alphabet[np.minimum(at, len(alphabet) - 1)] == letters
    flat = np.arange(len(letters))[:, None] * (len(alphabet) + 1) + np.where(known, at, len(alphabet))
    counts = np.bincount(flat.ravel(), minlength=len(letters) * (len(alphabet) + 1))
    return counts.reshape(len(letters), -1)[:, :-1]


def _squares(letters: np.ndarray) -> np.ndarray:
    """Squared length of each row's count vector, over all its letters."""
    return (letter_counts(letters, np.unique(letters)).astype(np.int64) ** 2).sum(1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of `a` and `b` differ by one replaced letter, or, if `b` has one column more, by one inserted there."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return before + after >= a.shape[1]


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `a` and of `b` (as long, or one letter longer) that are one edit apart."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = np.float32 if b.shape[1] ** 2 * 2 < EXACT_SUM else np.float64
    alphabet = np.unique(a)  # other letters of b only add to its length
    left, right = (letter_counts(x, alphabet).astype(kind) for x in (a, b))
    aa, bb = _squares(a).astype(kind), _squares(b).astype(kind)
    rows, columns = [], []
    step = max(1, STRIPE_CELLS // len(b))
    for s in range(0, len(a), step):
        distance = left[s : s + step] @ right.T
        distance *= -2
        distance += aa[s : s + step, None]
        distance += bb[None, :]
        i, j = np.nonzero(distance <= 2)
        piece = max(1, STRIPE_CELLS // b.shape[1])
        for p in range(0, len(i), piece):
            ii, jj = i[p : p + piece] + s, j[p : p + piece]
            good = one_edit(a[ii], b[jj])
            rows.append(ii[good])
            columns.append(jj[good])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


class _Best:
    """For each of some words: how many near words were found, and the most frequent of them."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.near = np.zeros(len(words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, mine: np.ndarray, theirs: np.ndarray, other: _Best) -> None:
        self.near += np.bincount(mine, minlength=len(self.words))
        order = np.lexsort((-other.n[theirs], mine))
        for i, j in zip(mine[order].tolist(), theirs[order].tolist(), strict=True):
            found = (-int(other.n[j]), other.words[j])
            if i not in self.best or found < self.best[i]:
                self.best[i] = found

    def batch(self) -> pa.RecordBatch:
        at = sorted(self.best)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.words[i] for i in at], pa.string()),
                pa.array(self.near[at], pa.int64()),
                pa.array([self.best[i][0] for i in at], pa.int64()),
                pa.array([self.best[i][1] for i in at], pa.string()),
            ],
            ["word", "near", "minus", "form"],
        )


def _spelled(letters: np.ndarray) -> list[str]:
    flat = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + letters.shape[1]] for i in range(0, len(flat), letters.shape[1])]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words to packed blocks of one cell each."""
    held: list[tuple[str, int]] = []
    cell, out = None, []

    def close() -> None:
        if held:
            text = "".join(w for w, _ in held)
            narrow = max(text) < "Ā"
            counts = tuple(map(int, cell.split(",")))
            out.append(
                {
                    "cell": cell,
                    "first": held[0][0],
                    "m": len(held),
                    "length": sum(counts),
                    "letters": text.encode("latin-1") if narrow else text.encode("utf-32-le", "surrogatepass"),
                    "ns": np.array([n for _, n in held], "<i8").tobytes(),
                    "visits": _visits(counts),
                }
            )
            held.clear()

    def ready() -> pa.RecordBatch:
        names = {"cell": pa.string(), "first": pa.string(), "m": pa.int64(), "length": pa.int64(), "letters": pa.binary()}
        names |= {"ns": pa.binary(), "visits": pa.list_(pa.string())}
        batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in names.items()], list(names))
        out.clear()
        return batch

    size = 0
    for batch in batches:
        for at, word, n in zip(*(batch.column(c).to_pylist() for c in ("cell", "word", "n")), strict=True):
            if at != cell or len(held) >= BLOCK_WORDS or size + len(word) > BLOCK_LETTERS:
                close()
                cell, size = at, 0
            held.append((word, n))
            size += len(word)
        if len(out) >= 256 or sum(len(r["letters"]) for r in out) > BLOCK_LETTERS:
            yield ready()
    close()
    yield ready()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each home block against its visitors, which follow it in order."""
    home: _Best | None = None
    mine = first = cell = None
    waiting: list[dict] = []

    def compare() -> Iterator[pa.RecordBatch]:
        for shorter in (False, True):
            some = [r for r in waiting if (r["length"] < mine.shape[1]) == shorter]
            if not some:
                continue
            theirs = np.concatenate([_letters(r) for r in some])
            visitors = _Best(_spelled(theirs), np.concatenate([np.frombuffer(r["ns"], "<i8") for r in some]))
            if shorter:
                j, i = near_pairs(theirs, mine)
            else:
                i, j = near_pairs(mine, theirs)
                # Words of one block's cell meet twice; one of the two is kept.
                own = np.repeat([r["own"] == cell for r in some], [r["m"] for r in some])
                twice = own[j]
                if twice.any():
                    again = np.array([home.words[x] > visitors.words[y] for x, y in zip(i[twice], j[twice], strict=True)])
                    keep = np.ones(len(i), bool)
                    keep[np.flatnonzero(twice)[again]] = False
                    i, j = i[keep], j[keep]
            if len(i):
                home.add(i, j, visitors)
                visitors.add(j, i, home)
                yield visitors.batch()
        waiting.clear()

    words = 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["first"] != first:
                if home is not None:
                    yield from compare()
                    yield home.batch()
                first, cell, words = row["first"], row["own"], 0
                mine = _letters(row)
                home = _Best(_spelled(mine), np.frombuffer(row["ns"], "<i8"))
                continue
            waiting.append(row)
            words += row["m"]
            if words >= 2 * BLOCK_WORDS:
                yield from compare()
                words = 0
    if home is not None:
        yield from compare()
        yield home.batch()


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """`word`, `form`, `root` (string), `n`, `n_near`, `form_n` (long) for each row of `words` (`word`, `n`).

    Words are near if one inserted, deleted or replaced code point tells them apart. A word's `form` is its most
    frequent near word (ties: the smaller one by code points), if that is at least `ratio` (over 1) times as
    frequent, else null; `root` is the last of the forms followed from it, the word itself if it has none. Words may hold
    any code points and be of any length. A null or empty word and a null count are left out, repeated words are added
    up, an empty table gives no rows. What is gathered in one place is a block of bounded size with the blocks that visit it.
    """

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "word"):
            cells = pa.array(map(_key, _cells(batch.column("word").to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["word", "n", "cell"])

    known = words.filter("word <> '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = materialise(known.mapInArrow(celled, "word string, n long, cell string"), "words")
    deals = partitions(words.sparkSession)
    packed = "cell string, first string, m long, length long, letters binary, ns binary, visits array<string>"
    ordered = known.repartitionByRange(deals, "cell", "word").sortWithinPartitions("cell", "word")
    blocks = materialise(ordered.select("cell", "word", "n").mapInArrow(_pack, packed), "blocks")
    body = ("m", "length", "letters", "ns")
    visitors = blocks.select(F.explode("visits").alias("cell"), F.col("cell").alias("own"), *body)
    homes = blocks.select("cell", "first")
    meetings = visitors.join(homes, "cell").select("first", F.lit(1).alias("kind"), "own", *body)
    meetings = meetings.unionByName(blocks.select("first", F.lit(0).alias("kind"), F.col("cell").alias("own"), *body))
    meetings = meetings.repartition(deals, "first").sortWithinPartitions("first", "kind")
    met = meetings.mapInArrow(_meet, "word string, near long, minus long, form string")
    best = F.min(F.struct("minus", "form"))
    near = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    near = near.select(F.col("word").alias("w"), "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.form").alias("best_form"))
    holds = F.col("best_n") >= F.lit(ratio) * F.col("n")
    joined = known.join(near, F.col("word") == F.col("w"), "left").select(
        "word",
        F.when(holds, F.col("best_form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, F.col("best_n")).alias("form_n"),
    )
    joined = materialise(joined, "forms")
    # Counts grow along the forms, so following them ends. Each round doubles the steps that are taken at once.
    links = joined.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("to"))
        links = materialise(
            links.join(onward, F.col("root") == F.col("at"), "left").select(
                "word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")
            ),
            "roots",
        )
        if not links.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            break
        links = links.select("word", "root")
    roots = links.select(F.col("word").alias("w"), "root")
    return joined.join(roots, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# One step of eight by which a byte's entry in the table of crc32 is made.
_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"


def _oracle() -> str:
    return rf"""
    WITH RECURSIVE steps(k, i, c) AS (
        SELECT 0, r, r FROM (SELECT unnest(range(256)) AS r)
        UNION ALL SELECT k + 1, i, {_STEP} FROM steps WHERE k < 8
    ), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
    ), runs AS (
        SELECT id, run, count(*) AS n FROM (
            SELECT coalesce(doc_id::VARCHAR, '') AS id,
                   translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents) WHERE length(run) >= 7 GROUP BY ALL
    ), bytes AS (
        SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
               lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)) AS b
        FROM runs
    ), hashed AS (
        SELECT id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
        FROM bytes, crc
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
            FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), cuts AS (
        SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), pairs AS (
        SELECT a.word AS a, b.word AS b, b.n AS n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
        UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
    ), ranked AS (
        SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS nth FROM pairs
    ), formed AS (
        SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
               CASE WHEN r.n >= 10 * w.n THEN r.b END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
        FROM words w LEFT JOIN ranked r ON w.word = r.a AND r.nth = 1
    ), chain(word, node) AS (
        SELECT word, word FROM formed
        UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.node = f.word AND f.form IS NOT NULL
    ), ends AS (SELECT c.word, c.node AS root FROM chain c JOIN formed f ON c.node = f.word AND f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
    """


@query("op11_spelling_variants", _oracle())
def op11_spelling_variants(spark, sf_dir):
    return group_variants(word_counts(table(spark, sf_dir, "documents")).filter("n >= 2"))
