"""Quality classifier by co-training of two views.

One classifier sees the text, the other what is known about the document (source, language, length). In each
round either labels the unlabelled documents it is most sure of, for the other to learn from: all unlabelled
documents take part, their sums are taken by tasks. The two are then calibrated on labelled documents that
neither has seen, and their evidence is added up to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.base import chunks, query, table, utf8
from framewright.sources.shared import materialise

LABELLED = 10_000  # documents of each label fitted on at most: those with the smallest hashes of their ids
ROUNDS, SURE, PER_ROUND = 4, 0.98, 0.05  # least confidence of a pseudo-label, and the part of the pool given per round
CALIBRATED = 5  # every fifth labelled document is for calibration
REJECT_BELOW = 0.5
HASHED = 64  # slots for sources and for languages
ADDERS = 16  # tasks that add up the sums of all others
CELLS = 4096  # confidences and hashes of ids are counted in so many cells to find the most confident

_UPPER, _LOWER, _DIGIT, _SIGN, _BLANK = range(5)
_KIND = np.full(256, _LOWER, np.uint8)  # bytes of letters beyond ASCII count as lower case
_KIND[list(range(0x21, 0x7F))] = _SIGN
_KIND[[*range(0x00, 0x21), 0x7F]] = _BLANK
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = _LOWER
_KIND[list(b"0123456789")] = _DIGIT
TEXT_FEATURES = 16


def text_features(x: bytes) -> list[float]:
    """Numbers about the whole text; all 0 but the first for an empty one."""
    words = x.split()
    if not words:
        return [1.0] + [0.0] * (TEXT_FEATURES - 1)
    data = np.frombuffer(x, np.uint8)
    share = np.bincount(_KIND[data], minlength=5) / len(x)
    lines = x.split(b"\n")
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lone = sum(len(w) == 1 for w in words)
    return [
        0.0,
        np.log1p(len(words)) / 5,
        np.log(len(x) / len(words)),
        share[_UPPER] * 5,
        share[_DIGIT] * 10,
        share[_SIGN] * 5,
        float(share[_UPPER] > 0.5),
        len(seen) / len(words),
        len(seen) / len(words) ** 0.7 / 3,
        max(seen.values()) / len(words),
        repeats / len(words),
        lone / len(words) * 5,
        len(set(lines)) / len(lines),
        np.log1p(len(x) / len(lines)) / 5,
        x.count(b"|") / len(words),
        (x.count(b"!") + x.count(b"#") + x.count(b"*") + x.count(b"%") + x.count(b"$") + x.count(b"&")) / len(words),
    ]


META_FEATURES = 3 + 2 * HASHED


def slot(value: str | None) -> int:
    """Place of a source or language among HASHED; null is a place too."""
    return zlib.crc32(value.encode()) % HASHED if value is not None else 0


def meta_features(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One column for each slot of the source and of the language, and the length of the text."""
    out = np.zeros((len(size), META_FEATURES))
    length, row = np.log1p(size) / 8, np.arange(len(size))
    out[:, 0], out[:, 1], out[:, 2] = size == 0, length, length**2
    out[row, 3 + source] = 1.0
    out[row, 3 + HASHED + lang] = 1.0
    return out


Sums = tuple[float, np.ndarray, np.ndarray]  # loss, slope and curvature


def sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> Sums:
    """What rows add to the loss of a logistic regression, to its slope and to its curvature at `w`."""
    x = np.c_[np.ones(len(x)), x]
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    return loss, x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


def fit(starts: list[np.ndarray], at: Callable[[list[np.ndarray]], list[Sums]], ridge: float = 1.0) -> list[np.ndarray]:
    """Logistic regressions by Newton steps, halved while the loss grows; the first coefficient is the constant.

    `at` gives the sums of all of them, so that one pass over the rows serves all. Rounded, so that the order in which
    rows were added up does not show.
    """
    penalties = [np.r_[1e-6, np.full(len(w) - 1, ridge)] for w in starts]
    best, trial = list(starts), list(starts)
    steps, least, done = [np.zeros(len(w)) for w in starts], [np.inf] * len(starts), [False] * len(starts)
    for _ in range(60):
        for i, (loss, slope, curve) in enumerate(at(trial)):
            if done[i]:
                continue
            loss += float((penalties[i] * trial[i] ** 2).sum()) / 2
            if loss > least[i] + 1e-9 * abs(least[i]):
                steps[i] = steps[i] / 2
            else:
                best[i], least[i] = trial[i], loss
                steps[i] = np.linalg.solve(curve + np.diag(penalties[i]), slope + penalties[i] * trial[i])
            trial[i] = best[i] - steps[i]
            if np.abs(steps[i]).max() < 1e-8:
                done[i], best[i] = True, trial[i]
        if all(done):
            break
    return [np.round(w, 9) for w in best]


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row: a matrix product's last digits would hang on what else is in the batch."""
    return np.clip(w[0] + (x * w[1:]).sum(1), -30, 30)


@dataclass(frozen=True)
class Views:
    """Coefficients of the two views and how their logits are combined: constant and weight of either."""

    text: np.ndarray | None
    meta: np.ndarray | None
    combine: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = np.full(len(text), self.combine[0])
        if self.text is not None:
            z = z + self.combine[1] * logit(self.text, text) + self.combine[2] * logit(self.meta, meta)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Rows:
    """Unlabelled documents: the features of the two views, and the cell of the hash of each id."""

    views: tuple[np.ndarray, np.ndarray]
    tie: np.ndarray


@dataclass(frozen=True)
class Round:
    """Models of the two views, and the cut for either label: the cell of confidence and, in it, that of the hash."""

    models: list[np.ndarray]
    cuts: dict[tuple[int, int], tuple[int, int]]


Total = Callable[[Callable[[Rows], np.ndarray]], np.ndarray]
_LEAST_SURE = np.log(SURE / (1 - SURE))


def confidence(model: np.ndarray, x: np.ndarray, label: int) -> np.ndarray:
    """Cell of the confidence in a label, the last for the surest; -1 below SURE."""
    z = logit(model, x) * (1 if label else -1)
    cell = np.minimum((z - _LEAST_SURE) / (30 - _LEAST_SURE) * CELLS, CELLS - 1)
    return np.where(z >= _LEAST_SURE, cell, -1).astype(np.int64)


def given(rows: Rows, rounds: list[Round]) -> list[np.ndarray]:
    """Pseudo-labels that either view has been given in the rounds so far, -1 for none. A first one stays."""
    out = [np.full(len(rows.tie), -1), np.full(len(rows.tie), -1)]
    for r in rounds:
        for (me, label), (cell, tie) in r.cuts.items():
            sure = confidence(r.models[me], rows.views[me], label)
            taken = (sure > cell) | ((sure == cell) & (rows.tie < tie))
            out[1 - me][taken & (out[1 - me] < 0)] = label
    return out


def _cut(counts: np.ndarray, most: int) -> tuple[int, int]:
    """The first cell that can not be taken in full, counted from the end, and what is left for it; -1 if all can."""
    upto = np.cumsum(counts[::-1])
    if not len(upto) or upto[-1] <= most:
        return -1, 0
    nth = int(np.searchsorted(upto, most, "right"))
    return len(counts) - 1 - nth, most - int(upto[nth - 1] if nth else 0)


def choose(total: Total, models: list[np.ndarray], rounds: list[Round], most: tuple[int, int]) -> Round:
    """The round in which either view gives at most `most` pseudo-labels of either class: its surest ones.

    Counted over all rows by cells of confidence, then the cell at the border by hashes of ids.
    """
    kinds = [(me, label) for me in (0, 1) for label in (1, 0)]

    def by_confidence(rows: Rows) -> np.ndarray:
        known, out = given(rows, rounds), []
        for me, label in kinds:
            sure = confidence(models[me], rows.views[me], label)
            out.append(np.bincount(sure[(sure >= 0) & (known[1 - me] < 0)], minlength=CELLS))
        return np.concatenate(out).astype(float)

    counts = total(by_confidence).reshape(4, CELLS).astype(np.int64)
    border = {kind: _cut(c, most[kind[1]]) for kind, c in zip(kinds, counts, strict=True)}

    def by_hash(rows: Rows) -> np.ndarray:
        known, out = given(rows, rounds), []
        for me, label in kinds:
            sure = confidence(models[me], rows.views[me], label)
            at = (sure == border[me, label][0]) & (sure >= 0) & (known[1 - me] < 0)
            out.append(np.bincount(rows.tie[at], minlength=CELLS))
        return np.concatenate(out).astype(float)

    counts = total(by_hash).reshape(4, CELLS).astype(np.int64)
    cuts = {}
    for kind, c in zip(kinds, counts, strict=True):
        cell, rest = border[kind]
        # a cell of confidence below 0 stands for rows that are not sure: none of them
        cuts[kind] = (cell, int(np.searchsorted(np.cumsum(c), rest, "right"))) if cell >= 0 else (-1, 0)
    return Round(models, cuts)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, unlabelled: int, total: Total) -> Views:
    """Fit on rows with a label (y 0 or 1), pseudo-label the `unlabelled` others, calibrate on those of `fold` 0.

    `weight` is how many labelled documents a row stands for; `total` adds up what a function makes of all unlabelled
    documents. Where one class has no document at all there is nothing to tell apart, and every document is good.
    """
    good = (weight * y).sum() / weight.sum() if len(y) else 1.0
    if min((y == 0).sum(), (y == 1).sum()) == 0:
        return Views(None, None, np.array([np.log(1e6), 0.0, 0.0]))
    held = fold == 0
    train_too = min((y[held] == 0).sum(), (y[held] == 1).sum(), (y[~held] == 0).sum(), (y[~held] == 1).sum()) == 0
    if train_too:  # a class without a document to calibrate on, or to fit on
        held = np.ones(len(y), bool)
    train = ~held if not held.all() else held
    views, rounds = [text, meta], []
    # both classes in the proportion of the labels
    most = tuple(int(np.ceil(PER_ROUND * unlabelled * share)) for share in (1 - good, good))
    width = [x.shape[1] + 1 for x in views]

    def at(w: list[np.ndarray]) -> list[Sums]:
        """Sums over the labelled rows here and the pseudo-labelled ones in tasks."""
        own = [sums(x[train], y[train], weight[train], c) for x, c in zip(views, w, strict=True)]
        if not rounds or not unlabelled:
            return own

        def pseudo(rows: Rows) -> np.ndarray:
            parts = []
            for x, label, c in zip(rows.views, given(rows, rounds), w, strict=True):
                some = label >= 0
                loss, slope, curve = sums(x[some], label[some], np.full(some.sum(), 0.5), c)
                parts += [[loss], slope, curve.ravel()]
            return np.concatenate(parts)

        more, out, start = total(pseudo), [], 0
        for n, (loss, slope, curve) in zip(width, own, strict=True):
            piece = more[start : start + 1 + n + n * n]
            out.append((loss + piece[0], slope + piece[1 : 1 + n], curve + piece[1 + n :].reshape(n, n)))
            start += 1 + n + n * n
        return out

    models = fit([np.zeros(n) for n in width], at)
    for _ in range(ROUNDS if unlabelled else 0):
        rounds.append(choose(total, models, rounds, most))
        models = fit(models, at)
    both = np.c_[logit(models[0], text), logit(models[1], meta)][held]
    (combine,) = fit([np.zeros(3)], lambda w: [sums(both, y[held], weight[held], w[0])], 0.1)
    return Views(models[0], models[1], combine)


def _smallest_hashes(df: DataFrame, n: int, most: int) -> DataFrame:
    """The `most` of n rows whose ids have the smallest hashes; a cut by hash first leaves little to sort."""
    span = 1 << 40
    cut = span * most * 1.1 / max(n, 1) + 1
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(span))
    return df.filter(place < cut).orderBy(place, "id").limit(most)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    label: str = "quality",
) -> DataFrame:
    """`docs` with `quality_score` (0 to 1) and `good` (score at least REJECT_BELOW).

    `labels` has the id and a label 0 or 1; null labels are left out, of repeated ones the smallest counts. Of the
    documents with a label at most LABELLED of either are fitted on, each weighted for those it stands for; they come
    to the driver as numbers, never as texts. All without a label are pseudo-labelled in tasks, whose sums come to the
    driver, and every document is scored. The numbers are written once to the shared folder. Null and empty texts are scored
    like any other, very long ones whole; rows without an id are not fitted on. Input columns of the two new names are
    replaced, others stay as they are. Without documents there are no rows, without labels every document is good.
    """
    marked = labels.filter(f"{label} in (0, 1) and {doc_id} is not null").groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y"))
    names = {text: "text", source: "source", lang: "lang"}

    def numbers(texts: list[bytes], sources: pa.Array, langs: pa.Array) -> tuple[np.ndarray, ...]:
        """Features of the text, slots of source and language, and bytes of each row."""
        features = np.array([text_features(x) for x in texts], np.float32).reshape(-1, TEXT_FEATURES)
        slots = [np.array([slot(x) for x in c.to_pylist()], np.int64) for c in (sources, langs)]
        return features, *slots, np.array([len(x) for x in texts], np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, *facts = numbers(utf8(batch.column("text")), batch.column("source"), batch.column("lang"))
            cells = [batch.column("id"), pa.array([x.tobytes() for x in features], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cells, *map(pa.array, facts)], ["id", "text", "source", "lang", "size"])

    def arrays(text: list[bytes], *facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(text), np.float32).reshape(-1, TEXT_FEATURES).astype(float), meta_features(*facts)

    # Only ids and numbers are shuffled, one row of each id, however often the id is repeated.
    rows = materialise(
        docs.select(F.col(doc_id).cast("long").alias("id"), *[F.col(c).cast("string").alias(n) for c, n in names.items()])
        .filter("id is not null")
        .mapInArrow(packed, "id long, text binary, source long, lang long, size long")
        .groupBy("id")
        .agg(F.min(F.struct("size", "text", "source", "lang")).alias("row"))
        .select("id", "row.*")
        .join(marked, "id", "left")
        .withColumn("tie", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(CELLS)))
        .sortWithinPartitions("id"),
        "quality",
    )
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    pool = rows.filter("y is null").select("text", "source", "lang", "size", "tie")

    def total(measure: Callable[[Rows], np.ndarray]) -> np.ndarray:
        """Sums of each task, packed as most of them are 0; added up by `ADDERS` tasks and then here, in the order of the tasks."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                facts = [batch.column(c).to_numpy() for c in ("source", "lang", "size")]
                made = measure(Rows(arrays(batch.column("text").to_pylist(), *facts), batch.column("tie").to_numpy()))
                out = made if out is None else out + made
            if out is not None:
                yield sums_row(TaskContext.get().partitionId(), out)

        def sums_row(task: int, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], ["task", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, out = None, None
            for batch in batches:
                for task, row in zip(batch.column("task").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                    made = np.frombuffer(zlib.decompress(row))
                    first, out = (task, made) if out is None else (first, out + made)
            if out is not None:
                yield sums_row(first, out)

        parts = pool.mapInArrow(part, "task long, sums binary")
        added = parts.repartition(ADDERS, "task").sortWithinPartitions("task").mapInArrow(add, "task long, sums binary")
        return sum(np.frombuffer(zlib.decompress(r.sums)) for r in sorted(added.collect()))

    known = pd.concat(
        [_smallest_hashes(rows.filter(F.col("y") == y), counts.get(y, 0), LABELLED).toPandas() for y in (0, 1)], ignore_index=True
    ).sort_values("id")
    y = known.y.to_numpy(np.int64)
    model = cotrain(
        *arrays(list(map(bytes, known.text)), *(known[c].to_numpy(np.int64) for c in ("source", "lang", "size"))),
        y,
        np.array([counts[k] / (y == k).sum() for k in y], float),
        np.array([zlib.crc32(str(i).encode()) % CALIBRATED for i in known.id], int),
        counts.get(None, 0),
        total,
    )
    kept = [c for c in docs.columns if c.lower() not in ("quality_score", "good")]
    at = {c: kept.index(c) for c in (text, source, lang)}
    schema = T.StructType(
        [*[docs.schema[c] for c in kept], T.StructField("quality_score", T.DoubleType()), T.StructField("good", T.BooleanType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            columns = [batch.column(at[c]).cast(pa.string()) for c in (source, lang)]
            features, *facts = numbers(utf8(batch.column(at[text])), *columns)
            p = model.score(features.astype(float), meta_features(*facts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array(p >= REJECT_BELOW)], [*kept, "quality_score", "good"]
            )

    return docs.select(*kept).mapInArrow(score, schema)


@query("op7_quality")
def op7_quality(spark, sf_dir):
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("good").alias("kept"))
