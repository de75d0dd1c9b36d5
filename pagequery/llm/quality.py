"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, cut, grams, mix, packed, prefix, remainder, runs, shuffle_parts, spans, with_fields, words

#: Fourier features, ridge penalty, folds of the calibration, and bins of its scores.
FEATURES, RIDGE, FOLDS, BINS = 192, 1e-3, 4, 1024
#: Partial sums of the normal equations that are sent on at once.
SUMS = 32

_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"%$&*#@^~<>{}\\=+_", b".,;:?'\"()-", b"\n", range(128, 256)]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _of in enumerate(_CLASSES):
    _CLASS[list(_of)] = _k
#: How many statistics a document has.
WIDTH = 2 + len(_CLASSES) + 9 + 4


def _shares(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Counts of each class of bytes between consecutive edges."""
    n = len(edges) - 1
    row = np.repeat(np.arange(n), np.diff(edges))
    width = len(_CLASSES) + 1
    return np.bincount(row * width + _CLASS[buf[edges[0] : edges[-1]]], minlength=n * width).reshape(n, width).astype(np.float64)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each document has, and how often its most frequent one occurs."""
    key, count = np.unique(mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_counts=True, return_index=True)[1:]
    top = np.zeros(n)
    np.maximum.at(top, doc[key], count)
    return np.bincount(doc[key], minlength=n).astype(np.float64), top


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """WIDTH statistics of each whole text: sizes, shares of kinds of bytes, repetition, and its worst line."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(np.float64)
    shares = _shares(buf, off)
    starts, ends, bounds = words(buf, off)
    count = np.diff(bounds)
    many = np.maximum(count, 1).astype(np.float64)
    doc = np.repeat(np.arange(n), count)
    hashes = spans(prefix(buf, FOLDED), starts, ends)
    length = (ends - starts).astype(np.float64)
    first = _CLASS[buf[starts]] if len(starts) else np.zeros(0, np.uint8)
    total = lambda x: np.bincount(doc, x, minlength=n)
    kinds, top = _distinct(doc, hashes, n)
    pairs, inside = grams(hashes, bounds, 3)
    triples, _ = _distinct(doc[: len(pairs)][inside], pairs[inside], n)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    columns = [np.log1p(np.diff(off)), np.log1p(count), *(shares[:, k] / size for k in range(len(_CLASSES)))]
    columns += [total(length) / many, total(length <= 3) / many, total(length >= 15) / many, total(first == 0) / many]
    columns += [kinds / many, top / many, triples / np.maximum(count - 2, 1), total(again) / many, shares[:, 7] / many]
    # lines
    cuts = np.unique(np.concatenate([off, np.flatnonzero(buf == 10) + 1])) if len(buf) else off[:1]
    worst = np.zeros((n, 4))
    if len(cuts) > 1:
        line = _shares(buf, cuts)
        of = np.searchsorted(off, cuts[:-1], "right") - 1
        long = np.maximum(np.diff(cuts), 20).astype(np.float64)
        for k, kind in enumerate((0, 3, 4, 5)):
            np.maximum.at(worst[:, k], of, line[:, kind] / long)
    return np.column_stack([*columns, *worst.T])


def _batched(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    parts = [statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in runs(off, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH))


@dataclass
class Model:
    """All of a fitted classifier; a few hundred numbers, whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier features, with a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.omega + self.phase
        return np.column_stack([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return np.interp(self.expand(x) @ self.weights, self.knots, self.values)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y under weights w: pool adjacent violators."""
    level: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        level.append([value, weight, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            total = a[1] + b[1]
            level.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in level]) if level else np.zeros(0)


def _solved(gram: np.ndarray, moment: np.ndarray, rows: float) -> np.ndarray:
    penalty = RIDGE * max(rows, 1) / len(gram) * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, moment)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, seed: int = 7) -> Model:
    """Fit on the rows of docs (doc_id, text) that are `learnable` and have a label (labels: doc_id, quality).

    All labelled rows count. Partitions sum the normal equations of their rows for each of FOLDS folds; the sums of the
    other folds score a fold for the calibration, and all sums together give the model. Labels of one doc_id are
    averaged; null labels and null doc_ids are left out; null text is empty. Without any label every score is 0.5.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _batched(*packed(batch.column(1))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    rows = docs.where(learnable & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = cut(rows.mapInArrow(measure, "doc_id long, x array<float>").join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    each = [F.struct(F.sum(v), F.sum(v * v)) for v in (F.col("x")[j].cast("double") for j in range(WIDTH))]
    sums = train.agg(F.count("*").alias("n"), F.array(*each).alias("s")).first()
    n = sums["n"]
    rng = np.random.default_rng(seed)
    omega, phase = rng.standard_normal((WIDTH, FEATURES)) / np.sqrt(WIDTH), rng.uniform(0, 2 * np.pi, FEATURES)
    nothing = Model(np.zeros(WIDTH), np.ones(WIDTH), omega, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    if not n:
        return nothing
    s = np.array([tuple(v) for v in sums["s"]])
    mean = s[:, 0] / n
    spread = np.sqrt(np.maximum(s[:, 1] / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-6, spread, 1), omega, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    d = FEATURES + 1

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        return model.expand(x), batch.column(1).to_numpy(), batch.column(2).to_numpy()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d + 1, d))
        for batch in batches:
            z, y, fold = arrays(batch)
            for f in range(FOLDS):
                m = fold == f
                total[f, :d] += z[m].T @ z[m]
                total[f, d] += y[m] @ z[m]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d + 1, d))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), np.float64).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    partial = train.mapInArrow(add, "part binary").repartition(min(SUMS, max(1, shuffle_parts(train.sparkSession) // 8))).mapInArrow(merge, "part binary")
    total = sum(np.frombuffer(bytes(r.part), np.float64).reshape(FOLDS, d + 1, d) for r in partial.collect())
    solve = lambda t: _solved(t[:d], t[d], n)
    others = [solve(total.sum(0) - total[f]) for f in range(FOLDS)]
    model.weights = solve(total.sum(0))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS))
        for batch in batches:
            z, y, fold = arrays(batch)
            raw = np.einsum("ij,ij->i", z, np.array(others)[fold])
            at = np.clip(((raw + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)
            seen[0] += np.bincount(at, minlength=BINS)
            seen[1] += np.bincount(at, y, minlength=BINS)
        k = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(seen[0, k]), pa.array(seen[1, k])], ["bin", "w", "y"])

    table = sorted(train.mapInArrow(bins, "bin int, w double, y double").groupBy("bin").agg(F.sum("w"), F.sum("y")).collect())
    at, w, y = (np.array(v, float) for v in zip(*table, strict=True))
    model.knots, model.values = (at + 0.5) / (BINS / 2) - 0.5, np.clip(isotonic(y / w, w), 0, 1)
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from a score of 0.5 on), replacing columns of those names.

    Scores come from the whole text alone; null counts as empty, and equal texts score alike.
    """
    new = ("score", "predicted")
    kept = [f.name for f in docs.schema.fields if f.name.lower() not in new]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _batched(*packed(batch.column(len(kept)))).astype(np.float32)
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*kept, *new])

    plain = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("__text"))
    return plain.mapInArrow(of, with_fields(docs.schema, ("score", "double"), ("predicted", "int")))


def held_out() -> Column:
    """The rows that the classifier does not learn from."""
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
