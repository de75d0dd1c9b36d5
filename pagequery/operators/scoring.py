"""Scores of a stated set of queries against documents, inside the tasks that hold the documents.

Queries are sent to all tasks as postings (term to queries and weights) and vectors; a task scores its documents in blocks and keeps
what is asked for: the k best of each query, their sums, or every match. No row for a pair of query and document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Scores in a block.
CELLS = 1 << 19


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """x rounded half away from zero; what is not a number is above all others, as in SQL."""
    y = x * 10.0**places
    whole = np.where(np.abs(y) < 2**52, np.trunc(y + np.copysign(0.5, y)), y)
    return np.where(np.isnan(x), np.inf, whole / 10.0**places) + 0.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, cut or filled up with zeros to dim; missing ones and missing elements are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.nan_to_num(np.asarray(column.flatten().cast(pa.float64()).fill_null(0.0)), nan=np.nan, posinf=np.inf, neginf=-np.inf)
    if len(column) and (sizes == dim).all():
        return flat.reshape(len(column), dim)
    ends = np.cumsum(sizes)
    at = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    row, inside = np.repeat(np.arange(len(column)), sizes), at < dim
    out[row[inside], at[inside]] = flat[inside]
    return out


class Queries:
    """The sent form of queries: ids, postings of their terms, and vectors where they have one."""

    def __init__(self, ids: pa.Array, terms: list[dict[int, float]] | None = None, n_terms: int = 0, vectors: pa.Array | None = None, alpha: float = 0.0):
        self.ids, self.n, self.alpha = ids, len(ids), alpha
        self.starts = None
        if terms is not None:
            got = sorted((c, q, w) for q, t in enumerate(terms) for c, w in t.items())
            self.query, self.weight = np.array([g[1] for g in got], np.int64), np.array([g[2] for g in got])
            self.starts = np.searchsorted(np.array([g[0] for g in got], np.int64), np.arange(n_terms + 1))
        self.vectors = self.has = None
        if vectors is not None:
            self.has = np.asarray(vectors.is_valid())
            sizes = np.asarray(vectors.value_lengths().fill_null(0))
            self.vectors = np.ascontiguousarray(matrix(vectors, int(sizes.max(initial=0))).T)

    def text(self, cols: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Documents by queries: sums of products of weights, of documents with `sizes` terms each, one after the other."""
        many = self.starts[cols + 1] - self.starts[cols]
        total = int(many.sum())
        at = np.arange(total) + np.repeat(self.starts[cols] - np.cumsum(many) + many, many)
        cell = np.repeat(np.repeat(np.arange(len(sizes)), sizes), many) * self.n + self.query[at]
        return np.bincount(cell, self.weight[at] * np.repeat(w, many), minlength=len(sizes) * self.n).reshape(len(sizes), self.n)

    def scores(self, batch: pa.RecordBatch, at: int, n: int) -> np.ndarray:
        """Scores of n rows of a batch: text by (cols, ws, norm), dense by (vec), or both blended."""
        rows, text = batch.slice(at, n), None
        if self.starts is not None:
            cols, ws = rows.column("cols"), rows.column("ws")
            text = self.text(np.asarray(cols.flatten(), np.int64), np.asarray(ws.flatten(), float), np.asarray(cols.value_lengths(), np.int64))
            norm = np.asarray(rows.column("norm"))
            text = text / np.where(norm > 0, norm, 1.0)[:, None]
        if self.vectors is None:
            return text
        with np.errstate(all="ignore"):
            dense = matrix(rows.column("vec"), len(self.vectors)) @ self.vectors
            return dense if text is None else np.where(self.has, self.alpha * dense + (1 - self.alpha) * text, text)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        """(batch, first row, scores) in blocks; the first are small, so that later ones meet a limit."""
        most, step = max(1, CELLS // max(self.n, 1)), 16
        for batch in batches:
            at = 0
            while at < batch.num_rows and self.n:
                n = min(step, most, batch.num_rows - at)
                yield batch, at, self.scores(batch, at, n)
                at, step = at + n, step * 2


class Best:
    """The k best of each query, by rounded score and then position."""

    def __init__(self, n: int, k: int, places: int):
        self.k, self.places = k, places
        self.r, self.pos = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.score, self.key, self.some = np.zeros((n, k)), np.empty((n, k), object), np.zeros((n, k), bool)

    def add(self, scores: np.ndarray, pos: np.ndarray, keys: pa.Array) -> None:
        last, at = self.r[:, -1], self.pos[:, -1]
        row, q = np.nonzero(~(scores < last - 2 * 10.0**-self.places))
        s = scores[row, q]
        r = rounded(s, self.places)
        better = (r > last[q]) | (r == last[q]) & (pos[row] < at[q]) | ~self.some[q, -1]
        row, q, s, r = row[better], q[better], s[better], r[better]
        if not len(row):
            return
        met = np.unique(q)
        held, k = self.some[met], self.k
        old = np.repeat(met, k).reshape(-1, k)[held]
        # a query's own best go first, so that rows with equal order stay as they came
        q2, r2, s2 = np.concatenate([old, q]), np.concatenate([self.r[met][held], r]), np.concatenate([self.score[met][held], s])
        p2 = np.concatenate([self.pos[met][held], pos[row]])
        order = np.lexsort((p2, -r2, q2))
        of = q2[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        order, of, rank = order[rank < k], of[rank < k], rank[rank < k]
        source = order - len(old)
        names = keys.take(pa.array(row[source[source >= 0]])).to_pylist()
        kept = np.empty(len(order), object)
        kept[source >= 0] = names
        kept[source < 0] = self.key[met][held][order[source < 0]]
        self.some[met] = False
        self.some[of, rank], self.r[of, rank], self.pos[of, rank], self.score[of, rank], self.key[of, rank] = True, r2[order], p2[order], s2[order], kept

    def rows(self, ids: pa.Array, key: pa.DataType) -> pa.RecordBatch:
        q, i = np.nonzero(self.some)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(list(self.key[q, i]), key), pa.array(self.pos[q, i]), pa.array(self.score[q, i]), pa.array(self.r[q, i])], ["query_id", "doc_key", "pos", "score", "r"])


def best(sent, k: int, places: int):
    """mapInArrow: the k best (query_id, doc_key, pos, score, r) of each query among a task's rows (doc_key, pos, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, key = sent.value, None
        top = Best(queries.n, k, places)
        for batch, at, scores in queries.blocks(batches):
            rows = batch.slice(at, len(scores))
            key = rows.column("doc_key").type
            top.add(scores, np.asarray(rows.column("pos"), np.int64), rows.column("doc_key"))
        if key is not None:
            yield top.rows(queries.ids, key)

    return run


def sums(sent):
    """mapInArrow: (query_id, s, ss, m), the sum, the sum of squares and the largest of each query's scores among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        s, ss, m, met = np.zeros(queries.n), np.zeros(queries.n), np.zeros(queries.n), False
        for _, _, scores in queries.blocks(batches):
            met = True
            s, ss, m = s + scores.sum(0), ss + (scores * scores).sum(0), np.maximum(m, scores.max(0))
        if met:
            yield pa.RecordBatch.from_arrays([queries.ids, pa.array(s), pa.array(ss), pa.array(m)], ["query_id", "s", "ss", "m"])

    return run


def matches(sent):
    """mapInArrow: (query_id, doc_key, score) of every pair with a score above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for batch, at, scores in queries.blocks(batches):
            row, q = np.nonzero(scores > 0)
            yield pa.RecordBatch.from_arrays([queries.ids.take(pa.array(q)), batch.column("doc_key").take(pa.array(row + at)), pa.array(scores[row, q])], ["query_id", "doc_key", "score"])

    return run
