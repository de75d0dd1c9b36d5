"""Masked pseudo-likelihood: a bidirectional window network predicts every word from its neighbours on both sides.

Words are counted over all documents; the most frequent become the vocabulary, others are seen by the network as one of a few shapes. The network
adds an embedding of each neighbour, by its place, passes tanh, and gives a word's probability as that of its class
times that within its class, classes being ranges of frequency. That of a word outside the vocabulary is its shape's times the word's
share of all such words of the shape, by exact counts of every word: those of the COMMON most frequent ones go to every task, all others are
joined. It starts from the counts, so that training only has to add
what neighbours tell. Training runs over all words of all documents: every partition makes Adagrad steps from common
weights, the weights are averaged by words seen, and so on for ROUNDS rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, cut, mix, packed, prefix, runs, shuffle_parts, spans, words

#: Classes, words of a class, width of the network, neighbours on each side.
CLASSES, MEMBERS, WIDTH, SIDE = 16, 32, 8, 2
VOCABULARY = CLASSES * MEMBERS
#: Ids that are no words: the edge of a text, and shapes of words outside the vocabulary.
EDGE, SHAPES = 0, 32
ROUNDS, STEP, MINIBATCH = 2, 0.15, 16384
#: Words outside the vocabulary whose counts are sent to every task; the others' are joined.
COMMON = 1 << 16
_PLACES = [d for d in range(-SIDE, SIDE + 1) if d]


@dataclass
class Network:
    """A vocabulary and the weights, of fixed size whatever the corpus; and the counts of all other words, which grow with it and stay in a table."""

    hashes: np.ndarray  # of the vocabulary's words, sorted
    ids: np.ndarray
    embed: np.ndarray  # places x VOCABULARY x WIDTH
    outer: np.ndarray  # (WIDTH + 1) x CLASSES
    inner: np.ndarray  # CLASSES x (WIDTH + 1) x MEMBERS
    unlisted: np.ndarray  # 1 + SHAPES: words outside the vocabulary, by shape
    common: np.ndarray  # keys of the COMMON most frequent of them, sorted
    logs: np.ndarray  # logarithms of their counts
    rare: DataFrame | None  # (h, shape, n) of the others that occur more than once

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.outer, self.inner]


def hashed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (A-Z only), their shapes, and the bounds of each row."""
    starts, ends, bounds = words(buf, off)
    h = spans(prefix(buf, FOLDED), starts, ends)
    if not len(h):
        return h, np.zeros(0, np.int64), bounds
    length = np.minimum((ends - starts + 1) // 2, 8)
    last = buf[ends - 1]
    lettered = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    capital = (buf[starts] >= 65) & (buf[starts] <= 90)
    return h, 1 + (length - 1) * 4 + lettered * 2 + capital, bounds


def _distinct(h: np.ndarray, shape: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different (row, h, shape), and how often it occurs."""
    order = np.lexsort((shape, h) if row is None else (shape, h, row))
    new = np.zeros(max(len(h) - 1, 0), bool)
    for v in (h, shape) if row is None else (h, shape, row):
        new |= v[order[1:]] != v[order[:-1]]
    first = np.flatnonzero(np.append(True, new)) if len(h) else np.zeros(0, np.int64)
    return order[first], np.diff(np.append(first, len(h)))


def _keys(h: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return mix(h + shape.astype(np.uint64))


def counts(docs: DataFrame) -> DataFrame:
    """(h, shape, n): how often each word occurs in all texts, in each of its shapes; and each shape, in rows whose h is null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = packed(batch.column(0))
            for i, j in runs(off, 4 << 20):
                h, shape, _ = hashed(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                first, n = _distinct(h, shape)
                k, total = h[first], np.bincount(shape, minlength=1 + SHAPES)
                rows = pa.array(np.append(k.view(np.int64), np.zeros(len(total), np.int64)), mask=np.arange(len(k) + len(total)) >= len(k))
                kinds = np.append(shape[first], np.arange(len(total))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows, pa.array(kinds), pa.array(np.append(n, total))], ["h", "shape", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(of, "h long, shape int, n long").groupBy("h", "shape").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, seed: int) -> Network:
    """The network before training: the most frequent words (ties by hash), and weights that give their frequencies."""
    every = cut(counts(docs))
    shapes = every.where("h IS NULL").collect()
    top = every.where("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(VOCABULARY - 1 - SHAPES).collect()
    listed = F.col("h").isin([r.h for r in top])
    unlisted = np.zeros(1 + SHAPES, np.int64)
    for r in shapes:
        unlisted[r["shape"]] += r.n
    for r in every.where(listed).collect():
        unlisted[r["shape"]] -= r.n
    frequency = np.full(VOCABULARY, 0.5)
    frequency[: 1 + SHAPES] = np.maximum(unlisted, 0.5)
    hashes = np.array([r.h for r in top], np.int64).view(np.uint64)
    ids = np.arange(1 + SHAPES, 1 + SHAPES + len(top))
    frequency[ids] += [r.n for r in top]
    others = every.where("h IS NOT NULL AND n > 1").where(~listed) if top else every.where("false")
    common = others.orderBy(F.desc("n"), "h", "shape").limit(COMMON).toArrow()
    key = _keys(common["h"].to_numpy().view(np.uint64), common["shape"].to_numpy())
    by_key = np.argsort(key)
    if len(common) == COMMON:  # what follows the last of them in that order
        n, h, shape = (common[c][COMMON - 1].as_py() for c in ("n", "h", "shape"))
        rare = others.where((F.col("n") < n) | (F.col("n") == n) & ((F.col("h") > h) | (F.col("h") == h) & (F.col("shape") > shape)))
    else:
        rare = None
    order = np.argsort(hashes)
    # ids in order of frequency make the classes
    rank = np.empty(VOCABULARY, np.int64)
    rank[np.argsort(-frequency, kind="stable")] = np.arange(VOCABULARY)
    shape_ids = rank[: 1 + SHAPES]
    by_rank = np.empty(VOCABULARY)
    by_rank[rank] = frequency
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (2 * SIDE, VOCABULARY, WIDTH)).astype(np.float32)
    outer = rng.normal(0, 0.1, (WIDTH + 1, CLASSES)).astype(np.float32)
    inner = rng.normal(0, 0.1, (CLASSES, WIDTH + 1, MEMBERS)).astype(np.float32)
    groups = by_rank.reshape(CLASSES, MEMBERS)
    outer[-1] = np.log(groups.sum(1) / groups.sum())
    inner[:, -1] = np.log(groups / groups.sum(1, keepdims=True))
    # the sorted hashes, and in front of their ids those of the edge and the shapes
    return Network(hashes[order], np.concatenate([shape_ids, rank[ids][order]]), embed, outer, inner, unlisted, key[by_key], np.log(common["n"].to_numpy()[by_key]), rare)


def tokens(net: Network, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and the bounds of each row."""
    h, shape, bounds = hashed(buf, off)
    ids = net.ids[shape].astype(np.int16)
    if len(net.hashes):
        at = np.minimum(np.searchsorted(net.hashes, h), len(net.hashes) - 1)
        known = net.hashes[at] == h
        ids[known] = net.ids[1 + SHAPES + at[known]]
    return ids, bounds


def neighbours(net: Network, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The ids at each place beside every word; beyond its text, the edge."""
    out = np.full((len(_PLACES), len(ids)), net.ids[EDGE], np.int16)
    n = np.diff(bounds)
    room = np.arange(len(ids)) - np.repeat(bounds[:-1], n)  # words before
    left = np.repeat(n, n) - room - 1  # words after
    for k, d in enumerate(_PLACES):
        if abs(d) < len(ids):
            to, of = (out[k, -d:], ids[:d]) if d < 0 else (out[k, :-d], ids[d:])
            inside = (room[-d:] >= -d) if d < 0 else (left[:-d] >= d)
            to[inside] = of[inside]
    return out


def _hidden(net: Network, beside: np.ndarray) -> np.ndarray:
    h = net.embed[0].take(beside[0], axis=0)
    for k in range(1, len(beside)):
        h += net.embed[k].take(beside[k], axis=0)
    out = np.empty((len(h), WIDTH + 1), np.float32)
    np.tanh(h, out=out[:, :WIDTH])
    out[:, WIDTH] = 1
    return out


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the words by class, their classes and members in it, and where each class begins."""
    order = np.argsort((ids // MEMBERS).astype(np.uint8), kind="stable")
    group, member = np.divmod(ids[order], MEMBERS)
    return order, group, member, np.searchsorted(group, np.arange(CLASSES + 1))


def log_probabilities(net: Network, ids: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """log P(word | its neighbours) of each word; no word sees itself. Hidden values are below 1, so no logit overflows."""
    out = np.empty(len(ids), np.float64)
    one, each = np.ones(CLASSES, np.float32), np.ones(MEMBERS, np.float32)
    for i in range(0, len(ids), MINIBATCH):
        order, group, member, edges = _by_class(ids[i : i + MINIBATCH])
        h = _hidden(net, beside[:, i : i + MINIBATCH][:, order])
        rows = np.arange(len(h))
        z = h @ net.outer
        p = z[rows, group]
        total = np.exp(z, out=z) @ one
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                z = h[a:b] @ net.inner[c]
                p[a:b] += z[rows[: b - a], member[a:b]]
                total[a:b] *= np.exp(z, out=z) @ each
        out[i + order] = p - np.log(total)
    return out


def _train(net: Network, state: list[np.ndarray], ids: np.ndarray, beside: np.ndarray) -> None:
    """Adagrad steps over the words, MINIBATCH at a time."""
    one, each = np.ones(CLASSES, np.float32), np.ones(MEMBERS, np.float32)
    for i in range(0, len(ids), MINIBATCH):
        order, group, member, edges = _by_class(ids[i : i + MINIBATCH])
        near = beside[:, i : i + MINIBATCH][:, order]
        h = _hidden(net, near)
        n = len(order)
        rows = np.arange(n)
        d = h @ net.outer
        np.exp(d, out=d)
        d /= (d @ one)[:, None]
        d[rows, group] -= 1
        g_outer = h.T @ d
        g_h = d @ net.outer.T
        g_inner = np.zeros_like(net.inner)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                d = h[a:b] @ net.inner[c]
                np.exp(d, out=d)
                d /= (d @ each)[:, None]
                d[rows[: b - a], member[a:b]] -= 1
                g_inner[c] = h[a:b].T @ d
                g_h[a:b] += d @ net.inner[c].T
        g = g_h[:, :WIDTH] * (1 - h[:, :WIDTH] ** 2)
        g_embed = np.zeros_like(net.embed)
        for k in range(len(near)):
            at = np.argsort(near[k], kind="stable")
            ranked = near[k][at]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            g_embed[k][ranked[first]] = np.add.reduceat(g.take(at, axis=0), first, axis=0)
        for w, a, grad in zip(net.weights(), state, (g_embed, g_outer, g_inner), strict=True):
            grad /= n
            a += grad**2
            w -= STEP * grad / (np.sqrt(a) + 1e-6)


def fit(docs: DataFrame, seed: int = 5, rounds: int = ROUNDS) -> Network:
    """Train on the text column of docs, all rows and all words; null text has none."""
    net = vocabulary(docs, seed)
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    sizes = [w.size for w in net.weights()]

    def pack(total: list[np.ndarray], seen: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate([w.ravel() for w in total]).astype(np.float64).tobytes()], pa.binary()), pa.array([float(seen)])], ["part", "seen"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(sum(sizes)), 0.0
        for batch in batches:
            for part, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(part.as_buffer(), np.float64)
                seen += n
        yield pack([total], seen)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(net)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = replace(sent.value, embed=sent.value.embed.copy(), outer=sent.value.outer.copy(), inner=sent.value.inner.copy())
            state = [np.full_like(w, 1e-4) for w in own.weights()]
            seen = 0
            for batch in batches:
                buf, off = packed(batch.column(0))
                for i, j in runs(off, 1 << 20):
                    ids, bounds = tokens(own, buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    _train(own, state, ids, neighbours(own, ids, bounds))
                    seen += len(ids)
            if seen:
                yield pack([w * np.float64(seen) for w in own.weights()], seen)

        schema = "part binary, seen double"
        merged = text.mapInArrow(train, schema).repartition(max(1, min(16, shuffle_parts(spark) // 8))).mapInArrow(merge, schema).collect()
        seen = sum(r.seen for r in merged)
        if not seen:
            break
        mean = sum(np.frombuffer(bytes(r.part), np.float64) for r in merged) / seen
        cuts = np.cumsum(sizes)[:-1]
        embed, outer, inner = (v.astype(np.float32).reshape(w.shape) for v, w in zip(np.split(mean, cuts), net.weights(), strict=True))
        net = replace(net, embed=embed, outer=outer, inner=inner)
    return net


def unlisted_words(net: Network, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sum by row of log P(word | its shape) of the words outside the vocabulary, as far as the network itself has their counts; and (row, h, shape, n) of the others.

    A word that occurs n times has n of unlisted + 1; one that does not occur has 1, and so needs no count.
    """
    h, shape, bounds = hashed(buf, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    out = np.ones(len(h), bool)
    if len(net.hashes):
        out = net.hashes[np.minimum(np.searchsorted(net.hashes, h), len(net.hashes) - 1)] != h
    h, shape, row = h[out], shape[out], row[out]
    value = -np.log(net.unlisted[shape] + 1.0)
    rest = np.ones(len(h), bool)
    if len(net.common):
        key = _keys(h, shape)
        at = np.minimum(np.searchsorted(net.common, key), len(net.common) - 1)
        rest = net.common[at] != key
        value[~rest] += net.logs[at[~rest]]
    total = np.bincount(row, value, minlength=len(off) - 1)
    h, shape, row = h[rest], shape[rest], row[rest]
    first, n = _distinct(h, shape, row)
    return total, row[first], h[first], shape[first], n


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with n_tokens, pll and mean_pll, replacing columns of those names.

    pll is the sum of the log-probabilities of all words of the whole text, each given its neighbours; mean_pll is pll by
    n_tokens. A null text, or one without words, has 0 tokens, pll 0 and mean_pll null. Equal texts score alike; an empty table gives an
    empty result.
    """
    new = ("n_tokens", "pll", "mean_pll")
    kept = [f.name for f in docs.schema.fields if f.name.lower() not in new]
    sent, joined = docs.sparkSession.sparkContext.broadcast(net), net.rare is not None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = packed(batch.column(2))
            n, total, words_ = np.zeros(len(batch), np.int64), np.zeros(len(batch)), []
            for i, j in runs(off, 1 << 20):
                part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, bounds = tokens(sent.value, part, at)
                p = log_probabilities(sent.value, ids, neighbours(sent.value, ids, bounds))
                n[i:j] = np.diff(bounds)
                more, row, *word = unlisted_words(sent.value, part, at)
                total[i:j] = np.bincount(np.repeat(np.arange(j - i), n[i:j]), p, minlength=j - i) + more
                if joined:
                    words_.append((row + i, *word))
            row, h, shape, many = (np.concatenate(v) for v in zip(*words_, strict=True)) if words_ else (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
            values = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(shape, pa.int32()), pa.array(many)], ["h", "shape", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(total), lists], ["a", "b", "n_tokens", "pll", "rest"])

    # a text is known by 128 bits
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    a, b = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    found = docs.select(a.alias("a"), b.alias("b"), text.alias("text")).mapInArrow(of, "a long, b long, n_tokens long, pll double, rest array<struct<h: long, shape: int, times: long>>")
    if joined:
        found = cut(found.dropDuplicates(["a", "b"]))
        more = found.select("a", "b", F.explode("rest").alias("r")).select("a", "b", "r.*").join(net.rare, ["h", "shape"])
        more = more.groupBy("a", "b").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
        found = found.drop("rest").join(more, ["a", "b"], "left").withColumn("pll", F.col("pll") + F.coalesce("more", F.lit(0.0)))
    else:
        found = found.drop("rest").dropDuplicates(["a", "b"])
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_pll")
    found = found.select(F.col("a").alias("__a"), F.col("b").alias("__b"), "n_tokens", F.round("pll", 6).alias("pll"), mean)
    own = docs.select(*[F.col(f"`{c}`") for c in kept], a.alias("__a"), b.alias("__b"))
    return own.join(found, ["__a", "__b"]).select(*[F.col(f"`{c}`") for c in kept], *new)
