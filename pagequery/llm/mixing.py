"""Mixing sources to target weights by a splitting tree over blocks of documents.

Each source's documents are dealt into blocks by a hash. A source draws all its blocks as often as its target holds its whole
size, each time in a permutation of its own, and the first blocks of one more permutation for the rest, whose last one is
taken in part. Output shards get their numbers of each source's blocks by halving: the blocks of a node are split
between its two halves by a multivariate hypergeometric draw, so that the quotas of the sources stay exact. A shard's blocks are
then disjoint ranges of each source's permuted draws, and its documents stand in an order of the shard's own. What is taken of a
document is what the shards have of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Weights of the sources in order of their names, repeating; no document is taken more often than this.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Documents that a block has on average, up to this many blocks of a source; larger sources have larger blocks.
BLOCK_DOCS, MAX_BLOCKS = 256, 1 << 16
#: Documents among which the last words of a source are sought.
LAST = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all sizes by weight, none above `most` times its size; what is cut off is shared again by weight."""
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        whole = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / whole > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= over
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source every shard gets (shards x sources); shard sizes differ by one block at most.

    A node of the tree draws its left half's blocks without replacement from its own: a multivariate hypergeometric
    draw. Column sums are the counts exactly.
    """
    out = np.zeros((shards, len(counts)), np.int64)

    def down(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        left = int(have.sum()) * (middle - first) // (last - first)
        taken = rng.multivariate_hypergeometric(have, left, method="marginals") if have.sum() else have
        down(first, middle, taken)
        down(middle, last, have - taken)

    down(0, shards, np.asarray(counts, np.int64))
    return out


def draws(blocks: list[tuple[int, int]], target: float, rng: np.random.Generator) -> list[tuple[int, int, int | None]]:
    """(block, copy, words) in the order drawn, from (block, size) of a source's blocks; words is null for a whole block, else about so many are taken of it."""
    size = sum(s for _, s in blocks)
    order = sorted(blocks)
    copies = int(target // size) if size else 0
    out: list[tuple[int, int, int | None]] = [(order[i][0], copy, None) for copy in range(copies) for i in rng.permutation(len(order))]
    left = round(target - copies * size)
    for i in rng.permutation(len(order)):
        if left <= 0:
            break
        block, words = order[i]
        out.append((block, copies, None if words <= left else left))
        left -= words
    return out


def fill(sizes: np.ndarray, words: int) -> np.ndarray:
    """Which documents, in this order, give about `words` words and no more.

    They are taken as they fit; then the last ones taken and the first ones left out are chosen again, LAST of them, so that their sum is the largest that fits.
    """
    taken, left = np.zeros(len(sizes), bool), words
    for i, size in enumerate(sizes.tolist()):
        if size <= left:
            taken[i] = True
            left -= size
    some = np.concatenate([np.flatnonzero(taken)[-LAST // 2 :], np.flatnonzero(~taken)[: LAST // 2]])
    left += int(sizes[some][taken[some]].sum())
    reached = [np.arange(left + 1) == 0]
    for size in sizes[some].tolist():
        now = reached[-1].copy()
        if 0 < size <= left:
            now[size:] |= reached[-1][: left + 1 - size]
        reached.append(now)
    at = int(np.flatnonzero(reached[-1]).max())
    for k in range(len(some) - 1, -1, -1):
        use = not reached[k][at]
        taken[some[k]] = use or sizes[some[k]] == 0
        at -= int(sizes[some[k]]) if use else 0
    return taken


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, k, source, size, rank): the words of each whole text, and the place of the document in its source's order."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    source = F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("k"), source.alias("source"), size.alias("size"), F.xxhash64(F.col("doc_id").cast("long"), source, F.lit("mix"), F.crc32(F.coalesce(text, F.lit("")))).alias("rank"))


def _block(count: Column) -> Column:
    """Blocks are ranges of the hashed order; how many, follows from the documents of the source."""
    blocks = F.least(F.greatest(F.ceil(count / BLOCK_DOCS), F.lit(1)), F.lit(MAX_BLOCKS)).cast("long")
    return F.shiftrightunsigned(F.shiftrightunsigned("rank", 33).cast("long") * blocks, 31).cast("int")


def mix(docs: DataFrame, shards: int = 16, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(taken, copies) of the mix of docs (doc_id, source, text).

    copies has a row for each time that a document is taken: doc_id, source, copy, shard and position, its place in its shard.
    taken has a row for each row of docs: doc_id, source, size, source_size, target, taken, the words that the shards have
    of it, repeats counted, and shards, which those are. Null text has size 0; null is a source, ordered last; documents of size 0 go with their block; rows
    repeated are documents of their own; an empty table gives empty results. The seed and the table alone decide.

    Of a source's last block, documents are taken in hashed order as they fit, and the last ones so that the target is met as nearly as some LAST of
    them allow. The driver holds a few numbers for each source; blocks are drawn source by source in the tasks.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs))
    sources = sorted(rows.groupBy("k").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.k == "n", r.k))
    small = len(sources) <= 10_000
    hint = F.broadcast if small else (lambda df: df)
    goal = targets([r["size"] for r in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    aims = spark.createDataFrame([(r.k, int(r["size"]), float(t), r["n"]) for r, t in zip(sources, goal, strict=True)], "k string, source_size long, target double, n long")
    blocked = rows.join(hint(aims), "k").withColumn("block", _block(F.col("n"))).drop("n")
    sums = blocked.groupBy("k", "block").agg(F.sum("size").alias("words"), F.max("target").alias("target"))

    def draw(pdf):
        import zlib

        import pandas as pd

        k = pdf["k"].iloc[0]
        found = draws([(int(b), int(w)) for b, w in zip(pdf["block"], pdf["words"], strict=True)], float(pdf["target"].iloc[0]), np.random.default_rng([seed, zlib.crc32(k.encode())]))
        return pd.DataFrame([(k, i, b, c, w) for i, (b, c, w) in enumerate(found)], columns=["k", "i", "block", "copy", "words"]).astype({"words": "Int64"})

    drawn = cut(sums.groupBy("k").applyInPandas(draw, "k string, i long, block int, copy int, words long"))
    counts = {r.k: r["n"] for r in drawn.groupBy("k").agg(F.count("*").alias("n")).collect()}
    share = split(np.array([counts.get(r.k, 0) for r in sources], np.int64), shards, np.random.default_rng(seed)) if sources else np.zeros((shards, 0), np.int64)
    ends = spark.createDataFrame([(r.k, share[:, j].cumsum().tolist()) for j, r in enumerate(sources)], "k string, ends array<long>")
    placed = cut(drawn.join(hint(ends), "k").select("k", "block", "words", F.struct("copy", F.size(F.filter("ends", lambda e: e <= F.col("i"))).alias("shard")).alias("draw")))
    whole = placed.where("words IS NULL").groupBy("k", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws"))
    part = placed.where("words IS NOT NULL").select("k", "block", "words", "draw")

    def filled(pdf):
        pdf = pdf.sort_values(["rank", "doc_id", "size", "row"], kind="stable")
        return pdf[fill(pdf["size"].to_numpy(), int(pdf["words"].iloc[0]))][["row", "copy", "shard"]]

    last = blocked.join(part, ["k", "block"]).select("k", "block", "row", "doc_id", "rank", "size", "words", "draw.*").groupBy("k", "block").applyInPandas(filled, "row long, copy int, shard int")
    more = last.select("row", F.array(F.struct("copy", "shard")).alias("more"))
    none = F.array().cast("array<struct<copy: int, shard: int>>")
    base = blocked.join(whole, ["k", "block"], "left").join(more, "row", "left").withColumn("draws", F.concat(F.coalesce("draws", none), F.coalesce("more", none)))
    taken = base.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))
    copies = base.select("doc_id", "source", "rank", F.explode("draws").alias("d"))
    return taken, copies.select("doc_id", "source", "d.copy", "d.shard", F.xxhash64("rank", "d.copy", "d.shard", F.lit(seed)).alias("position"))
