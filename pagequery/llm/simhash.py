"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint of 64 bits stands on a ring of RING segments. If two fingerprints differ in at most `most` bits, there is a
segment from which every chain of l consecutive segments has at most floor(l * most / RING) differences. Those budgets are
zero for the first segments, which therefore agree and make the join key; the longer chains then prune what meets
under a key, before the full Hamming check.

A key that more than CROWD fingerprints share is not paired: there each fingerprint is sent to itself and its one-bit
neighbours, and those that meet (at most 65, and never more than two bits apart) are linked to the smallest. That is as
exact, and linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDED, cut, grams, mix, packed, prefix, runs, spans, tidy, words
from .graph import components

SEED = 42
RING = 7
CROWD = 48
_ENDS = [round(64 * j / RING) for j in range(RING + 1)]


def simhash(text: bytes, size: int = 3) -> int:
    """The 64-bit SimHash of the shingles of `size` lower-cased words (A-Z only); without words 0."""
    found = text.lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[j:] for j in range(size)), strict=False)) if len(found) >= size else [b" ".join(found)]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, SEED) for s in shingles], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row: the SimHash of its whole text, in two's complement; null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, fp long")


def _segment(fp: Column, j: int) -> Column:
    low, high = _ENDS[j % RING], _ENDS[j % RING + 1]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def _free(most: int) -> int:
    """How many segments a chain begins with that must agree."""
    return max(l for l in range(RING + 1) if l * most // RING == 0)


def _keys(fp: Column, most: int) -> Column:
    """A key for each segment of the ring: its number, and the bits of the segments that agree in a chain from it."""
    keys = []
    for i in range(RING):
        key = F.lit(i).cast("long")
        for j in range(i, i + _free(most)):
            key = F.shiftleft(key, _ENDS[j % RING + 1] - _ENDS[j % RING]).bitwiseOR(_segment(fp, j))
        keys.append(key)
    return F.array(*keys)


def _chained(x: Column, start: Column, most: int) -> Column:
    """Whether each chain from `start` stays within its share of the differences x."""
    branches = None
    for i in range(RING):
        total, within = F.lit(0), F.lit(True)
        for l in range(1, RING + 1):
            total = total + F.bit_count(_segment(x, i + l - 1))
            if l > _free(most):
                within = within & (total <= l * most // RING)
        branches = F.when(start == i, within) if branches is None else branches.when(start == i, within)
    return branches


def links(points: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): enough links between the ids of `points` (id, fp; fp distinct) for all components at `most` (0 to 2) differing bits.

    Where fewer than CROWD meet, every pair within `most` bits is linked; in crowds, each to the smallest near it.
    """
    if not 0 <= most <= 2:
        raise ValueError("most must be 0, 1 or 2")
    keyed = points.select("id", "fp", F.posexplode(_keys(F.col("fp"), most)).alias("start", "key")).withColumn("key", F.struct("start", "key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(met, "key"))
    few = met.where(F.col("n") <= CROWD).select("key", "id", "fp")
    a, b = few.select("key", F.col("id").alias("a"), F.col("fp").alias("x")), few.select("key", F.col("id").alias("b"), F.col("fp").alias("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & _chained(differ, F.col("key.start"), most) & (F.bit_count(differ) <= most)).select("a", "b")
    many = met.where(F.col("n") > CROWD).select("id", "fp").distinct()
    flips = "array(fp)" if most == 0 else "concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))"
    balls = many.select("id", F.col("fp"), F.explode(F.expr(flips)).alias("at"))
    if most == 1:  # neighbours of one bit meet at either end, others only in between
        meet = balls.join(many.select(F.col("fp").alias("at"), F.col("id").alias("b")), "at").select(F.col("id").alias("a"), "b")
        return near.unionAll(meet).where("a <> b").distinct()
    groups = balls.groupBy("at").agg(F.min("id").alias("b"), F.collect_set("id").alias("ids")).where("size(ids) > 1")
    return near.unionAll(groups.select(F.explode("ids").alias("a"), "b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, most: int = 2, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at most `most` differing bits reach.

    Documents without words have the fingerprint 0 and are linked like any other; null text counts as empty. Equal
    fingerprints are one point of the search, however many rows have them. Rows repeated with one doc_id stay rows;
    a null doc_id gets a component of its fingerprint's other rows (null if there are none). Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = cut(fingerprints(docs, size))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(points.where("id IS NOT NULL"), most))
    named = points.join(found, points["id"] == found["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


#: Blocks of a document: a key of each is made of so many shingles, the smallest in an order of its own.
BLOCKS, SMALLEST = 12, 3
#: Members of a block up to which all its pairs are candidates at once; of larger ones, first the links to the first and the nearest earlier,
#: by groups of about NEAR, and then, in tiles of about TILE members a side, all pairs that are not yet in one component.
FEW, NEAR, TILE = 12, 5000, 1000
#: Most differing bits of candidates: 3.5 deviations over what a similarity of 0.8 leaves. From so many shingles on.
FAR, SURE = 20, 64
_SALTS = mix(np.arange(1, BLOCKS + 1, dtype=np.uint64))


def _outline(hashes: np.ndarray) -> tuple[int, int, list[int], int]:
    """(whole, fingerprint, block keys, number) of a set of shingle hashes."""
    own = np.unique(hashes)
    if not len(own):
        return 0, 0, [0] * BLOCKS, 0
    ones = np.unpackbits(own.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    fp = int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big", signed=True)
    orders = mix(own[None, :] ^ _SALTS[:, None])
    k = min(SMALLEST, len(own))
    least = np.sort(np.partition(orders, k - 1, axis=1)[:, :k], axis=1)
    key = np.zeros(BLOCKS, np.uint64)
    for j in range(k):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + least[:, j])
    return int((own.sum() ^ mix(own).sum()).astype(np.uint64).view(np.int64)), fp, key.view(np.int64).tolist(), len(own)


def _shingled(buf: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Hashes of each row's shingles of `size` lower-cased words, repeats included; of fewer words, that of the whole sequence."""
    starts, ends, bounds = words(buf, off)
    h = spans(prefix(buf, FOLDED), starts, ends)
    g, inside = grams(h, bounds, size)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            yield g[a : b - size + 1]
        else:
            one = np.zeros(min(b - a, 1), np.uint64)
            for x in h[a:b]:
                one = mix(one * np.uint64(0x2545F4914F6CDD1D) + x)
            yield one


def _unlinked(ids: np.ndarray, root: np.ndarray, fp: np.ndarray, n: np.ndarray, part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between members of a tile whose roots differ, of all pairs that the length and Hamming checks let pass; linked members share a root from then on."""
    root, sizes = root.copy(), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    across = part.min() != part.max()
    out = []
    for i in range(len(sets)):
        open_ = root != root[i]
        open_[: i + 1] = False
        if across:
            open_ &= part != part[i]
        open_ &= np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])
        open_ &= (np.minimum(n, n[i]) < SURE) | (np.bitwise_count(fp ^ fp[i]) <= FAR)
        if not open_.any():
            continue
        own = code[at[i] : at[i + 1]]
        many = start[own + 1] - start[own]
        met = posting[np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        shared = np.bincount(met, minlength=len(sets))
        for j in np.flatnonzero(open_ & (shared >= similarity * (sizes + sizes[i] - shared))):
            if root[j] != root[i]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents whose sets of shingles have a Jaccard similarity of at least `similarity`, linked.

    SimHashes of such documents differ in some ten of 64 bits, which no key over segments can find among many; so
    candidates come from blocks, keys of the SMALLEST shingles in each of BLOCKS orders, of which a pair at 0.8 shares one
    with a probability of 0.9998. Of candidates, the pigeonring chains and the Hamming check let pass those within FAR bits (texts of
    fewer than SURE shingles all), and their whole sets of shingles decide. In a block of more than FEW, members are linked to the first and the
    nearest earlier one first; all pairs of it that this leaves in different components are then compared. Equal sets are one point of the search. Null text counts
    as empty; documents without words are equal. Rows with a null doc_id are left out, rows repeated stay; an empty table gives an empty
    result.
    """
    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = packed(batch.column(1))
            rows = [_outline(s) for i, j in runs(off, 1 << 20) for s in _shingled(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", "whole", "fp", "keys", "n"])

    rows = cut(plain.mapInArrow(outline, "id long, whole long, fp long, keys array<long>, n int"))
    points = rows.groupBy("whole", "n").agg(F.min(F.struct("id", "fp", "keys")).alias("p")).select("p.id", "p.fp", "n", "p.keys")
    keyed = points.select("id", "fp", "n", F.posexplode("keys").alias("block", "key"))
    often = keyed.groupBy("block", "key").agg(F.count("*").alias("m"), F.min(F.struct("id", "fp", "n")).alias("f")).where("m > 1")
    met = cut(keyed.join(often, ["block", "key"]))
    one, two = (met.where(F.col("m") <= FEW).select("block", "key", *(F.col(c).alias(c + t) for c in ("id", "fp", "n"))) for t in "ab")
    pairs = one.join(two, ["block", "key"]).where("ida < idb").select("ida", "fpa", "na", "idb", "fpb", "nb")
    tidy(docs.sparkSession)
    large = met.where(F.col("m") > FEW)
    order = Window.partitionBy("block", "key", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / NEAR))).orderBy("id")
    previous = large.select(F.lag(F.struct("id", "fp", "n")).over(order).alias("f"), "id", "fp", "n")
    star = previous.unionByName(large.select("f", "id", "fp", "n")).where("f.id < id").select(F.col("f.id").alias("ida"), F.col("f.fp").alias("fpa"), F.col("f.n").alias("na"), F.col("id").alias("idb"), F.col("fp").alias("fpb"), F.col("n").alias("nb"))
    pairs = pairs.unionAll(star)
    differ = F.col("fpa").bitwiseXOR(F.col("fpb"))
    chained = F.lit(False)
    for i in range(RING):
        chained = chained | _chained(differ, F.lit(i), FAR)
    close = (F.least("na", "nb") < SURE) | (chained & (F.bit_count(differ) <= FAR))
    pairs = cut(pairs.where((F.least("na", "nb") >= similarity * F.greatest("na", "nb")) & close).select("ida", "idb").distinct())
    asked = pairs.select(F.col("ida").alias("id"), F.struct("ida", "idb").alias("ask")).unionAll(pairs.select(F.col("idb").alias("id"), F.struct("ida", "idb").alias("ask")))
    asked = asked.groupBy("id").agg(F.collect_list("ask").alias("asks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = batch.column(0).to_pylist(), batch.column(2)
            buf, off = packed(batch.column(1))
            for i, j in runs(off, 1 << 20):
                out = []
                for k, s in enumerate(_shingled(buf[off[i] : off[j]], off[i : j + 1] - off[i], size), i):
                    own = np.unique(s >> np.uint64(16)).tobytes()
                    out += [(a["ida"], a["idb"], ids[k], own) for a in asks[k].as_py()]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["ida", "idb", "id", "own"])

    both = plain.join(asked, "id").select("id", "text", "asks").mapInArrow(sets, "ida long, idb long, id long, own binary")
    left, right = both.where("id = ida").select("ida", "idb", F.col("own").alias("x")), both.where("id = idb").select("ida", "idb", F.col("own").alias("y"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    tidy(docs.sparkSession)
    first = cut(left.join(right, ["ida", "idb"]).mapInArrow(alike, "a long, b long"))
    roots = components(first)
    crowd = large.select("block", "key", "m", "id", "fp", "n").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    mixed = crowd.groupBy("block", "key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("block", "key")
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    crowd = crowd.join(mixed, ["block", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    crowd = cut(crowd.select("block", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "id", "root", "fp", "n", "part"))

    def own_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (buf, off) = batch.column(0), packed(batch.column(1))
            for i, j in runs(off, 1 << 20):
                own = [np.unique(s >> np.uint64(16)).tobytes() for s in _shingled(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(own, pa.binary())], ["id", "own"])

    def tile(members: pa.Table) -> pa.Table:
        of = {c: members.column(c).to_numpy() for c in ("id", "root", "fp", "n", "part")}
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in members.column("own").combine_chunks()]
        pairs = _unlinked(of["id"], of["root"], of["fp"].view(np.uint64), of["n"], of["part"], sets, similarity)
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    whole = plain.join(crowd.select("id").distinct(), "id").dropDuplicates(["id"]).mapInArrow(own_set, "id long, own binary")
    second = crowd.join(whole, "id").groupBy("block", "key", "low", "high").applyInArrow(tile, "a long, b long")
    found = components(first.unionAll(second).distinct())
    named = points.select("id").join(found, points["id"] == found["node"], "left").select("id", F.coalesce("root", "id").alias("component_id"))
    heads = rows.groupBy("whole", "n").agg(F.min("id").alias("head"))
    return rows.select("id", "whole", "n").join(heads, ["whole", "n"]).join(named.withColumnRenamed("id", "head"), "head").select(F.col("id").alias("doc_id"), "component_id")


def distinct(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id; rows with a null doc_id stay."""
    lost = similar(docs, size, similarity).where("component_id < doc_id").select(F.col("doc_id").alias("__lost")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["__lost"], "left_anti")
