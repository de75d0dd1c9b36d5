"""Exact substring dedup with suffix arrays: every byte under a string of LENGTH bytes that also starts elsewhere.

Only neighbourhoods that can repeat are sorted. A string of LENGTH bytes is at home at the smallest gram (GRAM bytes, by hash;
the leftmost of equals) within it, so equal strings have equal homes. The strings of a document that share a home are
consecutive: together they are one stretch of text. Homes that occur once in the corpus cannot hold a repeat. Equal stretches are one
class with a count. Where a home has different ones, the classes are dealt by home and cut into shards of SHARD bytes; each
shard is sorted as a suffix array by Larsson-Sadakane refinement, with Kasai's common prefixes between neighbours, and the
strings of a home that lies in several shards are merged by binary search: those of the later shard are looked up in the
sorted strings of the earlier ones.

A home whose classes take more than MOST bytes is dealt again by longer grams: its strings are halved by the place of the
home in them, and all strings of a half share more bytes around the home, which are its new home. Halves of single places are
equal strings, so that ends, and every task holds MOST + SHARD bytes of text at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, packed, prefix, runs, spans

LENGTH, GRAM = 400, 48
#: Bytes of a shard, and of the stretches of a home that are merged in one task.
SHARD, MOST = 1 << 20, 1 << 22
_POSITION = np.uint64((1 << 24) - 1)
_NO_ID = -(1 << 63)


def homes(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, home, digest, start, count, place) of the stretches: `count` strings from byte `start` of its row share a home, `place` bytes on."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(buf) < length:
        return none
    sums = prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    g = spans(sums, at, at + gram)
    w = length - gram + 1
    # a long row is cut where positions would not fit their bits; windows near the cut are done with the next part
    best = np.empty(len(g) - w + 1, np.int64)
    step = int(_POSITION) - 2 * w
    for a in range(0, len(best), step):
        b = min(a + step, len(best))
        part = g[a : b + w - 1]
        key = np.full(-(-len(part) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[: len(part)] = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        blocks = key.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        best[a:b] = (np.minimum(back[: b - a], ahead[w - 1 : w - 1 + b - a]) & _POSITION).astype(np.int64) + a
    count = np.maximum(np.diff(off) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    if not len(row):
        return none
    q = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[row]
    home = best[q]
    first = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (row[1:] != row[:-1])]))
    many = np.diff(np.append(first, len(q)))
    start = q[first]
    return row[first], g[home[first]], spans(sums, start, start + many + length - 1), start - off[row[first]], many, home[first] - start


def suffix_array(buf: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first `depth` bytes; ends[i] is where the text of position i ends.

    Larsson-Sadakane: order by the first seven bytes, then double the sorted length, with the ranks as keys, and sort
    only within groups that are still tied.
    """
    n = len(buf)
    key = np.zeros(n, np.int64)
    at = np.arange(n)
    for j in range(7):
        inside = at + j < ends
        key = key * 257
        key[inside] += buf[at[inside] + j].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(n, np.int64)
    rank[order] = first[group] + 1  # a group's rank is the place of its first
    size = np.diff(np.append(first, n))
    tied = np.flatnonzero(size[group] > 1)  # places in the order
    h = 7
    while len(tied) and h < depth:
        i = order[tied]
        beyond = i + h >= ends[i]
        second = np.where(beyond, 0, rank[np.minimum(i + h, n - 1)])
        both = rank[i] * (n + 2) + second
        sort = np.argsort(both, kind="stable")
        i, both = i[sort], both[sort]
        order[tied] = i
        new = np.concatenate([[True], both[1:] != both[:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[i] = tied[first][group] + 1
        tied = tied[np.diff(np.append(first, len(i)))[group] > 1]
        h *= 2
    return order, rank


def common_prefixes(buf: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, how many bytes it shares with the suffix before it in the order (0 for the first).

    Kasai's observation in blocks: where the suffix one byte earlier has its neighbour one byte earlier too, the prefix
    is one shorter than its; only the other positions are compared, eight bytes at a time.
    """
    n = len(buf)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[1:] - 1 == before[:-1]) & (ends[1:] == ends[:-1]) & (at[1:] < ends[:-1])
    prev = before[1:] - 1
    ok = follows[1:]
    follows[1:][ok] = (buf[at[1:][ok] - 1] == buf[prev[ok]]) & (ends[before[1:][ok]] == ends[prev[ok]])
    out = np.zeros(n, np.int64)
    i = np.flatnonzero(~follows & (before >= 0))
    j = before[i]
    most = np.minimum(ends[i] - i, ends[j] - j)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    done = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        differ = words[i[live] + done[live]] != words[j[live] + done[live]]
        some = differ.any(1)
        done[live] += np.where(some, differ.argmax(1), 8)
        live = live[~some & (done[live] < most[live])]
    out[i] = np.minimum(done, most)
    anchor = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(follows, np.maximum(out[anchor] - (at - anchor), 0), out)


class Shard:
    """The strings of `length` bytes of a shard's texts, in order: their starts, and the classes of equal ones."""

    def __init__(self, rows: list[tuple], texts: list[bytes], length: int = LENGTH):
        self.rows, self.length = rows, length
        self.off = np.cumsum([0, *map(len, texts)])
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.repeat(self.off[1:], np.diff(self.off))
        order, _ = suffix_array(self.buf, ends, length)
        shared = common_prefixes(self.buf, ends, order)
        self.starts = order[order + length <= ends[order]]
        self.first = shared[self.starts] < length
        self.classes = np.cumsum(self.first) - 1
        self.again = np.bincount(self.classes, minlength=1) > 1  # by class: whether its string starts more than once
        self._words: np.ndarray | None = None

    def words(self) -> np.ndarray:
        """The eight bytes from each position on, as numbers in the order of the bytes."""
        if self._words is None:
            padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
            self._words = np.lib.stride_tricks.as_strided(padded, (len(self.buf), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
        return self._words

    def of_group(self, group: int) -> np.ndarray:
        """Places in `starts` of one string of each class of the rows of a group; the rows of a group are consecutive."""
        own = [k for k, r in enumerate(self.rows) if r[0] == group]
        low, high = self.off[own[0]], self.off[own[-1] + 1]
        return np.flatnonzero(self.first & (self.starts >= low) & (self.starts < high))

    def merge(self, other: "Shard", group: int) -> None:
        """Mark the classes of a group whose strings both shards have: a binary search of the own strings in the other's sorted ones."""
        mine, theirs = self.of_group(group), other.of_group(group)
        at = search(other.words(), other.starts[theirs], self.words(), self.starts[mine], self.length)
        hit = np.flatnonzero(at >= 0)
        self.again[self.classes[mine[hit]]] = True
        other.again[other.classes[theirs[at[hit]]]] = True

    def found(self) -> np.ndarray:
        """(row, first, end): maximal runs of the starts of strings that start elsewhere too, in bytes of their rows."""
        flags = np.zeros(len(self.buf) + 2, np.int8)
        flags[self.starts[self.again[self.classes]] + 1] = 1
        edge = np.flatnonzero(np.diff(flags)).reshape(-1, 2)
        row = np.searchsorted(self.off, edge[:, 0], "right") - 1
        return np.column_stack([row, edge - self.off[row][:, None]])


def search(words: np.ndarray, sorted_starts: np.ndarray, other: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each string of `other`, its place among the sorted different strings of `words`, or -1.

    A binary search for all strings at once, eight bytes at a time: what agrees so far is a range of the sorted strings, and each
    further number narrows the range.
    """
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(sorted_starts), np.int64)
    live = np.arange(len(starts)) if len(sorted_starts) else np.zeros(0, np.int64)
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for step in steps:
        x = other[starts[live] + step]
        a, b = words[sorted_starts[low[live]] + step], words[sorted_starts[high[live] - 1] + step]
        some = (x >= a) & (x <= b)
        high[live[~some]] = low[live[~some]]
        narrow = some & (a != b)
        narrowed, x = live[narrow], x[narrow]
        for side in ("left", "right"):
            i, j = low[narrowed], high[narrowed]
            while (open_ := np.flatnonzero(i < j)).size:
                k = (i[open_] + j[open_]) // 2
                y = words[sorted_starts[k] + step]
                right = y < x[open_] if side == "left" else y <= x[open_]
                i[open_[right]], j[open_[~right]] = k[right] + 1, k[~right]
            if side == "left":
                first = i
            else:
                low[narrowed], high[narrowed] = first, i
        live = live[some]
        live = live[low[live] < high[live]]
        if not len(live):
            break
    out = np.full(len(starts), -1, np.int64)
    out[live] = low[live]
    return out


def merged(stretches: Iterator[tuple], length: int = LENGTH, size: int = SHARD) -> Iterator[Shard]:
    """Shards of the stretches (group, ..., text), in order of their groups, once all their groups are complete and merged."""
    held: list[Shard] = []
    rows, texts, total = [], [], 0

    def done() -> Iterator[Shard]:
        nonlocal held
        shard = Shard(rows, texts, length)
        for other in held:
            if other.rows[-1][0] == rows[0][0]:
                shard.merge(other, rows[0][0])
        if held and (held[-1].rows[-1][0] != rows[0][0] or rows[-1][0] != rows[0][0]):
            yield from held
            held = []
        held.append(shard)

    for *row, text in stretches:
        if texts and total + len(text) > size:
            yield from done()
            rows, texts, total = [], [], 0
        rows.append(tuple(row)), texts.append(text)
        total += len(text)
    if texts:
        yield from done()
    yield from held


def _batch(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_FOUND = "id long, v long, a long, b long"
_STRETCH = ["h", "t", "c", "id", "v", "q", "m", "p", "low", "high"]
_PART = ", ".join(f"{n} long" for n in _STRETCH) + ", part binary"
_PART_TYPES = [pa.int64()] * len(_STRETCH) + [pa.binary()]


def _kinds(stretches: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Classes of equal stretches of a home: how many there are, and one of them."""
    return stretches.groupBy("h", "t").agg(F.sum("c").alias("c"), F.min(F.struct("id", "v", "q", "m", "p", *more)).alias("r"))


def _groups(kinds: DataFrame, length: int) -> DataFrame:
    """Homes with different stretches of which one at least is not known to repeat, and the bytes that these take."""
    sizes = kinds.groupBy("h").agg(F.count("*").alias("d"), F.min("c").alias("least"), F.sum(F.col("r.m") + (length - 1)).alias("bytes"))
    return cut(sizes.where("d > 1 AND least = 1").select("h", (F.col("bytes") > MOST).alias("large")))


def _range(who: DataFrame, length: int) -> DataFrame:
    return who.select("id", "v", F.col("q").alias("a"), (F.col("q") + F.col("m") + (length - 1)).alias("b"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, v, a, b): byte ranges of docs (id, v, text) under strings of `length` bytes that also start elsewhere; they may overlap.

    id and v together name a text; rows of one (id, v) must have the same text, and are repeats of each other.
    """
    plain, size = docs.select("id", "v", "text"), SHARD

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, off = packed(batch.column(2))
            for i, j in runs(off, 1 << 20):
                row, home, digest, start, count, place = homes(buf[off[i] : off[j]], off[i : j + 1] - off[i], length, gram)
                yield _batch([home.view(np.int64), digest.view(np.int64), ids[row + i], versions[row + i], start, count, place], [pa.int64()] * 4 + [pa.int32()] * 3, ["h", "t", "id", "v", "q", "m", "p"])

    every = cut(plain.mapInArrow(stretches, "h long, t long, id long, v long, q int, m int, p int"))
    again = cut(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    kept = cut(every.join(again, "h").withColumn("c", F.lit(1)))
    kinds = _kinds(kept)
    groups = _groups(kinds, length)
    found = _range(kept.join(kinds.where("c > 1").select("h", "t"), ["h", "t"]), length)
    sought = kinds.join(groups, "h").select("h", "t", "c", "large", "r.id", "r.v", "r.q", "r.m", "r.p")
    asked = sought.groupBy("id", "v").agg(F.collect_list(F.struct("h", "t", "c", "q", "m", "p", "large")).alias("asked"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = packed(batch.column(2))
            text = buf.tobytes()
            lists = batch.column(3)
            flat = lists.flatten()
            per = np.diff(lists.offsets.to_numpy())
            f = {n: flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "t", "c", "q", "m", "p", "large")}
            _, once = np.unique(np.column_stack([f["h"], f["t"]]), axis=0, return_index=True)  # a row repeated gives its stretches once
            at = np.repeat(off[:-1], per)[once] + f["q"][once]
            to = at + f["m"][once] + length - 1
            own = [np.repeat(batch.column(k).to_numpy(), per)[once] for k in (0, 1)]
            ends = np.append(np.flatnonzero(np.diff((np.cumsum(to - at)) >> 22)) + 1, len(at))
            for i, j in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                k = once[i:j]
                whole = [np.zeros(j - i, np.int64), np.full(j - i, length - gram)]
                columns = [f["h"][k], f["t"][k], f["c"][k], own[0][i:j], own[1][i:j], f["q"][k], f["m"][k], f["p"][k], *whole, [text[a:b] for a, b in zip(at[i:j], to[i:j], strict=True)], f["large"][k].astype(bool)]
                yield _batch(columns, [*_PART_TYPES, pa.bool_()], [*_STRETCH, "part", "large"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, _, c, i, v, q, m, p, low, high, part in zip(*(batch.column(k).to_pylist() for k in range(len(_STRETCH) + 1)), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(p - b, 0), min(p - a, m - 1)  # strings with the home a to b bytes on
                    if a > b or first > last:
                        continue
                    text = part[first : last + length]
                    sums = prefix(np.frombuffer(part, np.uint8))
                    home, digest = spans(sums, np.array([p - a, first]), np.array([p + length - b, last + length]))
                    key = mix(np.array([home ^ np.uint64(a * 0x9E3779B1 + b)]))[0]
                    out.append((int(key.view(np.int64)), int(mix(np.array([digest + np.uint64(p - first)]))[0].view(np.int64)), c, i, v, q + first, last - first + 1, p - first, a, b, text))
            yield _batch(list(zip(*out, strict=True)) or [()] * len(_PART_TYPES), _PART_TYPES, [*_STRETCH, "part"])

    parts = plain.join(asked, ["id", "v"]).select("id", "v", "text", "asked").mapInArrow(slices, _PART + ", large boolean")
    few = None
    while groups.where("large").head(1):
        parts = cut(parts)
        small = parts.where("NOT large").drop("large")
        few = small if few is None else few.unionByName(small)
        half = cut(parts.where("large").drop("large").mapInArrow(halves, _PART))
        kinds = _kinds(half, ("low", "high", "part"))
        groups = _groups(kinds, length)
        found = found.unionAll(_range(half.where("c = 1").join(kinds.where("c > 1").select("h", "t"), ["h", "t"]), length))
        parts = kinds.join(groups, "h").select("h", "t", "c", "r.*", "large").select(*_STRETCH, "part", "large")
    parts = parts.drop("large")
    parts = parts if few is None else few.unionByName(parts)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                    if row[:2] != last:
                        yield row
                    last = row[:2]

        for shard in merged(rows(), length, size):
            hit = shard.found()
            c, i, v, q = (np.array([r[k] for r in shard.rows], np.int64)[hit[:, 0]] for k in (2, 3, 4, 5))
            one = c == 1  # the others are known to repeat
            yield _batch([i[one], v[one], (q + hit[:, 1])[one], (q + hit[:, 2] - 1 + length)[one]], [pa.int64()] * 4, ["id", "v", "a", "b"])

    sorted_ = parts.select("h", "t", "c", "id", "v", "q", "part").repartition("h").sortWithinPartitions("h", "t")
    return found.unionAll(sorted_.mapInArrow(shards, _FOUND))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, and with keep_text `kept`, the bytes that remain.

    Removed is each byte of the UTF-8 text under a string of `length` bytes that also starts anywhere else: in another row
    or elsewhere in its own; strings are judged on the input. Null text counts as empty; texts shorter than `length` stay whole.
    Equal texts in several rows are repeats of each other, so a text of `length` bytes or more that occurs twice is removed wholly from both,
    whether the rows have one doc_id or two. Rows with one doc_id and different texts, or with a null doc_id, are rows like any other. Extra
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("v"), text.alias("text"))
    found = repeats(rows, length, gram).groupBy("id", "v").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = packed(batch.column(1))
            text = buf.tobytes()
            out: list[tuple] = []
            for k, cuts in enumerate(batch.column(2)):
                one = text[off[k] : off[k + 1]]
                removed = n = at = 0
                rest = []
                if cuts.is_valid:
                    pairs = np.column_stack([cuts.values.field("a").to_numpy(), cuts.values.field("b").to_numpy()])
                    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                    reach = np.maximum.accumulate(np.minimum(pairs[:, 1], len(one)))
                    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                    lows = pairs[new, 0]
                    highs = reach[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)]
                    for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
                        if a < b:
                            rest.append(one[at:a])
                            at, removed, n = b, removed + b - a, n + 1
                rest.append(one[at:])
                kept = b"".join(rest)
                out.append((len(one), removed, n, hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_text else ()))
            columns = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    done = rows.join(found, ["id", "v"], "left").select("id", "text", "cuts").mapInArrow(of, schema)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
