"""Benchmark decontamination by templates: windows of canonical tokens are hash-joined, and their slots must agree.

Numbers, quantities, names and units become typed placeholders, so that a question whose parameters were changed keeps
its template. A capital at the start of a text, line or sentence is read both ways, as a plain word and as a name. A document
is taken for a copy of an item if, in one place, it holds at least COVERED of the item's template windows and each value of
the item's slots always stands for one and the same value of the document; or if so many of all its windows, also those of
placeholders only, are there with their values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXACT, grams, packed, prefix, runs, spans, words

#: Tokens of a window; share of an item's windows; windows of items that are joined in one pass over the documents.
WINDOW, COVERED, BLOCK_WINDOWS = 5, 0.8, 1_000_000
#: Units of measure, as they stand after a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw j kj cal kcal v a c f k degrees degree percent % dollars dollar euros euro cents cent usd eur"
#: Numbers spelled out.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"

_PLAIN, _NUMBER, _QUANTITY, _NAME, _UNIT = range(5)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "%"]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin letters of two bytes from C3 80 to C3 9E."""
    low = _LOWER[buf]
    if len(buf) > 1:
        wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        low[wide] += 32
    return low


def _hash(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    return spans(prefix(np.frombuffer(b"".join(raw), np.uint8)), off[:-1], off[1:])


_UNIT_HASHES = np.sort(_hash(UNITS.split()))
_NUMBER_HASHES = np.sort(_hash(NUMBERS.split()))
_MARKS = _hash([f"\x00{k}" for k in range(5)])


def _among(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, hashes), len(of) - 1)] == hashes


def templates(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, kinds, initial, bounds) of the words of each row.

    values are hashes of the words, lower-cased and without punctuation at their ends. A number has a digit or is spelled out,
    a quantity also has a letter, a unit follows a number, and a name begins with a capital that no start of a text, line or
    sentence explains; initial marks the plain words whose capital is explained so, and which may be names.
    """
    starts, ends, bounds = words(buf, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), bounds
    first = np.zeros(len(starts), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    first[1:] |= _STOP[buf[ends[:-1] - 1]]
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    first[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    a, b = starts.copy(), ends.copy()
    while len(at := np.flatnonzero((a < b) & _EDGE[buf[np.minimum(a, len(buf) - 1)]])):
        a[at] += 1
    while len(at := np.flatnonzero((a < b) & _EDGE[buf[b - 1]])):
        b[at] -= 1
    bare = a >= b
    a[bare], b[bare] = starts[bare], ends[bare]
    low = _folded(buf)
    values = spans(prefix(low, EXACT), a, b)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    letters = np.concatenate([[0], np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128))])
    number, lettered = digits[b] > digits[a], letters[b] > letters[a]
    spelled = _among(values, _NUMBER_HASHES)
    head, after = buf[a], buf[np.minimum(a + 1, len(buf) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    unit = np.zeros(len(a), bool)
    unit[1:] = (number | spelled)[:-1] & ~number[1:] & _among(values[1:], _UNIT_HASHES)
    kinds = np.select([number & lettered, number | spelled, unit, capital & ~first], [_QUANTITY, _NUMBER, _UNIT, _NAME], _PLAIN).astype(np.int8)
    return values, kinds, capital & first & (kinds == _PLAIN), bounds


@dataclass
class Items:
    """A block of benchmark items, as template tokens, and its windows in order of their hashes.

    fixed marks the first tokens of windows of placeholders only, which are known by their values; of the windows of each item,
    templates counts the others and windows all.
    """

    ids: list
    values: np.ndarray
    slots: np.ndarray
    fixed: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    item: np.ndarray
    windows: np.ndarray
    templates: np.ndarray
    sizes: list[int]


def _windows(values: np.ndarray, kinds: np.ndarray, initial: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first tokens, fixed) of the windows of `size` tokens within a row, one of each reading of their initial words.

    A window of placeholders only in the second reading, all initial words as names, is fixed: it has the hash of its values alone.
    """
    g, inside = grams(np.where(kinds > 0, _MARKS[kinds], values), bounds, size)
    n = len(g)
    plain, maybe = (np.concatenate([[0], np.cumsum(x)]) for x in (kinds == _PLAIN, initial))
    plain, maybe = plain[size : size + n] - plain[:n], maybe[size : size + n] - maybe[:n]
    fixed = plain == maybe
    if (inside & fixed).any():
        g = np.where(fixed, grams(values, bounds, size)[0], g)
    at = np.flatnonzero(inside)
    other = np.flatnonzero(inside & (maybe > 0) & ~fixed)
    if len(other):
        g = np.concatenate([g, grams(np.where(initial, _MARKS[_NAME], np.where(kinds > 0, _MARKS[kinds], values)), bounds, size)[0]])
        at, fixed = np.concatenate([at, other + n]), np.concatenate([fixed, np.zeros(n, bool)])
    return g[at] + np.uint64(size), at % max(n, 1), fixed[at]


def index(ids: list, texts: list[str], window: int = WINDOW) -> Items:
    raw = [(t or "").encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    values, kinds, initial, bounds = templates(np.frombuffer(b"".join(raw), np.uint8), off)
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(ids)), count)
    fixed = np.zeros(len(values), bool)
    parts, sizes = [], []
    for size in range(1, window + 1):  # an item of fewer tokens is a window by itself
        h, at, alone = _windows(values, kinds, initial, bounds, size)
        fits = np.minimum(count[row[at]], window) == size
        if fits.any():
            parts.append((h[fits], at[fits])), sizes.append(size)
            fixed[at[fits & alone]] = True
    h, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    each = np.unique(at)
    windows, plain = (np.bincount(row[x], minlength=len(ids)) for x in (each, each[~fixed[each]]))
    return Items(ids, values, (kinds > 0) | initial, fixed, bounds, h, at, row[at], windows, plain, sizes)


def _place(items: Items, k: int, p: np.ndarray, q: np.ndarray, values: np.ndarray, window: int, covered: float):
    """The best place of item k among its windows q met at tokens p of a document: (coverage, exact, first, last), or None."""
    length = int(items.bounds[k + 1] - items.bounds[k])
    size = min(window, length)
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    best = None
    for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p) > length) + 1):
        # of each window of the item the occurrence nearest to the common diagonal
        d = p[part] - q[part]
        middle = np.median(d)
        near = part[np.argsort(np.abs(d - middle), kind="stable")]
        _, first = np.unique(q[near], return_index=True)
        near = near[first]
        i, j = (q[near][:, None] + np.arange(size)).ravel(), (p[near][:, None] + np.arange(size)).ravel()
        same = items.values[i] == values[j]
        slot = items.slots[i]
        pairs = np.unique(np.column_stack([items.values[i][slot], values[j][slot]]), axis=0)
        consistent = len(pairs) == len(np.unique(pairs[:, 0])) if len(pairs) else True
        agree = same.reshape(len(near), size).all(1).sum() / items.windows[k]
        exact = agree >= covered
        coverage = (~items.fixed[q[near]]).sum() / items.templates[k] if items.templates[k] else 0.0
        coverage = max(coverage, agree) if exact else coverage
        if (exact or (consistent and coverage >= covered)) and (best is None or coverage > best[0]):
            best = (float(coverage), bool(exact), int(p[near].min()), int(p[near].max() + size))
    return best


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[Items]:
    """The items with a text, in blocks of about `block_windows` windows at most; an empty block if there are none."""
    ids, texts, held, any_yet = [], [], 0, False
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        ids.append(row[0]), texts.append(row[1])
        held += row[1].count(" ") + 1
        if held >= block_windows:
            yield index(ids, texts, window)
            ids, texts, held, any_yet = [], [], 0, True
    if ids or not any_yet:
        yield index(ids, texts, window)


def _leaks_of(items: Items, ids: list, column: pa.Array, window: int, covered: float) -> list[tuple]:
    """The rows of leaks() of a batch of texts; ids stand for the rows."""
    out: list[tuple] = []
    buf, off = packed(column)
    for i, j in runs(off, 1 << 20):
        values, kinds, initial, bounds = templates(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        met = []
        for size in items.sizes:
            h, at, _ = _windows(values, kinds, initial, bounds, size)
            low, high = np.searchsorted(items.hashes, h, "left"), np.searchsorted(items.hashes, h, "right")
            hit = np.flatnonzero(high > low)
            many = high[hit] - low[hit]
            k = np.repeat(low[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
            met.append((np.repeat(at[hit], many), k))
        p, k = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 2
        if not len(p):
            continue
        row, item = np.searchsorted(bounds, p, "right") - 1, items.item[k]
        order = np.lexsort([item, row])
        p, k, row, item = p[order], k[order], row[order], item[order]
        for part in np.split(np.arange(len(p)), np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1):
            r, m = row[part[0]], int(item[part[0]])
            enough = items.templates[m] or items.windows[m]
            if len(part) >= covered * enough and (place := _place(items, m, p[part], items.at[k[part]], values, window, covered)):
                out.append((ids[i + int(r)], items.ids[m], place[0], place[1], place[2] - int(bounds[r]), place[3] - int(bounds[r])))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, coverage, exact, first_word, end_word) for each document (doc_id, text) and item (item_id, text) that it holds.

    coverage is the share of the item's template windows in the best place, from word first_word to before end_word; exact tells
    whether so many windows also agree in their values. Items are joined in blocks of bounded size, each in one pass over all
    documents; the driver holds one block at a time. Null and empty texts match nothing; items of placeholders only match
    where their values are. Rows repeated are matched each by itself; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, exact boolean, first_word long, end_word long"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in _blocks(benchmark, window, block_windows):
        sent = spark.sparkContext.broadcast(items)

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(zip(*_leaks_of(sent.value, batch.column(0).to_pylist(), batch.column(1), window, covered), strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "coverage", "exact", "first_word", "end_word"])

        part = plain.mapInArrow(of, schema)
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, covered: float = COVERED, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs that leaks() finds no item in, by their texts, whatever their doc_id; all columns stay as they are."""
    names = docs.columns
    for items in _blocks(benchmark, window, block_windows):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = {r[0] for r in _leaks_of(sent.value, list(range(len(batch))), batch.column(len(names)), window, covered)}
                stay = pa.array([k not in hit for k in range(len(batch))], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(stay)

        schema = docs.schema
        docs = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("__text")).mapInArrow(of, schema)
    return docs
