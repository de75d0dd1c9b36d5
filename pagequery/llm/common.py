"""What the operators of this subpackage share: reliable cuts of the lineage and views of Arrow text."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace that separates words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


#: Has Spark remove the shuffle files of a plan as soon as it has run.
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, drop: bool = False) -> DataFrame:
    """Compute df once and keep it in the shared checkpoint folder, so a lost executor costs a read, not a recomputation.

    The folder is the session's spark.checkpoint.dir; only where that is unset (tests on one machine) is a temporary
    folder used. With `drop`, the plan's shuffle files go when it is kept, not when the driver next finds them useless.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pagequery-"))
    if not drop:
        return df.checkpoint(eager=True)
    was = conf.get(_DROP, "false")
    conf.set(_DROP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own takes the setting up
    finally:
        conf.set(_DROP, was)


def tidy(spark: SparkSession) -> None:
    """Have the driver look for plans that cuts have made useless, so that Spark's cleaner drops their shuffle files now and not when its heap fills up.

    What the heap gives back by that stays small, and what the compiler and the network had from the C library is given back too, where the JVM can.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        lang, gateway = jvm.java.lang, spark.sparkContext._gateway
        server = lang.Class.forName("javax.management.MBeanServer")  # by its interface: the class itself is not open
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        of = gateway.new_array(lang.Object, 4)
        of[0], of[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), of)
    except Py4JError:  # another JVM, or one before 17.0.9
        pass


def remainder(column: Column | str, of: int) -> Column:
    """crc32 of the value as text, modulo `of`: the fixed folds of the learned operators (null: null)."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % of


def with_fields(schema, *more: tuple[str, str]) -> str:
    """DDL of a schema and further fields, those replacing fields of the same name."""
    taken = {name.lower() for name, _ in more}
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name.lower() not in taken] + [f"`{n}` {t}" for n, t in more])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on each uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = both
    return _powers[0], _powers[1]


#: A 64-bit value for each byte; in the second, A-Z have those of a-z.
EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]


def prefix(buf: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    """Sums of a rolling polynomial: spans() gives from them the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * _STEP)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII whitespace, and the n + 1 offsets of each row's words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = SPACE[buf]
    edge = np.empty(len(buf), bool)
    full = offsets[1:] > offsets[:-1]
    edge[0] = True
    edge[1:] = blank[:-1]
    edge[offsets[:-1][full]] = True
    starts = np.flatnonzero(edge & ~blank)
    edge[-1] = True
    edge[:-1] = blank[1:]
    edge[offsets[1:][full] - 1] = True
    ends = np.flatnonzero(edge & ~blank) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` items from each position on, and whether they lie within one row."""
    n = max(len(hashes) - size + 1, 0)
    g = hashes[:n].copy()
    for j in range(1, size):
        g = mix(g * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + n])
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    return g, row_end[:n] - np.arange(n) >= size


#: Bits of a sieve; of fixed size whatever it holds, so that it can be sent to every task.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, column: str, parts: int = 4):
    """A broadcast of one bit for each long of a column, by hash: sifted() drops most of what is not among them, and nothing that is."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS // 8, np.uint8)
        for batch in batches:
            at = _place(batch.column(0).to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(SIEVE_BITS // 8, np.uint8)
    for row in keys.select(column).repartition(parts).mapInArrow(marked, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(total)


def _place(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - SIEVE_BITS.bit_length() + 1)).astype(np.int64)


def sifted(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be among those of a sieve."""
    at = _place(h)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1
