"""Numeric operators on arrays and long tables: quantisation, attention, positions, pruning of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest code of a width.
QMAX = {4: 7, 8: 127}


def quantized(cells: DataFrame, bits: int, group: int, width: int) -> DataFrame:
    """cells (row, col, v) with scale and code: symmetric, one scale for each group of `group` columns of a row.

    The scale is the largest magnitude by the largest code, 1 for an all-zero group; codes round half to even. A width that
    the group does not divide is an error.
    """
    if bits not in QMAX:
        raise ValueError("bits must be 4 or 8")
    if width % group:
        raise ValueError("the group must divide the width")
    q = QMAX[bits]
    top = F.max(F.abs("v")).over(Window.partitionBy("row", F.floor(F.col("col") / group)))
    scaled = cells.withColumn("scale", F.when(top > 0, top / q).otherwise(F.lit(1.0)))
    return scaled.withColumn("code", F.greatest(F.least(F.rint(F.col("v") / F.col("scale")), F.lit(float(q))), F.lit(float(-q))).cast("int"))


def quantized_array(v: Column, bits: int, group: int, width: int) -> tuple[Column, Column]:
    """(scales, codes) of an array of doubles, as quantized() on its cells but without exploding them."""
    if bits not in QMAX or width % group:
        raise ValueError("bits must be 4 or 8, and the group must divide the width")
    q = QMAX[bits]
    tops = F.transform(F.sequence(F.lit(0), F.lit(width // group - 1)), lambda g: F.array_max(F.transform(F.slice(v, g * group + 1, group), F.abs)))
    scales = F.transform(tops, lambda t: F.when(t > 0, t / q).otherwise(F.lit(1.0)))
    codes = F.transform(v, lambda x, i: F.greatest(F.least(F.rint(x / F.element_at(scales, (F.floor(i / group) + 1).cast("int"))), F.lit(float(q))), F.lit(float(-q))).cast("int"))
    return scales, codes


def dequantized(code: Column, scale: Column) -> Column:
    return code * scale


def packed(low: Column, high: Column) -> Column:
    """Two codes of four bits in one byte, each 8 higher; the even column is the low half."""
    return F.shiftleft(high + 8, 4).bitwiseOR(low + 8)


def unpacked_low(byte: Column) -> Column:
    return byte.bitwiseAND(F.lit(15)) - 8


def unpacked_high(byte: Column) -> Column:
    return F.shiftright(byte, 4).bitwiseAND(F.lit(15)) - 8


def error_metrics(cells: DataFrame) -> DataFrame:
    """Largest, mean and relative error, the worst row's, and the signal-to-noise ratio in dB, of cells (row, v, w)."""
    d = F.col("v") - F.col("w")
    rows = cells.groupBy("row").agg(F.max(F.abs(d)).alias("most"), F.sum(F.abs(d)).alias("total"), F.sum(d * d).alias("noise"), F.sum(F.col("v") * F.col("v")).alias("signal"), F.count("*").alias("n"))
    relative = lambda noise, signal: F.sqrt(noise) / F.greatest(F.sqrt(signal), F.lit(1e-12))
    return rows.agg(
        F.max("most").alias("max_abs"),
        (F.sum("total") / F.sum("n")).alias("mean_abs"),
        relative(F.sum("noise"), F.sum("signal")).alias("relative"),
        F.max(relative(F.col("noise"), F.col("signal"))).alias("worst_row"),
        (10 * F.log10(F.greatest(F.sum("signal"), F.lit(1e-20)) / F.greatest(F.sum("noise"), F.lit(1e-20)))).alias("snr_db"),
    )


def layer_bytes(rows: Column, cols: Column, group: int, bias: Column) -> Column:
    """Bytes of a layer in four-bit codes: halves, a two-byte scale for each group of a row, a two-byte bias."""
    return (F.floor((rows * cols + 1) / 2) + 2 * rows * F.floor(cols / group) + F.when(bias, 2 * rows).otherwise(0)).cast("long")


def plan(layers: DataFrame, skip: list[str], group: int) -> DataFrame:
    """How each layer (name, rows, cols, bias) is stored and what it costs; a listed name is skipped before a ragged width is."""
    from ..functions.scalars import name_matches

    dense = 2 * F.col("rows") * F.col("cols") + F.when(F.col("bias"), 2 * F.col("rows")).otherwise(0)
    reason = F.when(name_matches(F.col("name"), skip), "skip-list").when(F.col("cols") % group != 0, "ragged-groups").otherwise("eligible")
    out = layers.withColumn("dense_bytes", dense.cast("long")).withColumn("reason", reason)
    return out.withColumn("planned_bytes", F.when(F.col("reason") == "eligible", layer_bytes(F.col("rows"), F.col("cols"), group, F.col("bias"))).otherwise(F.col("dense_bytes")))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(v)
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(mean + eps))


def rotary(v: Column, position: Column, width: int, theta: float = 10000.0) -> Column:
    """Rotary positions: the halves of v are the coordinates of width / 2 planes, turned by position * theta^(-2i / width)."""
    half = width // 2
    angle = lambda i: position / F.pow(F.lit(theta), 2.0 * (i % half) / width)
    turned = lambda i: F.when(i < half, -F.element_at(v, (i + half + 1).cast("int"))).otherwise(F.element_at(v, (i - half + 1).cast("int")))
    return F.transform(v, lambda x, i: x * F.cos(angle(i)) + F.when(i < half, turned(F.least(i, F.lit(half - 1)))).otherwise(turned(F.greatest(i, F.lit(half)))) * F.sin(angle(i)))


def repeated_heads(heads: Column, times: int) -> Column:
    """Each head `times` over, side by side: h0 h0 h1 h1."""
    return F.flatten(F.transform(heads, lambda h: F.array_repeat(h, times)))


def attention(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, dim, out): softmax of `score` over the keys of each query, then the weighted sum of their values `v`."""
    w = Window.partitionBy(*by)
    p = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    p = p.withColumn("p", F.col("e") / F.sum("e").over(w))
    return p.select(*by, "p", F.posexplode("v").alias("dim", "x")).groupBy(*by, "dim").agg(F.sum(F.col("p") * F.col("x")).alias("out"))


def blockwise_attention(scores: DataFrame, by: list[str], block: str) -> DataFrame:
    """The same from the states of blocks: each block's maximum, sum and weighted values, rescaled to the common maximum."""
    w = Window.partitionBy(*by, block)
    local = scores.withColumn("m", F.max("score").over(w)).withColumn("e", F.exp(F.col("score") - F.col("m")))
    parts = local.select(*by, block, "m", "e", F.posexplode("v").alias("dim", "x")).groupBy(*by, block, "dim").agg(F.max("m").alias("m"), F.sum("e").alias("l"), F.sum(F.col("e") * F.col("x")).alias("acc"))
    top = F.max("m").over(Window.partitionBy(*by, "dim"))
    scaled = parts.withColumn("k", F.exp(F.col("m") - top))
    return scaled.groupBy(*by, "dim").agg((F.sum(F.col("k") * F.col("acc")) / F.sum(F.col("k") * F.col("l"))).alias("out"))


def received(weights: DataFrame) -> DataFrame:
    """Attention that each key (seq, head, q, k, w) receives: its sum by the queries that see it and by heads.

    A key j of S is seen by S - j queries where there are as many queries as keys, else by all of them.
    """
    size = weights.groupBy("seq").agg(F.count_distinct("head").alias("heads"), (F.max("q") + 1).alias("nq"), (F.max("k") + 1).alias("nk"))
    per = weights.groupBy("seq", "k").agg(F.sum("w").alias("total")).join(size, "seq")
    eligible = F.when(F.col("nq") == F.col("nk"), F.col("nk") - F.col("k")).otherwise(F.col("nq"))
    return per.select("seq", "k", (F.col("total") / (eligible * F.col("heads"))).alias("received"))


def received_last(weights: DataFrame) -> DataFrame:
    """Attention that each key receives from the last query, averaged over heads."""
    last = weights.groupBy("seq").agg(F.max("q").alias("q"))
    return weights.join(last, ["seq", "q"]).groupBy("seq", "k").agg(F.avg("w").alias("received"))


def pruned_top(tokens: DataFrame, by: list[str], keep: float, protect: int) -> DataFrame:
    """Tokens (pos, visual, score) that stay: all text, the last `protect`, and the best max(1, round(n * keep)) visual ones.

    Half rounds to even; ties stay by position; a keep of 1 keeps everything.
    """
    w = Window.partitionBy(*by)
    n = F.count_if("visual").over(w)
    rank = F.row_number().over(w.orderBy(F.when(F.col("visual"), 0).otherwise(1), F.round("score", 9).desc(), "pos"))
    room = F.greatest(F.lit(1), F.bround(n * F.lit(float(keep)), 0))
    marked = tokens.withColumn("rank", rank).withColumn("room", room).withColumn("last", F.max("pos").over(w))
    return marked.where(~F.col("visual") | (F.col("pos") > F.col("last") - protect) | (F.col("rank") <= F.col("room")) | F.lit(keep >= 1)).select(*tokens.columns)


def pruned_stride(tokens: DataFrame, by: list[str], keep: float) -> DataFrame:
    """Tokens that stay: all text, and visual ones at even steps from the first to the last."""
    w = Window.partitionBy(*by)
    n = F.count_if("visual").over(w)
    at = F.row_number().over(w.orderBy(F.when(F.col("visual"), 0).otherwise(1), "pos")) - 1
    m = F.greatest(F.lit(1), F.bround(n * F.lit(float(keep)), 0)).cast("int")
    marked = tokens.withColumn("n", n).withColumn("at", at).withColumn("m", m)
    picks = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.when(F.col("m") == 1, F.lit(0.0)).otherwise(F.rint(i * (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1)))))
    return marked.where(~F.col("visual") | F.array_contains(picks, F.col("at").cast("double"))).select(*tokens.columns)


def merged(slots: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """Features (i, value) into the masked slots (pos, masked) of each group, in order; unequal numbers are an error."""
    w = Window.partitionBy(*by)
    placed = slots.withColumn("i", F.when(F.col("masked"), F.sum(F.when(F.col("masked"), 1).otherwise(0)).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1))
    counts = slots.groupBy(*by).agg(F.count_if("masked").alias("n_slots")).join(features.groupBy(*by).agg(F.count("*").alias("n_features")), by, "left")
    checked = counts.select(*by, F.assert_true(F.col("n_slots") == F.coalesce("n_features", F.lit(0)), F.lit("slots and features differ in number")).alias("ok"))
    return placed.join(features, [*by, "i"], "left").join(checked, by).where("ok IS NULL").drop("ok")
