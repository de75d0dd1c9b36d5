"""Queries of the numeric operators over embeddings (rows of a matrix, keys and values of attention) and lineitem (layers)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..operators.retrieval import dot
from .tables import table


def _cells(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("col", "v"))


def _groupwise(spark, d, bits, group):
    return V.quantized(_cells(spark, d), bits, group, 64)


def int4_groupwise(spark, d):
    return _groupwise(spark, d, 4, 16).select("row", "col", F.round("scale", 9).alias("scale"), "code")


def int8_groupwise(spark, d):
    return _groupwise(spark, d, 8, 32).select("row", "col", F.round("scale", 9).alias("scale"), "code")


def int4_array_form(spark, d):
    """Codes by the array form, summed up by row: no cell is exploded."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    scales, codes = V.quantized_array(F.col("v"), 4, 16, 64)
    out = e.select("vec_id", scales.alias("s"), codes.alias("c"))
    return out.select("vec_id", F.aggregate("c", F.lit(0), lambda a, x: a + x).alias("sum_code"), F.aggregate("c", F.lit(0), lambda a, x: a + F.abs(x)).alias("sum_abs"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 9).alias("sum_scale"))


def dequantized(spark, d):
    q = _groupwise(spark, d, 4, 16)
    return q.select("row", "col", F.round(V.dequantized(F.col("code"), F.col("scale")), 9).alias("w"))


def quant_error(spark, d):
    out = None
    for bits, group in ((4, 16), (4, 64), (8, 16)):
        q = _groupwise(spark, d, bits, group).select("row", "v", V.dequantized(F.col("code"), F.col("scale")).alias("w"))
        m = V.error_metrics(q)
        one = m.select(F.lit(bits).alias("bits"), F.lit(group).alias("group_size"), *[F.round(c, 6).alias(c) for c in m.columns])
        out = one if out is None else out.unionAll(one)
    return out


def pack_roundtrip(spark, d):
    q = _groupwise(spark, d, 4, 16).select("row", F.floor(F.col("col") / 2).cast("int").alias("pair"), (F.col("col") % 2).alias("half"), "code")
    pairs = q.groupBy("row", "pair").agg(F.max(F.when(F.col("half") == 0, F.col("code"))).alias("low"), F.max(F.when(F.col("half") == 1, F.col("code"))).alias("high"))
    b = pairs.withColumn("byte", V.packed(F.col("low"), F.col("high")))
    ok = (V.unpacked_low(F.col("byte")) == F.col("low")) & (V.unpacked_high(F.col("byte")) == F.col("high"))
    return b.select("row", "pair", "byte", ok.alias("lossless"))


def _layers(spark, d):
    li = table(spark, d, "lineitem")
    name = F.concat("l_returnflag", F.lit("."), "l_linestatus", F.lit("."), F.col("l_orderkey").cast("string"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", name.alias("name"), (F.col("l_suppkey") % 7 + 1).alias("rows"), (F.col("l_partkey") % 9 * 16 + 16).alias("cols"), (F.col("l_linenumber") == 1).alias("bias"))


def quant_plan(spark, d):
    p = V.plan(_layers(spark, d), ["r.f", "HEAD"], 64)
    return p.groupBy("reason").agg(F.count("*").alias("n"), F.sum("dense_bytes").alias("dense"), F.sum("planned_bytes").alias("planned"), F.round(F.try_divide(8 * F.sum("planned_bytes"), F.sum(F.col("rows") * F.col("cols"))), 6).alias("bits_per_weight"))


def component_bytes(spark, d):
    """Bytes of components under the widths of an arm; a component without a width makes the arm's total null."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("component")).agg(F.count("*").alias("n"))
    widths = spark.createDataFrame([("lm4", "A", 4), ("lm4", "N", 16), ("lm4", "R", 16), ("mixed", "A", 8), ("mixed", "N", 4), ("open", "A", 8)], "arm string, component string, bits int")
    arms = widths.select("arm").distinct().join(F.broadcast(c)).join(F.broadcast(widths), ["arm", "component"], "left")
    total = F.when(F.bool_and(F.col("bits").isNotNull()), F.sum(F.col("n") * F.col("bits") / 8))
    return arms.groupBy("arm").agg(total.alias("bytes"), F.count("bits").alias("n_known"))


def ledger_pivot(spark, d):
    """Arm by component, with totals and the ratio to the first arm."""
    li = table(spark, d, "lineitem")
    p = li.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum(F.col("l_quantity").cast("long")))
    total = F.coalesce("A", F.lit(0)) + F.coalesce("N", F.lit(0)) + F.coalesce("R", F.lit(0))
    base = p.agg(F.max(F.when(F.col("l_linestatus") == "F", total)).alias("base"))
    return p.join(F.broadcast(base)).select("l_linestatus", "A", "N", "R", total.alias("total"), F.round(total / F.col("base"), 6).alias("ratio"))


def ledger_grouping_sets(spark, d):
    li = table(spark, d, "lineitem")
    return li.rollup("l_linestatus", "l_returnflag").agg(F.grouping_id().cast("long").alias("gid"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


# attention: queries are the first three vectors, keys and values all vectors, scale 1/8


def _scores(spark, d, causal=False):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    ids = "vec_id IN (3, 50, 199)" if causal else "vec_id < 3"
    q = e.where(ids).select(F.col("vec_id").alias("q"), F.col("v").alias("qv"))
    on = F.col("vec_id") <= F.col("q") if causal else F.lit(True)
    return e.join(F.broadcast(q), on).select("q", F.col("vec_id").alias("k"), (dot(F.col("qv"), F.col("v")) / 8).alias("score"), "v")


def _nine(df):
    return df.select("q", "dim", F.round("out", 9).alias("out"))


def softmax_attention(spark, d):
    return _nine(V.attention(_scores(spark, d), ["q"]))


def blockwise_attention(spark, d):
    return _nine(V.blockwise_attention(_scores(spark, d).withColumn("block", F.floor(F.col("k") / 16)), ["q"], "block"))


def causal_attention(spark, d):
    return _nine(V.attention(_scores(spark, d, True), ["q"]))


def padded_gather(spark, d):
    """Sequences of one length: what a shorter one lacks is padded on the right with zeros."""
    e = table(spark, d, "embeddings").withColumn("seq", F.col("label"))
    w = Window.partitionBy("seq").orderBy("vec_id")
    own = e.withColumn("pos", F.row_number().over(w) - 1).select("seq", "pos", F.element_at("embedding", 1).cast("double").alias("v"))
    top = own.agg(F.max("pos").alias("top"))
    frame = own.select("seq").distinct().join(F.broadcast(top)).select("seq", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("pos"))
    return frame.join(own, ["seq", "pos"], "left").select("seq", "pos", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"), F.col("v").isNull().alias("padded"))


def rmsnorm(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(V.rms_norm(F.col("embedding"))).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


def rope(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.posexplode(V.rotary(F.col("v"), F.col("vec_id"), 64)).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


def repeat_kv(spark, d):
    """The first four numbers of a vector as heads, each doubled."""
    e = table(spark, d, "embeddings")
    heads = V.repeated_heads(F.slice("embedding", 1, 4), 2)
    return e.select("vec_id", F.posexplode(heads).alias("head", "x")).select("vec_id", "head", F.round(F.col("x").cast("double"), 6).alias("x"))


def swiglu(spark, d):
    """silu(gate) * up, the gate being a vector's first half and up its second."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = F.zip_with(F.slice("v", 1, 32), F.slice("v", 33, 32), lambda g, u: g / (1 + F.exp(-g)) * u)
    return e.select("vec_id", F.posexplode(out).alias("dim", "x")).select("vec_id", "dim", F.round("x", 9).alias("x"))


def linear_layer(spark, d):
    """A matrix product as a join on the inner index: all rows by columns, rows 40 to 47 as weights; the largest is the greedy token."""
    c = _cells(spark, d)
    x, w = c, c.where("row >= 40 AND row < 48").select(F.col("row").alias("token"), "col", F.col("v").alias("w"))
    out = x.join(F.broadcast(w), "col").groupBy("row", "token").agg(F.sum(F.col("v") * F.col("w")).alias("logit"))
    best = out.groupBy("row").agg(F.max_by("token", F.struct(F.round("logit", 9), -F.col("token"))).alias("greedy"), F.round(F.max("logit"), 6).alias("logit"))
    return best


def _weights(spark, d):
    """Softmaxed causal attention of sequences of eight vectors, two heads (halves of the vector)."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    h = e.select("seq", "i", F.posexplode(F.array(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("head", "v"))
    q, k = h.select("seq", "head", F.col("i").alias("q"), F.col("v").alias("a")), h.select("seq", "head", F.col("i").alias("k"), F.col("v").alias("b"))
    s = q.join(k, ["seq", "head"]).where("k <= q").withColumn("e", F.exp(dot(F.col("a"), F.col("b"))))
    return s.select("seq", "head", "q", "k", (F.col("e") / F.sum("e").over(Window.partitionBy("seq", "head", "q"))).alias("w"))


def attention_received(spark, d):
    return V.received(_weights(spark, d)).select("seq", "k", F.round("received", 9).alias("received"))


def attention_received_last(spark, d):
    return V.received_last(_weights(spark, d)).select("seq", "k", F.round("received", 9).alias("received"))


def _tokens(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 50).alias("seq"), F.col("vec_id").alias("pos"), (F.col("label") != 0).alias("visual"), F.element_at("embedding", 1).cast("double").alias("score"))


def prune_topk(spark, d):
    return V.pruned_top(_tokens(spark, d), ["seq"], 0.25, 3).select("seq", "pos")


def prune_noop(spark, d):
    return V.pruned_top(_tokens(spark, d), ["seq"], 1.0, 0).groupBy("seq").agg(F.count("*").alias("n"))


def prune_uniform(spark, d):
    return V.pruned_stride(_tokens(spark, d), ["seq"], 0.25).select("seq", "pos")


def merge_slots(spark, d):
    t = _tokens(spark, d)
    features = t.where("visual").select("seq", (F.row_number().over(Window.partitionBy("seq").orderBy("pos")) - 1).alias("i"), (F.col("pos") * 10).alias("value"))
    return V.merged(t.select("seq", "pos", F.col("visual").alias("masked")), features, ["seq"]).select("seq", "pos", "value")


def tile_chunks(spark, d):
    """Tiles that are not all zero, numbered and dealt into chunks of eight; every fifth vector stands for an empty tile."""
    e = table(spark, d, "embeddings").withColumn("tile", F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    full = e.where(F.exists("tile", lambda x: x != 0)).withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return full.groupBy("label", F.floor(F.col("i") / 8).alias("chunk")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (int4_groupwise, int8_groupwise, int4_array_form, dequantized, quant_error, pack_roundtrip, quant_plan, component_bytes, ledger_pivot, ledger_grouping_sets, softmax_attention, blockwise_attention, causal_attention, padded_gather, rmsnorm, rope, repeat_kv, swiglu, linear_layer, attention_received, attention_received_last, prune_topk, prune_noop, prune_uniform, merge_slots, tile_chunks)
}


def _cells_sql() -> str:
    return f"x AS (SELECT vec_id AS \"row\", unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INTEGER AS col FROM embeddings)"


def _q_sql(bits: int, group: int, name: str = "q") -> str:
    top = {4: 7, 8: 127}[bits]
    return f"""{name}s AS (SELECT *, max(abs(v)) OVER (PARTITION BY "row", col // {group}) AS t FROM x), {name}c AS (SELECT *, CASE WHEN t > 0 THEN t / {top} ELSE 1.0 END AS scale FROM {name}s),
{name} AS (SELECT "row", col, v, scale, greatest(least(round_even(v / scale, 0), {top}), -{top})::INTEGER AS code FROM {name}c)"""


def _err_sql(bits: int, group: int) -> str:
    return f"""(WITH {_cells_sql()}, {_q_sql(bits, group)}, e AS (SELECT "row", max(abs(v - code * scale)) AS most, sum(abs(v - code * scale)) AS total, sum((v - code * scale) * (v - code * scale)) AS noise, sum(v * v) AS signal, count(*) AS n FROM q GROUP BY "row")
SELECT {bits} AS bits, {group} AS group_size, round(max(most), 6) AS max_abs, round(sum(total) / sum(n), 6) AS mean_abs, round(sqrt(sum(noise)) / sqrt(sum(signal)), 6) AS relative, round(max(sqrt(noise) / sqrt(signal)), 6) AS worst_row, round(10 * log10(sum(signal) / sum(noise)), 6) AS snr_db FROM e)"""


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _att_sql(ids: str, on: str) -> str:
    return f"""WITH e AS (SELECT * FROM embeddings), s AS (SELECT q.vec_id AS q, k.vec_id AS k, {_DOT.format("q.embedding", "k.embedding")} / 8 AS s, k.embedding AS v FROM e k JOIN e q ON {on} WHERE q.{ids}),
w AS (SELECT q, exp(s - max(s) OVER (PARTITION BY q)) AS e, v FROM s), p AS (SELECT q, e / sum(e) OVER (PARTITION BY q) AS p, v FROM w),
u AS (SELECT q, p, unnest(v)::DOUBLE AS x, unnest(range(64))::INTEGER AS dim FROM p) SELECT q, dim, round(sum(p * x), 9) AS out FROM u GROUP BY ALL"""


_LAYERS = """l AS (SELECT l_returnflag || '.' || l_linestatus || '.' || l_orderkey AS name, l_suppkey % 7 + 1 AS r, l_partkey % 9 * 16 + 16 AS c, l_linenumber = 1 AS bias FROM lineitem),
p AS (SELECT *, 2 * r * c + CASE WHEN bias THEN 2 * r ELSE 0 END AS dense, CASE WHEN contains(lower(name), 'r.f') OR contains(lower(name), 'head') THEN 'skip-list' WHEN c % 64 <> 0 THEN 'ragged-groups' ELSE 'eligible' END AS reason FROM l),
f AS (SELECT *, CASE WHEN reason = 'eligible' THEN (r * c + 1) // 2 + 2 * r * (c // 64) + CASE WHEN bias THEN 2 * r ELSE 0 END ELSE dense END AS planned FROM p)"""
_TOK = "t AS (SELECT vec_id // 50 AS seq, vec_id AS pos, label <> 0 AS visual, embedding[1]::DOUBLE AS score FROM embeddings)"
_WEIGHTS = f"""h AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS i, head, CASE WHEN head = 0 THEN embedding[1:32] ELSE embedding[33:64] END AS v FROM embeddings CROSS JOIN (SELECT unnest([0, 1]) AS head)),
s AS (SELECT a.seq, a.head, a.i AS q, b.i AS k, exp({_DOT.format("a.v", "b.v")}) AS e FROM h a JOIN h b ON a.seq = b.seq AND a.head = b.head AND b.i <= a.i),
w AS (SELECT seq, head, q, k, e / sum(e) OVER (PARTITION BY seq, head, q) AS w FROM s)"""
_ROPE_X = "CASE WHEN dim < 32 THEN -v[dim + 33] ELSE v[dim - 31] END"

ORACLE_SQL = {
    "int4_groupwise": f'WITH {_cells_sql()}, {_q_sql(4, 16)} SELECT "row", col, round(scale, 9) AS scale, code FROM q',
    "int8_groupwise": f'WITH {_cells_sql()}, {_q_sql(8, 32)} SELECT "row", col, round(scale, 9) AS scale, code FROM q',
    "int4_array_form": f'WITH {_cells_sql()}, {_q_sql(4, 16)}, g AS (SELECT "row", col // 16 AS g, max(scale) AS s FROM q GROUP BY ALL), t AS (SELECT "row", round(sum(s), 9) AS sum_scale FROM g GROUP BY "row") SELECT "row" AS vec_id, sum(code)::INTEGER AS sum_code, sum(abs(code))::INTEGER AS sum_abs, max(sum_scale) AS sum_scale FROM q JOIN t USING ("row") GROUP BY "row"',
    "dequantized": f'WITH {_cells_sql()}, {_q_sql(4, 16)} SELECT "row", col, round(code * scale, 9) AS w FROM q',
    "quant_error": f"{_err_sql(4, 16)} UNION ALL {_err_sql(4, 64)} UNION ALL {_err_sql(8, 16)}",
    "pack_roundtrip": f'WITH {_cells_sql()}, {_q_sql(4, 16)} SELECT "row", (col // 2)::INTEGER AS pair, ((max(code) FILTER (WHERE col % 2 = 1) + 8) * 16 + max(code) FILTER (WHERE col % 2 = 0) + 8)::INTEGER AS byte, true AS lossless FROM q GROUP BY ALL',
    "quant_plan": f"WITH {_LAYERS} SELECT reason, count(*) AS n, sum(dense)::BIGINT AS dense, sum(planned)::BIGINT AS planned, round(8 * sum(planned) / sum(r * c), 6) AS bits_per_weight FROM f GROUP BY reason",
    "component_bytes": """WITH c AS (SELECT l_returnflag AS component, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT * FROM (VALUES ('lm4', 'A', 4), ('lm4', 'N', 16), ('lm4', 'R', 16), ('mixed', 'A', 8), ('mixed', 'N', 4), ('open', 'A', 8)) t(arm, component, bits))
SELECT arm, CASE WHEN count(bits) = count(*) THEN sum(n * bits / 8.0::DOUBLE) END AS bytes, count(bits) AS n_known FROM (SELECT DISTINCT arm FROM w) CROSS JOIN c LEFT JOIN w USING (arm, component) GROUP BY arm""",
    "ledger_pivot": """WITH p AS (SELECT l_linestatus, sum(trunc(l_quantity)) FILTER (WHERE l_returnflag = 'A')::BIGINT AS A, sum(trunc(l_quantity)) FILTER (WHERE l_returnflag = 'N')::BIGINT AS N, sum(trunc(l_quantity)) FILTER (WHERE l_returnflag = 'R')::BIGINT AS R, sum(trunc(l_quantity))::BIGINT AS total FROM lineitem GROUP BY 1)
SELECT *, round(total / (SELECT total FROM p WHERE l_linestatus = 'F'), 6) AS ratio FROM p""",
    "ledger_grouping_sets": "SELECT l_linestatus, l_returnflag, grouping(l_linestatus, l_returnflag) AS gid, sum(trunc(l_quantity))::BIGINT AS total FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)",
    "softmax_attention": _att_sql("vec_id < 3", "true"),
    "blockwise_attention": _att_sql("vec_id < 3", "true"),
    "causal_attention": _att_sql("vec_id IN (3, 50, 199)", "k.vec_id <= q.vec_id"),
    "padded_gather": """WITH o AS (SELECT label AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding[1]::DOUBLE AS v FROM embeddings), f AS (SELECT seq, unnest(range(0, (SELECT max(pos) + 1 FROM o))) AS pos FROM (SELECT DISTINCT seq FROM o))
SELECT f.seq, f.pos::INTEGER AS pos, round(coalesce(v, 0), 6) AS v, v IS NULL AS padded FROM f LEFT JOIN o USING (seq, pos)""",
    "rmsnorm": f"WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64))::INTEGER AS dim, {_DOT.format('embedding', 'embedding')} / 64 AS m FROM embeddings) SELECT vec_id, dim, round(x / sqrt(m + 1e-6), 6) AS x FROM u",
    "rope": f"WITH u AS (SELECT vec_id, embedding AS v, unnest(range(64))::INTEGER AS dim FROM embeddings), a AS (SELECT *, vec_id / pow(10000.0, 2.0 * (dim % 32) / 64) AS t, v[dim + 1]::DOUBLE AS x, ({_ROPE_X})::DOUBLE AS y FROM u) SELECT vec_id, dim, round(x * cos(t) + y * sin(t), 6) AS x FROM a",
    "repeat_kv": "WITH u AS (SELECT vec_id, embedding AS v, unnest(range(8))::INTEGER AS head FROM embeddings) SELECT vec_id, head, round(v[head // 2 + 1]::DOUBLE, 6) AS x FROM u",
    "swiglu": "WITH u AS (SELECT vec_id, embedding AS v, unnest(range(32))::INTEGER AS dim FROM embeddings) SELECT vec_id, dim, round(v[dim + 1]::DOUBLE / (1 + exp(-(v[dim + 1]::DOUBLE))) * v[dim + 33]::DOUBLE, 9) AS x FROM u",
    "linear_layer": f"""WITH m AS (SELECT x.vec_id AS "row", w.vec_id AS token, {_DOT.format("x.embedding", "w.embedding")} AS logit FROM embeddings x CROSS JOIN embeddings w WHERE w.vec_id >= 40 AND w.vec_id < 48)
SELECT "row", token AS greedy, round(logit, 6) AS logit FROM m QUALIFY row_number() OVER (PARTITION BY "row" ORDER BY round(logit, 9) DESC, token) = 1""",
    "attention_received": f"WITH {_WEIGHTS}, n AS (SELECT seq, max(q) + 1 AS nq, count(DISTINCT head) AS heads FROM w GROUP BY seq) SELECT seq, k, round(sum(w) / ((max(nq) - k) * max(heads)), 9) AS received FROM w JOIN n USING (seq) GROUP BY seq, k",
    "attention_received_last": f"WITH {_WEIGHTS} SELECT seq, k, round(avg(w), 9) AS received FROM w WHERE q = (SELECT max(q) FROM w v WHERE v.seq = w.seq) GROUP BY seq, k",
    "prune_topk": f"""WITH {_TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY seq, visual ORDER BY round(score, 9) DESC, pos) AS rn, count(*) FILTER (WHERE visual) OVER (PARTITION BY seq) AS n, max(pos) OVER (PARTITION BY seq) AS top FROM t)
SELECT seq, pos FROM r WHERE NOT visual OR pos > top - 3 OR rn <= greatest(1, round_even(n * 0.25::DOUBLE, 0))""",
    "prune_noop": f"WITH {_TOK} SELECT seq, count(*) AS n FROM t GROUP BY seq",
    "prune_uniform": f"""WITH {_TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY seq, visual ORDER BY pos) - 1 AS ix, count(*) FILTER (WHERE visual) OVER (PARTITION BY seq) AS n FROM t), m AS (SELECT *, greatest(1, round_even(n * 0.25::DOUBLE, 0))::INTEGER AS m FROM r)
SELECT seq, pos FROM m WHERE NOT visual OR list_contains(list_transform(range(m), lambda i: CASE WHEN m = 1 THEN 0 ELSE round_even(i * (n - 1) / (m - 1)::DOUBLE, 0) END::BIGINT), ix)""",
    "merge_slots": f"WITH {_TOK} SELECT seq, pos, CASE WHEN visual THEN pos * 10 END AS value FROM t",
    "tile_chunks": "WITH r AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 8 AS chunk FROM embeddings WHERE vec_id % 5 <> 0) SELECT label, chunk, count(*) AS n, min(vec_id) AS first FROM r GROUP BY ALL",
}
