"""Queries of the block accounting, over documents (tokens), lineitem (retrieved lists) and events (pools)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks as B
from ..operators.retrieval import spread
from .tables import REQUESTS_SQL, requests, table

#: Bytes of keys and values of a token in the larger model; sizes of a sweep.
PER_TOKEN = 196_608
SIZES = [1, 8, 16, 32, 64]


def _lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))


def _sizes(spark):
    return F.broadcast(spark.createDataFrame([(s,) for s in SIZES], "block_size long"))


def blocks_needed_sweep(spark, d):
    return _lengths(spark, d).join(_sizes(spark)).groupBy("block_size").agg(F.sum(S.ceil_div(F.col("n"), F.col("block_size"))).alias("blocks"))


def positions(spark, d):
    """Block and offset of each text's last position, and the slack of its last block."""
    n, size = F.col("n"), 16
    docs = _lengths(spark, d).where("n > 0")
    return docs.select("doc_id", S.block_of(n - 1, size).alias("block"), S.offset_in(n - 1, size).alias("at"), (S.ceil_div(n, size) * size - n).alias("slack"))


def fragmentation(spark, d):
    out = B.fragmentation(_lengths(spark, d).join(_sizes(spark)), F.col("block_size"), ["block_size"])
    return out.select("block_size", "blocks", "wasted", F.round("waste", 6).alias("waste"))


def padding_waste(spark, d):
    return B.padding_waste(_lengths(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 8)), ["batch"])


def _blocks(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", B.full_blocks(F.split("text", " "), 4).alias("blocks"))


def chain_hash(spark, d):
    """How many blocks a text has, and the chain hashes of its first and second one."""
    h = _blocks(spark, d).select("doc_id", B.chain_hashes(F.col("blocks")).alias("h"))
    return h.select("doc_id", F.size("h").alias("n"), F.try_element_at("h", F.lit(1)).alias("h1"), F.try_element_at("h", F.lit(2)).alias("h2"))


def prefix_hits(spark, d):
    return B.prefix_hits(_blocks(spark, d).select("doc_id", B.chain_hashes(F.col("blocks")).alias("hashes")), "doc_id")


def _lists(spark, d):
    """Retrieved lists: parts of an order in the order of its lines, or sorted by part (canonical); cost by part size."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 16).cast("long").alias("cost"))
    line, part_first = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "cost"], ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "cost"]
    orders = li.join(part, "l_partkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*line))).alias("x"))
    both = orders.withColumn("y", F.array_sort(F.transform("x", lambda r: F.struct(*[r[c].alias(c) for c in part_first]))))
    form = lambda canonical, c: F.struct(F.lit(canonical).alias("canonical"), F.col(f"{c}.l_partkey").alias("docs"), F.col(f"{c}.cost").alias("costs"))
    return both.select(F.col("l_orderkey").alias("seq"), F.explode(F.array(form(False, "x"), form(True, "y"))).alias("f")).select("seq", "f.*")


def prefix_sharing(spark, d):
    out = B.sequence_sharing(_lists(spark, d), F.col("block_size"), ["canonical"], _sizes(spark))
    return out.select("block_size", "canonical", "n_sequences", "total_tokens", "paged_blocks", "shared_blocks", F.round("saving_pct", 6).alias("saving_pct"), F.round("mean_prefix_docs", 6).alias("mean_prefix_docs"))


_SPECS = [("2.2B", 24, 2048, 32, 32, 64, 384, 14, 3), ("256M", 30, 576, 9, 3, 64, 512, 16, 4)]


def model_dimensions(spark, d):
    """Bytes of a token, tokens of a tile, heads of a group, of the two models that sizes are given for."""
    m = spark.createDataFrame(_SPECS, "model string, layers long, hidden long, heads long, kv_heads long, head_dim long, image long, patch long, scale long")
    return m.select("model", S.kv_bytes_per_token(F.col("layers"), F.col("kv_heads"), F.col("head_dim")).alias("per_token"), S.visual_tokens_per_tile(F.col("image"), F.col("patch"), F.col("scale")).alias("per_tile"), S.heads_per_group(F.col("heads"), F.col("kv_heads")).alias("n_rep"), (F.col("heads") != F.col("kv_heads")).alias("uses_gqa"))


def image_tokens(spark, d):
    """Visual tokens of documents as images of doc_id % 5 + 1 tiles and a thumbnail."""
    return table(spark, d, "documents").select("doc_id", (S.visual_tokens_per_tile(F.lit(384), F.lit(14), F.lit(3)) * (F.col("doc_id") % 5 + 2)).alias("n_visual"))


def visual_share(spark, d):
    """The share of visual tokens in each prompt, summed up by the gate's median."""
    docs = image_tokens(spark, d).join(_lengths(spark, d), "doc_id")
    share = F.col("n_visual") / (F.col("n_visual") + F.col("n"))
    return docs.groupBy("source").agg(F.round(F.percentile(share, F.lit(0.5)), 6).alias("median"), (F.round(F.percentile(share, F.lit(0.5)), 6) >= 0.5).alias("passes"))


def pool_plan(spark, d):
    """Pools of a range of budgets: blocks, longest prompt, and requests (documents) that fit."""
    budgets = spark.range(5).select((F.lit(4 << 30) + F.col("id") * (1 << 28)).alias("budget"))
    n = B.pool_blocks(F.col("budget"), F.lit(2_465_137_152), F.lit(347_734_016), F.lit(16), F.lit(PER_TOKEN))
    plan = budgets.select("budget", n.alias("blocks")).withColumn("max_prompt", B.max_prompt(F.col("blocks"), 4, F.lit(16)))
    met = _lengths(spark, d).join(F.broadcast(plan))
    return met.groupBy("budget", "blocks", "max_prompt").agg(F.count_if(F.col("n") <= F.col("max_prompt")).alias("admissible"))


def concurrency(spark, d):
    """How many sequences fit a budget when each reserves the whole context, and when it has blocks for its tokens."""
    per = _lengths(spark, d).groupBy("source").agg(F.avg("n").cast("long").alias("n"))
    budget, naive = int(2.5 * (1 << 30)), 8192 * PER_TOKEN
    paged = F.floor(F.lit(budget) / (S.ceil_div(F.col("n"), 16) * 16 * PER_TOKEN))
    return per.select("source", F.lit(budget // naive).cast("long").alias("naive"), paged.cast("long").alias("paged"))


def budget_ledger(spark, d):
    """Bytes by component with the verdict on a budget, the largest first."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("component")).agg(F.sum(F.col("l_quantity").cast("long") * 1000).alias("bytes"))
    total = li.agg(F.sum("bytes").alias("total"))
    return li.join(F.broadcast(total)).select("component", "bytes", F.round(S.mib(F.col("bytes")), 6).alias("mib"), (F.col("total") <= 2_000_000_000).alias("within"), (F.lit(2_000_000_000) - F.col("total")).alias("headroom"))


def kv_reclaimed(spark, d):
    docs = image_tokens(spark, d).join(F.broadcast(spark.createDataFrame([(0.75,), (0.5,), (0.25,), (0.125,)], "keep double")))
    got = B.reclaimed_bytes(F.col("n_visual"), F.col("keep"), F.lit(24), F.lit(2), F.lit(PER_TOKEN // 24))
    return docs.groupBy("keep").agg(F.sum(got).alias("reclaimed"))


def layer_routing(spark, d):
    layers = spark.range(24).select(F.col("id").alias("layer"), F.when(F.col("id") < 2, "full").otherwise("pruned").alias("pool"))
    return layers.groupBy("pool").agg(F.count("*").alias("n"))


def victims(spark, d):
    """Requests of a server give up their blocks, newest first, until forty are free."""
    r = requests(spark, d).select("server", "event_id", S.ceil_div(F.col("prompt"), 64).alias("blocks")).withColumn("need", F.lit(40))
    return B.victims(r, "need", ["server"], "event_id").select("server", "event_id", "blocks")


def preempt_policies(spark, d):
    """Counters of the victims under each policy: blocks swapped out, tokens to compute again, requests refused."""
    v = victims(spark, d).withColumn("policy", F.element_at(F.array(F.lit("swap"), F.lit("recompute"), F.lit("reject")), (F.col("server") % 3 + 1).cast("int")))
    return v.groupBy("policy").agg(F.count("*").alias("n"), F.sum(F.when(F.col("policy") == "swap", F.col("blocks")).otherwise(0)).alias("swapped"), F.sum(F.when(F.col("policy") == "recompute", F.col("blocks") * 64).otherwise(0)).alias("recomputed"))


def _ops(spark, d):
    r = requests(spark, d).select((F.col("prompt") / 64).cast("long").alias("block"), "event_id")
    opened = r.select("block", (F.col("event_id") * 2).alias("op"), F.lit(1).alias("delta"))
    return opened.unionAll(r.select("block", (F.col("event_id") * 2 + 41).alias("op"), F.lit(-1).alias("delta")))


def refcount_ledger(spark, d):
    out = B.ledger(_ops(spark, d), ["block"], "op", "delta")
    return out.groupBy("block").agg(F.max("refs").alias("most"), F.count_if("broken").alias("n_broken"), F.sum("delta").alias("left"))


def duplicate_free_blocks(spark, d):
    """Blocks that a pool's free list holds twice."""
    r = requests(spark, d).select("session", (F.col("prompt") / 64).cast("long").alias("block"))
    return r.groupBy("session").agg((F.count("*") - F.count_distinct("block")).alias("n_duplicates"))


def block_gather(spark, d):
    """Logical positions of a sequence through its block map; the tail beyond its tokens is not read."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    mapped = docs.select("doc_id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / 16), F.lit(1)).cast("int") - 1), lambda i: (i * 7 + F.col("doc_id")) % 101)).alias("logical", "physical"))
    slots = mapped.select("doc_id", "n", "logical", "physical", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot"))
    live = slots.where(F.col("logical") * 16 + F.col("slot") < F.col("n"))
    return live.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("physical") * 16 + F.col("slot")).cast("long")).alias("checksum"))


def prefill_chunks(spark, d):
    """Chunks of a prompt's prefill, and the step of its first token."""
    return requests(spark, d).select("event_id", S.ceil_div(F.col("prompt"), 512).alias("n_chunks"), F.greatest(S.ceil_div(F.col("prompt"), 512) - 1, F.lit(0)).alias("first_token_step"))


def stop_positions(spark, d):
    """Where generation stops: at the first end token (a word that ends in a full stop), or after 16 words."""
    words = F.slice(F.split("text", " "), 1, 16)
    at = F.array_position(F.transform(words, lambda w: F.endswith(w, F.lit("."))), True)
    return table(spark, d, "documents").select("doc_id", F.when(at > 0, at).otherwise(F.size(words)).cast("long").alias("n_tokens"), F.when(at > 0, "stop").otherwise("length").alias("reason"))


QUERIES = {
    f.__name__: f
    for f in (blocks_needed_sweep, positions, fragmentation, padding_waste, chain_hash, prefix_hits, prefix_sharing, model_dimensions, image_tokens, visual_share, pool_plan, concurrency, budget_ledger, kv_reclaimed, layer_routing, victims, preempt_policies, refcount_ledger, duplicate_free_blocks, block_gather, prefill_chunks, stop_positions)
}

_SZ = "z AS (SELECT unnest([1, 8, 16, 32, 64])::BIGINT AS block_size)"
_N = "n AS (SELECT doc_id, source, length(text) AS n FROM documents)"
_IMG = "im AS (SELECT doc_id, 81 * (doc_id % 5 + 2) AS n_visual FROM documents)"
_W = "w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), b AS (SELECT doc_id, len(t) // 4 AS n, t FROM w)"
_H1 = "substring(sha256('root|' || array_to_string(t[1:4], ',')), 1, 32)"
_VICTIMS = f"""WITH r AS ({REQUESTS_SQL}), h AS (SELECT server, event_id, (prompt + 63) // 64 AS blocks, sum((prompt + 63) // 64) OVER (PARTITION BY server ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS f FROM r),
v AS (SELECT server, event_id, blocks FROM h WHERE f - blocks < 40)"""
_LISTS = """l AS (SELECT l_orderkey AS seq, l_partkey AS doc, p_size * 16 AS cost, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey),
li AS (SELECT false AS canonical, seq, doc, cost, row_number() OVER (PARTITION BY seq ORDER BY l_linenumber, doc, l_suppkey, l_extendedprice) AS i FROM l
UNION ALL SELECT true, seq, doc, cost, row_number() OVER (PARTITION BY seq ORDER BY doc, l_suppkey, l_linenumber, l_extendedprice) FROM l),
le AS (SELECT canonical, seq, doc AS lead FROM li WHERE i = 1), lo AS (SELECT li.*, lead FROM li JOIN le USING (canonical, seq)),
me AS (SELECT canonical, lead, count(*) AS members FROM le GROUP BY ALL),
br AS (SELECT canonical, lead, min(i) AS stop FROM (SELECT canonical, lead, i, count(*) AS have, count(DISTINCT doc) AS kinds FROM lo GROUP BY ALL) JOIN me USING (canonical, lead) WHERE kinds > 1 OR have < members GROUP BY ALL),
sq AS (SELECT canonical, lead, seq, sum(cost) AS total, coalesce(sum(cost) FILTER (WHERE i < coalesce(stop, 1e9)), 0) AS prefix, count(*) FILTER (WHERE i < coalesce(stop, 1e9)) AS docs FROM lo LEFT JOIN br USING (canonical, lead) GROUP BY ALL),
gr AS (SELECT block_size, canonical, lead, sum((total + block_size - 1) // block_size) AS paged, (max(prefix) + block_size - 1) // block_size + sum((total - prefix + block_size - 1) // block_size) AS kept, sum(total) AS tokens, sum(docs) AS docs, count(*) AS n FROM sq CROSS JOIN z GROUP BY block_size, canonical, lead)"""

ORACLE_SQL = {
    "blocks_needed_sweep": f"WITH {_N}, {_SZ} SELECT block_size, sum((n + block_size - 1) // block_size)::BIGINT AS blocks FROM n CROSS JOIN z GROUP BY block_size",
    "positions": f"WITH {_N} SELECT doc_id, (n - 1) // 16 AS block, (n - 1) % 16 AS at, (n + 15) // 16 * 16 - n AS slack FROM n WHERE n > 0",
    "fragmentation": f"WITH {_N}, {_SZ}, s AS (SELECT block_size, sum((n + block_size - 1) // block_size)::BIGINT AS blocks, sum(n)::BIGINT AS n FROM n CROSS JOIN z GROUP BY block_size) SELECT block_size, blocks, blocks * block_size - n AS wasted, round((blocks * block_size - n) / (blocks * block_size), 6) AS waste FROM s",
    "padding_waste": f"WITH {_N} SELECT doc_id // 8 AS batch, (max(n) * count(*) - sum(n))::BIGINT AS padding, min(n) AS shortest, max(n) AS longest FROM n GROUP BY 1",
    "chain_hash": f"WITH {_W} SELECT doc_id, n::INTEGER AS n, CASE WHEN n >= 1 THEN {_H1} END AS h1, CASE WHEN n >= 2 THEN substring(sha256({_H1} || '|' || array_to_string(t[5:8], ',')), 1, 32) END AS h2 FROM b",
    "prefix_hits": f"""WITH {_W}, p AS (SELECT doc_id, unnest(list_transform(range(1, n + 1), lambda i: md5(array_to_string(t[1:(4 * i)], ',')))) AS p FROM b), f AS (SELECT p, min(doc_id) AS first FROM p GROUP BY p), c AS (SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE first < doc_id) AS n_hit FROM p JOIN f USING (p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_hit, 0) AS n_hit FROM documents LEFT JOIN c USING (doc_id)""",
    "prefix_sharing": f"WITH {_SZ}, {_LISTS} SELECT block_size, canonical, sum(n)::BIGINT AS n_sequences, sum(tokens)::BIGINT AS total_tokens, sum(paged)::BIGINT AS paged_blocks, sum(kept)::BIGINT AS shared_blocks, round(100 * (sum(paged) - sum(kept)) / sum(paged), 6) AS saving_pct, round(sum(docs) / sum(n), 6) AS mean_prefix_docs FROM gr GROUP BY ALL",
    "model_dimensions": "SELECT * FROM (VALUES ('2.2B', 196608::BIGINT, 81::BIGINT, 1::BIGINT, false), ('256M', 23040::BIGINT, 64::BIGINT, 3::BIGINT, true)) t(model, per_token, per_tile, n_rep, uses_gqa)",
    "image_tokens": f"WITH {_IMG} SELECT * FROM im",
    "visual_share": f"WITH {_IMG}, {_N}, s AS (SELECT source, quantile_cont(n_visual / (n_visual + n), 0.5) AS m FROM im JOIN n USING (doc_id) GROUP BY source) SELECT source, round(m, 6) AS median, round(m, 6) >= 0.5 AS passes FROM s",
    "pool_plan": f"""WITH {_N}, p AS (SELECT 4294967296 + i * 268435456 AS budget, (4294967296 + i * 268435456 - 2465137152 - 347734016) // (16 * 196608) AS blocks FROM (SELECT unnest(range(5)) AS i))
SELECT budget, blocks, (blocks - 4) * 16 AS max_prompt, count(*) FILTER (WHERE n <= (blocks - 4) * 16) AS admissible FROM n CROSS JOIN p GROUP BY ALL""",
    "concurrency": f"WITH {_N}, m AS (SELECT source, trunc(avg(n))::BIGINT AS n FROM n GROUP BY source) SELECT source, 2684354560 // (8192 * 196608) AS naive, 2684354560 // ((n + 15) // 16 * 16 * 196608) AS paged FROM m",
    "budget_ledger": "WITH c AS (SELECT l_returnflag AS component, sum(trunc(l_quantity)::BIGINT * 1000)::BIGINT AS bytes FROM lineitem GROUP BY 1) SELECT component, bytes, round(bytes / 1048576, 6) AS mib, (SELECT sum(bytes) FROM c) <= 2000000000 AS within, (2000000000 - (SELECT sum(bytes) FROM c))::BIGINT AS headroom FROM c",
    "kv_reclaimed": f"WITH {_IMG} SELECT keep, sum(round_even(n_visual * (1 - keep), 0)::BIGINT * 22 * 8192)::BIGINT AS reclaimed FROM im CROSS JOIN (SELECT unnest([0.75, 0.5, 0.25, 0.125])::DOUBLE AS keep) GROUP BY keep",
    "layer_routing": "SELECT * FROM (VALUES ('full', 2::BIGINT), ('pruned', 22::BIGINT)) t(pool, n)",
    "victims": f"{_VICTIMS} SELECT * FROM v",
    "preempt_policies": f"{_VICTIMS}, p AS (SELECT *, ['swap', 'recompute', 'reject'][server % 3 + 1] AS policy FROM v) SELECT policy, count(*) AS n, sum(CASE WHEN policy = 'swap' THEN blocks ELSE 0 END)::BIGINT AS swapped, sum(CASE WHEN policy = 'recompute' THEN blocks * 64 ELSE 0 END)::BIGINT AS recomputed FROM p GROUP BY policy",
    "refcount_ledger": f"""WITH r AS ({REQUESTS_SQL}), o AS (SELECT prompt // 64 AS block, event_id * 2 AS op, 1 AS delta FROM r UNION ALL SELECT prompt // 64, event_id * 2 + 41, -1 FROM r), l AS (SELECT *, sum(delta) OVER (PARTITION BY block ORDER BY op ROWS UNBOUNDED PRECEDING) AS refs FROM o)
SELECT block, max(refs)::BIGINT AS most, count(*) FILTER (WHERE refs < 0) AS n_broken, sum(delta)::BIGINT AS "left" FROM l GROUP BY block""",
    "duplicate_free_blocks": f"WITH r AS ({REQUESTS_SQL}) SELECT session, count(*) - count(DISTINCT prompt // 64) AS n_duplicates FROM r GROUP BY session",
    "block_gather": "WITH s AS (SELECT doc_id, length(text) AS n, unnest(range(length(text))) AS p FROM documents) SELECT doc_id, count(*) AS n, sum(((p // 16 * 7 + doc_id) % 101) * 16 + p % 16)::BIGINT AS checksum FROM s GROUP BY doc_id",
    "prefill_chunks": f"WITH r AS ({REQUESTS_SQL}) SELECT event_id, (prompt + 511) // 512 AS n_chunks, greatest((prompt + 511) // 512 - 1, 0) AS first_token_step FROM r",
    "stop_positions": """WITH w AS (SELECT doc_id, string_split(text, ' ')[1:16] AS t FROM documents), p AS (SELECT doc_id, len(t) AS n, list_position(list_transform(t, lambda x: ends_with(x, '.')), true) AS ix FROM w)
SELECT doc_id, CASE WHEN ix > 0 THEN ix ELSE n END::BIGINT AS n_tokens, CASE WHEN ix > 0 THEN 'stop' ELSE 'length' END AS reason FROM p""",
}
