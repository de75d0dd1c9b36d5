"""Hand-computed cases of the operators, at their boundaries."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagequery.functions import scalars as S
from pagequery.operators import blocks as B
from pagequery.operators import load as L
from pagequery.operators import retrieval as R
from pagequery.operators import simulate as M
from pagequery.operators import stats as A
from pagequery.operators import vectors as V
from pagequery.operators import workload as W
from pagequery.sources import jsonl, ocr


def docs(spark, rows):
    return spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "doc_key string, pos long, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, question string")


def top(found):
    return {r.query_id: r.keys for r in found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_key"))), lambda x: x["doc_key"]).alias("keys")).collect()}


# retrieval


def test_text_search_ranks_and_fills(spark):
    index = R.fit(docs(spark, [("a", "quarterly revenue report"), ("b", "unrelated hiking trail guide"), ("c", "")]))
    got = top(R.text_topk(index, asked(spark, "Revenue, REPORT!", "nothing known", "", "guide"), 5))
    assert got == {"q0": ["a", "b", "c"], "q1": ["a", "b", "c"], "q2": ["a", "b", "c"], "q3": ["b", "a", "c"]}
    assert top(R.text_topk(index, asked(spark, "report"), 1)) == {"q0": ["a"]}


def test_similarity_identities(spark):
    index = R.fit(docs(spark, [("a", "one two two"), ("b", "three")]))
    scores = {(r.query_id, r.doc_key): r.score for r in R.text_scores(index, asked(spark, "one two two", "three four")).collect()}
    assert scores == {("q0", "a"): pytest.approx(1.0), ("q1", "b"): pytest.approx(1.0)}
    every = R.fit(docs(spark, [("a", "x"), ("b", "x")])).vocab.first()
    assert every.idf == pytest.approx(1.0)


@pytest.mark.parametrize("alpha, best", [(0.0, "a"), (1.0, "b")])
def test_hybrid_blend(spark, alpha, best):
    index = R.fit(docs(spark, [("a", "matches the text query"), ("b", "nothing of it")]))
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "doc_key string, vec array<float>")
    q = spark.createDataFrame([("q0", "text query", [1.0, 0.0]), ("q1", "text query", None)], "query_id string, question string, qvec array<float>")
    got = top(R.ranked(R.hybrid_scores(index, vectors, q, alpha), 2))
    assert got["q0"][0] == best and got["q1"][0] == "a"


def test_recall_without_queries_is_zero(spark):
    hits = spark.createDataFrame([("q", "a", 1)], "query_id string, doc_key string, rank int")
    gold = spark.createDataFrame([("q", "a")], "query_id string, gold_doc_key string")
    assert R.recall_at(hits, gold, 1).first().recall == 1.0
    assert R.recall_at(hits, gold.limit(0), 1).first().recall == 0.0


# scalars


def test_anls(spark):
    cases = [("0.28", ["0.28"], 1.0), ("  Pinterest ", ["pinterest"], 1.0), ("pinterest", ["facebook", "pinterest"], 1.0), ("0.28%", ["0.28"], 0.8), ("abcd", ["abxy"], 0.5), ("abcd", ["axyz"], 0.0), ("", ["x"], 0.0), ("", [""], 1.0), ("x", [], 0.0)]
    df = spark.createDataFrame([(p, g) for p, g, _ in cases], "p string, g array<string>")
    assert [r[0] for r in df.select(S.anls(F.col("p"), F.col("g"))).collect()] == pytest.approx([x for _, _, x in cases])


def test_block_arithmetic(spark):
    n = spark.createDataFrame([(0,), (1,), (16,), (17,)], "n long")
    assert [r[0] for r in n.select(S.ceil_div(F.col("n"), 16)).collect()] == [0, 1, 1, 2]
    with pytest.raises(Exception, match="negative"):
        n.select(S.ceil_div(-F.col("n"), 16)).collect()
    one = spark.range(1)
    assert one.select(S.kv_bytes_per_token(F.lit(24), F.lit(32), F.lit(64)), S.visual_tokens_per_tile(F.lit(512), F.lit(16), F.lit(4)), S.weight_bytes(F.lit(5), F.lit(4))).first() == (196_608, 64, 3)
    with pytest.raises(Exception, match="divide"):
        one.select(S.heads_per_group(F.lit(9), F.lit(2))).collect()


def test_cell_names(spark):
    df = spark.createDataFrame([(0.5, 512), (2.0, None)], "l double, c int")
    assert [r[0] for r in df.select(S.cell_name(F.col("l"), F.col("c"))).collect()] == ["load0.5-chunk512", "load2-unchunked"]


def test_prompts_leave_out_empty_texts(spark):
    df = spark.createDataFrame([("why?", ["k1", "k2"], ["a" * 2000, ""])], "q string, k array<string>, t array<string>")
    parts = df.select(S.prompt_parts(F.col("q"), F.col("k"), F.col("t"))).first()[0]
    assert [p.type for p in parts] == ["text", "image", "text", "text", "image", "text"] and len(parts[2].text) == 1500
    assert df.select(S.prompt(F.col("q"), F.col("t"))).first()[0] == "Document 1:\n" + "a" * 1500 + "\nDocument 2:\nQuestion: why?\nAnswer:"


# sources


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"query_id": "q1", "k": 5}\n\n{"query_id": "é", "k": 2}\n', encoding="utf-8")
    assert [(r.query_id, r.k) for r in jsonl.read(spark, str(tmp_path / "x.jsonl"), jsonl.TRACE).collect()] == [("q1", 5), ("é", 2)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read(spark, str(tmp_path / "bad.jsonl"), jsonl.TRACE).collect()
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", "ü")], "label string, v string")
    jsonl.write(df, out)
    jsonl.append(df.drop("label"), out)
    got = jsonl.results(spark, out, F.concat(F.lit("own-"), F.col("v"))).collect()
    assert sorted(r._label for r in got) == ["a", "own-ü"] and all(r._file.endswith(".json") for r in got)
    assert json.loads(df.select(jsonl.canonical("v", "label")).first()[0]) == {"label": "a", "v": "ü"}


def test_cache_computes_only_what_is_missing(spark, tmp_path):
    seen = []

    def compute(todo):
        seen.append(sorted(r.k for r in todo.collect()))
        return todo.withColumn("v", F.col("k") * 2)

    for keys in ([1, 2], [2, 3]):
        got = jsonl.cached(spark, str(tmp_path / "c"), spark.createDataFrame([(k,) for k in keys], "k long"), "k", compute)
        assert sorted((r.k, r.v) for r in got.collect()) == [(k, 2 * k) for k in keys]
    assert seen == [[1, 2], [3]]


def test_gate_and_report(spark):
    df = spark.range(4)
    assert jsonl.gate(df, F.count("*") >= 4, "few").count() == 4
    with pytest.raises(Exception, match="few"):
        jsonl.gate(df, F.count("*") > 4, "few").collect()
    assert jsonl.markdown(spark.createDataFrame([("a|b", None, 0.5)], "x string, y int, z double")) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | – | 0.5 |"


def test_ocr_containers(spark):
    payload = {"PAGE": [], "LINE": [{"BlockType": "LINE", "Text": "Social Media Demographics"}, {"BlockType": "LINE", "Text": "Pinterest: 71% female"}, {"BlockType": "LINE", "Text": ""}], "WORD": [{"BlockType": "WORD", "Text": "Social"}]}
    want = "Social Media Demographics\nPinterest: 71% female"
    shipped, plain = str([json.dumps(payload)]), json.dumps(payload)
    flat = json.dumps({"Blocks": [{"BlockType": "LINE", "Text": "flat form"}, {"BlockType": "WORD", "Text": "x"}]})
    bad = ["", "not json at all", "[", "{}", "[]", '["not-json-inside"]', "null", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([shipped, plain, flat, *bad])], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(ocr.lines(F.col("p"))).collect()] == [want, want, "flat form"] + [""] * len(bad)
    assert [r[0] for r in df.where("i IN (1, 2, 3, 4, 6)").orderBy("i").select(ocr.lines_native(F.col("p"))).collect()] == [want, "flat form", "", "", ""]


# workload


def test_traces_are_stable(spark):
    keys = spark.createDataFrame([(f"src:{i}:0",) for i in range(20)], "doc_key string")
    q = spark.createDataFrame([(f"q{i:03d}", f"src:{i}:0") for i in range(10)] + [("gone", "src:999:0")], "query_id string, gold_doc_key string")
    for make in (W.sampled_trace, W.sampled_trace_exact):
        rows = {r.query_id: list(r.retrieved) for r in make(q, keys).collect()}
        assert "gone" not in rows and all(len(set(v)) == 5 and v[0] == f"src:{int(k[1:])}:0" for k, v in rows.items())
        more = q.union(spark.createDataFrame([("q005b", "src:3:0")], q.schema)).orderBy(F.desc("query_id"))
        assert {k: v for k, v in ((r.query_id, list(r.retrieved)) for r in make(more, keys.orderBy(F.desc("doc_key"))).collect()) if k != "q005b"} == rows
        assert {r.query_id: list(r.retrieved) for r in make(q, keys, seed=2).collect()} != rows
        assert all(len(r.retrieved) == 3 for r in make(q, keys.where("doc_key IN ('src:1:0', 'src:2:0', 'src:3:0')"), 10).collect())


def test_holdout_takes_whole_documents(spark):
    gold = spark.createDataFrame([(f"q{i}", f"docvqa:{i // 3}:0") for i in range(30)], "query_id string, gold string")
    held = [r.gold for r in W.heldout_keys(gold, "gold", 0.25).collect()]
    assert len(held) == len(set(held)) == 2
    many = spark.range(20_000).select(F.col("id").alias("gold"))
    assert W.heldout_keys(many, "gold", 0.25).count() == 5000


def test_first_row_wins(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "k string, o int, v string")
    assert sorted((r.k, r.v) for r in W.first_per_key(df, "k", ["o"]).collect()) == [("a", "x"), ("b", "z")]
    assert W.limited_union([(df, 0), (df, 2), (df, -1)], "o").count() == 2


# statistics


def test_percentiles(spark):
    df = spark.range(1, 101).withColumn("x", F.col("id").cast("double"))
    r = df.agg(*A.percentiles(F.col("x"))).first()
    assert (r.p50, r.min, r.max, r.n, r.p99_is_reliable) == (50.5, 1.0, 100.0, 100, True) and r.p99 == pytest.approx(99.01)
    one = df.limit(1).agg(*A.percentiles(F.lit(7.0))).first()
    assert (one.p50, one.std, one.p99_is_reliable) == (7.0, 0.0, False)


def test_upper_median_and_last_write(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 1.0), ("a", 3, 3.0), ("a", 4, 4.0), ("b", 1, 9.0)], "k string, o int, v double")
    assert {r.k: r.median_upper for r in A.upper_median(df, ["k"], "v", "o").collect()} == {"a": 4.0, "b": 9.0}
    assert {r.k: r.v for r in A.last_write(df, ["k"], "o").collect()} == {"a": 4.0, "b": 9.0}


def test_comparability_treats_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "a", None)], "o int, same string, odd string")
    got = {r.field: (r.n_distinct, r.n_differing, r.comparable) for r in A.comparable(df, ["same", "odd"], "o").collect()}
    assert got == {"same": (1, 0, True), "odd": (2, 1, False)}


# load


def test_queue_closed_form(spark):
    rows = [(i, a, s) for i, (a, s) in enumerate([(0, 5), (1, 2), (10, 1), (10, 4), (11, 1)])]
    df = spark.createDataFrame(rows, "i int, a long, s long").withColumn("g", F.lit(1))
    got = [r.finish for r in L.fifo_finish(df, ["g"], ["a", "i"], "a", "s").orderBy("i").collect()]
    clock, want = 0, []
    for _, a, s in rows:
        clock = max(clock, a) + s
        want.append(clock)
    assert got == want


def test_depth_sweep(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 1, 3), (1, 4, 6)], "g int, a long, b long")
    got = [(r.t, r.delta, r.depth) for r in L.inflight(df, ["g"], "a", "b").orderBy("t", F.desc("delta")).collect()]
    assert got == [(0, 1, 1), (1, 1, 2), (3, -1, 1), (4, 1, 2), (4, -1, 1), (6, -1, 0)]


def test_saturation(spark):
    cells = [(0.081, 5.0, 12, False), (0.162, 8.9, 12, False), (0.323, 11.6, 12, True), (0.647, 11.3, 12, True), (0.313, 12.1, 100, True), (0.1, 0.0, 12, True)]
    df = spark.createDataFrame([(o, m / 60, n) for o, m, n, _ in cases] if (cases := cells) else [], "o double, s double, n int")
    flag = L.saturated(F.col("o"), F.col("s"), F.lit(6.39), F.col("n"))
    assert [r[0] for r in df.select(flag).collect()] == [x for *_, x in cells]
    assert spark.range(1).select(L.expected_stable(F.lit(6.39), F.lit(0.323), F.lit(12))).first()[0] == pytest.approx(1 + 6.39 * 0.323 / 12)


def test_cell_summary_counts_failures(spark):
    rows = [("c", 0.0, 1.0, 2.0, 10, None), ("c", 1.0, 3.0, 5.0, 10, "boom"), ("c", 2.0, None, None, 0, None)]
    df = spark.createDataFrame(rows, "cell string, submit_t double, first_token_t double, finish_t double, n_tokens long, error string")
    r = L.cell_summary(df).first()
    assert (r.n_requests, r.completed, r.failed, r.unfinished, r.tokens_per_s, r.ttft_p50, r.e2e_p50) == (3, 1, 1, 1, 4.0, 1.5, 2.0)
    assert L.decode_phase(df).first().p50 == 1.0


# blocks


def test_chain_hashes_match_hashlib(spark):
    df = spark.createDataFrame([([str(i) for i in range(10)],), (["1"],)], "t array<string>")
    got = [r[0] for r in df.select(B.chain_hashes(B.full_blocks(F.col("t"), 4))).collect()]
    link = lambda h, b: hashlib.sha256((h + "|" + b).encode()).hexdigest()[:32]
    first = link("root", "0,1,2,3")
    assert got == [[first, link(first, "4,5,6,7")], []]


def test_victims_newest_first(spark):
    def pick(blocks, need):
        df = spark.createDataFrame([(1, i, b, need) for i, b in enumerate(blocks)], "g int, i int, blocks int, need int")
        return sorted((r.i for r in B.victims(df, "need", ["g"], "i").collect()), reverse=True)

    assert pick([2, 2, 2], 2) == [2] and pick([2, 2, 2], 3) == [2, 1] and pick([5, 5, 5], 1) == [2]


def test_pool_plan(spark):
    n = B.pool_blocks(F.lit(4 << 30), F.lit(2_465_137_152), F.lit(347_734_016), F.lit(16), F.lit(196_608))
    assert spark.range(1).select(n, B.max_prompt(n, 4, F.lit(16))).first() == (471, 7472)
    with pytest.raises(Exception, match="no block"):
        spark.range(1).select(B.pool_blocks(F.lit(10), F.lit(20), F.lit(0), F.lit(16), F.lit(1))).collect()


def test_prefix_sharing_by_hand(spark):
    lists = [(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["x", "y"]), (4, ["a", "b"])]
    rows = [(1, s, i + 1, d, 10) for s, ds in lists for i, d in enumerate(ds)]
    r = B.prefix_sharing(spark.createDataFrame(rows, "all int, seq int, i int, doc string, cost long"), F.lit(16), ["all"]).first()
    # 30, 30, 20, 20 tokens: 2 + 2 + 2 + 2 blocks; a-b once 2, then 1 + 1 + 0; the single list once 2 and no rest
    assert (r.n_sequences, r.total_tokens, r.paged_blocks, r.shared_blocks) == (4, 100, 8, 6) and r.mean_prefix_docs == 2.0


# vectors


def test_quantisation_limits(spark):
    cells = spark.createDataFrame([(0, c, 0.0) for c in range(4)] + [(1, c, v) for c, v in enumerate([7.0, -7.0, 0.5, 1.5])], "row int, col int, v double")
    got = V.quantized(cells, 4, 4, 4).orderBy("row", "col").collect()
    assert [(r.scale, r.code) for r in got] == [(1.0, 0)] * 4 + [(1.0, 7), (1.0, -7), (1.0, 0), (1.0, 2)]
    for bits, group in ((4, 48), (3, 4)):
        with pytest.raises(ValueError):
            V.quantized(cells, bits, group, 64)
    pairs = spark.createDataFrame([(a, b) for a in range(-8, 8) for b in range(-8, 8)], "a int, b int").withColumn("p", V.packed(F.col("a"), F.col("b")))
    assert pairs.where((V.unpacked_low(F.col("p")) != F.col("a")) | (V.unpacked_high(F.col("p")) != F.col("b"))).count() == 0


def test_pruning_keeps_text_and_tail(spark):
    rows = [(0, i, i not in (0, 5), s) for i, s in enumerate([0.0, 0.9, 0.1, 0.8, 0.2, 0.0, 0.3, 0.4])]
    t = spark.createDataFrame(rows, "seq int, pos int, visual boolean, score double")
    keep = lambda df: sorted(r.pos for r in df.collect())
    assert keep(V.pruned_top(t, ["seq"], 0.5, 1)) == [0, 1, 3, 5, 7]
    assert keep(V.pruned_top(t, ["seq"], 1.0, 0)) == list(range(8)) and keep(V.pruned_top(t, ["seq"], 0.01, 0)) == [0, 1, 5]
    assert keep(V.pruned_stride(t, ["seq"], 0.5)) == [0, 1, 3, 5, 7]


def test_slots_must_match_features(spark):
    slots = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True)], "g int, pos int, masked boolean")
    f = spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "g int, i int, value int")
    assert [r.value for r in V.merged(slots, f, ["g"]).orderBy("pos").collect()] == [None, 10, 20]
    with pytest.raises(Exception, match="differ"):
        V.merged(slots, f.limit(1), ["g"]).collect()


# state machines


def test_allocator_rules():
    a = M.Allocator(4)
    x = a.allocate(3)
    with pytest.raises(M.OutOfBlocks):
        a.allocate(2)
    assert a.failures == 1 and a.free == 1 and a.violations() == 0
    a.share(x[0])
    y = a.own(x[0])
    assert y != x[0] and a.refs[x[0]] == 1 and a.own(y) == y
    assert a.release([x[0], *x[1:], y]) == 4 and a.free == 4 and a.violations() == 0
    for wrong in (lambda: a.share(0), lambda: a.release([0])):
        with pytest.raises(ValueError):
            wrong()


def test_prefix_cache_forgets_the_oldest():
    a = M.Allocator(16)
    c = M.PrefixCache(a, 2)
    blocks = a.allocate(3)
    assert c.register(["h1", "h2", "h3"], blocks) == 3 and list(c.held) == ["h2", "h3"]
    assert c.lookup(["h2", "h9", "h3"]) == [blocks[1]] and list(c.held) == ["h3", "h2"]
    assert M.PrefixCache(a, 0).register(["h"], [blocks[0]]) == 0


def test_scheduler_blocks_behind_a_request_that_never_fits():
    many = [{"id": i, "arrival": 0, "prompt": 40, "new": 4} for i in range(12)]
    out, stats = M.schedule(many, blocks=24, size=16, batch=4, reserve=2, chunk=16)
    assert stats["finished"] == 12 and stats["leaked"] == 0 and stats["prefill_chunks"] == 36 and stats["tokens"] == 48
    huge = [{"id": 99, "arrival": 0, "prompt": 10_000, "new": 1}, *many]
    out, stats = M.schedule(huge, blocks=24, size=16)
    assert stats["finished"] == 0 and {r["state"] for r in out} == {"unfinished"}
    out, stats = M.schedule(huge, blocks=24, size=16, reject_oversized=True)
    assert stats["rejected"] == 1 and stats["finished"] == 12


# streams


def test_request_machine(spark, tmp_path):
    from pagequery.streaming import requests as Q

    events = [(1, 0, "prompt", 5), (1, 1, "chunk", 5), (1, 2, "token", 3), (1, 3, "end", 0), (2, 0, "token", 1), (2, 1, "prompt", 8), (2, 2, "chunk", 4)]
    schema = "request_id long, seq long, kind string, n long"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = {(r.request_id, r.seq): (r.state, r.tokens, r.error) for r in Q.drained(spark, Q.transitions(stream), f"{tmp_path}/out", f"{tmp_path}/cp").collect()}
    assert got[1, 3] == ("finished", 4, None) and got[2, 0] == ("waiting", 0, "token while waiting") and got[2, 2] == ("prefilling", 0, None)


def test_poisson_source_is_seeded(spark, tmp_path):
    from pagequery.streaming import requests as Q

    spark.dataSource.register(Q.PoissonSource)
    runs = []
    for k in range(2):
        stream = spark.readStream.format("poisson").option("rate", "2.0").option("count", "250").option("seed", "3").load()
        query = stream.writeStream.format("memory").queryName(f"poisson{k}").start()
        for _ in range(200):
            if spark.table(f"poisson{k}").count() >= 250:
                break
            query.processAllAvailable()
        query.stop()
        runs.append([tuple(r) for r in spark.table(f"poisson{k}").orderBy("request_id").collect()])
    assert runs[0] == runs[1] and len(runs[0]) == 250 and 80 < runs[0][-1][1] < 180
