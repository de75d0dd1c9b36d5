"""What grows with the input: small cases that hold the plans of large tables against their plain forms."""

import pytest
from pyspark.sql import functions as F

from pagequery.functions import scalars as S
from pagequery.operators import blocks as B
from pagequery.operators import retrieval as R
from pagequery.operators import simulate as M
from pagequery.operators import workload as W
from pagequery.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(i, i, " ".join(f"w{(i * 7 + j * j) % (11 + i % 5)}" for j in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_key long, pos long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2", [1.0, 0.5]), (2, "w5 unknown", None), (3, "", [0.0, 1.0])], "query_id long, question string, qvec array<float>")
    vectors = spark.createDataFrame([(i, [i % 3 / 2, i % 5 / 4]) for i in range(0, 60, 2)], "doc_key long, vec array<float>")
    return docs, asked, vectors


@pytest.mark.parametrize("head", [0, 3, 1000])
@pytest.mark.parametrize("alpha", [0.0, 0.5])
def test_hybrid_topk_equals_the_frame_of_all_pairs(corpus, head, alpha):
    docs, asked, vectors = corpus
    want = R.ranked(R.hybrid_scores(R.fit(docs), vectors, asked, alpha), 5).select("query_id", "doc_key", "pos", "score", "rank")
    assert rows(R.hybrid_topk(R.fit(docs, head), vectors, asked, alpha, 5)) == rows(want)


@pytest.mark.parametrize("name", ["hybrid_topk", "hybrid_text_only"])
def test_hybrid_makes_no_pairs(spark, name):
    assert "NestedLoop" not in plan(QUERIES[name](spark, SF)) and "Cartesian" not in plan(QUERIES[name](spark, SF))


def test_dense_topk_is_products_of_blocks(spark):
    vectors = spark.createDataFrame([(i, i, [float(i % 4), float(i % 6), 1.0] if i % 7 else None) for i in range(90)], "doc_key long, pos long, vec array<float>")
    asked = vectors.where("pos % 20 = 1").select(F.col("doc_key").alias("query_id"), F.col("vec").alias("qvec"))
    assert rows(R.dense_topk(vectors, asked, 4)) == rows(R.ranked(R.dense_scores(vectors, asked), 4).select("query_id", "doc_key", "pos", "score", "rank"))
    assert "NestedLoop" not in plan(QUERIES["dense_topk"](spark, SF))


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_topk_and_sums_follow_from_scores(corpus, head):
    docs, asked, _ = corpus
    scores = R.text_scores(R.fit(docs), asked).collect()
    sums = {r.query_id: r for r in R.text_sums(R.fit(docs, head), asked).collect()}
    for q in (1, 2, 3):
        own = {r.doc_key: r.score for r in scores if r.query_id == q}
        assert (sums[q].s, sums[q].ss, sums[q].m) == pytest.approx((sum(own.values()), sum(x * x for x in own.values()), max(own.values(), default=0)))
        want = sorted(range(60), key=lambda k: (-round(own.get(k, 0.0), 9), k))[:5]
        assert [r.doc_key for r in R.text_topk(R.fit(docs, head), asked, 5).where(F.col("query_id") == q).orderBy("rank").collect()] == want


@pytest.mark.parametrize("name", ["flagship_tfidf_topk", "recall_at_k", "score_spread"])
def test_search_makes_no_pairs(spark, name):
    assert "regexp_extract_all" not in plan(QUERIES[name](spark, SF)) and "Contains" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_lengths_do_not_depend_on_the_head(corpus, head):
    docs = corpus[0]
    index = R.fit(docs, head)
    weights = R.weighted(R.term_counts(docs, "doc_key"), index.vocab, "doc_key")
    assert rows(index.norms) == rows(weights.groupBy("doc_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))


def test_zero_vectors_need_no_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["zero_vector_docs"](spark, SF)) and "Python" not in plan(QUERIES["zero_vector_docs"](spark, SF))


def test_bounded_distance_is_the_plain_one(spark):
    import random

    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abc \u00e9") for _ in range(n))
    pairs = [(word(n), word(m)) for n in range(0, 40, 3) for m in range(0, 40, 4)] + [(w, w[2:] + "x") for w in (word(n) for n in range(60, 140, 9))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b, d in df.select("a", "b", F.levenshtein("a", "b")).collect():
        for most in (0, d - 1, d, d + 3):
            assert S.bounded_distance(a, b, most) == (d if d <= most else -1)


@pytest.mark.parametrize("name", ["anls_scores", "anls_by_group"])
def test_anls_takes_words_of_bits(spark, name):
    assert "levenshtein" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("n", [1, 3, 700])
def test_trace_draws_without_sorting_pairs(spark, n):
    from pyspark.sql import Window

    keys = spark.range(n).select(F.col("id").alias("doc_key"))
    asked = spark.createDataFrame([(q, q % n) for q in range(6)] + [(9, 5000)], "query_id long, gold_doc_key long")
    got = {r.query_id: r.retrieved for r in W.sampled_trace(asked, keys, 5, 7).collect()}
    order = Window.partitionBy("query_id").orderBy(W.hash_rank(7, F.col("query_id"), F.col("doc_key")), "doc_key")
    every = asked.join(keys, F.col("gold_doc_key") != F.col("doc_key")).withColumn("rn", F.row_number().over(order)).where("rn < 5").orderBy("rn").collect()
    assert got == {q: [q % n] + [r.doc_key for r in every if r.query_id == q] for q in range(6)}


@pytest.mark.parametrize("name", ["frozen_trace", "canonical_order", "prompt_text", "prompt_part_counts"])
def test_traces_join_documents_where_they_lie(spark, name):
    shown = plan(QUERIES[name](spark, SF))
    assert "Cartesian" not in shown and "SortMergeJoin [doc_key" not in shown and "min(h" in shown


def test_prefix_sharing_shuffles_a_group_once(spark):
    import random

    draw = random.Random(3)
    lists = [(s % 2, s, [f"d{draw.choice('ab')}"] + [f"d{draw.choice('aab')}" for _ in range(draw.randrange(4))]) for s in range(80)]
    rows_ = [(a, s, i + 1, x, len(x) + ord(x[1]) % 5) for a, s, own in lists for i, x in enumerate(own)]
    got = {r.all: (r.n_sequences, round(r.mean_prefix_docs, 9)) for r in B.prefix_sharing(spark.createDataFrame(rows_, "all int, seq int, i int, doc string, cost long"), F.lit(4), ["all"]).collect()}
    for a in (0, 1):
        shared = 0
        for lead in ("da", "db"):
            group = [own for b, _, own in lists if b == a and own[0] == lead]
            n = 0
            while group and all(len(own) > n for own in group) and len({own[n] for own in group}) == 1:
                n += 1
            shared += n * len(group)
        assert got[a] == (40, round(shared / 40, 9))
    assert plan(QUERIES["prefix_sharing"](spark, SF)).count("Exchange") <= 8


def test_prefix_replay_has_no_limit(spark, tmp_path):
    words = [" ".join(f"{i}x{j}" for j in range(4 * 1000)) for i in range(270)]
    texts = [(i, t, "s") for i, t in enumerate([*words, words[0]])] + [(900, words[0], "other"), (901, "", "s"), (902, words[1], None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_blocks, r.n_hit) for r in QUERIES["unbounded_prefix_replay"](spark, str(tmp_path)).collect()}
    assert len(got) == 274 and got[270] == (1000, 1000) and got[900] == (1000, 0) and got[901] == (0, 0) and got[902] == (0, 0)
    assert all(got[i] == (1000, 0) for i in range(270))


@pytest.mark.parametrize("name", ["allocator_replay", "allocator_conservation", "lru_prefix_replay", "scheduler_replay", "scheduler_chunks"])
def test_replays_stream(spark, name):
    assert "FlatMapGroups" not in plan(QUERIES[name](spark, SF)) and "Join" not in plan(QUERIES[name](spark, SF))


def test_streamed_pools_do_not_mix(spark):
    ops = spark.createDataFrame([(p, e, "alloc" if e % 3 else "free", e % 2, 1) for p in (3, None, 1) for e in range(9000)], "pool long, at long, op string, owner long, n long").repartition(3)
    got = M.replay_allocator(ops, "pool", "at", 8)
    own = {p: [tuple(r)[1:] for r in got.where(F.col("pool").eqNullSafe(p)).orderBy("at").collect()] for p in (3, None, 1)}
    assert len(own[1]) == 9000 and own[1] == own[3] == own[None] and max(r[-1] for r in own[1]) == 0


def test_idle_steps_are_passed_over():
    out, stats = M.schedule([{"id": 1, "arrival": 5, "prompt": 4, "new": 1}, {"id": 2, "arrival": 900_000, "prompt": 4, "new": 2}], 24, 16)
    assert [(r["id"], r["admitted"], r["first"], r["finished"]) for r in out] == [(1, 5, 5, 5), (2, 900_000, 900_000, 900_001)] and stats["steps"] == 900_002


def test_violations_are_counted():
    a = M.Allocator(6)
    a.allocate(3)
    a.free_list.append(5)  # twice free
    a.refs[4] = 1  # free, with a reference
    a.refs[0] = 0  # neither
    assert a.violations() == 3
