"""The pipeline's stages on a small corpus with planted cases, each against what it must keep."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as C  # noqa: E402

RNG = np.random.default_rng(8)
VOCAB = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(500)]
prose = lambda n: " ".join(RNG.choice(VOCAB, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(300):
        good = i % 5 > 0
        text = prose(80) if good else " ".join(f"{w.upper()}!!" for w in prose(80).split())
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    bench = [(1, prose(30)), (2, prose(25))]
    passage = prose(70)
    extra = {400: rows[1][1], 401: rows[2][1].replace(rows[2][1].split()[40], "changed", 1), 402: prose(20) + " " + bench[0][1] + " " + prose(20), 403: prose(40) + " " + passage, 404: passage + " " + prose(40), 405: None, 406: ""}
    rows += [(i, t, "en", "s0", len(t or "")) for i, t in extra.items()]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {r[0]: r[1] for r in rows}


def test_stages(spark, corpus, tmp_path):
    at, texts = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r.asDict().get("text") for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    clean = {i for i in range(300) if i % 5 > 0}
    assert clean <= set(kept[0]) and not {i for i in range(300) if i % 5 == 0} & set(kept[0])
    assert {402, 403, 404} <= set(kept[0])
    assert set(kept[0]) - set(kept[1]) >= {400, 401} and clean <= set(kept[1])
    assert len(kept[2][404].split()) <= 45 and kept[2][403] == texts[403] and all(kept[2][i] == texts[i] for i in clean)
    assert 402 not in kept[3] and clean | {403, 404} <= set(kept[3])
    assert set(kept[4]) == set(kept[3])


def test_run_is_all_stages(spark, corpus):
    assert C.run(spark, corpus[0]).columns == ["doc_id", "source", "size", "source_size", "target", "taken", "shards"]


def test_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0, name
