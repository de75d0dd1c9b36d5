"""The operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequery.llm import common, decontam, graph, htmltext, langid, mixing, passages, pseudolm, quality, simhash, sketches, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, seed=None, vocab=VOCAB):
    rng = RNG if seed is None else np.random.default_rng(seed)
    return " ".join(rng.choice(vocab, n))


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 4}" if i % 9 else None, len(t) if t else 0) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "one", 5: "née Ünïcode ☃ 𝒳", 6: "x" * 3000, 7: "a b " * 2000}


def roots(pairs, nodes):
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 5), (200, 201), (201, 202), (7, 7), (200, 201)] + [(300 + i, 299) for i in range(1, 60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {k: v for k, v in roots(edges, nodes | {7}).items() if k in got} and set(got) == nodes
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# simhash


def _simhash_brute(texts):
    fp = {i: simhash.simhash((t or "").encode()) for i, t in texts.items()}
    ids = sorted(fp)
    return fp, roots([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2], ids)


def test_simhash_bits_follow_the_contract():
    import xxhash

    words = b"the quick brown fox jumps".split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum((2 * sum(x >> b & 1 for x in h) > 3) << b for b in range(64))
    assert simhash.simhash(b"The QUICK brown\tfox  jumps") == want
    assert simhash.simhash(b"") == 0 and simhash.simhash("é É".encode()) == xxhash.xxh64_intdigest("é É".encode(), 42)


@pytest.mark.parametrize("crowd", [48, 1])
def test_near_duplicates_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    base = prose(400, 1).split()
    texts = {i: prose(30) for i in range(20)} | {100 + i: v for i, v in ODD.items()}
    for i in range(30):
        words = list(base)
        words[i * 3] = "zz"
        texts[200 + i] = " ".join(words)
    fp, want = _simhash_brute(texts)
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fp % (1 << 64) == fp[r.doc_id] for r in got)


def test_near_duplicates_by_radius(spark):
    points = [(i, (1 << i) if i else 0) for i in range(12)] + [(50, (1 << 40) | 3), (51, (1 << 40))]
    df = spark.createDataFrame(points, "id long, fp long")
    for most in (0, 1, 2):
        want = roots([(a, b) for a, x in points for b, y in points if a < b and (x ^ y).bit_count() <= most], [p[0] for p in points])
        for crowd in (48, 1):
            simhash.CROWD, kept = crowd, simhash.CROWD
            try:
                got = {r.node: r.root for r in graph.components(simhash.links(df, most)).collect()}
            finally:
                simhash.CROWD = kept
            assert {k: got.get(k, k) for k in want} == want


def test_similar_documents_match_exact_jaccard(spark):
    texts = {i: prose(120) for i in range(10)} | {50 + i: v for i, v in ODD.items()}
    for i in range(14):  # copies with more and more words changed
        words = prose(200, 77).split()
        words[: i * 2] = [f"n{i}x{j}" for j in range(i * 2)]
        texts[100 + i] = " ".join(words)
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = roots([(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], sorted(sets))
    docs = frame(spark, texts)
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want
    assert {r.doc_id for r in simhash.distinct(docs).collect()} == set(want.values())


@pytest.mark.parametrize("tile", [1000, 10])
def test_similar_documents_in_crowded_blocks(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile, raising=False)
    base = prose(400, 78).split()
    texts = {500: " ".join(base)}
    for i in range(60):  # variants alike to the original, whose id is in their midst, but not to each other
        words = list(base)
        for j in range(8):
            words[(i * 7 + j * 43) % 400] = f"v{i}x{j}"
        texts[i * 17 + 1] = " ".join(words)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(alike(sets[500], s) for s in sets.values()) and not alike(sets[1], sets[18])
    got = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, texts)).collect()}
    assert got == roots([(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])], sorted(sets))


# suffixes


def _suffix_brute(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(t[k : k + length] for t in raw.values() for k in range(len(t) - length + 1))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        starts = (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()
        out[i] = (len(t), int(gone.sum()), int(starts), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[: len(t)]])).hexdigest())
    return out


@pytest.mark.parametrize("shard, most", [(1 << 20, 1 << 22), (700, 1 << 22), (900, 1500), (300, 0)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, shard, most):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "MOST", most)
    shared = prose(60, 3)
    texts = {i: prose(40) for i in range(8)} | {20 + i: prose(20) + " " + shared[i : 200 + 3 * i] + " " + prose(10) for i in range(12)}
    texts |= {60: shared, 61: shared, 62: shared + shared, 63: "ab" * 200} | {100 + i: v for i, v in ODD.items()}
    texts |= {200 + i: f"{prose(9)} {shared[40 + i % 3 : 180]}{(' left', ' right')[i % 2]} side {prose(9)}" for i in range(20)}
    for length, gram in ((40, 8), (90, 20)):
        got = suffixes.dedup(frame(spark, texts), length, gram, keep_text=True).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _suffix_brute(texts, length)
        assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_dedup_keeps_rows_of_one_id_apart(spark):
    p = prose(30, 4)
    rows = [(1, f"{prose(9)} {p}"), (1, prose(50)), (1, f"{p} {prose(9)}"), (None, p), (None, None), (None, prose(40)), (2, prose(45)), (2, prose(45, 6)), (2, prose(45, 6)), (None, prose(45, 7)), (None, prose(45, 7))]
    docs = spark.createDataFrame([(i, t, b"x", 5) for i, t in rows], "doc_id long, text string, kept binary, n_bytes int").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(docs, 60, 12).collect())
    want = _suffix_brute(dict(enumerate(t for _, t in rows)), 60)
    assert got == Counter((i, *want[k]) for k, (i, _) in enumerate(rows))
    assert suffixes.dedup(docs.limit(0)).count() == 0


def test_shards_are_merged_by_binary_search():
    rng = np.random.default_rng(3)
    stretches = [(g, 20 * g + k, bytes(rng.integers(97 + 2 * g, 99 + 2 * g, int(rng.integers(5, 60))).astype(np.uint8))) for g in range(3) for k in range(20)]
    for length in (8, 11, 16):
        seen = Counter(t[i : i + length] for _, _, t in stretches for i in range(len(t) - length + 1))
        want = {k: {i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1} for _, k, t in stretches}
        for size in (40, 200, 10**6):
            got = {k: set() for k in want}
            for shard in suffixes.merged(iter(stretches), length, size):
                for r, a, b in shard.found().tolist():
                    got[shard.rows[r][1]].update(range(a, b))
            assert got == want


def test_suffix_array_is_sorted():
    text = bytes(np.random.default_rng(0).integers(97, 100, 500).astype(np.uint8))
    buf = np.frombuffer(text, np.uint8)
    order, _ = suffixes.suffix_array(buf, np.full(500, 500), 1000)
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(500))
    lcp = suffixes.common_prefixes(buf, np.full(500, 500), order)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while max(a, b) + n < 500 and text[a + n] == text[b + n]:
            n += 1
        assert lcp[b] == n


# passages


def test_passages_are_cut_from_all_but_the_first(spark):
    p = prose(80, 9).split()
    texts = {
        1: prose(50, 10) + " " + " ".join(p) + " " + prose(40, 11),
        2: prose(60, 12),
        3: " ".join([prose(10, 13), *p[:40], "zz", *p[41:], prose(30, 14)]),
        4: " ".join([prose(10, 15), *p[:30], *p[33:60], "a1", "b1", *p[60:], prose(7, 16)]),
        5: prose(30, 17) + " " + " ".join(p[:45]) + " " + prose(30, 18),
        6: None,
        7: "",
        8: " ".join(p),
    }
    got = {r.doc_id: r for r in passages.dedup(frame(spark, texts)).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {3, 4, 8}
    assert got[8].n_removed == got[8].n_words == 80 and got[8].text == "" and got[8].partners == [1]
    assert got[3].n_removed >= 79 and got[4].n_removed >= 75 and 1 in got[4].partners
    assert got[1].text == texts[1] and got[6].text is None and got[7].text == ""


def test_passages_of_repeated_and_null_ids(spark):
    p, q = prose(80, 91), prose(70, 92)
    rows = [(1, f"{p} {prose(30, 93)}"), (1, f"{prose(30, 94)} {q}"), (None, f"{q} {prose(20, 95)}"), (2, p), (2, p), (3, f"{prose(9, 96)} {q}"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, 7, ["x"]) for i, t in rows], "doc_id long, text string, n_words int, partners array<string>").repartition(3)
    got = passages.dedup(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words or 0, r.n_removed) for r in got) == sorted(((i is None, i or 0), len((t or "").split()), {(1, 100): 70, (3, 79): 70}.get((i, len((t or "").split())), 80 if t == p else 0)) for i, t in rows)
    assert {tuple(r.partners) for r in got if r.doc_id == 2} == {(1,)} and sum(r.text is None for r in got) == 1
    assert passages.dedup(docs.limit(0)).count() == 0


def test_passages_of_many_documents_match_brute_force(spark):
    """Every word of a verbatim run of 50 words or more that an earlier document has is removed, and no other, but for chance matches at its ends."""
    shared = [prose(n, 500 + n).split() for n in (60, 75, 120)]
    texts = {}
    for i in range(60):
        rng = np.random.default_rng(i)
        parts = [prose(int(rng.integers(5, 40)), 7000 + i).split()]
        for k in rng.choice(3, int(rng.integers(0, 3)), replace=False):
            parts += [shared[k], prose(int(rng.integers(70, 90)), 8000 + 3 * i + int(k)).split()]
        texts[i] = " ".join(w for p in parts for w in p)
    seen, want = set(), {}
    for i, t in texts.items():
        w = t.split()
        gone, grams = np.zeros(len(w), bool), [tuple(w[k : k + 50]) for k in range(max(len(w) - 49, 0))]
        for k, g in enumerate(grams):
            gone[k : k + 50] |= g in seen
        seen |= set(grams)
        want[i] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in passages.dedup(frame(spark, texts)).collect()}
    assert sum(want.values()) > 1000 and all(abs(got[i] - want[i]) <= 2 * (want[i] > 0) for i in texts)


def test_a_line_that_goes_on_and_on_makes_few_chains(spark, monkeypatch):
    """Documents that repeat two words some hundred times meet the earliest one on a few diagonals, not on one for each time, and lose the passage."""
    line = prose(2, 53).split()
    run = lambda k, n: [line[(k + j) % 2] for j in range(n)]
    texts = {k: " ".join([*prose(20, 5100 + k).split(), *run(k, 300 if k == 1 else 250 + 3 * k), *prose(20, 5200 + k).split()]) for k in range(1, 13)}
    texts[20] = " ".join([*texts[2].split()[:200], *prose(70, 5300).split(), *run(0, 49), *prose(70, 5301).split(), *run(0, 90)])
    seen, want = set(), {}
    for i, t in texts.items():
        w = t.split()
        gone, grams = np.zeros(len(w), bool), [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, g in enumerate(grams):
            gone[k : k + 50] |= g in seen
        seen |= set(grams)
        want[i] = int(gone.sum())
    kept, cut = [], passages.cut
    monkeypatch.setattr(passages, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = {r.doc_id: r.n_removed for r in passages.dedup(frame(spark, texts)).collect()}
    assert sum(want.values()) > 2500 and all(abs(got[i] - want[i]) <= 2 * (want[i] > 0) for i in texts)
    chains = [r["count"] for r in next(df for df in kept if "c" in df.columns).groupBy("x", "y").count().collect()]
    assert max(chains) <= 20 and sum(chains) <= 300


def _halves(n):
    """A passage of two halves in documents 100 and 900, and n documents on either side of 100 and before 900 with one half."""
    a, b = prose(30, 31), prose(30, 32)
    around = lambda k, t: f"{prose(20, 1000 + k)} {t} {prose(20, 3000 + k)}"
    alone = [*range(1, 1 + n), *range(400, 400 + n)]
    return {k: around(k, (a, b)[k % 2]) for k in alone} | {k: around(k, f"{a} {b}") for k in (100, 900)}


@pytest.mark.parametrize("n", [4, 40])
def test_a_passage_finds_the_document_that_has_it_all(spark, n):
    got = {r.doc_id: r for r in passages.dedup(frame(spark, _halves(n))).collect()}
    assert {k for k, r in got.items() if r.n_removed} == {900} and got[900].n_removed >= 60 and got[900].partners == [100]


def test_a_passage_whose_parts_are_all_crowded(spark):
    """Six earlier documents hold each part of 42 words, so that every run of seeds of the passage meets only those; two hold all of it."""
    p = prose(53, 61).split()
    parts = [p[k : k + 42] for k in range(0, 12)]
    texts = {10 * k + m: f"{prose(20, 5000 + 10 * k + m)} {' '.join(part)} {prose(20, 6000 + 10 * k + m)}" for k, part in enumerate(parts) for m in range(6)}
    texts |= {k: f"{prose(20, 7000 + k)} {' '.join(p)} {prose(20, 8000 + k)}" for k in (*range(500, 506), 900)}
    got = {r.doc_id: r for r in passages.dedup(frame(spark, texts)).collect()}
    assert {k for k, r in got.items() if r.n_removed} == {*range(501, 506), 900}
    assert all(got[k].n_removed >= 53 and got[k].partners == [500] for k in (501, 505, 900))


def test_passages_drop_their_shuffles_as_they_go(spark, monkeypatch):
    """What the steps shuffled goes when they end, not when the driver's heap next fills up; windows and chains may be spread over batches."""
    monkeypatch.setattr(passages, "tidy", lambda spark: None)
    files = lambda: set(re.findall(r"shuffle_(\d+)_", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before = files()
    found = passages.dedup(frame(spark, _halves(40)))
    assert len(files() - before) <= 5
    assert {r.doc_id: r.n_removed >= 60 for r in found.where("n_removed > 0").collect()} == {900: True}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        test_a_passage_whose_parts_are_all_crowded(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tidy_gives_native_memory_back(spark, monkeypatch):
    """The call to the JVM is one that it has; where it has not, tidy() goes on without it."""
    monkeypatch.setattr(common, "Py4JError", ZeroDivisionError)
    common.tidy(spark)


def test_straight_chains_align_as_one_by_one():
    rng = np.random.default_rng(3)
    flat, x, y, close, a, b, n, want = [], [], [], [], [], [], [], []
    for _ in range(300):
        one, two = (rng.integers(0, 3, rng.integers(12, 90)).astype(np.uint16) for _ in "xy")
        p, q = int(rng.integers(0, len(one) - 10)), int(rng.integers(0, len(two) - 10))
        step = int(rng.integers(1, min(len(one) - p, len(two) - q) - passages.SHINGLE + 1))
        same = min(step + 9, len(one) - p, len(two) - q)
        two[q : q + same] = one[p : p + same]
        start = sum(map(len, flat))
        flat += [one, two]
        x.append(start), y.append(start + len(one)), close.append(start + len(one) + len(two)), a.append(p), b.append(q), n.append(step + passages.SHINGLE)
        want.append(passages.align(one, two, np.array([p, p + step]), np.array([q, q + step])))
    got = passages.align_straight(np.concatenate(flat), *(np.array(v) for v in (x, y, close, a, b, n)))
    assert list(zip(*(v.tolist() for v in got), strict=True)) == want


def test_windows_of_crowded_seeds(monkeypatch):
    texts = [prose(200, 71), prose(49, 72), "", prose(50, 73)]
    buf, off = passages.packed(pa.array(texts))
    row, h, place = passages.crowded_windows(np.full(1 << 22, 255, np.uint8), buf, off)
    assert np.bincount(row, minlength=4).tolist() == [151, 0, 0, 1] and place.tolist() == [*range(151), 0] and len(set(h.tolist())) == 152
    assert not len(passages.crowded_windows(np.zeros(1 << 22, np.uint8), buf, off)[0])
    # whatever stands beside them, the same windows are found
    sifted = passages.sifted
    p = prose(50, 74)
    hot = set(passages.seeds(*passages.packed(pa.array([p])))[1].tolist())
    monkeypatch.setattr(passages, "sifted", lambda bits, h: np.isin(h, np.array(list(hot), np.uint64)))
    for k in range(20):
        one = passages.packed(pa.array([f"{prose(9, 7500 + k)} {p} {prose(9, 7600 + k)}"]))
        assert 9 in passages.crowded_windows(None, *one)[2].tolist()
    monkeypatch.setattr(passages, "sifted", sifted)


@pytest.mark.parametrize("places", [1, 12])
def test_a_phrase_that_stands_earlier_in_the_partner(spark, places):
    p = prose(60, 41).split()
    early = " ".join(f"{prose(30, 4000 + k)} {' '.join(p[20:44])}" for k in range(places))
    texts = {1: f"{early} {prose(70, 43)} {' '.join(p)} {prose(20, 44)}", 2: f"{prose(20, 45)} {' '.join(p)} {prose(20, 46)}"}
    assert passages.dedup(frame(spark, texts)).where("doc_id = 2").first().n_removed >= 60


def test_chains_keep_order_and_gap_costs():
    a = np.array([0, 5, 10, 15, 40, 41, 12])
    b = np.array([100, 105, 110, 116, 20, 21, 300])
    found = passages.chains(a, b)
    assert [len(x) for x, _ in found][0] == 4 and found[0][0].tolist() == [0, 5, 10, 15]
    assert all((np.diff(x) > 0).all() and (np.diff(y) > 0).all() for x, y in found)
    rng = np.random.default_rng(2)
    for _ in range(20):  # every match is in one chain at most
        a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        once = np.unique(np.column_stack([a, b]), axis=0)
        pairs = [(int(x), int(y)) for p, q in passages.chains(once[:, 0], once[:, 1]) for x, y in zip(p, q, strict=True)]
        assert len(pairs) == len(set(pairs)) <= len(once)


def test_chains_reach_past_a_better_end_far_away():
    far = np.arange(0, 200, 6)  # a long passage, and a second one 100 words on with two words put in
    one, two = np.arange(300, 330, 6), np.arange(332, 362, 6)
    a = np.concatenate([far, one, two])
    b = np.concatenate([far, one, two - 2])
    found = {p.tolist()[0]: p.tolist() for p, _ in passages.chains(a, b)}
    assert found == {0: far.tolist(), 300: [*one.tolist(), *two.tolist()]}
    rng = np.random.default_rng(4)
    for _ in range(20):  # the best chain's score is that of a search through all predecessors
        m = np.unique(np.column_stack([rng.integers(0, 150, 60), rng.integers(0, 150, 60)]), axis=0)
        best = []
        for x, y in m.tolist():
            reach = [(s, x - u, y - v) for s, u, v in best if 0 < x - u <= passages.GAP and 0 < y - v <= passages.GAP]
            best.append((max([5.0, *(s + min(5, c, d) - 0.5 * abs(c - d) - 0.02 * max(max(c, d) - 5, 0) for s, c, d in reach)]), x, y))
        p, q = passages.chains(m[:, 0], m[:, 1])[0]
        c, d = np.diff(p), np.diff(q)
        assert np.isclose(5 + (np.minimum(np.minimum(c, d), 5) - 0.5 * abs(c - d) - 0.02 * np.maximum(np.maximum(c, d) - 5, 0)).sum(), max(best)[0])


def test_second_passage_behind_a_longer_one(spark):
    p, q = prose(200, 21), prose(60, 22).split()
    texts = {1: f"{p} {prose(90, 23)} {' '.join(q)}", 2: f"{p} {prose(90, 24)} {' '.join([*q[:30], 'inserted', *q[30:]])}"}
    assert passages.dedup(frame(spark, texts)).where("doc_id = 2").first().n_removed >= 258


def test_a_sieve_keeps_what_it_holds(spark):
    from pagequery.llm import common

    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    bits = common.sieve(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h").value
    assert common.sifted(bits, keys.view(np.uint64)).all()
    assert common.sifted(bits, np.arange(100000, dtype=np.uint64)).mean() < 0.001


def test_fenwick_prefix_maxima():
    tree, values = passages.Fenwick(50), {}
    rng = np.random.default_rng(1)
    for k in range(200):
        i, v = int(rng.integers(0, 50)), float(rng.normal())
        tree.put(i, v, k)
        values[i] = max(values.get(i, -9e9), v)
        j = int(rng.integers(0, 51))
        want = max([x for p, x in values.items() if p < j], default=-np.inf)
        assert tree.best(j)[0] == want


# decontamination


def test_leaks_found_exactly_and_reparameterised(spark):
    items = [(1, "A train leaves the old station with 120 passengers and travels 45 km before noon"), (2, "x " * 3), (3, None), (4, ""), (5, "12 34 56 78"), (6, "short item here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = items[0][1].replace("120", "77").replace("45", "99")
    twice = "each box holds 5 pens and 5 caps so 5 children share the boxes between them today"
    bench = bench.union(spark.createDataFrame([(7, twice)], bench.schema))
    texts = {
        1: prose(30) + " " + items[0][1] + ". " + prose(10),
        2: prose(30) + " " + changed + " " + prose(10),
        3: prose(60),
        4: "short item here",
        5: twice.replace("5", "8"),
        6: twice.replace("5", "8", 1).replace("5", "9", 1),
        7: None,
        8: "12 34 56 78",
        9: items[0][1][:40],
    }
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 6), (5, 7), (8, 5)}  # an item of numbers only is found by its values
    assert got[1, 1].exact and not got[2, 1].exact and not got[5, 7].exact
    assert (got[1, 1].first_word, got[1, 1].end_word) == (30, 45)  # the leading A, within a sentence here, is read as a name too
    small = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, texts), bench, block_windows=10).collect()}
    assert small == set(got)
    assert {r.doc_id for r in decontam.clean(frame(spark, texts), bench).collect()} == {3, 6, 7, 9}
    nothing = spark.createDataFrame([], bench.schema)
    assert decontam.leaks(frame(spark, texts), nothing).count() == 0 and decontam.clean(frame(spark, texts), nothing).count() == 9


def test_leaks_of_numbers_names_and_layout(spark):
    trade = "{0} has {1} plums and 3 figs. {0} buys {2} kg of flour today. {0} sells 2 boxes to Ann. How many are left?"
    bench = spark.createDataFrame([(1, trade.format("Tom", 5, 7)), (2, "12 34 56 78 91 23 45"), (3, "Anna Berta Clara Dora Emma Frieda")], "item_id long, text string")
    texts = {
        1: prose(20) + " " + trade.format("Eve", 9, 8) + " " + prose(20),
        2: trade.format("Tom", "eleven", "four"),
        3: trade.format("Eve", 9, 8).replace("Eve buys", "Ute buys"),
        4: trade.format("Tom", 5, 7).replace(" ", "\n"),
        5: prose(9) + " 12 34 56 78 91 23 45 " + prose(9),
        6: prose(9) + " 12 34 56 78 91 32 54 " + prose(9),
        7: "so Anna Berta Clara Dora Emma Frieda came",
        8: "so Anna Clara Berta Dora Emma Frieda came",
        9: prose(40),
    }
    got = {(r.doc_id, r.item_id): r.exact for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert got == {(1, 1): False, (2, 1): False, (4, 1): True, (5, 2): True, (7, 3): True}


# mixing


def test_targets_are_shared_and_capped():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 500, 490], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(1000) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_split_keeps_quotas():
    counts = np.array([40, 0, 3, 900])
    got = mixing.split(counts, 7, np.random.default_rng(0))
    assert got.sum(0).tolist() == counts.tolist() and (got >= 0).all() and np.ptp(got.sum(1)) <= 7
    assert (mixing.split(counts, 7, np.random.default_rng(0)) == got).all()


def test_mix_meets_targets(spark):
    texts = {i: prose(int(RNG.integers(1, 120))) for i in range(400)} | {1000 + i: v for i, v in ODD.items()}
    docs = frame(spark, texts)
    taken, copies = (x.toPandas() for x in mixing.mix(docs))
    again = mixing.mix(docs)[0].toPandas()
    assert taken.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    size = {i: len((t or "").encode().split()) for i, t in texts.items()}
    assert dict(zip(taken.doc_id, taken["size"], strict=True)) == size
    assert (taken.taken <= 3 * taken["size"]).all() and (taken.taken % taken["size"].clip(lower=1) == 0).all()
    for _, g in taken.groupby(taken.source.fillna("")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(20, 0.01 * g.target.iloc[0]) and g.source_size.iloc[0] == g["size"].sum()
    times = copies.groupby("doc_id").size()
    assert all(times.get(i, 0) * s == t for i, s, t in zip(taken.doc_id, taken["size"], taken.taken, strict=True) if s)
    assert not copies.duplicated(["doc_id", "copy"]).any() and copies.shard.between(0, 15).all()
    assert {i: sorted(s) for i, s in zip(taken.doc_id, taken.shards, strict=True) if len(s)} == copies.groupby("doc_id").shard.apply(sorted).to_dict()
    assert mixing.mix(frame(spark, {0: None}).limit(0))[0].count() == 0


def test_mix_goes_through_the_tree(spark, monkeypatch):
    """The blocks of each shard are those that the tree deals it; without the tree the rows are others."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    docs = frame(spark, {i: prose(3 + i % 50, i) for i in range(300)})
    rows = lambda: {(r.doc_id, r.copy, r.shard) for r in mixing.mix(docs)[1].collect()}
    kept, real, dealt = rows(), mixing.split, []
    monkeypatch.setattr(mixing, "split", lambda counts, shards, rng: dealt.append(real(counts, shards, rng)) or dealt[-1])
    assert rows() == kept
    sizes = dealt[0].sum(1)
    assert np.ptp(sizes) <= 4 and {s for _, _, s in kept} == set(np.flatnonzero(sizes).tolist())
    monkeypatch.setattr(mixing, "split", lambda counts, shards, rng: np.concatenate([counts[None], np.zeros((shards - 1, len(counts)), np.int64)]))
    assert {s for _, _, s in rows()} == {0} != {s for _, _, s in kept}


def test_draws_and_last_words():
    rng = np.random.default_rng(2)
    blocks = [(b, int(rng.integers(1, 50))) for b in range(30)]
    size = sum(s for _, s in blocks)
    for target in (0, 7, size, 2.5 * size, 3 * size):
        got = mixing.draws(blocks, target, np.random.default_rng(1))
        words = sum(dict(blocks)[b] if w is None else w for b, _, w in got)
        assert words == round(target) and len({(b, c) for b, c, _ in got}) == len(got) and sum(w is not None for *_, w in got) <= 1
    for _ in range(30):
        sizes = rng.integers(0, 40, 12)
        words = int(rng.integers(0, sizes.sum() + 5))
        sums = {0}
        for s in sizes.tolist():
            sums |= {s + x for x in sums}
        got = mixing.fill(sizes, words)
        assert sizes[got].sum() == max(x for x in sums if x <= words)


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e", "x"), (None, "f g", None), (None, None, None), (2, "h " * 40, "y"), (2, "h " * 40, "y")]
    docs = spark.createDataFrame([(i, t, s, 9, "z") for i, t, s in rows], "doc_id long, text string, source string, size int, k string").repartition(3)
    got = mixing.mix(docs)[0].collect()
    assert sorted((r.doc_id or 0, r.size, r.source or "") for r in got) == sorted((i or 0, len((t or "").split()), s or "") for i, t, s in rows)
    assert all(r.taken <= 3 * r.size for r in got) and {r.source: r.source_size for r in got} == {"x": 8, None: 2, "y": 80}


# learned operators


def test_language_needs_only_the_text(spark):
    vocab = {"aa": ["".join(np.random.default_rng(i).choice(list("aeioulmn"), 5)) for i in range(90)], "zz": ["".join(np.random.default_rng(i).choice(list("zkrtxwöß"), 5)) for i in range(90)]}
    rows = [(i, " ".join(np.random.default_rng(i).choice(vocab[lang], 3 + i % 60)), lang) for i, lang in enumerate(["aa", "zz"] * 120)]
    rows += [(900, None, "aa"), (901, "123 !!", "zz"), (902, "", None), (903, rows[7][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(docs, F.col("doc_id") % 4 != 2)
    assert set(model) == {"aa", "zz"} and model == langid.learn(docs.repartition(5), F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [i for i in range(240) if i % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == got[7].lang_pred
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.learn(docs.limit(0), F.lit(True)) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_quality_learns_and_calibrates(spark):
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        rows.append((i, prose(40, i) if good else " ".join(f"{w.upper()}!!" for w in prose(40, i).split())))
        labels.append((i, int(good)))
    rows += [(900 + i, v) for i, v in ODD.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (2000, 1)], "doc_id long, quality int")
    model = quality.fit(docs, lab, ~quality.held_out())
    got = {r.doc_id: r for r in quality.classify(docs.withColumn("score", F.lit(1)), model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and len(got) == len(rows)
    empty = quality.fit(docs, lab.limit(0), ~quality.held_out())
    assert {r.score for r in quality.classify(docs, empty).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0
    one_class = quality.fit(docs, lab.where("quality = 1"), ~quality.held_out())
    assert min(r.score for r in quality.classify(docs, one_class).collect()) > 0.5


def test_isotonic_is_the_nearest_monotone_fit():
    y, w = np.array([1.0, 0.0, 0.5, 2.0, 1.0]), np.array([1.0, 1.0, 2.0, 1.0, 3.0])
    got = quality.isotonic(y, w)
    assert (np.diff(got) >= -1e-12).all() and got.tolist() == pytest.approx([0.5, 0.5, 0.5, 1.25, 1.25])


def test_pseudo_likelihood_normalises_and_learns(spark):
    order = [f"w{i}" for i in range(12)]
    texts = {i: " ".join(order[(i + j) % 12] for j in range(60)) for i in range(150)} | {1000 + i: v for i, v in ODD.items()}
    docs = frame(spark, texts)
    net = pseudolm.fit(docs, rounds=6)
    start = pseudolm.vocabulary(docs, 5)
    beside = np.array([[net.ids[-1]] * 3] * 4, np.int16)
    total = sum(np.exp(pseudolm.log_probabilities(net, np.full(3, i, np.int16), beside)) for i in range(pseudolm.VOCABULARY))
    assert total == pytest.approx(np.ones(3), abs=1e-4)
    got = {r.doc_id: r for r in pseudolm.score(docs, net).collect()}
    first = {r.doc_id: r for r in pseudolm.score(docs, start).collect()}
    assert np.mean([got[i].mean_pll for i in range(150)]) > np.mean([first[i].mean_pll for i in range(150)]) + 0.3
    shuffled = spark.createDataFrame([(0, " ".join(np.random.default_rng(0).permutation(texts[0].split())))], "doc_id long, text string")
    assert pseudolm.score(shuffled, net).first().pll < got[0].pll
    assert (got[1000].n_tokens, got[1000].pll, got[1000].mean_pll) == (0, 0.0, None) and got[1003].pll == got[1004].pll
    assert pseudolm.score(docs.limit(0), net).count() == 0
    assert pseudolm.score(docs.limit(0), pseudolm.fit(docs.limit(0))).count() == 0


@pytest.mark.parametrize("common", [pseudolm.COMMON, 3])
def test_every_word_outside_the_vocabulary_has_a_probability_of_its_own(spark, monkeypatch, common):
    monkeypatch.setattr(pseudolm, "COMMON", common)
    many = [f"w{k:04d}" for k in range(pseudolm.VOCABULARY)]
    texts = {0: " ".join(many * 20), 1: "zebra " * 6 + "Zebra", 2: "camel " * 3, 3: "zebra", 4: "camel", 5: "otter", 6: None, 7: "zebra camel Zebra"}
    docs = frame(spark, texts)
    every = {(r.h, r["shape"]): r.n for r in pseudolm.counts(docs).collect() if r.h is not None}
    assert len(every) == len(many) + 4  # zebra in two shapes, whatever the partitions
    net = pseudolm.vocabulary(docs, 5)
    got = {r.doc_id: r for r in pseudolm.score(docs, net).collect()}
    n = {"zebra": 8, "camel": 5, "otter": 1}  # all of one shape, small letters
    for one, two, i, j in (("zebra", "camel", 3, 4), ("camel", "otter", 4, 5)):
        assert got[i].pll - got[j].pll == pytest.approx(np.log(n[one] / n[two]), abs=1e-5)
    unseen = pseudolm.score(spark.createDataFrame([(0, "horse"), (1, "horse")], "doc_id long, text string"), net).collect()
    assert len(unseen) == 2 and unseen[0].pll == unseen[1].pll == pytest.approx(got[5].pll, abs=1e-5)
    assert (got[6].n_tokens, got[6].pll, got[6].mean_pll) == (0, 0.0, None) and got[1].n_tokens == 7


# sketches


def _paragraphs(t):
    t = t or ""
    return set(re.split(r"\n|(?<=[aen]\. )|(?<=[!?] )|(?<=[\u3002\uFF01\uFF1F])", t)) | {" ".join(t.split(" ")[:k]) for k in (1, 2, 4, 8, 16)}


@pytest.mark.parametrize("uneven", [20, 0])
def test_fingerprints_tell_versions_apart(spark, monkeypatch, uneven):
    monkeypatch.setattr(sketches, "UNEVEN", uneven)
    monkeypatch.setattr(sketches, "RANGE_DOCS", 7)
    lines = [prose(6, i) for i in range(400)]
    texts = {i * 3: "\n".join(lines[i % 50 : i % 50 + 1 + i * 3]) for i in range(60)} | {500 + i: v for i, v in ODD.items()} | {10**9: "end", -5: "begin\nof. all\nFoo bar! baz", 600: prose(40, 1), 601: ". ".join(lines[:30])}
    got = {r.doc_id: r for r in sketches.fingerprints(frame(spark, texts)).collect()}
    ids = sorted(texts)
    like = lambda a, b: len(a & b) / len(a | b)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, u = texts[i] or "", texts[j] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(_paragraphs(t), _paragraphs(edited))) and got[i].near_next == pytest.approx(like(_paragraphs(t), _paragraphs(u)))
    assert got[503].fingerprint == got[504].fingerprint and got[500].fingerprint == got[501].fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({tuple(sorted(_paragraphs(t))) for t in texts.values()})
    assert got[600].near_edited > got[600].near_next


def test_sketches_are_retried_larger(spark, monkeypatch):
    """With parts that hold more than their cells, only the retries peel; the count is exact all the same."""
    monkeypatch.setattr(sketches, "PART", 40)
    a, b = (np.random.default_rng(k).integers(-(1 << 62), 1 << 62, n).tolist() for k, n in ((1, 300), (2, 200)))
    rows = [(a, b), (a, a), (a, a[:-1]), (a + b, a), ([], a), ([], [])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for (x, y), r in zip(rows, df.withColumn("n", sketches.n_parts("a", "b")).withColumns({"p": sketches.sketched("a", "n"), "q": sketches.sketched("b", "n")}).select(sketches.likeness("a", "b", "p", "q").alias("l")).collect(), strict=True):
        assert r.l == pytest.approx(len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0)


def test_fingerprints_of_many_lines(spark):
    import time

    texts = {i: "\n".join(f"line {i} {k}" for k in range(30000)) for i in (1, 2)}
    began = time.time()
    got = {r.doc_id: r for r in sketches.fingerprints(frame(spark, texts)).collect()}
    assert time.time() - began < 60 and 0.3 < got[1].near_edited < 0.4 and got[1].near_next < 0.001


def test_fingerprints_of_few_and_repeated_rows(spark):
    one = sketches.fingerprints(frame(spark, {4: "a\nb"})).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sketches.fingerprints(frame(spark, {4: None}).limit(0)).count() == 0
    rows = [(1, "x y. z"), (1, "x y. z"), (1, "other"), (None, None), (None, "n"), (2, "")]
    got = sketches.fingerprints(spark.createDataFrame([(i, t, 3, "f") for i, t in rows], "doc_id long, text string, n_chars int, fingerprint string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 6}) == 1


# html


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a\n b<p>c", "a b\n\nc"),
        ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>", "- x\n- y\n\n  1. 1\n  2. 2"),
        ("<ol start=3><li>c<li>d</ol>", "3. c\n4. d"),
        ("<table><tr><th>name<th>n<tr><td>x<td>12<tr><td>longer</table>", "name    n\nx       12\nlonger"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
        ("a<div hidden>no</div><span style='display: none'>no</span><script>if (a<b) x</script>b", "ab"),
        ("<title>t</title><body>x<!-- c --><style>p{}</style>y", "xy"),
        ("<pre> k\n  l</pre>", " k\n  l"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<details><summary>s</summary>gone</details><details open><summary>t</summary>here</details>", "s\nt\nhere"),
        ("<b>a</b> <i>b</i>", "a b"),
        ("<table><tr><td rowspan=2>aa<td>b<tr><td>c</table>", "aa  b\n    c"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>very wide cell<td>z<tr><td>x<td>y<td>w</table>", "a  b\nvery wide cell  z\nx  y            w"),
        ("<svg><title>no</title><text>A</text><text>B</text><path d=x/></svg>c", "A\nB\nc"),
        ("x<math><mi>k</mi><annotation>no</annotation></math>", "xk"),
        ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no</div>", "yes"),
        ("<div style='display:none'>no<span style='visibility: visible'>no</span></div>y", "y"),
        ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
        ("<td>alone</td>", "alone"),
        ("</div></p>text<unclosed", "text"),
    ],
)
def test_pages_are_rendered(html, text):
    assert htmltext.render(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>T</title><p>Hello <b>you</b></html>", "Hello you"),
        ("<head><meta charset=utf-8><link rel=x><script>a</script>\nplain text<div>more</div>", "plain text\nmore"),
        ("<head><title>T</title><noscript><p>no</p></noscript><style>p{}</style><h1>x</h1>", "x"),
        ("<head><title>T</title></head><body>x", "x"),
        ("<head><template><div>no</div></template><br>x", "x"),
    ],
)
def test_a_head_ends_without_tags(html, text):
    assert htmltext.render(html) == text


def test_deep_and_broken_pages(spark):
    began = time.process_time()
    assert htmltext.render("<div>" * 100000 + "x") == "x"
    assert htmltext.render("<b>" * 50000 + "</p>" * 50000 + "x") == "x"
    assert htmltext.render("<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 5000).count("x") == 5000
    assert time.process_time() - began < 20  # in proportion to the tags; by their square it took minutes
    assert htmltext.render("<table><tr><td>" * 50 + "x").strip() == "x"
    pages = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old"), (2, None, "old")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in htmltext.extract(pages).collect()) == [(1, "a"), (2, ""), (2, "")]
    assert htmltext.extract(pages.limit(0)).count() == 0
