"""Queries that build a workload out of documents, benchmark, labels, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import workload as W
from ..operators.retrieval import spread
from ..sources import ocr
from .retrieval import _gold
from .tables import table


def _corpus(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 10 < 3, "").otherwise(F.col("text"))
    return docs.select("doc_id", S.doc_key(F.col("source"), F.col("doc_id"), F.lit(0)).alias("doc_key"), "source", text.alias("text"), F.length(text).cast("long").alias("n_text_chars"))


def doc_key_dedup(spark, d):
    """Documents with one text are one page; the first stays."""
    return W.first_per_key(table(spark, d, "documents").withColumn("text_key", F.md5("text")), "text_key", ["doc_id"]).select("text_key", "doc_id")


def source_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    parts = [(docs.where("lang = 'en'"), 30), (docs.where("lang = 'fr'"), 20), (docs.where("lang = 'de'"), 0)]
    return W.limited_union(parts, "doc_id")


def source_branch(spark, d):
    """Fields that depend on the source: number, page, and whether there is text."""
    docs = table(spark, d, "documents")
    info = F.col("lang") == "en"
    return docs.select(
        "doc_id",
        F.when(info, F.concat(F.lit("img_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("own_id"),
        F.when(info, 0).otherwise((F.col("doc_id") % 7).cast("int")).alias("page_no"),
        F.when(info, S.truncated(F.col("text"), 20)).otherwise("").alias("head"),
    )


def docs_with_text(spark, d):
    return _corpus(spark, d).where("text <> ''").select("doc_key", "n_text_chars")


def corpus_summary(spark, d):
    c = _corpus(spark, d)
    per = c.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("text") != "").alias("n_with_text"), F.round(F.avg("n_text_chars"), 6).alias("mean_chars"))
    return per


def corpus_rollup(spark, d):
    docs = table(spark, d, "documents")
    return docs.rollup("source", "lang").agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n_docs"), F.sum(F.length("text").cast("long")).alias("n_chars"))


def coverage_gate(spark, d):
    """The share of each source's documents that have text, and whether it passes at 65 percent."""
    share = F.avg(F.when(F.col("text") != "", 1.0).otherwise(0.0))
    return _corpus(spark, d).groupBy("source").agg(F.round(share, 6).alias("share"), (F.round(share, 6) >= 0.65).alias("passes"))


def heldout_split(spark, d):
    held = W.heldout_keys(table(spark, d, "documents"), "doc_id").withColumn("held", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(held, "doc_id", "left").select("doc_id", F.when(F.col("held"), "heldout").otherwise("eval").alias("split"))


def heldout_prefix(spark, d):
    return heldout_split(spark, d).where("split = 'heldout'").orderBy("doc_id").limit(25).select("doc_id")


def _trace(spark, d):
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("doc_key"))
    return W.sampled_trace(_gold(spark, d), keys, 5), keys


def frozen_trace(spark, d):
    trace, _ = _trace(spark, d)
    return trace.select("query_id", "gold_doc_key", F.array_join(F.transform("retrieved", lambda x: x.cast("string")), ",").alias("retrieved"))


def trace_drop_missing(spark, d):
    queries = _gold(spark, d)
    keys = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("gold_doc_key"))
    return queries.join(keys, "gold_doc_key", "left_anti").select("query_id", "gold_doc_key")


def canonical_order(spark, d):
    """A trace's documents sorted by key, beside their order of relevance."""
    trace, _ = _trace(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return trace.select("query_id", text(F.col("retrieved")).alias("relevance"), text(F.array_sort("retrieved")).alias("canonical"))


def prompt_text(spark, d):
    trace, _ = _trace(spark, d)
    corpus = _corpus(spark, d).select(F.col("doc_id").alias("doc_key"), "text")
    got = W.resolved(trace, corpus).join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    text = S.prompt(F.col("question"), F.col("texts"))
    return got.select("query_id", F.size("keys").alias("n_docs"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha"))


def prompt_part_counts(spark, d):
    trace, _ = _trace(spark, d)
    corpus = _corpus(spark, d).select(F.col("doc_id").alias("doc_key"), "text")
    got = W.resolved(trace, corpus).join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    part = F.explode(S.prompt_parts(F.col("question"), F.col("keys"), F.col("texts"))).alias("p")
    return got.select("query_id", part).groupBy("query_id", F.col("p.type").alias("type")).agg(F.count("*").alias("n"))


def queries_per_doc(spark, d):
    per = _gold(spark, d).groupBy("gold_doc_key").agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("n_docs"), F.count_if(F.col("c") > 1).alias("n_multi"), F.max("c").alias("most"))


def row_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", W.row_fingerprint(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("sha"))


def table_fingerprint(spark, d):
    return W.table_fingerprint(table(spark, d, "documents"), "doc_id", "doc_id", "lang", "text")


def missing_embeddings(spark, d):
    """Documents that the cache of vectors lacks: the ones still to compute."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


# conversations


def last_user_message(spark, d):
    c = table(spark, d, "conversations")
    user = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return c.groupBy("conv_id").agg(F.coalesce(user, F.max_by("text", "turn")).alias("text"))


def chat_flatten(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat("role", F.lit(": "), "text").alias("line")
    flat = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line))).alias("m"))
    return flat.select("conv_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("chat"))


def text_delta(spark, d):
    """What each turn adds to the chat so far, as a stream of increments would send it."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    so_far = F.array_join(F.collect_list("text").over(w.rowsBetween(Window.unboundedPreceding, 0)), "\n")
    shown = c.withColumn("so_far", so_far)
    before = F.lag("so_far").over(w)
    return shown.withColumn("before", before).select("conv_id", "turn", F.md5(S.text_delta(F.col("so_far"), F.col("before"))).alias("delta_md5"))


def usage_counts(spark, d):
    c = table(spark, d, "conversations")
    n = F.size(F.split(F.col("text"), " ")).cast("long")
    prompt, completion = F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0))
    return c.groupBy("conv_id").agg(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"))


def finish_reasons(spark, d):
    """Turns as outputs of 'words': one that ends in a full stop has met its end token."""
    c = table(spark, d, "conversations")
    last = F.transform(F.split("text", ""), lambda x: x)
    return c.select("conv_id", "turn", S.finish_reason(F.filter(last, lambda x: x != ""), F.lit(".")).alias("reason"))


def request_rejects(spark, d):
    """Requests that ask for sampling that greedy decoding cannot give, by reason."""
    c = table(spark, d, "conversations").where("role = 'user'")
    t, p, n = (F.col("turn") % 3) * 0.5, 1.0 - (F.col("conv_id") % 4) * 0.1, F.col("conv_id") % 5
    reason = F.when(t > 0, "temperature").when(p < 1, "top_p").when(n > 1, "n")
    return c.select("conv_id", "turn", F.coalesce(reason, F.lit("ok")).alias("reason"))


def _printable():
    return S.ascii_folded(F.col("text"))


def levenshtein_pairs(spark, d):
    c = spread(table(spark, d, "conversations")).select("conv_id", "turn", _printable().alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.levenshtein("t", "u").cast("long").alias("distance"))


def anls_scores(spark, d):
    """Each turn against two answers: the next turn, and itself from a character on that follows from its number."""
    c = spread(table(spark, d, "conversations")).select("conv_id", "turn", "role", _printable().alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    both = c.join(nxt, ["conv_id", "turn"], "left")
    golds = F.filter(F.array(F.col("u"), F.substring("t", F.lit(1) + (F.col("turn") * 7 % 30).cast("int"), F.length("t"))), lambda x: x.isNotNull())
    return both.select("conv_id", "turn", "role", F.round(S.anls(F.col("t"), golds), 6).alias("anls"))


def anls_by_group(spark, d):
    return anls_scores(spark, d).groupBy("role").agg(F.round(F.avg("anls"), 5).alias("mean_anls"), F.count("*").alias("n"))


# pages


def page_lines(spark, d):
    """Lines of paragraph text of a page, tags and scripts off."""
    p = table(spark, d, "pages")
    body = F.regexp_replace(F.regexp_replace("html", "<script>[^<]*</script>|<style>[^<]*</style>", ""), "<[^>]*>", "\n")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(x) > 0)
    return p.select("page_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("md5"))


def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


def ocr_lines(spark, d):
    """A plain JSON container of each document's lines, read back in the JVM."""
    docs = table(spark, d, "documents")
    block = F.struct(F.lit("LINE").alias("BlockType"), F.col("text").alias("Text"))
    word = F.struct(F.lit("WORD").alias("BlockType"), F.lit("w").alias("Text"))
    payload = F.to_json(F.struct(F.array(block, word).alias("Blocks")))
    return docs.select("doc_id", F.md5(ocr.lines_native(payload)).alias("md5"))


QUERIES = {
    f.__name__: f
    for f in (doc_key_dedup, source_union, source_branch, docs_with_text, corpus_summary, corpus_rollup, coverage_gate, heldout_split, heldout_prefix, frozen_trace, trace_drop_missing, canonical_order, prompt_text, prompt_part_counts, queries_per_doc, row_fingerprint, table_fingerprint, missing_embeddings, last_user_message, chat_flatten, text_delta, usage_counts, finish_reasons, request_rejects, levenshtein_pairs, anls_scores, anls_by_group, page_lines, slugs, ocr_lines)
}

_CORPUS = "c AS (SELECT doc_id, source, source || ':' || doc_id || ':0' AS doc_key, CASE WHEN doc_id % 10 < 3 THEN '' ELSE text END AS text FROM documents)"
_GOLD = "g AS (SELECT item_id AS query_id, min(doc_id) AS gold_doc_key FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"
_SPLIT = "h AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('1234:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.25) THEN 'heldout' ELSE 'eval' END AS split FROM documents)"
_TRACE = f"""{_GOLD}, kn AS (SELECT * FROM g),
dr AS (SELECT query_id, gold_doc_key, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('1234:' || query_id || ':' || doc_id), doc_id) AS rn FROM kn JOIN (SELECT doc_id FROM documents) ON doc_id <> gold_doc_key),
tr AS (SELECT query_id, gold_doc_key AS doc_id, 0 AS rn FROM kn UNION ALL SELECT query_id, doc_id, rn FROM dr WHERE rn <= 4)"""
_PAIR = "t AS (SELECT conv_id, turn, role, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM conversations)"
_SIM = "CASE WHEN greatest(length(lower(trim({0}))), length(lower(trim({1})))) = 0 THEN 1.0 ELSE 1.0 - levenshtein(lower(trim({0})), lower(trim({1}))) / greatest(length(lower(trim({0}))), length(lower(trim({1}))))::DOUBLE END"
_ANLS = f"""{_PAIR}, p AS (SELECT a.*, b.t AS u, substring(a.t, 1 + (a.turn * 7 % 30)::INTEGER) AS v FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
s AS (SELECT conv_id, turn, role, greatest(coalesce({_SIM.format("t", "u")}, 0), {_SIM.format("t", "v")}) AS x FROM p), an AS (SELECT conv_id, turn, role, round(CASE WHEN x >= 0.5 THEN x ELSE 0 END, 6) AS anls FROM s)"""
_N = "len(string_split(text, ' '))"
_LINES = "list_filter(string_split(regexp_replace(regexp_replace(html, '<script>[^<]*</script>|<style>[^<]*</style>', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: length(x) > 0)"

ORACLE_SQL = {
    "doc_key_dedup": "SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "source_union": "(SELECT doc_id, source, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 30) UNION ALL (SELECT doc_id, source, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20)",
    "source_branch": "SELECT doc_id, CASE WHEN lang = 'en' THEN 'img_' || doc_id ELSE doc_id::VARCHAR END AS own_id, CASE WHEN lang = 'en' THEN 0 ELSE doc_id % 7 END::INTEGER AS page_no, CASE WHEN lang = 'en' THEN substring(text, 1, 20) ELSE '' END AS head FROM documents",
    "docs_with_text": f"WITH {_CORPUS} SELECT doc_key, length(text) AS n_text_chars FROM c WHERE text <> ''",
    "corpus_summary": f"WITH {_CORPUS} SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE text <> '') AS n_with_text, round(avg(length(text)), 6) AS mean_chars FROM c GROUP BY source",
    "corpus_rollup": "SELECT source, lang, grouping(source, lang) AS gid, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (source, lang)",
    "coverage_gate": f"WITH {_CORPUS}, s AS (SELECT source, round(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END), 6) AS share FROM c GROUP BY source) SELECT source, share, share >= 0.65 AS passes FROM s",
    "heldout_split": f"WITH {_SPLIT} SELECT doc_id, split FROM h",
    "heldout_prefix": f"WITH {_SPLIT} SELECT doc_id FROM h WHERE split = 'heldout' ORDER BY doc_id LIMIT 25",
    "frozen_trace": f"WITH {_TRACE} SELECT query_id, first(doc_id ORDER BY rn) AS gold_doc_key, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) AS retrieved FROM tr GROUP BY query_id",
    "trace_drop_missing": f"WITH {_GOLD} SELECT query_id, gold_doc_key FROM g WHERE gold_doc_key NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "canonical_order": f"WITH {_TRACE} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) AS relevance, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS canonical FROM tr GROUP BY query_id",
    "prompt_text": f"""WITH {_TRACE}, {_CORPUS}, x AS (SELECT query_id, rn, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS i, c.text FROM tr JOIN c USING (doc_id)),
y AS (SELECT query_id, count(*)::INTEGER AS n_docs, string_agg('Document ' || i || ':' || CASE WHEN text <> '' THEN chr(10) || substring(text, 1, 1500) ELSE '' END, chr(10) ORDER BY i) AS p FROM x GROUP BY query_id),
z AS (SELECT query_id, n_docs, p || chr(10) || 'Question: ' || b.text || chr(10) || 'Answer:' AS t FROM y JOIN benchmark b ON b.item_id = query_id)
SELECT query_id, n_docs, length(t) AS n_chars, sha256(t) AS sha FROM z""",
    "prompt_part_counts": f"""WITH {_TRACE}, {_CORPUS}, x AS (SELECT query_id, c.text FROM tr JOIN c USING (doc_id))
SELECT query_id, 'image' AS type, count(*) AS n FROM x GROUP BY query_id UNION ALL SELECT query_id, 'text', 1 + count(*) + count(*) FILTER (WHERE text <> '') FROM x GROUP BY query_id""",
    "queries_per_doc": f"WITH {_GOLD}, p AS (SELECT gold_doc_key, count(*) AS c FROM g GROUP BY 1) SELECT count(*) AS n_docs, count(*) FILTER (WHERE c > 1) AS n_multi, max(c) AS most FROM p",
    "row_fingerprint": "SELECT doc_id, sha256(doc_id || '|' || lang || '|' || source || '|' || text) AS sha FROM documents",
    "table_fingerprint": """WITH r AS (SELECT doc_id // 1000 AS g, doc_id, sha256(doc_id || '|' || lang || '|' || text) AS h FROM documents),
q AS (SELECT g, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM r GROUP BY g) SELECT substring(sha256(string_agg(h, '' ORDER BY g)), 1, 16) AS fingerprint FROM q""",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "last_user_message": "SELECT conv_id, coalesce(max_by(text, turn) FILTER (WHERE role = 'user'), max_by(text, turn)) AS text FROM conversations GROUP BY conv_id",
    "chat_flatten": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id",
    "text_delta": "SELECT conv_id, turn, md5(CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN text ELSE chr(10) || text END) AS delta_md5 FROM conversations",
    "usage_counts": f"SELECT conv_id, coalesce(sum({_N}) FILTER (WHERE role <> 'assistant'), 0)::BIGINT AS prompt_tokens, coalesce(sum({_N}) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS completion_tokens, sum({_N})::BIGINT AS total_tokens FROM conversations GROUP BY conv_id",
    "finish_reasons": "SELECT conv_id, turn, CASE WHEN text LIKE '%.' THEN 'stop' ELSE 'length' END AS reason FROM conversations",
    "request_rejects": "SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN 'temperature' WHEN conv_id % 4 > 0 THEN 'top_p' WHEN conv_id % 5 > 1 THEN 'n' ELSE 'ok' END AS reason FROM conversations WHERE role = 'user'",
    "levenshtein_pairs": f"WITH {_PAIR} SELECT a.conv_id, a.turn, levenshtein(a.t, b.t) AS distance FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn",
    "anls_scores": f"WITH {_ANLS} SELECT * FROM an",
    "anls_by_group": f"WITH {_ANLS} SELECT role, round(avg(anls), 5) AS mean_anls, count(*) AS n FROM an GROUP BY role",
    "page_lines": f"SELECT page_id, len({_LINES}) AS n_lines, md5(array_to_string({_LINES}, chr(10))) AS md5 FROM pages",
    "slugs": "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS slug FROM pages",
    "ocr_lines": "SELECT doc_id, md5(text) AS md5 FROM documents",
}
