"""Queries of the record analytics, over events: arm = event_type, session = user_id % 5, order = event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import stats as A
from .tables import REQUESTS_SQL, requests, table

_P = ["p50", "p95", "p99", "mean", "std", "min", "max"]


def _rounded(df, keys, names, places=6):
    return df.select(*keys, *[F.round(n, places).alias(n) for n in names], *[c for c in df.columns if c not in (*keys, *names)])


def latency_percentiles(spark, d):
    return _rounded(requests(spark, d).groupBy("cell").agg(*A.percentiles(F.col("service"))), ["cell"], _P)


def single_sample_percentiles(spark, d):
    return _rounded(requests(spark, d).groupBy("event_id").agg(*A.percentiles(F.col("service"))), ["event_id"], _P)


def token_mix_summary(spark, d):
    """Interpolated median, mean, extremes and the truncated median of text lengths by language."""
    n = F.length("text").cast("double")
    return table(spark, d, "documents").groupBy("lang").agg(F.percentile(n, F.lit(0.5)).alias("median"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.percentile(n, F.lit(0.5)).cast("int").alias("median_int"))


def median_upper(spark, d):
    return A.upper_median(requests(spark, d), ["cell"], "service", "event_id")


def index_percentiles(spark, d):
    r = requests(spark, d)
    low = A.at_index(r, ["cell"], "service", "event_id", F.floor(F.col("n") / 10), "p10")
    high = A.at_index(r, ["cell"], "service", "event_id", F.floor(9 * F.col("n") / 10), "p90")
    return low.join(high, "cell")


def last_write_wins(spark, d):
    return A.last_write(requests(spark, d), ["session", "cell"], "event_id").select("session", "cell", "event_id", "service")


def superseded_rows(spark, d):
    return requests(spark, d).groupBy("cell").agg((F.count("*") - 1).alias("n_superseded"))


def coverage_missing(spark, d):
    """Which of all arms no row of a server has measured."""
    r = requests(spark, d)
    arms = r.select("cell").distinct()
    return A.missing(r.select("server").distinct().join(F.broadcast(arms)), r.select("server", "cell").distinct(), ["server", "cell"])


def coverage_elsewhere(spark, d):
    """Arms missing for a server that other servers of its session have."""
    r = requests(spark, d)
    gone = coverage_missing(spark, d).withColumn("session", F.col("server") % 5)
    return gone.join(r.select("session", "cell").distinct(), ["session", "cell"], "left_semi").select("server", "cell")


def sessions_by_coverage(spark, d):
    return requests(spark, d).groupBy("session").agg(F.count_distinct("cell").alias("n_cells"), F.count_distinct("server").alias("n_servers")).orderBy(F.desc("n_cells"), "session")


def extras_cross(spark, d):
    """The full grid of session and arm, less what was asked for."""
    r = requests(spark, d)
    grid = r.select("session").distinct().join(F.broadcast(r.select("cell").distinct()))
    return grid.exceptAll(r.where("cell = 'view' OR session = 0").select("session", "cell").distinct())


def labels_also_missing(spark, d):
    r = requests(spark, d)
    return r.select("cell").intersect(coverage_missing(spark, d).select("cell"))


def completed_manifest(spark, d):
    """A manifest of done cells, one more added and some retired."""
    r = requests(spark, d)
    done = r.where("session = 0").select("server").distinct().union(r.where("session = 1").select("server").distinct()).distinct()
    return done.subtract(r.where("prompt = 0").select("server"))


def comparable_fields(spark, d):
    r = requests(spark, d).withColumn("width", F.lit("fp16")).withColumn("odd", F.when(F.col("event_id") % 100 == 0, F.lit(None)).otherwise(F.col("event_id") % 2))
    return A.comparable(r, ["cell", "session", "width", "odd"], "event_id")


def ratio_to_anchor(spark, d):
    per = requests(spark, d).groupBy("session", "cell").agg(F.avg("service").alias("mean_service"))
    out = A.ratio_to_anchor(per, "session", "cell", "mean_service", "view")
    return out.select("session", "cell", F.round("mean_service", 6).alias("mean_service"), F.round("ratio", 6).alias("ratio"))


def paired_ratio(spark, d):
    """Requests of a server paired by their number in two arms."""
    from pyspark.sql import Window

    r = requests(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("server", "cell").orderBy("event_id")))
    a, b = r.where("cell = 'click'"), r.where("cell = 'view'")
    a, b = a.select("server", "i", F.col("service").alias("x")), b.select("server", "i", F.col("service").alias("y"))
    return a.join(b, ["server", "i"]).select("server", "i", F.round(F.try_divide("x", "y"), 6).alias("ratio"))


def distinct_sessions(spark, d):
    return requests(spark, d).groupBy("cell").agg(F.count_distinct("session").alias("n_sessions"), F.array_join(F.array_sort(F.collect_set("session")), ",").alias("sessions"))


def adequate_rows(spark, d):
    """Rows that asked for enough, where the request is recorded for some only."""
    r = requests(spark, d).withColumn("n_requested", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("prompt")))
    ok = (F.coalesce("n_requested", F.col("server")) >= 100) & (F.coalesce(F.lit(None).cast("int"), F.lit(3)) >= 3)
    return r.groupBy("cell").agg(F.count_if(ok).alias("n_adequate"), F.count_if(~ok).alias("n_thin"))


def thin_rows(spark, d):
    r = requests(spark, d).groupBy("server").agg(F.count("*").alias("n"), F.count_if(F.col("service") > 50).alias("n_scored"))
    return r.select("server", "n", "n_scored", (F.col("n_scored") < 0.5 * F.col("n")).alias("thin"))


def trial_violations(spark, d):
    """Trials that break a rule, and the first rule they break."""
    r = requests(spark, d)
    rule = F.when(F.col("service") < 1, "ttft").when(F.col("prompt") == 0, "steps").when(~F.col("cell").isin("click", "view", "purchase", "signup", "logout"), "mode")
    return r.withColumn("rule", rule).where("rule IS NOT NULL").select("event_id", "rule")


def monotone_check(spark, d):
    """Where the mean over prompts falls as the prompt grows, and whether the noise allows to say so."""
    from pyspark.sql import Window

    per = requests(spark, d).groupBy("prompt").agg(F.avg("service").alias("m"), F.stddev_samp("service").alias("s"))
    w = Window.orderBy("prompt")  # one row for each of the few prompt lengths
    out = per.withColumn("before", F.lag("m").over(w))
    return out.select("prompt", F.coalesce(F.round("m", 6) < F.round("before", 6), F.lit(False)).alias("falls"), (F.round(F.coalesce(F.try_divide("s", "m"), F.lit(0.0)), 6) > 0.10).alias("noisy"))


def max_residual(spark, d):
    r = requests(spark, d).where((F.col("cell") == "view") & (F.col("service") > 0) & (F.col("session") < 3))
    return r.agg(F.round(F.max("service"), 6).alias("residual"), F.count("*").alias("n"))


def label_derivation(spark, d):
    r = requests(spark, d).withColumn("bits", F.when(F.col("session") == 0, 16).when(F.col("session") < 3, 8).otherwise(4))
    return r.select("event_id", S.arm_label(F.col("cell"), F.col("bits")).alias("label"), S.cell_name(F.col("session") * 0.5, F.when(F.col("prompt") > 3000, F.col("prompt"))).alias("cell_name"))


def label_inverse(spark, d):
    labels = label_derivation(spark, d).select("label").distinct()
    return labels.select("label", S.label_bits(F.col("label")).alias("bits"), S.label_arm(F.col("label")).alias("arm"))


def mode_best(spark, d):
    """The server of each arm with the largest total, the first one of equals."""
    per = requests(spark, d).groupBy("cell", "server").agg(F.round(F.sum("service"), 4).alias("total"))
    return per.groupBy("cell").agg(F.max_by("server", F.struct("total", (-F.col("server")).alias("first"))).alias("server"), F.max("total").alias("total"))


def max_feasible_batch(spark, d):
    """The largest batch before the first that fails, batch sizes standing for k and failure for service over 95."""
    per = requests(spark, d).groupBy("cell", (F.col("prompt") / 64 + 1).cast("long").alias("batch")).agg(F.max("service").alias("m"))
    limit = per.groupBy("cell").agg(F.min(F.when(F.col("m") > 99, F.col("batch"))).alias("fails"), F.max("batch").alias("top"))
    ok = per.join(limit, "cell").where(F.col("batch") < F.coalesce("fails", F.col("top") + 1))
    return limit.join(ok.groupBy("cell").agg(F.max("batch").alias("batch")), "cell", "left").select("cell", F.coalesce("batch", F.lit(0)).cast("long").alias("batch"))


QUERIES = {
    f.__name__: f
    for f in (latency_percentiles, single_sample_percentiles, token_mix_summary, median_upper, index_percentiles, last_write_wins, superseded_rows, coverage_missing, coverage_elsewhere, sessions_by_coverage, extras_cross, labels_also_missing, completed_manifest, comparable_fields, ratio_to_anchor, paired_ratio, distinct_sessions, adequate_rows, thin_rows, trial_violations, monotone_check, max_residual, label_derivation, label_inverse, mode_best, max_feasible_batch)
}

_R = f"WITH r AS ({REQUESTS_SQL})"
_PCT = """round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.95), 6) AS p95, round(quantile_cont({v}, 0.99), 6) AS p99, round(avg({v}), 6) AS mean,
round(coalesce(stddev_samp({v}), 0), 6) AS std, round(min({v}), 6) AS min, round(max({v}), 6) AS max, count({v}) AS n, count({v}) >= 100 AS p99_is_reliable"""
_MISSING = "m AS (SELECT server, cell FROM (SELECT DISTINCT server FROM r) CROSS JOIN (SELECT DISTINCT cell FROM r) EXCEPT SELECT server, cell FROM r)"
_LABELS = """l AS (SELECT event_id, CASE WHEN session = 0 THEN 'fp16' ELSE cell || '@int' || CASE WHEN session < 3 THEN 8 ELSE 4 END END AS label,
'load' || printf('%g', session * 0.5) || '-' || CASE WHEN prompt > 3000 THEN 'chunk' || prompt ELSE 'unchunked' END AS cell_name FROM r)"""


def _index_sql(i: str) -> str:
    return f"(SELECT cell, service FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY service, event_id) - 1 AS a, count(*) OVER (PARTITION BY cell) AS n FROM r) WHERE a = {i})"


ORACLE_SQL = {
    "latency_percentiles": f"{_R} SELECT cell, {_PCT.format(v='service')} FROM r GROUP BY cell",
    "single_sample_percentiles": f"{_R} SELECT event_id, {_PCT.format(v='service')} FROM r GROUP BY event_id",
    "token_mix_summary": "SELECT lang, quantile_cont(length(text)::DOUBLE, 0.5) AS median, round(avg(length(text)), 6) AS mean, min(length(text))::DOUBLE AS min, max(length(text))::DOUBLE AS max, trunc(quantile_cont(length(text)::DOUBLE, 0.5))::INTEGER AS median_int FROM documents GROUP BY lang",
    "median_upper": f"{_R} SELECT cell, service AS median_upper FROM {_index_sql('n // 2')}",
    "index_percentiles": f"{_R} SELECT a.cell, a.service AS p10, b.service AS p90 FROM {_index_sql('n // 10')} a JOIN {_index_sql('9 * n // 10')} b USING (cell)",
    "last_write_wins": f"{_R} SELECT session, cell, event_id, service FROM r QUALIFY row_number() OVER (PARTITION BY session, cell ORDER BY event_id DESC) = 1",
    "superseded_rows": f"{_R} SELECT cell, count(*) - 1 AS n_superseded FROM r GROUP BY cell",
    "coverage_missing": f"{_R}, {_MISSING} SELECT * FROM m",
    "coverage_elsewhere": f"{_R}, {_MISSING} SELECT server, cell FROM m WHERE EXISTS (SELECT 1 FROM r WHERE r.session = m.server % 5 AND r.cell = m.cell)",
    "sessions_by_coverage": f"{_R} SELECT session, count(DISTINCT cell) AS n_cells, count(DISTINCT server) AS n_servers FROM r GROUP BY session",
    "extras_cross": f"{_R} SELECT session, cell FROM (SELECT DISTINCT session FROM r) CROSS JOIN (SELECT DISTINCT cell FROM r) EXCEPT SELECT session, cell FROM r WHERE cell = 'view' OR session = 0",
    "labels_also_missing": f"{_R}, {_MISSING} SELECT cell FROM r INTERSECT SELECT cell FROM m",
    "completed_manifest": f"{_R} SELECT server FROM r WHERE session = 0 OR session = 1 EXCEPT SELECT server FROM r WHERE prompt = 0",
    "comparable_fields": f"""{_R}, l AS (SELECT event_id, unnest(['cell', 'session', 'width', 'odd']) AS field, unnest([cell, session::VARCHAR, 'fp16', CASE WHEN event_id % 100 = 0 THEN NULL ELSE (event_id % 2)::VARCHAR END]) AS v FROM r),
f AS (SELECT field, v AS w FROM l WHERE event_id = (SELECT min(event_id) FROM r))
SELECT field, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_distinct, count(*) FILTER (WHERE v IS DISTINCT FROM w) AS n_differing, count(*) FILTER (WHERE v IS DISTINCT FROM w) = 0 AS comparable FROM l JOIN f USING (field) GROUP BY field""",
    "ratio_to_anchor": f"{_R}, p AS (SELECT session, cell, avg(service) AS m FROM r GROUP BY ALL) SELECT p.session, p.cell, round(p.m, 6) AS mean_service, round(p.m / a.m, 6) AS ratio FROM p LEFT JOIN (SELECT session, m FROM p WHERE cell = 'view') a USING (session)",
    "paired_ratio": f"{_R}, i AS (SELECT *, row_number() OVER (PARTITION BY server, cell ORDER BY event_id) AS i FROM r) SELECT a.server, a.i, round(CASE WHEN b.service = 0 THEN NULL ELSE a.service / b.service END, 6) AS ratio FROM i a JOIN i b ON a.server = b.server AND a.i = b.i WHERE a.cell = 'click' AND b.cell = 'view'",
    "distinct_sessions": f"{_R} SELECT cell, count(DISTINCT session) AS n_sessions, string_agg(DISTINCT session::VARCHAR, ',' ORDER BY session::VARCHAR) AS sessions FROM r GROUP BY cell",
    "adequate_rows": f"{_R}, a AS (SELECT cell, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE prompt END, server) >= 100 AS ok FROM r) SELECT cell, count(*) FILTER (WHERE ok) AS n_adequate, count(*) FILTER (WHERE NOT ok) AS n_thin FROM a GROUP BY cell",
    "thin_rows": f"{_R} SELECT server, count(*) AS n, count(*) FILTER (WHERE service > 50) AS n_scored, count(*) FILTER (WHERE service > 50) < 0.5 * count(*) AS thin FROM r GROUP BY server",
    "trial_violations": f"{_R}, v AS (SELECT event_id, CASE WHEN service < 1 THEN 'ttft' WHEN prompt = 0 THEN 'steps' WHEN cell NOT IN ('click', 'view', 'purchase', 'signup', 'logout') THEN 'mode' END AS rule FROM r) SELECT * FROM v WHERE rule IS NOT NULL",
    "monotone_check": f"{_R}, p AS (SELECT prompt, avg(service) AS m, stddev_samp(service) AS s FROM r GROUP BY prompt) SELECT prompt, coalesce(round(m, 6) < round(lag(m) OVER (ORDER BY prompt), 6), false) AS falls, round(coalesce(s / m, 0), 6) > 0.10 AS noisy FROM p",
    "max_residual": f"{_R} SELECT round(max(service), 6) AS residual, count(*) AS n FROM r WHERE cell = 'view' AND service > 0 AND session < 3",
    "label_derivation": f"{_R}, {_LABELS} SELECT * FROM l",
    "label_inverse": f"{_R}, {_LABELS} SELECT DISTINCT label, CASE WHEN label = 'fp16' THEN 16 ELSE string_split(label, '@int')[2]::INTEGER END AS bits, CASE WHEN label = 'fp16' THEN 'fp16' ELSE string_split(label, '@')[1] END AS arm FROM l",
    "mode_best": f"{_R}, p AS (SELECT cell, server, round(sum(service), 4) AS total FROM r GROUP BY ALL) SELECT cell, server, total FROM p QUALIFY row_number() OVER (PARTITION BY cell ORDER BY total DESC, server) = 1",
    "max_feasible_batch": f"""{_R}, p AS (SELECT cell, prompt // 64 + 1 AS batch, max(service) AS m FROM r GROUP BY ALL), f AS (SELECT cell, min(batch) FILTER (WHERE m > 99) AS fails FROM p GROUP BY cell)
SELECT cell, coalesce(max(batch) FILTER (WHERE fails IS NULL OR batch < fails), 0) AS batch FROM p JOIN f USING (cell) GROUP BY cell""",
}
