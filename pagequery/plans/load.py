"""Load queries over events as requests: server = user, cell = event type, service in thousands of seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import load as L
from .tables import REQUESTS_SQL, requests

#: Events are days apart for one user, so service is stretched to make queues: seconds of service for a unit of value.
STRETCH = 2000


def _queue(spark, d):
    r = requests(spark, d).select("event_id", "cell", "server", F.col("t").alias("arrival"), F.round(F.col("service") * STRETCH * 1e6).cast("long").alias("service"), "prompt")
    return L.fifo_finish(r, ["server"], ["arrival", "event_id"], "arrival", "service")


def _outcomes(spark, d):
    """Outcomes of the queue: every 50th fails, every 70th never finishes, the first token comes after a tenth of the service."""
    q = _queue(spark, d)
    never, bad = F.col("event_id") % 70 == 0, F.col("event_id") % 50 == 0
    s = lambda x: x / 1e6
    return q.select(
        "event_id",
        "cell",
        s(F.col("arrival")).alias("submit_t"),
        F.when(~never, s(F.col("finish") - F.round(F.col("service") * 0.9).cast("long"))).alias("first_token_t"),
        F.when(~never, s(F.col("finish"))).alias("finish_t"),
        (F.col("prompt") / 64).cast("long").alias("n_tokens"),
        F.when(bad & ~never, F.lit("failed")).alias("error"),
    )


def poisson_arrivals(spark, d):
    r = requests(spark, d).select("server", "event_id")
    gaps = r.withColumn("gap", L.exponential_gap(L.hashed_uniform(7, F.col("event_id")), F.lit(0.5)))
    return L.arrivals(gaps, ["server"], "event_id", "gap").select("server", "event_id", F.round("arrival", 6).alias("arrival"))


def fifo_finish(spark, d):
    return _queue(spark, d).select("event_id", "finish")


def inflight_depth(spark, d):
    return L.inflight(_queue(spark, d), ["server"], "arrival", "finish")


def inflight_sampled(spark, d):
    """Open requests at sampled times, each interval expanded to the samples in it: as a sampler thread would count."""
    q = _queue(spark, d)
    step = 6 * 3600 * 1_000_000
    first, last = F.ceil(F.col("arrival") / step), F.floor((F.col("finish") - 1) / step)
    hit = q.where(first <= last).select("server", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("sample"))
    return hit.groupBy("server", "sample").agg(F.count("*").alias("depth"))


def mean_inflight(spark, d):
    return L.mean_depth(_queue(spark, d), ["server"], "arrival", "finish").select("server", F.round("mean_inflight", 6).alias("mean_inflight"))


def cell_summary(spark, d):
    s = L.cell_summary(_outcomes(spark, d))
    whole = ["cell", "n_requests", "completed", "failed", "unfinished"]
    return s.select(*whole, *[F.round(c, 4).alias(c) for c in s.columns if c not in whole])


def _cells(spark, d):
    """Servers as cells of a sweep."""
    q = _queue(spark, d)
    span = (F.max("arrival") - F.min("arrival")) / 1e6
    window = (F.max("finish") - F.min("arrival")) / 1e6
    return q.groupBy("server").agg(F.count("*").alias("n"), F.try_divide(F.count("*"), span).alias("offered"), F.try_divide(F.count("*"), window).alias("served"), (F.avg("service") / 1e6).alias("service")).where("n > 1")


def saturation_flags(spark, d):
    c = _cells(spark, d)
    rho, stable = L.utilisation(F.col("offered"), F.col("served")), L.expected_stable(F.col("service"), F.col("offered"), F.col("n"))
    return c.select("server", F.round(rho, 6).alias("rho"), F.round(stable, 6).alias("expected"), (F.round(rho, 6) > F.round(stable * L.MARGIN, 6)).alias("saturated"))


def queue_prediction(spark, d):
    c = _cells(spark, d)
    return c.select("server", F.round(L.predicted_wait(F.col("n"), F.col("offered"), F.col("served")), 3).alias("wait"))


def capacity(spark, d):
    c = _cells(spark, d).withColumn("hot", L.utilisation(F.col("offered"), F.col("served")) > 1.01)
    rate = F.avg(F.when(F.col("hot"), F.col("served")))
    return c.agg(F.round(rate, 9).alias("capacity"), F.round(rate * F.avg("service"), 6).alias("over_serial"), F.count_if("hot").alias("n_saturated"))


def saturation_boundary(spark, d):
    c = _cells(spark, d).withColumn("hot", L.utilisation(F.col("offered"), F.col("served")) > 1.01).groupBy("n").agg(F.max("hot").alias("hot"))
    return L.boundary(c, "n", "hot").select(F.col("boundary").cast("double").alias("boundary"))


def decode_phase(spark, d):
    s = L.decode_phase(_outcomes(spark, d))
    return s.select("cell", *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99", "mean", "std", "min", "max")], "n", "p99_is_reliable")


def arrival_deciles(spark, d):
    q = _queue(spark, d)
    out = L.arrival_deciles(q, ["cell"], ["arrival", "event_id"], (F.col("finish") - F.col("arrival")) / 1e6)
    return out.select("cell", "decile", F.round("mean", 3).alias("mean"))


def stats_delta(spark, d):
    """Counters after a run less those before it: running totals of each cell between two days."""
    r = requests(spark, d)
    half = 1704067200000000 + 15 * 86_400_000_000
    before = r.where(F.col("t") < half).groupBy("cell").agg(F.count("*").alias("n"), F.sum("prompt").alias("tokens"))
    after = r.groupBy("cell").agg(F.count("*").alias("n2"), F.sum("prompt").alias("tokens2"))
    return after.join(before, "cell", "left").select("cell", (F.col("n2") - F.coalesce("n", F.lit(0))).alias("steps"), (F.col("tokens2") - F.coalesce("tokens", F.lit(0))).alias("tokens"))


def chunk_pairs(spark, d):
    """Chunked cells (odd events) beside unchunked ones (even events) of the same load."""
    r = requests(spark, d).groupBy("server", (F.col("event_id") % 2).alias("chunked")).agg(F.avg("service").alias("m"))
    a, b = r.where("chunked = 1").select("server", F.col("m").alias("x")), r.where("chunked = 0").select("server", F.col("m").alias("y"))
    return a.join(b, "server").select("server", F.round(F.try_divide("x", "y"), 6).alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (poisson_arrivals, fifo_finish, inflight_depth, inflight_sampled, mean_inflight, cell_summary, saturation_flags, queue_prediction, capacity, saturation_boundary, decode_phase, arrival_deciles, stats_delta, chunk_pairs)
}

_UPTO = "(PARTITION BY server ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)"
_Q = f"""WITH r AS ({REQUESTS_SQL}), a AS (SELECT event_id, cell, server, t AS arrival, round(service * {STRETCH} * 1e6)::BIGINT AS service, prompt FROM r),
s AS (SELECT *, sum(service) OVER {_UPTO} AS s FROM a), q AS (SELECT * EXCLUDE (s), (s + max(arrival - (s - service)) OVER {_UPTO})::BIGINT AS finish FROM s)"""
_O = f"""{_Q}, o AS (SELECT event_id, cell, arrival / 1e6 AS submit_t, CASE WHEN event_id % 70 <> 0 THEN (finish - round(service * 0.9)::BIGINT) / 1e6 END AS first_token_t,
CASE WHEN event_id % 70 <> 0 THEN finish / 1e6 END AS finish_t, prompt // 64 AS n_tokens, CASE WHEN event_id % 50 = 0 AND event_id % 70 <> 0 THEN 'failed' END AS error FROM q)"""
_C = f"""{_Q}, c AS (SELECT server, count(*) AS n, count(*) / ((max(arrival) - min(arrival)) / 1e6) AS offered, count(*) / ((max(finish) - min(arrival)) / 1e6) AS served, avg(service) / 1e6 AS service FROM q GROUP BY server HAVING count(*) > 1)"""
_W = "greatest(max(finish_t) - min(submit_t), 1e-9)"
_DONE = "finish_t IS NOT NULL AND error IS NULL"


def _pct(x: str, name: str, places: int) -> str:
    return ", ".join(f"round(quantile_cont({x}, {q}), {places}) AS {name}{n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))


ORACLE_SQL = {
    "poisson_arrivals": f"""WITH r AS ({REQUESTS_SQL}), u AS (SELECT server, event_id, ('0x' || substring(md5('7:' || event_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM r)
SELECT server, event_id, round(sum(-ln(1 - u) / 0.5) OVER (PARTITION BY server ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS arrival FROM u""",
    "fifo_finish": f"{_Q} SELECT event_id, finish FROM q",
    "inflight_depth": f"""{_Q}, m AS (SELECT server, arrival AS t, 1 AS delta FROM q UNION ALL SELECT server, finish, -1 FROM q), p AS (SELECT server, t, delta, sum(delta) AS change FROM m GROUP BY ALL)
SELECT server, t, delta, sum(change) OVER (PARTITION BY server ORDER BY t, delta DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM p""",
    "inflight_sampled": f"""{_Q}, k AS (SELECT unnest(range((SELECT min(arrival) // 21600000000 FROM q), (SELECT max(finish) // 21600000000 + 1 FROM q))) AS sample)
SELECT server, sample, count(*) AS depth FROM q JOIN k ON sample * 21600000000 >= arrival AND sample * 21600000000 < finish GROUP BY ALL""",
    "mean_inflight": f"{_Q} SELECT server, round(sum(finish - arrival) / greatest(max(finish) - min(arrival), 1e-9), 6) AS mean_inflight FROM q GROUP BY server",
    "cell_summary": f"""{_O} SELECT cell, count(*) AS n_requests, count(*) FILTER (WHERE {_DONE}) AS completed, count(*) FILTER (WHERE error IS NOT NULL) AS failed, count(*) FILTER (WHERE finish_t IS NULL AND error IS NULL) AS unfinished,
round(sum(n_tokens) / {_W}, 4) AS tokens_per_s, round(count(*) FILTER (WHERE {_DONE}) / {_W}, 4) AS completed_per_s, {_pct("first_token_t - submit_t", "ttft_", 4)}, {_pct(f"CASE WHEN {_DONE} THEN finish_t - submit_t END", "e2e_", 4)} FROM o GROUP BY cell""",
    "saturation_flags": f"{_C} SELECT server, round(offered / served, 6) AS rho, round(1 + service * offered / greatest(1, n), 6) AS expected, round(offered / served, 6) > round((1 + service * offered / greatest(1, n)) * 1.05, 6) AS saturated FROM c",
    "queue_prediction": f"{_C} SELECT server, round(n * (1 / served - 1 / offered), 3) AS wait FROM c",
    "capacity": f"{_C} SELECT round(avg(served) FILTER (WHERE offered / served > 1.01), 9) AS capacity, round(avg(served) FILTER (WHERE offered / served > 1.01) * avg(service), 6) AS over_serial, count(*) FILTER (WHERE offered / served > 1.01) AS n_saturated FROM c",
    "saturation_boundary": f"{_C}, g AS (SELECT n, bool_or(offered / served > 1.01) AS hot FROM c GROUP BY n), f AS (SELECT min(n) AS first FROM g WHERE hot) SELECT ((SELECT first FROM f) + (SELECT max(n) FROM g WHERE NOT hot AND n < (SELECT first FROM f))) / 2.0::DOUBLE AS boundary",
    "decode_phase": f"""{_O}, p AS (SELECT cell, finish_t - first_token_t AS x FROM o WHERE {_DONE} AND first_token_t IS NOT NULL)
SELECT cell, {_pct("x", "", 3)}, round(avg(x), 3) AS mean, round(coalesce(stddev_samp(x), 0), 3) AS std, round(min(x), 3) AS min, round(max(x), 3) AS max, count(*) AS n, count(*) >= 100 AS p99_is_reliable FROM p GROUP BY cell""",
    "arrival_deciles": f"{_Q}, t AS (SELECT cell, ntile(10) OVER (PARTITION BY cell ORDER BY arrival, event_id) AS decile, (finish - arrival) / 1e6 AS x FROM q) SELECT cell, decile::INTEGER AS decile, round(avg(x), 3) AS mean FROM t GROUP BY ALL",
    "stats_delta": f"WITH r AS ({REQUESTS_SQL}) SELECT cell, count(*) FILTER (WHERE t >= 1704067200000000 + 15 * 86400000000) AS steps, coalesce(sum(prompt) FILTER (WHERE t >= 1704067200000000 + 15 * 86400000000), 0)::BIGINT AS tokens FROM r GROUP BY cell",
    "chunk_pairs": f"WITH r AS ({REQUESTS_SQL}) SELECT server, round(avg(service) FILTER (WHERE event_id % 2 = 1) / avg(service) FILTER (WHERE event_id % 2 = 0), 6) AS ratio FROM r GROUP BY server HAVING count(DISTINCT event_id % 2) = 2",
}
