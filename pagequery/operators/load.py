"""Load analytics of an open-loop server: arrivals, queueing in closed form, depth, saturation, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import percentiles

#: A cell is saturated beyond so many times the utilisation that a stable one shows.
MARGIN = 1.05
#: The shortest window that rates are taken over, seconds.
SHORTEST = 1e-9


def arrivals(gaps: DataFrame, by: list[str], order: str, gap: str, name: str = "arrival") -> DataFrame:
    """Arrival times: running sums of the gaps of each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return gaps.withColumn(name, F.sum(gap).over(w))


def exponential_gap(uniform: Column, rate: Column) -> Column:
    """A Poisson gap from a uniform number in [0, 1): -ln(1 - u) / rate."""
    return F.when(rate > 0, -F.log1p(-uniform) / rate).otherwise(F.raise_error(F.lit("rate must be positive")).cast("double"))


def hashed_uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that the seed and the key alone decide: 13 hexadecimal digits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def fifo_finish(requests: DataFrame, by: list[str], order: list[str], arrival: str, service: str) -> DataFrame:
    """`finish` of each request at a single first-in first-out server of its group.

    The recurrence finish = max(arrival, finish before) + service has the closed form S_k + max over j <= k of
    (arrival_j - S_{j-1}), S being running sums of service: two window passes, no loop.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    with_sum = requests.withColumn("_s", F.sum(service).over(upto))
    return with_sum.withColumn("finish", F.col("_s") + F.max(F.col(arrival) - (F.col("_s") - F.col(service))).over(upto)).drop("_s")


def inflight(requests: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by, t, depth): how many requests are open after every start and end, by a sweep over both; at one instant starts come first."""
    marks = requests.select(*by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("delta")))).alias("m")).select(*by, "m.*")
    per = marks.groupBy(*by, "t", "delta").agg(F.sum("delta").alias("change"))
    w = Window.partitionBy(*by).orderBy("t", F.desc("delta")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*by, "t", "delta", F.sum("change").over(w).alias("depth"))


def mean_depth(requests: DataFrame, by: list[str], start: str, end: str) -> Column | DataFrame:
    """Mean number of open requests over the window of each group: time in system by window length (Little's law)."""
    window = F.max(end) - F.min(start)
    return requests.groupBy(*by).agg((F.sum(F.col(end) - F.col(start)) / F.greatest(window, F.lit(SHORTEST))).alias("mean_inflight"))


def cell_summary(outcomes: DataFrame, by: str = "cell") -> DataFrame:
    """A row for each cell of outcomes (submit_t, first_token_t, finish_t, n_tokens, error).

    Completed requests finished without an error; the window goes from the first submission to the last finish.
    Time to the first token counts failed requests that sent one, end-to-end time does not.
    """
    done = F.col("finish_t").isNotNull() & F.col("error").isNull()
    window = F.greatest(F.max("finish_t") - F.min("submit_t"), F.lit(SHORTEST))
    ttft = F.col("first_token_t") - F.col("submit_t")
    e2e = F.when(done, F.col("finish_t") - F.col("submit_t"))
    named = lambda prefix, x: [c.alias(f"{prefix}_{n}") for c, n in zip(percentiles(x), ("p50", "p95", "p99", "mean", "std", "min", "max", "n", "reliable"), strict=True)]
    return outcomes.groupBy(by).agg(
        F.count("*").alias("n_requests"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("finish_t").isNull() & F.col("error").isNull()).alias("unfinished"),
        (F.sum("n_tokens") / window).alias("tokens_per_s"),
        (F.count_if(done) / window).alias("completed_per_s"),
        *named("ttft", ttft)[:3],
        *named("e2e", e2e)[:3],
    )


def utilisation(offered: Column, served: Column) -> Column:
    """Offered rate by served rate; without any service infinite."""
    return F.when(served > 0, F.try_divide(offered, served)).otherwise(F.lit(float("inf")))


def expected_stable(service: Column, offered: Column, n: Column) -> Column:
    """What a cell shows that keeps up: its window is one service time longer than its arrivals."""
    return 1.0 + service * offered / F.greatest(F.lit(1), n)


def saturated(offered: Column, served: Column, service: Column, n: Column) -> Column:
    return utilisation(offered, served) > expected_stable(service, offered, n) * MARGIN


def predicted_wait(n: Column, offered: Column, served: Column) -> Column:
    """How long the last of n requests waits at a saturated server."""
    return n * (F.try_divide(F.lit(1.0), served) - F.try_divide(F.lit(1.0), offered))


def decode_phase(outcomes: DataFrame, by: str = "cell") -> DataFrame:
    """Percentiles of finish - first token of each request, errors and gaps left out; not a difference of medians."""
    ok = outcomes.where("error IS NULL AND finish_t IS NOT NULL AND first_token_t IS NOT NULL")
    return ok.groupBy(by).agg(*percentiles(F.col("finish_t") - F.col("first_token_t")))


def arrival_deciles(outcomes: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    """The mean of value in each tenth of the arrivals."""
    tenth = F.ntile(10).over(Window.partitionBy(*by).orderBy(*order))
    return outcomes.withColumn("decile", tenth).groupBy(*by, "decile").agg(F.avg(value).alias("mean"))


def boundary(cells: DataFrame, load: str, flag: str) -> DataFrame:
    """Midway between the last stable load and the first saturated one, over the few cells of a sweep; null without both."""
    edges = cells.agg(F.min(F.when(F.col(flag), F.col(load))).alias("first"), F.collect_list(F.when(~F.col(flag), F.col(load))).alias("stable"))
    below = F.array_max(F.filter("stable", lambda x: x < F.col("first")))
    return edges.select(((F.col("first") + below) / 2).alias("boundary"))
