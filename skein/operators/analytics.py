"""Latency, cost and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars for a million tokens in and out, by model. Other models cost nothing.
PRICES = (
    ("claude-3-5-sonnet", 3.0, 15.0), ("claude-3-5-sonnet-latest", 3.0, 15.0), ("claude-3-5-sonnet-20240620", 3.0, 15.0), ("claude-3-5-sonnet-20241022", 3.0, 15.0),
    ("claude-3-opus", 15.0, 75.0), ("claude-3-opus-20240229", 15.0, 75.0),
    ("claude-3-5-haiku", 1.0, 5.0), ("claude-3-5-haiku-latest", 1.0, 5.0), ("claude-3-5-haiku-20241022", 1.0, 5.0),
)


def call_costs(calls: DataFrame, model: str = "model", tokens_in: str = "input", tokens_out: str = "output") -> DataFrame:
    """calls with usd, by a broadcast join to the price table."""
    prices = calls.sparkSession.createDataFrame(list(PRICES), f"{model} string, __in double, __out double")
    usd = F.coalesce((F.col(tokens_in) * F.col("__in") + F.col(tokens_out) * F.col("__out")) / 1_000_000, F.lit(0.0))
    return calls.join(F.broadcast(prices), model, "left").withColumn("usd", usd).drop("__in", "__out")


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.round(F.sum("usd"), 6).alias("usd"))


def percentile_nearest(rows: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """Nearest rank: the value at place ceil(share * n)."""
    return rows.groupBy(*by).agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(q * 100)}") for q in shares))


def percentile_linear(value: str, share: float) -> Column:
    return F.percentile(value, share)


def benchmark_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Over batches (duration_us, operation_count, success_count): totals, the mean by operation, percentiles of each batch's duration by operation, throughput and success rate."""
    each = F.col("duration_us") / F.col("operation_count")
    out = rows.withColumn("each", each).groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("operation_count").alias("operations"),
        F.sum("success_count").alias("successes"),
        F.sum("duration_us").alias("total_us"),
        F.min("each").alias("min_us"),
        *(F.percentile("each", q).alias(n) for n, q in (("p50_us", 0.5), ("p95_us", 0.95), ("p99_us", 0.99))),
        F.max("each").alias("max_us"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("errors", F.col("operations") - F.col("successes")).withColumn("mean_us", ratio("total_us", "operations")).withColumn("per_second", ratio("operations", "total_us") * 1e6).withColumn("success_rate", ratio("successes", "operations"))


def benchmark_compare(baseline: DataFrame, current: DataFrame, name: str, most_slower: float = 10.0, most_less: float = 10.0) -> DataFrame:
    """Change of p95 and loss of throughput in percent, with what regressed. A scenario that only one side has fails."""
    b = baseline.select(name, *(F.col(c).alias(f"b_{c}") for c in ("p95_us", "per_second", "success_rate")))
    c = current.select(name, *(F.col(x).alias(f"c_{x}") for x in ("p95_us", "per_second", "success_rate")))
    rows = b.join(c, name, "full_outer")
    slower = (F.col("c_p95_us") - F.col("b_p95_us")) / F.col("b_p95_us") * 100
    less = (F.col("b_per_second") - F.col("c_per_second")) / F.col("b_per_second") * 100
    both = F.col("b_p95_us").isNotNull() & F.col("c_p95_us").isNotNull()
    flags = [(slower > most_slower + 1e-9).alias("latency_regressed"), (less > most_less + 1e-9).alias("throughput_regressed"), (F.col("c_success_rate") + 1e-9 < F.col("b_success_rate")).alias("success_regressed")]
    return rows.select(name, slower.alias("p95_change"), less.alias("throughput_loss"), *flags, both.alias("comparable"))


def stage_latencies(samples: DataFrame, key: str, order: str, time_ms: Column, stage: str) -> DataFrame:
    """Time from each sample of a key to the next one, summed up by stage: n, p50, p95, max, mean."""
    after = F.lead(time_ms).over(Window.partitionBy(key).orderBy(order))
    rows = samples.where(F.col(stage).isNotNull()).withColumn("ms", after - time_ms).where("ms is not null")
    return rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"), F.max("ms").alias("longest"), F.avg("ms").alias("mean"))
