"""Cost, latency and benchmark statistics over the order tables and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import analytics
from skein.plans.registry import query

_MODEL = "CASE l_linenumber % 4 WHEN 0 THEN 'claude-3-5-sonnet' WHEN 1 THEN 'claude-3-opus' WHEN 2 THEN 'claude-3-5-haiku' ELSE 'other' END"
_USD = "CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 3.0 + l_quantity * 2 * 15.0 WHEN 1 THEN l_quantity * 15.0 + l_quantity * 2 * 75.0 WHEN 2 THEN l_quantity * 1.0 + l_quantity * 2 * 5.0 ELSE 0 END / 1000000"


def _calls(read):
    return analytics.call_costs(read("lineitem").select("l_orderkey", "l_linenumber", F.expr(_MODEL).alias("model"), F.col("l_quantity").alias("input"), (F.col("l_quantity") * 2).alias("output")))


@query("call_cost", f"SELECT model, count(*) AS n, round(sum(usd), 6) AS usd FROM (SELECT {_MODEL} AS model, {_USD} AS usd FROM lineitem) GROUP BY model")
def _(read, spark):
    """Quantities as tokens."""
    return _calls(read).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("usd"), 6).alias("usd"))


@query("usage_totals", f"SELECT count(*) AS calls, sum(l_quantity) AS input, sum(l_quantity * 2) AS output, round(sum({_USD}), 6) AS usd FROM lineitem")
def _(read, spark):
    return analytics.usage_totals(_calls(read))


@query("percentile_nearest", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def _(read, spark):
    return analytics.percentile_nearest(read("events"), "value", [0.5, 0.95], "event_type")


@query("percentile_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY l_returnflag")
def _(read, spark):
    return read("lineitem").groupBy("l_returnflag").agg(*(F.round(analytics.percentile_linear("l_extendedprice", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


_OBS = "SELECT o_orderpriority AS scenario, o_totalprice AS duration_us, CAST(1 + o_orderkey % 10 AS BIGINT) AS operation_count, CAST(1 + o_orderkey % 10 - CASE WHEN o_orderkey % 20 = 9 THEN 1 ELSE 0 END AS BIGINT) AS success_count FROM orders"
_SUMMARY = "SELECT scenario, count(*) AS samples, CAST(sum(operation_count) AS BIGINT) AS operations, CAST(sum(operation_count) - sum(success_count) AS BIGINT) AS errors, round(min(duration_us / operation_count), 6) AS min_us, round(sum(duration_us) / sum(operation_count), 6) AS mean_us, round(quantile_cont(duration_us / operation_count, 0.5), 6) AS p50_us, round(quantile_cont(duration_us / operation_count, 0.95), 6) AS p95_us, round(quantile_cont(duration_us / operation_count, 0.99), 6) AS p99_us, round(max(duration_us / operation_count), 6) AS max_us, round(sum(operation_count) / sum(duration_us) * 1e6, 6) AS per_second, round(sum(success_count) / sum(operation_count), 6) AS success_rate FROM o GROUP BY scenario"


def _observations(read):
    return read("orders").selectExpr("o_orderpriority AS scenario", "o_totalprice AS duration_us", "CAST(1 + o_orderkey % 10 AS BIGINT) AS operation_count", "CAST(1 + o_orderkey % 10 - CASE WHEN o_orderkey % 20 = 9 THEN 1 ELSE 0 END AS BIGINT) AS success_count")


@query("benchmark_summary", f"WITH o AS ({_OBS}) {_SUMMARY}")
def _(read, spark):
    """Order prices as durations."""
    rows = analytics.benchmark_summary(_observations(read), "scenario")
    doubles = ("min_us", "mean_us", "p50_us", "p95_us", "p99_us", "max_us", "per_second", "success_rate")
    return rows.select("scenario", "samples", "operations", "errors", *(F.round(c, 6).alias(c) for c in doubles))


@query("benchmark_compare", f"WITH o AS ({_OBS}), b AS ({_SUMMARY}), c AS ({_SUMMARY.replace('FROM o', 'FROM (SELECT scenario, duration_us * 1.12 AS duration_us, operation_count, success_count FROM o)')}) SELECT scenario, round((c.p95_us - b.p95_us) / b.p95_us * 100, 3) AS p95_change, round((b.per_second - c.per_second) / b.per_second * 100, 3) AS throughput_loss, true AS latency_regressed, true AS throughput_regressed, false AS success_regressed, true AS comparable FROM b JOIN c USING (scenario)")
def _(read, spark):
    """Against the same rows, 12 percent slower."""
    rows = _observations(read)
    slow = rows.withColumn("duration_us", F.col("duration_us") * 1.12)
    out = analytics.benchmark_compare(analytics.benchmark_summary(rows, "scenario"), analytics.benchmark_summary(slow, "scenario"), "scenario")
    return out.withColumn("p95_change", F.round("p95_change", 3)).withColumn("throughput_loss", F.round("throughput_loss", 3))


@query("stage_latency", "WITH x AS (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts)) / 1000 AS ms FROM events) SELECT event_type, count(*) AS n, round(quantile_cont(ms, 0.5), 3) AS p50, round(quantile_cont(ms, 0.95), 2) AS p95, round(max(ms), 3) AS longest, round(avg(ms), 3) AS mean FROM x WHERE ms IS NOT NULL GROUP BY event_type")
def _(read, spark):
    rows = analytics.stage_latencies(read("events"), "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1000, "event_type")
    return rows.select("event_type", "n", F.round("p50", 3).alias("p50"), F.round("p95", 2).alias("p95"), F.round("longest", 3).alias("longest"), F.round("mean", 3).alias("mean"))


@query("backend_latency", "SELECT l_shipdate_year AS year, median(q) AS median, round(avg(q), 6) AS mean, min(q) AS least, max(q) AS most FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year, l_quantity AS q FROM lineitem) GROUP BY 1")
def _(read, spark):
    q = F.col("l_quantity")
    return read("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.median(q).alias("median"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most"))


@query("kind_counts", "SELECT kind, coalesce(n, 0) AS n, coalesce(n, 0) >= least AS enough FROM (VALUES ('view', 10), ('click', 10), ('refund', 1)) m(kind, least) LEFT JOIN (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type) USING (kind)")
def _(read, spark):
    least = spark.createDataFrame([("view", 10), ("click", 10), ("refund", 1)], "kind string, least int")
    counts = read("events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return least.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("enough"))


@query("last_per_kind", "SELECT event_type, max(event_id) AS last_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def _(read, spark):
    return read("events").groupBy("event_type").agg(F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("value"))


@query("first_wins", "SELECT event_type, min(event_id) AS first_id, arg_min(value, event_id) AS value FROM events GROUP BY event_type")
def _(read, spark):
    return read("events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.min_by("value", "event_id").alias("value"))


@query("progress_stream", "SELECT user_id, event_id, round(100 * row_number() OVER o / count(*) OVER (PARTITION BY user_id), 6) AS percent FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)")
def _(read, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return read("events").select("user_id", "event_id", F.round(100 * F.row_number().over(w.orderBy("event_id")) / F.count(F.lit(1)).over(w), 6).alias("percent"))
