"""Event logs, made from the tables: tasks from events (skein.plans.traces), sessions from conversations, the memory log from events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import policy as P
from skein.operators import conversation, histories, replay
from skein.operators.order import numbered
from skein.plans import traces
from skein.plans.registry import query

_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


def _events(read):
    return read("events").withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


@query("sequence_contiguous", f"WITH {_SEQ} SELECT user_id, count(*) AS n, min(sequence) = 1 AND max(sequence) = count(*) AS contiguous FROM seq WHERE NOT (user_id % 5 = 0 AND sequence = 3) GROUP BY user_id")
def _(read, spark):
    """Every fifth log lacks its third event."""
    rows = _events(read).where("NOT (user_id % 5 = 0 AND sequence = 3)")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("sequence"))
    return rows.withColumn("place", place).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("place") == F.col("sequence")).alias("contiguous"))


@query("time_monotone", f"WITH {_SEQ}, x AS (SELECT user_id, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS ok FROM seq) SELECT user_id, bool_and(coalesce(ok, true)) AS monotone FROM x GROUP BY user_id")
def _(read, spark):
    ok = F.coalesce(F.col("ts") >= F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(True))
    return read("events").withColumn("ok", ok).groupBy("user_id").agg(F.bool_and("ok").alias("monotone"))


_METRICS = "model_rounds, tool_calls, evidence_rounds, evidence_items, model_requests_with_evidence, tool_error_results"


@query("task_replay", f"WITH {traces.ROUND_SQL} SELECT user_id, task, status, CAST(model_rounds AS BIGINT) AS model_rounds, CAST(tool_calls AS BIGINT) AS tool_calls, CAST(last_sequence AS BIGINT) AS last_sequence, ends IS NOT DISTINCT FROM 'completed' AND error IS NULL AS passed, error FROM o")
def _(read, spark):
    """All tasks' logs through the state machine: where each one stands, and the rule that a broken one broke."""
    rows = traces.task_keys(replay.replay_tasks(traces.task_events(read, spark), strict=False))
    return rows.select("user_id", "task", "status", "model_rounds", "tool_calls", "last_sequence", "passed", "error")


@query("task_evaluation", f"WITH {traces.ROUND_SQL} SELECT user_id, task, CASE WHEN ends = 'completed' THEN 'pass' ELSE 'fail' END AS verdict, status, " + ", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in _METRICS.split(", ")) + ", CAST(last_sequence AS BIGINT) AS last_sequence FROM o WHERE error IS NULL")
def _(read, spark):
    """What became of each task with a sound log, and what it took."""
    sound = replay.evaluate_logs(traces.task_events(read, spark)).where("error is null")
    return traces.task_keys(sound).select("user_id", "task", "verdict", "status", *_METRICS.split(", "), "last_sequence")


@query("verify_log", f"WITH {traces.ROUND_SQL} SELECT user_id, task, error IS NULL AS sound, CASE WHEN error IS NULL THEN status END AS status, CASE WHEN error IS NULL THEN CAST(last_sequence AS BIGINT) END AS last_sequence FROM o")
def _(read, spark):
    rows = replay.verify_logs(traces.task_events(read, spark))
    return traces.task_keys(rows).select("user_id", "task", F.col("error").isNull().alias("sound"), "status", "last_sequence")


def session_log(read):
    """A session's log for each conversation: every second turn starts a turn of the session, which the answer commits. By conv_id modulo 7: 0 lacks its second turn, 1 commits a turn that isn't open at its end, 2 doesn't commit its last turn, 3 is compacted at the end through the last turn but one, 4 has a history that doesn't alternate where an answer's length divides by five."""
    turns = read("conversations").where("role <> 'system'").select("conv_id", "turn", "text")
    own = Window.partitionBy("conv_id")
    turns = turns.withColumn("place", F.row_number().over(own.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("index", F.ceil(F.col("place") / 2))
    m, starts, last = F.col("conv_id") % 7, F.col("place") % 2 == 1, F.col("place") == F.col("n") - F.col("n") % 2
    none = F.lit(None).cast("bigint")
    row = lambda sequence, kind, turn_index=none, through=none, ok=F.lit(True): [F.col("conv_id").alias("session_id"), sequence.cast("bigint").alias("sequence"), kind.alias("kind"), turn_index.cast("bigint").alias("turn_index"), through.cast("bigint").alias("through_turn"), ok.alias("history_ok")]
    index = F.when((m == 1) & last, F.col("index") + 1).otherwise(F.col("index"))
    middle = turns.where(~((m == 0) & (F.col("place") == 2)) & ~((m == 2) & last)).select(*row(F.col("place") + 1, F.when(starts, "session_turn_started").otherwise("session_turn_committed"), index, ok=~((m == 4) & (F.octet_length("text") % 5 == 0))))
    ends = turns.where(F.col("place") == 1)
    rows = ends.select(*row(F.lit(1), F.lit("session_started"))).unionByName(middle).unionByName(ends.where(m == 3).select(*row(F.col("n") + 2, F.lit("session_compacted"), through=F.floor(F.col("n") / 2) - 1)))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence") + F.col("session_id") % 50), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumns({"timestamp": stamp, "task_id": F.concat(F.lit("task-"), F.col("turn_index"))})


_SESSIONS = """
p AS (SELECT conv_id, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n, conv_id % 7 AS m FROM conversations WHERE role <> 'system'),
f AS (SELECT *, min(CASE WHEN (m = 0 AND place = 3) OR (m = 1 AND place = n - n % 2) OR (m = 2 AND place = n AND n % 2 = 1 AND n > 1) OR (m = 4 AND place % 2 = 0 AND size % 5 = 0) THEN place END) OVER (PARTITION BY conv_id) AS bad FROM p),
a AS (SELECT * FROM f WHERE place < coalesce(bad, n + 1) AND NOT (m = 0 AND place = 2) AND NOT (m = 2 AND place = n - n % 2)),
h AS (SELECT conv_id, any_value(m) AS m, any_value(n) AS n, any_value(bad) AS bad, count(*) AS held, max(place) AS last, max((place + 1) // 2) AS last_turn, count(*) FILTER (place % 2 = 0) AS committed FROM a GROUP BY conv_id),
g AS (SELECT *, m = 3 AND last % 2 = 0 AND committed >= 2 AS compacts FROM h),
state AS (SELECT conv_id AS session_id, last_turn, CASE WHEN last % 2 = 1 THEN last_turn END AS pending, CASE WHEN compacts THEN 1 ELSE committed END AS turns, CASE WHEN compacts THEN committed - 1 ELSE 0 END AS compacted_through, 1 + held + compacts::INTEGER AS last_sequence,
  CASE WHEN bad IS NOT NULL THEN CASE m WHEN 0 THEN 'bad_sequence' WHEN 2 THEN 'bad_sequence' WHEN 1 THEN 'no_pending_turn' ELSE 'bad_history' END WHEN m = 3 AND NOT compacts THEN 'nothing_to_compact' END AS error FROM g)"""


@query("session_replay", f"WITH {_SESSIONS} SELECT * FROM state")
def _(read, spark):
    """Sessions' logs through the rules of turns; five of seven kinds break one, or end in the middle."""
    return histories.replay_sessions(session_log(read)).drop("last_timestamp")


@query("list_sessions", f"WITH {_SESSIONS} SELECT session_id, row_number() OVER (ORDER BY last_sequence + session_id % 50 DESC, session_id) AS place FROM state WHERE error IS NULL")
def _(read, spark):
    states = histories.replay_sessions(session_log(read)).where("error is null")
    return histories.list_sessions(states).select("session_id", "place")


@query("active_tasks", f"WITH {_SESSIONS} SELECT session_id, pending FROM state WHERE error IS NULL AND pending IS NOT NULL")
def _(read, spark):
    """Sessions with an open turn, as replayed."""
    return histories.replay_sessions(session_log(read)).where("error is null and pending is not null").select("session_id", "pending")


@query("recover_pending", f"WITH {_SESSIONS} SELECT session_id, pending AS turn, CASE session_id % 5 WHEN 0 THEN 'rerun' WHEN 1 THEN 'mismatched' WHEN 2 THEN 'finalise' ELSE 'resume' END AS action FROM state WHERE error IS NULL AND pending IS NOT NULL")
def _(read, spark):
    """What to do about open turns, from the logs of their tasks, which are made by session_id modulo 5."""
    states = histories.replay_sessions(session_log(read)).where("error is null")
    m = F.col("session_id") % 5
    tasks = states.where(m > 0).select("session_id", F.when(m == 1, F.col("pending") + 97).otherwise(F.col("pending")).alias("turn_index"), F.when(m == 2, "failed").otherwise("awaiting_model").alias("status"))
    return histories.recover_pending(states, tasks)


def memory_log(read):
    """The one memory log: an entry for each user at its first event, whose content the second changes and the third forgets for every third user; each event further on is a checkpoint of that user's session."""
    rows = read("events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("k"))
    rows = numbered(rows, [F.col("event_id")], "sequence")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    forgets = (F.col("k") == 3) & (F.col("user_id") % 3 == 0)
    kind = F.when(F.col("k") <= 2, "memory_upserted").when(forgets, "memory_forgotten").otherwise("memory_checkpointed")
    entry = F.col("k") <= 2
    return rows.select(
        "sequence", stamp.alias("timestamp"), kind.alias("kind"), F.when(entry | forgets, F.concat(F.lit("memory-"), "user_id")).alias("memory_id"), F.when(entry, F.concat(F.lit("v"), "k")).alias("content"), F.when(entry, F.lit("fact")).alias("fixed"),
        F.when(entry, F.lit("2023-01-01T00:00:00Z")).alias("created_at"), F.when(entry, F.when(F.col("k") == 1, "2023-01-01T00:00:00.000Z").otherwise("2023-01-02T00:00:00Z")).alias("updated_at"),
        F.when(~entry & ~forgets, F.col("user_id")).alias("session_id"), F.when(~entry & ~forgets, F.col("k")).cast("bigint").alias("through_turn"),
    )


_MEMORY = "k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), l AS (SELECT *, row_number() OVER (ORDER BY event_id) AS sequence FROM k)"


@query("memory_replay", f"WITH {_MEMORY} SELECT 'memory-' || user_id AS memory_id, 'v' || max(k) FILTER (WHERE k <= 2) AS content, max(sequence) FILTER (WHERE k <= 2) AS sequence FROM l GROUP BY user_id HAVING NOT (user_id % 3 = 0 AND max(k) >= 3)")
def _(read, spark):
    """Entries that live at the log's end, each event held against the rules."""
    live, _marks, _first = histories.replay_memory(memory_log(read))
    return live.select("memory_id", "content", "sequence")


@query("memory_checkpoints", f"WITH {_MEMORY} SELECT user_id AS session_id, max(k) AS through_turn FROM l WHERE k > 3 OR (k = 3 AND user_id % 3 <> 0) GROUP BY user_id")
def _(read, spark):
    return histories.replay_memory(memory_log(read))[1]


@query("memory_files", f"WITH {_MEMORY} SELECT 'memory-' || user_id || '.md' AS path, '---' || chr(10) || 'memory_id: memory-' || user_id || chr(10) || 'updated_at: 2023-01-0' || max(k) FILTER (WHERE k <= 2) || 'T00:00:00.000Z' || chr(10) || '---' || chr(10) || chr(10) || '# memory-' || user_id || chr(10) || chr(10) || 'v' || max(k) FILTER (WHERE k <= 2) || chr(10) AS text FROM l GROUP BY user_id HAVING NOT (user_id % 3 = 0 AND max(k) >= 3)")
def _(read, spark):
    return histories.memory_files(histories.replay_memory(memory_log(read))[0])


@query("memory_log_errors", f"WITH {_MEMORY} SELECT sequence + 1 AS sequence, 'bad_sequence' AS error FROM l WHERE sequence % 97 = 0 AND sequence < (SELECT max(sequence) FROM l)")
def _(read, spark):
    """A log that lacks each 97th event: the events behind the gaps are wrong."""
    return histories.memory_errors(memory_log(read).where("sequence % 97 <> 0")).where("error = 'bad_sequence'").select("sequence", "error")


@query("budget_guard", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'cancelled' WHEN value >= 50 THEN 'max_task_time_ms' WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 90 THEN 'max_tool_calls' END AS ended FROM events")
def _(read, spark):
    """Cancelling comes before time, and time before counts."""
    k = F.get_json_object("props", "$.k").cast("int")
    ended = P.budget_end(F.col("event_type") == "error", F.col("value"), F.lit(50), k, F.lit(90), "max_tool_calls")
    return read("events").select("event_id", ended.alias("ended"))


@query("dispatch_windows", f"""
WITH {_SEQ}, s AS (SELECT user_id, sequence, event_type <> 'error' AS safe FROM seq), f AS (SELECT *, CASE WHEN safe AND lag(safe) OVER (PARTITION BY user_id ORDER BY sequence) THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sequence) AS run FROM f), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY sequence) - 1) % 4 = 0 AS first FROM r)
SELECT user_id, sequence::INTEGER AS sequence, CAST(sum(first::INTEGER) OVER (PARTITION BY user_id ORDER BY sequence) AS BIGINT) AS window_no FROM p
""")
def _(read, spark):
    calls = _events(read).select("user_id", "sequence", (F.col("event_type") != "error").alias("safe"))
    return conversation.dispatch_runs(calls, "user_id", "sequence", "safe", 4).select("user_id", "sequence", "window_no")


@query("running_checkpoint", "SELECT event_id, max(CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS checkpoint FROM events")
def _(read, spark):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read("events").select("event_id", F.max(F.get_json_object("props", "$.k").cast("bigint")).over(w).alias("checkpoint"))


@query("coalesced_queue", "SELECT user_id, date_trunc('day', ts) AS batch, max(event_id) AS target FROM events GROUP BY 1, 2")
def _(read, spark):
    """One pending target for each key and batch: the largest."""
    return read("events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("batch")).agg(F.max("event_id").alias("target"))


@query("value_json", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def _(read, spark):
    return read("events").groupBy("event_type").agg(F.sum(F.expr("variant_get(parse_json(props), '$.k', 'bigint')")).alias("k"))


@query("strict_json", "SELECT event_id, event_id % 3 <> 0 AS sound FROM events")
def _(read, spark):
    """Every third object has a key twice."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": 1, '), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    return read("events").select("event_id", F.try_parse_json(broken).isNotNull().alias("sound"))


@query("exact_keys", "SELECT event_id, true AS exact, event_id % 2 = 0 AS exact_two FROM events")
def _(read, spark):
    two = F.when(F.col("event_id") % 2 == 0, F.lit('{"b": 1, "a": 2}')).otherwise(F.lit('{"a": 1}'))
    keys = lambda c, *k: F.array_sort(F.json_object_keys(c)) == F.array(*map(F.lit, sorted(k)))
    return read("events").select("event_id", keys(F.col("props"), "k").alias("exact"), keys(two, "a", "b").alias("exact_two"))


@query("event_log_scan", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS tasks FROM events GROUP BY event_type")
def _(read, spark):
    """Events as JSON lines, parsed by a fixed schema; a line that breaks it fails the query."""
    lines = read("events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("line"))
    rows = lines.select(F.from_json("line", "event_id bigint, user_id bigint, event_type string", {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("tasks"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(read, spark):
    """Beyond the logs' own operators: event-time windows in batch; skein.streaming has the watermarked form."""
    return read("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
