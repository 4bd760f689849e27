"""Task logs made from the events table, as JSON lines on disk: every four events of a user in a row are a task, each one a round of it, and what it does follows from the event's type, number and properties."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources import logs
from skein.sources.shared import shared_dir
from skein.streaming.tasks import EVENT

ROUNDS = 4
_BUDGETS = {"model_timeout_ms": 1000, "max_model_rounds": 9, "max_tool_calls": 99, "max_task_time_ms": 9000}
#: Event types as rounds: how many tools the model calls. A purchase is the final answer.
_CALLS = {"view": 1, "click": 2, "error": 1, "signup": 3}

#: What the rounds of a task come to, in SQL over events: `accepted` log events of a round before the one that ends the task or breaks a rule, and which of its steps are among them. i counts rounds from 1.
ROUND_SQL = """
seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events),
r AS (SELECT user_id, place // 4 AS task, place % 4 + 1 AS i, event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS items, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 1 WHEN 'signup' THEN 3 ELSE 0 END AS calls,
  coalesce(lead(CASE WHEN event_id % 41 = 0 AND event_id // 41 % 5 = 0 THEN 'bad_sequence' ELSE 'already_ended' END) OVER (PARTITION BY user_id, place // 4 ORDER BY place), '') AS later FROM seq),
k AS (SELECT *, CASE WHEN event_id % 41 = 0 THEN 'broken' WHEN kind = 'purchase' THEN 'completed' WHEN kind = 'error' AND event_id % 7 = 0 THEN 'failed' WHEN kind = 'signup' AND event_id % 11 = 0 THEN 'cancelled'
  WHEN kind = 'click' AND event_id % 13 = 0 THEN 'budget_exceeded' END AS ends, event_id // 41 % 5 AS way FROM r),
s AS (SELECT *, min(CASE WHEN ends IS NOT NULL THEN i END) OVER (PARTITION BY user_id, task) AS stop FROM k),
c AS (SELECT *, CASE WHEN ends = 'broken' THEN CASE way WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 3 ELSE 2 END WHEN ends = 'completed' THEN 5 WHEN ends = 'failed' THEN 6 WHEN ends = 'cancelled' THEN 2 WHEN ends = 'budget_exceeded' THEN 3 ELSE 4 + 2 * calls END AS accepted,
  ends IS DISTINCT FROM 'cancelled' AND NOT (ends IS NOT DISTINCT FROM 'broken' AND way < 2) AS prepared, coalesce(ends NOT IN ('cancelled', 'budget_exceeded') AND NOT (ends = 'broken' AND way < 4), true) AS asked,
  CASE WHEN ends = 'failed' THEN 1 WHEN ends IS NULL THEN calls ELSE 0 END AS started FROM s WHERE i <= coalesce(stop, 4)),
t AS (SELECT user_id, task, 1 + sum(accepted) AS last_sequence, count(*) FILTER (prepared) AS evidence_rounds, coalesce(sum(items) FILTER (prepared), 0) AS evidence_items, count(*) FILTER (asked) AS model_rounds, count(*) FILTER (asked AND items > 0) AS model_requests_with_evidence,
  sum(started) AS tool_calls, count(*) FILTER (kind = 'error' AND ends IS NULL) AS tool_error_results, arg_max(ends, i) AS ends, arg_max(way, i) AS way, max(i) AS i, arg_max(later, i) AS later, arg_max(event_id, i) AS event_id FROM c GROUP BY user_id, task),
o AS (SELECT *, CASE WHEN ends IS NULL THEN 'awaiting_tool' WHEN ends <> 'broken' THEN ends WHEN way = 0 THEN CASE WHEN i = 1 THEN 'created' ELSE 'awaiting_tool' END WHEN way = 1 THEN 'preparing_context' ELSE 'awaiting_model' END AS status,
  CASE WHEN ends = 'broken' THEN CASE way WHEN 0 THEN 'bad_sequence' WHEN 1 THEN 'bad_evidence' WHEN 2 THEN 'request_messages' WHEN 3 THEN 'request_timeout' ELSE 'model_not_due' END WHEN ends IS NOT NULL AND later <> '' AND event_id % 2 = 1 THEN later END AS error FROM t)"""


def _answer(text: str) -> dict:
    return {"type": "text", "text": text}


def task_log(task_id: str, rounds: list[tuple[int, str, int]]) -> Iterator[dict]:
    """The log's events for rounds (event_id, type, k)."""
    messages, n = [{"role": "user", "content": [_answer(task_id)]}], 0

    def event(kind: str, **payload) -> dict:
        nonlocal n
        n += 1
        return {"schema_version": 1, "sequence": n, "task_id": task_id, "timestamp": f"2024-01-01T00:{n // 60:02d}:{n % 60:02d}Z", "event_type": kind, "correlation_id": f"{task_id}-{n}", "payload": payload}

    yield event("task_started", issue=task_id, budgets=_BUDGETS)
    for event_id, kind, k in rounds:
        way = event_id // 41 % 5 if event_id % 41 == 0 else None
        n += way == 0
        items = [{"source_id": f"s{x}", "content": kind} for x in range(k % 3)]
        evidence = {"items": items}
        yield event("context_preparation_started")
        if way is None and kind == "signup" and event_id % 11 == 0:
            yield event("task_cancelled", error={"message": "cancelled"})
            if event_id % 2:
                continue
            return
        yield event("context_prepared", evidence={"items": [{"source_id": "s", "content": "x"}] * 2} if way == 1 else evidence)
        if way is None and kind == "click" and event_id % 13 == 0:
            yield event("task_budget_exceeded", budget_name="max_task_time_ms", error={"code": "budget_exceeded", "message": "max_task_time_ms budget exceeded", "retryable": False})
            if event_id % 2:
                continue
            return
        request = {"messages": messages[1:] if way == 2 else messages, "evidence": evidence, "tools": [], "timeout_ms": 1 if way == 3 else _BUDGETS["model_timeout_ms"], "system_prompt": "s"}
        yield event("model_call_started", request=request)
        if way == 4:
            yield event("model_call_started", request=request)
        if kind == "purchase":
            yield event("model_call_succeeded", response={"content": [_answer("done")], "stop_reason": "end_turn"})
            messages = [*messages, {"role": "assistant", "content": [_answer("done")]}]
            yield event("task_completed", final_text="done")
            if event_id % 2:
                continue
            return
        calls = [{"id": f"c{event_id}-{x}", "name": "read", "arguments": {"path": f"{x}"}} for x in range(_CALLS[kind])]
        content = [{"type": "tool_use", **c} for c in calls]
        yield event("model_call_succeeded", response={"content": content, "stop_reason": "tool_use"})
        results = [{"tool_call_id": c["id"], "content": kind, "is_error": kind == "error"} for c in calls]
        if kind == "click":  # both are dispatched before the first one ends
            for c in calls:
                yield event("tool_call_started", call=c)
            for r in results:
                yield event("tool_call_succeeded", result=r)
        else:
            for c, r in zip(calls, results, strict=True):
                yield event("tool_call_started", call=c)
                if way is None and kind == "error" and event_id % 7 == 0:
                    yield event("tool_call_failed", tool_call_id=c["id"], error={"message": "tool failed"})
                    break
                yield event("tool_call_succeeded", result=r)
        if way is None and kind == "error" and event_id % 7 == 0:
            if event_id % 2:
                continue
            return
        messages = [*messages, {"role": "assistant", "content": content}, {"role": "user", "content": [{"type": "tool_result", **r} for r in results]}]


def task_events(read, spark: SparkSession) -> DataFrame:
    """The logs' events, read from the lines that were written for them."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rounds = read("events").withColumn("place", place).groupBy("user_id", F.floor(F.col("place") / ROUNDS).alias("task"))
    rounds = rounds.agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")))).alias("rounds"))  # ROUNDS at most

    def lines(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for user, task, some in batch.itertuples(index=False):
                out += [json.dumps(e) for e in task_log(f"task-{user:024x}{task:08x}", [(r["event_id"], r["event_type"], r["k"]) for r in some])]
            yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    folder = f"{shared_dir(spark)}/task-logs-{uuid.uuid4().hex}"
    rounds.select("user_id", "task", "rounds").mapInPandas(lines, "value string").write.text(folder)
    return logs.read_log(spark, folder, EVENT, "task")


def task_keys(rows: DataFrame) -> DataFrame:
    number = lambda first, n: F.conv(F.substring("task_id", first, n), 16, 10).cast("bigint")
    return rows.withColumns({"user_id": number(6, 24), "task": number(30, 8)})
