"""State machines, statistics, chunks and sources."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from traces import task_trace

from skein.operators import analytics, conversation, corpus, replay
from skein.sources import logs, sections, sinks

TASK = "task-" + "0" * 32


def run(events):
    state = None
    for e in events:
        state = replay.task_step(state, e | {"payload": json.loads(e["payload"])})
    return state


def tool_trace():
    """Two rounds, one tool call that fails softly, three pieces of evidence."""
    user = {"role": "user", "content": [{"type": "text", "text": "i"}]}
    call = {"id": "c1", "name": "read", "arguments": {}}
    use = {"role": "assistant", "content": [{"type": "tool_use", **call}]}
    result = {"tool_call_id": "c1", "content": "x", "is_error": True}
    one, two = {"items": [{"source_id": "a", "content": "x"}]}, {"items": [{"source_id": "a", "content": "x"}, {"source_id": "b", "content": "y"}]}
    ask = lambda messages, evidence: {"request": {"messages": messages, "evidence": evidence, "tools": [], "timeout_ms": 1, "system_prompt": "s"}}
    steps = [
        ("task_started", {"issue": "i", "budgets": {"model_timeout_ms": 1, "max_model_rounds": 3, "max_tool_calls": 3, "max_task_time_ms": 9}}),
        ("context_preparation_started", {}), ("context_prepared", {"evidence": one}), ("model_call_started", ask([user], one)),
        ("model_call_succeeded", {"response": {"content": use["content"], "stop_reason": "tool_use"}}), ("tool_call_started", {"call": call}), ("tool_call_succeeded", {"result": result}),
        ("context_preparation_started", {}), ("context_prepared", {"evidence": two}), ("model_call_started", ask([user, use, {"role": "user", "content": [{"type": "tool_result", **result}]}], two)),
        ("model_call_succeeded", {"response": {"content": [{"type": "text", "text": "done"}], "stop_reason": "end_turn"}}), ("task_completed", {"final_text": "done"}),
    ]
    return [{"schema_version": 1, "task_id": TASK, "sequence": i + 1, "event_type": k, "payload": json.dumps(p)} for i, (k, p) in enumerate(steps)]


def test_tool_trace_and_its_prefixes():
    events = tool_trace()
    s = run(events)
    assert replay.task_passed(s)
    assert (s["rounds"], s["tool_calls"], s["evidence_rounds"], s["evidence_items"], s["requests_with_evidence"], s["tool_errors"], s["last_sequence"]) == (2, 1, 2, 3, 2, 1, 12)
    for n in range(1, len(events)):
        assert not replay.task_passed(run(events[:n]))


@pytest.mark.parametrize("change", [lambda e: e[4].update(sequence=9), lambda e: e.append(dict(e[-1], sequence=13)), lambda e: e[0].update(task_id="x"), lambda e: e.pop(1), lambda e: e[11].update(payload='{"final_text": "no"}')])
def test_broken_traces(change):
    events = tool_trace()
    change(events)
    with pytest.raises(replay.Rejected):
        run(events)


def test_memory_and_sessions():
    entry = dict(memory_id="m1", category="c", scope="", source_session_id="s", source_turn_start=1, source_turn_end=1, created_at="2024-01-01T00:00:00Z", updated_at="2024-01-01T00:00:00.000Z", origin="user", content="a")
    up = lambda n, **k: {"sequence": n, "timestamp": "2024-01-01T00:00:00Z", "event_type": "memory_upserted", "payload": {"entry": entry | k}}
    s = replay.memory_step(replay.memory_step({}, up(1)), up(2, content="b", updated_at="2024-01-02T00:00:00Z"))
    assert s["active"]["m1"]["content"] == "b"
    s = replay.memory_step(s, {"sequence": 3, "timestamp": "2024-01-03T00:00:00Z", "event_type": "memory_forgotten", "payload": {"memory_id": "m1"}})
    with pytest.raises(replay.Rejected):
        replay.memory_step(s, dict(up(4), timestamp="2024-01-04T00:00:00Z"))
    base = {"session_id": "s", "timestamp": "t"}
    state = replay.session_step(None, base | {"sequence": 1, "event_type": "session_started", "payload": {}})
    state = replay.session_step(state, base | {"sequence": 2, "event_type": "session_turn_started", "payload": {"turn_index": 1, "task_id": "t"}})
    talk = [{"role": r, "content": [{"type": "text", "text": "x"}]} for r in ("user", "assistant")]
    state = replay.session_step(state, base | {"sequence": 3, "event_type": "session_turn_committed", "payload": {"turn_index": 1, "task_id": "t", "messages": talk}})
    assert len(state["turns"]) == 1 and state["pending"] is None
    with pytest.raises(replay.Rejected):
        replay.session_step(state, base | {"sequence": 5, "event_type": "session_started", "payload": {}})


def test_replay_modes(spark):
    rows = [e for k in range(4) for e in task_trace(f"task-{k:032x}", "i", k)]
    events = spark.createDataFrame(pd.DataFrame(rows))
    got = {r["task_id"][-1]: r for r in replay.replay_tasks(events, strict=False).collect()}
    assert [got[str(k)]["status"] for k in range(4)] == ["completed", "failed", "cancelled", "awaiting_model"] and got["3"]["error"]
    with pytest.raises(Exception, match="completion_differs"):
        replay.replay_tasks(events).collect()


def test_stream_equals_batch(spark, tmp_path):
    from skein.streaming import tasks

    rows = [e | {"timestamp": "t", "correlation_id": "c"} for k in range(4) for e in task_trace(f"task-{k:032x}", "i", k)]
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):  # a task's events come over several batches
        (folder / f"{part}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows if (r["sequence"] - 1) // 2 == part))
        os.utime(folder / f"{part}.jsonl", (1_700_000_000 + part * 60,) * 2)  # files come in the order of their times
    stream = tasks.replay_stream(tasks.read_events(spark, str(folder), files_per_batch=1))
    q = stream.writeStream.outputMode("update").format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("replayed").groupBy("task_id").agg(F.max_by("status", "last_sequence").alias("status"))
    assert sorted(r["status"] for r in last.collect()) == ["awaiting_model", "cancelled", "completed", "failed"]


def test_benchmark_numbers(spark):
    rows = spark.createDataFrame([(100.0, 10, 10), (250.0, 10, 9), (300.0, 10, 10), (450.0, 10, 8)], "duration_us double, operation_count bigint, success_count bigint")
    s = analytics.benchmark_summary(rows).first()
    assert (s["operations"], s["successes"], s["success_rate"]) == (40, 37, 0.925)
    assert [s[c] for c in ("mean_us", "p50_us", "p95_us", "p99_us")] == pytest.approx([27.5, 27.5, 42.75, 44.55])
    near = analytics.percentile_nearest(spark.createDataFrame([(x,) for x in (1, 2, 3, 100)], "x int"), "x", [0.5, 0.95]).first()
    assert (near["p50"], near["p95"]) == (2, 100)


def test_chunks():
    count = lambda t: len(t.split())
    body = " ".join(f"w{i}" for i in range(25)) + ".\n\nnew paragraph here"
    spans = corpus.chunk_spans(body, "p", count, 11, 3)
    assert all(count("p\n" + body[a:b]) <= 11 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(body)
    assert all(b[0] < a[1] and count(body[b[0] : a[1]]) <= 3 for a, b in zip(spans, spans[1:], strict=False))
    assert corpus.chunk_spans("x" * 10, "", len, 5, 0) == [(0, 4), (4, 8), (8, 10)]
    with pytest.raises(ValueError):
        corpus.chunk_spans("a", "p q", count, 2)


def test_sections():
    xml = b"<R><DIV5 TYPE='PART' N='2'><HEAD>Part 2</HEAD><DIV8 TYPE='SECTION' N='2.1'><HEAD>\xc2\xa7 2.1 Scope.</HEAD><P>One  two</P><TABLE><TR><TD>a|b</TD></TR><TR><TD>c</TD></TR></TABLE></DIV8><DIV8 TYPE='SECTION' N='2.2'><HEAD>[Reserved]</HEAD><P>x</P></DIV8></DIV5></R>"
    assert list(sections.sections_of(xml)) == [("Part 2", "2.1", "Scope", "One two\n\n| a\\|b |\n| --- |\n| c |")]
    with pytest.raises(ValueError):
        list(sections.sections_of(b"<!DOCTYPE x><R/>"))


def test_jsonl_and_publish(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n{"a": 1, "a": 2, "b": "x"}\n{"a": 1}\n')
    assert logs.read_jsonl(spark, str(path), "a int, b string", strict=False).where("_error is not null").count() == 2
    with pytest.raises(ValueError):
        logs.read_jsonl(spark, str(path), "a int, b string")
    good, place = spark.createDataFrame([(1,)], "x int"), str(tmp_path / "pub")
    sinks.publish({"t": good}, place)
    with pytest.raises(ValueError):
        sinks.publish({"t": good.union(good)}, place, {"too many": good})
    assert sinks.published(spark, place, "t").count() == 1


def test_report(spark, tmp_path):
    good = spark.createDataFrame([(1.5, "x"), (None, None)], "b double, a string")
    sinks.write_report(good, str(tmp_path / "r"))
    assert sorted(spark.read.text(str(tmp_path / "r")).toPandas()["value"]) == ['{"a":"x","b":1.5}', "{}"]
    for bad in ("nan", "inf"):
        with pytest.raises(ValueError, match="finite"):
            sinks.write_report(spark.createDataFrame([(float(bad),)], "b double"), str(tmp_path / bad))


def test_markdown_source(spark, tmp_path):
    (tmp_path / "d.md").write_text("---\nid: 1\n---\n\n# Title\n\nbody one\nbody two\n")
    row = logs.read_markdown(spark, str(tmp_path / "d.md")).first()
    assert (row["heading"], row["body"], row["body_start_line"]) == ("Title", "body one\nbody two", 7)


def test_dispatch_and_batches(spark):
    calls = spark.createDataFrame([(1, i, i not in (3,)) for i in range(1, 9)], "k int, o int, safe boolean")
    got = [r["window_no"] for r in conversation.dispatch_runs(calls, "k", "o", "safe", 2).orderBy("o").collect()]
    assert got == [1, 1, 2, 3, 3, 4, 4, 5]
    turns = spark.createDataFrame([(1, 0, "x" * 10), (1, 1, "x" * 10), (1, 2, "x" * 50), (1, 3, "x")], "conv_id bigint, turn bigint, text string")
    assert [(r["first"], r["n"]) for r in conversation.batches(turns, 20, 5).orderBy("batch").collect()] == [(0, 2), (2, 0), (3, 1)]


def test_each_log_has_its_own_rules(spark, tmp_path):
    schema = "a int, b string"
    folder = lambda name, raw: (tmp_path / name).mkdir() or (tmp_path / name / "x.jsonl").write_bytes(raw) and str(tmp_path / name)
    line = b'{"a": 1, "b": "x"}\n'
    whole, cut, blank, twice = folder("w", line * 3), folder("c", line + line[:-1]), folder("b", line + b"\n" + line), folder("t", line + b'{"a": 1, "a": 2, "b": "x"}\n')
    assert [logs.read_log(spark, whole, schema, k).count() for k in ("task", "session", "memory")] == [3, 3, 3]
    assert logs.read_log(spark, cut, schema, "task").count() == 2 and logs.read_log(spark, blank, schema, "task").count() == 2
    for kind in ("session", "memory"):
        with pytest.raises(ValueError, match="truncated"):
            logs.read_log(spark, cut, schema, kind)
        with pytest.raises(ValueError, match="schema"):
            logs.read_log(spark, blank, schema, kind)
    with pytest.raises(ValueError, match="schema"):
        logs.read_log(spark, twice, schema, "task")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.jsonl").write_bytes(b"")
    with pytest.raises(ValueError, match="truncated"):
        logs.read_log(spark, str(tmp_path / "e"), schema, "session")
    assert logs.truncated_files(spark, cut).count() == 1 and logs.truncated_files(spark, whole).count() == 0
