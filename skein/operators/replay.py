"""Replay of append-only event logs through keyed state machines.

The step functions are plain Python over dicts, shared by the batch form (events sorted by key stream through) and the streaming form (skein.streaming). An event that breaks a rule stops its key: the row has the rule's code, or the job fails in strict mode.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "budget_exceeded", "cancelled")


class Rejected(ValueError):
    """An event that the state doesn't allow."""


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise Rejected(why)


def text_of(content: list[dict]) -> str:
    return "".join(b.get("text", "") for b in content if b["type"] == "text")


def history_valid(messages: list[dict]) -> bool:
    """Turns alternate from user to assistant and end there; tool uses are answered, each once, by the next user turn, and by nothing else."""
    if len(messages) % 2:
        return False
    open_calls: list[str] = []
    for i, m in enumerate(messages):
        blocks = m["content"]
        if m["role"] != ("user", "assistant")[i % 2] or not blocks:
            return False
        if i % 2:
            if any(b["type"] not in ("text", "tool_use") for b in blocks):
                return False
            open_calls = [b["id"] for b in blocks if b["type"] == "tool_use"]
            if len(set(open_calls)) != len(open_calls):
                return False
        else:
            answers = [b["tool_call_id"] for b in blocks if b["type"] == "tool_result"]
            if sorted(answers) != sorted(open_calls) or any(b["type"] not in ("text", "tool_result") for b in blocks):
                return False
    return not open_calls


def _evidence_ok(pack: dict) -> bool:
    items = pack.get("items", [])
    sizes = [len(x.get("content", "").encode()) for x in items]
    ids = [x.get("source_id") for x in items]
    return len(items) <= 20 and len(set(ids)) == len(ids) and all(s <= 8192 for s in sizes) and sum(sizes) <= 32_768 and not (items and pack.get("authoritative_no_match"))


def _response_ok(response: dict) -> bool:
    blocks, stop = response["content"], response["stop_reason"]
    calls = [b["id"] for b in blocks if b["type"] == "tool_use"]
    texts = [b["text"] for b in blocks if b["type"] == "text"]
    if any(b["type"] == "tool_result" for b in blocks) or len(set(calls)) != len(calls):
        return False
    if stop == "tool_use":
        return bool(calls)
    return not calls and (stop == "max_tokens" or any(texts))


def start_task(event: dict) -> dict:
    p = event["payload"]
    _need(event["sequence"] == 1, "bad_sequence")
    _need(event["event_type"] == "task_started", "not_started")
    _need(bool(re.fullmatch(r"task-[0-9a-f]{32}", event["task_id"])), "bad_task_id")
    _need(all(v > 0 for v in p["budgets"].values()), "bad_budget")
    past = p.get("initial_messages", [])
    _need(history_valid(past), "bad_history")
    link = p.get("session_link")
    _need(not past or link is not None, "unlinked_history")
    _need(link is None or (bool(re.fullmatch(r"session-[0-9a-f]{32}", link["session_id"])) and link["turn_index"] > 0), "bad_link")
    return {
        "task_id": event["task_id"], "status": "created", "budgets": p["budgets"], "messages": [*past, {"role": "user", "content": [{"type": "text", "text": p["issue"]}]}],
        "evidence": {"items": []}, "in_flight": False, "stop": None, "calls": [], "results": [], "done": 0, "dispatched": 0, "active": None, "rounds": 0, "tool_calls": 0, "system": None,
        "final_text": None, "error": None, "last_sequence": 1, "evidence_rounds": 0, "evidence_items": 0, "requests_with_evidence": 0, "tool_errors": 0,
    }


def _context_started(s: dict, p: dict) -> None:
    finished = s["status"] == "awaiting_tool" and s["calls"] and s["active"] is None and s["done"] == len(s["calls"]) == len(s["results"])
    _need(s["status"] == "created" or finished, "context_not_due")
    if finished:
        s["messages"].append({"role": "user", "content": [{"type": "tool_result", **r} for r in s["results"]]})
        s.update(calls=[], results=[], done=0, dispatched=0, active=None)
    s.update(stop=None, status="preparing_context")


def _context_prepared(s: dict, p: dict) -> None:
    _need(s["status"] == "preparing_context", "context_not_open")
    _need(_evidence_ok(p["evidence"]), "bad_evidence")
    s.update(evidence=p["evidence"], status="awaiting_model", evidence_rounds=s["evidence_rounds"] + 1, evidence_items=s["evidence_items"] + len(p["evidence"].get("items", [])))


def _no_match(s: dict, p: dict) -> None:
    done = [*s["messages"], {"role": "assistant", "content": [{"type": "text", "text": p["final_text"]}]}]
    _need(s["status"] == "awaiting_model" and not s["in_flight"] and s["evidence"].get("authoritative_no_match", False) and p["final_text"] and history_valid(done), "no_match_not_due")
    s.update(messages=done, final_text=p["final_text"], status="completed")


def _context_failed(s: dict, p: dict) -> None:
    _need(s["status"] == "preparing_context", "context_not_open")
    s.update(error=p["error"], status="failed")


def _model_started(s: dict, p: dict) -> None:
    r = p["request"]
    _need(s["status"] == "awaiting_model" and not s["in_flight"] and s["stop"] is None, "model_not_due")
    _need(r["messages"] == s["messages"], "request_messages")
    _need(_evidence_ok(r["evidence"]) and r["evidence"] == s["evidence"], "request_evidence")
    _need(not (s["evidence"].get("tool_use_forbidden") and r.get("tools")), "tools_forbidden")
    _need(r["timeout_ms"] == s["budgets"]["model_timeout_ms"], "request_timeout")
    _need(s["system"] is None or r["system_prompt"] == s["system"], "request_system")
    s.update(in_flight=True, system=r["system_prompt"], rounds=s["rounds"] + 1, requests_with_evidence=s["requests_with_evidence"] + bool(r["evidence"].get("items")))


def _model_succeeded(s: dict, p: dict) -> None:
    r = p["response"]
    _need(s["status"] == "awaiting_model" and s["in_flight"], "no_model_call")
    _need(_response_ok(r), "bad_response")
    calls = [{k: b[k] for k in ("id", "name", "arguments")} for b in r["content"] if b["type"] == "tool_use"]
    _need(not (s["evidence"].get("tool_use_forbidden") and calls), "tools_forbidden")
    s["messages"].append({"role": "assistant", "content": r["content"]})
    s.update(in_flight=False, stop=r["stop_reason"])
    if calls:
        s.update(calls=calls, done=0, dispatched=0, active=None, results=[], status="awaiting_tool")


def _model_failed(s: dict, p: dict) -> None:
    _need(s["status"] == "awaiting_model" and s["in_flight"], "no_model_call")
    s.update(in_flight=False, stop=None, error=p["error"], status="failed")


def _tool_started(s: dict, p: dict) -> None:
    _need(s["status"] == "awaiting_tool" and s["dispatched"] < len(s["calls"]) and p["call"] == s["calls"][s["dispatched"]], "tool_order")
    if s["dispatched"] == s["done"]:
        s["active"] = p["call"]["id"]
    s.update(dispatched=s["dispatched"] + 1, tool_calls=s["tool_calls"] + 1)


def _head(s: dict, call_id: str) -> bool:
    return s["status"] == "awaiting_tool" and s["done"] < len(s["calls"]) and call_id == s["calls"][s["done"]]["id"]


def _tool_succeeded(s: dict, p: dict) -> None:
    _need(_head(s, p["result"]["tool_call_id"]), "tool_order")
    s["results"].append(p["result"])
    s.update(done=s["done"] + 1, tool_errors=s["tool_errors"] + bool(p["result"].get("is_error")))
    more = s["dispatched"] > s["done"] and s["tool_calls"] < s["budgets"]["max_tool_calls"]
    s["active"] = s["calls"][s["done"]]["id"] if more else None


def _tool_failed(s: dict, p: dict) -> None:
    _need(_head(s, p["tool_call_id"]), "tool_order")
    s.update(active=None, error=p["error"], status="failed")


def _completed(s: dict, p: dict) -> None:
    last = s["messages"][-1]
    ok = s["status"] == "awaiting_model" and not s["in_flight"] and not s["calls"] and last["role"] == "assistant" and s["stop"] in ("end_turn", "stop_sequence")
    _need(ok and not any(b["type"] == "tool_use" for b in last["content"]) and p["final_text"] == text_of(last["content"]), "completion_differs")
    s.update(final_text=p["final_text"], status="completed")


def _ended(status: str) -> Callable[[dict, dict], None]:
    def apply(s: dict, p: dict) -> None:
        s.update(error=p["error"], status=status)

    return apply


def _spent(message: str) -> dict:
    return {"code": "budget_exceeded", "message": message, "retryable": False}


def _budget_exceeded(s: dict, p: dict) -> None:
    name, idle = p["budget_name"], not s["in_flight"]
    if name == "max_tokens":
        last = s["messages"][-1]
        ok = s["status"] == "awaiting_model" and idle and s["stop"] == "max_tokens" and last["role"] == "assistant" and not any(b["type"] == "tool_use" for b in last["content"])
        _need(ok and p["error"] == _spent("model output token budget exceeded"), "budget_not_spent")
    else:
        _need(p["error"] == _spent(f"{name} budget exceeded") and s["stop"] not in ("max_tokens", "end_turn", "stop_sequence"), "budget_not_spent")
        left = s["done"] < len(s["calls"])
        guards = {
            "max_task_time_ms": s["status"] in ("preparing_context", "awaiting_model") or (s["status"] == "awaiting_tool" and left),
            "max_model_rounds": idle and s["active"] is None and s["status"] == "awaiting_model" and s["stop"] is None and s["rounds"] >= s["budgets"]["max_model_rounds"],
            "max_tool_calls": idle and s["active"] is None and s["status"] == "awaiting_tool" and s["stop"] == "tool_use" and left and s["tool_calls"] >= s["budgets"]["max_tool_calls"],
        }
        _need(guards.get(name, False), "budget_not_spent")
    s.update(error=p["error"], status="budget_exceeded")


STEPS: dict[str, Callable[[dict, dict], None]] = {
    "context_preparation_started": _context_started, "context_prepared": _context_prepared, "knowledge_no_match": _no_match, "context_preparation_failed": _context_failed, "model_call_started": _model_started,
    "model_call_succeeded": _model_succeeded, "model_call_failed": _model_failed, "tool_call_started": _tool_started, "tool_call_succeeded": _tool_succeeded, "tool_call_failed": _tool_failed, "task_completed": _completed,
    "task_failed": _ended("failed"), "task_budget_exceeded": _budget_exceeded, "task_cancelled": _ended("cancelled"),
}


def task_step(state: dict | None, event: dict) -> dict:
    """The next state of a task. The state given isn't used any more after an error."""
    _need(event["schema_version"] == 1, "schema_version")
    if state is None:
        return start_task(event)
    _need(event["task_id"] == state["task_id"], "other_task")
    _need(event["sequence"] == state["last_sequence"] + 1, "bad_sequence")
    _need(state["status"] not in TERMINAL, "already_ended")
    step = STEPS.get(event["event_type"])
    _need(step is not None, "already_started" if event["event_type"] == "task_started" else "unknown_event")
    step(state, event["payload"])
    state["last_sequence"] = event["sequence"]
    return state


def task_passed(s: dict) -> bool:
    return s["status"] == "completed" and bool(s["final_text"]) and s["error"] is None and not s["in_flight"] and s["active"] is None and not s["calls"] and not s["results"]


def memory_step(state: dict, event: dict) -> dict:
    """The next state of the memory log, {} at first: active entries, used ids, checkpoints of sessions."""
    state = state or {"active": {}, "used": [], "checkpoints": {}, "last_sequence": 0, "last_timestamp": ""}
    normal = lambda t: t[:19] + ".000Z" if len(t) == 20 else t
    _need(event["sequence"] == state["last_sequence"] + 1 and normal(event["timestamp"]) >= normal(state["last_timestamp"] or ""), "bad_sequence")
    p, kind = event["payload"], event["event_type"]
    if kind == "memory_upserted":
        e = p["entry"]
        old = state["active"].get(e["memory_id"])
        if old is None:
            _need(e["memory_id"] not in state["used"] and normal(e["created_at"]) == normal(e["updated_at"]), "id_reused")
            state["used"].append(e["memory_id"])
        else:
            fixed = ("category", "scope", "source_session_id", "source_turn_start", "source_turn_end", "created_at", "origin")
            _need(all(old[k] == e[k] for k in fixed) and old["content"] != e["content"] and normal(e["updated_at"]) > normal(old["updated_at"]), "fixed_field")
        state["active"][e["memory_id"]] = e
    elif kind == "memory_forgotten":
        _need(state["active"].pop(p["memory_id"], None) is not None, "not_active")
    else:
        _need(p["through_turn"] > state["checkpoints"].get(p["session_id"], -1), "checkpoint_back")
        state["checkpoints"][p["session_id"]] = p["through_turn"]
    state.update(last_sequence=event["sequence"], last_timestamp=event["timestamp"])
    return state


def session_step(state: dict | None, event: dict) -> dict:
    """The next state of a session: turns start, and are committed or fail; compaction keeps the turns behind it."""
    p, kind = event["payload"], event["event_type"]
    if state is None:
        _need(event["sequence"] == 1 and kind == "session_started", "not_started")
        return {"session_id": event["session_id"], "turns": [], "pending": None, "last_turn": 0, "compacted_through": 0, "summary": None, "last_sequence": 1, "last_timestamp": event["timestamp"]}
    _need(event["session_id"] == state["session_id"] and event["sequence"] == state["last_sequence"] + 1, "bad_sequence")
    if kind == "session_turn_started":
        _need(state["pending"] is None and p["turn_index"] == state["last_turn"] + 1, "turn_order")
        state.update(pending=p, last_turn=p["turn_index"])
    elif kind in ("session_turn_committed", "session_turn_failed"):
        _need(state["pending"] is not None and state["pending"]["turn_index"] == p["turn_index"] and state["pending"]["task_id"] == p["task_id"], "no_pending_turn")
        if kind == "session_turn_committed":
            _need(history_valid(p["messages"]), "bad_history")
            state["turns"].append({"turn_index": p["turn_index"], "messages": p["messages"]})
        state["pending"] = None
    elif kind == "session_compacted":
        _need(state["pending"] is None and state["compacted_through"] < p["through_turn"] and any(t["turn_index"] == p["through_turn"] for t in state["turns"][:-1]), "nothing_to_compact")
        state.update(summary=p["summary"], compacted_through=p["through_turn"], turns=[t for t in state["turns"] if t["turn_index"] > p["through_turn"]])
    else:
        raise Rejected("already_started")
    state.update(last_sequence=event["sequence"], last_timestamp=event["timestamp"])
    return state


TASK_ROW = "task_id string, status string, model_rounds bigint, tool_calls bigint, evidence_rounds bigint, evidence_items bigint, model_requests_with_evidence bigint, tool_error_results bigint, last_sequence bigint, passed boolean, error string"


def task_row(key: str, state: dict | None, error: str | None) -> dict:
    s = state or {}
    names = {"model_rounds": "rounds", "tool_calls": "tool_calls", "evidence_rounds": "evidence_rounds", "evidence_items": "evidence_items", "model_requests_with_evidence": "requests_with_evidence", "tool_error_results": "tool_errors", "last_sequence": "last_sequence"}
    return {"task_id": key, "status": s.get("status"), **{k: s.get(v) for k, v in names.items()}, "passed": bool(s) and error is None and task_passed(s), "error": error}


def replay_tasks(events: DataFrame, strict: bool = True) -> DataFrame:
    """One row per task of events (schema_version, sequence, task_id, event_type, payload as JSON). A log that breaks a rule fails the job, or with strict=False gives a row with the error and the state before it.

    Events are sorted by task and sequence, and stream through: a worker holds one task's state, and no log as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, error = None, None, None
        for batch in batches:
            out = []
            for version, sequence, task, kind, payload in batch.itertuples(index=False):
                if task != key:
                    if key is not None:
                        out.append(task_row(key, state, error))
                    key, state, error = task, None, None
                if error:
                    continue
                try:
                    state = task_step(state, {"schema_version": version, "sequence": sequence, "task_id": task, "event_type": kind, "payload": json.loads(payload)})
                except (Rejected, KeyError, ValueError) as why:
                    if strict:
                        raise
                    error = str(why)
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([task_row(key, state, error)])

    rows = events.select("schema_version", "sequence", "task_id", "event_type", "payload").repartition("task_id").sortWithinPartitions("task_id", "sequence")
    return rows.mapInPandas(run, TASK_ROW)


def evaluate_logs(events: DataFrame) -> DataFrame:
    """A row for each task log: its verdict (pass or fail; null for a broken log), status, metrics and error."""
    return replay_tasks(events, strict=False).withColumn("verdict", F.when(F.col("error").isNull(), F.when(F.col("passed"), "pass").otherwise("fail")))


def verify_logs(events: DataFrame) -> DataFrame:
    """task_id, status and last_sequence of each sound log, or its error."""
    sound = F.col("error").isNull()
    return replay_tasks(events, strict=False).select("task_id", F.when(sound, F.col("status")).alias("status"), F.when(sound, F.col("last_sequence")).alias("last_sequence"), "error")


def latest_entries(events: DataFrame, key: str = "memory_id") -> DataFrame:
    """The live rows of an upsert-and-forget log (sequence, kind, key and content): each key's last event, unless that forgets it."""
    last = events.groupBy(key).agg(F.max_by(F.struct("*"), "sequence").alias("e")).select("e.*")
    return last.where(F.col("kind") != "forget")
