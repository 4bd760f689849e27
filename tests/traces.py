"""Logs of tasks for tests: short ones of four kinds, and valid walks of the automaton with one mutation each, whose outcome the maker knows without replaying them."""

import copy
import json
import random

BUDGETS = {"model_timeout_ms": 7, "max_model_rounds": 50, "max_tool_calls": 50, "max_task_time_ms": 9}


def task_trace(task, issue, kind):
    """Completed, failed or cancelled by kind, or with an end that differs from the answer."""
    user, answer = {"role": "user", "content": [{"type": "text", "text": issue}]}, {"type": "text", "text": "done"}
    request = {"messages": [user], "evidence": {"items": []}, "tools": [], "timeout_ms": 1000, "system_prompt": "s"}
    ends = [("task_completed", {"final_text": "done"}), ("task_failed", {"error": {"message": "x"}}), ("task_cancelled", {"error": {"message": "y"}}), ("task_completed", {"final_text": "other"})]
    steps = [
        ("task_started", {"issue": issue, "budgets": {"model_timeout_ms": 1000, "max_model_rounds": 4, "max_tool_calls": 4, "max_task_time_ms": 9000}}),
        ("context_preparation_started", {}),
        ("context_prepared", {"evidence": {"items": []}}),
        ("model_call_started", {"request": request}),
        ("model_call_succeeded", {"response": {"content": [answer], "stop_reason": "end_turn"}}),
        ends[kind % 4],
    ]
    return [{"schema_version": 1, "task_id": task, "sequence": i + 1, "event_type": name, "payload": json.dumps(p)} for i, (name, p) in enumerate(steps)]


def walk(rng, task):
    """(events, status after each of them): a valid log that ends in any of the states."""
    out, text = [], lambda t: {"type": "text", "text": t}

    def add(kind, status, **payload):
        out.append(({"schema_version": 1, "sequence": len(out) + 1, "task_id": task, "event_type": kind, "payload": copy.deepcopy(payload)}, status))

    spent = lambda message: {"code": "budget_exceeded", "message": message, "retryable": False}
    budgets, calls_made = dict(BUDGETS, max_model_rounds=rng.choice([1, 2, 50]), max_tool_calls=rng.choice([1, 2, 50])), 0
    past = [{"role": "user", "content": [text("old")]}, {"role": "assistant", "content": [text("answer")]}] if rng.random() < 0.3 else []
    link = {"session_link": {"session_id": "session-" + "a" * 32, "turn_index": 2}} if past else {}
    add("task_started", "created", issue="i", budgets=budgets, initial_messages=past, **link)
    messages = [*past, {"role": "user", "content": [text("i")]}]
    for rounds in range(rng.randrange(1, 5)):
        if rng.random() < 0.05:
            add(rng.choice(["task_failed", "task_cancelled"]), None, error={"message": "x"})
            out[-1] = out[-1][0], {"task_failed": "failed", "task_cancelled": "cancelled"}[out[-1][0]["event_type"]]
            return out
        add("context_preparation_started", "preparing_context")
        if rng.random() < 0.05:
            add("context_preparation_failed", "failed", error={"message": "x"})
            return out
        evidence = {"items": [{"source_id": f"s{i}", "content": "c"} for i in range(rng.randrange(3))]}
        no_match = rng.random() < 0.07
        if no_match:
            evidence = {"items": [], "authoritative_no_match": True}
        add("context_prepared", "awaiting_model", evidence=evidence)
        if no_match:
            add("knowledge_no_match", "completed", final_text="none")
            return out
        if rounds >= budgets["max_model_rounds"]:
            add("task_budget_exceeded", "budget_exceeded", budget_name="max_model_rounds", error=spent("max_model_rounds budget exceeded"))
            return out
        if rng.random() < 0.05:
            add("task_budget_exceeded", "budget_exceeded", budget_name="max_task_time_ms", error=spent("max_task_time_ms budget exceeded"))
            return out
        add("model_call_started", "awaiting_model", request={"messages": messages, "evidence": evidence, "tools": [], "timeout_ms": 7, "system_prompt": "s"})
        if rng.random() < 0.05:
            add("model_call_failed", "failed", error={"message": "x"})
            return out
        roll = rng.random()
        if roll < 0.3:
            stop = rng.choice(["end_turn", "stop_sequence", "max_tokens"])
            content = [text("a"), text("b")]
            add("model_call_succeeded", "awaiting_model", response={"content": content, "stop_reason": stop})
            if stop == "max_tokens":
                add("task_budget_exceeded", "budget_exceeded", budget_name="max_tokens", error=spent("model output token budget exceeded"))
            else:
                add("task_completed", "completed", final_text="ab")
            return out
        calls = [{"id": f"c{rounds}-{i}", "name": "t", "arguments": {"n": i}} for i in range(rng.randrange(1, 4))]
        content = [text("x"), *({"type": "tool_use", **c} for c in calls)]
        add("model_call_succeeded", "awaiting_tool", response={"content": content, "stop_reason": "tool_use"})
        results, sent = [], 0
        while len(results) < len(calls):
            if sent < len(calls) and (sent == len(results) or rng.random() < 0.5):  # dispatch runs ahead of completion
                if sent == len(results) and calls_made >= budgets["max_tool_calls"]:
                    add("task_budget_exceeded", "budget_exceeded", budget_name="max_tool_calls", error=spent("max_tool_calls budget exceeded"))
                    return out
                add("tool_call_started", "awaiting_tool", call=calls[sent])
                sent, calls_made = sent + 1, calls_made + 1
            elif rng.random() < 0.04:
                add("tool_call_failed", "failed", tool_call_id=calls[len(results)]["id"], error={"message": "x"})
                return out
            else:
                results.append({"tool_call_id": calls[len(results)]["id"], "content": "r", "is_error": rng.random() < 0.3})
                add("tool_call_succeeded", "awaiting_tool", result=results[-1])
        messages = [*messages, {"role": "assistant", "content": content}, {"role": "user", "content": [{"type": "tool_result", **r} for r in results]}]
    return out


#: What is done to an event, for which kinds, and the rule that it breaks.
MUTATIONS = [
    ("bad_sequence", None, lambda e: e.update(sequence=e["sequence"] + 1)),
    ("schema_version", None, lambda e: e.update(schema_version=2)),
    ("unknown_event", "later", lambda e: e.update(event_type="nothing")),
    ("already_started", "later", lambda e: e.update(event_type="task_started")),
    ("bad_budget", "task_started", lambda e: e["payload"]["budgets"].update(max_tool_calls=0)),
    ("bad_evidence", "context_prepared", lambda e: e["payload"].update(evidence={"items": [{"source_id": "s", "content": "x" * 9000}]})),
    ("request_messages", "model_call_started", lambda e: e["payload"]["request"]["messages"].pop()),
    ("request_evidence", "model_call_started", lambda e: e["payload"]["request"].update(evidence={"items": [{"source_id": "zz", "content": ""}]})),
    ("request_timeout", "model_call_started", lambda e: e["payload"]["request"].update(timeout_ms=8)),
    ("bad_response", "model_call_succeeded", lambda e: e["payload"]["response"].update(content=[], stop_reason="end_turn")),
    ("tool_order", "tool_call_started", lambda e: e["payload"]["call"].update(arguments={})),
    ("tool_order", "tool_call_succeeded", lambda e: e["payload"]["result"].update(tool_call_id="nobody")),
    ("tool_order", "tool_call_failed", lambda e: e["payload"].update(tool_call_id="nobody")),
    ("completion_differs", "task_completed", lambda e: e["payload"].update(final_text="other")),
    ("no_match_not_due", "knowledge_no_match", lambda e: e["payload"].update(final_text="")),
    ("budget_not_spent", "task_budget_exceeded", lambda e: e["payload"]["error"].update(retryable=True)),
    ("budget_not_spent", "task_budget_exceeded", lambda e: e["payload"].update(budget_name="max_things")),
]


def property_logs(seed, n):
    """(events, outcome) of n tasks; outcome is the row that replay is to give, from the walk alone."""
    rng = random.Random(seed)
    for t in range(n):
        task = f"task-{seed:016x}{t:016x}"
        steps = walk(rng, task)
        if t % 7 == 6:
            steps = steps[: rng.randrange(1, len(steps) + 1)]  # a log that isn't at its end
        events, error, held = [e for e, _ in steps], None, len(steps)
        if t % 2:
            error, kind, change = rng.choice(MUTATIONS)
            places = [i for i, e in enumerate(events) if kind is None or (i > 0 if kind == "later" else e["event_type"] == kind)]
            if places:
                held = rng.choice(places)
                change(events[held])
            else:
                error = None
        done = [e for e, _ in steps[:held]]
        count = lambda kind: sum(e["event_type"] == kind for e in done)  # noqa: E731, B023
        items = [len(e["payload"]["evidence"]["items"]) for e in done if e["event_type"] == "context_prepared"]
        asked = sum(bool(e["payload"]["request"]["evidence"]["items"]) for e in done if e["event_type"] == "model_call_started")
        bad = sum(e["payload"]["result"]["is_error"] for e in done if e["event_type"] == "tool_call_succeeded")
        status = steps[held - 1][1] if held else None
        metrics = (count("model_call_started"), count("tool_call_started"), len(items), sum(items), asked, bad, held) if held else (None,) * 7
        yield events, (task, status, *metrics, error is None and status == "completed", error)
