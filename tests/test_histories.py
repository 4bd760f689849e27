"""Sessions and memories by windows, against the step functions one event at a time."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import histories, replay

SESSION = "session_id string, sequence bigint, timestamp string, kind string, turn_index bigint, task_id string, through_turn bigint, history_ok boolean"
MEMORY = "sequence bigint, timestamp string, kind string, memory_id string, content string, fixed string, created_at string, updated_at string, session_id string, through_turn bigint"
GOOD = [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]


def stamp(n):
    return f"2024-01-01T00:{n // 60:02d}:{n % 60:02d}Z"


def session_logs(seed, n=60):
    rng = random.Random(seed)
    for s in range(n):
        rows, turn, open_, done = [("session_started", None, None, None, True)], 0, None, []
        for _ in range(rng.randrange(12)):
            roll = rng.random()
            if open_ is None and roll < 0.75:
                turn += rng.choice([1] * 20 + [0, 2])
                rows.append(("session_turn_started", turn, f"t{turn}", None, None))
                open_ = turn
            elif open_ is not None and roll < 0.9:
                kind = rng.choice(["session_turn_committed", "session_turn_committed", "session_turn_failed"])
                rows.append((kind, open_ if rng.random() < 0.95 else open_ + 1, f"t{open_}", None, rng.random() < 0.95))
                done += [open_] if kind.endswith("committed") else []
                open_ = None
            else:
                rows.append(("session_compacted", None, None, rng.choice(done) if done else 1, None))
        for i, (kind, index, task, through, ok) in enumerate(rows):
            yield f"s{s:02d}", i + 1 + (i > 4 and s % 10 == 9), stamp(i), kind, index, task, through, ok


def stepped(rows):
    state, error = None, None
    for _, sequence, timestamp, kind, index, task, through, ok in rows:
        payload = {"turn_index": index, "task_id": task, "through_turn": through, "summary": "s", "messages": GOOD if ok else GOOD[:1]}
        try:
            state = replay.session_step(state, {"session_id": "x", "sequence": sequence, "timestamp": timestamp, "event_type": kind, "payload": payload} | {"session_id": rows[0][0]})
        except replay.Rejected as why:
            error = str(why)
            break
    return state["last_turn"], state["pending"] and state["pending"]["turn_index"], len(state["turns"]), state["compacted_through"], state["last_sequence"], error


def test_sessions_step_by_step(spark):
    rows = list(session_logs(4))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {k: stepped(v) for k, v in by.items()}
    got = {r["session_id"]: tuple(r[c] for c in ("last_turn", "pending", "turns", "compacted_through", "last_sequence", "error")) for r in histories.replay_sessions(spark.createDataFrame(rows, SESSION).repartition(3)).collect()}
    assert got == want and len({w[-1] for w in want.values()}) >= 4


def test_broken_session_fails_the_list(spark):
    states = histories.replay_sessions(spark.createDataFrame([("s", 2, stamp(1), "session_started", None, None, None, None)], SESSION))
    assert [r["error"] for r in states.collect()] == ["bad_sequence"]
    with pytest.raises(ValueError, match="broken"):
        histories.list_sessions(states)


def memory_log(seed, n=40):
    rng, rows = random.Random(seed), []
    alive, used = {}, []
    for i in range(n):
        roll = rng.random()
        if roll < 0.4 or not alive:
            name = f"m{len(used)}" if rng.random() < 0.98 or not used else rng.choice(used)
            rows.append([i + 1, stamp(i), "memory_upserted", name, "c0", "f", stamp(i), stamp(i), None, None])
            alive[name] = 0
            used.append(name)
        elif roll < 0.7:
            name = rng.choice(list(alive))
            alive[name] += rng.random() < 0.97
            rows.append([i + 1, stamp(i), "memory_upserted", name, f"c{alive[name]}", "f" if rng.random() < 0.98 else "g", stamp(0), stamp(i), None, None])
        elif roll < 0.85:
            name = rng.choice(list(alive)) if rng.random() < 0.97 else "nobody"
            alive.pop(name, None)
            rows.append([i + 1, stamp(i), "memory_forgotten", name, None, None, None, None, None, None])
        else:
            rows.append([i + 1, stamp(i), "memory_checkpointed", None, None, None, None, None, "s", i if rng.random() < 0.97 else 0])
    return rows


def test_memory_step_by_step(spark):
    for seed in range(4):
        rows = memory_log(seed)
        state, error = {}, None
        for sequence, at, kind, name, content, fixed, created, updated, session, through in rows:
            entry = {"memory_id": name, "content": content, "created_at": created, "updated_at": updated, **dict.fromkeys(("category", "scope", "source_session_id", "source_turn_start", "source_turn_end", "origin"), fixed)}
            if name in state.get("active", {}):
                entry["created_at"] = state["active"][name]["created_at"]
            try:
                state = replay.memory_step(state, {"sequence": sequence, "timestamp": at, "event_type": kind, "payload": {"entry": entry, "memory_id": name, "session_id": session, "through_turn": through}})
            except replay.Rejected as why:
                error = sequence, str(why)
                break
        live, marks, first = histories.replay_memory(spark.createDataFrame([tuple(r) for r in rows], MEMORY).repartition(3), strict=False)
        assert {(r["memory_id"], r["content"]) for r in live.collect()} == {(k, e["content"]) for k, e in state["active"].items()}
        assert {r["session_id"]: r["through_turn"] for r in marks.collect()} == state["checkpoints"]
        assert [tuple(r) for r in first.collect()] == ([error] if error else [])
        if error:
            with pytest.raises(replay.Rejected):
                histories.replay_memory(spark.createDataFrame([tuple(r) for r in rows], MEMORY))


def test_history_column(spark):
    text, use = {"type": "text"}, {"type": "tool_use", "id": "c1"}
    answer = {"type": "tool_result", "tool_call_id": "c1"}
    turn = lambda role, *blocks: {"role": role, "content": [{"type": b["type"], "id": b.get("id"), "tool_call_id": b.get("tool_call_id")} for b in blocks]}
    cases = [
        [], [turn("user", text), turn("assistant", text)], [turn("user", text)], [turn("assistant", text), turn("user", text)], [turn("user", text), turn("assistant", use)],
        [turn("user", text), turn("assistant", use), turn("user", answer), turn("assistant", text)], [turn("user", text), turn("assistant", use), turn("user", text), turn("assistant", text)],
        [turn("user", text), turn("assistant", use, use), turn("user", answer, answer), turn("assistant", text)], [turn("user", answer), turn("assistant", text)], [turn("user"), turn("assistant", text)],
    ]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m array<struct<role: string, content: array<struct<type: string, id: string, tool_call_id: string>>>>")
    got = [r["ok"] for r in rows.select("i", histories.history_ok(F.col("m")).alias("ok")).orderBy("i").collect()]
    assert got == [replay.history_valid(c) for c in cases] and got.count(True) == 3
