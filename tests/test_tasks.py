"""Task logs as JSON lines on disk: walks of the automaton, sound and with one mutation each, against what their maker knows."""

import json

import pytest
from traces import property_logs

from skein.operators import replay
from skein.sources import logs
from skein.streaming.tasks import EVENT


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_and_mutations(spark, tmp_path, seed):
    made = list(property_logs(seed, 250))
    folder = tmp_path / "logs"
    folder.mkdir()
    lines = [json.dumps(e | {"timestamp": "2024-01-01T00:00:00Z", "correlation_id": "c"}) for events, _ in made for e in events]
    for k in range(3):  # a task's lines are in any file, blank lines among them
        (folder / f"{k}.jsonl").write_text("\n\n".join(lines[k::3]) + "\n")
    events = logs.read_log(spark, str(folder), EVENT, "task")
    got = {r["task_id"]: tuple(r) for r in replay.replay_tasks(events, strict=False).collect()}
    want = {row[0]: row for _, row in made}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    statuses, errors = {w[1] for w in want.values()}, {w[-1] for w in want.values()}
    assert statuses >= {"created", "preparing_context", "awaiting_model", "awaiting_tool", "completed", "failed", "budget_exceeded", "cancelled"} and len(errors) >= 10
    verdicts = {r["task_id"]: r["verdict"] for r in replay.evaluate_logs(events).collect()}
    assert verdicts == {k: None if w[-1] else "pass" if w[-2] else "fail" for k, w in want.items()}
    sound = {r["task_id"]: (r["status"], r["last_sequence"], r["error"]) for r in replay.verify_logs(events).collect()}
    assert sound == {k: (None, None, w[-1]) if w[-1] else (w[1], w[8], None) for k, w in want.items()}
