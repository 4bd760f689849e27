"""Outcomes of candidates against a walk over them one by one."""

import random

from skein.operators import memories

CANDIDATE = "session_id string, place bigint, category string, scope string, content string, turn_end bigint"


def walked(candidates, entries, sessions, forgotten):
    there, out = {(c, s or "", x) for c, s, x in entries}, {}
    for session, place, category, scope, content, end in sorted(candidates, key=lambda r: r[1]):
        through, workspace = sessions.get(session, (0, ""))
        key = (category, scope or "", content)
        if end <= (through or 0):
            out[place] = "done"
        elif not (content or "").strip(" ") or len(content.encode()) > 4096 or "password =" in content:
            out[place] = "unsafe"
        elif category not in memories.CATEGORIES:
            out[place] = "category"
        elif scope and workspace and scope != workspace:
            out[place] = "scope"
        elif content in forgotten:
            out[place] = "forgotten"
        elif key in there:
            out[place] = "duplicate"
        else:
            out[place] = "append"
            there.add(key)
    return out


def test_outcomes(spark):
    rng = random.Random(4)
    contents = ["likes tea", "uses make", "é" * 2048, "é" * 2049, "", " ", None, "password = hunter2hunter2", *(f"fact {i}" for i in range(12))]
    rows = [(rng.choice(["a", "b", "c", "d", None]), i, rng.choice([*memories.CATEGORIES, "other", None]), rng.choice(["", "/w", "/v", None]), rng.choice(contents), rng.randint(1, 9)) for i in range(600)]
    sessions = {"a": (3, "/w"), "b": (None, None), "c": (0, "/v")}
    entries = [("fact", None, "fact 1"), ("fact", "", "fact 1"), ("fact", "/w", "fact 2"), ("decision", "", "fact 3")]
    frames = [
        spark.createDataFrame(rows, CANDIDATE).repartition(5), spark.createDataFrame(entries, "category string, scope string, content string"),
        spark.createDataFrame([(k, *v) for k, v in sessions.items()], "session_id string, checkpoint bigint, workspace string"), spark.createDataFrame([("fact 4",), ("fact 4",), (None,)], "content string"),
    ]
    got = memories.commit_outcomes(*frames).collect()
    assert len(got) == len(rows)
    assert {r["place"]: r["outcome"] for r in got} == walked(rows, entries, sessions, {"fact 4"})
    assert {r["outcome"] for r in got} == {"done", "unsafe", "category", "scope", "forgotten", "duplicate", "append"}
    assert memories.commit_outcomes(frames[0].limit(0), *frames[1:]).count() == 0
    assert all(r["outcome"] == "append" or r["outcome"] in ("unsafe", "category", "duplicate") for r in memories.commit_outcomes(frames[0], *(f.limit(0) for f in frames[1:])).collect())
