"""The stages of compaction and the bytes of a request, against plain loops over lists of messages."""

import json
import random

from pyspark.sql import functions as F

from skein.operators import compaction

BLOCK = "conv_id bigint, message int, block int, role string, type string, text string, id string, name string, arguments string, tool_call_id string, content string"
MARK = "<think>"


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(["a", "é", '"', "\\", "\n", "\x01", "{", ":", "\\n", "😀", "/"]) for _ in range(rng.randrange(6)))
    if kind < 5:
        return rng.choice([1, -2.5, 1e30, True, False, None])
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}\"": value(rng, depth + 1) for i in range(rng.randrange(4))}


def sent(v):
    quoted = lambda s: 2 + sum(6 if ord(c) < 32 else 2 if c in '"\\' else len(c.encode()) for c in s)
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, list):
        return 2 + sum(1 + sent(x) for x in v)
    return 2 + sum(2 + quoted(k) + sent(x) for k, x in v.items()) if isinstance(v, dict) else 32


def conversation(rng):
    out = []
    for _ in range(rng.randrange(1, 9)):
        blocks = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["text", "text", "tool_use", "tool_result"])
            if kind == "text":
                blocks.append({"type": kind, "text": "".join(rng.choice(["abc ", "é", MARK, MARK, "a long run of words "]) for _ in range(rng.randrange(8)))})
            elif kind == "tool_use":
                blocks.append({"type": kind, "id": "c1", "name": "näme", "arguments": json.dumps(value(rng), ensure_ascii=rng.random() < 0.5)})
            else:
                blocks.append({"type": kind, "tool_call_id": "c1", "content": rng.choice(["x", "é"]) * rng.randrange(60)})
        out.append({"role": rng.choice(["user", "assistant"]), "content": blocks})
    return out


def size(messages):
    one = lambda b: len((b.get("text") or "").encode()) if b["type"] == "text" else len((b["id"] + b["name"]).encode()) + 64 if b["type"] == "tool_use" else len((b["tool_call_id"] + b["content"]).encode())
    return sum(one(b) for m in messages for b in m["content"])


def compacted(messages, threshold, most):
    messages = json.loads(json.dumps(messages))
    for m in messages:
        for b in m["content"]:
            raw = b.get("content", "").encode()
            if b["type"] == "tool_result" and len(raw) > most:
                b["content"] = raw[:most].decode(errors="ignore") + compaction.CUT_NOTE
    if size(messages) <= threshold:
        return messages, 1
    results = [(m, b) for m in messages for b in m["content"] if b["type"] == "tool_result"]
    total = sum(len(b["content"].encode()) for _, b in results)
    for m, b in results[:-1]:
        if threshold and total > threshold:
            m["content"] = [x for x in m["content"] if x is not b]
            total -= len(b["content"].encode())
    messages = [m for m in messages if m["content"]]  # what is left is rows of blocks
    if size(messages) <= threshold:
        return messages, 2
    texts = [b for m in messages for b in m["content"] if b["type"] == "text"]
    marked = sum(len(b["text"].encode()) - len(b["text"].split(MARK)[0].encode()) for b in texts if MARK in b["text"])
    if marked > threshold:
        for b in texts:
            b["text"] = "".join(b["text"].split(MARK)[::2])
    if size(messages) <= threshold:
        return messages, 3
    out = []
    for m in messages:
        if out and out[-1]["role"] == m["role"]:
            out[-1]["content"] += m["content"]
        else:
            out.append(m)
    return out, 4


def rows_of(conversations):
    names = [x.split()[0] for x in BLOCK.split(", ")]
    return [tuple({"conv_id": k, "message": i, "block": j, "role": m["role"], **b}.get(n) for n in names) for k, c in conversations.items() for i, m in enumerate(c) for j, b in enumerate(m["content"])]


def test_stages(spark):
    rng = random.Random(1)
    made = {k: conversation(rng) for k in range(150)}
    made[1000] = [{"role": "user", "content": [{"type": "text", "text": f"abc {MARK}{'x' * 120}{MARK}end"}]}]
    blocks = spark.createDataFrame(rows_of(made), BLOCK).repartition(3).cache()
    seen = set()
    for threshold, most in ((90, 21), (150, 1000)):
        got = {}
        for r in compaction.compact(blocks, threshold, most).orderBy("conv_id", "message", "block").collect():
            messages, stage = got.setdefault(r["conv_id"], ([], r["stage"]))
            assert stage == r["stage"]
            if not messages or messages[-1][0] != r["message"]:
                messages.append((r["message"], r["role"], []))
            keys = {"text": ("text",), "tool_use": ("id", "name", "arguments"), "tool_result": ("tool_call_id", "content")}[r["type"]]
            messages[-1][2].append({"type": r["type"], **{k: r[k] for k in keys}})
        for k, c in made.items():
            want, stage = compacted(c, threshold, most)
            assert k in got or not any(m["content"] for m in want)
            if k in got:
                assert got[k][1] == stage and [(role, content) for _, role, content in got[k][0]] == [(m["role"], m["content"]) for m in want], (k, threshold)
                seen.add(stage)
    assert seen == {1, 2, 3, 4}
    want = {k: 4 + sum(sent(json.loads(b["arguments"])) - 64 for m in c for b in m["content"] if b["type"] == "tool_use") + size(c) for k, c in made.items()}
    assert {r["conv_id"]: r["bytes"] for r in compaction.context_bytes(blocks, system_prompt="é", user_text="ab").collect()} == want
    assert compaction.compact(blocks.limit(0), 1, 1).count() == 0


def test_value_bytes(spark):
    rng = random.Random(2)
    values = [value(rng) for _ in range(300)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").withColumn("v", F.parse_json("j"))
    assert {r["i"]: r["n"] for r in rows.select("i", compaction.value_bytes("v").alias("n")).collect()} == {i: sent(v) for i, v in enumerate(values)}
