"""Messages from parts: whole, in any order and batch, with repeats, and with one thing wrong."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_streams import rows_of

from skein.operators import messages
from skein.streaming import messages as stream

PART = "message_id string, sequence bigint, timestamp string, data string"


def message(rng):
    """Parts of a message and its blocks, stop reason and usage."""
    usage = {"input_tokens": rng.randrange(9), "output_tokens": 1}
    parts = [{"type": "message_start", "message": {"id": "m", "type": "message", "role": "assistant", "content": [], "stop_reason": None, "usage": dict(usage)}}]
    blocks = []
    for i in range(rng.randrange(4)):
        if rng.random() < 0.5:
            text = ["", *(rng.choice(["é", "x\n", '"q"', ""]) for _ in range(rng.randrange(5)))]
            text[0] = rng.choice(["", "start "])
            parts.append({"type": "content_block_start", "index": i, "content_block": {"type": "text", "text": text[0]}})
            parts += [{"type": "content_block_delta", "index": i, "delta": {"type": "text_delta", "text": t}} for t in text[1:]]
            blocks.append({"type": "text", "text": "".join(text)})
        else:
            value = rng.choice([{}, {"b": [1, 2.5], "a": "é\n"}, {"deep": {"x": None}}])
            raw = json.dumps(value) if value or rng.random() < 0.5 else ""
            at = rng.randrange(len(raw) + 1)
            parts.append({"type": "content_block_start", "index": i, "content_block": {"type": "tool_use", "id": f"c{i}", "name": "n", "input": {}}})
            parts += [{"type": "content_block_delta", "index": i, "delta": {"type": "input_json_delta", "partial_json": t}} for t in (raw[:at], raw[at:])]
            blocks.append({"type": "tool_use", "id": f"c{i}", "name": "n", "input": value})
        parts.append({"type": "content_block_stop", "index": i})
        if rng.random() < 0.3:
            parts.append({"type": "ping"})
    if rng.random() < 0.3:
        parts.append({"type": "message_delta", "delta": {"stop_reason": None}, "usage": {"output_tokens": 2}})
    stop = rng.choice(messages.STOPS)
    more = {"input_tokens": usage["input_tokens"] + 4} if rng.random() < 0.3 else {}
    usage = {"output_tokens": 7, "input_tokens": more.get("input_tokens", usage["input_tokens"])}
    parts.append({"type": "message_delta", "delta": {"stop_reason": stop}, "usage": {"output_tokens": 7, **more}})
    parts.append({"type": "message_stop"})
    return parts, (blocks, stop, usage["input_tokens"], usage["output_tokens"])


def first_of(parts, kind):
    return next((i for i, p in enumerate(parts) if p["type"] == kind), None)


#: What is done to a message: the change gives the place of the first wrong part, or None if it can't be made.
def put(kind, change):
    def apply(parts):
        i = first_of(parts, kind)
        if i is not None:
            change(parts[i])
        return i

    return apply


WRONG = [
    ("bad_part", put("message_start", lambda p: p["message"].update(role="user"))), ("bad_part", put("message_start", lambda p: p["message"]["usage"].pop("input_tokens"))), ("bad_part", put("content_block_start", lambda p: p.update(index=9))),
    ("bad_part", put("content_block_delta", lambda p: p["delta"].update(type="other"))), ("bad_part", put("content_block_stop", lambda p: p.update(index=True))), ("bad_part", put("message_stop", lambda p: p.update(type="message_start"))),
    ("provider_error", put("message_stop", lambda p: p.update(type="error"))), ("bad_part", lambda parts: parts.insert(0, {"type": "message_stop"}) or 0), ("after_stop", lambda parts: parts.append({"type": "message_stop"}) or len(parts) - 1),
    ("incomplete", lambda parts: parts.pop() and len(parts)), ("bad_json", lambda parts: parts.insert(1, "{") or 1), ("bad_json", lambda parts: parts.insert(1, '{"type": "ping", "type": "ping"}') or 1), ("bad_json", lambda parts: parts.insert(1, '{"type": "ping", "x": NaN}') or 1),
]


def made(seed, n):
    rng, rows, want = random.Random(seed), [], {}
    for k in range(n):
        parts, (blocks, stop, given, used) = message(rng)
        key, error, held = f"m{k:03d}", None, len(parts)
        if k % 2:
            error, change = rng.choice(WRONG)
            held = change(parts)
            if held is None:
                error, held = None, len(parts)
        rows += [(key, i + 1, "t", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(parts)]
        if error:
            want[key] = (None, None, held, error)
        else:
            want[key] = ("".join(b["text"] for b in blocks if b["type"] == "text"), json.dumps(blocks, sort_keys=True, separators=(",", ":"), ensure_ascii=False), held, None, stop, given, used)
    return rows, want


def told(rows):
    return {r["message_id"]: (r["text"], r["blocks"], r["parts"], r["error"], *(() if r["error"] else (r["stop_reason"], r["input_tokens"], r["output_tokens"]))) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    rows, want = made(seed, 150)
    assert len({w[3] for w in want.values()}) >= 5
    parts = spark.createDataFrame(rows + rows[::3], PART).repartition(5)  # some come twice
    assert told(messages.assemble(parts).collect()) == want
    lost = parts.where("message_id <> 'm000' or sequence <> 2")
    assert {r["error"] for r in messages.assemble(lost).where("message_id = 'm000'").collect()} == {"bad_sequence"}
    assert messages.assemble(parts.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    """In three batches at random, with repeats: each message as in batch, when it is whole."""
    rows, want = made(3, 60)
    rng = random.Random(4)
    batches = [[], [], []]
    for r in rows:
        batches[rng.randrange(3)].append(r)
    batches[2] += rng.sample(rows, 40)
    rows_of(spark, PART, batches, tmp_path / "in", stream.assemble, tmp_path / "cp", tmp_path / "out")
    out = spark.read.schema(messages.MESSAGE).json(f"{tmp_path}/out/*").withColumn("n", F.regexp_extract(F.input_file_name(), r"/(\d+)/part", 1).cast("int"))
    last = out.groupBy("message_id").agg(F.max_by(F.struct("*"), F.struct("n", F.col("error").isNotNull())).alias("r")).select("r.*")
    assert told(last.collect()) == {k: w for k, w in want.items() if w[3] != "incomplete"}


def test_patience(spark, tmp_path):
    """A message that doesn't end in time is an error."""
    import time

    whole, want = made(3, 8)
    open_ = next(k for k, w in want.items() if w[3] is None)
    part = [r for r in whole if r[0] == open_][:-1]
    folder = tmp_path / "in"
    folder.mkdir()
    names = [x.split()[0] for x in PART.split(", ")]
    (folder / "0.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part))
    parts = stream.assemble(spark.readStream.schema(PART).json(str(folder)), patience_ms=1)
    found: list = []
    query = parts.writeStream.foreachBatch(lambda rows, n: found.extend((r["message_id"], r["error"], r["parts"]) for r in rows.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(300):  # timers are looked at in batches without data
        if found or not query.isActive:
            break
        time.sleep(0.2)
    query.stop()
    assert found == [(open_, "incomplete", len(part))]
