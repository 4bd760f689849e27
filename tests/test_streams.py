"""Session and memory streams: equal to the batch form on the same logs, in any cut into batches, after a restart, and from a snapshot."""

import json
import os
import random

from pyspark.sql import functions as F
from test_histories import MEMORY, SESSION, memory_log, session_logs

from skein.operators import histories as batch
from skein.streaming import histories as stream


def rows_of(spark, schema, parts, folder, replay, checkpoint, out, start=0):
    """What comes out of the parts, one a batch, by the query of a checkpoint."""
    folder.mkdir(exist_ok=True)
    names = [x.split()[0] for x in schema.split(", ")]
    for k, part in enumerate(parts, start):
        path = folder / f"{k}.json"
        path.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part))
        os.utime(path, (1_700_000_000 + k * 60,) * 2)  # files come in the order of their times
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    write = lambda rows, n: rows.write.mode("overwrite").json(f"{out}/{n}")
    replay(events).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def read(spark, out, schema):
    return spark.read.schema(schema).json(f"{out}/*").withColumn("n", F.regexp_extract(F.input_file_name(), r"/(\d+)/part", 1).cast("int"))


STATE = ("last_turn", "pending", "turns", "compacted_through", "last_sequence", "error")


def last_states(spark, out):
    rows = read(spark, out, stream.SESSION_OUT).where("output = 'state'").groupBy("session_id").agg(F.max_by(F.struct(*STATE), "n").alias("s"))
    return {r["session_id"]: tuple(r["s"]) for r in rows.collect()}


def test_sessions_in_order_with_a_restart_and_from_a_snapshot(spark, tmp_path):
    logs = list(session_logs(4, 40))
    frame = spark.createDataFrame(logs, SESSION)
    want = {r["session_id"]: tuple(r[c] for c in STATE) for r in batch.replay_sessions(frame).collect()}
    errors = {(r["session_id"], r["error"]) for r in batch.until_error(batch.session_errors(frame), "session_id")[1].collect()}
    assert len({w[-1] for w in want.values()}) >= 4
    cuts = [[r for r in logs if (r[1] - 1) // 3 == k] for k in range(5)]
    run = lambda part, out, replay, start=0, cp="cp": rows_of(spark, SESSION, part, tmp_path / f"in-{cp}", replay, tmp_path / cp, tmp_path / out, start)
    strict = lambda e: stream.replay_sessions(e, patience_ms=0)
    run(cuts[:2], "out", strict)
    run(cuts[2:], "out", strict, start=2)  # the query starts anew from its checkpoint
    assert last_states(spark, tmp_path / "out") == want
    told = read(spark, tmp_path / "out", stream.SESSION_OUT).where("output = 'error'")
    assert sorted((r["session_id"], r["error"]) for r in told.collect()) == sorted(errors)
    early = spark.createDataFrame([r for c in cuts[:2] for r in c], SESSION)
    run(cuts[2:], "later", lambda e: stream.replay_sessions(e, 0, stream.session_snapshot(early)), cp="cp2")
    got = last_states(spark, tmp_path / "later")
    assert got and got == {k: want[k] for k in got}


def test_early_events_wait(spark, tmp_path):
    """Each session's events in any batch: sound logs end as in batch; behind a gap events wait."""
    rng = random.Random(1)
    logs = [r for r in session_logs(4, 40) if r[0][-1] != "5" or r[1] != 2]  # a tenth lacks its second event
    judged = {r["session_id"]: r["error"] for r in batch.replay_sessions(spark.createDataFrame(logs, SESSION)).collect()}
    gap = {k for k, e in judged.items() if e == "bad_sequence"}
    want = {r["session_id"]: tuple(r[c] for c in STATE) for r in batch.replay_sessions(spark.createDataFrame(logs, SESSION)).collect()}
    where = {r: rng.randrange(3) for r in logs}
    rows_of(spark, SESSION, [[r for r in logs if where[r] == k] for k in range(3)], tmp_path / "in", stream.replay_sessions, tmp_path / "cp", tmp_path / "out")
    got = last_states(spark, tmp_path / "out")
    assert gap and {k: v for k, v in got.items() if k not in gap} == {k: v for k, v in want.items() if k not in gap}
    ends = read(spark, tmp_path / "out", stream.SESSION_OUT).where("output = 'state'").groupBy("session_id").agg(F.max_by(F.struct("waiting", "error"), "n").alias("w"))
    assert {r["session_id"] for r in ends.collect() if r["w"]["waiting"]} == gap and {r["w"]["error"] for r in ends.collect() if r["session_id"] in gap} == {None}


def test_memories(spark, tmp_path):
    """Three logs in one stream, out of order, the first ten events of each from a snapshot."""
    logs = {f"log{seed}": [tuple(r) for r in memory_log(seed)] for seed in range(3)}
    schema = "log_id string, " + MEMORY
    first, rest = [], []
    for k, rows in logs.items():
        first.append(stream.memory_snapshot(spark.createDataFrame(rows[:10], MEMORY), k))
        rest += [(k, *r) for r in rows[10:]]
    rng = random.Random(2)
    where = [rng.randrange(3) for _ in rest]
    snapshot = first[0].unionByName(first[1]).unionByName(first[2])
    rows_of(spark, schema, [[r for r, w in zip(rest, where, strict=True) if w == k] for k in range(3)], tmp_path / "in", lambda e: stream.replay_memory(e, snapshot=snapshot), tmp_path / "cp", tmp_path / "out")
    out = read(spark, tmp_path / "out", stream.MEMORY_OUT).collect()
    for k, rows in logs.items():
        live, marks, error = batch.replay_memory(spark.createDataFrame(rows, MEMORY), strict=False)
        mine = [r for r in out if r["log_id"] == k]
        assert [(r["sequence"], r["error"]) for r in mine if r["output"] == "error"] == [tuple(r) for r in error.collect() if r["sequence"] > 10]
        changed = {}
        for r in sorted((r for r in mine if r["output"] in ("entry", "forgotten")), key=lambda r: r["sequence"]):
            changed[r["memory_id"]] = r["content"]
        now = {r["memory_id"]: r["content"] for r in live.collect()}
        assert changed == {m: now.get(m) for m in changed} and len(changed) > 1
        top = {r["session_id"]: r["through_turn"] for r in sorted((r for r in mine if r["output"] == "checkpoint"), key=lambda r: r["sequence"])}
        assert top.items() <= {r["session_id"]: r["through_turn"] for r in marks.collect()}.items()
