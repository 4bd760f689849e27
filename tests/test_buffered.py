"""The buffered sink: flushes by number, commits by batch, and a batch that is run again."""

import json
import os
import shutil

import pytest
from pyspark.sql import Row

from skein.sources import buffered

SCHEMA = "id bigint, name string, cost double"


def run(spark, folder, out, checkpoint, **options):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    buffered.append(events, str(out), str(checkpoint), **options).trigger(availableNow=True).start().awaitTermination()


def test_batches_are_added_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text("".join(json.dumps({"id": 100 * k + i, "name": "é", "cost": i / 4}) + "\n" for i in range(70)))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k * 60,) * 2)
    assert buffered.read(spark, str(out), SCHEMA).count() == 0
    run(spark, folder, out, checkpoint, milliseconds=10**9)
    want = sorted((100 * k + i, "é", i / 4) for k in range(2) for i in range(70))
    assert sorted(tuple(r) for r in buffered.read(spark, str(out), SCHEMA).collect()) == want
    told = buffered.commits(spark, str(out)).collect()
    assert sorted((r["batch"], r["rows"], r["flushes"]) for r in told) == [(0, 70, 3), (1, 70, 3)]  # 32, 32 and 6 rows
    assert sum(r["bytes"] for r in told) == sum(f.stat().st_size for f in (out / "data").glob("*.jsonl"))
    # the checkpoint has lost that the last batch was committed: it is run again, and adds nothing
    for f in (checkpoint / "commits").iterdir():
        if f.name.strip(".").split(".")[0] == "1":
            f.unlink()
    run(spark, folder, out, checkpoint)
    assert sorted(tuple(r) for r in buffered.read(spark, str(out), SCHEMA).collect()) == want and len(list((out / "data").glob("*.jsonl"))) == 2
    # files that no commit names aren't there for readers
    shutil.copy(next((out / "data").glob("*.jsonl")), out / "data" / "rows-lost.jsonl")
    assert buffered.read(spark, str(out), SCHEMA).count() == 140


def test_lines_are_canonical():
    assert buffered.line(Row(b=1, a=Row(z=None, y="é"))) == '{"a":{"y":"é","z":null},"b":1}\n'.encode()
    with pytest.raises(ValueError):
        buffered.line(Row(x=float("nan")))
