"""The encoder: batches within their bounds, one model for each worker, and an error for each text that fails."""

import numpy as np
import pytest

from skein.operators import encoder


def test_batches():
    assert list(encoder.batches([], 2, 9)) == []
    assert list(encoder.batches([1, 1, 1, 99, 1, 5, 5], 2, 9)) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]


def test_identity_and_bounds():
    make = lambda **more: encoder.Encoder(dict, 3, "m", **more)
    assert make().identity == make(batch_rows=3).identity != make(precision="half").identity
    with pytest.raises(ValueError):
        encoder.Encoder(dict, 0, "m")


def test_encode(spark, tmp_path):
    place = str(tmp_path)

    def load():
        import os

        open(f"{place}/{os.getpid()}", "a").write("x")  # as often as a worker loads it

        def model(texts):
            if any("raise" in t for t in texts):
                raise RuntimeError("no")
            if any("shape" in t for t in texts):
                return np.zeros((len(texts), 2))
            if len(texts) > 4 or (len(texts) > 1 and sum(len(t) for t in texts) > 40):
                raise ValueError("the batch is too large")
            value = lambda t: [float("nan")] * 3 if "nan" in t else [0.0] * 3 if "zero" in t else [1e-200, 0, 0] if "tiny" in t else [len(t), 1.0, 0.0]
            return [value(t) for t in texts]

        return model

    texts = ["a", "bb", None, "", "raise", "shape", "nan", "zero", "tiny", "x" * 1000, *["ccc"] * 20]
    rows = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "id int, text string, error string").repartition(2)
    got = {r["id"]: r for r in encoder.encode(rows, encoder.Encoder(load, 3, "m", batch_rows=4, batch_bytes=40)).collect()}
    want = {2: "empty", 3: "empty", 4: "failed: RuntimeError", 5: "shape", 6: "not_finite", 7: "zero"}
    assert {i: r["error"] for i, r in got.items()} == {i: want.get(i) for i in range(len(texts))}
    assert all((r["embedding"] is None) == (i in want) for i, r in got.items()) and got[8]["embedding"] == [1.0, 0.0, 0.0]
    for i in (0, 1, 9, 20):
        v = np.array([len(texts[i]), 1.0, 0.0])
        assert np.allclose(got[i]["embedding"], v / np.linalg.norm(v), atol=1e-12)
    assert all(p.read_text() == "x" for p in tmp_path.iterdir())
    assert encoder.encode(rows.limit(0), encoder.Encoder(load, 3, "m")).count() == 0
