"""The stored index and the full query on a toy corpus of two documents with hand-made vectors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.operators import hybrid, index, order

CHUNKS = [
    ("a1", "d1", "1 CFR 1.1", "alpha legal opening", None, "a2"),
    ("a2", "d1", "1 CFR 1.1", "context following alpha", "a1", None),
    ("b1", "d2", "2 CFR 2.1", "beta legal rule", None, "b2"),
    ("b2", "d2", "2 CFR 2.1", "gamma unrelated", "b1", None),
]


def meaning(text):
    low = text.lower()
    v = [float("alpha" in low), float("beta" in low or "1 cfr" in low), float("gamma" in low or "1 cfr" in low)]
    return v if any(v) else [0.01, 0.01, 0.01]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(c, d, cite, text, hashlib.sha256(text.encode()).hexdigest(), len(text.split()), a, b) for c, d, cite, text, a, b in CHUNKS]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, citation string, content string, sha256 string, token_count int, previous_id string, next_id string")
    vectors = spark.createDataFrame([(c, meaning(t), "x") for c, _, _, t, _, _ in CHUNKS], "chunk_id string, embedding array<double>, embedding_sha256 string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.write(chunks, vectors, path)
    return index.read(spark, path), chunks, vectors, path


def asked(spark, *texts):
    return spark.createDataFrame([(i, t, meaning(t or "")) for i, t in enumerate(texts)], "query_id int, text string, embedding array<double>")


def run(spark, stored, *texts, **more):
    items, outcomes = hybrid.query(stored[0], asked(spark, *texts), **more)
    assert hybrid.result_errors(items, outcomes, more.get("top_k", 5), more.get("most_bytes", 32_768)).isEmpty()
    got = {i: [] for i in range(len(texts))}
    for r in items.orderBy("query_id", "place").collect():
        got[r["query_id"]].append(r["chunk_id"])
    return got, {r["query_id"]: r["outcome"] for r in outcomes.collect()}


@pytest.mark.parametrize("mode", hybrid.MODES)
def test_modes_and_citations(spark, stored, mode):
    got, outcome = run(spark, stored, "alpha opening", "what says 9 CFR 9.9", "compare 1 CFR 1.1 with 2 CFR 2.1", "1 CFR 1.1 and 9 CFR 9.9", " ", " ".join(f"1 CFR {i}" for i in range(9)), mode=mode, top_k=3)
    assert outcome == {0: "matched", 1: "authoritative_no_match", 2: "matched", 3: "authoritative_no_match", 4: "invalid", 5: "invalid"}
    assert got[0][:2] == ["a1", "a2"] and got[1] == got[3] == got[4] == got[5] == []
    assert {x[0] for x in got[2]} == {"a", "b"} and len(got[2]) == 3


def test_gate_and_neighbour(spark, stored):
    got, outcome = run(spark, stored, "alpha gamma", "alpha", mode="hybrid", dense_min=0.9 * 2)
    assert set(outcome.values()) == {"below_threshold"} and not got[0] and not got[1]
    got, outcome = run(spark, stored, "beta", mode="dense", top_k=2)
    assert got[0] == ["b1", "b2"]  # the best hit and its neighbour
    got, _ = run(spark, stored, "beta", mode="dense", most_bytes=16)
    assert got[0] == ["b1"]
    with pytest.raises(ValueError):
        hybrid.check_bounds(21, 10, "dense")


def test_result_errors(spark, stored):
    items, outcomes = hybrid.query(stored[0], asked(spark, "beta"), mode="lexical", top_k=2)
    bad = items.withColumn("content", F.concat("content", F.lit("!"))).withColumn("lexical_rank", F.when(F.col("place") == 1, 101))
    assert {r["error"] for r in hybrid.result_errors(bad, outcomes.limit(0), 1, 3).collect()} == {"rank", "digest", "items", "outcome"}
    assert {r["error"] for r in hybrid.result_errors(items.where("place = 2"), outcomes, 2, 100).collect()} == {"neighbor"}


def test_index_checks(spark, stored, tmp_path):
    _, chunks, vectors, path = stored
    assert index.chunk_errors(chunks).isEmpty()
    for change, error in ((F.when(F.col("chunk_id") == "a1", "b1").otherwise(F.col("next_id")), "neighbor"), (F.when(F.col("chunk_id") == "a1", "zz").otherwise(F.col("next_id")), "neighbor")):
        assert {r["error"] for r in index.chunk_errors(chunks.withColumn("next_id", change)).collect()} == {error}
    with pytest.raises(ValueError, match="differ"):
        index.write(chunks, vectors.limit(3), path)
    with pytest.raises(ValueError, match="finite"):
        index.write(chunks, vectors.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0))), str(tmp_path / "i"))
    assert index.read(spark, path).chunks.count() == 4  # what was published before still is
    assert [tuple(r) for r in index.row_numbers(chunks).orderBy("vector_row").collect()] == [("a1", 0), ("a2", 1), ("b1", 2), ("b2", 3)]
    kept, new = index.to_encode(chunks.withColumn("identity", F.lit("m2")), vectors.withColumn("identity", F.lit("m1")), "sha256")
    assert kept.count() == 0 and new.count() == 4


def test_running_sums(spark):
    rows = spark.range(1000).repartition(7).select("id", (F.col("id") % 5).alias("x"))
    got = {r["id"]: (r["n"], r["s"]) for r in order.running(rows, [F.desc("id")], {"n": F.lit(1), "s": F.col("x")}).collect()}
    assert got == {i: (1000 - i, sum(j % 5 for j in range(i, 1000))) for i in range(1000)}
    assert order.numbered(rows.limit(0), [F.col("id")], "n").count() == 0


def test_legs_are_found_once(spark, stored, monkeypatch):
    """Three modes over the same legs give what each gives alone, and postings and vectors are searched once; nothing that is written leaves shuffle files behind."""
    calls = []
    for name in ("lexical_hits", "dense"):
        plain = getattr(hybrid.search, name)
        monkeypatch.setattr(hybrid.search, name, lambda *a, _f=plain, _n=name: calls.append(_n) or _f(*a))
    texts = ("alpha opening", "compare 1 CFR 1.1 with 2 CFR 2.1", "what says 9 CFR 9.9", "beta rule")
    own, found = asked(spark, *texts), None
    found = hybrid.legs(stored[0], own)
    rows = lambda t: [sorted(map(repr, x.collect())) for x in t]
    together = [rows(hybrid.query(stored[0], own, mode=m, dense_min=0.5, found=found)) for m in hybrid.MODES]
    assert sorted(calls) == ["dense", "lexical_hits", "lexical_hits"]
    assert together == [rows(hybrid.query(stored[0], own, mode=m, dense_min=0.5)) for m in hybrid.MODES]


def test_stored_drops_shuffles(spark):
    from skein.sources import shared

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name, None), []
    probe = spark.range(3).repartition(2)
    with shared.dropping_shuffles(spark):
        seen.append(spark.conf.get(name))
    assert seen == ["true"] and spark.conf.get(name, None) == before and shared.stored(probe, "probe").count() == 3
