"""Hand-checked numbers of retrieval, selection and evaluation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import evals, search


def hit(chunk, document="d", sha=None, size=4, neighbor_of=None):
    return {"chunk_id": chunk, "document_id": document, "sha256": sha or chunk, "bytes": size, "neighbor_of": neighbor_of}


def legs(spark, a, b):
    leg = lambda xs: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(xs)], "q int, d string, rank int")
    return leg(a), leg(b)


def test_rrf(spark):
    got = search.fuse(*legs(spark, ["a", "b"], ["b", "c"]), "q", "d", 1.0).orderBy("rank").collect()
    assert [r["d"] for r in got] == ["b", "a", "c"] and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    got = search.fuse(*legs(spark, ["lexical", "shared"], ["dense", "shared"]), "q", "d").orderBy("rank").collect()
    assert [r["d"] for r in got] == ["shared", "dense", "lexical"] and got[0]["score"] == pytest.approx(4 / 62)


def selected(spark, hits, top_k, room, required=()):
    schema = "q int, chunk_id string, document_id string, sha256 string, bytes bigint, neighbor_of string, rank int, required int"
    rows = [(1, h["chunk_id"], h["document_id"], h["sha256"], h["bytes"], h["neighbor_of"], i, required.index(h["document_id"]) if h["document_id"] in required else None) for i, h in enumerate(hits)]
    return [r["chunk_id"] for r in search.select_evidence(spark.createDataFrame(rows, schema), "q", top_k, room).orderBy("place").collect()]


def test_selection(spark):
    hits = [hit("p1", "d1", "x"), hit("p2", "d2", "x"), hit("p3", "d1", "y"), hit("p4", "d1", "z"), hit("p5", "d2", "w")]
    assert selected(spark, hits, 5, 100) == ["p1", "p3", "p5"]
    assert selected(spark, [hit("long", size=30), hit("short", size=4)], 5, 10) == ["short"]
    assert selected(spark, [], 5, 10) == []
    around = [hit("a", "d1"), hit("b", "d2"), hit("n", "d1", neighbor_of="a")]
    assert selected(spark, around, 2, 100) == ["a", "n"]
    assert selected(spark, around, 2, 100, ["d2", "d1"]) == ["b", "a"]
    assert selected(spark, around, 3, 100, ["d2"]) == ["b", "a", "n"]  # b has no neighbour; n comes when a is there
    capped = [*hits[:1], hits[2], hit("p4", "d1", "z"), hit("p6", "d3", "z")]
    assert selected(spark, capped, 5, 100) == ["p1", "p3", "p6"]  # p4 is a document's third, so that its content is free
    assert selected(spark, [hit("a", "d1", size=6), hit("n", "d1", size=6, neighbor_of="a"), hit("b", "d2", size=4)], 3, 10) == ["a", "b"]


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, "a", 60), (1, "b", 70), (1, "c", 40)], "q int, item string, size int")
    got = search.greedy_bytes(rows, "q", "item", "size", [F.col("item")], 100).orderBy("place").collect()
    assert [r["item"] for r in got] == ["a", "c"]


def test_common_term_is_dropped(spark):
    docs = spark.createDataFrame([(i, "common beta" + (" rare" if i == 3 else "")) for i in range(8)], "id int, text string")
    asked = spark.createDataFrame([(1, "common rare")], "q int, text string")
    index = search.postings(docs, "id", "text")
    got = search.lexical(index, search.index_stats(docs, F.lit(2)), asked, "id", "q", "text").collect()
    assert [r["id"] for r in got] == [3]


def test_dense_and_gate(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, None)], "id int, v array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "q int, v array<float>")
    hits = search.dense(rows, asked, "id", "q", "v")
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [1, 2, 3]
    assert search.dense_gate(hits, "q", 1.5).count() == 0 and search.dense_gate(hits, "q", 0.9).count() == 3
    several = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(9)], "q int, v array<float>")
    whole = search.dense(rows, several, "id", "q", "v")
    assert whole.count() == 27 and whole.exceptAll(search.dense(rows, several, "id", "q", "v", block=2)).isEmpty()  # in blocks
    among = search.dense_among(rows, asked, spark.createDataFrame([(9, 2), (9, 3)], "q int, id int"), "id", "q", "v")
    assert [(r["id"], r["rank"]) for r in among.orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_tokens(spark):
    got = spark.createDataFrame([("HTTPParser parse_json 修复知识库检索 été Straße",)], "t string").select(X.tokens(F.col("t"))).first()[0]
    assert {"httpparser", "http", "parser", "parse_json", "parse", "json", "知", "知识", "检索", "t", "é"} <= set(got)


@pytest.mark.parametrize(
    ("text", "bad"),
    [("token sk-ABCDEFGHIJKLMNOP1", True), ("Bearer abcdefghijkl", True), ('"password": "hunter22"', True), ("api_key=abcd", True), ("-----BEGIN RSA PRIVATE KEY-----", True), ("password: should have a length of 12 characters", False), ("passwords are hard", False), ("risk-free", False)],
)
def test_sensitive(spark, text, bad):
    assert spark.createDataFrame([(text,)], "t string").select(X.looks_sensitive(F.col("t"))).first()[0] is bad


@pytest.mark.parametrize(
    ("call", "name"), [("cat ~/.ssh/id", "ssh_keys"), ("see docs/.ssh/readme", None), ("C:\\Users\\me\\.aws\\x", "aws_creds"), ("RM -RF x", "destructive"), ("vi /etc/hosts", "host_etc"), ("ls", None)]
)
def test_dangerous(spark, call, name):
    assert spark.createDataFrame([(call,)], "t string").select(X.dangerous(F.lit("run"), F.col("t"))).first()[0] == name


def test_scores(spark):
    ranked = spark.createDataFrame([("c", i + 1, d) for i, d in enumerate(["x", "d2", "d2", "d1"])] + [("e", 1, "x")], "case_id string, rank int, item_id string")
    wanted = spark.createDataFrame([("c", "d1"), ("c", "d2"), ("e", None), ("f", None)], "case_id string, item_id string")
    got = {r["case_id"]: r for r in evals.score_cases(ranked, wanted).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["c"]["recall_at_5"] == 1 and got["c"]["reciprocal_rank"] == 0.5
    assert got["c"]["ndcg_at_10"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
    assert got["e"]["no_answer_false_positive"] and not got["f"]["no_answer_false_positive"] and not got["e"]["positive"]


def test_threshold(spark):
    rows = spark.createDataFrame([(0.9, True), (0.7, True), (0.4, True), (0.65, False), (0.2, False)], "score double, positive boolean")
    got = evals.fit_threshold(rows).first()
    assert (got["threshold"], got["false_positive_rate"]) == (0.7, 0) and got["recall"] == pytest.approx(2 / 3)


def test_products(spark):
    """All pairs against sums in order; halves go away from zero, whatever the order in which a product of matrices adds them up."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)] + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [1.0]), (203, []), (None, [1.0] * 5), (204, [0.5**6, 0.0, 0.0, 0.0, 0.0]), (205, [0.1, 0.2, 0.3, 1e300, 0.0])]
    asked = [(i, v) for i, v in rows if i is not None and i % 50 == 0 or i in (201, 202, 203)] + [(300, [0.001 * 0.5**3, 0.0, 0.0, 0.0, 0.0]), (301, [-0.001 * 0.5**3, 0.0, 0.0, 0.0, 0.0]), (302, [0.0, 0.0, 0.0, 1e5, 1.0])]
    schema = "{} bigint, embedding array<double>"

    def want(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        y = s * 1e5
        return s if math.isinf(y) else (math.floor(abs(y) + 0.5) / 1e5) * (1 if y > 0 else -1)

    vectors = spark.createDataFrame(rows, schema.format("vec_id")).repartition(3)
    for block in (4096, 4):
        got = search.products(vectors, spark.createDataFrame(asked, schema.format("query_id")), "vec_id", "query_id", "embedding", block=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((i, q, want(v, w)) for i, v in rows for q, w in asked), key=repr)
    assert search.products(vectors, vectors.limit(0).select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", "embedding").count() == 0
    assert search.products(vectors.limit(0), vectors.select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", "embedding").count() == 0


def test_products_deal_pairs(spark, monkeypatch):
    """Tasks have a bounded number of pairs, and no join carries the vectors of both sides."""
    monkeypatch.setattr(search, "_PAIRS", 100)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(100)], "vec_id int, embedding array<float>").coalesce(1)
    out = search.products(rows, rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding")
    assert out.rdd.getNumPartitions() == 18 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["vec_id"], r["query_id"]): r["score"] for r in out.collect()} == {(i, q): float(i * q) for i in range(100) for q in range(0, 100, 10)}
