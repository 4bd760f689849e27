"""Small rules against plain Python."""

import json
import random

from pyspark.sql import functions as F

from skein.functions import policy as P
from skein.functions import text as X


def fragment(line, at, n, most):
    """The characters whose bytes are all within the window."""
    size = len(line.encode())
    if size <= most:
        return line
    early = max(0, at - most // 3)
    to = min(size, max(early + most, at + n))
    out, place = [], 0
    for c in line:
        out += [c] if place >= max(early, to - most) and place + len(c.encode()) <= to else []
        place += len(c.encode())
    return "".join(out)


def test_line_fragment(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        line = "".join(rng.choice("ab é日𝄞") for _ in range(rng.randrange(60)))
        starts = [len(line[:k].encode()) for k in range(len(line))] or [0]
        rows.append((i, line, rng.choice(starts)))
    for n, most in ((1, 16), (40, 16), (3, 25)):
        some = [r for r in rows if r[2] + n <= len(r[1].encode())]
        df = spark.createDataFrame(some, "i int, s string, at int").select("i", P.line_fragment(F.col("s"), F.col("at"), n, most).alias("f"))
        assert {r["i"]: r["f"] for r in df.collect()} == {i: fragment(s, at, n, most) for i, s, at in some} and len(some) > 40


def test_values(spark):
    deep = lambda n: "[" * n + "1" + "]" * n
    cases = [("null", True), (None, True), ("{}", True), (deep(16), True), (deep(17), False), (json.dumps([1] * 255), True), (json.dumps([1] * 256), False), ('{"a": NaN}', False), (json.dumps({"k" * 4000: "x" * 96}), True), (json.dumps({"k" * 4000: "x" * 97}), False), ("{", False)]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", P.metadata_ok("c").alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [ok for _, ok in cases]
    flat = spark.createDataFrame([('{"path": "/etc/x", "n": [1, "two", true, null]}',), (None,)], "c string").select(P.flatten_value("c")).collect()
    assert flat[0][0] == "path n two 1 /etc/x" and flat[1][0] is None


def test_codes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(P.backoff_ms(F.lit(n), 100, 1000)) for n in (1, 2, 4, 5, 500)] == [100, 200, 800, 1000, 1000]
    assert one(P.failure_summary(F.lit("completed"))) is None and one(P.failure_summary(F.lit("budget_exceeded"))) == "task budget exceeded"
    assert one(P.canonical_date(F.lit("2024-02-29"))) and not one(P.canonical_date(F.lit("2023-02-29"))) and not one(P.canonical_date(F.lit(None).cast("string")))
    assert one(P.budget_end(F.lit(True), F.lit(9), F.lit(1), F.lit(9), F.lit(1), "x")) == "cancelled" and one(P.budget_end(F.lit(False), F.lit(0), F.lit(1), F.lit(0), F.lit(1), "x")) is None
    assert one(P.no_match_text(F.lit("第 1 条"))) == P.NO_MATCH_ZH
    items = lambda *x: F.lit(None).cast("array<struct<source_id:string,content:string>>") if not x else F.array(*(F.struct(F.lit(i).alias("source_id"), F.lit(c).alias("content")) for i, c in x))
    ok = lambda n, *x: one(P.evidence_ok(items(*x), F.lit(n)))
    assert ok(True) and ok(False, ("a", "x")) and not ok(True, ("a", "x")) and not ok(False, ("a", "x"), ("a", "y")) and not ok(False, ("a", "x" * 8193))


def test_retrieval_opted_out(spark):
    want = {
        "/help": True, " \t\r\n/x": True, "a /x": False, "\n\nb\n/x": False, "": False, " ": False, "\u00a0/x": False, None: None, "Please DO NOT use Rag here": True, "don't use the Knowledge Base": True, "do not use ragged": True,
        "do  not use rag": False, "请不要查询知识库": True, "不使用RAG": True, "不使用 Rag 吗": True, "知识库": False, "x" * 100_000 + "don't use rag": True,
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in rows.select("t", X.retrieval_opted_out(F.col("t"))).collect()} == want
