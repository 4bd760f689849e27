"""The queries with SQL against it, and the pipeline's stages on a small table."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import duckdb_on, same

from skein.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark):
    same(queries.queries()[name](spark, SF), duckdb_on(SF), queries.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline as cp
    from skein.llm import decontamination, neardup, quality, substrings
    from skein.llm._shared import written

    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        docs, before = written(stage(spark, docs, SF), name), docs
        assert set(before.columns) <= set(docs.columns) and 0 < docs.count() <= before.count()
        if name == "quality":
            kept = {r["doc_id"] for r in quality.digest(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        elif name == "near_dedup":
            assert docs.count() == neardup.link(before).where("kept").count() and neardup.link(docs).where("not kept").isEmpty()
        elif name == "substring_dedup":
            assert substrings.digest(docs, cp.PASSAGE).where("n_removed > 0").isEmpty()
        elif name == "decontamination":
            assert decontamination.digest(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").isEmpty()
        else:
            assert docs.where("decoded <> text OR n_tokens <> size(token_ids)").isEmpty()
    assert cp.run(spark, SF).count() == docs.count()
    assert [cp.STAGES[k][1](spark, before.limit(0), SF).count() for k in (1, 2, 3, 4)] == [0] * 4


def test_pipeline_against_brute_force(spark):
    """Each stage's rows, written out in plain Python over what the stage before has kept; the network's scores are taken as they are."""
    import base64
    import re

    import corpus_pipeline as cp
    import public_tokenizers
    import tiktoken

    from skein.llm import quality
    from skein.llm._shared import written

    spaced, alnum, lower = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {65 + i: 97 + i for i in range(26)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    text = {i: t for i, t in text.items() if score[i] >= 0.7}
    got = docs = written(cp.good_quality(spark, docs, SF), "q")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == text and len(text) > 50

    sets = {}
    for i, t in text.items():
        ws = spaced.findall(t.translate(lower))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    least = {i: i for i in text}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in text:
        for j in text:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    text = {i: t for i, t in text.items() if root(i) == i}
    docs = written(cp.one_of_each(spark, docs, SF), "n")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == text

    words, first = {i: spaced.findall(t) for i, t in text.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - cp.PASSAGE + 1):
            first.setdefault(tuple(words[i][k : k + cp.PASSAGE]), i)
    kept = {}
    for i, ws in words.items():
        gone = {k + j for k in range(len(ws) - cp.PASSAGE + 1) if first[tuple(ws[k : k + cp.PASSAGE])] < i for j in range(cp.PASSAGE)}
        if len(gone) < len(ws) or not ws:
            kept[i] = [w for k, w in enumerate(ws) if k not in gone]
    docs = written(cp.without_passages(spark, docs, SF), "s")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i: spaced.findall(t) for i, t in text.items()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = alnum.findall((r["text"] or "").translate(lower))
        n = min(13, len(ws))
        grams |= {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()
    clean = {}
    for i, t in text.items():
        ws = alnum.findall(t.translate(lower))
        hit = {k + j for n in {len(g) for g in grams} for k in range(len(ws) - n + 1) if tuple(ws[k : k + n]) in grams for j in range(n)}
        if not hit or 20 * len(hit) < len(ws):
            clean[i] = t
    docs = written(cp.without_benchmarks(spark, docs, SF), "d")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == clean

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r["doc_id"]: (list(r["token_ids"]), r["n_tokens"], r["decoded"]) for r in cp.as_tokens(spark, docs, SF).collect()}
    assert last == {i: (ids := own.encode_ordinary(t), len(ids), t) for i, t in clean.items()}


def test_pipeline_with_nulls_repeats_and_clashes(spark):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")).unionAll(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionAll(docs.limit(2).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")}))
    docs = docs.unionAll(docs.limit(5)).unionAll(odd)
    docs = docs.withColumns({c: F.lit("own") for c in ("row", "class", "spans", "items", "n_words", "score", "least", "key", "label")})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count() and out.where("spans <> 'own' or items <> 'own' or n_words <> 'own' or score <> 'own' or `row` <> 'own' or class <> 'own'").isEmpty()
    assert cp.as_tokens(spark, docs, SF).count() == docs.count()
