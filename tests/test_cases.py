"""Evaluation cases against a plain walk over the same documents in the order of their hashes, and what makes a set of cases wrong."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skein.functions.policy import ZH_TERMS
from skein.operators import cases

DOC = "document_id string, citation string, path string, title string, content string"
CHUNK = "document_id string, citation string, path string, title string, chunk_id string, next_id string, content string"
CASE = "case_id string, split string, language string, query string, relevant_document_ids array<string>, relevant_chunk_ids array<string>, kind string, rationale string"
CURATED = "case_id string, language string, query string, kind string, citations array<string>, rationale string, source_snapshot string"


def documents(n):
    """Every third title has known concepts; some documents can't give a case."""
    rows = []
    for i in range(n):
        title = f"Part {i}" + (" Safety RECORDS and safety notice permit training" if i % 3 == 0 else "")
        rows.append((f"doc-{i}", f"{i % 50} CFR {i}", f"t/{i}.md", None if i % 41 == 7 else " " if i % 41 == 8 else title, None if i % 17 == 3 else f"§ {i}. It's a rule-{i} of x 1st alpha b2 gamma delta eps zeta eta theta iota kappa"))
    return rows


def chunks(docs):
    return [(d, c, p, t, f"{d}-c{k}", f"{d}-c{k + 1}" if k < 2 else None, f"{x} part {k}") for d, c, p, t, x in docs for k in range(3)]


def hashed(key):
    return hashlib.sha256(f"eval-v2:{key}".encode()).hexdigest()


def words(text, n):
    return " ".join(re.findall(r"[A-Za-z][A-Za-z0-9'-]+", text or "")[:n])


def concepts(title):
    return list(dict.fromkeys(ZH_TERMS[w] for w in re.findall("[a-z]+", title.lower()) if w in ZH_TERMS))


def expected(docs, parts, sizes):
    """case id: (split, language, query, documents, chunks)."""
    sound = sorted((d for d in docs if d[3] and d[3].strip()), key=lambda d: hashed(d[0]))
    a, b, m = sizes["citation"], sizes["paraphrase_en"], sizes["multi_concept"]
    out = [("citation", i, "en", d[1], [d[0]], []) for i, d in enumerate(sound[:a])]
    out += [("paraphrase-en", i, "en", f"What federal requirements apply to {d[3]}? {words(d[4], 8)}", [d[0]], []) for i, d in enumerate(sound[a : a + b])]
    known = [d for d in sound if concepts(d[3])]
    out += [("cross-language-zh", i, "zh", f"关于{'、'.join(concepts(d[3])[:4])}，这条美国联邦法规规定了什么？", [d[0]], []) for i, d in enumerate(known[: sizes["cross_language_zh"]])]
    two = sound[a + b : a + b + 2 * m]
    out += [("multi-concept", i, "en", f"Compare the federal requirements for {x[3]} and {y[3]}.", [x[0], y[0]], []) for i, (x, y) in enumerate(zip(two[::2], two[1::2], strict=False))]
    linked = sorted((c for c in parts if c[5] and c[3] and c[3].strip()), key=lambda c: hashed(c[4]))
    out += [("adjacent-context", i, "en", f"What context immediately follows the rule about {c[3]}? {words(c[6], 10)}", [c[0]], [c[5]]) for i, c in enumerate(linked[: sizes["adjacent_context"]])]
    return {f"pos-{kind}-{i + 1:03d}": (("holdout", "development")[serial % 2], *rest) for serial, (kind, i, *rest) in enumerate(out, 1)}


def negatives(spark, each=25, labelled=False):
    rows = [(f"neg-{kind}-{i}", "development" if i % 2 else "holdout", "en", f"question {i}", ["doc-1"] if labelled and i == 0 else [], [], kind, "none") for kind in ("no_answer", "hostile_query") for i in range(each)]
    return spark.createDataFrame(rows, CASE)


@pytest.fixture(scope="module")
def index(spark):
    docs = documents(260)
    return docs, chunks(docs), spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(chunks(docs), CHUNK).repartition(3)


def test_all_kinds(spark, index):
    docs, parts, d, c = index
    got = cases.generate(d, c, negatives(spark), spark.createDataFrame([("cur-1", "en", "which rule", "citation", ["1 CFR 1", "2 CFR 2"], "read", "s")], CURATED), snapshot="s").collect()
    made = {r["case_id"]: (r["split"], r["language"], r["query"], r["relevant_document_ids"], r["relevant_chunk_ids"]) for r in got if r["case_id"].startswith("pos-")}
    assert made == expected(docs, parts, cases.POSITIVES) and len(made) == 250
    other = {r["case_id"]: r for r in got if not r["case_id"].startswith("pos-")}
    assert len(other) == 51 and len(got) == 301
    assert other["cur-1"]["split"] == "holdout" and other["cur-1"]["relevant_document_ids"] == ["doc-1", "doc-2"] and other["cur-1"]["rationale"] == "Frozen source-checked case: read"
    reasons = {r["case_id"]: r["rationale"] for r in got}
    first = next(r for r in got if r["case_id"] == "pos-adjacent-context-001")
    chunk = next(x for x in parts if x[5] == first["relevant_chunk_ids"][0])
    assert reasons["pos-adjacent-context-001"] == f"Adjacent-chunk label {chunk[5]} follows primary {chunk[4]} in {chunk[1]} at {chunk[2]}."


def test_long_questions_are_cut(spark):
    docs = [(f"d{i}", "c", "p", "é" * 20_000, "w") for i in range(4)]
    rows = cases.positives(spark.createDataFrame(docs, DOC), spark.createDataFrame([], CHUNK), dict.fromkeys(cases.POSITIVES, 0) | {"paraphrase_en": 2, "multi_concept": 1}).collect()
    assert sorted((r["kind"], len(r["query"])) for r in rows) == [("multi_concept", 16_000), ("paraphrase_en", 16_000), ("paraphrase_en", 16_000)]


def test_empty_tables(spark):
    none = cases.positives(spark.createDataFrame([], DOC), spark.createDataFrame([], CHUNK))
    assert none.count() == 0
    errors = {(r["error"], r["of"]) for r in cases.composition_errors(none).collect()}
    assert errors == {("few", k) for k in [*cases.POSITIVES, *cases.NEGATIVES, "all"]} | {("split", "development"), ("split", "holdout")}


@pytest.mark.parametrize("each, labelled", [(24, False), (26, False), (25, True)])
def test_wrong_negatives(spark, index, each, labelled):
    with pytest.raises(ValueError, match="without an answer"):
        cases.generate(index[2], index[3], negatives(spark, each, labelled))


def test_too_few_documents(spark, index):
    with pytest.raises(ValueError, match="composed"):
        cases.generate(index[2].where(F.col("document_id") < "doc-2"), index[3], negatives(spark))


def test_curated_errors(spark, index):
    good = ("en", "q", "citation", ["1 CFR 1"], "why", "s")
    rows = [
        ("ok", *good), ("zh", "zh", "问", "cross_language_zh", ["1 CFR 1"], "why", "s"), ("twice", *good), ("twice", *good), ("kind", "en", "q", "no_answer", ["1 CFR 1"], "why", "s"), ("nokind", "en", "q", None, ["1 CFR 1"], "why", "s"),
        ("lang", "fr", *good[1:]), ("lang-zh", "en", "q", "cross_language_zh", ["1 CFR 1"], "why", "s"), ("lang-en", "zh", "q", "paraphrase_en", ["1 CFR 1"], "why", "s"), ("blank", "en", " ", *good[2:]), ("null", "en", None, *good[2:]),
        ("zero", "en", "a\0b", *good[2:]), ("long", "en", "é" * 8193, *good[2:]), ("fits", "en", "é" * 8192, *good[2:]), ("why", *good[:4], "", "s"), ("old", *good[:5], "t"), ("five", *good[:3], ["1 CFR 1", "2 CFR 2", "3 CFR 3", "4 CFR 4", "5 CFR 5"], "why", "s"),
        ("none", *good[:3], [], "why", "s"), ("lost", *good[:3], ["99 CFR 9"], "why", "s"), ("same", *good[:3], ["1 CFR 1", "1 CFR 1"], "why", "s"),
    ]
    got = {(r["case_id"], r["error"]) for r in cases.curated_cases(spark.createDataFrame(rows, CURATED), index[2], "s").collect()}
    want = {
        "ok": None, "zh": None, "fits": None, "twice": "repeated", "kind": "kind", "nokind": "kind", "lang": "language", "lang-zh": "language", "lang-en": "language", "blank": "query", "null": "query", "zero": "query", "long": "query",
        "why": "rationale", "old": "snapshot", "five": "count", "none": "count", "lost": "missing", "same": "repeated",
    }
    assert got == set(want.items())


def test_label_and_composition_errors(spark, index):
    rows = [
        ("a", "development", "en", "q", ["doc-1"], ["doc-1-c1"], "citation", ""), ("b", "development", "en", "q", ["doc-1", "gone"], [], "citation", ""), ("c", "development", "en", "q", ["doc-1"], ["doc-2-c0"], "adjacent_context", ""),
        ("d", "development", "en", "q", ["doc-1"], ["gone"], "citation", ""), ("e", "development", "en", "q", [], ["doc-2-c0"], "cross_language_zh", ""), ("e", "development", "fr", "q", [], None, "paraphrase_en", ""),
    ]
    own = spark.createDataFrame(rows, CASE)
    assert {tuple(r) for r in cases.label_errors(own, index[2], index[3]).collect()} == {("b", "gone", "document"), ("c", "doc-2-c0", "owner"), ("d", "gone", "chunk")}
    assert {tuple(r) for r in cases.composition_errors(own, {"citation": 3, "multi_concept": 1, "cross_language_zh": 1, "paraphrase_en": 0}, 6).collect()} == {("few", "multi_concept"), ("language", "cross_language_zh"), ("language", "paraphrase_en"), ("split", "holdout"), ("repeated", "e")}
