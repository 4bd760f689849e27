"""The corpus as files: written together or not at all, checked, and what is wrong with titles and downloads."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skein.sources import corpus_files, versions

DOC = "citation string, path string, text string, body_bytes bigint, body_sha256 string"


def docs(spark, rows):
    return spark.createDataFrame([(c, p, t, len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for c, p, t in rows], DOC)


def test_write_and_verify(spark, tmp_path):
    root = str(tmp_path / "c")
    rows = [("1 CFR 1", "a/1.md", "é one\n"), ("1 CFR 2", "a/2.md", "two"), ("2 CFR 1", "b/c/1.md", "x"), ("1 CFR 2", "a/2.md", "two")]
    assert corpus_files.write_corpus(docs(spark, rows), root) == 1
    listed = {r["path"]: r for r in corpus_files.read_manifest(spark, root).collect()}
    assert sorted(listed) == ["a/1.md", "a/2.md", "b/c/1.md"]
    for _, path, text in rows:
        raw = open(listed[path]["file"], "rb").read()
        assert raw == text.encode() and (listed[path]["bytes"], listed[path]["sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {r["state"] for r in corpus_files.verify_corpus(spark, root).collect()} == {"ok"}
    assert corpus_files.write_corpus(docs(spark, rows), root, count=2) == 2  # the largest two: the older version stays
    assert sorted(r["path"] for r in corpus_files.read_manifest(spark, root).collect()) == ["a/1.md", "a/2.md"] and corpus_files.read_manifest(spark, root, 1).count() == 3
    open(listed["a/1.md"]["file"], "w").write("other")
    open(os.path.dirname(listed["a/1.md"]["file"]) + "/new.md", "w").write("x")
    assert {r["path"]: r["state"] for r in corpus_files.verify_corpus(spark, root, 1).collect() if r["state"] != "ok"} == {"a/1.md": "bytes", "a/new.md": "unlisted"}


@pytest.mark.parametrize("more, match", [([("1", "z", "other")], "different"), ([("9", "a", "x")], "two documents"), ([("9", "../up", "x")], "can't be"), ([("9", "a\\b", "x")], "can't be"), ([("9", "n", None)], "can't be")])
def test_wrong_documents(spark, tmp_path, more, match):
    root = str(tmp_path / "c")
    with pytest.raises(ValueError, match=match):
        corpus_files.write_corpus(docs(spark, [("1", "a", "text"), *more]), root)
    assert versions.latest(spark, root) == 0


def test_too_few(spark, tmp_path):
    with pytest.raises(ValueError, match="1 complete documents of 2"):
        corpus_files.write_corpus(docs(spark, [("1", "a", "text")]), str(tmp_path / "c"), count=2)


def test_titles(spark):
    titles = spark.createDataFrame([(1, "A", False), (2, "B", False), (3, "C", True), (4, "D", False), (5, "E", False), (6, "F", False), (7, "G", False), (7, "G2", False), (8, "H", False)], "number int, name string, reserved boolean")
    row = lambda n, url=None, sha="a" * 64, at="2024Z": (url or f"u/{n}", f"raw/title-{n:03d}.xml", sha, at)
    got = [row(1), row(4, url="u/5"), row(5, sha="A" * 64), row(6, at="2024"), row(7), row(8), row(8)]
    downloads = spark.createDataFrame(got, "url string, relative_path string, sha256 string, retrieved_utc string")
    joined = corpus_files.title_downloads(titles, downloads, "u/%d")
    assert {r["number"]: r["error"] for r in joined.collect()} == {1: None, 2: "missing", 4: "url", 5: "digest", 6: "time", 7: "repeated", 8: "repeated"}
    with pytest.raises(ValueError, match="wrong"):
        corpus_files.assert_complete(joined, 7)
    corpus_files.assert_complete(joined.where(F.col("number") == 1), 1)
    with pytest.raises(ValueError, match="should be 2"):
        corpus_files.assert_complete(joined.where(F.col("number") == 1), 2)
