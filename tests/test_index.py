"""Upgrades of the stored index: equal to full builds, only what has changed is written, old readers go on."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import index
from skein.sources import versions

SCHEMA = "chunk_id string, document_id string, citation string, content string, sha256 string, token_count int, previous_id string, next_id string"


def corpus(contents):
    """Chunks of two to a document, from texts by number."""
    rows, ids = [], sorted(contents)
    for k, i in enumerate(ids):
        mate = [j for j in ids if j // 2 == i // 2 and j != i]
        text = contents[i]
        a, b = (f"c{mate[0]:04}" if mate and mate[0] < i else None), (f"c{mate[0]:04}" if mate and mate[0] > i else None)
        rows.append((f"c{i:04}", f"d{i // 2:04}", f"{i} CFR {k % 3}", text, hashlib.sha256(text.encode()).hexdigest(), len(text.split()), a, b))
    return rows


def vector(text):
    h = hashlib.sha256(text.encode()).digest()
    return [b / 8 + 1 for b in h[:4]]


def encoder(spark, asked):
    digest = hashlib.sha256  # nothing of this module, which workers can't import
    code = F.udf(lambda text: [b / 8 + 1 for b in digest(text.encode()).digest()[:4]], "array<double>")

    def encode(rows):
        asked.append(sorted(r["chunk_id"] for r in rows.collect()))
        return rows.select("chunk_id", code("text").alias("embedding"))

    return encode


def built(spark, rows, path, **more):
    chunks = spark.createDataFrame(rows, SCHEMA)
    vectors = spark.createDataFrame([(r[0], vector(r[3]), r[4]) for r in rows], "chunk_id string, embedding array<double>, embedding_sha256 string")
    return index.write(chunks, vectors, path, **more)


def content(own):
    read = lambda df, cols: sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    return [read(own.chunks, index.CHUNK), read(own.postings, ("term", "chunk_id", "tf", "length")), read(own.terms, ("term", "df")), read(own.vectors, ("chunk_id", "embedding", "embedding_sha256")), read(own.stats, ("n", "sum_token_count", "average", "dimensions"))]


def prose(rng, words=60, n=30):
    return " ".join(["the", *(f"t{rng.randrange(words)}" for _ in range(n))])


@pytest.mark.parametrize("seed", range(1))
def test_upgrades_equal_full_builds(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = {i: prose(rng) for i in range(40)}
    path, asked = str(tmp_path / "i"), []
    assert built(spark, corpus(texts), path, ranges=4) == 1
    first = index.read(spark, path)
    before = content(first)
    for step in range(2):
        kept = dict(texts)
        for i in rng.sample(sorted(texts), 4):
            texts[i] = prose(rng) if i % 3 else texts[i] + " the the new"
        for i in rng.sample(sorted(texts), 2):
            del texts[i]
        texts[100 + step] = prose(rng)
        texts[rng.choice(sorted(texts))] = kept[next(iter(kept))]  # a copy of another's text
        rows = corpus(texts)
        number = index.upgrade(spark, path, spark.createDataFrame(rows, SCHEMA), encoder(spark, asked))
        assert number == step + 2
        fresh = str(tmp_path / f"whole{step}")
        built(spark, rows, fresh, ranges=3)
        assert content(index.read(spark, path)) == content(index.read(spark, fresh))
        assert asked[-1] == sorted(f"c{i:04}" for i in texts if kept.get(i) != texts[i])
    assert index.compact(spark, path, 0.0) == 4
    assert content(index.read(spark, path)) == content(index.read(spark, fresh))
    assert not [p for p in versions.pieces(spark, path)[1] if p.name.endswith("+")]
    assert content(first) == before == content(index.read(spark, path, version=1))  # an old reader goes on
    assert index.compact(spark, path, 0.0) == 4 and index.upgrade(spark, path, spark.createDataFrame(rows, SCHEMA), encoder(spark, asked)) == 4


def test_only_touched_ranges_are_written(spark, tmp_path):
    """A tenth of the corpus with words of its own, in one stretch of the alphabet."""
    texts = {i: " ".join(f"{'abcdefghij'[i // 4]}{j}" for j in range(50)) for i in range(40)}
    path, asked = str(tmp_path / "i"), []
    built(spark, corpus(texts), path, ranges=10)
    _, base = versions.pieces(spark, path)
    for i in range(36, 40):
        texts[i] += " j3 j99"
    index.upgrade(spark, path, spark.createDataFrame(corpus(texts), SCHEMA), encoder(spark, asked))
    _, now = versions.pieces(spark, path)
    touched = {p.part for p in now if p.name == "postings+"}
    assert 1 <= len(touched) <= 3 and {p for p in base if p.name != "stats"} <= set(now)
    assert index.compact(spark, path, 0.9) == 3  # the touched ranges are all additions
    _, packed = versions.pieces(spark, path)
    same = {p.part for p in packed if p in base and p.name == "postings"}
    assert same and same >= {p.part for p in base if p.name == "postings"} - touched and [p for p in packed if p.name == "postings" and p not in base]
    built(spark, corpus(texts), str(tmp_path / "whole"))
    assert content(index.read(spark, path)) == content(index.read(spark, str(tmp_path / "whole")))
    assert set(versions.unused(spark, path, keep=1)) == {p.path for p in [*base, *now]} - {p.path for p in packed}


def test_sums_need_no_merge(spark, tmp_path):
    """Sums by term of the rows as they are stored are those of the merged postings, without a shuffle of postings by chunk; ranges start at their least keys."""
    rng = random.Random(4)
    texts = {i: prose(rng) for i in range(30)}
    path = str(tmp_path / "i")
    built(spark, corpus(texts), path, ranges=4)
    for p in versions.pieces(spark, path)[1]:
        assert p.name != "postings" or (p.low, p.rows) == spark.read.parquet(p.path).agg(F.min(F.concat("term", F.lit("\0"), "chunk_id")), F.count(F.lit(1))).first()
    texts = {i: t if i % 3 else t + " the new" for i, t in texts.items() if i % 7}
    index.upgrade(spark, path, spark.createDataFrame(corpus(texts), SCHEMA), encoder(spark, []))
    own = index.read(spark, path)
    sums = lambda rows: sorted(map(tuple, rows.groupBy("term").agg(F.sum("tf"), F.sum("length")).join(own.terms, "term").collect()))
    assert own.signed.count() > own.postings.count() and sums(own.signed) == sums(own.postings)


def test_everything_changes_or_goes(spark, tmp_path):
    texts = {i: f"alpha beta w{i}" for i in range(6)}
    path, asked = str(tmp_path / "i"), []
    built(spark, corpus(texts), path, ranges=3, model="one")
    index.upgrade(spark, path, spark.createDataFrame(corpus(texts), SCHEMA), encoder(spark, asked), model="two")  # another model: all vectors
    assert asked == [sorted(f"c{i:04}" for i in texts)] and index.read(spark, path).stats.first()["model"] == "two"
    texts = {i: f"other words {i}" for i in range(20, 23)}
    index.upgrade(spark, path, spark.createDataFrame(corpus(texts), SCHEMA), encoder(spark, asked), model="two")
    built(spark, corpus(texts), str(tmp_path / "whole"))
    want = content(index.read(spark, str(tmp_path / "whole")))
    assert content(index.read(spark, path)) == want
    index.compact(spark, path)
    assert content(index.read(spark, path)) == want
    index.upgrade(spark, path, spark.createDataFrame([], SCHEMA), encoder(spark, asked), model="two")
    none = index.read(spark, path)
    assert [none.chunks.count(), none.postings.count(), none.terms.count(), none.vectors.count(), none.stats.first()["n"]] == [0, 0, 0, 0, 0]


def test_what_is_wrong_is_not_published(spark, tmp_path):
    texts = {i: f"alpha w{i}" for i in range(4)}
    path, rows = str(tmp_path / "i"), corpus(texts)
    built(spark, rows, path)
    encode = encoder(spark, [])
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    bad = [
        [*rows, ("c9", "d9", "x", "text", "0" * 64, 1, None, None)],  # digest
        [r for r in rows if r[0] != "c0001"],  # a neighbour is gone
        [*rows, *[("c9", "d9", "x", "t", hashlib.sha256(b"t").hexdigest(), 1, None, None)] * 2],  # twice
    ]
    for some in bad:
        with pytest.raises(ValueError):
            index.upgrade(spark, path, frame(some), encode)
    texts[3] = "changed"
    for wrong in (lambda r: r.select("chunk_id", F.array(*[F.lit(float("nan"))] * 4).alias("embedding")), lambda r: encode(r).limit(0)):
        with pytest.raises(ValueError):
            index.upgrade(spark, path, frame(corpus(texts)), wrong)
    assert versions.latest(spark, path) == 1


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "v")
    piece = versions.Piece("t", -1, 1, 0, None, "x")
    with pytest.raises(ValueError):
        versions.pieces(spark, root)
    versions.publish(spark, root, 1, [piece])
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, 1, [piece])
    assert versions.pieces(spark, root) == (1, [piece])
