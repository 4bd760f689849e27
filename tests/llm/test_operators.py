"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, decontamination, licenses, lm, neardup, quality, sharding, substrings, topk, warc

DOCS = "doc_id bigint, text string"
LOWER = {65 + i: 97 + i for i in range(26)}
ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, size=400):
    return " ".join(rng.choice(["Alpha", "béta", "gamma,", "delta", "x|y"]) if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=1, n=40):
    """Copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 5, 12, 13, 14, 60, 200]))) for i in range(n)]
    passage = prose(rng, 30)
    for i in range(8):
        rows.append((100 + i, prose(rng, 20) + " " + passage + "\n" + prose(rng, 10)))
    base = prose(rng, 120).split(" ")
    for i in range(8):
        near = list(base)
        for _ in range(i):
            near[rng.randrange(len(near))] = f"z{rng.randrange(99)}"
        rows.append((200 + i, " ".join(near)))
    rows += [(300 + i, rows[8][1]) for i in range(4)] + [(400, None), (401, ""), (402, "   \n\t"), (403, "one"), (404, "ONE"), (None, "no id here at all"), (405, "word " * 3000), (406, "é" * 5000)]
    return rows + [rows[3], rows[3]]


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_decontamination(spark):
    rows = corpus()
    shared = rows[40][1].split(" ")[20:50]
    items = [(1, " ".join(shared)), (2, "one"), (3, None), (4, ""), (None, "word word"), (5, "Alpha nowhere to be seen by anyone in any of these texts at all"), (10, " ".join(shared[:15]).upper()), (2, "one")]
    grams = collections.defaultdict(set)
    for item, text in items:
        ws = ALNUM.findall((text or "").translate(LOWER))
        for k in [min(13, len(ws))] if ws and item is not None else []:
            for i in range(len(ws) - k + 1):
                grams[tuple(ws[i : i + k])].add(item)
    want = collections.Counter()
    for doc_id, text in rows:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for g, ids in grams.items():
            for i in range(len(ws) - len(g) + 1):
                if tuple(ws[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want[doc_id, len(ws), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(ws)] += 1
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    assert collections.Counter(tuple(r) for r in decontamination.digest(docs, bench).collect()) == want
    clash = docs.withColumn("spans", F.lit(1)).withColumn("items", F.lit("x"))
    few = decontamination.contamination(clash, bench, broadcast_bytes=300)  # several parts
    assert few.exceptAll(decontamination.contamination(docs, bench).select(*few.columns)).isEmpty() and few.count() == len(rows)
    clean = decontamination.remove_documents(clash, bench)
    assert clean.columns == clash.columns and {(r["spans"], r["items"]) for r in clean.collect()} == {(1, "x")} and clean.count() == sum(n for w, n in want.items() if not w[-1])
    named = bench.withColumn("item_id", F.concat(F.lit("item "), "item_id"))
    got = {tuple(r["items"]) for r in decontamination.contamination(docs, named).collect()}
    assert () in got and any(i.startswith("item ") for x in got for i in x)
    cut = decontamination.remove_spans(decontamination.contamination(docs, bench))
    assert not any(" ".join(shared[:14]) in (r["text"] or "") for r in cut.collect())
    assert decontamination.digest(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.digest(docs, bench.limit(0)).collect())


def test_licenses(spark):
    texts = [None, "", "x" * 9000, "Licensed under the Apache License, Version 2.0.", "cc-by " * 3, "CC BY-NC 4.0 license; GNU GENERAL PUBLIC LICENSE v3", "all rights reserved " * 700, "ccby ccé by licensed", "SPDX-License-Identifier: MIT", "under the same license. See LICENSE file; MIT license", "All\n\nrights--reserved general  public LICENSE"]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    given = [(r, re.compile(r["pattern"])) for r in licenses.rules()]
    assert len(given) > 200
    want = collections.Counter()
    for doc_id, text in rows:
        norm = " " + " ".join(ALNUM.findall((text or "").translate(LOWER))) + " "
        base, rest = [], []
        for i, (r, p) in enumerate(given):
            for m in p.finditer(norm):
                a = norm[: m.start()].count(" ")
                (base if r["base"] else rest).append((a, -(a + m[0].count(" ") - 1), r["priority"], i, r))
        kept, reach = [], -1
        for x in sorted(rest, key=lambda x: x[:4]):
            if -x[1] > reach:
                kept.append(x)
                reach = -x[1]
        left = []
        for x in sorted(kept, key=lambda x: x[2]):
            if not any(y[2] < x[2] and y[0] <= -x[1] and x[0] <= -y[1] for y in left):
                left.append(x)
        starts, names = [x[0] for x in base], {x[4]["label"] for x in base}
        want[doc_id, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | {x[4]["label"] for x in left})), max((x[4]["weight"] for x in base + left), default=0.0)] += 1
    docs = spark.createDataFrame(rows, DOCS)
    assert collections.Counter(tuple(r) for r in licenses.digest(docs).collect()) == want
    assert licenses.digest(docs.limit(0)).count() == 0
    clash = docs.withColumn("url", F.lit("u")).withColumn("label", F.lit(1)).withColumn("__row", F.lit("r")).withColumn("__doc", F.lit("d")).withColumn("first", F.lit("f"))
    got = licenses.detections(clash)
    assert got.columns == ["doc_id", "url", "__row", "__doc", "first", "label", "priority", "weight", "first_word", "last_word"]
    assert {(r["url"], r["__row"], r["__doc"], r["first"]) for r in got.collect()} == {("u", "r", "d", "f")}
    assert licenses.detections(docs.select("text")).count() == got.count()
    plan = licenses.digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def example(rng, pattern):
    """A text that a rule's pattern matches, made at random."""
    from re import _parser

    def made(parsed):
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                op, arg = rng.choice(arg)
                out += chr(arg if str(op) == "LITERAL" else rng.randint(*arg))
            elif op == "BRANCH":
                out += made(rng.choice(arg[1]))
            elif op == "MAX_REPEAT":
                out += made(arg[2]) * rng.randint(arg[0], arg[1])
            elif op == "SUBPATTERN":
                out += made(arg[3])
            else:
                assert op == "ASSERT", op
        return out

    return made(_parser.parse(pattern)).strip()


def test_licenses_each_rule_alone(spark):
    rng = random.Random(8)
    given = [(r, re.compile(r["pattern"])) for r in licenses.rules()]
    texts = ["Released under the MIT", "distributed under GPL v3", "available under Apache 2.0", "published under Creative Commons Attribution 4.0", "Expat License", "provided\n-- under X11"]
    texts += [example(rng, r["pattern"]) for r, _ in given for _ in range(4)]
    texts += [re.sub(" ", lambda _: rng.choice(["\n", "  ", " -- ", "\t", "\r\n * "]), example(rng, r["pattern"])) for r, _ in given for _ in range(2)]  # whatever stands between the words
    rows, want = [], {}
    for i, text in enumerate(texts):
        norm = " " + " ".join(ALNUM.findall(text.translate(LOWER))) + " "
        whole = [(r["priority"], k, r) for k, (r, p) in enumerate(given) if not r["base"] and (m := p.match(norm)) and m.end() == len(norm) - 1]
        base = [r for r, p in given if r["base"] and p.search(norm)]
        if whole:  # all others lie within it
            best = min(whole, key=lambda x: x[:2])[2]
            rows.append((i, text))
            want[i] = ",".join(sorted({r["label"] for r in [best, *base]})), max(r["weight"] for r in [best, *base])
    assert len(rows) > 0.9 * len(texts)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert sorted({(texts[i], got[i], w) for i, w in want.items() if got[i] != w}) == []


def test_warc(spark, tmp_path):
    rng = random.Random(3)
    inner = b"".join(warc._record("response", f"urn:page:{i}", "u", None, b"inner", 6) for i in range(3))
    html = [None, "", "same", "same", "<p>é</p>" * 3000, "".join(rng.choice("abc<>") for _ in range(40_000)), "same"]
    rows = [(10 - i, f"http://h/{i}\r\n", h) for i, h in enumerate(html)] + [(50, None, "same"), (50, None, "same"), (None, "u", "same"), (51, "v", "<p>é</p>" * 3000)]
    pages = frame(spark, rows, "page_id bigint, url string, html string")
    first = {}
    for page, _, h in rows:
        if page is not None:
            first[h or ""] = min(page, first.get(h or "", page))
    want = collections.Counter()
    for page, _, h in rows:
        raw = (h or "").encode()
        again = page != first[h or ""]
        want[page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert collections.Counter(tuple(r) for r in warc.digest(pages.withColumn("first_id", F.lit(1)).withColumn("path", F.lit("p")).withColumn("bytes", F.lit(0))).collect()) == want
    assert warc.digest(pages.limit(0)).count() == 0
    files = warc.write_archives(pages, str(tmp_path / "a"), least_bytes=10, file_bytes=2000)
    whole = warc.read_archives(files)
    assert whole.where("record_type = 'revisit'").count() == 1 and whole.where("not digest_ok").count() == 0
    for split in (97, 1000):
        assert whole.exceptAll(warc.read_archives(files, split)).isEmpty() and warc.read_archives(files, split).count() == len(rows)
    assert warc.read_archives(files, 1000).rdd.getNumPartitions() > 5
    long = spark.createDataFrame([(1, None, "<p>word " * 2_000_000), (1, None, "<p>word " * 2_000_000), (2, "u", "short")], "page_id bigint, url string, html string")
    assert sorted(r["payload_bytes"] for r in warc.digest(long).collect()) == [5, 16_000_000, 16_000_000]
    listed = warc.files_in(spark, str(tmp_path / "a" / "*.gz"))
    assert warc.read_archives(listed).count() == len(rows)
    # a payload that holds an archive, stored as it is
    odd = tmp_path / "odd.gz"
    odd.write_bytes(warc._record("response", "urn:page:1", "u", None, rng.randbytes(3000) + inner + rng.randbytes(3000), 0) + warc._record("response", "urn:page:2", "u", None, b"x", 6))
    got = warc.read_archives(spark.createDataFrame([(str(odd), odd.stat().st_size)], "path string, bytes bigint"), 500)
    assert sorted(r["record_id"] for r in got.collect()) == ["urn:page:1", "urn:page:2"]


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "under", "old", "stone", "bridges"]) for _ in range(rng.randrange(20, 200)))
    rows = [(i, good() if i % 2 else " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in good().split())) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(1, 0, 0), (None, 1, 0), (7, None, 0), (9, 5, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*rows, (900, None), (901, ""), (902, "the old river " * 20_000), (None, "the river")])
    got = [r for r in quality.digest(docs, labels).collect()]
    assert len(got) == 244 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert sum((r["predicted"] == r["doc_id"] % 2) for r in held) >= 0.95 * len(held) > 20
    assert len({r["score"] for r in quality.digest(docs, labels.limit(0)).collect()}) == 1
    assert quality.keep_good(docs.limit(0), labels).columns == ["doc_id", "text"]
    w = quality.fit(docs, labels)
    assert all((a == b).all() for a, b in zip(w.arrays(), quality.fit(docs.repartition(5), labels).arrays(), strict=True))


def test_quality_forward_pass():
    """Scores against the network written out in plain Python, each text by itself."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    w = quality._start(3)
    w.shift[:] = np.linspace(-0.2, 0.2, quality.FILTERS)
    w.out[:] *= 5
    texts = ["", "a", "abcd", "abcde", "é日本", None, "x" * 255, "y" * 256, "z" * 257, *("".join(rng.choice("ab cdé\n") for _ in range(rng.randrange(1, 1500))) for _ in range(20)), "long " * 3000]

    def plain(text):
        raw = (text or "").encode()
        rows = max(1, -(-len(raw) // quality.STEP))
        raw = list(raw) + [0] * (rows * quality.STEP + quality.KERNEL - len(raw))
        values = []
        for r in range(rows):
            flat = [float(v) for b in raw[r * quality.STEP : r * quality.STEP + quality.KERNEL] for v in w.embed[b]]
            values.append([max(0.0, sum(x * float(f) for x, f in zip(flat, w.filters[:, j], strict=True)) + float(w.shift[j])) for j in range(quality.FILTERS)])
        size = quality.CHUNK // quality.STEP
        pooled = [[max(column) for column in zip(*values[a : a + size], strict=True)] for a in range(0, rows, size)]
        features = [max(c) for c in zip(*pooled, strict=True)] + [sum(c) / len(pooled) for c in zip(*pooled, strict=True)]
        return 1 / (1 + math.exp(-sum(f * float(o) for f, o in zip(features, w.out, strict=True)) - float(w.bias[0])))

    got = quality.scores(w, pa.array(texts))
    assert got == pytest.approx([plain(t) for t in texts], rel=1e-4)
    assert quality.scores(w, pa.array(texts[::-1]))[::-1] == pytest.approx(got, rel=1e-5)  # neighbours make no difference


def test_quality_of_long_samples(spark, monkeypatch):
    rng = random.Random(6)
    good = lambda n: " ".join(rng.choice(["the", "river", "runs", "under", "old", "stone", "bridges"]) for _ in range(n))
    text = {i: good(40) if i % 2 else good(40).upper().replace(" ", "## ") for i in range(240)}
    by_hash = [r[0] for r in spark.range(240).orderBy(F.xxhash64("id")).collect() if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    text[by_hash[0]] *= 300  # the first of all doesn't fit
    labels = spark.createDataFrame([(i, i % 2) for i in text], "doc_id bigint, quality int")
    docs = frame(spark, list(text.items()))
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda texts, ys, **more: seen.append((texts, ys)) or train(texts, ys, **more))
    got = quality.score(docs, quality.fit(docs, labels, sample_bytes=40_000)).collect()
    texts, ys = seen.pop()
    assert set(ys) == {0, 1} and sum(len(t.encode()) for t in texts) <= 40_000
    assert sum((r["score"] >= 0.7) == r["doc_id"] % 2 for r in got) >= 0.95 * len(got)
    # all texts of a label are longer than what there is for it
    long = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.repeat("text", 200)).otherwise(F.col("text")))
    quality.fit(long, labels, sample_bytes=40_000)
    texts, ys = seen.pop()
    assert set(ys) == {0, 1} and sum(len(t.encode()) for t in texts) <= 40_000


def test_quality_sample_is_of_documents_that_are_there(spark, monkeypatch):
    """Labels of other documents take nobody's place; ids may be strings; a long text is sampled from its start to its end."""
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda texts, ys, **more: seen.append((texts, ys)) or train(texts, ys, **more))
    ids = [f"d{i}" for i in range(60)]
    docs = spark.createDataFrame([(d, f"{d} words of it") for d in ids] + [(None, "none"), ("d1", None)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"gone{i}", i % 2) for i in range(400)] + [(d, i % 2) for i, d in enumerate(ids)], "doc_id string, quality int")
    scored = quality.score(docs, quality.fit(docs, labels, per_class=10)).count()
    assert scored == 62 and sorted(seen[-1][1]) == [0] * 10 + [1] * 10 and all(t.split()[0] in ids or t == "" for t in seen[-1][0])
    wide = "".join(chr(0x4E00 + i) for i in range(20_000))  # 60,000 bytes
    docs = spark.createDataFrame([("a", wide), ("b", "short"), ("c", "x" * 50_000), ("e", "y")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("e", 0)], "doc_id string, quality int")
    quality.fit(docs, labels, sample_bytes=40_000)
    cut = next(t for t in seen[-1][0] if t[:1] == wide[0])
    each = 5000 // quality.SPANS
    assert cut == "".join(wide[i * 20_000 // quality.SPANS :][:each] for i in range(quality.SPANS)) and len(cut.encode()) <= 20_000


def test_topk(spark):
    rng = random.Random(7)
    centre = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centre[i % 3]]) for i in range(0, 300)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [1.0]), (None, [0.1] * 6), (300, [9.0] * 6), (300, [8.0] * 6), rows[4]]
    rows += [(400, [1e300, -1e300, 1.0, 0.0, 0.0, 0.0]), (402, [4e6] * 6), (404, [4e6, 4e6, -4e6, 0.0, 0.0, 0.0]), (420, [1.7e308] + [0.0] * 5), (440, [3e7, -3e7, 0.5, 0.5, 0.5, 0.5])]
    sound = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(min(1024.0 * x, 1.7976931348623157e308)) for x in v]
            sound.append((i, whole + [0] * (6 - len(v))))
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = collections.Counter()
    for n, (q, a) in enumerate(sound):
        if q % 20 == 0:
            scored = sorted((-cut(sum(x * y for x, y in zip(a, v, strict=True))), i) for m, (i, v) in enumerate(sound) if m != n)[:10]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored))
    vectors = frame(spark, rows, "vec_id bigint, embedding array<double>").withColumn("row", F.lit(1)).withColumn("query_id", F.lit("x"))
    for pivots in (5, None):
        got = collections.Counter(tuple(r) for r in topk.search(vectors, every=20, pivots=pivots).collect())
        assert (got - want, want - got) == (collections.Counter(), collections.Counter())
    assert topk.search(vectors.limit(0)).count() == 0
    assert topk.search(vectors.where("vec_id in (0, 1, 2)"), every=100).count() == 2


def below(plan, node):
    """The subtrees of a plan, as text, under each node of a name."""
    lines = plan.split("\n")
    depth = [len(re.match(r"[ :|+-]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if x.lstrip(" :|+-").startswith(node):
            ends = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : ends])


def test_topk_broadcasts(spark):
    """Neither the slices of all questions, which Spark sizes as if they weren't exploded, nor the vectors are broadcast."""
    rng = random.Random(3)
    vectors = frame(spark, [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(2000)], "vec_id bigint, embedding array<double>")
    plan = topk.search(vectors, every=10)._jdf.queryExecution().executedPlan().toString()
    sent = list(below(plan, "BroadcastExchange"))
    assert any("explode(sequence(from" in x for x in sent) and not any("explode(sequence(first" in x or "vectors#" in x for x in sent)


def test_ppm(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 50)  # most words go the long way
    rows = corpus(9)
    monkeypatch.setattr(lm, "PART_WORDS", 40)
    got = lm.score(frame(spark, rows).withColumn("score", F.lit("s")).withColumn("row", F.lit("r")).withColumn("part", F.lit("p"))).collect()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    counts, trie = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
            raw = b"\xfe\xfe" + (t or "").encode() + b"\xff"
            for k in range(2, len(raw)):
                for o in range(3):
                    trie[raw[k - o : k]][raw[k]] += 1
    n, v = sum(counts.values()), len(counts)

    def ppm(raw):
        total = 0.0
        for k in range(2, len(raw)):
            out = set()
            for o in (2, 1, 0):
                seen = {s: c for s, c in trie[raw[k - o : k]].items() if s not in out}
                whole = sum(seen.values()) + (len(seen) if len(out) + len(seen) < 256 else 0)
                if raw[k] in seen:
                    total += math.log10(seen[raw[k]] / whole)
                    break
                if seen:
                    total += math.log10(len(seen) / whole)
                    out |= seen.keys()
            else:
                total -= math.log10(256 - len(out))
        return total

    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert len(got) == len(rows)
    for r in got:
        ws = tokens(texts[r["doc_id"]][0])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(ppm(b"\xfe\xfe" + (texts[r["doc_id"]][0] or "").encode() + b"\xff"), rel=1e-5)
    assert lm.score(frame(spark, rows).limit(0)).count() == 0
    assert lm.adaptive(b"abababababab") > lm.adaptive(b"axbycvdufwez") and lm.adaptive(b"") == pytest.approx(-math.log10(256))


def test_ppm_of_longer_contexts(spark, monkeypatch):
    """Contexts of five bytes against brute force, in many groups and parts, with texts that only the longer ones tell apart."""
    monkeypatch.setattr(lm, "GROUP_BYTES", 300, raising=False)
    monkeypatch.setattr(lm, "GRAM_PART_BYTES", 500, raising=False)
    monkeypatch.setattr(lm, "_SUMMED", 200, raising=False)
    rows = corpus(9) + [(7000, "".join(map(chr, range(1, 128)))), (7001, "x" * 3000), (7002, None), (7003, ""), (None, "gamma gamma")]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    for order in (lm.ORDER, 3):
        trie = collections.defaultdict(collections.Counter)
        raw_of = lambda t: b"\xfe" * order + (t or "").encode() + b"\xff"  # noqa: B023, E731
        for i, t in rows:
            if not held(i):
                raw = raw_of(t)
                for k in range(order, len(raw)):
                    for o in range(order + 1):
                        trie[raw[k - o : k]][raw[k]] += 1

        def ppm(raw, order=order, trie=trie):
            total = 0.0
            for k in range(order, len(raw)):
                out = set()
                for o in range(order, -1, -1):
                    seen = {s: c for s, c in trie[raw[k - o : k]].items() if s not in out} if raw[k - o : k] in trie else {}
                    whole = sum(seen.values()) + (len(seen) if len(out) + len(seen) < 256 else 0)
                    if raw[k] in seen:
                        total += math.log10(seen[raw[k]] / whole)
                        break
                    if seen:
                        total += math.log10(len(seen) / whole)
                        out |= seen.keys()
                else:
                    total -= math.log10(256 - len(out))
            return total

        got = lm.score(frame(spark, rows), order=order).collect()
        want = sorted((-1 if i is None else i, ppm(raw_of(t))) for i, t in rows)
        have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
        assert [i for i, _ in have] == [i for i, _ in want]
        assert [x for _, x in have] == pytest.approx([x for _, x in want], rel=1e-5)
    assert lm.ORDER == 5 and lm.score(frame(spark, rows).limit(0), order=5).count() == 0
    none = frame(spark, [(i, "ab") for i in range(40) if held(i)])
    assert all(r["score"] == pytest.approx(-3 * math.log10(256)) for r in lm.score(none, order=5).collect())


def brute_substrings(rows, k):
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    split = [(order(i), SPACED.findall(t or "")) for i, t in rows]
    for i, ws in split:
        for p in range(len(ws) - k + 1):
            key = tuple(ws[p : p + k])
            first[key] = min(first.get(key, i), i)
    for (i, ws), (doc_id, _) in zip(split, rows, strict=True):
        gone = {p + j for p in range(len(ws) - k + 1) if first[tuple(ws[p : p + k])] < i for j in range(k)}
        yield doc_id, len(ws), len(gone), hashlib.sha256(" ".join(w for p, w in enumerate(ws) if p not in gone).encode()).hexdigest()


@pytest.mark.parametrize(("hot", "window"), [(16, 13), (2, 13), (16, 7)])
def test_substrings(spark, monkeypatch, hot, window):
    monkeypatch.setattr(substrings, "HOT", hot)
    if hot == 2:
        monkeypatch.setattr(substrings, "SAMPLE", 1)
    rows = corpus(11)
    docs = frame(spark, rows)
    want = collections.Counter(brute_substrings(rows, window))
    assert collections.Counter(tuple(r) for r in substrings.digest(docs, window).collect()) == want
    kept = substrings.remove(docs.withColumn("class", F.lit(1)).withColumn("least", F.lit(2)), window)
    digests = collections.Counter((r["doc_id"], hashlib.sha256(" ".join(SPACED.findall(r["text"] or "")).encode()).hexdigest()) for r in kept.collect())
    assert digests == collections.Counter((i, d) for (i, _, _, d), n in want.items() for _ in range(n))
    assert substrings.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window", [13, 50])
def test_substrings_whatever_the_white_space(spark, window):
    rng = random.Random(17)
    rows = []
    for p in range(30):
        shared = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 4, 4, 5]))) for _ in range(window)]  # seven of them are short or long by a byte or two
        for i, spaces in enumerate([[" "], ["  "], ["\r\n"], [" ", "\n    ", "\t", " \n"]]):
            text = "".join(w + rng.choice(spaces) for w in shared)
            rows.append((10 * p + i, f"{prose(rng, 9, 10**6)} {text}{prose(rng, 9, 10**6)}"))
    want = collections.Counter(brute_substrings(rows, window))
    assert sum(n for _, _, n, _ in want) >= 90 * window
    assert collections.Counter(tuple(r) for r in substrings.digest(frame(spark, rows), window).collect()) == want


@pytest.mark.parametrize(("hot", "many"), [(2, 10_000), (16, 10_000), (2, 20)])
def test_substrings_of_a_repeated_passage(spark, monkeypatch, hot, many):
    """A large group of documents that say one passage over and over: rows of places as the documents, and not as their windows."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    monkeypatch.setattr(substrings, "MANY", many)
    tables, write = {}, substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: tables.setdefault(name, []).append(write(df, name)) or tables[name][-1])
    rng = random.Random(23)
    passage = " ".join(f"passage{k}" for k in range(9))
    rows = [(rng.choice([i, i, i, None]), f"{prose(rng, 9, 10**6)} {' '.join([passage] * rng.randrange(4, 20))}\n{prose(rng, 9, 10**6)}") for i in range(60)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(corpus(29))]
    want = collections.Counter(brute_substrings(rows, 13))
    assert collections.Counter(tuple(r) for r in substrings.digest(frame(spark, rows), 13).collect()) == want
    windows = sum(max(0, len(SPACED.findall(t or "")) - 12) for _, t in rows[:60])
    of_passage = tables["places"][0].join(tables["involved"][0].where(F.col("text").contains(passage)).select("class"), "class", "left_semi").count()
    assert of_passage <= 5 * 60 < windows / 3


def test_automaton():
    rng = random.Random(2)
    auto, texts = substrings.Automaton(), [[rng.choice([b"a", b"b", b"c"]) for _ in range(30)] for _ in range(6)]
    for t in texts[:-1]:
        auto.add(t)
    parts = {tuple(t[i:j]) for t in texts[:-1] for i in range(30) for j in range(i + 1, 31)}
    for i, m in enumerate(auto.matching(texts[-1])):
        assert m == max((n for n in range(i + 2) if n == 0 or tuple(texts[-1][i + 1 - n : i + 1]) in parts))


@pytest.mark.parametrize("block", [2048, 3])
def test_neardup(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(13)
    sets = []
    for _, t in rows:
        ws = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(ws[i : i + 2]) for i in range(len(ws) - 1)} if len(ws) > 1 else {tuple(ws)} if ws else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    want = collections.Counter((d, len(sets[i]), (c := min(least[root(i)], default=None)), d == c) for i, (d, _) in enumerate(rows))
    got = collections.Counter(tuple(r) for r in neardup.digest(frame(spark, rows).withColumn("node", F.lit(0))).collect())
    assert got == want
    assert neardup.digest(frame(spark, rows).limit(0)).count() == 0


def test_neardup_keeps_one_row(spark):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 80, 10**6) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(1, a), (1, a), (2, near(a)), (None, b), (None, near(b)), (None, b), (2, c), (3, d), (None, d), (4, ""), (4, None)]
    got = neardup.keep_one(frame(spark, rows).withColumn("row", F.lit(0))).collect()
    found = collections.Counter((r["doc_id"], r["text"]) for r in got)
    left = {(None, b), (None, near(b))} & found.keys()
    assert len(left) == 1 and found == collections.Counter([(1, a), *left, (2, c), (3, d), (4, ""), (4, None)])


def test_sketches_fill_and_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    s = neardup.sketches([base[:300], base[30:330], base[:4], base[:1]])
    assert (s != 2**64 - 1).all()
    assert abs((s[0] == s[1]).mean() - 270 / 330) < 0.15


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = [None, "", " lead", "trail ", "a  b", "a \n b", "x\x1c y", "don't  we 'll", "  a b", "<|endoftext|>", "a" * 3000, " " * 700, "日本語 " * 40, "ab" * 400 + "c", "it's 12ab ...! c", "\x00\x01 é́"]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(1, 120))) for a in ("ab ", "the ", "0123 ", "éèa\n ", "-=*# ") for _ in range(12)]
    texts += ["foo bar\n baz  ", "\n\nfoo bar", "x\n ", "a   b", "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "ab" * 30_000, "x y " * 4000, "x" * 70 + " " + "=" * 300, texts[0], "a b"]
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in bpe.digest(docs.withColumn("n_tokens", F.lit("x")), path, pattern).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, repr(t)
    trip = bpe.decode(bpe.encode(docs.withColumn("token_ids", F.lit(0)), path, pattern), path, pattern)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in trip.collect())
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) for r in bpe.round_trip(docs, path, pattern).collect())
    slow = {r["doc_id"]: list(r["token_ids"]) for r in bpe.encode(docs, path, pattern, spaced=False).collect()}
    assert all(slow[i] == own.encode_ordinary(t or "") for i, t in enumerate(texts))
    twice = bpe.round_trip(docs.unionAll(docs).withColumn("decoded", F.lit(1)), path, pattern).collect()
    assert len(twice) == 2 * len(texts) and all(r["token_ids"] == slow[r["doc_id"]] for r in twice)
    with pytest.raises(Exception, match="isn't in the rank file"):
        bpe.decode(spark.createDataFrame([([10**6],)], "token_ids array<int>"), path, pattern).collect()
    assert bpe.digest(docs.limit(0), path, pattern).count() == 0


def test_bpe_in_parts(monkeypatch):
    """Chunks, tables and windows so small that everything is cut, emptied and widened."""
    import pyarrow as pa
    import public_tokenizers
    import tiktoken

    for name, value in (("CHUNK_BYTES", 400), ("DECODED_IDS", 7), ("PIECE_BYTES", 3000), ("PART_BYTES", 3000), ("WINDOW", 1), ("SPAN", 5), ("LONG", 9)):
        monkeypatch.setattr(bpe, name, value)
    own = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, True)
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(14)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 900))) for a in ("ab", "a b", "etaoinshr", "etaoin ", "é日 \n", "  a", "aaab", "-= ") for _ in range(12)]
    texts += ["e" * 500 + " " + "to the " * 300]
    at = 0
    for ids, bounds in own.ids(pa.array(texts)):
        back = list(own.decode(ids, bounds))
        for i in range(len(bounds) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == right.encode_ordinary(texts[at]) and back[i] == texts[at].encode()
            at += 1
    assert at == len(texts)


def test_bpe_cuts_many_parts_as_one_text(monkeypatch):
    """New words cost neither a call of the pattern nor a row of each round's result; memory goes back between chunks."""
    import pyarrow as pa
    import public_tokenizers
    import tiktoken

    own = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, True)
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    pattern, calls, trims, rows = own.pattern, [], [], []

    class Counted:
        def findall(self, text):
            calls.append(text)
            return pattern.findall(text)

        def finditer(self, text):
            calls.append(text)
            return pattern.finditer(text)

    def ask(query, *a, had=own._ask, **b):
        rows.append((query, (got := had(query, *a, **b)).num_rows))
        return got

    own.pattern, own._ask = Counted(), ask
    monkeypatch.setattr(bpe, "trim", lambda: trims.append(1), raising=False)
    rng = random.Random(16)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu.\n,") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(400)) for _ in range(20)]
    texts += ["a  b", "", " x", "x\n y", "it's\nhis 12\n"]
    ids, bounds = next(own.ids(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [right.encode_ordinary(t) for t in texts]
    assert len(calls) < 200 and trims
    assert 0 < sum(n for q, n in rows if q == bpe._ENCODE) <= len({p for t in texts for p in pattern.findall(t)})


def test_bpe_asks_few_queries():
    """Pieces of some hundred kilobytes, all as long as a query of lists takes, are one query, within its memory; bytes that merge with none are pieces, too."""
    import public_tokenizers
    import tiktoken

    own = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, True)
    right = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=own.ranks, special_tokens={})
    asked = []
    own._ask = lambda query, *a, had=own._ask, **b: asked.append(query) or had(query, *a, **b)
    rng = random.Random(19)
    pieces = ["".join(rng.choice("etaoinshrdlu") for _ in range(bpe.LONG)) for _ in range(6000)]
    pieces += ["e", "é", "\x00\x01", "\x01e\x00", "aaaa", "aaaaaaa", "日"]
    assert [ids.tolist() for ids in own.encode([p.encode() for p in pieces])] == [right.encode_ordinary(p) for p in pieces]
    assert asked == [bpe._ENCODE]


def test_workers_give_back_their_tables():
    """A worker that has ended a task holds no tables of powers, which idle workers would keep beside those of the next stage."""
    import pickle

    import pyarrow as pa
    from pyspark import cloudpickle

    from skein.llm import _words
    from skein.llm._shared import lean

    hashes = lambda batches: ([w.hashes() for w in _words.words_of(b, _words.SPACED)] for b in batches)
    first, second = (list(lean(hashes)([pa.array(["to be or not", "to be"])])) for _ in range(2))
    assert not _words._powers and (first[0][0] == second[0][0]).all()
    list(hashes([pa.array(["to be"])]))
    sent = cloudpickle.dumps(lean(hashes))
    assert _words._powers and len(sent) < 10_000
    assert len(list(pickle.loads(sent)([pa.array(["to be"])]))) == 1 and not _words._powers


def test_bpe_of_a_very_long_word():
    import time

    import numpy as np
    import public_tokenizers

    own = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, True)
    rng = random.Random(15)
    word = "".join(rng.choice("etaoinshrdluETA") for _ in range(200_000))
    began = time.perf_counter()
    ids = own.encode([word.encode()])[0]
    assert next(own.decode(ids, np.array([0, len(ids)]))) == word.encode() and time.perf_counter() - began < 60


def test_sharding(spark):
    rows = [(i, f"text {i % 90}" if i % 3 else f"alone {i}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)] + [(5000, None), (5001, None), (5002, ""), (None, "x"), (5, "text 5")]
    docs = frame(spark, rows).withColumn("shard", F.lit("other"))
    placed = sharding.assign(docs.withColumn("group", F.md5("text")), shards=16)
    got = placed.collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    text = collections.defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    assert all((r["size"], r["text_crc32"]) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in text[r["doc_id"]]} for r in got)
    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    small = F.col("group") != F.md5(F.lit("hot"))
    assert sharding.cut_edges(placed.where(small), "group") < 0.2 * sharding.cut_edges(dealt.where(small), "group")
    unavoidable = (300**2 - 5 * 57**2 - 15**2) // 2  # five whole shards and the rest
    assert sharding.cut_edges(placed.where(~small), "group") == unavoidable
    assert sharding.digest(docs.limit(0)).count() == 0
    assert sharding.digest(docs.limit(3)).count() == 3


def test_sharding_by_propagation_alone(spark):
    """No group is packed (heavy_share 1): what is linked comes together by moving towards its neighbours, as far as quotas let it."""
    rng = random.Random(5)
    groups = [rng.randrange(2, 9) for _ in range(60)]
    rows = [(None, f"group {g}") for g, n in enumerate(groups) for _ in range(n)] + [(i, f"alone {i}") for i in range(1500)]
    rng.shuffle(rows)
    docs = frame(spark, rows, parts=5).withColumn("group", F.md5("text"))
    placed = sharding.assign(docs, heavy_share=1)
    assert {r["count"] for r in placed.groupBy("shard").count().collect()} <= {len(rows) // 16, len(rows) // 16 + 1}
    start = sharding.cut_edges(sharding.assign(docs, rounds=0, heavy_share=1), "group")
    assert sharding.cut_edges(placed, "group") <= 0.1 * start and start > 200
    # one group of more than a shard's quota: it fills shards, and no shard takes more than its quota
    hot = frame(spark, [(i, "hot") for i in range(130)] + [(200 + i, f"alone {i}") for i in range(190)], parts=5)
    got = sharding.assign(hot.withColumn("group", F.md5("text")), heavy_share=1)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {20} and got.count() == 320
    largest = got.where(F.col("group") == F.md5(F.lit("hot"))).groupBy("shard").count().agg(F.max("count")).first()[0]
    assert 10 <= largest <= 20


@pytest.mark.parametrize("rows", [300])
def test_many_rows_without_ids(spark, rows):
    """Pairs of near copies, and shared passages, all without ids or all with one: each row is itself, and the work grows with the rows."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(rows // 2)]
    near = [" ".join([*words[:59], "other"]) for words in base]
    texts = [" ".join(words) for words in base] + near
    for doc_id in (None, 7):
        docs = frame(spark, [(doc_id, t) for t in texts])
        out = neardup.keep_one(docs, shingle=2)
        assert out.count() == rows // 2
        kept = substrings.remove(docs, 13)  # no row has a smaller id than another
        assert sorted(r["text"] for r in kept.collect()) == sorted(texts)
    docs = frame(spark, [(1, near[0]), *((None, t) for t in texts)])
    gone = {r["n_removed"]: r["n"] for r in substrings.digest(docs, 13).groupBy("n_removed").agg(F.count("*").alias("n")).collect()}
    assert gone == {0: rows - 1, 59: 1, 60: 1}  # the copy of the first row, and the words that its near copy shares with it


@pytest.mark.parametrize("seed", [1, 2])
def test_sharding_against_brute_force(spark, seed):
    """Law, slots, sizes and whole groups; cut edges no more than those of a greedy placement of all groups on one machine allow for."""
    rng = random.Random(seed)
    sizes = [300, 62, 50, 50, 44, 30, 20, 12, *(rng.randrange(1, 9) for _ in range(60))]
    texts = [f"group {g} " + "é" * rng.randrange(40) for g in range(len(sizes))]
    rows = [t for t, n in zip(texts, sizes, strict=True) for _ in range(n)]
    rows += [f"alone {i}" for i in range(1000 - len(rows) - 3)] + [None, None, "x" * 1_000_000]
    rng.shuffle(rows)
    rows = [(rng.randrange(900) if rng.random() < 0.98 else None, t) for t in rows]
    docs = frame(spark, rows, parts=7).withColumn("slot", F.lit("s")).withColumn("size", F.lit("s"))
    got = sharding.assign(docs.withColumn("group", F.md5("text"))).collect()
    assert sharding.assign(docs).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    described = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == described
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    assert sorted(by_shard) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert {len(v) for v in by_shard.values()} <= {62, 63}
    on = collections.defaultdict(collections.Counter)
    for r in got:
        if r["group"]:
            on[r["group"]][r["shard"]] += 1
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert [len(on[digest(texts[g])]) for g in range(1, 8)] == [1] * 7  # no larger than a shard: whole
    assert len(on[digest(texts[0])]) == 5  # 300 rows of 62 or 63
    cut = sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in on.values())
    placed = spark.createDataFrame([(r["group"], r["shard"]) for r in got], "group string, shard int")
    assert sharding.cut_edges(placed, "group") == cut
    unavoidable = (300**2 - 4 * 63**2 - 48**2) // 2
    small = sum(n * (n - 1) // 2 for n in sizes[8:])
    assert cut <= unavoidable + 0.2 * small
