"""Curriculum, whitening and the filter audit against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import audit, curriculum, whitening
from skein.llm._words import SPACED, words_of

SPACED_RE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda odd: rng.choice(["Ab", "C", "été", "d|", "1%", "x"]) if rng.random() < odd else f"w{rng.randrange(300)}"
    rows = []
    for i in range(n):
        odd, size = rng.choice([0, 0.005, 0.1]), rng.choice([0, 1, 30, 199, 200, 201, 400])
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(word(odd) for _ in range(size)), rng.choice(["b", "a", "é", "", None, "z"])))
    rows += [(n + i, rows[7][1], "hot") for i in range(30)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \t\r\n", None), (None, "no id " * 150, "a"), (None, rows[7][1], "a"), (903, "long\x1fword " * 40_000, "b"), (904, "É" * 3000 + "QRS", "a"), (905, "W" * 200_000 + " a" * 300, "z"), (3, "other text with id three", "z")]
    return rows + [rows[5], rows[5]]


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


# curriculum


def mixed(rows, schedules=curriculum.SCHEDULES, passes=3):
    """The contract, and the order of copies, in plain Python."""
    sized = [(i, len(SPACED_RE.findall(t or "")), s, t or "") for i, t, s in rows]
    sources = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, n, x, _ in sized if x == s) for s in sources}
    area = lambda p: sum((u - t) * (w + v) / 2 for (t, w), (u, v) in zip(p, p[1:], strict=False))
    plan = {s: schedules[k % len(schedules)] for k, s in enumerate(sources)}
    target, open_, left = dict.fromkeys(sources, 0.0), set(sources), float(sum(size.values()))
    while left > 1e-9 and open_:
        share = left / sum(area(plan[s]) for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * area(plan[s])
        for s in list(open_):
            if target[s] > passes * size[s]:
                left += target[s] - passes * size[s]
                target[s] = float(passes * size[s])
                open_.discard(s)
    out, copies = [], []
    for k, s in enumerate(sources):
        goal, before = min(math.floor(target[s] + 0.5), passes * size[s]), 0
        mine = sorted((r for r in sized if r[2] == s), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] is None, r[0] or 0, hashlib.md5(r[3].encode()).hexdigest()))
        for r in mine:
            taken = []
            for p in range(passes):
                begins = p * size[s] + before
                n = min(r[1], goal - begins)
                if n > 0:
                    lo, hi = 0.0, 1.0  # the time at which the integral reaches the words before, by bisection
                    want, points = begins / goal * area(plan[s]), plan[s]
                    for _ in range(60):
                        mid, have = (lo + hi) / 2, 0.0
                        for (t, w), (u, v) in zip(points, points[1:], strict=False):
                            x = min(max(mid, t), u)
                            have += (x - t) * (w + w + (v - w) * (x - t) / (u - t)) / 2
                        lo, hi = (mid, hi) if have <= want else (lo, mid)
                    taken.append(n)
                    copies.append((lo, k, begins, n))
            out.append((r[0], r[1], size[s], target[s], sum(taken)))
            before += r[1]
    return out, sorted(copies)


def test_curriculum(spark):
    rows = texts()
    want, copies = mixed(rows)
    docs = frame(spark, rows)
    got = [tuple(r) for r in curriculum.digest(docs).collect()]
    short = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert collections.Counter(map(short, got)) == collections.Counter(map(short, want))
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in curriculum.digest(frame(spark, rows, parts=7)).collect())  # any partitioning
    assert all(r[4] <= 3 * r[1] for r in got)
    taken, wanted = collections.Counter(), {}
    source = {(i, len(SPACED_RE.findall(t or ""))): s for i, t, s in rows}
    for r in got:
        taken[source[r[0], r[1]]] += r[4]
        wanted[source[r[0], r[1]]] = r[3]
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in wanted)
    assert abs(sum(wanted.values()) - sum(r[1] for r in got)) < 1e-6
    _, stream = curriculum.mix(docs.withColumn("target", F.lit("clash")).withColumn("rank", F.lit(1)))
    told = sorted((r["first_word"], r["words"], r["position"]) for r in stream.collect())
    assert [n for _, n, _ in told] == [c[3] for c in copies]
    assert np.allclose([p for _, _, p in told], [c[0] for c in copies], atol=1e-9)
    assert [f for f, _, _ in told] == list(itertools.accumulate([0, *(n for _, n, _ in told[:-1])]))
    parts = stream.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min("position").alias("a"), F.max("position").alias("b")).orderBy("part").collect()
    assert all(x["b"] <= y["a"] for x, y in itertools.pairwise(parts))  # range-sorted


def test_curriculum_edges(spark):
    assert curriculum.digest(frame(spark, [(1, "a", "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in curriculum.digest(frame(spark, [(1, None, None), (2, "", None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]
    assert [tuple(r)[:5] for r in curriculum.digest(frame(spark, [(1, "one two three", "s")])).collect()] == [(1, 3, 3, 3.0, 3)]
    # two steps down to nothing, then a jump: all of the second source comes late
    late = [[(0, 1), (1, 1)], [(0, 0), (0.5, 0), (1, 4)]]
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(40)]
    want, copies = mixed(rows, late)
    docs, stream = curriculum.mix(frame(spark, rows), late)
    place = {r["__row"]: r["source"] for r in docs.collect()}
    got = sorted((r["first_word"], place[r["__row"]], r["position"]) for r in stream.collect())
    assert min(p for _, s, p in got if s == "b") >= 0.5 and [s for _, s, _ in got] == ["ab"[c[1]] for c in copies]
    with pytest.raises(ValueError):
        curriculum.mix(frame(spark, rows), [[(0, 1), (0.5, 1)]])


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 1000]), f"s{rng.randrange(9)}") for i in range(60)]
    want = {(r[2], r[3]) for r in mixed(rows)[0]}
    assert {(r["source_size"], round(r["target"], 6)) for r in curriculum.digest(frame(spark, rows)).collect()} == {(s, round(t, 6)) for s, t in want}


# whitening


def vectors(seed=5, n=300, d=11):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ np.diag(10.0 ** -np.arange(d) * 30) @ rng.normal(size=(d, d))
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(base)]


def whitened_by_hand(rows, d):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (d - len(v)) for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    exact = x * n - sums
    cov = (exact.T @ exact / n**3).astype(float)
    e, u = np.linalg.eigh(cov)
    return n, (exact * exact).sum(axis=1), (exact / n).astype(float), e[::-1], u[:, ::-1], float(np.trace(cov))


def test_whitening(spark):
    good = vectors() + [(None, vectors()[0][1]), (7, vectors()[3][1]), (7, vectors()[3][1]), (800, [1.0, 2.0]), (801, [])]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 11), (903, [float("inf")] + [0.0] * 10)]
    df = frame(spark, good + bad, "vec_id bigint, embedding array<float>", 4)
    n, deviation, centred, e, u, trace = whitened_by_hand([(i, [float(np.float32(c)) for c in v]) for i, v in good], 11)
    got = whitening.digest(df).collect()
    k = min(8, int((e > 11 * np.finfo(float).eps * e[0]).sum()))
    assert len(got) == len(good) * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    by = collections.defaultdict(collections.Counter)
    for r in got:
        by[r["component"]][r["vec_id"], r["deviation"]] += 1
        assert abs(r["explained"] - e[r["component"] - 1] / trace) <= 1e-10 * r["explained"] + 1e-15
    assert all(c == collections.Counter(zip((i for i, _ in good), map(int, deviation), strict=True)) for c in by.values())
    white = {(r["vec_id"], r["deviation"], r["component"]): r["whitened"] for r in got}
    for c in range(1, min(k, 4) + 1):
        want = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
        mine = np.array([white[i, int(d), c] for (i, _), d in zip(good, deviation, strict=True)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    model, again = whitening.fit(df), whitening.fit(df.repartition(7))
    assert (model.values == again.values).all() and (model.vectors == again.vectors).all()  # the same for any partitioning
    clash = whitening.whiten(df.withColumn("deviation", F.lit("x")).withColumn("tag", F.lit("t")), model, 3)
    assert clash.columns == ["vec_id", "tag", "deviation", "whitened"] and clash.count() == len(good) and all(len(r["whitened"]) == 3 for r in clash.collect())


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.digest(spark.createDataFrame(rows, schema)).count() == 0
    far = [(i, [i * 1e6, (i % 3) * 1e7 - i]) for i in range(50)] + [(99, [1e300, 0.0])]
    model = whitening.fit(spark.createDataFrame(far, schema))
    assert model.sums[0] == sum(math.floor(1024 * i * 1e6) for i in range(50)) + 2**43 + 51 * 100_000
    assert {r["deviation"] for r in whitening.digest(spark.createDataFrame(far, schema)).where("vec_id = 99").collect()} == {2**63 - 1}


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    scale = np.diag(10.0 ** -(np.arange(d) % 12))
    a = scale @ (q @ q.T + np.eye(d) + (q + q.T) / 8) @ scale  # graded: small eigenvalues to many digits
    values, unit = whitening.jacobi((a + a.T) / 2)
    assert (np.diff(values) <= 0).all() and np.abs(unit.T @ unit - np.eye(d)).max() < 1e-13
    assert np.abs(a @ unit - unit * values).max() < 1e-13 * values[0]
    inner = np.linalg.slogdet(q @ q.T + np.eye(d) + (q + q.T) / 8)[1]
    assert abs(np.log(values).sum() - 2 * np.log(np.diag(scale)).sum() - inner) < 1e-9


# audit


def failing(rows):
    out = []
    for doc_id, text, source in rows:
        text, ws = text or "", SPACED_RE.findall(text or "")
        smaller = any((t or "") == text and i is not None and (doc_id is None or i < doc_id) for i, t, _ in rows)
        own = [len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller]
        out.append((doc_id, source or "", {f for f, x in zip("ABCDE", own, strict=True) if x}))
    return out


def test_audit(spark):
    rows = texts()
    rng = random.Random(9)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (777, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failed = failing(rows)
    assert {len(f) for _, _, f in failed} >= {0, 1, 2}
    want = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        removed = collections.Counter()
        for order in orders:
            left = mine
            for step, f in enumerate(order, 1):
                here, gone = [x for x in left if f in x[1]], [x for x in mine if f in x[1] and x not in left]
                left = [x for x in left if f not in x[1]]
                removed[f] += len(here)
                fails = sum(f in x[1] for x in mine)
                want[part, order, step] = [len(left), len(here), fails - len(here), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here), f]
                assert len(here) + len(gone) <= fails
        for order in orders:
            for step in range(1, 6):
                want[part, order, step][-1] = removed[want[part, order, step][-1]]
    docs = frame(spark, rows).withColumn("n_words", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("key", F.lit(2))
    got = {tuple(r)[:3]: list(r)[3:] for r in audit.digest(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == want
    assert audit.digest(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0


def test_audit_measures(spark):
    rows = texts()
    docs = frame(spark, rows, "doc_id bigint, text string, source string").select("text", F.lit("x").alias("n_points"), F.lit(7).alias("tag"))
    got = audit.measure(docs, symbols="|")
    assert got.columns == ["tag", *audit.MEASURES]
    words = [SPACED_RE.findall(t or "") for _, t, _ in rows]
    want = collections.Counter((7, len(w), len(set(w)), len(re.findall("[A-Z]", t or "")), len(t or ""), (t or "").count("|")) for w, (_, t, _) in zip(words, rows, strict=True))
    assert counted(got) == want


@pytest.mark.parametrize("kind", ["same", "byte", "doc"])
def test_distinct_words_do_not_depend_on_hashes(kind):
    column = pa.array([t for _, t, _ in texts() if len(t or "") < 3000])
    for w in words_of(column, SPACED):
        sets = [len({w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(w.bounds[d], w.bounds[d + 1])}) for d in range(w.hi - w.lo)]
        poor = {"same": np.zeros(len(w), np.uint64), "byte": w.data[w.starts].astype(np.uint64), "doc": w.doc_of_word().astype(np.uint64)}[kind]
        assert audit._distinct(w, poor).tolist() == sets and audit._distinct(w).tolist() == sets
