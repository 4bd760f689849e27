"""Retrieval quality: neighbours by vector with equal labels as relevant."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import cases, corpus, evals, search
from skein.operators.order import numbered
from skein.plans.corpus import _CHUNKS
from skein.plans.registry import query
from skein.plans.retrieval import chunks_of

_HITS = """
q AS (SELECT vec_id AS case_id, embedding AS q, label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT case_id, vec_id AS item_id, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings),
top AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item_id) AS place FROM s QUALIFY place <= 100),
hits AS (SELECT case_id, item_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item_id) AS rank FROM top WHERE item_id <> case_id),
rel AS (SELECT case_id, e.vec_id AS item_id FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> case_id),
sizes AS (SELECT case_id, count(*) AS n FROM rel GROUP BY case_id),
scores AS (SELECT q.case_id, coalesce(count(h.rank) FILTER (WHERE h.rank <= 5) / any_value(n), 0) AS recall_at_5, coalesce(count(h.rank) FILTER (WHERE h.rank <= 10) / any_value(n), 0) AS recall_at_10, coalesce(1 / min(h.rank), 0) AS reciprocal_rank,
  coalesce(sum(CASE WHEN h.rank <= 10 THEN 1 / log2(h.rank + 1) END), 0) / any_value(list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1)))) AS ndcg_at_10
  FROM q JOIN sizes z USING (case_id) JOIN rel r USING (case_id) LEFT JOIN hits h ON h.case_id = r.case_id AND h.item_id = r.item_id GROUP BY q.case_id)"""


def _hits(read):
    """One vector in fifty as the cases, against all others."""
    rows = read("embeddings")
    found = search.dense(rows.select(F.col("vec_id").alias("item_id"), "embedding"), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "embedding"), "item_id", "case_id", "embedding")
    return search.ranked(found.where("item_id <> case_id").drop("rank"), "case_id", "item_id")


def _relevant(read):
    """All others with the case's label."""
    rows = read("embeddings")
    cases = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "label")
    return cases.join(rows.select(F.col("vec_id").alias("item_id"), "label"), "label").where("item_id <> case_id").select("case_id", "item_id")


def _scores(read):
    return evals.score_cases(_hits(read), _relevant(read))


@query("score_case", f"WITH {_HITS} SELECT case_id, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg_at_10, 6) AS ndcg_at_10 FROM scores")
def _(read, spark):
    return _scores(read).select("case_id", *(F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_10")))


@query("mean_metrics", f"WITH {_HITS}, x AS (SELECT *, CASE WHEN case_id % 2 = 1 THEN 'development' ELSE 'holdout' END AS split FROM scores) SELECT split, count(*) AS positives, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM x GROUP BY GROUPING SETS ((split), ())")
def _(read, spark):
    rows = evals.mean_metrics(_scores(read).withColumn("split", evals.split_parity(F.col("case_id"))))
    return rows.select("split", "positives", *(F.round(c, 6).alias(c) for c in ("recall_at_5", "reciprocal_rank", "ndcg_at_10")))


_FIT = """
x AS (SELECT round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS score, label < 5 AS positive FROM embeddings),
t AS (SELECT DISTINCT score AS threshold FROM x),
r AS (SELECT threshold, (SELECT count(*) FROM x WHERE positive AND score >= threshold) / (SELECT count(*) FROM x WHERE positive) AS recall, (SELECT count(*) FROM x WHERE NOT positive AND score >= threshold) / (SELECT count(*) FROM x WHERE NOT positive) AS fpr FROM t)"""


@query("fit_threshold", f"WITH {_FIT} SELECT threshold, round(recall, 6) AS recall, round(fpr, 6) AS false_positive_rate FROM r WHERE fpr <= 0.05 ORDER BY recall DESC, threshold DESC LIMIT 1")
def _(read, spark):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = read("embeddings").select(F.round(total, 4).alias("score"), (F.col("label") < 5).alias("positive"))
    return evals.fit_threshold(rows).select("threshold", F.round("recall", 6).alias("recall"), F.round("false_positive_rate", 6).alias("false_positive_rate"))


_MODES = "modes AS (SELECT CASE label % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS mode, count(*) / 500 AS recall_at_5, avg(vec_id) / 500 AS reciprocal_rank, 0.01 AS false_positive_rate FROM embeddings GROUP BY 1)"


def _modes(read):
    mode = F.when(F.col("label") % 3 == 0, "lexical").when(F.col("label") % 3 == 1, "dense").otherwise("hybrid")
    return read("embeddings").groupBy(mode.alias("mode")).agg((F.count(F.lit(1)) / 500).alias("recall_at_5"), (F.avg("vec_id") / 500).alias("reciprocal_rank"), F.lit(0.01).alias("false_positive_rate"))


@query("quality_gate", f"WITH {_MODES}, w AS (SELECT max(recall_at_5) FILTER (WHERE mode = 'hybrid') AS hr, max(recall_at_5) FILTER (WHERE mode <> 'hybrid') AS br, max(reciprocal_rank) FILTER (WHERE mode = 'hybrid') AS hm, max(reciprocal_rank) FILTER (WHERE mode <> 'hybrid') AS bm FROM modes) SELECT hr >= br AND hm >= bm AS no_worse, hr > br OR hm > bm AS better, hr >= 0.5 AND hm >= 0.45 AS floors, hr >= br AND hm >= bm AND (hr > br OR hm > bm) AND hr >= 0.5 AND hm >= 0.45 AS passed FROM w")
def _(read, spark):
    return evals.quality_gate(_modes(read))


_FIELD = "split_modes AS (SELECT CASE label % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS mode, CASE WHEN vec_id % 2 = 1 THEN 'development' ELSE 'holdout' END AS split, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM embeddings) * 4 AS recall_at_5, CAST(avg(vec_id) AS DOUBLE) / (SELECT max(vec_id) FROM embeddings) AS reciprocal_rank, avg(label) / 10 AS ndcg_at_10, 0.01 AS false_positive_rate FROM embeddings GROUP BY 1, 2)"


def _field(read):
    rows = read("embeddings")
    whole = F.broadcast(rows.agg(F.count(F.lit(1)).alias("all"), F.max("vec_id").alias("last")))
    mode = F.when(F.col("label") % 3 == 0, "lexical").when(F.col("label") % 3 == 1, "dense").otherwise("hybrid")
    sums = rows.groupBy(mode.alias("mode"), evals.split_parity(F.col("vec_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.avg("vec_id").alias("v"), F.avg("label").alias("l"))
    return sums.join(whole).select("mode", "split", (F.col("n") / F.col("all") * 4).alias("recall_at_5"), (F.col("v") / F.col("last")).alias("reciprocal_rank"), (F.col("l") / 10).alias("ndcg_at_10"), F.lit(0.01).alias("false_positive_rate"))


@query("mode_selection", f"WITH {_FIELD}, c AS (SELECT mode FROM split_modes WHERE split = 'development' AND mode <> 'lexical' AND recall_at_5 >= 0.5 AND reciprocal_rank >= 0.45 AND false_positive_rate <= 0.05 ORDER BY recall_at_5 DESC, reciprocal_rank DESC, ndcg_at_10 DESC, false_positive_rate, mode = 'hybrid' DESC LIMIT 1) SELECT c.mode, h.recall_at_5 >= l.recall_at_5 AND h.reciprocal_rank >= l.reciprocal_rank AS accepted FROM c JOIN split_modes h ON h.mode = c.mode AND h.split = 'holdout', split_modes l WHERE l.mode = 'lexical' AND l.split = 'holdout'")
def _(read, spark):
    """Of dense and hybrid the best on development within the floors, and whether it holds against lexical on what is held out. The metrics are made from labels and ids."""
    rows = _field(read)
    return evals.holds_against_lexical(evals.best_mode(rows.where("split = 'development'")), rows.where("split = 'holdout'"))


_NEGATIVE = "SELECT case_id, score FROM (SELECT vec_id + 1000000 AS case_id, -round(list_sum(CAST(embedding AS DOUBLE[])), 4) / 8 AS score FROM embeddings WHERE vec_id % 50 = 3)"


@query("evaluate_cases", f"""
WITH {_HITS}, n AS ({_NEGATIVE}), cases AS (SELECT case_id, case_id // 50 AS serial, true AS positive FROM q UNION ALL SELECT case_id, (case_id - 1000000) // 50, false FROM n),
c AS (SELECT case_id, CASE WHEN serial % 2 = 1 THEN 'development' ELSE 'holdout' END AS split, positive AND serial % 4 = 0 AS exact, positive FROM cases),
best AS (SELECT case_id, max(score) AS score FROM (SELECT case_id, score FROM hits UNION ALL SELECT case_id, score FROM n) GROUP BY case_id),
x AS (SELECT score, positive FROM c JOIN best USING (case_id) WHERE split = 'development' AND NOT exact),
r AS (SELECT DISTINCT y.score AS threshold, (SELECT count(*) FROM x WHERE positive AND x.score >= y.score) / (SELECT count(*) FROM x WHERE positive) AS recall, (SELECT count(*) FROM x WHERE NOT positive AND x.score >= y.score) / (SELECT count(*) FROM x WHERE NOT positive) AS fpr FROM x y),
t AS (SELECT threshold FROM r WHERE fpr <= 0.05 ORDER BY recall DESC, threshold DESC LIMIT 1),
k AS (SELECT c.case_id FROM c JOIN best USING (case_id), t WHERE exact OR score >= threshold),
z AS (SELECT split, positive, CASE WHEN k.case_id IS NULL THEN 0 ELSE recall_at_5 END AS recall_at_5, CASE WHEN k.case_id IS NULL THEN 0 ELSE reciprocal_rank END AS reciprocal_rank, k.case_id IS NOT NULL AS answered FROM c LEFT JOIN scores USING (case_id) LEFT JOIN k USING (case_id))
SELECT split, count(*) FILTER (WHERE positive) AS positives, round(avg(recall_at_5) FILTER (WHERE positive), 6) AS recall_at_5, round(avg(reciprocal_rank) FILTER (WHERE positive), 6) AS reciprocal_rank, round(avg(CASE WHEN answered THEN 1.0 ELSE 0 END) FILTER (WHERE NOT positive), 6) AS false_positive_rate, round(any_value(threshold), 6) AS threshold FROM z, t GROUP BY GROUPING SETS ((split), ())
""")
def _(read, spark):
    """Cases with and without an answer: the threshold is fitted on development, gates all but exact citations, and the means follow."""
    hits = _hits(read)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    negative = read("embeddings").where("vec_id % 50 = 3").select((F.col("vec_id") + 1_000_000).alias("case_id"), F.lit(0).cast("bigint").alias("item_id"), (-total / 8).alias("score"), F.lit(1).alias("rank"))
    serial = F.floor((F.col("case_id") % 1_000_000) / 50)
    relevant = _relevant(read).unionByName(negative.select("case_id", F.lit(None).cast("bigint").alias("item_id")))
    cases = relevant.groupBy("case_id").agg(F.count("item_id").alias("n")).select("case_id", evals.split_parity(serial).alias("split"), ((F.col("n") > 0) & (serial % 4 == 0)).alias("exact"))
    rows = evals.evaluate_cases(hits.unionByName(negative.select(*hits.columns)), cases, relevant)
    return rows.select("split", "positives", *(F.round(c, 6).alias(c) for c in ("recall_at_5", "reciprocal_rank", "false_positive_rate", "threshold")))


_CASES = "SELECT 'case-' || doc_id AS case_id, CASE WHEN doc_id % 2 = 1 THEN 'development' ELSE 'holdout' END AS split, doc_id FROM documents"


@query("case_scan", "SELECT 'case-' || doc_id AS case_id, CASE doc_id % 7 WHEN 0 THEN 'split' WHEN 1 THEN 'query' WHEN 2 THEN 'labelled' WHEN 3 THEN 'unlabelled' ELSE 'repeated' END AS error FROM documents WHERE doc_id % 7 < 5")
def _(read, spark):
    """Five ways in which a case can be wrong, each in every seventh; a repeated id is given once."""
    m = F.col("doc_id") % 7
    some = F.array(F.lit("d"))
    none = F.array().cast("array<string>")
    cases = read("documents").select(
        F.concat(F.lit("case-"), "doc_id").alias("case_id"),
        F.when(m == 0, "train").otherwise(evals.split_parity(F.col("doc_id"))).alias("split"),
        F.when(m == 2, "no_answer").otherwise("citation").alias("kind"),
        F.when(m == 1, " ").otherwise("what").alias("query"),
        F.when(m == 3, none).otherwise(some).alias("relevant_document_ids"),
    )
    return evals.case_errors(cases.unionByName(cases.where(F.regexp_extract("case_id", "[0-9]+", 0).cast("bigint") % 7 == 4)))


@query("curated_cases", "SELECT item_id, CASE item_id % 4 WHEN 1 THEN 'count' WHEN 2 THEN 'repeated' WHEN 3 THEN 'missing' END AS error, CASE WHEN item_id % 4 = 0 THEN item_id || ',' || (item_id + 1) END AS documents FROM benchmark")
def _(read, spark):
    """One to four distinct citations of documents that are there."""
    docs = read("documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("1 CFR "), F.col("doc_id")).alias("citation"))
    i = F.col("item_id")
    cite = lambda c: F.concat(F.lit(" 1 cfr "), c.cast("string"))
    named = F.when(i % 4 == 1, F.array().cast("array<string>")).when(i % 4 == 2, F.array(cite(i), cite(i))).when(i % 4 == 3, F.array(cite(i), cite(-i - 1))).otherwise(F.array(cite(i), cite(i + 1)))
    rows = evals.resolve_curated(read("benchmark").select(i.alias("case_id"), named.alias("citations")), docs)
    return rows.select(F.col("case_id").alias("item_id"), "error", F.array_join("documents", ",").alias("documents"))


@query("label_inventory", "SELECT count(DISTINCT doc_id // 4) AS documents, count(*) AS chunks, true AS sound FROM documents WHERE regexp_matches(text, '\\S')")
def _(read, spark):
    return evals.label_inventory(chunks_of(read))


@query("negative_composition", "SELECT CASE WHEN item_id % 2 = 0 THEN 'no_answer' ELSE 'hostile_query' END AS kind, count(*) AS n, count(*) FILTER (WHERE item_id % 10 <> 1) AS unlabelled, count(*) = 20 AND count(*) FILTER (WHERE item_id % 10 <> 1) = 20 AS ok FROM benchmark GROUP BY 1")
def _(read, spark):
    kind = F.when(F.col("item_id") % 2 == 0, "no_answer").otherwise("hostile_query")
    labels = F.when(F.col("item_id") % 10 == 1, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>"))
    return evals.negative_composition(read("benchmark").select(kind.alias("kind"), labels.alias("relevant_document_ids")), each=20)


@query("relevant_intersection", f"WITH {_HITS} SELECT case_id, count(h.item_id) AS common FROM q LEFT JOIN (SELECT h.case_id, h.item_id FROM hits h JOIN rel r ON r.case_id = h.case_id AND r.item_id = h.item_id WHERE rank <= 10) h USING (case_id) GROUP BY case_id")
def _(read, spark):
    top = _hits(read).where("rank <= 10").groupBy("case_id").agg(F.collect_set("item_id").alias("top"))
    wanted = _relevant(read).groupBy("case_id").agg(F.collect_set("item_id").alias("wanted"))
    return top.join(wanted, "case_id", "left").select("case_id", F.coalesce(F.size(F.array_intersect("top", "wanted")), F.lit(0)).cast("bigint").alias("common"))


@query("split_intersection", "SELECT doc_id FROM labels WHERE doc_id % 6 = 0")
def _(read, spark):
    ids = read("labels").select("doc_id")
    return ids.where("doc_id % 2 = 0").intersect(ids.where("doc_id % 3 = 0"))


@query("concat_cases", "SELECT 'citation' AS kind, item_id FROM benchmark UNION ALL SELECT 'no_answer', item_id + 1000 FROM benchmark WHERE item_id % 2 = 0")
def _(read, spark):
    items = read("benchmark").select("item_id")
    return items.select(F.lit("citation").alias("kind"), "item_id").unionByName(items.where("item_id % 2 = 0").select(F.lit("no_answer").alias("kind"), (F.col("item_id") + 1000).alias("item_id")))


@query("label_granularity", "SELECT doc_id, CASE WHEN quality = 1 THEN 'chunk' ELSE 'document' END AS level FROM labels")
def _(read, spark):
    rows = read("labels").withColumn("chunks", F.when(F.col("quality") == 1, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")))
    return rows.select("doc_id", F.when(F.size("chunks") > 0, "chunk").otherwise("document").alias("level"))


@query("split_parity", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) % 2 = 1 THEN 'development' ELSE 'holdout' END AS split FROM labels WHERE quality = 0")
def _(read, spark):
    rows = numbered(read("labels").where("quality = 0").select("doc_id"), [F.col("doc_id")], "serial")
    return rows.select("doc_id", evals.split_parity(F.col("serial")).alias("split"))


@query("generate_cases", "SELECT doc_id, CASE WHEN rn <= 40 THEN 'citation' WHEN rn <= 80 THEN 'paraphrase_en' ELSE 'multi_concept' END AS kind, CASE WHEN rn % 2 = 1 THEN 'development' ELSE 'holdout' END AS split, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 10), ' ') AS query FROM (SELECT *, row_number() OVER (ORDER BY sha256('eval-v2:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 120")
def _(read, spark):
    """Cases by slices of the hash order, each with the first ten words of its document."""
    picked = evals.hash_slices(read("documents").select("doc_id"), "doc_id", "eval-v2:", [("citation", 40), ("paraphrase_en", 40), ("multi_concept", 40)])
    rows = read("documents").join(F.broadcast(picked), "doc_id")
    return rows.select("doc_id", "kind", evals.split_parity(F.col("place")).alias("split"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), 1, 10), " ").alias("query"))


_CASE_SIZES = {"citation": 30, "paraphrase_en": 30, "cross_language_zh": 20, "multi_concept": 15, "adjacent_context": 10}
_WORDS = "array_to_string(list_slice(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9''-]+'), 1, {}), ' ')"
_CASES_SQL = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'doc:' || doc_id AS citation, concat_ws('/', lang, source, doc_id || '.md') AS path, concat_ws(' ', source, lang, CASE WHEN lang = 'en' THEN 'Safety records' END) AS title, coalesce(text, '') AS content FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('eval-v2:' || id)) - 1 AS rn FROM d),
z AS (SELECT *, row_number() OVER (ORDER BY sha256('eval-v2:' || id)) - 1 AS rn FROM d WHERE title LIKE '%Safety records'),
p AS (SELECT (rn - 60) // 2 AS pair, min_by(title, rn) AS lt, max_by(title, rn) AS rt, min_by(id, rn) AS li, max_by(id, rn) AS ri, min_by(citation || ' (' || path || ')', rn) AS lc, max_by(citation || ' (' || path || ')', rn) AS rc FROM o WHERE rn BETWEEN 60 AND 89 GROUP BY 1),
{_CHUNKS.strip().rstrip()},
n AS (SELECT *, doc_id || ':' || start AS chunk_id, doc_id || ':' || lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next_id FROM chunks),
a AS (SELECT n.*, d.id, d.citation, d.path, d.title, row_number() OVER (ORDER BY sha256('eval-v2:' || chunk_id)) - 1 AS rn FROM n JOIN d ON d.id = CAST(n.doc_id AS VARCHAR) WHERE next_id IS NOT NULL),
c AS (
SELECT 'citation' AS kind, rn, rn AS serial, citation AS query, id AS documents, '' AS chunk_ids, 'Exact citation audited against ' || path || ' in the locked document manifest.' AS rationale FROM o WHERE rn < 30
UNION ALL SELECT 'paraphrase_en', rn - 30, rn, 'What federal requirements apply to ' || title || '? ' || {_WORDS.format(8)}, id, '', 'English paraphrase audited against ' || citation || ' at ' || path || '.' FROM o WHERE rn BETWEEN 30 AND 59
UNION ALL SELECT 'cross_language_zh', rn, rn + 60, '关于安全、记录，这条美国联邦法规规定了什么？', id, '', 'Chinese cross-language query audited against ' || citation || ' at ' || path || '; source title is ' || title || '.' FROM z WHERE rn < 20
UNION ALL SELECT 'multi_concept', pair, pair + 80, 'Compare the federal requirements for ' || lt || ' and ' || rt || '.', li || ',' || ri, '', 'Two-source case audited against ' || lc || ' and ' || rc || '.' FROM p
UNION ALL SELECT 'adjacent_context', rn, rn + 95, 'What context immediately follows the rule about ' || title || '? ' || {_WORDS.format(10)}, id, next_id, 'Adjacent-chunk label ' || next_id || ' follows primary ' || chunk_id || ' in ' || citation || ' at ' || path || '.' FROM a WHERE rn < 10)
SELECT 'pos-' || replace(kind, '_', '-') || '-' || printf('%03d', rn + 1) AS case_id, CASE WHEN serial % 2 = 0 THEN 'development' ELSE 'holdout' END AS split, CASE WHEN kind = 'cross_language_zh' THEN 'zh' ELSE 'en' END AS language, query, documents, chunk_ids, kind, rationale FROM c
UNION ALL SELECT 'neg-' || item_id, CASE WHEN item_id % 4 < 2 THEN 'development' ELSE 'holdout' END, 'en', text, '', '', CASE WHEN item_id % 2 = 0 THEN 'no_answer' ELSE 'hostile_query' END, 'no document' FROM benchmark"""


@query("evaluation_cases", _CASES_SQL)
def _(read, spark):
    """Cases of all seven kinds: from all documents and their chunks, and all benchmark items as ones without an answer. English documents have the words of two known concepts in their titles."""
    docs = read("documents")
    number = F.col("doc_id").cast("string")
    names = docs.select(number.alias("document_id"), F.concat(F.lit("doc:"), number).alias("citation"), F.concat_ws("/", "lang", "source", F.concat(number, F.lit(".md"))).alias("path"), F.concat_ws(" ", "source", "lang", F.when(F.col("lang") == "en", "Safety records")).alias("title"), F.col("text").alias("content"))
    parts = corpus.chunk_fixed(docs, "doc_id", "text").withColumn("chunk_id", F.concat_ws(":", "doc_id", "start"))
    parts = corpus.neighbor_links(parts, "doc_id", "start", "chunk_id").select(number.alias("document_id"), "chunk_id", "next_id", "content").join(names.drop("content"), "document_id")
    items = read("benchmark")
    negatives = items.select(
        F.concat(F.lit("neg-"), "item_id").alias("case_id"), F.when(F.col("item_id") % 4 < 2, "development").otherwise("holdout").alias("split"), F.lit("en").alias("language"), F.col("text").alias("query"), F.array().cast("array<string>").alias("relevant_document_ids"),
        F.array().cast("array<string>").alias("relevant_chunk_ids"), F.when(F.col("item_id") % 2 == 0, "no_answer").otherwise("hostile_query").alias("kind"), F.lit("no document").alias("rationale"),
    )
    sizes = _CASE_SIZES | {kind: negatives.where(F.col("kind") == kind).count() for kind in cases.NEGATIVES}
    made = cases.generate(names, parts, negatives, sizes=sizes, least=100)
    joined = lambda c: F.array_join(c, ",")
    return made.select("case_id", "split", "language", "query", joined("relevant_document_ids").alias("documents"), joined("relevant_chunk_ids").alias("chunk_ids"), "kind", "rationale")
