"""Indexes and retrieval over documents, benchmark items as queries, and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import corpus, encoder, hybrid, index, search
from skein.plans.registry import query
from skein.sources import versions
from skein.sources.shared import shared_dir, stored

#: Terms of a text without `_` and CJK characters; RE2 has no lookaround, so that camel parts are cut at spaces put between them.
_WORDS = "regexp_extract_all({c}, '[A-Za-z0-9_]+')"
_PARTS = r"string_split(regexp_replace(regexp_replace(x, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ')"
TERMS = (
    "list_concat(list_transform(" + _WORDS + ", lambda x: lower(x)), "
    "flatten(list_transform(" + _WORDS + ", lambda x: list_transform(CASE WHEN len(" + _PARTS + ") > 1 THEN " + _PARTS + " ELSE [] END, lambda y: lower(y)))), "
    "list_transform(regexp_extract_all(regexp_replace({c}, '[A-Za-z0-9_]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda x: replace(lower(x), 'ß', 'ss')))"
)
_TERMS = TERMS
_INDEX = f"""
terms AS (SELECT doc_id, unnest({_TERMS.format(c='text')}) AS term FROM documents WHERE regexp_matches(text, '\\S')),
tf AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS length FROM documents WHERE regexp_matches(text, '\\S')),
stats AS (SELECT count(*) AS n, avg(length) AS average FROM size)"""
_ASKED = f"""
words AS (SELECT item_id, unnest({_TERMS.format(c='text')}) AS term, generate_subscripts({_TERMS.format(c='text')}, 1) AS i FROM benchmark),
asked AS (SELECT item_id, term FROM (SELECT item_id, term, min(i) AS i FROM words GROUP BY item_id, term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 64)"""
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))"
_LEXICAL = f"""{_INDEX}, {_ASKED},
scored AS (SELECT item_id, doc_id, round(sum({_BM25}), 9) AS score FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN size USING (doc_id), stats WHERE df < 8 OR df * 4 <= n GROUP BY item_id, doc_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 100)"""


#: Indexes that this application has written, by what their tables' files were then.
_BUILT: dict[tuple[str, str], str] = {}


def _files(read, *tables: str) -> str:
    """A digest of the tables' files: their names, sizes and times."""
    each = [read(t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().select(F.xxhash64(F.lit(t), "file_path", "file_size", "file_modification_time").alias("h")) for t in tables]
    rows = each[0]
    for more in each[1:]:
        rows = rows.union(more)
    found = rows.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.bit_xor("h").alias("b"), F.count(F.lit(1)).alias("c")).first()
    return ":".join(map(str, found))


def chunks_of(read):
    """Documents as an index's chunks: four in a row make one cited document, whose chunks are neighbours. Blank texts have none. Tokens are white-space words."""
    docs = read("documents").where(F.col("text").rlike(r"\S"))
    whole = (F.col("doc_id") / 4).cast("bigint")
    name = lambda letter, c: F.concat(F.lit(letter), F.lpad(c.cast("string"), 12, "0"))
    rows = docs.select(
        name("c", F.col("doc_id")).alias("chunk_id"),
        name("d", whole).alias("document_id"),
        F.concat(whole % 50 + 1, F.lit(" CFR "), whole).alias("citation"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("sha256"),
        F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("token_count"),
    )
    return corpus.neighbor_links(rows, "document_id", "chunk_id", "chunk_id")


def vectors_of(read):
    """A vector for each chunk: that of the vec_id that is doc_id modulo their number."""
    vectors = read("embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    n = vectors.count()
    rows = read("documents").where(F.col("text").rlike(r"\S")).select(F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"), F.sha2("text", 256).alias("embedding_sha256"), (F.col("doc_id") % n).alias("__v"))
    return rows.join(vectors, "__v").select("chunk_id", "embedding", "embedding_sha256")


def stored_index(read, spark) -> index.Index:
    """The index of these tables, written by the first query of the application that needs it, and again if a file has changed."""
    key = spark.sparkContext.applicationId, _files(read, "documents", "embeddings")
    return index.read(spark, _stored_path(read, spark, key))


def _stored_path(read, spark, key=None) -> str:
    key = key or (spark.sparkContext.applicationId, _files(read, "documents", "embeddings"))
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        index.write(chunks_of(read), vectors_of(read), path)
        _BUILT[key] = path
    return _BUILT[key]


def letters(dimensions: int = 64) -> encoder.Encoder:
    """A model that needs no files: how often each of a text's characters is there, by code point modulo the dimensions."""

    def load():
        import numpy as np

        return lambda texts: np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % dimensions, minlength=dimensions) for t in texts], float)

    return encoder.Encoder(load, dimensions, "letters", "1")


def changed_documents(read):
    """The tables with every tenth text longer, and every tenth gone."""
    m = F.col("doc_id") % 10
    docs = read("documents").where(m != 7).withColumn("text", F.when((m == 3) & F.col("text").rlike(r"\S"), F.concat("text", F.lit(" Revised revised wording"))).otherwise(F.col("text")))
    return lambda table: docs if table == "documents" else read(table)


def doc_id(c):
    return F.substring(c, 2, 12).cast("bigint").alias("doc_id")


def _lexical(read, spark, only=None):
    own = stored_index(read, spark)
    return search.lexical(own.postings, own.stats, read("benchmark").select("item_id", "text"), "chunk_id", "item_id", "text", only, own.terms).withColumn("doc_id", doc_id("chunk_id")).drop("chunk_id")


@query("write_index", f"WITH {_INDEX}, d AS (SELECT doc_id // 4 AS document FROM documents WHERE regexp_matches(text, '\\S')) SELECT (SELECT count(*) FROM size) AS chunks, (SELECT count(*) FROM tf) AS postings, (SELECT count(*) FROM size) AS vectors, (SELECT count(DISTINCT document) FROM d) AS documents, CAST((SELECT sum(length) FROM size) AS BIGINT) AS sum_token_count")
def _(read, spark):
    own = stored_index(read, spark)
    rows = own.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("documents")).join(F.broadcast(own.postings.agg(F.count(F.lit(1)).alias("postings"))))
    return rows.join(F.broadcast(own.vectors.agg(F.count(F.lit(1)).alias("vectors")))).join(F.broadcast(own.stats)).select("chunks", "postings", "vectors", "documents", "sum_token_count")


_CHANGED = _INDEX.replace("FROM documents", "FROM changed")


@query("index_upgrade", f"WITH changed AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 AND regexp_matches(text, '\\S') THEN text || ' Revised revised wording' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7), {_CHANGED} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(length) AS BIGINT) AS lengths, (SELECT n FROM stats) AS n FROM tf JOIN size USING (doc_id) GROUP BY term")
def _(read, spark):
    """The stored index brought to a corpus of which a tenth has changed and a tenth is gone: its postings by term, with the frequencies that the upgrade kept."""
    path = f"{shared_dir(spark)}/upgraded-{uuid.uuid4().hex}"
    versions.branch(spark, _stored_path(read, spark), path)
    index.upgrade(spark, path, chunks_of(changed_documents(read)), encoder.strict(letters()))
    own = index.read(spark, path)
    sums = own.signed.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("length").alias("lengths"))
    return sums.join(own.terms, "term").join(F.broadcast(own.stats.select("n"))).select("term", "df", "tf", "lengths", "n")


@query("encode", "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), v AS (SELECT doc_id, CAST(sum(n * n) AS DOUBLE) AS square, coalesce(max(n) FILTER (d = 37), 0) AS e FROM (SELECT doc_id, unicode(c) % 64 AS d, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2) GROUP BY doc_id) SELECT doc_id, 64 AS dimensions, round(e / sqrt(square), 6) AS e, CASE WHEN square IS NULL THEN 'empty' END AS error FROM documents LEFT JOIN v USING (doc_id)")
def _(read, spark):
    """Every text through a model; e is the vector's entry of the letter e."""
    rows = encoder.encode(read("documents").select("doc_id", "text"), letters())
    return rows.select("doc_id", F.lit(64).alias("dimensions"), F.round(F.get("embedding", F.lit(ord("e") % 64)), 6).alias("e"), "error")


@query("term_frequency", f"WITH {_INDEX} SELECT term, doc_id, tf FROM tf")
def _(read, spark):
    return search.postings(read("documents").where(F.col("text").rlike(r"\S")), "doc_id", "text").select("term", "doc_id", "tf")


@query("document_frequency", f"WITH {_INDEX} SELECT term, df FROM df")
def _(read, spark):
    return stored_index(read, spark).terms.select("term", "df")


@query("avg_length", f"WITH {_INDEX} SELECT n AS row_count, CAST((SELECT sum(length) FROM size) AS BIGINT) AS sum_token_count, round(average, 6) AS average FROM stats")
def _(read, spark):
    return stored_index(read, spark).stats.select(F.col("n").alias("row_count"), "sum_token_count", F.round("average", 6).alias("average"))


@query("bm25_score", f"WITH {_INDEX} SELECT doc_id, term, round({_BM25}, 6) AS score FROM tf JOIN df USING (term) JOIN size USING (doc_id), stats")
def _(read, spark):
    """Length is the number of white-space words of the document."""
    own = stored_index(read, spark)
    rows = own.postings.join(own.terms, "term").join(F.broadcast(own.stats))
    return rows.select(doc_id("chunk_id"), "term", F.round(search.bm25(*(F.col(c) for c in ("tf", "df", "length", "n", "average"))), 6).alias("score"))


@query("lexical_search", f"WITH {_LEXICAL} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lexical")
def _(read, spark):
    return _lexical(read, spark).withColumn("score", F.round("score", 6))


@query("lexical_in_documents", f"WITH {_LEXICAL.replace('WHERE df < 8', 'WHERE doc_id // 4 % 16 = item_id % 16 AND (df < 8').replace('4 <= n GROUP', '4 <= n) GROUP')} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lexical")
def _(read, spark):
    """Candidates kept to a set of documents for each question, with the frequencies of all: the set is a semi join on the hits' documents, not a list of pairs."""
    own = stored_index(read, spark)
    items = read("benchmark").select("item_id", "text", (F.col("item_id") % 16).alias("set"))
    sets = own.chunks.select("chunk_id", (F.substring("document_id", 2, 12).cast("bigint") % 16).alias("set"))
    hits = search.lexical_hits(own.postings, own.stats, items, "item_id", "text", own.terms).join(items.select("item_id", "set"), "item_id").join(sets, ["chunk_id", "set"], "left_semi")
    return search.scored(hits, "chunk_id", "item_id").select("item_id", doc_id("chunk_id"), F.round("score", 6).alias("score"), "rank")


_DENSE = """
q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
scores AS (SELECT query_id, vec_id, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM embeddings, q),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores QUALIFY rank <= 100)"""


def _dense(read):
    rows = read("embeddings")
    return search.dense(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", "embedding")


@query("dense_search", f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM dense")
def _(read, spark):
    return _dense(read).withColumn("score", F.round("score", 5))


@query("dot_product", "SELECT a.vec_id, b.vec_id AS query_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def _(read, spark):
    """Each question's vector, one row in fifty, against all rows."""
    rows = read("embeddings")
    return search.products(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", "embedding")


@query("normalize_rows", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 5) AS square FROM embeddings")
def _(read, spark):
    v = search.normalized(F.transform("embedding", lambda x: x * 3))
    return read("embeddings").select("vec_id", F.round(search.dot(v, v), 5).alias("square"))


@query("dense_min_gate", f"WITH {_DENSE}, best AS (SELECT query_id FROM scores WHERE vec_id <> query_id GROUP BY query_id HAVING max(score) >= 0.5) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores WHERE vec_id <> query_id) SEMI JOIN best USING (query_id) WHERE rank <= 99")
def _(read, spark):
    others = search.ranked(_dense(read).where("vec_id <> query_id").drop("rank"), "query_id", "vec_id", 99)
    return search.dense_gate(others, "query_id", 0.5).select("query_id", "vec_id", "rank")


@query("max_dense_score", f"WITH {_DENSE} SELECT query_id, coalesce(max(CASE WHEN vec_id <> query_id THEN round(score, 5) END), -1) AS best FROM dense GROUP BY query_id")
def _(read, spark):
    return _dense(read).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("vec_id") != F.col("query_id"), F.round("score", 5))), F.lit(-1.0)).alias("best"))


def _legs(read):
    """Two neighbouring vectors as the legs of a question."""
    rows = read("embeddings")
    leg = lambda k: search.dense(rows, rows.where(f"vec_id % 50 = {k}").select((F.col("vec_id") - k).alias("query_id"), "embedding"), "vec_id", "query_id", "embedding")
    return leg(0), leg(1)


_LEG = """a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id - {k} AS query_id, e.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = {k}) QUALIFY rank <= 100)"""
_LEGS = _LEG.format(k=0) + ", b" + _LEG.format(k=1)[1:]


@query("rrf", f"""
WITH {_LEGS}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS vec_id, a.rank AS lexical_rank, b.rank AS dense_rank, round(coalesce(1 / (60 + a.rank), 0) + coalesce(3 / (60 + b.rank), 0), 12) AS score
  FROM a FULL JOIN b ON a.vec_id = b.vec_id AND a.query_id = b.query_id)
SELECT query_id, vec_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(dense_rank AS INTEGER) AS dense_rank, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(lexical_rank, dense_rank), vec_id) AS INTEGER) AS rank FROM f
""")
def _(read, spark):
    fused = search.fuse(*_legs(read), "query_id", "vec_id")
    return fused.select("query_id", "vec_id", "lexical_rank", "dense_rank", F.round("score", 9).alias("score"), "rank")


@query("union_keys", f"WITH {_LEGS} SELECT query_id, vec_id FROM a UNION SELECT query_id, vec_id FROM b")
def _(read, spark):
    a, b = _legs(read)
    return a.select("query_id", "vec_id").union(b.select("query_id", "vec_id")).distinct()


@query("exact_route", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'authoritative_no_match' ELSE 'matched' END AS outcome, CASE WHEN item_id % 3 = 0 THEN '' || item_id ELSE '' || item_id || ',' || (item_id + 100) END AS documents FROM benchmark")
def _(read, spark):
    """Each item cites two documents; every third item's second one isn't there."""
    docs = read("documents").select("doc_id", F.concat(F.lit(" Doc "), F.col("doc_id")).alias("citation"))
    cited = read("benchmark").select("item_id", F.explode(F.array(F.col("item_id"), F.when(F.col("item_id") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("item_id") + 100))).alias("d")).select("item_id", F.concat(F.lit("doc "), F.col("d")).alias("citation"))
    return search.exact_route(cited, docs, "item_id", "citation", "doc_id").select("item_id", "outcome", F.array_join("documents", ",").alias("documents"))


@query("document_coverage", f"WITH {_LEXICAL} SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id <> most, rank) AS INTEGER) AS rank FROM (SELECT *, max(doc_id) OVER (PARTITION BY item_id) AS most FROM lexical)")
def _(read, spark):
    """The hit with the largest id is required: it comes first."""
    hits = _lexical(read, spark).withColumn("chunk", F.col("doc_id"))
    required = hits.groupBy("item_id").agg(F.max("doc_id").alias("doc_id")).withColumn("place", F.lit(1))
    return search.cover_documents(hits, required, "item_id", "doc_id", "chunk").select("item_id", "doc_id", "rank")


@query("per_doc_cap", f"WITH {_LEXICAL}, x AS (SELECT item_id, doc_id, rank, doc_id % 10 AS parent, sha256(text) AS sha FROM lexical JOIN documents USING (doc_id)), o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY item_id, sha ORDER BY rank) = 1) SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM o QUALIFY row_number() OVER (PARTITION BY item_id, parent ORDER BY rank) <= 2")
def _(read, spark):
    hits = _lexical(read, spark).join(read("documents").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id").withColumn("parent", F.col("doc_id") % 10)
    return search.per_document_cap(hits, "item_id", "parent", "sha").select("item_id", "doc_id", "rank")


def questions(read):
    """Benchmark items as questions; every third names the document of its number, every ninth one that isn't there as well. The vector is that of vec_id = item_id modulo their number."""
    vectors = read("embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    n, whole = vectors.count(), F.col("item_id") % 16
    cite = F.when(F.col("item_id") % 9 == 0, F.concat(F.lit(" see 1 CFR 99999999 and "), whole % 50 + 1, F.lit(" cfr "), whole)).when(F.col("item_id") % 3 == 0, F.concat(F.lit(" see "), whole % 50 + 1, F.lit(" cfr "), whole)).otherwise("")
    rows = read("benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", cite).alias("text"), (F.col("item_id") % n).alias("__v"))
    return rows.join(vectors, "__v").drop("__v")


@query("hybrid_query")
def _(read, spark):
    """Evidence of 5 items and 32 KiB for each question, over the stored index; questions that cite keep to what they cite."""
    items, _outcomes = hybrid.query(stored_index(read, spark), questions(read), dense_min=0.1)
    return items.select("query_id", "place", doc_id("chunk_id"), F.round("score", 6).alias("score"), "lexical_rank", "dense_rank", doc_id("neighbor_of").alias("neighbor_of"))


@query("hybrid_outcomes", "SELECT item_id AS query_id, CASE WHEN item_id % 9 = 0 THEN 'authoritative_no_match' ELSE 'matched' END AS outcome FROM benchmark")
def _(read, spark):
    _items, outcomes = hybrid.query(stored_index(read, spark), questions(read), dense_min=0.1)
    return outcomes


@query("result_validate", "SELECT 0 AS errors, (SELECT count(*) FROM benchmark WHERE item_id % 9 <> 0) AS answered")
def _(read, spark):
    """Results in all three modes hold what readers rely on."""
    own, asked, rows = stored_index(read, spark), questions(read), None
    found = hybrid.legs(own, asked)
    for mode in hybrid.MODES:
        items, outcomes = hybrid.query(own, asked, mode=mode, found=found)
        items = stored(items, "evidence")
        wrong = hybrid.result_errors(items, outcomes, 5, 32_768).select(F.lit(1).alias("error"), F.lit(None).cast("bigint").alias("query_id"))
        wrong = wrong if mode != "hybrid" else wrong.unionByName(items.select(F.lit(0).alias("error"), "query_id").distinct())
        rows = wrong if rows is None else rows.unionByName(wrong)
    return rows.agg(F.coalesce(F.sum("error"), F.lit(0)).cast("int").alias("errors"), F.count("query_id").alias("answered"))


@query("neighbor_lookup", f"WITH {_LEXICAL}, n AS (SELECT item_id, doc_id AS neighbor_of, rank, CASE WHEN s = 1 THEN doc_id - 1 ELSE doc_id + 1 END AS doc_id, s FROM lexical, unnest([1, 2]) AS u(s)), k AS (SELECT n.* FROM n JOIN documents d USING (doc_id) WHERE regexp_matches(text, '\\S') AND n.doc_id // 4 = neighbor_of // 4) SELECT item_id, doc_id, neighbor_of FROM k QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank, neighbor_of, s) = 1")
def _(read, spark):
    """The neighbours of the lexical hits, each with the best hit beside it. (No text of the tables is blank between others, so that neighbours' ids are neighbours.)"""
    own = stored_index(read, spark)
    hits = search.lexical(own.postings, own.stats, read("benchmark").select(F.col("item_id").alias("query_id"), "text"), "chunk_id", "query_id", "text", None, own.terms)
    return hybrid.neighbors(own, hits).select(F.col("query_id").alias("item_id"), doc_id("chunk_id"), doc_id("neighbor_of").alias("neighbor_of"))


@query("dense_subset", "WITH v AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT item_id, doc_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM benchmark, v JOIN embeddings a ON a.vec_id = item_id % n JOIN documents d ON doc_id // 4 = item_id AND regexp_matches(text, '\\S') JOIN embeddings b ON b.vec_id = doc_id % n) SELECT item_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s")
def _(read, spark):
    """Scores of the chunks of one document for each question only."""
    own = stored_index(read, spark)
    only = read("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("d"), F.lpad(F.col("item_id").cast("string"), 12, "0")).alias("document_id")).join(own.chunks.select("document_id", "chunk_id"), "document_id")
    hits = search.dense_among(own.vectors, questions(read), only.select("query_id", "chunk_id"), "chunk_id", "query_id", "embedding")
    return hits.select(F.col("query_id").alias("item_id"), doc_id("chunk_id"), F.round("score", 6).alias("score"), "rank")


@query("index_order", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS vector_row FROM documents WHERE regexp_matches(text, '\\S')")
def _(read, spark):
    return index.row_numbers(stored_index(read, spark).chunks).select(doc_id("chunk_id"), "vector_row")


@query("chunk_validate", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'digest' WHEN 2 THEN 'tokens' END AS error FROM documents WHERE regexp_matches(text, '\\S') AND doc_id % 5 < 3")
def _(read, spark):
    """Chunks that were broken in three ways are found, and no others."""
    m = F.substring("chunk_id", 2, 12).cast("bigint") % 5
    rows = stored_index(read, spark).chunks.withColumns({"content": F.when(m == 0, "").otherwise(F.col("content")), "sha256": F.when(m == 1, F.lit("x")).otherwise(F.col("sha256")), "token_count": F.when(m == 2, F.lit(0)).otherwise(F.col("token_count"))})
    return index.chunk_errors(rows).select(doc_id("chunk_id"), "error")


@query("incremental_vectors", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'encode' ELSE 'keep' END AS action FROM documents WHERE regexp_matches(text, '\\S')")
def _(read, spark):
    """Vectors are kept where the text and the model are what they were; every third text has changed since."""
    own = stored_index(read, spark)
    mark = index.identity(F.lit("model"), F.lit("1"), F.lit("64"))
    old = own.vectors.withColumn("identity", mark)
    changed = F.when(F.substring("chunk_id", 2, 12).cast("bigint") % 3 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("sha256"))
    kept, new = index.to_encode(own.chunks.withColumn("now", changed).withColumn("identity", mark), old, "now")
    return kept.select(doc_id("chunk_id"), F.lit("keep").alias("action")).unionByName(new.select(doc_id("chunk_id"), F.lit("encode").alias("action")))


@query("memory_search", """
WITH t AS (SELECT conv_id, turn, text, list_distinct(list_concat(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), regexp_extract_all(regexp_replace(text, '[A-Za-z0-9]+', ' ', 'g'), '[\\p{L}\\p{N}]'))) AS terms FROM conversations)
SELECT conv_id, turn, CAST(len(list_intersect(terms, ['the', 'of', 'nicht', 'ther'])) + CASE WHEN contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the of nicht ther') THEN 100 ELSE 0 END AS BIGINT) AS score
FROM t WHERE len(list_intersect(terms, ['the', 'of', 'nicht', 'ther'])) > 0
""")
def _(read, spark):
    from skein.operators.conversation import recall_score

    return recall_score(read("conversations"), "the of nicht ther").select("conv_id", "turn", "score")


@query("memory_order", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS INTEGER) AS place FROM conversations")
def _(read, spark):
    from pyspark.sql import Window

    return read("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")).alias("place"))


@query("byte_budget_greedy", """
WITH RECURSIVE x AS (SELECT conv_id, turn, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, turn, rn, CASE WHEN size <= 2000 THEN size ELSE 0 END AS used, size <= 2000 AS taken FROM x WHERE rn = 1
  UNION ALL SELECT x.conv_id, x.turn, x.rn, CASE WHEN used + size <= 2000 THEN used + size ELSE used END, used + size <= 2000 FROM r JOIN x ON x.conv_id = r.conv_id AND x.rn = r.rn + 1)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS INTEGER) AS place FROM r WHERE taken
""")
def _(read, spark):
    rows = read("conversations").withColumn("size", F.octet_length("text"))
    return search.greedy_bytes(rows, "conv_id", "turn", "size", [F.col("turn")], 2000)
