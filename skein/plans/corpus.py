"""Corpus building, chunks, links, set operations and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import checks, corpus
from skein.plans.registry import query
from skein.sources import corpus_files, listing
from skein.sources.shared import shared_dir


@query("select_documents", "SELECT doc_id, strlen(text) AS body_bytes FROM documents ORDER BY strlen(text) DESC, doc_id LIMIT 100")
def _(read, spark):
    docs = read("documents").select("doc_id", F.octet_length("text").cast("bigint").alias("body_bytes"))
    return corpus.select_documents(docs, 100, "body_bytes", "doc_id")


@query("dedupe_conflict", "SELECT source, count(*) AS n, count(DISTINCT text) > 1 AS conflict FROM documents GROUP BY source")
def _(read, spark):
    return corpus.dedupe_conflicts(read("documents"), "source", "text")


@query("exact_copies", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(read, spark):
    return read("documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_CHUNKS = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
chunks AS (SELECT doc_id, s AS start, least(768, len(w) - s) AS n_words, array_to_string(w[s + 1:s + 768], ' ') AS content FROM w, unnest(range(0, greatest(len(w) - 97, 0) + 1, 672)) AS u(s) WHERE len(w) > 0)
"""


@query("chunk_fixed", f"WITH {_CHUNKS} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words, sha256(content) AS sha256 FROM chunks")
def _(read, spark):
    return corpus.chunk_fixed(read("documents"), "doc_id", "text").select("doc_id", "start", "n_words", F.sha2("content", 256).alias("sha256"))


@query("neighbor_links", f"WITH {_CHUNKS} SELECT doc_id, CAST(start AS INTEGER) AS start, lag(doc_id || ':' || start) OVER o AS previous_id, lead(doc_id || ':' || start) OVER o AS next_id FROM chunks WINDOW o AS (PARTITION BY doc_id ORDER BY start)")
def _(read, spark):
    chunks = corpus.chunk_fixed(read("documents"), "doc_id", "text").withColumn("chunk_id", F.concat_ws(":", "doc_id", "start"))
    return corpus.neighbor_links(chunks, "doc_id", "start", "chunk_id").select("doc_id", "start", "previous_id", "next_id")


@query("adjacent_chunks", f"WITH {_CHUNKS} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + 672 AS INTEGER) AS next_start FROM chunks a SEMI JOIN chunks b ON a.doc_id = b.doc_id AND b.start = a.start + 672")
def _(read, spark):
    chunks = corpus.chunk_fixed(read("documents"), "doc_id", "text").select("doc_id", "start")
    return chunks.join(chunks.select("doc_id", F.col("start").alias("next_start")), "doc_id").where("next_start = start + 672")


@query("doc_first_chunk", f"WITH {_CHUNKS} SELECT doc_id, arg_min(n_words, start)::INTEGER AS first_words, count(*) AS n_chunks FROM chunks GROUP BY doc_id")
def _(read, spark):
    return corpus.chunk_fixed(read("documents"), "doc_id", "text").groupBy("doc_id").agg(F.min_by("n_words", "start").alias("first_words"), F.count(F.lit(1)).alias("n_chunks"))


@query("chunk_document")
def _(read, spark):
    """Token-budget chunks with white-space words as tokens; checked by unit tests."""
    docs = read("documents").select(F.concat(F.lit("doc-"), F.md5("text")).alias("document_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("prefix"), F.col("text").alias("body"), F.lit(1).alias("body_start_line"))
    return corpus.chunk_documents(docs.where(F.trim("body") != ""), _count_words)


def _count_words(text: str) -> int:
    return len(text.split())


@query("line_range", "SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS line FROM documents")
def _(read, spark):
    """The line that a text's end is on."""
    return read("documents").select("doc_id", (1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("line"))


@query("token_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_tokens FROM documents")
def _(read, spark):
    return read("documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("bigint").alias("n_tokens"))


@query("token_sum", r"SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, bool_and(n > 0) AS all_positive FROM (SELECT lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents) GROUP BY lang")
def _(read, spark):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return read("documents").select("lang", n.alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"), F.bool_and(F.col("n") > 0).alias("all_positive"))


@query("incremental_vector_reuse", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'encode' WHEN doc_id % 7 = 0 THEN 'encode' ELSE 'reuse' END AS action FROM documents")
def _(read, spark):
    """The old index lacks a tenth of the documents and has other contents for a seventh."""
    new = read("documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    old = new.where("doc_id % 10 <> 0").withColumn("old_sha", F.when(F.col("doc_id") % 7 == 0, F.sha2("sha", 256)).otherwise(F.col("sha"))).drop("sha")
    return new.join(old, "doc_id", "left").select("doc_id", F.when(F.col("sha") == F.col("old_sha"), "reuse").otherwise("encode").alias("action"))


@query("stale_removal", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0")
def _(read, spark):
    docs = read("documents").select("doc_id")
    return docs.exceptAll(docs.where("doc_id % 5 <> 0"))


@query("inventory_equality", "SELECT side, doc_id FROM (SELECT 'missing' AS side, doc_id FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'unlisted', doc_id FROM documents WHERE doc_id % 60 = 1)")
def _(read, spark):
    docs = read("documents").select("doc_id")
    return checks.inventory_differences(docs.where("doc_id % 60 <> 1"), docs.where("doc_id % 50 <> 0 OR doc_id % 60 = 1"), "doc_id")


@query("label_antijoin", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def _(read, spark):
    return read("labels").select("doc_id").join(read("documents").where("doc_id % 3 <> 0").select("doc_id"), "doc_id", "left_anti")


@query("fk_check", "SELECT 'nation' AS link, count(*) AS orphans FROM customer c ANTI JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) n ON c.c_nationkey = n.n_nationkey UNION ALL SELECT 'order', count(*) FROM lineitem l ANTI JOIN orders o ON l.l_orderkey = o.o_orderkey")
def _(read, spark):
    return checks.orphans("nation", read("customer"), "c_nationkey", read("nation").where("n_nationkey <> 3"), "n_nationkey").union(checks.orphans("order", read("lineitem"), "l_orderkey", read("orders"), "o_orderkey"))


@query("row_map_contiguous", "SELECT count(*) AS n, min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*) AS contiguous FROM embeddings")
def _(read, spark):
    return checks.contiguous(read("embeddings"), "vec_id", 0)


@query("verify_vectors", "SELECT count(*) AS n, CAST(count(*) * 64 * 2 AS BIGINT) AS half_bytes, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_length FROM embeddings")
def _(read, spark):
    return checks.vector_shape(read("embeddings"), "embedding", 64)


@query("verify_documents", "SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) FILTER (WHERE length(text) <> n_chars) AS bad_length FROM documents")
def _(read, spark):
    return read("documents").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("repeated_ids"), F.count_if(F.length("text") != F.col("n_chars")).alias("bad_length"))


@query("verify_files", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'digest' WHEN doc_id % 13 = 0 THEN 'bytes' ELSE 'ok' END AS state FROM documents")
def _(read, spark):
    docs = read("documents").select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"))
    listed = docs.select("doc_id", F.when((F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 11 != 0), F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("sha")).alias("sha"))
    return checks.verify_files(listed, docs, "doc_id", "bytes", "sha")


@query("retrieval_revision", "SELECT sha256('{\"docs\":' || count(*) || ',\"langs\":' || count(DISTINCT lang) || '}') AS revision FROM documents")
def _(read, spark):
    seed = F.to_json(F.struct(F.count(F.lit(1)).alias("docs"), F.countDistinct("lang").alias("langs")))
    return read("documents").agg(F.sha2(seed, 256).alias("revision"))


@query("xml_sections")
def _(read, spark):
    """Sections of a nested document made from each row's text, read back by the parser that keeps ancestors."""
    from skein.sources.sections import parse_sections

    title = F.concat(F.lit("<ROOT><DIV1 TYPE='TITLE' N='1'><HEAD>Title 1</HEAD><DIV5 TYPE='PART' N='"), F.col("doc_id"), F.lit("'><HEAD>Part</HEAD><DIV8 TYPE='SECTION' N='1.1'><HEAD>§ 1.1 First.</HEAD><P>"), F.regexp_replace("text", "[<>&\\x00-\\x08]", " "), F.lit("</P></DIV8><DIV8 TYPE='SECTION' N='1.2'><HEAD>§ 1.2 [Reserved]</HEAD></DIV8></DIV5></DIV1></ROOT>"))
    return parse_sections(read("documents").select(F.col("doc_id").cast("string").alias("source"), title.cast("binary").alias("content")))


def corpus_documents(read):
    """Each text as a Markdown document, by language and source."""
    docs = read("documents").where("text is not null")
    number = F.col("doc_id").cast("string")
    return docs.select(
        number.alias("citation"), F.concat_ws("/", "lang", "source", F.concat(number, F.lit(".md"))).alias("path"), corpus.markdown({"doc_id": number}, F.concat(F.lit("Document "), number), F.col("text")).alias("text"),
        F.octet_length("text").cast("bigint").alias("body_bytes"), F.sha2("text", 256).alias("body_sha256"),
    )


@query("write_corpus", "WITH f AS (SELECT concat_ws('/', lang, source, doc_id || '.md') AS path, '---' || chr(10) || 'doc_id: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || '# Document ' || doc_id || chr(10) || chr(10) || text || chr(10) AS file FROM documents WHERE text IS NOT NULL) SELECT path, CAST(strlen(file) AS BIGINT) AS bytes, sha256(file) AS sha256, 'ok' AS state FROM f")
def _(read, spark):
    """All documents written as files, published, and read back: what the manifest says of each file, and whether the file is so."""
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpus_files.write_corpus(corpus_documents(read), root)
    return corpus_files.read_manifest(spark, root).select("path", "bytes", "sha256").join(corpus_files.verify_corpus(spark, root), "path")


@query("list_files", "WITH f AS (SELECT doc_id, lang, source, strlen('---' || chr(10) || 'doc_id: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || '# Document ' || doc_id || chr(10) || chr(10) || text || chr(10)) AS bytes FROM documents WHERE text IS NOT NULL) SELECT concat_ws('/', lang, source, doc_id || '.md') AS path, false AS directory, CAST(bytes AS BIGINT) AS bytes FROM f UNION ALL SELECT DISTINCT concat_ws('/', lang, source), true, CAST(0 AS BIGINT) FROM f UNION ALL SELECT DISTINCT lang, true, CAST(0 AS BIGINT) FROM f")
def _(read, spark):
    """All files and folders of the published corpus, listed by tasks from its root on."""
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpus_files.write_corpus(corpus_documents(read), root)
    rows, _ = listing.walk(spark, corpus_files.files_folder(spark, root))
    return rows.where("not omitted").select("path", "directory", "bytes")


@query("title_download_join", "SELECT s_suppkey AS number, CASE WHEN s_nationkey = 3 THEN 'missing' WHEN s_acctbal < 0 THEN 'url' WHEN s_acctbal < 500 THEN 'digest' END AS error, CASE WHEN s_nationkey <> 3 THEN 'https://host/title-' || s_suppkey || CASE WHEN s_acctbal < 0 THEN '.txt' ELSE '.xml' END END AS url FROM supplier")
def _(read, spark):
    """Suppliers as titles: those of a nation have no download, those in debt one of another address, those with little a cut digest."""
    rows = read("supplier")
    titles = rows.select(F.col("s_suppkey").cast("bigint").alias("number"), F.col("s_name").alias("name"), F.lit(False).alias("reserved"))
    url = F.concat(F.lit("https://host/title-"), "s_suppkey", F.when(F.col("s_acctbal") < 0, ".txt").otherwise(".xml"))
    digest = F.when(F.col("s_acctbal") < 500, F.substring(F.sha2("s_name", 256), 1, 63)).otherwise(F.sha2("s_name", 256))
    downloads = rows.where("s_nationkey <> 3").select(url.alias("url"), F.format_string("raw/title-%03d.xml", F.col("s_suppkey")).alias("relative_path"), digest.alias("sha256"), F.lit("2024-01-01T00:00:00Z").alias("retrieved_utc"))
    return corpus_files.title_downloads(titles, downloads, "https://host/title-%d.xml").select("number", "error", "url")
