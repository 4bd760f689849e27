"""The full query over a stored index, for a table of questions at once: citation route, lexical and dense legs, gate, fusion, coverage, neighbours and evidence within a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import citations
from skein.operators import search
from skein.operators.index import Index
from skein.sources.shared import stored

MODES = ("lexical", "dense", "hybrid")


def check_bounds(top_k: int, most_bytes: int, mode: str) -> None:
    if not 1 <= top_k <= 20 or not 1 <= most_bytes <= 32_768 or mode not in MODES:
        raise ValueError("top_k is 1 to 20, most_bytes 1 to 32768, the mode lexical, dense or hybrid")


def question_ok(text: Column) -> Column:
    """Not blank, no longer than 16 KiB, and with no more than eight citations."""
    return F.coalesce((F.trim(text) != "") & (F.octet_length(text) <= 16_384) & (F.size(citations(text)) <= 8), F.lit(False))


def cited_documents(index: Index, questions: DataFrame) -> DataFrame:
    """query_id, place, citation and document_id (null if there is none) for the citations that questions name."""
    named = questions.select("query_id", F.posexplode(citations(F.col("text"))).alias("place", "citation"))
    known = index.chunks.select(F.lower(F.trim("citation")).alias("citation"), "document_id").join(named.select("citation").distinct(), "citation", "left_semi")
    known = known.groupBy("citation").agg(F.min("document_id").alias("document_id"))
    return named.join(known, "citation", "left").select("query_id", "place", "citation", "document_id")


def neighbors(index: Index, hits: DataFrame) -> DataFrame:
    """query_id, chunk_id and neighbor_of: the chunks before and behind each hit (query_id, chunk_id, rank) in its own document, each once, as the neighbour of the best hit."""
    own = index.chunks.select("chunk_id", "document_id", "previous_id", "next_id")
    beside = hits.select("query_id", "chunk_id", "rank").join(own, "chunk_id")
    beside = beside.select("query_id", F.col("chunk_id").alias("neighbor_of"), "document_id", "rank", F.posexplode(F.array("previous_id", "next_id")).alias("side", "chunk_id")).where("chunk_id is not null")
    beside = beside.join(own.select("chunk_id", "document_id"), ["chunk_id", "document_id"], "left_semi")
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "neighbor_of", "side")
    return beside.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "chunk_id", "neighbor_of", "rank", "side")


@dataclass(frozen=True)
class Legs:
    """What all modes rank, stored: hits of both legs by questions that name no documents (free) and by those whose documents are all there (bound), the documents that these name (required: query_id, document_id, place), and routes (query_id, found)."""

    lexical: DataFrame | None
    dense_free: DataFrame | None
    dense_bound: DataFrame | None
    required: DataFrame
    routes: DataFrame
    free: DataFrame


def legs(index: Index, questions: DataFrame, modes: tuple[str, ...] = MODES) -> Legs:
    """The legs that these modes need, each found once: no more than CUT hits of a question are kept of a leg."""
    asked = questions.where(question_ok(F.col("text")))
    cited = stored(cited_documents(index, asked), "cited")
    routes = cited.groupBy("query_id").agg(F.bool_and(F.col("document_id").isNotNull()).alias("found"))
    required = cited.join(routes.where("found"), "query_id", "left_semi").groupBy("query_id", "document_id").agg(F.min("place").alias("place"))
    free, bound = asked.join(routes, "query_id", "left_anti"), asked.join(routes.where("found"), "query_id", "left_semi")
    lex = open_ = own = None
    only = stored(index.chunks.select("document_id", "chunk_id").join(search.few(required), "document_id").select("query_id", "chunk_id"), "only")
    if modes != ("dense",):
        of = lambda some, chunks=None: search.lexical(index.postings, index.stats, some, "chunk_id", "query_id", "text", chunks, index.terms)
        lex = stored(of(free).unionByName(of(bound, only)), "lexical-leg")
    if modes != ("lexical",):
        open_ = stored(search.dense(index.vectors, free, "chunk_id", "query_id", "embedding"), "dense-leg")
        own = stored(search.dense_among(index.vectors, bound, only, "chunk_id", "query_id", "embedding"), "dense-leg-bound")
    return Legs(lex, open_, own, required, routes, free)


def ranked_hits(index: Index, questions: DataFrame, mode: str, dense_min: float | None, dense_weight: float = 3.0, found: Legs | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, chunk_id, document_id, score, lexical_rank, dense_rank, rank), stored, and outcomes (query_id, outcome) before evidence is selected. found: legs() of these questions, if there are already.

    Questions that name documents get hits of these only, and none (authoritative_no_match) if one of them isn't there; those that name none get no hits if the best dense score is below dense_min.
    """
    found = found or legs(index, questions, (mode,))
    required, routes, free = found.required, found.routes, found.free
    lex, gated = found.lexical, free.select("query_id").limit(0)
    if mode != "lexical":
        open_ = found.dense_free
        if dense_min is not None:
            kept = search.dense_gate(open_, "query_id", dense_min)
            gated = free.join(kept, "query_id", "left_anti").select("query_id")
            open_ = kept
            lex = lex if lex is None else lex.join(gated, "query_id", "left_anti")
        den = open_.unionByName(found.dense_bound)
    if mode == "hybrid":
        hits = search.fuse(lex, den, "query_id", "chunk_id", dense_weight).where(F.col("rank") <= search.CUT)
    else:
        null = F.lit(None).cast("int")
        hits = (lex if mode == "lexical" else den).withColumn("lexical_rank", F.col("rank") if mode == "lexical" else null).withColumn("dense_rank", F.col("rank") if mode == "dense" else null)
    hits = hits.join(index.chunks.select("chunk_id", "document_id"), "chunk_id").select("query_id", "chunk_id", "document_id", "score", "lexical_rank", "dense_rank", "rank")
    # a document that is asked for and has no hit is there by its first chunk, with no score
    firsts = index.chunks.join(required.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.min_by("chunk_id", F.struct(F.col("previous_id").isNotNull(), "chunk_id")).alias("chunk_id"))
    missing = required.join(hits, ["query_id", "document_id"], "left_anti").join(firsts, "document_id")
    null = F.lit(None).cast("int")
    hits = hits.unionByName(missing.select("query_id", "chunk_id", "document_id", F.lit(0.0).alias("score"), null.alias("lexical_rank"), null.alias("dense_rank"), F.lit(search.CUT + 1).alias("rank")))
    hits = search.cover_documents(hits, required, "query_id", "document_id", "chunk_id")
    hits = stored(hits.join(required.select("query_id", "document_id", F.col("place").alias("required")), ["query_id", "document_id"], "left"), "hits")  # about a hundred rows for each question, read several times
    outcome = F.when(~question_ok(F.col("text")), "invalid").when(~F.col("found"), "authoritative_no_match").when(F.col("gated"), "below_threshold").when(F.col("any"), "matched").otherwise("no_hits")
    marks = questions.join(routes, "query_id", "left").join(gated.distinct().withColumn("gated", F.lit(True)), "query_id", "left").join(hits.select("query_id").distinct().withColumn("any", F.lit(True)), "query_id", "left")
    return hits, marks.select("query_id", outcome.alias("outcome"))


def query(index: Index, questions: DataFrame, top_k: int = 5, most_bytes: int = 32_768, mode: str = "hybrid", dense_min: float | None = None, found: Legs | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence for questions (query_id, text, embedding): one table of items (query_id, place, chunk_id, document_id, content, sha256, bytes, score, lexical_rank, dense_rank, neighbor_of), one of outcomes (query_id, outcome).

    found: legs() of these questions, for whoever asks in several modes.
    """
    check_bounds(top_k, most_bytes, mode)
    hits, outcomes = ranked_hits(index, questions, mode, dense_min, found=found)
    chunks = index.chunks.select("chunk_id", "content", "sha256", F.octet_length("content").cast("bigint").alias("bytes"))
    hits = hits.withColumn("neighbor_of", F.lit(None).cast("string"))
    near = neighbors(index, hits).join(index.chunks.select("chunk_id", "document_id"), "chunk_id")
    near = near.select("query_id", "chunk_id", "document_id", F.lit(0.0).alias("score"), *(F.lit(None).cast("int").alias(c) for c in ("lexical_rank", "dense_rank")), (F.lit(1000) + 2 * F.col("rank") + F.col("side")).alias("rank"), F.lit(None).cast("int").alias("required"), "neighbor_of")
    both = hits.unionByName(stored(near, "neighbors"))
    wanted = search.few(both.select("chunk_id").distinct())
    items = stored(chunks.join(wanted, "chunk_id", "left_semi").join(both, "chunk_id"), "items")  # contents are cut to these before they meet the hits
    chosen = search.select_evidence(items, "query_id", top_k, most_bytes)
    best = items.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("n = 1")
    return chosen.join(best, ["query_id", "chunk_id"]).select("query_id", "place", "chunk_id", "document_id", "content", "sha256", "bytes", "score", "lexical_rank", "dense_rank", "neighbor_of"), outcomes


def result_errors(items: DataFrame, outcomes: DataFrame, top_k: int, most_bytes: int) -> DataFrame:
    """query_id and error for results that break what readers rely on: ranks from 1 to 100 or none, digests of the contents, no chunk or content twice, a neighbour's hit among the items, no more than top_k items and most_bytes, none without a match."""
    bad_rank = lambda c: F.coalesce(~F.col(c).between(1, search.CUT), F.lit(False))
    own = F.when(bad_rank("lexical_rank") | bad_rank("dense_rank"), "rank").when(F.sha2("content", 256) != F.col("sha256"), "digest")
    rows = items.select("query_id", own.alias("error")).where("error is not null")
    total = F.when(F.count(F.lit(1)) > top_k, "items").when(F.sum(F.octet_length("content")) > most_bytes, "bytes").when((F.countDistinct("chunk_id") < F.count(F.lit(1))) | (F.countDistinct("sha256") < F.count(F.lit(1))), "repeated")
    sums = items.groupBy("query_id").agg(total.alias("error")).where("error is not null")
    alone = items.where("neighbor_of is not null").join(items.select("query_id", F.col("chunk_id").alias("neighbor_of")), ["query_id", "neighbor_of"], "left_anti").select("query_id", F.lit("neighbor").alias("error"))
    without = items.join(outcomes.where("outcome = 'matched'"), "query_id", "left_anti").select("query_id", F.lit("outcome").alias("error"))
    return rows.unionByName(sums).unionByName(alone).unionByName(without).distinct()
