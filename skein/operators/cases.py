"""Evaluation cases of an index: made from its documents and chunks by the order of their ids' hashes, with curated ones and ones without an answer, and checked.

The numbers of cases are parameters, so that what is picked is bounded; candidates are ranked by their ids alone, and texts meet the picked ids afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.policy import zh_concepts
from skein.operators import evals
from skein.operators.checks import assert_none
from skein.sources.shared import stored

# fixed values: cases of each kind, the fewest in all, and the forms of questions and reasons
POSITIVES = {"citation": 60, "paraphrase_en": 60, "cross_language_zh": 60, "multi_concept": 40, "adjacent_context": 30}
NEGATIVES = {"no_answer": 25, "hostile_query": 25}
LEAST = 300
PARAPHRASE = "What federal requirements apply to %s? %s"
CROSS_LANGUAGE = "关于%s，这条美国联邦法规规定了什么？"
MULTI_CONCEPT = "Compare the federal requirements for %s and %s."
ADJACENT = "What context immediately follows the rule about %s? %s"
PARAPHRASE_WORDS, ADJACENT_WORDS, CONCEPTS, QUERY_CHARS, QUERY_BYTES = 8, 10, 4, 16_000, 16_384
REASONS = {
    "citation": "Exact citation audited against %s in the locked document manifest.",
    "paraphrase_en": "English paraphrase audited against %s at %s.",
    "cross_language_zh": "Chinese cross-language query audited against %s at %s; source title is %s.",
    "multi_concept": "Two-source case audited against %s (%s) and %s (%s).",
    "adjacent_context": "Adjacent-chunk label %s follows primary %s in %s at %s.",
}
CURATED_REASON = "Frozen source-checked case: "

_CASE = ["case_id", "split", "language", "query", "relevant_document_ids", "relevant_chunk_ids", "kind", "rationale"]
_NONE = "cast(array() AS array<string>)"


def _first_words(content: Column, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(content, F.lit("[A-Za-z][A-Za-z0-9'-]+"), 0), 1, n), " ")


def _filled(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return out


def _placed(rows: DataFrame, key: str, salt: str, slices: list[tuple[str, int]]) -> DataFrame:
    """rows of the slices with `kind`, and `index` from 0 on within it."""
    picked = evals.hash_slices(rows.select(key), key, salt, slices)
    before, index = 0, F.lit(None).cast("int")
    for kind, n in slices:
        index = F.when(F.col("kind") == kind, F.col("place") - 1 - before).otherwise(index)
        before += n
    return rows.join(F.broadcast(picked.select(key, "kind", index.alias("index"))), key)


def positives(documents: DataFrame, chunks: DataFrame, sizes: dict[str, int] | None = None, salt: str = "eval-v2:") -> DataFrame:
    """Cases with an answer: case_id, split, language, query, relevant_document_ids, relevant_chunk_ids, kind, rationale.

    documents (document_id, citation, path, title, content of the first chunk) give, in the order of sha256(salt + document_id): citations, English paraphrases, and comparisons of two, as disjoint slices; and Chinese questions on the first ones
    whose titles have known concepts, which may be in other slices too. chunks (document_id, citation, path, title, chunk_id, next_id, content) with a next one give questions on what follows, in the order of their own ids.
    Documents without an id, citation, path or title, and chunks without one of these or a next one, can't give a case, and those behind them move up. Odd serials over all kinds, in the order of sizes, are for development.
    Ids are expected once: a repeated one gives repeated cases, which composition_errors() names.
    """
    sizes = POSITIVES if sizes is None else sizes
    serial, starts = 0, {}
    for kind in POSITIVES:
        starts[kind] = serial
        serial += sizes[kind]
    sound = documents.where(_filled("document_id", "citation", "path", "title"))
    docs = _placed(sound, "document_id", salt, [("citation", sizes["citation"]), ("paraphrase_en", sizes["paraphrase_en"]), ("multi_concept", 2 * sizes["multi_concept"])])
    zh = _placed(sound.where(F.size(zh_concepts(F.col("title"))) > 0), "document_id", salt, [("cross_language_zh", sizes["cross_language_zh"])])
    next_to = _placed(chunks.where(_filled("document_id", "citation", "path", "title", "chunk_id", "next_id")), "chunk_id", salt, [("adjacent_context", sizes["adjacent_context"])])

    def rows(of: DataFrame, kind: str, query: Column, rationale: Column, ids: Column, chunk_ids: Column | None = None, language: str = "en") -> DataFrame:
        return of.select(
            F.format_string(f"pos-{kind.replace('_', '-')}-%03d", F.col("index") + 1).alias("case_id"), evals.split_parity(F.col("index") + 1 + starts[kind]).alias("split"), F.lit(language).alias("language"), F.substring(query, 1, QUERY_CHARS).alias("query"),
            ids.alias("relevant_document_ids"), (F.expr(_NONE) if chunk_ids is None else chunk_ids).alias("relevant_chunk_ids"), F.lit(kind).alias("kind"), rationale.alias("rationale"),
        )

    def reason(kind: str, *columns: str) -> Column:
        return F.format_string(REASONS[kind], *columns)

    content = F.coalesce("content", F.lit(""))
    own = F.array("document_id")
    side = F.struct("index", "document_id", "citation", "path", "title")
    pairs = docs.where("kind = 'multi_concept'").groupBy(F.floor(F.col("index") / 2).cast("int").alias("pair")).agg(F.min(side).alias("l"), F.max(side).alias("r"))
    pairs = pairs.where("l.index < r.index").withColumnRenamed("pair", "index")
    return (
        rows(docs.where("kind = 'citation'"), "citation", F.col("citation"), reason("citation", "path"), own)
        .unionByName(rows(docs.where("kind = 'paraphrase_en'"), "paraphrase_en", F.format_string(PARAPHRASE, "title", _first_words(content, PARAPHRASE_WORDS)), reason("paraphrase_en", "citation", "path"), own))
        .unionByName(rows(zh, "cross_language_zh", F.format_string(CROSS_LANGUAGE, F.array_join(F.slice(zh_concepts(F.col("title")), 1, CONCEPTS), "、")), reason("cross_language_zh", "citation", "path", "title"), own, language="zh"))
        .unionByName(rows(pairs, "multi_concept", F.format_string(MULTI_CONCEPT, "l.title", "r.title"), reason("multi_concept", "l.citation", "l.path", "r.citation", "r.path"), F.array("l.document_id", "r.document_id")))
        .unionByName(rows(next_to, "adjacent_context", F.format_string(ADJACENT, "title", _first_words(content, ADJACENT_WORDS)), reason("adjacent_context", "next_id", "chunk_id", "citation", "path"), own, F.array("next_id")))
    )


def curated_cases(curated: DataFrame, documents: DataFrame, snapshot: str | None = None) -> DataFrame:
    """Cases, held out, of curated rows (case_id, language, query, kind, citations, rationale, source_snapshot), with an error: repeated, language (or not the kind's), query (blank, a zero character, more than QUERY_BYTES), kind, rationale, snapshot, or that of the citations."""
    named = evals.resolve_curated(curated.dropDuplicates(["case_id"]).select("case_id", "citations"), documents)
    repeated = curated.groupBy("case_id").agg((F.count(F.lit(1)) > 1).alias("__repeated"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    wrong_kind = no(F.col("kind").isin(*POSITIVES))
    language = no(F.col("language").isin("en", "zh")) | ((F.col("kind") == "cross_language_zh") & (F.col("language") != "zh")) | ((F.col("kind") == "paraphrase_en") & (F.col("language") != "en"))
    query = no(F.trim("query") != "") | F.contains("query", F.lit("\0")) | (F.octet_length("query") > QUERY_BYTES)
    error = F.when(F.col("__repeated"), "repeated").when(wrong_kind, "kind").when(language, "language").when(query, "query").when(~_filled("rationale"), "rationale")
    if snapshot is not None:
        error = error.when(no(F.col("source_snapshot") == snapshot), "snapshot")
    rows = curated.where("case_id is not null").join(repeated, "case_id").join(named.withColumnRenamed("error", "__cited"), "case_id")
    return rows.select(
        "case_id", F.lit("holdout").alias("split"), "language", "query", F.col("documents").alias("relevant_document_ids"), F.expr(_NONE).alias("relevant_chunk_ids"), "kind",
        F.concat(F.lit(CURATED_REASON), "rationale").alias("rationale"), error.otherwise(F.col("__cited")).alias("error"),
    )


def composition_errors(cases: DataFrame, sizes: dict[str, int] | None = None, least: int = LEAST) -> DataFrame:
    """error and of (a kind, split or case): too few of a kind (few), fewer than least in all (few, all), a split without cases (split), a kind in another language (language), a case id that is there twice, or null (repeated)."""
    sizes = POSITIVES | NEGATIVES if sizes is None else sizes
    spark = cases.sparkSession
    other = ((F.col("kind") == "cross_language_zh") & ~F.col("language").eqNullSafe("zh")) | ((F.col("kind") == "paraphrase_en") & ~F.col("language").eqNullSafe("en"))
    kinds = cases.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(other).alias("other"))
    wanted = spark.createDataFrame(list(sizes.items()), "kind string, wanted bigint").join(kinds, "kind", "left")
    all_cases = cases.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("split") == s).alias(s) for s in ("development", "holdout")))
    few = wanted.where(F.coalesce("n", F.lit(0)) < F.col("wanted")).select(F.lit("few").alias("error"), F.col("kind").alias("of"))
    return (
        few.unionByName(wanted.where("other > 0").select(F.lit("language").alias("error"), F.col("kind").alias("of")))
        .unionByName(all_cases.where(F.col("n") < least).select(F.lit("few").alias("error"), F.lit("all").alias("of")))
        .unionByName(all_cases.select(F.explode(F.array(*(F.when(F.col(s) == 0, s) for s in ("development", "holdout")))).alias("of")).where("of is not null").select(F.lit("split").alias("error"), "of"))
        .unionByName(cases.groupBy("case_id").count().where("count > 1 or case_id is null").select(F.lit("repeated").alias("error"), F.col("case_id").alias("of")))
    )


def label_errors(cases: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, label and error of labels that the index doesn't have (document, chunk), and of chunks of a document that isn't among the case's own, where it has any (owner)."""
    docs = cases.select("case_id", F.explode("relevant_document_ids").alias("label"))
    unknown = docs.join(documents.select(F.col("document_id").alias("label")), "label", "left_anti").select("case_id", "label", F.lit("document").alias("error"))
    parts = cases.select("case_id", "relevant_document_ids", F.explode("relevant_chunk_ids").alias("label"))
    owners = chunks.select(F.col("chunk_id").alias("label"), F.col("document_id").alias("owner"))
    lost = parts.join(owners, "label", "left_anti").select("case_id", "label", F.lit("chunk").alias("error"))
    other = parts.join(owners, "label").where((F.size("relevant_document_ids") > 0) & ~F.coalesce(F.array_contains("relevant_document_ids", F.col("owner")), F.lit(False)))
    return unknown.unionByName(lost).unionByName(other.select("case_id", "label", F.lit("owner").alias("error")))


def generate(documents: DataFrame, chunks: DataFrame, negatives: DataFrame, curated: DataFrame | None = None, sizes: dict[str, int] | None = None, least: int = LEAST, salt: str = "eval-v2:", snapshot: str | None = None) -> DataFrame:
    """All cases as a stored table; an index or lists that can't give them as asked for are an error. negatives: cases without labels, as many of each of their two kinds as sizes says."""
    sizes = POSITIVES | NEGATIVES if sizes is None else sizes
    kinds = negatives.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.size("relevant_document_ids") > 0) | (F.size("relevant_chunk_ids") > 0)).alias("labelled"))
    wanted = negatives.sparkSession.createDataFrame([(k, sizes[k]) for k in NEGATIVES], "kind string, wanted bigint")
    assert_none(wanted.join(kinds, "kind", "full").where("wanted is null or coalesce(n, 0) <> wanted or labelled > 0").select("kind"), "the cases without an answer are wrong")
    cases = positives(documents, chunks, sizes, salt)
    if curated is not None:
        own = curated_cases(curated, documents, snapshot)
        assert_none(own.where("error is not null").select("case_id", "error"), "a curated case is wrong")
        cases = cases.unionByName(own.select(*_CASE))
    cases = stored(cases.unionByName(negatives.select(*_CASE)), "cases")
    assert_none(composition_errors(cases, sizes, least), "the cases aren't composed as asked for")
    assert_none(label_errors(cases, documents, chunks), "a case's label is wrong")
    return cases
