"""Retrieval quality: scores of ranked results, means, thresholds and gates."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.order import running
from skein.sources.shared import stored


def hash_slices(rows: DataFrame, key: str, salt: str, slices: list[tuple[str, int]]) -> DataFrame:
    """The first rows by sha256(salt + key), in slices of the given names and sizes. Only as many rows as asked for reach the numbering."""
    ends = list(accumulate(n for _, n in slices))
    first = rows.withColumn("__order", F.sha2(F.concat(F.lit(salt), F.col(key)), 256)).orderBy("__order", key).limit(ends[-1])
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("__order", key)))
    kind = F.lit(slices[-1][0])
    for (name, _), end in reversed(list(zip(slices[:-1], ends[:-1], strict=True))):
        kind = F.when(F.col("place") <= end, name).otherwise(kind)
    return placed.select(key, kind.alias("kind"), "place")


def score_cases(ranked: DataFrame, relevant: DataFrame, case: str = "case_id", item: str = "item_id") -> DataFrame:
    """recall_at_5, recall_at_10, reciprocal_rank and ndcg_at_10 for each case of `relevant` (case, item), from ranked (case, rank, item).

    An item counts at its first rank. A case without relevant items has null as item: it is scored by no_answer_false_positive, whether anything was returned.
    """
    first = ranked.groupBy(case, item).agg(F.min("rank").alias("rank"))
    wanted = relevant.where(F.col(item).isNotNull()).distinct()
    hits = wanted.join(first, [case, item], "left").groupBy(case).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("rank") <= 5).alias("h5"),
        F.count_if(F.col("rank") <= 10).alias("h10"),
        F.min("rank").alias("best"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    cases, answered = relevant.select(case).distinct(), ranked.select(case).distinct().withColumn("answered", F.lit(True))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    rows = cases.join(hits, case, "left").join(answered, case, "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("n"), F.lit(0.0))
    return rows.select(
        case,
        share("h5").alias("recall_at_5"),
        share("h10").alias("recall_at_10"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("gain") / ideal, F.lit(0.0)).alias("ndcg_at_10"),
        (F.col("n").isNull() & F.coalesce("answered", F.lit(False))).alias("no_answer_false_positive"),
        F.col("n").isNotNull().alias("positive"),
    )


def mean_metrics(scores: DataFrame, split: str = "split") -> DataFrame:
    """Means by split and over all (split null): metrics over positive cases, the false-positive rate over the others; 0 where there are none."""
    mean = lambda c, over: F.coalesce(F.avg(F.when(over, F.col(c).cast("double"))), F.lit(0.0))
    yes = F.col("positive")
    return scores.rollup(split).agg(
        F.count_if(yes).alias("positives"),
        *(mean(c, yes).alias(c) for c in ("recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_10")),
        mean("no_answer_false_positive", ~yes).alias("false_positive_rate"),
    )


def fit_threshold(scored: DataFrame, most_false: float = 0.05) -> DataFrame:
    """threshold, recall, false_positive_rate over rows (score, positive): of the scores at which the rate of others accepted is no more than most_false, that with the largest recall, then the largest score."""
    by_score = scored.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    sums = running(by_score, [F.desc("score")], {"p_so_far": F.col("p"), "q_so_far": F.col("q")})
    rates = sums.join(F.broadcast(by_score.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")))).select(
        F.col("score").alias("threshold"),
        F.coalesce(F.try_divide("p_so_far", "all_p"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide("q_so_far", "all_q"), F.lit(0.0)).alias("false_positive_rate"),
    )
    return rates.where(F.col("false_positive_rate") <= most_false).orderBy(F.desc("recall"), F.desc("threshold")).limit(1)


def quality_gate(modes: DataFrame, least_recall: float = 0.5, least_rr: float = 0.45, most_false: float = 0.05) -> DataFrame:
    """One row: does hybrid reach the better of lexical and dense in recall and rank, and beat it in one, within the floors."""
    of = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    wide = modes.agg(*(of(m, c).alias(f"{m}_{c}") for m in ("lexical", "dense", "hybrid") for c in ("recall_at_5", "reciprocal_rank", "false_positive_rate")))
    best = lambda c: F.greatest(f"lexical_{c}", f"dense_{c}")
    no_worse = (F.col("hybrid_recall_at_5") >= best("recall_at_5")) & (F.col("hybrid_reciprocal_rank") >= best("reciprocal_rank"))
    better = (F.col("hybrid_recall_at_5") > best("recall_at_5")) | (F.col("hybrid_reciprocal_rank") > best("reciprocal_rank"))
    floors = (F.col("hybrid_recall_at_5") >= least_recall) & (F.col("hybrid_reciprocal_rank") >= least_rr) & (F.col("hybrid_false_positive_rate") <= most_false)
    return wide.select(no_worse.alias("no_worse"), better.alias("better"), floors.alias("floors"), (no_worse & better & floors).alias("passed"))


def split_parity(order: Column) -> Column:
    """Odd serials are for development, even ones held out."""
    return F.when(order % 2 == 1, "development").otherwise("holdout")


def best_mode(modes: DataFrame, least_recall: float = 0.5, least_rr: float = 0.45, most_false: float = 0.05) -> DataFrame:
    """One row with the mode chosen on development, or none: of dense and hybrid those that hold the floors, the best by recall_at_5, reciprocal_rank, ndcg_at_10, the smaller false-positive rate, and then hybrid before dense."""
    floors = (F.col("recall_at_5") >= least_recall) & (F.col("reciprocal_rank") >= least_rr) & (F.col("false_positive_rate") <= most_false)
    key = F.struct("recall_at_5", "reciprocal_rank", "ndcg_at_10", (-F.col("false_positive_rate")).alias("f"), (F.col("mode") == "hybrid").alias("h"))
    return modes.where(F.col("mode").isin("dense", "hybrid") & floors).agg(F.max_by("mode", key).alias("mode")).where("mode is not null")


def holds_against_lexical(chosen: DataFrame, holdout: DataFrame) -> DataFrame:
    """mode and accepted: whether the chosen mode is no worse than lexical on the rows held out, in recall_at_5 and reciprocal_rank."""
    lexical = holdout.where("mode = 'lexical'").select(F.col("recall_at_5").alias("lr"), F.col("reciprocal_rank").alias("lm"))
    own = chosen.join(holdout, "mode")
    return own.join(F.broadcast(lexical)).select("mode", ((F.col("recall_at_5") >= F.col("lr")) & (F.col("reciprocal_rank") >= F.col("lm"))).alias("accepted"))


def evaluate_cases(results: DataFrame, cases: DataFrame, relevant: DataFrame, most_false: float = 0.05) -> DataFrame:
    """Means by split of ranked results (case_id, item_id, rank, score) of cases (case_id, split, exact) under the threshold that is fitted on development: split, positives, recall_at_5, recall_at_10, reciprocal_rank, ndcg_at_10, false_positive_rate, threshold.

    A case's best score counts as positive in the fit if it has relevant items. Cases with exact citations pass the threshold whatever their score, and don't take part in the fit. relevant: (case_id, item_id), null items for cases without any.
    """
    results = stored(results, "results")  # read three times; results may be a union, whose sides Spark 4.1 takes to be partitioned alike before a join and, planned again at run time, as one behind the other
    best = results.groupBy("case_id").agg(F.max("score").alias("score"))
    positive = relevant.groupBy("case_id").agg((F.count("item_id") > 0).alias("positive"))
    fitting = cases.where("split = 'development' and not exact").join(best, "case_id").join(positive, "case_id").select("score", "positive")
    limit = fit_threshold(fitting, most_false).select("threshold")  # one row, or none
    limit = cases.sparkSession.range(1).select(F.lit(1).alias("one")).join(F.broadcast(limit), F.lit(True), "left").select("threshold")
    kept = cases.select("case_id", "exact").join(best, "case_id").join(F.broadcast(limit)).where(F.col("exact") | F.col("threshold").isNull() | (F.col("score") >= F.col("threshold"))).select("case_id")
    scores = score_cases(results.join(kept, "case_id", "left_semi"), relevant).join(cases.select("case_id", "split"), "case_id")
    return mean_metrics(scores).join(F.broadcast(limit))


def case_errors(cases: DataFrame) -> DataFrame:
    """case_id and error of cases (case_id, split, language, kind, query, relevant_document_ids): repeated ids, unknown splits, blank or long queries, labels on cases without an answer, or none on others."""
    empty = F.coalesce(F.size("relevant_document_ids"), F.lit(0)) <= 0
    negative = F.col("kind").isin("no_answer", "hostile_query")
    own = F.when(~F.coalesce(F.col("split").isin("development", "holdout"), F.lit(False)), "split").when((F.coalesce(F.trim("query"), F.lit("")) == "") | (F.octet_length("query") > 16_384), "query").when(negative & ~empty, "labelled").when(~negative & empty, "unlabelled")
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("repeated").alias("error"))
    return cases.select("case_id", own.alias("error")).where("error is not null").unionByName(twice)


def negative_composition(cases: DataFrame, each: int = 25) -> DataFrame:
    """kind, n, unlabelled and ok for the two kinds of cases without an answer: each has so many, none of them labelled. A kind without cases has no row, and isn't ok."""
    rows = cases.where(F.col("kind").isin("no_answer", "hostile_query")).groupBy("kind")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.size("relevant_document_ids"), F.lit(0)) <= 0).alias("unlabelled")).select("kind", "n", "unlabelled", ((F.col("n") == each) & (F.col("unlabelled") == each)).alias("ok"))


def resolve_curated(curated: DataFrame, documents: DataFrame, most: int = 4) -> DataFrame:
    """case_id, documents (of its citations, in order) and error: no citation or more than `most`, one twice, or one that no document has. curated: (case_id, citations)."""
    named = curated.select("case_id", F.posexplode_outer(F.transform("citations", lambda c: F.lower(F.trim(c)))).alias("place", "citation"))
    known = documents.groupBy(F.lower(F.trim("citation")).alias("citation")).agg(F.min("document_id").alias("document_id"))
    rows = named.join(known, "citation", "left").groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "document_id"))), lambda x: x["document_id"]).alias("documents"),
        F.count("citation").alias("n"), F.countDistinct("citation").alias("different"), F.count("document_id").alias("found"),
    )
    error = F.when(~F.col("n").between(1, most), "count").when(F.col("different") < F.col("n"), "repeated").when(F.col("found") < F.col("n"), "missing")
    return rows.select("case_id", F.when(error.isNull(), F.col("documents")).alias("documents"), error.alias("error"))


def label_inventory(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, and whether both are there and each chunk belongs to one document only."""
    owners = chunks.groupBy("chunk_id").agg(F.countDistinct("document_id").alias("owners"))
    return chunks.agg(F.countDistinct("document_id").alias("documents")).join(F.broadcast(owners.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.max("owners"), F.lit(0)).alias("most")))).select("documents", "chunks", ((F.col("documents") > 0) & (F.col("most") == 1)).alias("sound"))
