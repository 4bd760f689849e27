"""What becomes of candidates for a memory: which are appended, and why others aren't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import looks_sensitive

CATEGORIES = ("preference", "decision", "fact", "workflow", "constraint")
MOST_BYTES = 4096
_KEY = ["category", "scope", "content"]


def commit_outcomes(candidates: DataFrame, entries: DataFrame, sessions: DataFrame, forgotten: DataFrame) -> DataFrame:
    """candidates with outcome: done (turn_end isn't beyond the session's checkpoint), unsafe, category, scope (of another workspace), forgotten, duplicate, or append, the first that holds.

    candidates: session_id, place (unique, their order), category, scope, content, turn_end. entries: active ones' category, scope, content. sessions: session_id, once, checkpoint, workspace; without a row, or where null, 0 and unknown.
    forgotten: content. Null scopes are empty ones, which belong to every workspace. Of equal candidates that would be appended the first is, whichever session it comes from; the others are duplicates.
    """
    rows = candidates.withColumn("scope", F.coalesce("scope", F.lit("")))
    rows = rows.join(sessions.select("session_id", F.coalesce("checkpoint", F.lit(0)).alias("__through"), F.coalesce("workspace", F.lit("")).alias("__workspace")), "session_id", "left")
    rows = rows.join(forgotten.select("content").distinct().withColumn("__forgotten", F.lit(True)), "content", "left")
    rows = rows.join(entries.select("category", F.coalesce("scope", F.lit("")).alias("scope"), "content").distinct().withColumn("__there", F.lit(True)), _KEY, "left")
    content, workspace = F.coalesce("content", F.lit("")), F.coalesce("__workspace", F.lit(""))
    reason = (
        F.when(F.col("turn_end") <= F.coalesce("__through", F.lit(0)), "done")
        .when((F.trim(content) == "") | (F.octet_length(content) > MOST_BYTES) | looks_sensitive(content), "unsafe")
        .when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category")
        .when((F.col("scope") != "") & (workspace != "") & (F.col("scope") != workspace), "scope")
        .when(F.col("__forgotten"), "forgotten")
        .when(F.col("__there"), "duplicate")
    )
    rows = rows.withColumn("__reason", reason)
    first = rows.where("__reason is null").groupBy(*_KEY).agg(F.min("place").alias("__first"))
    out = rows.join(first, _KEY, "left")
    return out.select(*candidates.columns, F.coalesce("__reason", F.when(F.col("place") == F.col("__first"), "append").otherwise("duplicate")).alias("outcome"))
