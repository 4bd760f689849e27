"""Conversations: sizes, validity, compaction and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alternates(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key and valid: user and assistant take turns, from user to assistant; a leading system row is left out."""
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.where(~((F.col("role") == "system") & (F.col(order) == 0))).withColumn("place", F.row_number().over(w))
    wanted = F.when(F.col("place") % 2 == 1, "user").otherwise("assistant")
    return rows.groupBy(key).agg((F.bool_and(F.col("role") == wanted) & (F.count(F.lit(1)) % 2 == 0)).alias("valid"))


def compaction_plan(turns: DataFrame, threshold: int, retain: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, bytes, n_turns, compact, through: compact if the bytes are above the threshold and there are more turns than are retained; through is the last turn that goes."""
    rows = turns.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    sums = rows.groupBy(key).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n_turns"), F.max(F.when(F.col("back") > retain, F.col(order))).alias("last"))
    compact = (F.col("bytes") > threshold) & (F.col("n_turns") > retain)
    return sums.select(key, "bytes", "n_turns", compact.alias("compact"), F.when(compact, F.col("last")).alias("through"))


def collapse_roles(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Neighbouring turns of one role as one, their texts on lines of their own: gaps and islands. A run is part of one conversation."""
    w = Window.partitionBy(key).orderBy(order)
    runs = turns.withColumn("new", (F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True))).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run", "role").agg(F.min(order).alias("first_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))


def truncate_text(c, most: int, note: str = " [truncated]"):
    """Texts of more than `most` characters cut there, with a note."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(note))).otherwise(c)


def snip_oldest(results: DataFrame, threshold: int, key: str = "conv_id", order: str = "turn", size: str = "bytes") -> DataFrame:
    """results with kept: of a conversation's tool results the oldest go, one by one, until what is left is within the threshold; the last one stays in any case."""
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum(size).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(order).over(w) == F.col(order)
    return results.withColumn("kept", last | (F.sum(size).over(w) - before <= threshold))


def batches(turns: DataFrame, most_bytes: int = 32_768, most_turns: int = 32, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, batch, first, last, n, bytes: turns in order, a batch closed before it would pass a limit. A turn that is too large alone is a batch without turns, marked by n = 0."""
    schema = f"{key} bigint, batch int, first bigint, last bigint, n int, bytes bigint"

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []
        flush = lambda: held and (out.append((held[0][0], held[-1][0], len(held), sum(b for _, b in held))), held.clear())
        for turn, text in pdf.sort_values(order)[[order, "text"]].itertuples(index=False):
            size = len((text or "").encode())
            if size > most_bytes:
                flush()
                out.append((turn, turn, 0, size))
                continue
            if held and (len(held) >= most_turns or sum(b for _, b in held) + size > most_bytes):
                flush()
            held.append((turn, size))
        flush()
        return pd.DataFrame([(pdf[key].iloc[0], i, *x) for i, x in enumerate(out)], columns=[x.split()[0] for x in schema.split(", ")])

    return turns.select(key, order, "text").groupBy(key).applyInPandas(cut, schema)


def dispatch_runs(calls: DataFrame, key: str, order: str, safe: str, most: int) -> DataFrame:
    """calls with window_no: neighbouring safe calls share a window, `most` at a time; an unsafe one has its own."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.coalesce(~(F.col(safe) & F.lag(safe).over(w)), F.lit(True))
    runs = calls.withColumn("__run", F.sum(starts.cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)) - 1
    runs = runs.withColumn("__new", (place % most == 0).cast("int"))
    return runs.withColumn("window_no", F.sum("__new").over(w)).drop("__run", "__new")


def recall_score(memories: DataFrame, query: str, text: str = "text") -> DataFrame:
    """memories with score: distinct shared terms, and 100 more where the query stands in the text as it is. Rows that score nothing go."""
    from skein.functions.text import ascii_lower, memory_tokens

    shared = F.size(F.array_intersect(memory_tokens(F.col(text)), memory_tokens(F.lit(query))))
    whole = F.when(ascii_lower(F.col(text)).contains(query.translate({65 + i: 97 + i for i in range(26)})), 100).otherwise(0)
    return memories.withColumn("score", (shared + whole).cast("bigint")).where("score > 0")
