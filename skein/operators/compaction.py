"""Compaction of conversations, stage by stage, until each one is within its threshold.

Rows are blocks: key, message and block (their places), role, type (text, tool_use, tool_result), text, id, name, arguments (JSON), tool_call_id and content. All stages are windows over one partitioning by key: a conversation that is within the
threshold after a stage is left alone by the next ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT_NOTE = "...[truncated by tool_result_budget]"  # fixed: what follows a result that was cut
STAGES = ("tool_result_budget", "snip_old_results", "strip_marked", "collapse_adjacent")


def _size(c: str | Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")


def block_bytes() -> Column:
    """A block's bytes, with 64 for a call's arguments."""
    return F.when(F.col("type") == "text", _size("text")).when(F.col("type") == "tool_use", _size("id") + _size("name") + 64).otherwise(_size("tool_call_id") + _size("content"))


def value_bytes(value: str) -> Column:
    """Bytes of a column of variants as it is sent: strings with their escapes (6 for a control character), 32 for any other scalar, 2 for each list and object, and 1 and 2 for each of their entries."""
    plain = F.to_json(F.col(value))  # escapes only what JSON asks for
    string = r'"(?:[^"\\]|\\.)*"'
    bare = F.regexp_replace(plain, string, '"')
    inside = F.array_join(F.regexp_extract_all(plain, F.lit(string), 0), "")
    short = F.regexp_count(F.regexp_replace(inside, r"\\\\", ""), F.lit(r"\\[bfnrt]"))  # written with two bytes
    count = lambda pattern: F.regexp_count(bare, F.lit(pattern)).cast("bigint")
    members, strings, scalars, holders = count(":"), count('"'), count(r"-?[0-9][0-9.eE+-]*|true|false|null"), count(r"[\[{]")
    values = strings - members + scalars + holders
    total = _size(inside) + 4 * short + 32 * scalars + 2 * holders + 2 * members + (values - 1 - members)
    return total


def context_bytes(blocks: DataFrame, key: str = "conv_id", system_prompt: str = "", user_text: str = "") -> DataFrame:
    """key and bytes: what a conversation's blocks take in a request, with the prompt and the new text. Arguments that aren't JSON count as none."""
    rows = blocks.withColumn("__v", F.try_parse_json("arguments"))
    use = _size("id") + _size("name") + F.coalesce(value_bytes("__v"), F.lit(0))
    size = F.when(F.col("type") == "text", _size("text")).when(F.col("type") == "tool_use", use).otherwise(_size("tool_call_id") + _size("content"))
    return rows.groupBy(key).agg((F.sum(size) + len(system_prompt.encode()) + len(user_text.encode())).cast("bigint").alias("bytes"))


def cut_bytes(c: str, most: int) -> Column:
    """The longest beginning of whole characters within so many bytes."""
    raw = F.col(c).cast("binary")
    return F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, max(0, most - k)).cast("string")) for k in range(4)))


def strip_marked(text: Column, marker: str) -> Column:
    """The text without what stands from each marker to the next one, both included; one without a next goes on to the end."""
    m = re.escape(marker)
    return F.regexp_replace(text, rf"(?s){m}.*?(?:{m}|\z)", "")


def compact(blocks: DataFrame, threshold: int, most_result_bytes: int, marker: str = "<think>", key: str = "conv_id") -> DataFrame:
    """blocks after the stages that each conversation needs, with stage: how many of STAGES it went through.

    Results longer than most_result_bytes are cut; the oldest results go until the others are within the threshold, but for the last; marked spans go if there is more of them than the threshold; neighbouring messages of one role become one
    (message is then the first one's place, and blocks are numbered anew). A threshold of 0 leaves old results.
    """
    own = Window.partitionBy(key)
    order = own.orderBy("message", "block")
    result, text = F.col("type") == "tool_result", F.col("type") == "text"
    rows = blocks.withColumn("stage", F.lit(1))

    def measured(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bytes", F.sum(block_bytes()).over(own)).withColumn("__open", F.col("__bytes") > threshold)

    long = result & (_size("content") > most_result_bytes)
    rows = measured(rows.withColumn("content", F.when(long, F.concat(cut_bytes("content", most_result_bytes), F.lit(CUT_NOTE))).otherwise(F.col("content"))))

    size = F.when(result, _size("content")).otherwise(0)
    rows = rows.withColumns({
        "stage": F.when(F.col("__open"), 2).otherwise(F.col("stage")), "__left": F.sum(size).over(own) - F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__last": F.max(F.when(result, F.struct("message", "block"))).over(own) == F.struct("message", "block"),
    })
    goes = F.col("__open") & result & ~F.coalesce("__last", F.lit(False)) & (F.col("__left") > threshold) & F.lit(threshold > 0)
    rows = measured(rows.where(~goes))

    after = F.when(text & (F.instr("text", F.lit(marker)) > 0), _size("text") - _size(F.substring_index("text", marker, 1))).otherwise(0)
    rows = rows.withColumns({"stage": F.when(F.col("__open"), 3).otherwise(F.col("stage")), "__marked": F.sum(after).over(own)})
    strips = F.col("__open") & text & (F.col("__marked") > threshold) & (F.col("__marked") > 0)
    rows = measured(rows.withColumn("text", F.when(strips, strip_marked(F.col("text"), marker)).otherwise(F.col("text"))))

    rows = rows.withColumn("stage", F.when(F.col("__open"), 4).otherwise(F.col("stage")))
    new = F.coalesce((F.lag("role").over(order) != F.col("role")) | (~F.col("__open") & (F.lag("message").over(order) != F.col("message"))), F.lit(True))
    rows = rows.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order))
    run = Window.partitionBy(key, "__run")
    rows = rows.withColumns({"__first": F.min("message").over(run), "__at": F.row_number().over(run.orderBy("message", "block")) - 1})
    merged = F.col("__open")
    rows = rows.withColumns({"message": F.when(merged, F.col("__first")).otherwise(F.col("message")), "block": F.when(merged, F.col("__at")).otherwise(F.col("block"))})
    return rows.select(*blocks.columns, "stage")
