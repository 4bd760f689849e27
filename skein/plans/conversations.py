"""Conversations and their compaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import compaction, conversation, memories, messages
from skein.plans.registry import query


@query("history_valid", "WITH x AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE NOT (role = 'system' AND turn = 0)) SELECT conv_id, bool_and(role = CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0 AS valid FROM x GROUP BY conv_id")
def _(read, spark):
    return conversation.alternates(read("conversations"))


@query("message_bytes", "SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n FROM conversations GROUP BY conv_id")
def _(read, spark):
    return read("conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"))


@query("session_compaction_plan", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
s AS (SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n_turns, max(CASE WHEN back > 4 THEN turn END) AS last FROM x GROUP BY conv_id)
SELECT conv_id, bytes, n_turns, bytes > 4000 AND n_turns > 4 AS compact, CASE WHEN bytes > 4000 AND n_turns > 4 THEN last END AS through FROM s
""")
def _(read, spark):
    return conversation.compaction_plan(read("conversations"), 4000, 4)


def conversation_blocks(read):
    """Conversations as blocks: what a system says is a tool's result, what a user says a text and a call with it as its argument, an answer a text with its first sentence marked."""
    turns = read("conversations").withColumn("text", F.coalesce("text", F.lit("")))
    null, said = F.lit(None).cast("string"), F.col("text")
    marked = F.when(F.instr(said, ".") > 0, F.concat(F.lit("<think>"), F.regexp_replace(said, r"(?s)\A([^.]*)\.", "$1<think>"))).otherwise(said)
    block = lambda kind, at=0, text=null, arguments=null, content=null: F.struct(F.lit(kind).alias("type"), F.lit(at).alias("block"), text.alias("text"), arguments.alias("arguments"), content.alias("content"))
    blocks = F.when(F.col("role") == "system", F.array(block("tool_result", content=said))).when(F.col("role") == "user", F.array(block("text", text=said), block("tool_use", 1, arguments=F.to_json(F.struct(said.alias("q")))))).otherwise(F.array(block("text", text=marked)))
    rows = turns.select("conv_id", F.col("turn").alias("message"), "role", F.explode(blocks).alias("b")).select("conv_id", "message", "role", "b.*")
    return rows.withColumns({"id": F.when(F.col("type") == "tool_use", "c"), "name": F.when(F.col("type") == "tool_use", "find"), "tool_call_id": F.when(F.col("type") == "tool_result", "c")})


@query("context_bytes", """
WITH t AS (SELECT conv_id, role, strlen(text) AS size, contains(text, '.') AS dot, length(regexp_replace(text, '[^"\\\\]', '', 'g')) + 5 * length(regexp_replace(text, '[^\x01-\x1F]', '', 'g')) AS escapes FROM conversations)
SELECT conv_id, CAST(9 + sum(CASE role WHEN 'system' THEN 1 + size WHEN 'user' THEN size + 5 + 2 + 2 + 3 + 2 + size + escapes ELSE size + CASE WHEN dot THEN 13 ELSE 0 END END) AS BIGINT) AS bytes FROM t GROUP BY conv_id
""")
def _(read, spark):
    """What each conversation takes in a request, with a prompt and a new text."""
    return compaction.context_bytes(conversation_blocks(read), system_prompt="system", user_text="new")


@query("compaction_chain")
def _(read, spark):
    """Conversations through the stages that they need: how many, and the blocks and bytes that are left."""
    rows = compaction.compact(conversation_blocks(read).withColumn("message", F.col("message").cast("int")), 2000, 300)
    return rows.groupBy("conv_id").agg(F.max("stage").alias("stage"), F.count(F.lit(1)).alias("blocks"), F.countDistinct("message").alias("messages"), F.sum(compaction.block_bytes()).alias("bytes"))


@query("compaction_stages", """
WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END AS role, text FROM conversations), f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM x),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, min(turn) AS first_turn, any_value(role) AS role, sha256(string_agg(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' [truncated]' ELSE text END, chr(10) ORDER BY turn)) AS text_sha256 FROM r GROUP BY conv_id, run
""")
def _(read, spark):
    """Long texts are cut, then neighbouring turns of one role become one."""
    turns = read("conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, "user").otherwise(F.col("role"))).withColumn("text", conversation.truncate_text(F.col("text"), 500))
    return conversation.collapse_roles(turns).select("conv_id", "first_turn", "role", F.sha2("text", 256).alias("text_sha256"))


@query("concat_text", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256 FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(read, spark):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return read("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["text"]), ""), 256).alias("text_sha256"))


def message_parts(read):
    """Each turn as a streamed message: a text in deltas of forty characters, a tool's input in two for user turns, and usage. Every seventh conversation's turn 1 has no stop, turn 2 a delta of another block; turn 3 of all comes twice."""
    turns = read("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws("-", "conv_id", "turn").alias("message_id"))
    odd = F.col("conv_id") % 7 == 0
    pieces = F.expr("transform(sequence(0, cast((length(text) - 1) / 40 as int)), i -> substring(text, i * 40 + 1, 40))")
    whole = lambda c: F.to_json(F.struct(c.alias("t")))
    quoted = lambda c: F.substr(whole(c), F.lit(6), F.length(whole(c)) - 6)
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    index = F.when(odd & (F.col("turn") == 2), "5").otherwise("0")
    deltas = F.transform(pieces, lambda x: said('{"type": "content_block_delta", "index": ', index, ', "delta": {"type": "text_delta", "text": ', quoted(x), "}}"))
    tool = F.when(F.col("role") == "user", F.array(
        F.lit('{"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "c", "name": "find", "input": {}}}'), F.lit('{"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "{\\"n\\": "}}'),
        said('{"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "', F.length("text").cast("string"), '}"}}'), F.lit('{"type": "content_block_stop", "index": 1}'),
    )).otherwise(F.array().cast("array<string>"))
    reason = F.when(F.col("role") == "user", "tool_use").otherwise("end_turn")
    first = F.array(
        F.lit('{"type": "message_start", "message": {"id": "m", "type": "message", "role": "assistant", "content": [], "stop_reason": null, "usage": {"input_tokens": 3, "output_tokens": 1}}}'), F.lit('{"type": "ping"}'),
        F.lit('{"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}}'),
    )
    ends = F.array(said('{"type": "message_delta", "delta": {"stop_reason": "', reason, '"}, "usage": {"output_tokens": ', (F.length("text") + 1).cast("string"), "}}"))
    stop = F.when(odd & (F.col("turn") == 1), F.array().cast("array<string>")).otherwise(F.array(F.lit('{"type": "message_stop"}')))
    rows = turns.select("message_id", "turn", F.posexplode(F.concat(first, deltas, F.array(F.lit('{"type": "content_block_stop", "index": 0}')), tool, ends, stop)).alias("sequence", "data"))
    rows = rows.withColumn("sequence", (F.col("sequence") + 1).cast("bigint"))
    return rows.unionByName(rows.where("turn = 3")).select("message_id", "sequence", "data")


_WRONG = "conv_id % 7 = 0 AND turn = 2"


@query("stream_assemble", f"""
SELECT conv_id || '-' || turn AS message_id, CASE WHEN error IS NULL THEN sha256(text) END AS text_sha256, CASE WHEN error IS NULL THEN CASE WHEN role = 'user' THEN 2 ELSE 1 END END AS blocks, CASE WHEN error IS NULL OR error = 'incomplete' THEN CASE WHEN role = 'user' THEN 'tool_use' ELSE 'end_turn' END END AS stop_reason,
  CAST(CASE WHEN error = 'bad_part' THEN 1 ELSE length(text) + 1 END AS BIGINT) AS output_tokens, CAST(CASE WHEN error = 'bad_part' THEN 3 ELSE 6 + greatest(1, ceil(length(text) / 40)) + CASE WHEN role = 'user' THEN 4 ELSE 0 END - CASE WHEN error = 'incomplete' THEN 1 ELSE 0 END END AS BIGINT) AS parts, error
FROM (SELECT *, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'incomplete' WHEN {_WRONG} THEN 'bad_part' END AS error FROM conversations)
""")
def _(read, spark):
    """Every turn put together from its parts, with its usage and stop reason; parts that are wrong or missing are errors, repeated ones are not."""
    rows = messages.assemble(message_parts(read))
    blocks = F.size(F.from_json("blocks", "array<struct<type: string>>"))
    return rows.select("message_id", F.when(F.col("error").isNull(), F.sha2("text", 256)).alias("text_sha256"), F.when(F.col("error").isNull(), blocks).alias("blocks"), "stop_reason", "output_tokens", "parts", "error")


@query("turn_index_gap", "SELECT conv_id, turn, turn - coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) > 1 AS gap FROM conversations WHERE turn % 4 <> 2")
def _(read, spark):
    rows = read("conversations").where("turn % 4 <> 2")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", (F.col("turn") - F.coalesce(before, F.lit(-1)) > 1).alias("gap"))


@query("consolidation_batches")
def _(read, spark):
    return conversation.batches(read("conversations"), 4000, 4)


@query("checkpoint_skip", "SELECT conv_id, turn FROM conversations WHERE turn > conv_id % 4")
def _(read, spark):
    turns = read("conversations").select("conv_id", "turn")
    done = turns.groupBy("conv_id").agg((F.first("conv_id") % 4).alias("through"))
    return turns.join(done, "conv_id").where("turn > through").select("conv_id", "turn")


@query("maintenance_transcript", "SELECT conv_id, count(*) AS n, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript_sha256 FROM conversations WHERE turn > 1 AND turn <= 4 GROUP BY conv_id")
def _(read, spark):
    rows = read("conversations").where("turn > 1 AND turn <= 4")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), 256).alias("transcript_sha256"))


@query("commit_candidates", "SELECT DISTINCT text FROM conversations c WHERE role = 'user' AND strlen(text) <= 400 AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.role = 'assistant' AND o.text = c.text) AND turn > 0")
def _(read, spark):
    """Candidates within the size limit that aren't stored yet."""
    turns = read("conversations")
    new = turns.where("role = 'user' AND octet_length(text) <= 400 AND turn > 0").select("text").distinct()
    return new.join(turns.where("role = 'assistant'").select("text"), "text", "left_anti")


@query("memory_scope", "SELECT conv_id, turn FROM conversations WHERE conv_id % 3 = 0 OR conv_id % 3 = 1")
def _(read, spark):
    """Memories without a scope and those of the workspace."""
    scoped = read("conversations").withColumn("scope", F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 3 == 1, "/work").otherwise("/other"))
    return scoped.where((F.col("scope") == "") | (F.col("scope") == "/work")).select("conv_id", "turn")


@query("flatten_turns", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def _(read, spark):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.array("role").alias("messages"))))
    return read("conversations").groupBy("conv_id").agg(F.array_join(F.flatten(F.transform(turns, lambda x: x["messages"])), ",").alias("roles"))


@query("neighbor_semijoin", "SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 1 AND o.role = 'assistant')")
def _(read, spark):
    turns = read("conversations")
    return turns.select("conv_id", "turn").join(turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi")


@query("compaction_snip", "WITH r AS (SELECT conv_id, turn, strlen(text) AS bytes FROM conversations WHERE role = 'assistant'), x AS (SELECT *, sum(bytes) OVER (PARTITION BY conv_id) AS total, coalesce(sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(turn) OVER (PARTITION BY conv_id) AS last FROM r) SELECT conv_id, turn, turn = last OR total - before <= 600 AS kept FROM x")
def _(read, spark):
    """Answers stand for tool results: the oldest go until 600 bytes are left."""
    rows = read("conversations").where("role = 'assistant'").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("bytes"))
    return conversation.snip_oldest(rows, 600).select("conv_id", "turn", "kept")


_COMMIT_SQL = """
WITH c AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS place, CASE WHEN turn % 7 = 6 THEN 'other' WHEN turn % 2 = 0 THEN 'fact' ELSE 'decision' END AS category, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '/w' ELSE '/v' END AS scope, text AS content, turn AS turn_end FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id AS session_id, min(turn) - 1 + max(turn) // 4 AS through, CASE WHEN conv_id % 2 = 0 THEN '/w' END AS workspace FROM conversations GROUP BY conv_id),
e AS (SELECT DISTINCT text FROM conversations WHERE role = 'assistant'), g AS (SELECT DISTINCT text FROM conversations WHERE role NOT IN ('user', 'assistant')),
r AS (SELECT c.*, CASE WHEN turn_end <= through THEN 'done' WHEN trim(coalesce(content, '')) = '' OR strlen(content) > 4096 THEN 'unsafe' WHEN category = 'other' THEN 'category' WHEN scope <> '' AND workspace IS NOT NULL AND scope <> workspace THEN 'scope'
  WHEN content IN (SELECT text FROM g WHERE text IS NOT NULL) THEN 'forgotten' WHEN category = 'fact' AND scope = '' AND content IN (SELECT text FROM e WHERE text IS NOT NULL) THEN 'duplicate' END AS reason FROM c JOIN s USING (session_id))
SELECT session_id, place, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, category, scope, content ORDER BY place) = 1 THEN 'append' ELSE 'duplicate' END) AS outcome FROM r"""


@query("commit_outcomes", _COMMIT_SQL)
def _(read, spark):
    """All turns of users as candidates, the assistants' texts as entries, other roles' texts as forgotten ones. The test tables have no case of unsafe, forgotten or duplicate (the SQL has no rule for secrets); tests/test_memories.py has them."""
    turns = read("conversations")
    users = turns.where("role = 'user'").selectExpr("conv_id AS session_id", "conv_id * 1000 + turn AS place", "CASE WHEN turn % 7 = 6 THEN 'other' WHEN turn % 2 = 0 THEN 'fact' ELSE 'decision' END AS category", "CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '/w' ELSE '/v' END AS scope", "text AS content", "turn AS turn_end")
    sessions = turns.groupBy(F.col("conv_id").alias("session_id")).agg(F.expr("min(turn) - 1 + max(turn) div 4").alias("checkpoint")).withColumn("workspace", F.when(F.col("session_id") % 2 == 0, "/w"))
    entries = turns.where("role = 'assistant'").selectExpr("'fact' AS category", "'' AS scope", "text AS content")
    forgotten = turns.where("role NOT IN ('user', 'assistant')").selectExpr("text AS content")
    return memories.commit_outcomes(users, entries, sessions, forgotten).select("session_id", "place", "outcome")
