"""Session and memory logs as tables of events: what each event may follow is a window over its key, so that no log is held by one task as a whole, and the state is an aggregate of the events that hold.

Events come as columns, not as JSON (skein.sources.logs parses lines). Errors are rows (key, sequence, code); a log counts up to its first error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import normal_timestamp
from skein.operators.replay import Rejected


def history_ok(messages: Column) -> Column:
    """For array<struct<role, content: array<struct<type, id, tool_call_id>>>>: user and assistant take turns, from user to assistant; what a turn calls is answered, each once, by the next user turn, and nothing else is."""
    kinds = lambda i, name: F.transform(F.filter(F.get(messages, i)["content"], lambda b: b["type"] == name), lambda b: F.when(b["type"] == "tool_use", b["id"]).otherwise(b["tool_call_id"]))
    place = F.sequence(F.lit(0), F.greatest(F.size(messages) - 1, F.lit(0)))

    def sound(i: Column) -> Column:
        answers = F.when(i == 0, F.array().cast("array<string>")).otherwise(kinds(i - 1, "tool_use"))
        user = (F.array_sort(kinds(i, "tool_result")) == F.array_sort(answers)) & F.forall(F.get(messages, i)["content"], lambda b: b["type"].isin("text", "tool_result"))
        calls = kinds(i, "tool_use")
        assistant = (F.size(F.array_distinct(calls)) == F.size(calls)) & F.forall(F.get(messages, i)["content"], lambda b: b["type"].isin("text", "tool_use"))
        right_role = F.get(messages, i)["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")
        return right_role & (F.size(F.get(messages, i)["content"]) > 0) & F.when(i % 2 == 0, user).otherwise(assistant)

    last_open = F.size(kinds(F.size(messages) - 1, "tool_use")) > 0
    return F.coalesce((F.size(messages) % 2 == 0) & ((F.size(messages) == 0) | (F.forall(place, sound) & ~last_open)), F.lit(False))


def until_error(events: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Events before each key's first error, and that error."""
    first = events.where("error is not null").groupBy(key).agg(F.min_by(F.struct("sequence", "error"), "sequence").alias("e")).select(key, F.col("e.sequence").alias("at"), F.col("e.error").alias("error"))
    return events.drop("error").join(first.select(key, "at"), key, "left").where("at is null or sequence < at").drop("at"), first


def session_errors(events: DataFrame) -> DataFrame:
    """events (session_id, sequence, timestamp, kind, turn_index, task_id, through_turn, history_ok) with error, null for one that may follow those before it.

    kind: session_started, session_turn_started, session_turn_committed, session_turn_failed, session_compacted. Turns are numbered without a gap; compaction goes through a committed turn that isn't the last one. An event is judged as if those before it were sound; only the first error of a session has a meaning.
    """
    order = Window.partitionBy("session_id").orderBy("sequence")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    kind, turn = F.col("kind"), F.col("kind").isin("session_turn_started", "session_turn_committed", "session_turn_failed")
    last = F.last(F.when(turn, F.struct("kind", "turn_index", "task_id")), ignorenulls=True).over(so_far)
    committed = events.where("kind = 'session_turn_committed'").groupBy("session_id", F.col("turn_index").alias("through_turn")).agg(F.min("sequence").alias("__done"))
    rows = events.join(committed, ["session_id", "through_turn"], "left").withColumns({
        "__place": F.row_number().over(order),
        "__last": last,
        "__most": F.max(F.when(kind == "session_turn_started", F.col("turn_index"))).over(so_far),
        "__compacted": F.max(F.when(kind == "session_compacted", F.col("through_turn"))).over(so_far),
        "__last_committed": F.max(F.when(kind == "session_turn_committed", F.col("turn_index"))).over(so_far),
    })
    pending = F.coalesce(F.col("__last.kind") == "session_turn_started", F.lit(False))
    same = (F.col("__last.turn_index") == F.col("turn_index")) & F.col("__last.task_id").eqNullSafe(F.col("task_id"))
    compacts = ~pending & (F.col("__done") < F.col("sequence")) & (F.col("through_turn") < F.col("__last_committed")) & (F.col("through_turn") > F.coalesce("__compacted", F.lit(0)))
    error = (
        F.when(F.col("sequence") != F.col("__place"), "bad_sequence")
        .when((F.col("__place") == 1) & (kind != "session_started"), "not_started")
        .when((F.col("__place") > 1) & (kind == "session_started"), "already_started")
        .when((kind == "session_turn_started") & (pending | ~F.coalesce(F.col("turn_index") == F.coalesce("__most", F.lit(0)) + 1, F.lit(False))), "turn_order")
        .when(kind.isin("session_turn_committed", "session_turn_failed") & ~F.coalesce(pending & same, F.lit(False)), "no_pending_turn")
        .when((kind == "session_turn_committed") & ~F.coalesce("history_ok", F.lit(False)), "bad_history")
        .when((kind == "session_compacted") & ~F.coalesce(compacts, F.lit(False)), "nothing_to_compact")
        .when(~turn & ~kind.isin("session_started", "session_compacted"), "unknown_event")
    )
    return rows.withColumn("error", error).drop("__place", "__last", "__most", "__compacted", "__done", "__last_committed")


def replay_sessions(events: DataFrame) -> DataFrame:
    """A row for each session: last_turn, pending (the turn that is open), turns (committed and not compacted), compacted_through, last_sequence, last_timestamp and error. With an error, the state is that before it."""
    held, errors = until_error(session_errors(events), "session_id")
    kind = F.col("kind")
    last = F.max_by(F.when(kind.isin("session_turn_started", "session_turn_committed", "session_turn_failed"), F.struct("kind", "turn_index")), F.when(kind != "session_started", F.when(kind != "session_compacted", F.col("sequence"))))
    state = held.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(kind == "session_turn_started", F.col("turn_index"))), F.lit(0)).alias("last_turn"),
        last.alias("last"),
        F.array_sort(F.collect_set(F.when(kind == "session_turn_committed", F.col("turn_index")))).alias("committed"),
        F.coalesce(F.max(F.when(kind == "session_compacted", F.col("through_turn"))), F.lit(0)).alias("compacted_through"),
        F.max("sequence").alias("last_sequence"),
        F.max_by("timestamp", "sequence").alias("last_timestamp"),
    )
    out = state.join(errors.select("session_id", "error"), "session_id", "full_outer")
    turns = F.size(F.filter("committed", lambda t: t > F.col("compacted_through")))
    return out.select("session_id", "last_turn", F.when(F.col("last.kind") == "session_turn_started", F.col("last.turn_index")).alias("pending"), turns.alias("turns"), "compacted_through", "last_sequence", "last_timestamp", "error")


def list_sessions(states: DataFrame) -> DataFrame:
    """Sessions by their last timestamp, the latest first, then by id, as place from 1. A session with an error fails the whole list."""
    from skein.operators.checks import assert_none
    from skein.operators.order import numbered

    assert_none(states.where("error is not null").select("session_id", "error"), "a session's log is broken")
    return numbered(states, [F.desc(normal_timestamp(F.col("last_timestamp"))), F.col("session_id")], "place")


def memory_errors(events: DataFrame) -> DataFrame:
    """events (sequence, timestamp, kind, memory_id, content, fixed, created_at, updated_at, session_id, through_turn) of the one memory log with error, null for one that may follow those before it.

    kind: memory_upserted, memory_forgotten, memory_checkpointed. fixed: what an entry may never change. Numbers and times are judged against the event before, found by its number; entries and checkpoints by their own key.
    """
    own = Window.partitionBy("memory_id").orderBy("sequence")
    session = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    before = events.select((F.col("sequence") + 1).alias("sequence"), normal_timestamp(F.col("timestamp")).alias("__before")).groupBy("sequence").agg(F.max("__before").alias("__before"), F.count(F.lit(1)).alias("__n"))
    entry, kind = F.col("kind").isin("memory_upserted", "memory_forgotten"), F.col("kind")
    entries = events.where(entry).withColumn("__old", F.lag(F.struct("kind", "content", "fixed", "updated_at")).over(own)).withColumn("__mark", F.lit(None).cast("bigint"))
    others = events.where(~entry).withColumn("__old", F.lit(None).cast(entries.schema["__old"].dataType)).withColumn("__mark", F.max("through_turn").over(session))
    old = F.col("__old")
    changes = (old["fixed"] == F.col("fixed")) & (old["content"] != F.col("content")) & (normal_timestamp(F.col("updated_at")) > normal_timestamp(old["updated_at"]))
    fresh = normal_timestamp(F.col("created_at")) == normal_timestamp(F.col("updated_at"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when((F.col("sequence") > 1) & (F.col("__before").isNull() | (F.col("__n") > 1)), "bad_sequence")
        .when((F.col("sequence") < 1) | (normal_timestamp(F.col("timestamp")) < F.col("__before")), "bad_sequence")
        .when((kind == "memory_upserted") & ((old.isNull() & no(fresh)) | (old["kind"] == "memory_forgotten")), "id_reused")
        .when((kind == "memory_upserted") & old.isNotNull() & no(changes), "fixed_field")
        .when((kind == "memory_forgotten") & no(old["kind"] == "memory_upserted"), "not_active")
        .when((kind == "memory_checkpointed") & no(F.col("through_turn") > F.coalesce("__mark", F.lit(-1))), "checkpoint_back")
        .when(~kind.isin("memory_upserted", "memory_forgotten", "memory_checkpointed"), "unknown_event")
    )
    return entries.unionByName(others).join(before, "sequence", "left").withColumn("error", error).drop("__old", "__mark", "__before", "__n")


def replay_memory(events: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live entries, checkpoints (session_id, through_turn) and the log's first error (sequence, error; no row if it is sound). With strict, an error fails the job; else what was before it counts."""
    judged = memory_errors(events)
    first = judged.where("error is not null").orderBy("sequence").limit(1).select("sequence", "error")
    found = first.collect()
    if found and strict:
        raise Rejected(f"event {found[0]['sequence']}: {found[0]['error']}")
    held = judged.drop("error") if not found else judged.drop("error").where(F.col("sequence") < found[0]["sequence"])
    last = held.where(F.col("kind").isin("memory_upserted", "memory_forgotten")).groupBy("memory_id").agg(F.max_by(F.struct("*"), "sequence").alias("e")).select("e.*")
    marks = held.where("kind = 'memory_checkpointed'").groupBy("session_id").agg(F.max("through_turn").alias("through_turn"))
    return last.where("kind = 'memory_upserted'"), marks, first


def recover_pending(states: DataFrame, tasks: DataFrame) -> DataFrame:
    """session_id, turn and action for sessions with an open turn: rerun without a log of its task (session_id, turn_index, status), finalise if that has ended, resume otherwise; mismatched if the task is of another turn."""
    rows = states.where("pending is not null").join(tasks.select("session_id", "turn_index", "status"), "session_id", "left")
    action = F.when(F.col("status").isNull(), "rerun").when(F.col("turn_index") != F.col("pending"), "mismatched").when(F.col("status").isin("completed", "failed", "budget_exceeded", "cancelled"), "finalise").otherwise("resume")
    return rows.select("session_id", F.col("pending").alias("turn"), action.alias("action"))


def memory_files(live: DataFrame) -> DataFrame:
    """path and text of the Markdown view of live entries, one file each, named by its id; an entry that was forgotten has none. Written whole each time, as a table that replaces the one before."""
    from skein.operators.corpus import markdown

    front = {"memory_id": F.col("memory_id"), "updated_at": normal_timestamp(F.col("updated_at"))}
    return live.select(F.concat("memory_id", F.lit(".md")).alias("path"), markdown(front, F.col("memory_id"), F.col("content")).alias("text"))
