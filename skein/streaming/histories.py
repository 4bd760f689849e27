"""Session and memory logs as streams, by the rules of skein.operators.histories: keyed value, list and map state, started from a batch snapshot, with errors as a second output.

Events have the columns of the batch form. A batch's events of a key are taken by their sequence; one that comes early waits in the key's list until those before it have come, in whatever batch, or, with patience, is an error when
that has passed. A key in error takes nothing more. State is in RocksDB, changes are logged with the checkpoint, so that a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SESSION_EVENT = "sequence bigint, timestamp string, kind string, turn_index bigint, task_id string, through_turn bigint, history_ok boolean"
SESSION_OUT = "output string, session_id string, sequence bigint, error string, last_turn bigint, pending bigint, turns bigint, compacted_through bigint, last_sequence bigint, last_timestamp string, waiting bigint"
MEMORY_EVENT = "sequence bigint, timestamp string, kind string, memory_id string, content string, fixed string, created_at string, updated_at string, session_id string, through_turn bigint"
MEMORY_OUT = "output string, log_id string, sequence bigint, error string, memory_id string, content string, session_id string, through_turn bigint, waiting bigint"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Events of a key in the order of their numbers. A subclass says what state an event makes (apply gives an error's code or None) and what a batch puts out."""

    event, head = "", ""
    #: Whether an event that comes again is passed over, and not an error.
    repeats = False

    def __init__(self, patience_ms: int | None) -> None:
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("head", self.head)
        self.waiting = handle.getListState("waiting", self.event)
        self.names = [x.split()[0] for x in self.event.split(", ")]
        self.heads = [x.split()[0] for x in self.head.split(", ")]

    def start(self) -> dict:
        return dict.fromkeys(self.heads) | {"last_sequence": 0, "waiting": 0}

    def apply(self, head: dict, event: dict, out: list[Row], key: str) -> str | None:
        raise NotImplementedError

    def summary(self, key: str, head: dict, fault: tuple[int, str] | None) -> Iterator[Row]:
        raise NotImplementedError

    def unfinished(self, head: dict) -> bool:
        """Whether the key waits for more, so that its patience runs."""
        return bool(head["waiting"])

    def late(self, head: dict) -> str:
        """The error of a key whose patience has ended while it waits."""
        return "bad_sequence"

    def _run(self, key: str, head: dict, events: list[dict], late: bool) -> Iterator[Row]:
        out: list[Row] = []
        fault, held, began = None, [], bool(head["waiting"])
        for e in sorted(events, key=lambda e: e["sequence"]):
            if head["error"]:
                break
            if self.repeats and e["sequence"] <= head["last_sequence"]:
                continue
            if e["sequence"] > head["last_sequence"] + 1 and not late:
                held.append(e)
                continue
            error = "bad_sequence" if e["sequence"] != head["last_sequence"] + 1 else self.apply(head, e, out, key)
            if error:
                head["error"], fault, held = error, (e["sequence"], error), []
            else:
                head["last_sequence"], head["last_timestamp"] = e["sequence"], e["timestamp"]
        if held:
            self.waiting.put([tuple(e[n] for n in self.names) for e in held])
        elif began:
            self.waiting.clear()
        head["waiting"] = len(held)
        self.first.update(tuple(head[h] for h in self.heads))
        yield from out
        yield from self.summary(key, head, fault)

    def _head(self) -> dict:
        return dict(zip(self.heads, self.first.get(), strict=True)) if self.first.exists() else self.start()

    def ended(self, key: str, head: dict, fault: tuple[int, str]) -> Iterator[Row]:
        yield from self.summary(key, head, fault)

    def _early(self, head: dict) -> list[dict]:
        return [dict(zip(self.names, x, strict=True)) for x in self.waiting.get()] if head["waiting"] else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head = self._head()
        before = self.first.exists() and self.unfinished(head)
        yield from self._run(key[0], head, [*self._early(head), *({n: r[n] for n in self.names} for r in rows)], self.patience_ms == 0)
        if self.patience_ms and self.unfinished(head) and not before:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self._head()
        if self.unfinished(head):
            early = self._early(head)
            error = (min((e["sequence"] for e in early), default=head["last_sequence"] + 1), self.late(head))
            head.update(error=error[1], waiting=0)
            self.waiting.clear()
            self.first.update(tuple(head[h] for h in self.heads))
            yield from self.ended(key[0], head, error)

    def close(self) -> None:
        pass


def _normal(stamp: str) -> str:
    return stamp[:19] + ".000Z" if len(stamp) == 20 else stamp


class _Sessions(_Ordered):
    event = SESSION_EVENT
    head = "last_turn bigint, pending bigint, pending_task string, last_committed bigint, turns bigint, compacted_through bigint, last_sequence bigint, last_timestamp string, error string, waiting bigint"

    def init(self, handle) -> None:
        super().init(handle)
        self.committed = handle.getMapState("committed", "turn bigint", "sequence bigint")

    def start(self) -> dict:
        return super().start() | {"last_turn": 0, "turns": 0, "compacted_through": 0, "last_committed": 0}

    def apply(self, head, e, out, key):
        kind, open_ = e["kind"], head["pending"] is not None
        if not head["last_sequence"]:
            return None if kind == "session_started" else "not_started"
        if kind == "session_started":
            return "already_started"
        if kind == "session_turn_started":
            if open_ or e["turn_index"] != head["last_turn"] + 1:
                return "turn_order"
            head.update(pending=e["turn_index"], pending_task=e["task_id"], last_turn=e["turn_index"])
        elif kind in ("session_turn_committed", "session_turn_failed"):
            if not open_ or (head["pending"], head["pending_task"]) != (e["turn_index"], e["task_id"]):
                return "no_pending_turn"
            if kind == "session_turn_committed":
                if not e["history_ok"]:
                    return "bad_history"
                self.committed.updateValue((e["turn_index"],), (e["sequence"],))
                head.update(turns=head["turns"] + 1, last_committed=e["turn_index"])
            head.update(pending=None, pending_task=None)
        elif kind == "session_compacted":
            through = e["through_turn"]
            if open_ or through is None or through <= head["compacted_through"] or through >= head["last_committed"] or not self.committed.containsKey((through,)):
                return "nothing_to_compact"
            gone = [k for (k,) in self.committed.keys() if k <= through]
            for k in gone:
                self.committed.removeKey((k,))
            head.update(turns=head["turns"] - len(gone), compacted_through=through)
        else:
            return "unknown_event"
        return None

    def summary(self, key, head, fault):
        names = ("last_turn", "pending", "turns", "compacted_through", "last_sequence", "last_timestamp", "waiting")
        yield Row(output="state", session_id=key, sequence=None, error=head["error"], **{n: head[n] for n in names})
        if fault:
            yield Row(output="error", session_id=key, sequence=fault[0], error=fault[1], **dict.fromkeys(names))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        head = self.start() | {h: initialState[h] for h in self.heads if h != "waiting"}
        self.first.update(tuple(head[h] for h in self.heads))
        for turn, sequence in initialState["committed"]:
            self.committed.updateValue((turn,), (sequence,))


class _Memories(_Ordered):
    event = MEMORY_EVENT
    head = "last_sequence bigint, last_timestamp string, error string, waiting bigint"

    def init(self, handle) -> None:
        super().init(handle)
        self.entries = handle.getMapState("entries", "memory_id string", "content string, fixed string, updated_at string, live boolean")
        self.marks = handle.getMapState("marks", "session_id string", "through_turn bigint")

    def apply(self, head, e, out, key):
        kind = e["kind"]
        if head["last_sequence"] and _normal(e["timestamp"]) < _normal(head["last_timestamp"]):
            return "bad_sequence"
        tell = lambda output, **more: out.append(Row(**(dict.fromkeys(x.split()[0] for x in MEMORY_OUT.split(", ")) | {"output": output, "log_id": key, "sequence": e["sequence"]} | more)))
        own = (e["memory_id"],)
        if kind == "memory_upserted":
            if not self.entries.containsKey(own):
                if _normal(e["created_at"]) != _normal(e["updated_at"]):
                    return "id_reused"
            else:
                content, fixed, updated_at, live = self.entries.getValue(own)
                if not live:
                    return "id_reused"
                if fixed != e["fixed"] or content == e["content"] or _normal(e["updated_at"]) <= _normal(updated_at):
                    return "fixed_field"
            self.entries.updateValue(own, (e["content"], e["fixed"], e["updated_at"], True))
            tell("entry", memory_id=own[0], content=e["content"])
        elif kind == "memory_forgotten":
            if not self.entries.containsKey(own) or not self.entries.getValue(own)[3]:
                return "not_active"
            self.entries.updateValue(own, (None, None, None, False))  # the id is never used again
            tell("forgotten", memory_id=own[0])
        elif kind == "memory_checkpointed":
            session = (e["session_id"],)
            if self.marks.containsKey(session) and e["through_turn"] <= self.marks.getValue(session)[0]:
                return "checkpoint_back"
            self.marks.updateValue(session, (e["through_turn"],))
            tell("checkpoint", session_id=session[0], through_turn=e["through_turn"])
        else:
            return "unknown_event"
        return None

    def summary(self, key, head, fault):
        rest = dict.fromkeys(("memory_id", "content", "session_id", "through_turn"))
        yield Row(output="state", log_id=key, sequence=head["last_sequence"], error=head["error"], waiting=head["waiting"], **rest)
        if fault:
            yield Row(output="error", log_id=key, sequence=fault[0], error=fault[1], waiting=None, **rest)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        if r["memory_id"] is not None:
            self.entries.updateValue((r["memory_id"],), (r["content"], r["fixed"], r["updated_at"], r["live"]))
        elif r["session_id"] is not None:
            self.marks.updateValue((r["session_id"],), (r["through_turn"],))
        else:
            head = self.start() | {h: r[h] for h in self.heads if h != "waiting"}
            self.first.update(tuple(head[h] for h in self.heads))


def keyed_stream(events: DataFrame, key: str, columns: str, processor: _Ordered, out: str, snapshot: DataFrame | None) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = events.select(F.col(key).cast("string").alias(key), *(F.col(c.split()[0]).cast(c.split()[1]) for c in columns.split(", "))).groupBy(key)
    mode = "ProcessingTime" if processor.patience_ms else "None"
    return rows.transformWithState(processor, out, "Update", mode, None if snapshot is None else snapshot.groupBy(key))


def replay_sessions(events: DataFrame, patience_ms: int | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """For each session and batch with events of it a row with output "state", and one with output "error" when an event breaks a rule. snapshot: session_snapshot() of the events that came before the stream.

    patience_ms: how long an early event may wait; for ever unless given, and not at all with 0.
    """
    return keyed_stream(events, "session_id", SESSION_EVENT, _Sessions(patience_ms), SESSION_OUT, snapshot)


def replay_memory(events: DataFrame, patience_ms: int | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """The same for memory logs, with a log_id: rows with output "entry", "forgotten" and "checkpoint" for what changes, "state" for each log and batch, and "error"."""
    return keyed_stream(events, "log_id", MEMORY_EVENT, _Memories(patience_ms), MEMORY_OUT, snapshot)


def session_snapshot(events: DataFrame) -> DataFrame:
    """What replay_sessions() needs of the events so far, a row for each session, by the batch form's windows."""
    from skein.operators import histories

    held, errors = histories.until_error(histories.session_errors(events), "session_id")
    kind = F.col("kind")
    turn = kind.isin("session_turn_started", "session_turn_committed", "session_turn_failed")
    last = F.max_by(F.when(turn, F.struct("kind", "turn_index", "task_id")), F.when(turn, F.col("sequence")))
    done = F.collect_list(F.when(kind == "session_turn_committed", F.struct("turn_index", "sequence")))
    through = F.coalesce(F.max(F.when(kind == "session_compacted", F.col("through_turn"))), F.lit(0))
    rows = held.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(kind == "session_turn_started", F.col("turn_index"))), F.lit(0)).alias("last_turn"), last.alias("last"), done.alias("done"), through.alias("compacted_through"),
        F.max("sequence").alias("last_sequence"), F.max_by("timestamp", "sequence").alias("last_timestamp"),
    ).join(errors.select("session_id", "error"), "session_id", "full_outer")
    open_ = F.col("last.kind") == "session_turn_started"
    kept = F.filter(F.coalesce("done", F.array().cast(rows.schema["done"].dataType)), lambda x: x["turn_index"] > F.coalesce("compacted_through", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        F.col("session_id").cast("string").alias("session_id"), zero("last_turn"), F.when(open_, F.col("last.turn_index")).cast("bigint").alias("pending"), F.when(open_, F.col("last.task_id")).alias("pending_task"),
        F.coalesce(F.array_max(F.transform("done", lambda x: x["turn_index"])), F.lit(0)).cast("bigint").alias("last_committed"), F.size(kept).cast("bigint").alias("turns"), zero("compacted_through"), zero("last_sequence"), "last_timestamp", "error",
        F.transform(kept, lambda x: F.struct(x["turn_index"].cast("bigint").alias("turn"), x["sequence"].cast("bigint").alias("sequence"))).alias("committed"),
    )


def memory_snapshot(events: DataFrame, log_id: str) -> DataFrame:
    """What replay_memory() needs of the events so far of a log: a row for the log, and one for each entry, also forgotten ones, and checkpoint."""
    from skein.operators import histories

    judged = histories.memory_errors(events)
    first = judged.where("error is not null").agg(F.min_by(F.struct("sequence", "error"), "sequence").alias("e"))  # one row
    held = judged.drop("error").join(F.broadcast(first)).where("e is null or sequence < e.sequence")
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda **c: [c.get(n, null(k)).cast(k).alias(n) for n, k in (("memory_id", "string"), ("content", "string"), ("fixed", "string"), ("updated_at", "string"), ("live", "boolean"), ("session_id", "string"), ("through_turn", "bigint"), ("last_sequence", "bigint"), ("last_timestamp", "string"), ("error", "string"))]
    last = held.where(F.col("kind").isin("memory_upserted", "memory_forgotten")).groupBy("memory_id").agg(F.max_by(F.struct("*"), "sequence").alias("r")).select("r.*")
    live = F.col("kind") == "memory_upserted"
    entries = last.select(*row(memory_id=F.col("memory_id"), content=F.when(live, F.col("content")), fixed=F.when(live, F.col("fixed")), updated_at=F.when(live, F.col("updated_at")), live=live))
    marks = held.where("kind = 'memory_checkpointed'").groupBy("session_id").agg(F.max("through_turn").alias("through_turn")).select(*row(session_id=F.col("session_id"), through_turn=F.col("through_turn")))
    heads = held.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("n"), F.max_by("timestamp", "sequence").alias("t")).join(F.broadcast(first)).select(*row(last_sequence=F.col("n"), last_timestamp=F.col("t"), error=F.col("e.error")))
    return entries.unionByName(marks).unionByName(heads).select(F.lit(log_id).alias("log_id"), "*")

