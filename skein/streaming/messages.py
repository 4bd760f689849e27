"""Messages from a stream of their parts, by the rules of skein.operators.messages: parts may come in any batch, out of order and more than once. A message comes out when it has stopped, or with an error when a part breaks a rule or its time has passed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from skein.operators import messages
from skein.operators.replay import Rejected
from skein.streaming.histories import _Ordered, keyed_stream


class _Messages(_Ordered):
    event = "sequence bigint, timestamp string, data string"
    head = messages.HEAD
    repeats = True

    def init(self, handle) -> None:
        super().init(handle)
        self.pieces = handle.getListState("pieces", messages.PIECE)

    def start(self) -> dict:
        return messages.start()

    def unfinished(self, head) -> bool:
        return not head["stopped"] and not head["error"]

    def _run(self, key, head, events, late) -> Iterator[Row]:
        self.told, self.new = bool(head["stopped"] or head["error"]), []
        yield from super()._run(key, head, events, late)
        if self.unfinished(head):
            if self.new:
                self.pieces.appendList(self.new)
        else:
            self.pieces.clear()

    def _held(self, block: int | None = None) -> list[tuple]:
        return [x for x in [*(tuple(p) for p in self.pieces.get()), *self.new] if block is None or x[0] == block]

    def apply(self, head, event, out, key):
        before = dict(head)
        try:
            self.new += messages.take(head, event["data"], self._held)
        except Rejected as why:
            head.update(before)
            return str(why)
        return None

    def late(self, head) -> str:
        return "incomplete"

    def ended(self, key, head, fault):
        self.pieces.clear()
        yield Row(**messages.row(key, head, [], head["error"]))

    def summary(self, key, head, fault):
        if not self.told and (head["stopped"] or head["error"]):
            yield Row(**messages.row(key, head, [] if head["error"] else self._held(), head["error"]))
        elif self.told and fault:
            yield Row(**messages.row(key, head, [], head["error"]))


def assemble(parts: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """A row for each message (as messages.assemble gives it) of a stream of parts (message_id, sequence, timestamp, data). patience_ms: how long after its first batch a message may go on; for ever unless given."""
    return keyed_stream(parts, "message_id", _Messages.event, _Messages(patience_ms), messages.MESSAGE, None)
