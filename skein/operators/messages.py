"""Messages put together from the parts that a model streams: start, blocks with their deltas, usage, stop reason and stop. The rules of one part after the other are here; skein.streaming.messages has the stateful form.

Parts are rows (message_id, sequence from 1, data: a JSON object). A part that comes again is passed over; one that is missing, or breaks a rule, gives the message an error. Kinds of parts that aren't known are passed over too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from skein.operators.replay import Rejected

MOST_BYTES, MOST_TOOL_BYTES, MOST_BLOCKS = 8 << 20, 1 << 20, 4096
STOPS = ("end_turn", "stop_sequence", "tool_use", "max_tokens")
HEAD = "open string, block bigint, input_tokens bigint, output_tokens bigint, stop_reason string, ending boolean, stopped boolean, bytes bigint, tool_bytes bigint, last_sequence bigint, last_timestamp string, error string, waiting bigint"
#: What a part adds to a block: its number and kind, for a tool its id and name, and a piece of its text or of its input's JSON.
PIECE = "block bigint, kind string, id string, name string, piece string"
MESSAGE = "message_id string, text string, blocks string, stop_reason string, input_tokens bigint, output_tokens bigint, parts bigint, error string"


def _need(ok: bool, why: str = "bad_part") -> None:
    if not ok:
        raise Rejected(why)


def _once(pairs: list[tuple]) -> dict:
    _need(len({k for k, _ in pairs}) == len(pairs), "bad_json")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise Rejected("bad_json")


def _parsed(text: str) -> dict:
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        raise Rejected("bad_json") from None
    _need(isinstance(value, dict), "bad_json")
    return value


def _count(value) -> int:
    _need(type(value) is int and value >= 0)
    return value


def _text(value, empty: bool = True) -> str:
    _need(isinstance(value, str) and (empty or bool(value)))
    return value


def start() -> dict:
    return {x.split()[0]: None for x in HEAD.split(", ")} | {"block": 0, "ending": False, "stopped": False, "bytes": 0, "tool_bytes": 0, "last_sequence": 0, "waiting": 0}


def take(head: dict, data: str, held) -> list[tuple]:
    """The pieces that a part adds; head is brought up to date. held(block) gives the pieces of a block so far. Rejected for a part that breaks a rule: head isn't used any more."""
    head["bytes"] += len(data.encode())
    _need(head["bytes"] <= MOST_BYTES, "too_large")
    p = _parsed(data)
    kind = p.get("type")
    _need(isinstance(kind, str))
    _need(kind != "error", "provider_error")
    if kind not in ("message_start", "content_block_start", "content_block_delta", "content_block_stop", "message_delta", "message_stop"):
        return []
    _need(not head["stopped"], "after_stop")
    started = head["output_tokens"] is not None
    try:
        if kind == "message_start":
            m = p["message"]
            _need(not started and m["type"] == "message" and m["role"] == "assistant" and m["content"] == [] and m["stop_reason"] is None)
            _text(m["id"], empty=False)
            head.update(input_tokens=_count(m["usage"]["input_tokens"]), output_tokens=_count(m["usage"]["output_tokens"]))
            return []
        _need(started)
        if kind == "content_block_start":
            _need(head["open"] is None and not head["ending"] and _count(p["index"]) == head["block"] < MOST_BLOCKS)
            b = p["content_block"]
            _need(b["type"] in ("text", "tool_use"))
            head.update(open=b["type"], tool_bytes=0)
            if b["type"] == "text":
                return [(head["block"], "text", None, None, _text(b["text"]))]
            _need(b["input"] == {} and isinstance(b["input"], dict))
            return [(head["block"], "tool_use", _text(b["id"], empty=False), _text(b["name"], empty=False), "")]
        if kind == "content_block_delta":
            _need(head["open"] is not None and head["stop_reason"] is None and _count(p["index"]) == head["block"])
            d = p["delta"]
            if head["open"] == "text":
                _need(d["type"] == "text_delta")
                return [(head["block"], "text", None, None, _text(d["text"]))]
            _need(d["type"] == "input_json_delta")
            head["tool_bytes"] += len(_text(d["partial_json"]).encode())
            _need(head["tool_bytes"] <= MOST_TOOL_BYTES, "too_large")
            return [(head["block"], "tool_use", None, None, d["partial_json"])]
        if kind == "content_block_stop":
            _need(head["open"] is not None and head["stop_reason"] is None and _count(p["index"]) == head["block"])
            if head["open"] == "tool_use" and (whole := "".join(x[4] for x in held(head["block"]))):
                _parsed(whole)
            head.update(open=None, block=head["block"] + 1, tool_bytes=0)
        elif kind == "message_delta":
            _need(head["open"] is None and head["stop_reason"] is None)
            tokens, usage = _count(p["usage"]["output_tokens"]), p["usage"]
            _need(tokens >= head["output_tokens"])  # usage counts all so far
            head.update(ending=True, output_tokens=tokens)
            if "input_tokens" in usage:
                _need(_count(usage["input_tokens"]) >= head["input_tokens"])
                head["input_tokens"] = usage["input_tokens"]
            if p["delta"]["stop_reason"] is not None:
                _need(p["delta"]["stop_reason"] in STOPS)
                head["stop_reason"] = p["delta"]["stop_reason"]
        else:
            _need(head["open"] is None and head["stop_reason"] is not None)
            head["stopped"] = True
    except (KeyError, TypeError):
        raise Rejected("bad_part") from None
    return []


def row(message_id: str, head: dict, pieces: list[tuple], error: str | None) -> dict:
    """A message's row; without an error it must have stopped. The text is that of its text blocks; blocks are JSON, keys in order."""
    error = error or (None if head["stopped"] else "incomplete")
    blocks: dict[int, dict] = {}
    for block, kind, own, name, piece in pieces:
        b = blocks.setdefault(block, {"type": kind, "id": own, "name": name, "pieces": []})
        b["pieces"].append(piece)
    made = [{"type": "text", "text": "".join(b["pieces"])} if b["type"] == "text" else {"type": "tool_use", "id": b["id"], "name": b["name"], "input": error or json.loads("".join(b["pieces"]) or "{}")} for _, b in sorted(blocks.items())]
    whole = None if error else json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    text = None if error else "".join(b["text"] for b in made if b["type"] == "text")
    return {"message_id": message_id, "text": text, "blocks": whole, "stop_reason": head["stop_reason"], "input_tokens": head["input_tokens"], "output_tokens": head["output_tokens"], "parts": head["last_sequence"], "error": error}


def assemble(parts: DataFrame) -> DataFrame:
    """A row for each message of parts. Parts are sorted by message and number, and stream through: a worker holds one message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, head, pieces, error = None, start(), [], None
        for batch in batches:
            out = []
            for message, sequence, data in batch.itertuples(index=False):
                if message != key:
                    out += [row(key, head, pieces, error)] if key is not None else []
                    key, head, pieces, error = message, start(), [], None
                if error or sequence <= head["last_sequence"]:
                    continue
                try:
                    _need(sequence == head["last_sequence"] + 1, "bad_sequence")
                    before = dict(head)
                    pieces += take(head, data, lambda block, have=pieces: [x for x in have if x[0] == block])
                    head["last_sequence"] = sequence
                except Rejected as why:
                    error = str(why)
                    head = before if error != "bad_sequence" else head
            if out:
                yield pd.DataFrame(out).astype({c: "Int64" for c in ("input_tokens", "output_tokens", "parts")})
        if key is not None:
            yield pd.DataFrame([row(key, head, pieces, error)]).astype({c: "Int64" for c in ("input_tokens", "output_tokens", "parts")})

    rows = parts.select("message_id", "sequence", "data").where("message_id is not null and sequence is not null and data is not null")
    return rows.repartition("message_id").sortWithinPartitions("message_id", "sequence").mapInPandas(run, MESSAGE)
