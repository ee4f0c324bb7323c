"""Replies that arrive in pieces, as streams: bytes to lines of data, and pieces to the events an interface shows.

Pieces of a reply carry their number and may come in any order and in any batch;
what is ahead of its turn waits in the reply's state. So what comes out depends
neither on how bytes were cut nor on batches, and a query that starts again from
its checkpoint goes on where it stopped. A reply is one person's answer: its
state is small, and replies run beside each other.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

HELD = "held binary"


class InTurn(StatefulProcessor):
    """A processor of numbered pieces that a subclass takes one by one, in order, into ``now``, what it knows of the reply. Its rows are the reply, when it arrived, the number, the moment, and the piece."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("reply", HELD)

    def fresh(self) -> dict:
        raise NotImplementedError

    def take(self, now: dict, piece: tuple) -> list[tuple]:
        """The rows that a piece gives; sets now["ended"] if none can follow."""
        raise NotImplementedError

    def stalled(self, now: dict) -> list[tuple]:
        """The rows that a reply gives from which nothing came in time."""
        return []

    def shown(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        shape = Row(*self.columns)
        return (shape(key[0], *r) for r in rows)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.kept.get()
        now = pickle.loads(held[0]) if held else {"next": 0, "waiting": {}, "last": 0, "ended": False, "timer": None, **self.fresh()}
        for _, _, number, at, *piece in rows:
            now["last"] = max(now["last"], at)
            if number >= now["next"]:
                now["waiting"].setdefault(number, tuple(piece))  # a piece that comes twice counts once
        out: list[tuple] = []
        while not now["ended"] and now["next"] in now["waiting"]:
            out += self.take(now, now["waiting"].pop(now["next"]))
            now["next"] += 1
        if now["ended"]:
            now["waiting"] = {}
        due = now["last"] + self.timeout_ms
        if now.get("timer") != due:  # each call asks the JVM, so the timer is known from the state
            for timer in [now["timer"]] if "timer" in now else list(self.handle.listTimers()):
                if timer is not None:
                    self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            now["timer"] = due
        self.kept.update((pickle.dumps(now),))
        return self.shown(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.kept.get()
        now = pickle.loads(held[0]) if held else {"ended": True}
        self.kept.clear()
        return self.shown(key, [] if now["ended"] else self.stalled(now))

    def close(self) -> None:
        pass


class Lines(InTurn):
    """Bytes to the data of their lines: a line may be cut anywhere, within a letter too. No bytes (null) say that the reply is closed, which ends its last line."""

    columns = ["reply_id", "seq", "body"]

    def fresh(self) -> dict:
        return {"tail": b"", "seq": 0}

    def take(self, now: dict, piece: tuple) -> list[tuple]:
        (chunk,) = piece
        *lines, now["tail"] = (now["tail"] + (b"\n" if chunk is None else bytes(chunk))).split(b"\n")
        now["ended"] = chunk is None
        out = []
        for line in lines:
            text = line.decode(errors="replace").strip()
            if text.startswith("data:"):
                now["seq"] += 1
                out.append((now["seq"], text.removeprefix("data:").strip()))
        return out


class Events(InTurn):
    """Pieces to events: hits once, a token for each piece with text, and then exactly one end, also if nothing more comes."""

    columns = ["reply_id", "seq", "event", "payload"]

    def __init__(self, timeout_ms: int, model: str):
        super().__init__(timeout_ms)
        self.model = model

    def fresh(self) -> dict:
        return {"shown": 0, "finish": None, "tokens": None}

    def take(self, now: dict, piece: tuple) -> list[tuple]:
        kind, text, finish, tokens = piece
        if kind == "hits":
            return [(0, "hits", text)]
        if kind == "closed":
            now["ended"] = True
            total = "" if now["tokens"] is None else f',"tokens":{int(now["tokens"])}'
            done = now["finish"] == "STOP"
            told = f'{{"model":{_quoted(self.model)}{total}}}' if done else f"{self.model} stopped early ({now['finish']}); the answer is incomplete"
            return [(now["shown"] + 1, "done" if done else "error", told)]
        now["finish"] = finish or now["finish"]
        now["tokens"] = now["tokens"] if tokens is None else tokens
        if not text:
            return []
        now["shown"] += 1
        return [(now["shown"], "token", text)]

    def stalled(self, now: dict) -> list[tuple]:
        return [(now["shown"] + 1, "error", f"nothing more came from {self.model} within {self.timeout_ms // 1000} s; the answer is incomplete")]


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    timed = rows.withColumn("arrived", F.col(at).cast("timestamp")).withWatermark("arrived", late)
    return timed.withColumn("moment", F.unix_millis("arrived"))


def data_lines(chunks: DataFrame, at: str = "at", timeout: int = 120, late: str = "1 hour") -> DataFrame:
    """(reply_id, seq, body) of a stream of chunks (reply_id, n, chunk, at): n counts a reply's chunks from 0, a null chunk closes it.

    Comments and blank lines are left out, white space around a line goes.
    Bytes that are no UTF-8 are shown as U+FFFD. What a reply that isn't closed
    leaves in an unfinished line is never shown; it is forgotten after timeout.
    """
    rows = _timed(chunks, at, late).select("reply_id", "arrived", F.col("n").cast("long").alias("n"), "moment", "chunk")
    return rows.groupBy("reply_id").transformWithState(statefulProcessor=Lines(timeout * 1000), outputStructType=f"reply_id {rows.schema['reply_id'].dataType.simpleString()}, seq long, body string", outputMode="Append", timeMode="EventTime")


def reply_events(pieces: DataFrame, model: str, at: str = "at", timeout: int = 120, late: str = "1 hour") -> DataFrame:
    """(reply_id, seq, event, payload) of a stream of pieces (reply_id, seq, kind, text, finish, tokens, at).

    seq counts from 0: first the piece of kind ``hits`` with the hits as text,
    then those of kind ``piece``, then one of kind ``closed``. A reply from which
    nothing has come for ``timeout`` seconds, by the stream's own time, ends with
    an error; what comes of it later is not shown.
    """
    rows = _timed(pieces, at, late).select("reply_id", "arrived", F.col("seq").cast("long").alias("seq"), "moment", "kind", "text", "finish", F.col("tokens").cast("long").alias("tokens"))
    return rows.groupBy("reply_id").transformWithState(statefulProcessor=Events(timeout * 1000, model), outputStructType=f"reply_id {rows.schema['reply_id'].dataType.simpleString()}, seq long, event string, payload string", outputMode="Append", timeMode="EventTime")
