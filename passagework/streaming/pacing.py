"""A budget that many senders share: when each request of a stream may go.

The ledger of what was sent in the last window lives in the stream's state, one
for each budget, and not in the tasks that send. So it holds over all of them,
and a task, a query or a driver that starts again finds it as it was left. A
budget is one order of events, so its requests pass one task, as numbers alone:
who, when and how many. Budgets run beside each other. Where texts themselves are
sent, the budget is cut into shares, each with a ledger of its own.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..sources.remote import BATCH, CHARS, KINDS, MARGIN, RATE, WINDOW, Call, batched, pace

SECOND = 1_000_000  # times are whole microseconds, so that sums are exact
LEDGER = "times array<long>, counts array<long>, last long"


def released(sent: tuple, last: int, requests: list[tuple[int, int]], rate: int, window: int, margin: int) -> tuple[tuple, int, list[int]]:
    """(what was sent, when the last went, when each of requests (when, how many) goes): in order, none before the one ahead of it."""
    out = []
    for when, count in requests:
        now = max(when, last)
        sent, wait = pace(sent, now, count, rate, window, margin)
        while wait:
            now += wait
            sent, wait = pace(sent, now, count, rate, window, margin)
        sent += ((now, count),)
        last = now
        out.append(now)
    return sent, last, out


class Ledger(StatefulProcessor):
    """Keeps one budget: takes requests in order of time and tells when they go. It is forgotten once all of it has left the window."""

    def __init__(self, rate: int, window: int, margin: int):
        self.limits = (rate, window, margin)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("ledger", LEDGER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["moment", "request"], kind="stable")  # a batch's requests of one budget: three numbers each
        sent, last = (), -(1 << 62)
        if self.kept.exists():
            times, counts, last = self.kept.get()
            sent = tuple(zip(times, counts, strict=True))
        sent, last, out = released(sent, last, list(zip(frame["moment"].tolist(), frame["many"].tolist(), strict=True)), *self.limits)
        self.kept.update(([int(t) for t, _ in sent], [int(n) for _, n in sent], int(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.limits[1]) // 1000 + 1)
        yield pd.DataFrame({"budget": key[0], "request": frame["request"].tolist(), "released": out})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def paced(requests: DataFrame, by: str, key: str, at: str = "ts", count: str = "n", rate: int = RATE, window: float = WINDOW, margin: float = MARGIN, late: str = "1 hour") -> DataFrame:
    """(by, key, released) of a stream of requests: when each goes, in microseconds since the epoch, under the budget of its ``by``.

    Requests of one batch go in order of time, then key; batches in the order
    in which they come. A request larger than the rate goes when nothing else
    counts. Rows whose budget, time or count is null are no requests. late: how
    far behind the newest request one may come; it keeps ledgers from being
    forgotten too early and costs nothing else.
    """
    # Names of our own: a processor's columns can't begin with an underscore, as given ones might.
    rows = requests.select(F.col(by).alias("budget"), F.col(key).alias("request"), F.col(at).cast("timestamp").alias("arrived"), F.col(count).cast("long").alias("many"))
    rows = rows.where("budget is not null and arrived is not null and many is not null").withWatermark("arrived", late).withColumn("moment", F.unix_micros("arrived"))
    schema = f"budget {rows.schema['budget'].dataType.simpleString()}, request {rows.schema['request'].dataType.simpleString()}, released long"
    ledger = Ledger(rate, int(window * SECOND), int(margin * SECOND))
    out = rows.groupBy("budget").transformWithStateInPandas(statefulProcessor=ledger, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(F.col("budget").alias(by), F.col("request").alias(key), "released")


class Sender(StatefulProcessor):
    """Sends a share's texts to a service, in requests, and waits before each until the ledger lets it go."""

    def __init__(self, call: Call, task: str, rate: int, window: int, margin: int, most: int):
        self.call, self.task, self.limits, self.most = call, task, (rate, window, margin), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("ledger", LEDGER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times, counts, last = self.kept.get() if self.kept.exists() else ([], [], 0)
        sent = tuple(zip(times, counts, strict=True))
        for frame in rows:
            at = 0
            for texts in batched([t or "" for t in frame["text"]], self.most, CHARS):
                now = int(time.time() * SECOND)  # of the clock, as the next run may be another process
                sent, wait = pace(sent, now, len(texts), *self.limits)
                while wait:
                    time.sleep(wait / SECOND)
                    now = int(time.time() * SECOND)
                    sent, wait = pace(sent, now, len(texts), *self.limits)
                sent += ((now, len(texts)),)
                # Told before it is sent: a request that fails has still used the budget.
                self.kept.update(([int(t) for t, _ in sent], [int(n) for _, n in sent], now))
                found = self.call(texts, self.task)
                yield pd.DataFrame({"request": frame["request"].iloc[at : at + len(texts)].tolist(), "vector": [[float(x) for x in v] for v in found]})
                at += len(texts)

    def close(self) -> None:
        pass


def embedded(texts: DataFrame, key: str, kind: str, call: Call, text: str = "text", rate: int = RATE, window: float = WINDOW, margin: float = MARGIN, most: int = BATCH, senders: int = 4) -> DataFrame:
    """(key, vector) of a stream of texts, sent under one budget whatever else runs on the cluster.

    The budget is dealt out over ``senders`` in equal shares, so no task is
    handed all texts. A text's sender follows from its key. A sender's ledger is
    in its state, so the next batch, or the query that goes on after a restart,
    is told what it sent in the last window. More senders than the cluster has
    cores, or than there is rate, leave shares unused. A null text is sent as
    an empty one. ``remote.embedded`` is the same for a table.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; expected one of {sorted(KINDS)}")
    senders = max(min(senders, rate), 1)  # a share is one text at least, and all together keep to the rate
    share = rate // senders
    rows = texts.select(F.pmod(F.xxhash64(F.col(key)), F.lit(senders)).cast("int").alias("budget"), F.col(key).alias("request"), F.col(text).cast("string").alias("text"))
    sender = Sender(call, KINDS[kind], share, int(window * SECOND), int(margin * SECOND), min(most, share))
    out = rows.groupBy("budget").transformWithStateInPandas(statefulProcessor=sender, outputStructType=f"request {rows.schema['request'].dataType.simpleString()}, vector array<float>", outputMode="Append", timeMode="None")
    return out.select(F.col("request").alias(key), "vector")
