"""Streams with state: against brute force, however rows are cut into batches and ordered, and over restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from passagework.plans import base
from passagework.sources import remote
from passagework.streaming import pacing, replies


def test_a_spent_budget_waits_for_the_window_to_slide():
    assert pacing.released((), 0, [(1_000, 1500), (2_000, 1)], 1500, 60_000_000, 500_000)[2] == [1_000, 60_501_000]
    sent, last, out = pacing.released((), 0, [(0, 10), (5, 10), (7, 1)], 20, 100, 3)
    assert out == [0, 5, 103] and last == 103 and (0, 10) not in sent
    assert pacing.released((), 0, [(0, 99), (1, 99)], 20, 100, 3)[2] == [0, 103]  # larger than the rate: alone


def brute_release(requests, rate, window, margin):
    """A clock that ticks on, one request at a time, by the rule of a budget that sleeps."""
    now, slept = [0.0], []
    budget = remote.Budget(rate, window, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    out = []
    for at, count in requests:
        now[0] = max(now[0], at)
        budget.take(count)
        out.append(now[0])
    return out


def test_a_budget_holds_over_batches_and_restarts(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(120):
        t += rng.randint(0, 30)
        rows.append((i, "ab"[rng.random() < 0.3], t, rng.choice([1, 2, 5, 30])))
    frame = spark.createDataFrame([(i, k, t, n) for i, k, t, n in rows], "id long, k string, t long, n int").withColumn("ts", F.timestamp_seconds("t"))
    frame = frame.union(spark.createDataFrame([(900, None, 5, 1), (901, "a", None, 1), (902, "a", 5, None)], "id long, k string, t long, n int").withColumn("ts", F.timestamp_seconds("t")))
    slices = [frame.where(f"id between {a} and {a + 39} or ({a} = 0 and id >= 900)") for a in (0, 40, 80)]
    out = base.streamed(slices, lambda s: pacing.paced(s, "k", "id", rate=20, window=60.0, margin=0.5))
    got = {r.id: r.released / 1e6 for r in out.collect()}
    assert out.count() == 120
    for k in "ab":
        mine = [(i, t, n) for i, kk, t, n in rows if kk == k]
        assert [got[i] for i, _, _ in mine] == brute_release([(t, n) for _, t, n in mine], 20, 60.0, 0.5)
    assert any(got[i] > t for i, _, t, _ in rows)


def lines_of(data):
    out = []
    for line in data.split(b"\n"):
        text = line.decode(errors="replace").strip()
        if text.startswith("data:"):
            out.append(text[5:].strip())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_are_the_same_however_bytes_are_cut(spark, seed):
    rng = random.Random(seed)
    data = {
        "a": ": comment\n\n  data: {\"x\": \"né\"}\r\ndata:two\n\tdata:  three \nother: no\ndata: last without end".encode(),
        "b": "data: é漢字\U0001d11e\n".encode() * 5,
        "c": b"",
        "d": b"data: \xff\xfe broken\n",
    }
    rows = []
    for reply, whole in data.items():
        cuts = sorted({0, len(whole), *(rng.randint(0, len(whole)) for _ in range(9))})
        chunks = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [None]
        rows += [(reply, n, None if c is None else bytearray(c), 1_700_000_000 + n) for n, c in enumerate(chunks)]
    rows += [(r, n, c, t) for r, n, c, t in rows if n == 1]  # sent twice
    rows.append(("open", 0, bytearray(b"data: whole\ndata: unfini"), 1_700_000_000))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "reply_id string, n long, chunk binary, t long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    half = F.pmod(F.xxhash64("reply_id", "n"), F.lit(2))
    out = base.streamed([frame.where(half == k) for k in (0, 1)], lambda s: replies.data_lines(s)).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.seq):
        got.setdefault(r.reply_id, []).append(r.body)
    assert got == {k: v for k, v in {**{r: lines_of(w) for r, w in data.items()}, "open": ["whole"]}.items() if v}
    assert sorted(r.seq for r in out if r.reply_id == "b") == [1, 2, 3, 4, 5]


def test_a_reply_asks_for_its_state_once_and_moves_its_timer_only_if_that_changes():
    """Each such call waits for the JVM; replies are many and short."""
    calls = []

    class Handle:
        held = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def registerTimer(self, at):
            calls.append(("timer", at))

        def deleteTimer(self, at):
            calls.append(("gone", at))

    lines = replies.Lines(1000)
    lines.init(Handle())
    got = [list(lines.handleInputRows(("r",), iter(rows), None)) for rows in ([("r", None, 1, 5, b"ta: x\n")], [("r", None, 0, 5, b"da")], [("r", None, 2, 9, None)])]
    assert [[tuple(r) for r in rows] for rows in got] == [[], [("r", 1, "x")], []]
    assert calls == ["get", ("timer", 1005), "update", "get", "update", "get", ("gone", 1005), ("timer", 1009), "update"]


def test_each_reply_ends_once(spark):
    piece = lambda r, seq, kind, text=None, finish=None, tokens=None, t=0: (r, seq, kind, text, finish, tokens, 1_700_000_000 + t)
    rows = [
        *(piece("whole", n, "piece", x, "STOP" if n == 3 else None, 7 if n == 2 else None) for n, x in ((1, "a"), (2, ""), (3, "b"))),
        piece("whole", 0, "hits", "[]"), piece("whole", 4, "closed"), piece("whole", 5, "piece", "late"),
        piece("cut", 0, "hits", "[]"), piece("cut", 1, "piece", "x", "MAX_TOKENS"), piece("cut", 2, "closed"),
        piece("silent", 0, "hits", "[1]"), piece("silent", 1, "closed"),
        piece("stalled", 0, "hits", "[]"), piece("stalled", 1, "piece", "y"), piece("stalled", 3, "closed"),
        piece("untold", 0, "hits", "[]"), piece("untold", 1, "piece", "z", "STOP"), piece("untold", 2, "closed"),
    ]
    random.Random(4).shuffle(rows)
    schema = "reply_id string, seq long, kind string, text string, finish string, tokens long, t long"
    timed = lambda rows: spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("t")).drop("t")
    slices = [timed(rows[::2]), timed(rows[1::2]), timed([piece("clock", 9, "piece", t=100_000)]), timed([piece("clock", 9, "piece", t=100_001)])]
    out = base.streamed(slices, lambda s: replies.reply_events(s, "m", timeout=120)).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.seq):
        got.setdefault(r.reply_id, []).append((r.event, r.payload))
    assert got == {
        "whole": [("hits", "[]"), ("token", "a"), ("token", "b"), ("done", '{"model":"m","tokens":7}')],
        "cut": [("hits", "[]"), ("token", "x"), ("error", "m stopped early (MAX_TOKENS); the answer is incomplete")],
        "silent": [("hits", "[1]"), ("error", "m stopped early (None); the answer is incomplete")],
        "stalled": [("hits", "[]"), ("token", "y"), ("error", "nothing more came from m within 120 s; the answer is incomplete")],
        "untold": [("hits", "[]"), ("token", "z"), ("done", '{"model":"m"}')],
    }


def test_texts_are_sent_under_one_budget_over_restarts(spark):
    """The service here answers with the time it was asked: no window holds more than the rate, whatever tasks and runs there were."""
    service = lambda texts, task: [[time.time() % 100_000, len(texts), len(task)] for _ in texts]
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(25)], "id long, text string").repartition(5)
    slices = [rows.where(f"id % 2 = {k}") for k in (0, 1)]
    out = base.streamed(slices, lambda s: pacing.embedded(s, "id", "query", service, rate=8, window=3.0, margin=0.2, most=4)).collect()
    assert sorted(r.id for r in out) == list(range(25)) and {r.vector[2] for r in out} == {len("RETRIEVAL_QUERY")} and max(r.vector[1] for r in out) <= 4
    times = sorted(round(r.vector[0], 2) for r in out)
    assert all(sum(t <= u < t + 2.9 for u in times) <= 8 for t in times)
    with pytest.raises(ValueError, match="unknown kind"):
        pacing.embedded(rows, "id", "other", service)


def test_texts_are_dealt_out_to_senders_that_together_keep_to_the_rate(spark):
    """The service answers with its task and time: many tasks send, and no window holds more than the rate, even one of fewer texts than senders."""
    from pyspark import TaskContext

    service = lambda texts, task: [[TaskContext.get().partitionId(), time.time() % 100_000] for _ in texts]
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string")
    out = base.streamed([rows], lambda s: pacing.embedded(s, "id", "query", service, rate=1 << 20, senders=16)).collect()
    assert sorted(r.id for r in out) == list(range(40)) and len({r.vector[0] for r in out}) > 1
    out = base.streamed([rows.where("id < 9")], lambda s: pacing.embedded(s, "id", "query", service, rate=3, window=2.0, margin=0.2, senders=16)).collect()
    times = [round(r.vector[1], 2) for r in out]
    assert len(times) == 9 and all(sum(t <= u < t + 1.9 for u in times) <= 3 for t in times)
