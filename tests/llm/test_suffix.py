import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm.suffix_dedup import dedup_substrings
from passagework.llm.suffix_sort import suffix_array


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 8))
def test_suffix_array_equals_sorting(text, times):
    text = (text * times)[:60]
    assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(docs, length=100):
    """docs: (order, bytes); the order ranks them, equal ones are one document."""
    seen, out = {}, {}
    for key, t in sorted(set(docs)):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen.setdefault(t[p : p + length], (key, p)) != (key, p):
                gone[p : p + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[key] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(8)]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.2:
            t = t[: rng.randint(0, len(t))] + word() + t[rng.randint(0, len(t)) :]
        elif kind < 0.4:
            t = word() + t + rng.choice(base) + word()
        elif kind < 0.5:
            t = rng.choice(["x", "ab", "boiler plate of some length here. "]) * rng.randint(1, 300)
        elif kind < 0.8:
            t = list(t)
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            t = "".join(t)
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


def check(spark, documents, rows, **options):
    got = dedup_substrings(documents(rows).repartition(3), **options).collect()
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id


def test_dedup_equals_brute_force(spark, documents):
    check(spark, documents, corpus(1))


def test_dedup_of_hot_anchors_equals_brute_force(spark, documents):
    check(spark, documents, corpus(2), hot=2)
    check(spark, documents, corpus(3), hot=6)


def test_each_reading_may_deal_rows_out_anew(spark):
    rows = corpus(4)
    deal = F.udf(lambda: random.SystemRandom().randrange(1000), "int").asNondeterministic()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("deal", deal()).repartition(5, "deal")
    want = brute([(i, t.encode()) for i, t in rows])
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = dedup_substrings(docs).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_awkward_rows(spark, documents, awkward):
    got = dedup_substrings(documents(awkward)).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[1].spans == []
    # The long text repeats itself: all but its first period and the end of the last window stays out.
    assert by[7].n_removed == 300_000 - 5 and len(by[7].spans) == 1
    assert dedup_substrings(documents([])).count() == 0
