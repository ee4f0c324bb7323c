"""Operator 7: toxic passages as maximum-scoring segments.

Words score their log-odds of standing in toxic text, for or against. A
Dirichlet prior, of a constant and a part that follows the words' frequencies in
the whole corpus, shrinks rare words towards no evidence. Words whose log-odds
can't be told from zero, and words never seen, score a small negative drift. One
pass over a text finds all its maximal segments. A segment's score is held
against the extreme-value law that such scores follow in clean text of the same
length, and the segments' significances are added up and calibrated to a
probability.

Words and calibration are learned on a bounded sample: at most about
``sample`` labelled rows of either label, chosen by a hash of the id, one half
for the words and the other for the calibration. Of near copies, known by the
smallest hash of their runs of words, one counts. The prior counts the
lexicon's words over all documents. The lexicon has at most ``lexicon`` words,
those of the largest z-scores.

Null and empty texts have no segment and score the calibrated floor. Rows are
scored one by one, in one narrow stage; repeated rows each give their own row.
The time for a text is linear in its length. Without labels of both kinds the
model has no words and every row scores its floor.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

WORD = re.compile(r"[^\W\d_]+")
EULER = 0.5772156649


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score), given the words that score; all others score -drift.

    Each segment points to the nearest one before it that starts from a lower
    sum. Those passed over on the way there are never looked at again, so the
    time is linear in the hits.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, the nearest that starts lower
    total, at = 0.0, 0
    for i, s in hits:
        total -= drift * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        first, left = i, total
        total += s
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < total:
            first, _, left, _, lower = stack[j]
            del stack[j:]
            j = lower
        stack.append((first, i + 1, left, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def sketch(words: list[str], run: int = 5) -> int:
    """The smallest hash of the runs of words, by which near copies are known."""
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    return min((hash(tuple(h[i : i + run])) for i in range(max(len(h) - run, 0) + 1)), default=0)


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    decay: float = 1.0  # of the extreme-value law
    size: float = 1.0
    bias: float = -4.0
    slope: float = 0.0

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        return [(i, self.scores[w]) for i, w in enumerate(words) if w in self.scores]

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of -ln(p-value) over the significant segments, and these."""
        words = words_of(text)
        found, total = [], 0.0
        for a, b, s in segments(self.hits(words), self.drift):
            if (gain := self.surprise(s, len(words))) > 0:
                found.append((a, b, s))
                total += gain
        return total, found

    def surprise(self, score: float, words: int) -> float:
        """-ln(p-value) of a segment's score in a text of so many words; 0 if it isn't significant."""
        p = -math.expm1(-self.size * max(words, 1) * math.exp(-self.decay * score))
        return -math.log(max(p, 1e-300)) if p < 0.5 else 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(evidence)))))


def decay_of(freq: np.ndarray, score: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(x * score)] = 1 over clean text."""
    rest = max(0.0, 1 - freq.sum())
    value = lambda x: float((freq * np.exp(x * score)).sum() + rest * math.exp(-x * drift)) - 1
    lo, hi = 1e-4, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return max(lo, 0.05)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Bias and slope, lightly penalised, by Newton's method."""
    beta, z = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (w * (y - p)) - 1e-3 * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        beta += np.clip(np.linalg.solve(h, g), -2, 2)
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 8000, lexicon: int = 20_000, prior: float = 500.0, least: float = 3.0, z_least: float = 3.0, drift: float = 0.3) -> Model:
    """labels: (id, label) of the rows that may be learned from. least: the constant part of the prior.

    z_least and drift gave the least log-loss, of twelve settings, on one fold of
    the learnable rows when the rest of those was learned from.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    sizes = dict(marked.groupBy("y").count().collect())
    if set(sizes) != {0, 1}:
        return Model()
    share = {y: min(1.0, sample / n) for y, n in sizes.items()}
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    drawn = marked.where(hashed < F.when(F.col("y") == 1, share[1] * (1 << 20)).otherwise(share[0] * (1 << 20))).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)))
    # About 2 * sample rows of 16 bytes, whatever the size of the tables. What is read with them is the bounded sample.
    rows = materialised(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id").select("text", "y", "half"))

    def words_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words_of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(sketch, found), pa.int64()), pa.array([sorted(set(w)) for w in found], pa.list_(pa.string())), b.column(1)], ["sketch", "words", "y"])

    # A word counts once for each text, and near copies are one.
    texts = rows.where("half = 0").select("text", "y").mapInArrow(words_once, "sketch long, words array<string>, y int").groupBy("sketch", "y").agg(F.min("words").alias("words"))
    learn = materialised(texts.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")))
    n1, n0 = learn.agg(F.sum("a"), F.sum("b")).first()
    if not n1 or not n0:
        return Model()
    by1, by0 = n1 / (n1 + n0), n0 / (n1 + n0)
    x, y = F.col("a") + least * by1, F.col("b") + least * by0
    z = (F.log(x / (n1 - F.col("a") + 1)) - F.log(y / (n0 - F.col("b") + 1))) / F.sqrt(1 / x + 1 / y)
    top = learn.where(F.abs(z) >= z_least).orderBy(F.desc(F.abs(z)), "word").limit(lexicon).collect()  # the model: bounded by lexicon
    vocabulary = {r.word: i for i, r in enumerate(top)}

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(len(vocabulary) + 1, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                words = words_of(t)
                total += len(words)
                for w in words:
                    if w in vocabulary:
                        held[vocabulary[w]] += 1
        held[-1] = total
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["word", "n"])

    all_counts = np.zeros(len(vocabulary) + 1)
    for i, n in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(background, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        all_counts[i] = n
    freq = (all_counts[:-1] + 0.5) / max(all_counts[-1], 1)
    scores = {}
    for r, f in zip(top, freq.tolist(), strict=True):
        alpha = least + prior * f
        a, b = r.a + alpha * by1, r.b + alpha * by0
        scores[r.word] = math.log(a / (n1 - r.a + 1)) - math.log(b / (n0 - r.b + 1)) - drift
    model = Model(scores, drift)
    model.decay = decay_of(freq, np.array(list(scores.values())), drift) if scores else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = [], []
            for t in b.column(0).to_pylist():
                words = words_of(t)
                n.append(len(words))
                found.append([s for *_, s in segments(model.hits(words), drift)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array(n, pa.int64()), b.column(1)], ["found", "n", "y"])

    seen = rows.where("half = 1").select("text", "y").mapInArrow(weigh, "found array<double>, n long, y int").toPandas()  # the bounded sample: about sample rows
    clean = seen[seen.y == 0]
    best = np.array([max(f, default=0.0) for f in clean.found])
    # Location of the law: its mean over clean rows is (ln(size * n) + Euler's constant) / decay.
    model.size = float(np.exp(np.mean(model.decay * best - EULER - np.log(np.maximum(clean.n, 1))))) if len(clean) else 1.0
    evidence = np.array([sum(model.surprise(s, n) for s in f) for f, n in zip(seen.found, seen.n, strict=True)])
    if seen.y.nunique() == 2:
        model.bias, model.slope = logistic(np.log1p(evidence), seen.y.to_numpy(float), np.where(seen.y == 1, 1 / share[1], 1 / share[0]))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages array<struct<first,stop,score>>) of every row; a passage's offsets count words."""
    passage = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.evidence(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.probability(x) for x, _ in found], pa.float64()), pa.array([[{"first": a, "stop": e, "score": s} for a, e, s in f] for _, f in found], passage)], ["id", "score", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "id long, score double, passages array<struct<first:int,stop:int,score:double>>").withColumnRenamed("id", id_col)
