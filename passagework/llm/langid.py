"""Operator 6: language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character trigrams. Each
language has several centroids, found by spherical k-means, and a text takes
the language of the centroid with the largest cosine. A text further from every
centroid than its language's training rows of about its length are is rejected:
the floor is ``slack`` times the least cosine of those rows. Cosines grow with length, so
there is a floor for each power of two of trigrams.

Document frequencies are counted over all training rows. The centroids are
fitted on a bounded sample: about ``sample`` rows of each language, chosen by a
hash of the id. Languages are fitted in parallel, one task each; what comes to
the driver is ``clusters`` vectors of ``SLOTS`` numbers for each language. At
most ``languages`` languages are learned, those with most rows, so a dirty
column can't make the model grow.

Null texts and texts without a letter are ``und`` with score 0, and rejected. Rows are scored
one by one, in one narrow stage; repeated rows each give their own row. A text
of any length is counted whole, in pieces. Without training rows everything is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4096
PIECE = 1 << 20  # bytes counted at a time
CLASSES = 12  # of length: the last holds texts of 2^11 trigrams or more
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters and all bytes of longer characters stay; everything else is a gap.
KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def counts(text: str | None) -> np.ndarray:
    """Counts of the hashed trigrams of a whole text; trigrams about a gap don't count."""
    raw, total = np.frombuffer(f" {(text or '').lower()} ".encode(errors="replace"), np.uint8), np.zeros(SLOTS, np.int64)
    for at in range(0, len(raw) - 2, PIECE):
        b = KEEP[raw[at : at + PIECE + 2]]
        code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[b[1:-1] != 32]
        total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=SLOTS)
    return total.astype(np.float32)


def length_class(n: np.ndarray) -> np.ndarray:
    """Which of ``CLASSES`` a number of trigrams falls into, by powers of two."""
    return np.clip(np.log2(np.maximum(n, 1)).astype(int), 0, CLASSES - 1)


def floors_of(cos: np.ndarray, n: np.ndarray, slack: float, least: int = 12) -> np.ndarray:
    """A floor for each class of length: slack times the least cosine of its rows and all longer ones.

    A class with few rows of its own takes the floor of the next shorter one.
    """
    of, out, held = length_class(n), np.zeros(CLASSES), 0.0
    for c in range(CLASSES):
        if (of == c).sum() >= least:
            held = slack * float(cos[of >= c].min())
        out[c] = held
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    return weighted(np.stack([counts(t) for t in texts]) if texts else np.zeros((0, SLOTS), np.float32), idf)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fold(id_col: Column) -> Column:
    """Remainder of the id's CRC-32 by four; a null id has none."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # least cosine of each centroid's language, by class of length

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        lang, score, far = [], [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            x = np.stack([counts(t) for t in part])
            cos = weighted(x, self.idf) @ self.centroids.T
            for t, best, row, size in zip(part, cos.argmax(1), cos, length_class(x.sum(1)), strict=True):
                seen = bool(t and LETTER.search(t))
                lang.append(self.languages[best] if seen else "und")
                score.append(float(min(max(row[best], 0), 1)) if seen else 0.0)
                far.append(not seen or bool(row[best] <= self.floors[best, size]))
        return lang, score, far


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; seeds are rows as far apart as can be, so the fit is repeatable."""
    mean = x.mean(0)
    seeds = [int((x @ mean).argmax())]
    near = x @ x[seeds[0]]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.stack([x[of == i].sum(0) if (of == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(rows: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = 600, clusters: int = 4, slack: float = 0.7, languages: int = 1000) -> Model:
    """slack: a floor, as a share of the least cosine of the rows it is taken from."""
    rows = rows.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")

    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += counts(t) > 0
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], ["slot", "n"])

    held = np.zeros(SLOTS)
    for slot, n in rows.select("text").mapInArrow(df, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # SLOTS rows at most
        held[slot] = n
    sizes = {lang: n for lang, n in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    idf = np.log((1 + sum(sizes.values())) / (1 + held)).astype(np.float32) + 1
    if not sizes:
        return Model([], np.zeros((0, SLOTS), np.float32), idf, np.zeros((0, CLASSES)))

    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([counts(t) for t in part["text"]])
        n, x = x.sum(1), weighted(x, idf)
        c = kmeans(x, clusters)
        seen = n > 0
        floors = floors_of((x @ c.T).max(1)[seen], n[seen], slack).tolist()
        return pd.DataFrame({"lang": part["lang"].iloc[0], "floors": [floors] * len(c), "centroid": [v.tolist() for v in c]})

    fitted = sorted(drawn.groupBy("lang").applyInPandas(fit, "lang string, floors array<double>, centroid array<float>").collect(), key=lambda r: (r.lang, r.centroid))
    return Model([r.lang for r in fitted], np.array([r.centroid for r in fitted], np.float32).reshape(-1, SLOTS), idf, np.array([r.floors for r in fitted]).reshape(-1, CLASSES))


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with three columns more: the language, its score (0 to 1) and whether it is rejected.

    Columns of docs that have these names already are replaced.
    """
    docs = docs.drop(*names)
    at = docs.schema.fieldNames().index(text_col)
    added = dict(zip(names, ("string", "double", "boolean"), strict=True))
    out = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, cos, far = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(cos, pa.float64()), pa.array(far, pa.bool_())], [*b.schema.names, *added])

    return docs.mapInArrow(score, out)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that aren't rejected, a null language filled in; all other columns pass untouched, whatever their names."""
    schema = docs.schema
    text, lang = (schema.fieldNames().index(c) for c in (text_col, lang_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, _, far = model.predict(b.column(text).to_pylist())
            filled = [given if given is not None else new for given, new in zip(b.column(lang).to_pylist(), found, strict=True)]
            yield b.set_column(lang, b.schema.field(lang).name, pa.array(filled, b.schema.field(lang).type)).filter(pa.array([not x for x in far], pa.bool_()))

    return docs.mapInArrow(keep, schema)
