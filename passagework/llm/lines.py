"""Operator 2: substring dedup by line, sentence and paragraph hashing.

Every line, every sentence of a line of several, and every paragraph (a run of
adjacent lines) of several lines is a unit. A line, sentence or paragraph may
be the copy of any of the three. Units are
normalised (lower case, runs of anything but letters and digits as one space),
digested to 128 bits and grouped over the whole corpus. The occurrence with the
smallest document id, then start, is the first; every other is a repeat.

A short unit repeats by chance: a greeting, a list mark, a stock sentence. So
repeats that follow one another, with nothing but white space between, are one
block, and a block is cut out of its text when it has ``block`` words or more;
a character of a script without spaces counts as a word. Offsets of what
is cut, in the original, are returned, and those of the shorter repeats that stay. Units of any length take part, so a
passage laid out in short lines goes as one in long lines does.

Units without a letter or digit are no units: they neither repeat nor part a
block from the next if all that stands between is white space.

A digest of which there is one occurrence never leaves its aggregation, and a
hot digest is one row after it. The join back to the units is on a written
table, so that Spark may split a hot digest's units over tasks.

Null and empty texts have no units. Rows that repeat an id and text are one
document and fare alike; different texts under one id are told apart by a hash
of the text. A null id ranks first. The time for a text grows in proportion to
its length; the units of one text are held by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

LINE = re.compile(r"[^\n]+")
#: A sentence's end: marks before white space, or full-width ones. No run is tried but from its first mark, and no mark given back.
ENDS = re.compile(r"(?<![.!?])[.!?]++(?=\s)|[。！？｡]++[」』”’）]*+")
#: Scripts written without spaces.
DENSE = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WORD = re.compile(r"[^\W_]+")
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
UNIT = "doc long, key long, start int, stop int, hi long, lo long"


def sentences(line: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a line, without the white space about them."""
    out, at = [], 0
    for end in [*(m.end() for m in ENDS.finditer(line)), len(line)]:
        piece = line[at:end]
        if bare := piece.strip():
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(bare)))
        at = end
    return out


def units_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of the units of a text."""
    held: list[list[str]] = []  # words of the lines of the paragraph at hand
    first = last = -1

    def paragraph() -> Iterator[tuple[int, int, str]]:
        # With words in one line alone it would be that line's copy.
        if sum(map(bool, held)) > 1:
            yield first, last, " ".join(w for words in held for w in words)

    for line in LINE.finditer(text):
        words = WORD.findall(line[0].lower())
        blank = not line[0].strip()
        if blank or line.start() > last + 1:
            yield from paragraph()
            held = []
        if not blank:
            first, last = first if held else line.start(), line.end()
            held.append(words)
        if words:
            yield line.start(), line.end(), " ".join(words)
            if len(pieces := sentences(line[0])) > 1:
                for a, b in pieces:
                    own = WORD.findall(line[0][a:b].lower())
                    if own and own != words:  # not the line's own copy
                        yield line.start() + a, line.start() + b, " ".join(own)
    yield from paragraph()


def weight(text: str) -> int:
    """Its words; of scripts without spaces, its characters."""
    dense = len(DENSE.findall(text))
    return dense + (len(WORD.findall(DENSE.sub(" ", text))) if dense else len(WORD.findall(text)))


def blocks(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans made one where only white space parts them."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and (s <= out[-1][1] or text[out[-1][1] : s].isspace()):
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def units(rows: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key, start, stop, hi, lo = [], [], [], [], [], []
            for d, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for s, e, unit in units_of(t or ""):
                    h = xxhash.xxh3_128_intdigest(unit)
                    doc.append(d), key.append(k), start.append(s), stop.append(e)
                    hi.append((h >> 64) - (1 << 63)), lo.append((h & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc", "key", "start", "stop", "hi", "lo"])

    return rows.mapInArrow(find, UNIT)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 25) -> DataFrame:
    """(id, n_chars, n_removed, spans array<struct<start,stop>>, short array<struct<start,stop>>, kept) of every row; offsets in code points of the original. short: the repeats that stay, as they have too few words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = materialised(units(rows))
    place = F.struct("doc", "key", "start")
    repeated = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    cuts = found.join(materialised(repeated), ["hi", "lo"]).where(~place.eqNullSafe(F.col("first")))
    cuts = cuts.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))  # as many as a text has units

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans, short, kept, last = [], [], [], 0
                for s, e in blocks(text or "", [(c["start"], c["stop"]) for c in cuts or ()]):
                    (spans if weight(text[s:e]) >= block else short).append((s, e))
                for s, e in spans:
                    kept.append(text[last:s])
                    last = e
                kept.append((text or "")[last:])
                out.append((len(text or ""), sum(e - s for s, e in spans), [{"start": s, "stop": e} for s, e in spans], [{"start": s, "stop": e} for s, e in short], "".join(kept)))
            n, removed, spans, short, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(short, SPANS), pa.array(kept, pa.string())], ["doc", "n_chars", "n_removed", "spans", "short", "kept"])

    r, c = rows.alias("r"), cuts.alias("c")
    whole = r.join(c, F.col("r.doc").eqNullSafe(F.col("c.doc")) & (F.col("r.key") == F.col("c.key")), "left").select("r.doc", "r.text", "c.cuts")
    return whole.mapInArrow(cut, "doc long, n_chars long, n_removed long, spans array<struct<start:int,stop:int>>, short array<struct<start:int,stop:int>>, kept string").withColumnRenamed("doc", id_col)
