"""From paragraphs to passages: long ones cut, short ones packed with overlap, references taken out.

Packing is a fold over the units of a run of one section, in order: a passage
never goes over from one section to the next. Only lengths enter it: a task is
given numbers, never texts, and answers with the units of each passage. Runs of
a manual are packed apart and their passages then numbered through.

All that a fold knows when it begins a passage is the unit that didn't fit into
the one before. So each unit has a pointer to the unit that would begin the next
passage if it began one itself, found by searching running totals, and the fold
is the way from the first unit along pointers. Keys of at most ``BLOCK`` rows
are walked where they are. A longer one is cut into blocks, each with the few
rows around it that pointers from within can reach. A block tells, for the few
units at its head on which a way can enter, where that way leaves it; these
pointers are doubled by joins until they span the key, which tells where the
fold enters each block; then all blocks are walked at once. So a key that holds
a third of all rows is folded by as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_references
from ..scratch import stored as written
from . import pages as P
from .ranking import ranked

TARGET, OVERLAP, BLOCK = 1200, 150, 20_000


def pieces(text: str, target: int) -> list[str]:
    """The pieces of a text, each of at most ``target`` characters.

    A piece ends at the last space before the target if that leaves more than
    half of it, else at the target. The place in the text is all that is kept,
    so a text of any length takes one pass.
    """
    out, at = [], 0
    end = len(text)
    while end - at > target:
        cut = text.rfind(" ", at, at + target)
        cut = cut if cut - at > target // 2 else at + target
        out.append(text[at:cut].strip())
        at = cut
        while at < end and text[at].isspace():
            at += 1
        while at < end and text[end - 1].isspace():
            end -= 1
    if at < end or not out:
        out.append(text[at:end])
    return out


def split_long(text: Column, target: int = TARGET) -> Column:
    """The pieces of each text; a null has none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else pieces(t, target))

    long = F.char_length(text) > target
    short = F.when(text.isNull(), F.array().cast("array<string>")).when(~long, F.array(text))
    return short.otherwise(cut(F.when(long, text)))  # a task's Python is handed the long ones alone


def units(pages: DataFrame, target: int = TARGET, stored: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(manual_id, run, ord, para, piece, page, printed, section, text): what is packed, by runs of one section. Lines are used for the text alone, their edges for heads and marks; stored: see ``passages``."""
    rows = stored(P.page_rows(pages))
    marks = stored(P.marks(rows, stored(P.chrome(rows))))
    held = P.section_runs(stored(P.sections(marks)))
    text = P.paragraphs(P.with_body(rows, held), "printed", "section", "run")
    return text.select("manual_id", "run", "ord", "para", "page", "printed", "section", F.posexplode_outer(split_long(F.col("text"), target)).alias("piece", "text"))  # no filter on what Python gives


@dataclass(frozen=True)
class Filling:
    """Passages of at most ``target`` characters where units allow it; each begins with the last units of the one before, as far as those have at most ``overlap``."""

    target: int
    overlap: int

    @property
    def reach(self) -> tuple[int, int]:
        """How many units before and after one its pointers can go to, if each has a character or more."""
        return self.overlap + 1, self.target + 2

    def pointers(self, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit, if it is the first new one of a passage: the unit that the passage begins with, and the first that no longer fits. low, high: its section."""
        total = np.concatenate(([0], np.cumsum(sizes)))
        start = np.maximum(np.searchsorted(total, total[:-1] - self.overlap, "left"), low)
        beyond = np.searchsorted(total, total[start] + self.target, "right") - 1
        return start, np.minimum(np.maximum(beyond, np.arange(1, len(sizes) + 1)), high)


@dataclass(frozen=True)
class Batching:
    """Requests of at most ``most`` texts and ``chars`` characters; an oversized text goes alone."""

    most: int
    chars: int

    @property
    def reach(self) -> tuple[int, int]:
        return 0, self.most + 1

    def pointers(self, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, at = np.concatenate(([0], np.cumsum(sizes))), np.arange(len(sizes))
        beyond = np.searchsorted(total, total[:-1] + self.chars, "right") - 1
        return at, np.minimum(np.minimum(np.maximum(beyond, at + 1), at + self.most), high)


class Batcher:
    """Gathers texts that come one by one into requests, by the rule of ``Batching``."""

    def __init__(self, most: int, chars: int):
        self.most, self.chars = most, chars
        self.batch = self.n = self.held = 0

    def add(self, size: int) -> int:
        """The number of the request that this text goes into."""
        if self.n and (self.n >= self.most or self.held + size > self.chars):
            self.batch, self.n, self.held = self.batch + 1, 0, 0
        self.n, self.held = self.n + 1, self.held + size
        return self.batch


def _bounds(frame: pd.DataFrame, by: list[str], section: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first rows of the keys, first rows of the sections, and for each row the bounds of its section)."""

    def differs(c: str) -> np.ndarray:
        v = frame[c]
        return ~((v == v.shift()) | (v.isna() & v.shift().isna())).to_numpy(bool)

    key = np.logical_or.reduce([np.arange(len(frame)) == 0, *map(differs, by)])
    part = key | differs(section) if section else key
    keys, parts = np.flatnonzero(key), np.flatnonzero(part)
    of = np.cumsum(part) - 1
    return keys, parts, parts[of], np.append(parts[1:], len(frame))[of]


def _way(pointers: list[int], start: int, end: int) -> list[int]:
    way = []
    while start < end:
        way.append(start)
        start = pointers[start]
    return way


def _whole_keys(frames: Iterator[pd.DataFrame], by: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames of about so many, none of which cuts a key."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            whole = pd.concat(held, ignore_index=True)
            last = int(_bounds(whole, by, None)[0][-1])
            if last:
                yield whole[:last]
            held = [whole[last:].reset_index(drop=True)]
            n = 0 if last else n  # what is left is one key
    if held and len(whole := pd.concat(held, ignore_index=True)):
        yield whole


def _groups(frame: pd.DataFrame, starts: list[int], ends: list[int], number: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, numbers) of groups that are ranges of rows."""
    a, n = np.array(starts, np.int64), np.array(ends, np.int64) - np.array(starts, np.int64)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    return rows, np.repeat(np.array(number, np.int64), n)


def _folded(rows: DataFrame, by: list[str], order: list[str], size: str, section: str | None, rule: Filling | Batching, name: str, block: int) -> DataFrame:
    """(by.., name, at, order..): the groups of rows that the rule makes of each key, in order."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [c for c in order if c != "at"]
    columns, schema = [*by, name, "at", *kept], ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{name} int, at int", *(f"{c} {kinds[c]}" for c in kept)])
    slim = rows.select(*by, *order, size, *([section] if section else []))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_keys(frames, by):
            keys, _, low, high = _bounds(frame, by, section)
            start, after = rule.pointers(frame[size].to_numpy(np.int64), low, high)
            pointers, ways, number = after.tolist(), [], []
            for a, b in zip(keys.tolist(), [*keys[1:].tolist(), len(frame)], strict=True):
                way = _way(pointers, a, b)
                ways += way
                number += range(len(way))
            at, group = _groups(frame, start[ways], after[ways], number)
            first = keys[np.searchsorted(keys, at, "right") - 1]
            yield pd.DataFrame({**{c: frame[c].to_numpy()[at] for c in by}, name: group, "at": at - first, **{c: frame[c].to_numpy()[at] for c in kept}})[columns]

    counted = slim.groupBy(*by).count()
    large = written(counted.where(F.col("count") > block))
    if not large.take(1):
        return slim.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(fold, schema)
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in by))
    small = slim.alias("s").join(large.alias("l"), same("s", "l"), "left_anti").repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(fold, schema)
    split = slim.alias("s").join(large.alias("l"), same("s", "l"), "left_semi")
    return small.union(_blocks(split, by, order, size, section, rule, name, block).select(columns))


def _blocks(rows: DataFrame, by: list[str], order: list[str], size: str, section: str | None, rule: Filling | Batching, name: str, block: int) -> DataFrame:
    """As ``_folded``, of keys that are cut into blocks."""
    back, ahead = rule.reach
    block = max(block, back + ahead)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [c for c in order if c != "at"]
    told = ", ".join(f"{c} {kinds[c]}" for c in by)
    numbered = ranked(rows, by, order, "_at", first=0)
    home, within = F.floor(F.col("_at") / block), F.col("_at") % block
    # A row goes to its block, to the one before if pointers from there reach it, and to the one after if that looks back to it.
    copies = F.array_compact(F.array(home, F.when((within < ahead) & (home > 0), home - 1), F.when(within >= block - back, home + 1)))
    dealt = written(numbered.withColumn("_block", F.explode(copies)))
    key = [*by, "_block"]

    def pointed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """(start, after, places) of a frame of whole blocks, and (first, own first, own end, end) of each block."""
        keys, _, low, high = _bounds(frame, key, section)
        start, after = rule.pointers(frame[size].to_numpy(np.int64), low, high)
        place, ends = frame["_at"].to_numpy(np.int64), [*keys[1:].tolist(), len(frame)]
        of = frame["_block"].to_numpy(np.int64)
        spans = [(a, a + int(np.searchsorted(place[a:b], of[a] * block)), a + int(np.searchsorted(place[a:b], (of[a] + 1) * block)), b) for a, b in zip(keys.tolist(), ends, strict=True)]
        return start, after, place, [x for x in spans if x[1] < x[2]]  # a block may get rows of its neighbours alone

    def left(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(by.., x, y): of units at a block's head, the first beyond the block that the way from there comes to; none if the key ends."""
        for frame in _whole_keys(frames, key):
            _, after, place, spans = pointed(frame)
            out: list[tuple[int, int, int | None]] = []
            pointers = after.tolist()
            for _, a, b, end in spans:
                leaves = pointers[a:b]
                for j in range(b - a - 1, -1, -1):
                    if leaves[j] < b:
                        leaves[j] = leaves[leaves[j] - a]
                out += [(j, int(place[j]), int(place[y]) if (y := leaves[j - a]) < end else None) for j in range(a, min(a + ahead, b))]
            at = [j for j, _, _ in out]
            yield pd.DataFrame({**{c: frame[c].to_numpy()[at] for c in by}, "x": [x for _, x, _ in out], "y": pd.array([y for _, _, y in out], "Int64")})

    ordered = lambda d: d.repartition(*key).sortWithinPartitions(*key, "_at")
    jumps = written(ordered(dealt).mapInPandas(left, f"{told}, x long, y long"))
    entered = jumps.where("x = 0").select(*by, F.col("x").alias("at"))
    most = dealt.agg(F.max("_block")).first()[0] + 1
    to = lambda d, names: d.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(by)), *names)
    same = lambda a, b: F.expr(" and ".join([f"{c} <=> _{k}" for k, c in enumerate(by)] + [f"{a} = {b}"]))
    for _ in range(max(1, (most - 1).bit_length())):
        on = to(jumps, [F.col("x").alias("_x"), F.col("y").alias("_y")])
        entered = written(entered.union(entered.join(on, same("at", "_x")).where("_y is not null").select(*by, "_y")).distinct())
        jumps = written(jumps.join(on, same("y", "_x")).select(*by, "x", F.col("_y").alias("y")).where("y is not null"))

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_keys(frames, key):
            start, after, place, spans = pointed(frame)
            pointers, entry = after.tolist(), frame["_entry"].to_numpy(np.int64)
            ways: list[int] = []
            number: list[int] = []
            for first, a, b, _ in spans:
                way = _way(pointers, first + int(np.searchsorted(place[first:b], entry[a])), b)
                ways += way
                number += range(len(way))
            at, group = _groups(frame, start[ways], after[ways], number)
            of = np.repeat(frame["_block"].to_numpy(np.int64)[ways], after[ways] - start[ways])
            yield pd.DataFrame({**{c: frame[c].to_numpy()[at] for c in by}, "_block": of, name: group, "at": place[at], **{c: frame[c].to_numpy()[at] for c in kept}})

    ways = to(entered, [F.floor(F.col("at") / block).alias("_in"), F.col("at").alias("_entry")])
    walks = ordered(dealt.join(ways, same("_block", "_in")).select(*dealt.columns, "_entry"))
    out = written(walks.mapInPandas(walked, f"{told}, _block long, {name} long, at int" + "".join(f", {c} {kinds[c]}" for c in kept)))
    counts = out.groupBy(*key).agg((F.max(name) + 1).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a key's blocks, not its rows
    before = to(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), [F.col("_block").alias("_in"), "_before"])
    return out.join(before, same("_block", "_in")).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).select(*by, name, "at", *kept)


def pack(rows: DataFrame, by: list[str], order: list[str], size: str, section: str | None = None, target: int = TARGET, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(by.., chunk, at, order..): which units, numbered from 0 in order, each passage of a manual takes.

    Sizes are 1 or more: a unit has text. Units tell their order apart.
    """
    return _folded(rows, by, order, size, section, Filling(target, overlap), "chunk", block)


def passages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, stored: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(chunk_id, manual_id, ord, section, pages, printed, refs, figures, text) of the pages' manuals.

    Units are used twice, for their lengths and for their texts, and so are
    marks, sections and packed units. stored: what writes a table and reads it
    again, so that each is made but once.
    """
    order = ["ord", "para", "piece"]
    found = stored(units(pages, target, stored))
    sized = found.select("manual_id", "run", *order, "section", F.char_length("text").alias("size"))
    packed = stored(pack(sized, ["manual_id", "run"], order, "size", "section", target, overlap))
    counts = packed.groupBy("manual_id", "run").agg((F.max("chunk") + 1).alias("n"))
    numbered = packed.join(P.running_total(counts, "manual_id", "run", "n", "before").drop("n"), ["manual_id", "run"])
    numbered = numbered.withColumn("chunk", (F.col("before") + F.col("chunk")).cast("int")).drop("before", "run")
    taken = found.join(numbered, ["manual_id", *order])
    whole = taken.groupBy("manual_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "page", "printed", "section", "text"))).alias("u"))
    text = strip_references(F.array_join(F.transform("u", lambda x: x["text"]), "\n"))
    whole = whole.withColumn("cleaned", text)
    return whole.select(
        F.format_string("%s:%05d", "manual_id", "chunk").alias("chunk_id"),
        "manual_id",
        F.col("chunk").alias("ord"),
        F.element_at("u", 1)["section"].alias("section"),
        F.array_sort(F.array_distinct(F.transform("u", lambda x: x["page"]))).alias("pages"),
        F.array_distinct(F.filter(F.transform("u", lambda x: x["printed"]), lambda x: x.isNotNull())).alias("printed"),
        "cleaned.refs",
        "cleaned.figures",
        "cleaned.text",
    )


def batches(rows: DataFrame, by: list[str], order: list[str], size: str, most: int = 50, chars: int = 80_000, block: int = BLOCK) -> DataFrame:
    """(by.., batch, at, order..): which texts, numbered from 0, each request takes; an oversized text goes alone."""
    return _folded(rows, by, order, size, None, Batching(most, chars), "batch", block)
