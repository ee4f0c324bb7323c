"""Operator 5: exact substring dedup with suffix arrays by linear grouping.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
earlier in the corpus. No suffix array of a whole corpus fits a task, so
suffixes are dealt out by content: each window of LENGTH bytes belongs to an
anchor, the smallest of the hashes of its runs of ``GRAM`` bytes, and equal
windows have equal anchors at equal distances.

The table is read once and stored as parts of bounded size; all steps read
those, so it doesn't matter how often or in what splits the table would be read.

1. Each part's anchors go out, packed, by ranges of hashes; a range's task
   answers which anchors occur more than once. All other text is done with.
2. Each part cuts out the segments of its repeated anchors: the bytes of all
   windows that belong to one. Segments that repeat within the part are settled
   there; the rest go out by ranges of hashes.
3. In a range, a segment met before is a copy as a whole. Anchors of which
   segments differ, as about an edit or at the end of a passage, have the texts
   to the right of the anchor, and those to its left, reversed, written as
   symbols of eight bytes counted from the anchor. One suffix array of all of
   them, made by linear grouping, puts contexts in order; common prefixes of
   neighbours then tell for each distance which windows are equal and which of
   those is the earliest.
4. The spans return to their parts and are cut from the texts.

An anchor that occurs ``hot`` times or more would bring its many contexts to
one task. Its windows go out one by one instead, by digests of their own, which
gives the same result; for those the method is hashing and no suffix array.

Rows are put back together by the stored number of their part. Rows that repeat
an id and text are one document; texts under one id are ranked by a hash of the text. A null
id ranks before all others, as does -2^63, which is taken for it; null and empty
texts have nothing to remove. A text of any length is one part, hashed piece by
piece; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, text_bytes
from .suffix_sort import suffix_array

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1  # runs of GRAM bytes in a window
SYMBOL = 8
PIECE = 1 << 20  # bytes of one document hashed at a time
PART = 6 << 20  # bytes of the texts that a part takes, of one table partition; a longer text is a part of its own
PARTS = 1_000_000  # a table partition has fewer
GROUP = 16 << 20  # bytes of a row group of the stored parts
NO_ID = -(1 << 63)
ROWS = "bucket int, part long, body binary"
U64 = np.uint64
OUT = "doc long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def packed(**columns: np.ndarray | bytes) -> bytes:
    """Columns as one compressed value."""
    head, body = [], []
    for name, c in columns.items():
        raw, kind = (c, "S") if isinstance(c, bytes) else (np.ascontiguousarray(c).tobytes(), c.dtype.str)
        head.append(f"{name}:{kind}:{len(raw)}")
        body.append(raw)
    return zstandard.ZstdCompressor(1).compress(";".join(head).encode() + b"\n" + b"".join(body))


def unpacked(value: bytes) -> dict[str, np.ndarray | bytes]:
    head, _, body = zstandard.ZstdDecompressor().decompress(value).partition(b"\n")
    out, at = {}, 0
    for name, kind, size in (x.split(":") for x in head.decode().split(";")):
        raw = body[at : at + int(size)]
        out[name] = raw if kind == "S" else np.frombuffer(raw, kind)
        at += int(size)
    return out


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes, built up by doubling."""
    h = b.astype(U64) * U64(0x9E3779B97F4A7C15)
    width = 1
    while width < GRAM:
        h = h[:-width] * U64(0xC2B2AE3D27D4EB4F) + (h[width:] ^ (h[width:] >> U64(29)))
        h ^= h >> U64(32)
        width *= 2
    return h * U64(0x9E3779B97F4A7C15)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first window, last window) of the runs of windows of a text that belong to one anchor."""
    found = []
    for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
        h = gram_hashes(np.frombuffer(text, np.uint8, min(PIECE + LENGTH - 1, len(text) - at), at))
        best = (h >> U64(24) << U64(24)) | np.arange(len(h), dtype=U64)  # the leftmost of equal hashes
        width = 1
        while width * 2 <= REACH:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        rest = REACH - width
        best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
        owner = (best & U64((1 << 24) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        a = owner[lo]
        found.append((h[a], a + at, lo + at, np.r_[lo[1:], len(owner)] - 1 + at))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)


def _text(t: str | None) -> bytes:
    return t.encode(errors="surrogatepass") if t else b""


def _range(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The range that a hash goes to. Anchors are minima, so they are mixed once more to lie evenly."""
    return ((hashes ^ (hashes >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(64 - bits)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(bucket) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _record(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, p, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int64()), pa.array(body, pa.binary())], ["bucket", "part", "body"])


def _frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "part", "body"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(part, ids, texts) of a table partition; numbered once, when the parts are stored."""
    part, ids, texts, n = TaskContext.get().partitionId() * PARTS, [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(NO_ID if d is None else d)
            texts.append(_text(t))
            n += len(texts[-1])
            if n >= PART:
                yield part, ids, texts
                part, ids, texts, n = part + 1, [], [], 0
    if ids:
        yield part, ids, texts


def _anchors_out(bits: int):
    """Step 1, for one part: its anchors by range."""

    def send(found: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = np.unique(np.concatenate([anchors(t)[0] for *_, t in _documents(found)]), return_counts=True)
        bucket = _range(hashes, bits)
        return _frame([(b, int(found["part"].iloc[0]), packed(h=hashes[at], k=np.minimum(counts[at], 65535).astype(np.uint16))) for b, at in _slices(bucket)])

    return send


def _repeated(hot: int):
    def answer(found: pd.DataFrame) -> pd.DataFrame:
        bodies = [unpacked(b) for b in found["body"]]
        hashes, counts = np.concatenate([b["h"] for b in bodies]), np.concatenate([b["k"] for b in bodies]).astype(np.int64)
        whole, back = np.unique(hashes, return_inverse=True)
        total = np.bincount(back, counts)[back]
        out, at = [], 0
        for part, b in zip(found["part"], bodies, strict=True):
            t = total[at : at + len(b["h"])]
            at += len(b["h"])
            if (keep := t > 1).any():
                out.append((0, part, packed(h=b["h"][keep], hot=t[keep] >= hot)))
        return _frame(out)

    return answer


def _texts_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each part, packed."""
    for part, ids, texts in _parts(batches):
        key = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], U64)
        yield _record([(-1, part, packed(doc=np.array(ids, np.int64), n=np.array([len(t) for t in texts], np.int64), key=key, text=b"".join(texts)))])


def _documents(found: pd.DataFrame) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, doc, key, text) of the texts of a part."""
    for body in found["body"]:
        b = unpacked(body)
        ends = np.cumsum(b["n"])
        for i, (d, k, e, n) in enumerate(zip(b["doc"].tolist(), b["key"].tolist(), ends.tolist(), b["n"].tolist(), strict=True)):
            yield i, d, k, b["text"][e - n : e]


def _segments(bits: int, chunk: int = 200_000):
    """Step 2, for one part: its segments by range, and the spans settled here."""

    def cut(held: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        answers = [unpacked(b) for b in found["body"]]
        if not answers:
            return _frame([])
        part = int(held["part"].iloc[0])
        known, hot = np.concatenate([a["h"] for a in answers]), np.concatenate([a["hot"] for a in answers])
        known, at = np.unique(known, return_index=True)
        hot = hot[at]
        texts: dict[int, bytes] = {}
        rows: list[np.ndarray] = []  # h, a, lo, hi, row, doc, key, single
        for row, doc, key, text in _documents(held):
            h, a, lo, hi = anchors(text)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            if not (mine := known[i] == h).any():
                continue
            texts[row] = text
            h, a, lo, hi, is_hot = h[mine], a[mine], lo[mine], hi[mine], hot[i[mine]]
            if is_hot.any():  # its windows, one by one
                n = (hi - lo + 1) * is_hot
                p = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h, a, lo, hi, single = (np.r_[x[~is_hot], y] for x, y in ((h, np.repeat(h, n)), (a, np.repeat(a, n)), (lo, p), (hi, p), (np.zeros(len(h), bool), np.ones(len(p), bool))))
            else:
                single = np.zeros(len(h), bool)
            rows.append(np.stack([h.view(np.int64), a, lo, hi, np.full(len(h), row), np.full(len(h), doc), np.full(len(h), np.array(key, U64).view(np.int64)), single]))
        if not rows:
            return _frame([])
        h, a, lo, hi, row, doc, key, single = np.concatenate(rows, 1)
        digest = np.empty((len(h), 2), U64)
        for i, (r, s, e, x) in enumerate(zip(row.tolist(), lo.tolist(), hi.tolist(), a.tolist(), strict=True)):
            d = xxhash.xxh3_128_intdigest(texts[r][s : e + LENGTH], x - s)
            digest[i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
        order = np.lexsort((lo, key, doc, digest[:, 1], digest[:, 0]))
        new = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(1)]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = (doc[order] != doc[first]) | (key[order] != key[first]) | (lo[order] != lo[first])
        done, stay = order[later], np.sort(order[~later])
        out = [(-1 - part % 64, part, packed(row=row[done], start=lo[done], stop=hi[done] + LENGTH))] if len(done) else []
        # A single window goes by its own digest, all others by their anchor.
        route = np.where(single[stay] == 1, digest[stay, 0], h[stay].view(U64))
        for b, at in _slices(_range(route, bits)):
            for c in range(0, len(at), chunk):
                i = stay[at[c : c + chunk]]
                body = b"".join(texts[r][s : e + LENGTH] for r, s, e, one in zip(row[i].tolist(), lo[i].tolist(), hi[i].tolist(), single[i].tolist(), strict=True) if not one)
                out.append((b, part, packed(h=h[i].view(U64), a=a[i], lo=lo[i], hi=hi[i], row=row[i], doc=doc[i], key=key[i], single=single[i].astype(np.uint8), d=digest[i], text=body)))
        return _frame(out)

    return cut


def equal_windows(group: np.ndarray, near: np.ndarray, far: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which windows have an equal one in an earlier segment: a boolean for each segment and distance.

    Segments are in their order in the corpus. near and far: the least and most
    bytes from a window's start to the anchor. right and left: bytes from the
    anchor on, and before it reversed, in rows padded with zeros to a multiple
    of SYMBOL.
    """
    m = len(group)
    sides = []
    for side, size in ((right, LENGTH - near), (left, far)):
        blocks = side.reshape(m, -1, SYMBOL).view(">u8")[:, :, 0].astype(U64)
        sides.append((blocks, np.arange(blocks.shape[1]) < -(-size // SYMBOL)[:, None]))
    alphabet = np.unique(np.concatenate([b[held] for b, held in sides]))
    # The text: for each segment its anchor's symbol, above all blocks and apart for either side, then the blocks.
    parts, starts, at = [], [], 0
    for k, (blocks, held) in enumerate(sides):
        symbols = np.concatenate([(len(alphabet) + 2 * group + k)[:, None], np.searchsorted(alphabet, blocks)], 1)
        used = np.concatenate([np.ones((m, 1), bool), held], 1)
        parts.append(symbols[used])
        starts.append(at + np.cumsum(used.sum(1)) - used.sum(1))
        at += len(parts[-1])
    ranked = suffix_array(np.concatenate(parts))
    place = np.empty(at, np.int64)
    place[ranked] = np.arange(at)
    classes = []
    for side, start in zip((right, left), starts, strict=True):
        order = np.argsort(place[start])
        differ = side[order][1:] != side[order][:-1]
        common = np.where(differ.any(1), differ.argmax(1), side.shape[1])
        common[group[order][1:] != group[order][:-1]] = -1
        classes.append((order, np.r_[-1, common]))
    found = np.zeros((m, REACH), bool)
    ids = np.empty((2, m), np.int64)
    for x in range(REACH):
        own = np.flatnonzero((near <= x) & (x <= far))
        if len(own) < 2:
            continue
        for k, depth in enumerate((LENGTH - x, x)):
            order, common = classes[k]
            ids[k][order] = np.cumsum(common < depth)
        _, first, back = np.unique(ids[0][own] * (m + 1) + ids[1][own], return_index=True, return_inverse=True)
        found[own, x] = first[back] != np.arange(len(own))
    return found


def _settle(found: pd.DataFrame) -> pd.DataFrame:
    """Step 3, for one range of anchors: the spans of its segments, by partition."""
    if found["bucket"].iloc[0] < 0:
        return found
    bodies = [unpacked(b) for b in found["body"]]
    h, a, lo, hi, row, doc, key, single = (np.concatenate([b[c] for b in bodies]) for c in ("h", "a", "lo", "hi", "row", "doc", "key", "single"))
    digest = np.concatenate([b["d"].reshape(-1, 2) for b in bodies])
    part = np.repeat(found["part"].to_numpy(), [len(b["h"]) for b in bodies])
    text = np.frombuffer(b"".join(b["text"] for b in bodies), np.uint8)
    size = np.where(single == 1, 0, hi - lo + LENGTH)
    begin = np.cumsum(size) - size

    order = np.lexsort((lo, key, doc, digest[:, 1], digest[:, 0]))
    new = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(1)]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (doc[order] != doc[first]) | (key[order] != key[first]) | (lo[order] != lo[first])
    who, start, stop = [order[later]], [lo[order[later]]], [hi[order[later]] + LENGTH]

    # Of each digest the first stands for those that tie with it; anchors with several such have contexts to compare.
    tied, lead = order[~later], first[~later]
    leads = np.unique(lead)
    leads = leads[single[leads] == 0]
    anchor, back, count = np.unique(h[leads], return_inverse=True, return_counts=True)
    mixed = leads[count[back] > 1]
    if len(mixed):
        mixed = mixed[np.lexsort((a[mixed], key[mixed], doc[mixed]))]
        near, far = a[mixed] - hi[mixed], a[mixed] - lo[mixed]
        width = -(-LENGTH // SYMBOL) * SYMBOL
        spread = np.arange(width)
        middle = (begin[mixed] + far)[:, None]
        right = np.where(spread < (LENGTH - near)[:, None], text[np.minimum(middle + spread, len(text) - 1)], 0).astype(np.uint8)
        spread = np.arange(-(-REACH // SYMBOL) * SYMBOL)
        left = np.where(spread < far[:, None], text[np.maximum(middle - 1 - spread, 0)], 0).astype(np.uint8)
        equal = equal_windows(np.searchsorted(anchor, h[mixed]), near, far, right, left)
        edge = np.diff(np.pad(equal, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (r, x), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # distances x .. end - 1
        by_lead = np.argsort(lead, kind="stable")
        lo_, hi_ = np.searchsorted(lead[by_lead], mixed[r]), np.searchsorted(lead[by_lead], mixed[r], side="right")
        n = hi_ - lo_
        i = np.repeat(np.arange(len(r)), n)
        members = tied[by_lead[np.repeat(lo_, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        who.append(members)
        start.append(a[members] - end[i] + 1)
        stop.append(a[members] - x[i] + LENGTH)
    who, start, stop = np.concatenate(who), np.concatenate(start), np.concatenate(stop)
    return _frame([(0, p, packed(row=row[who[at]], start=start[at], stop=stop[at])) for p, at in _slices(part[who])])


def _cut(held: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Step 4, for one part: its documents without the spans."""
    spans = [unpacked(b) for b in found["body"]]
    row, start, stop = (np.concatenate([s[c] for s in spans]) if spans else np.zeros(0, np.int64) for c in ("row", "start", "stop"))
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    out = []
    for r, doc, _, text in _documents(held):
        i, j = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
        runs, kept, last = [], [], 0
        if j > i:
            reach = np.maximum.accumulate(stop[i:j])
            new = np.flatnonzero(np.r_[True, start[i + 1 : j] > reach[:-1]])
            runs = list(zip(start[i:j][new].tolist(), reach[np.r_[new[1:], j - i] - 1].tolist(), strict=True))
        for s, e in runs:
            kept.append(text[last:s])
            last = e
        kept.append(text[last:])
        out.append((None if doc == NO_ID else doc, len(text), sum(e - s for s, e in runs), [{"start": s, "stop": e} for s, e in runs], b"".join(kept)))
    frame = pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "spans", "kept"])
    frame["doc"] = frame["doc"].astype("Int64")
    return frame


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6 << 20, hot: int = 5000) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept binary) of every row; offsets in bytes of the original."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    bits = max(6, (text_bytes(rows) // bucket_bytes).bit_length())
    # The three uses of the parts share one exchange.
    parts = materialised(rows.mapInArrow(_texts_out, ROWS), **{"parquet.block.size": GROUP}).groupBy("part")
    repeated = parts.applyInPandas(_anchors_out(bits), ROWS).groupBy("bucket").applyInPandas(_repeated(hot), ROWS)
    segments = parts.cogroup(repeated.groupBy("part")).applyInPandas(_segments(bits), ROWS)
    spans = segments.groupBy("bucket").applyInPandas(_settle, ROWS)
    return parts.cogroup(spans.groupBy("part")).applyInPandas(_cut, OUT).withColumnRenamed("doc", id_col)
