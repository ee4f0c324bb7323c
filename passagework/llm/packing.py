"""Operator 13: packing documents into sequences of a fixed length, by sum of squares.

A document's tokens go whole into one sequence if they fit; only longer
documents are cut, into full pieces behind a first one that takes the rest.
A piece is placed where the sum, over all gaps, of the squared numbers of open
sequences with that gap becomes smallest. That choice needs the numbers alone:
a task holds a count and a stack of open sequences for each gap.

Documents are tokenised and placed in the same pass, each task by itself, so
texts are never shuffled. A task places up to ``hold`` pieces at a time, from
long to short; then it sets free what open sequences hold and places that anew,
as long as this saves sequences. What is left open is set free once more and
placed over all tasks: those pieces, by then short rows of a key and a length,
are dealt into shards of at most ``shard`` rows and placed alike. What shards
leave open is dealt into fewer ones, until one remains or ``levels`` are done.
So no task, group or driver holds more than its share, at any size, and
sequences that stay partly empty are few: some tens for each shard of the last
level.

Tokens come from a file of the ``tokenizers`` library. Words repeat, so a worker
keeps the ids of the pieces that it has met, up to ``KEPT``, and asks the
tokenizer for new ones only. A text is cut for that at places where no token of
a byte-level vocabulary with the usual splitting pattern can go across; other
tokenizers are given whole texts (``pieces_repeat``).

A null text counts as an empty one: it has the end mark alone. A null id stays
null. Repeated rows are documents of their own. Other columns of docs don't
matter. An empty table gives an empty table. A text of any length is tokenised
block by block; its ids, four bytes a token, are held until it is cut.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

#: How many distinct pieces of texts a worker keeps the ids of, and the characters of the longest.
KEPT, LONGEST = 500_000, 64

#: Letters that every version of Unicode has as such, within Latin-1.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A word with the one white space before it: after it comes ASCII without letters, and before it white space, a digit or a mark that can't begin a contraction.
WORD = rf"((?:[ \n]|(?<![^0-9!-&(-/:-@\[-`{{-~]))[{LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z))"
#: A long text is cut before such a space.
BLOCK, CUT = 1 << 20, rf"(?<=[{LETTERS}])(?= [{LETTERS}])"


def public(name: str) -> str:
    """The path of an installed public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def kept_by_worker(name: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next; one thing for each name, made anew for another key."""
    kept = vars(sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")))
    if kept.get(name, (None, None))[0] != key:
        kept[name] = (key, make())
    return kept[name][1]


class Pieces(dict):
    """The ids of pieces of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the name of a special token within a text is text
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(0x100) if b not in printed]
        self.shown = dict(zip(printed, printed, strict=True)) | {b: 0x100 + k for k, b in enumerate(others)}  # how a byte-level model writes each byte
        self.word = re.compile(rf" ?[{LETTERS}]+")

    def __missing__(self, piece: str) -> bytes:
        if piece[0] == "\n" and len(piece) > 1 and self.word.fullmatch(piece, 1) and piece[1] != " ":
            return self["\n"] + self[piece[1:]]
        if self.word.fullmatch(piece):
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = np.array(ids, dtype="<u4").tobytes()
        if len(self) < KEPT and len(piece) <= LONGEST:
            self[piece] = found
        return found


def blocks(text: str, block: int = BLOCK) -> Iterator[str]:
    """A text in parts of about ``block`` characters, cut where no token goes across; whole if there is no such place."""
    cut, at = re.compile(CUT), 0
    while len(text) - at > block and (found := cut.search(text, at + block)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_ids(path: str, pieces_repeat: bool = True) -> Callable[[str], bytes]:
    """A function from a text to its ids."""
    known = kept_by_worker("tokens", path, lambda: Pieces(path))
    if not pieces_repeat:
        return lambda text: np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    split = re.compile(WORD).split
    return lambda text: b"".join([known[p] for part in blocks(text) for p in split(part) if p])


class Gaps:
    """Open sequences, by how much room each has left. place says where a piece goes: (sequence, offset)."""

    def __init__(self, room: int):
        self.room = room
        self.counts = np.zeros(room + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(room + 1)]
        self.n = 0  # sequences so far

    def place(self, size: int) -> tuple[int, int]:
        n, room = self.counts, self.room
        if size >= room:
            self.n += 1
            return self.n - 1, 0
        # By how much the sum of squares grows: from a gap g to g - size it is 2 (n[g - size] - n[g]) + 2; a gap of 0 or of all the room isn't counted.
        grows = 2 * (n[: room - size] - n[size:room]) + 2
        grows[0] = 1 - 2 * n[size]
        grows[n[size:room] == 0] = np.iinfo(np.int64).max
        k = int(grows.argmin())
        if grows[k] <= 2 * n[room - size] + 1:  # as good as a new one: take the open one
            gap, at = k + size, self.open[k + size].pop()
            n[gap] -= 1
        else:
            gap, at = room, self.n
            self.n += 1
        if gap > size:
            self.open[gap - size].append(at)
            n[gap - size] += 1
        return at, room - gap

    def still_open(self) -> list[int]:
        return [at for stack in self.open for at in stack]


def settled(lengths: np.ndarray, room: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sequences, offsets, whether their sequence is full, numbers used) of pieces: placed from long to short, and what open sequences hold placed anew, as long as that saves any."""
    sequence, offset, whole = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    todo = np.argsort(-lengths, kind="stable")
    used, full, least = 0, 0, len(lengths) + 1
    for _ in range(rounds):
        gaps = Gaps(room)
        places = np.array([gaps.place(n) for n in lengths[todo].tolist()], np.int64).reshape(-1, 2)
        if full + gaps.n >= least:
            break
        least = full + gaps.n
        still = gaps.still_open()
        done = ~np.isin(places[:, 0], still)
        sequence[todo], offset[todo], whole[todo] = used + places[:, 0], places[:, 1], done
        used, full, todo = used + gaps.n, full + gaps.n - len(still), todo[~done]
    return sequence, offset, whole, used


def numbered(level: int, part: int, at: int) -> int:
    """A number for a sequence: of so many levels, parts and sequences of a part that they fit a long."""
    return (level << 58) | (part << 30) | at


def first_length(n: int, room: int) -> int:
    """The length of a document's first piece; those after it are full."""
    return (n - 1) % room + 1


def _tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, room: int, end: int, hold: int, pieces_repeat: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids, key, sequence_id, offset): pieces, placed by the task that made them; without a place if what they were in stayed open.

    A task holds back the first pieces of at most ``hold`` documents, which it
    then places together; all other pieces are full.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = docs.select(F.col(id_col).alias("doc_id")).withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "ids": F.lit(b""), "key": F.lit(0).cast("long"), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}).schema
    mark = np.array([end], dtype="<u4").tobytes()

    def made(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids_of = TaskContext.get().partitionId(), token_ids(path, pieces_repeat)
        n_sequences, key = 0, part << 33
        held: list[tuple] = []  # (doc, piece, start, ids, key)
        out: list[tuple] = []
        kind = None

        def batch() -> pa.RecordBatch:
            doc, piece, start, ids, keys, seq, off = zip(*out, strict=True) if out else [()] * 7
            out.clear()
            columns = [pa.array(doc, kind), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def place() -> None:
            nonlocal n_sequences
            at, offset, whole, used = settled(np.array([len(p[3]) // 4 for p in held], np.int64), room)
            out.extend((*p, numbered(0, part, n_sequences + a), o) if w else (*p, None, None) for p, a, o, w in zip(held, at.tolist(), offset.tolist(), whole.tolist(), strict=True))
            n_sequences += used
            held.clear()

        for frame in frames:
            kind, size = frame.schema.field(0).type, 0
            for doc, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + mark
                n = len(ids) // 4
                first = first_length(n, room)
                held.append((doc, 0, 0, ids[: 4 * first], key))
                key += 1
                for k, start in enumerate(range(first, n, room)):
                    out.append((doc, k + 1, start, ids[4 * start : 4 * (start + room)], key, numbered(0, part, n_sequences), 0))
                    n_sequences += 1
                    key += 1
                if len(held) >= hold:
                    place()
                size += len(ids)
                if size > 4 << 20 and out:
                    yield batch()
                    size = 0
            if out:
                yield batch()
        if held:
            place()
            yield batch()

    return rows.mapInArrow(made, schema)


def _placed(rows: DataFrame, shards: int, level: int, room: int) -> DataFrame:
    """(key, length, sequence_id, offset, whole) of rows (key, length): dealt into shards by key, each placed from long to short; whole says if the sequence is full."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # at most a shard's rows, of two numbers each
        if held:
            frame = pd.concat(held, ignore_index=True)
            at, offset, whole, _ = settled(frame["length"].to_numpy(np.int64), room)
            yield frame.assign(sequence_id=numbered(level, TaskContext.get().partitionId(), 0) + at, offset=offset, whole=whole)

    dealt = rows.repartition(shards, F.xxhash64("key")).sortWithinPartitions("key")
    return dealt.mapInPandas(place, "key long, length long, sequence_id long, offset long, whole boolean")


def placed(rows: DataFrame, room: int, shard: int = 50_000, levels: int = 4) -> DataFrame:
    """(key, sequence_id, offset) of rows (key, length), in as few sequences as the method finds."""
    done: list[DataFrame] = []
    for level in range(1, levels + 1):
        shards = -(-rows.count() // shard)
        if not shards:
            break
        found = materialised(_placed(rows, shards, level, room))  # a task for each shard, whose number is in its sequences'
        last = shards == 1 or level == levels
        done.append((found if last else found.where("whole")).select("key", "sequence_id", "offset"))
        if last:
            break
        rows = found.where("not whole").select("key", "length")
    out = done[0] if done else rows.select("key", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for more in done[1:]:
        out = out.union(more)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", room: int = 1024, end: int = 2, hold: int = 10_000, shard: int = 50_000, pieces_repeat: bool = True, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): where each piece of each document goes.

    tokenizer: the path of its file, the same on all executors. end: the id put
    after each document. ids: little-endian unsigned 32-bit numbers. start:
    how many of its document's ids come before a piece. Places of pieces that
    tasks left open are broadcast up to ``broadcast_rows`` rows of 24 bytes,
    which are counted, and joined by shuffle beyond.
    """
    made = materialised(_tokenised(docs, id_col, text_col, tokenizer, room, end, hold, pieces_repeat), compression="zstd")
    free = made.where("sequence_id is null")
    places = materialised(placed(free.select("key", "length"), room, shard), few=True)
    few = places.count() <= broadcast_rows
    found = free.drop("sequence_id", "offset").join(F.broadcast(places) if few else places, "key")
    return made.where("sequence_id is not null").unionByName(found).drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, documents): the ids of each sequence in order, and which documents' pieces they are. A group holds no more than a sequence's room."""
    piece = F.struct("offset", "ids", "doc_id", "piece", "length")
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("length").alias("length"))
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("sequence_id", "length", ids.alias("ids"), F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["length"].alias("length"))).alias("documents"))
