"""Operator 11: spelling variants, found by Levenshtein automata over a trie.

Words are counted where they stand, with partial sums before the shuffle, so a
word that every document holds is a row for each task. The vocabulary, which is
what remains after a least count, is sorted by range and each stretch of it
becomes a compact trie: the letters on its edges in one string, children in
order side by side, and a leaf as soon as one word alone is left, whose rest is
compared as a whole. Tries are broadcast in rounds of at most
``broadcast_bytes``, so neither the driver nor a worker ever holds more of them,
however large the vocabulary. In each round every word's automaton of distance
one meets every trie depth-first: as long as nothing is changed each edge may be
taken by keeping, replacing, inserting or leaving out a letter; after the one
change only the path of the word's own letters is left. Of what a word meets it
keeps the number and the best; rounds are then added up.

Words are near if they differ by one code point inserted, deleted or replaced.
A word's form is its near word of largest count, of equal ones the first in
code-point order, if that count is at least ``times`` its own. Counts so grow
along forms, and the last one, the root, is reached in few steps: each step of
``roots`` doubles the way that is known.

A null text has no words; a null id counts as an empty one. Repeated rows count
each. An empty table gives an empty table. Texts of any length are matched in
the JVM in one pass. Other columns don't matter.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialised

__all__ = ["LOWER", "UPPER", "Trie", "damaged", "nearest", "roots", "variants", "vocabulary"]

# The letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"


def damaged(word: Column, id_col: Column, one_in: int = 199) -> Column:
    """A word as it stands in a document: of one in so many, told by a checksum of both, a letter is left out."""
    checksum = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (checksum % F.char_length(word)).cast("int")
    return F.when(checksum % one_in == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, one_in: int | None = 199) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences. one_in: see ``damaged``; None leaves words as they are."""
    run = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))  # shorter runs can't give a word
    # An outer explosion: for an inner one Spark would match all texts once more in a filter.
    rows = docs.select(F.col(id_col).alias("id"), F.explode_outer(run).alias("run")).where("run is not null").select("id", ascii_lower(F.col("run")).alias("run"))
    words = rows.select((F.col("run") if one_in is None else damaged(F.col("run"), F.col("id"), one_in)).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A compact trie of sorted words. Children of a node lie side by side; a node without any is the rest of one word."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, array("q", counts)
        labels, first, ends = ["\0"], array("I"), array("i")
        todo = [(0, len(words), 0)]  # (from, to, depth) of each node, in the order of their numbers
        for low, high, depth in todo:
            first.append(len(labels))
            if high - low == 1:
                ends.append(low)
                continue
            ended = len(words[low]) == depth
            ends.append(low if ended else -1)
            low += ended
            while low < high:
                letter, to = words[low][depth], low + 1
                while to < high and words[to][depth] == letter:
                    to += 1
                labels.append(letter)
                todo.append((low, to, depth + 1))
                low = to
        first.append(len(labels))
        self.labels, self.first, self.ends = "".join(labels), first, ends

    def packed(self) -> bytes:
        return pickle.dumps(("\n".join(self.words), self.counts.tobytes(), self.labels, self.first.tobytes(), self.ends.tobytes()))

    @classmethod
    def unpacked(cls, blob: bytes) -> Trie:
        trie = cls.__new__(cls)
        words, counts, trie.labels, first, ends = pickle.loads(blob)
        trie.words = words.split("\n")
        trie.counts, trie.first, trie.ends = array("q", counts), array("I", first), array("i", ends)
        return trie

    def near(self, word: str) -> set[int]:
        """The numbers of the words that differ from this one by exactly one code point."""
        words, labels, first, ends = self.words, self.labels, self.first, self.ends
        n, found = len(word), set()
        stack = [(0, 0, 0, False)]  # node, its depth, how much of the word is used, whether the change was made
        while stack:
            node, depth, used, changed = stack.pop()
            a, b = first[node], first[node + 1]
            if a == b:  # one word is left
                rest = words[ends[node]][depth:]
                if rest == word[used:] if changed else one_off(rest, word[used:]):
                    found.add(ends[node])
            elif changed:
                while True:  # a single way from here
                    if used == n:
                        if ends[node] >= 0 and (a != b or len(words[ends[node]]) == depth):
                            found.add(ends[node])
                        break
                    if a == b:
                        if words[ends[node]][depth:] == word[used:]:
                            found.add(ends[node])
                        break
                    node = labels.find(word[used], a, b)
                    if node < 0:
                        break
                    depth, used = depth + 1, used + 1
                    a, b = first[node], first[node + 1]
            else:
                letter = word[used] if used < n else ""
                follows = word[used + 1] if used + 1 < n else ""
                for child in range(a, b):
                    la, lb = first[child], first[child + 1]
                    if labels[child] == letter:
                        stack.append((child, depth + 1, used + 1, False))
                    elif letter and (la == lb or not follows or labels.find(follows, la, lb) >= 0):
                        stack.append((child, depth + 1, used + 1, True))  # replaced
                    if la == lb or not letter or labels.find(letter, la, lb) >= 0:
                        stack.append((child, depth + 1, used, True))  # inserted
                if letter:
                    stack.append((node, depth, used + 1, True))  # left out
        return found


def one_off(a: str, b: str) -> bool:
    """Whether two strings differ by exactly one code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def tries(words: DataFrame, shard: int) -> DataFrame:
    """(blob, size): a trie for each stretch of at most ``shard`` words."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0

        def trie() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            blob = Trie(rows["word"].tolist(), rows["n"].tolist()).packed()
            return pd.DataFrame({"blob": [blob], "size": [len(blob)]})

        for frame in frames:
            while len(frame):
                held.append(frame[: shard - n])
                frame = frame[shard - n :]
                n += len(held[-1])
                if n == shard:
                    yield trie()
                    n = 0
        if held:
            yield trie()

    shards = max(1, -(-words.count() // shard))
    return words.repartitionByRange(shards, "word").sortWithinPartitions("word").mapInPandas(build, "blob binary, size long")


MET = "word string, n long, n_near long, near string, near_n long"


def _met(words: DataFrame, blobs: list[bytes]) -> DataFrame:
    """(word, n, n_near, near, near_n): how many words of the tries each word is near to, and the best of them."""
    sent = words.sparkSession.sparkContext.broadcast(blobs)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [Trie.unpacked(b) for b in sent.value]
        for frame in frames:
            rows = []
            for word, n in zip(frame["word"].tolist(), frame["n"].tolist(), strict=True):
                number, best = 0, None
                for trie in held:
                    for k in trie.near(word):
                        number += 1
                        key = (-trie.counts[k], trie.words[k])
                        best = key if best is None or key < best else best
                rows.append((word, n, number, best and best[1], -best[0] if best else None))
            yield pd.DataFrame(rows, columns=["word", "n", "n_near", "near", "near_n"]).astype({"near_n": "Int64"})

    out = materialised(words.mapInPandas(meet, MET), few=True)
    sent.destroy()
    return out


def nearest(words: DataFrame, shard: int = 50_000, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(word, n, n_near, near, near_n) of each of words (word, n): the number of near words, and the best by count, then by order."""
    spark = words.sparkSession
    built = materialised(tries(words, shard))
    # Each trie's round, by its running size; the tries' rows are fewer than words by a factor of shard, and hold a number each.
    rounds: list[list[str]] = []
    size = broadcast_bytes
    for file, held in sorted((r[0], r[1]) for r in built.groupBy(F.input_file_name().alias("file")).agg(F.sum("size").alias("held")).collect()):
        if size + held > broadcast_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append(file)
        size += held
    dealt = words.repartition(4 * spark.sparkContext.defaultParallelism)
    met = [_met(dealt, [bytes(r[0]) for r in spark.read.schema(built.schema).parquet(*files).select("blob").collect()]) for files in rounds]
    if not met:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    if len(met) == 1:
        return met[0]
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), "near"))).alias("best")
    both = reduce(DataFrame.unionByName, met).groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return both.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), which have no cycle: where following forms ends."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialised(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), few=True)
        at = step.select("word", "root")
        if not step.where("moved").take(1):
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, times: int = 5, one_in: int | None = 199, shard: int = 50_000, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary."""
    words = materialised(vocabulary(docs, id_col, text_col, least_chars, least_count, one_in), few=True)
    best = F.col("near_n") >= times * F.col("n")
    told = materialised(nearest(words, shard, broadcast_bytes).select("word", "n", "n_near", F.when(best, F.col("near")).alias("form"), F.when(best, F.col("near_n")).alias("form_n")), few=True)
    found = roots(told.where("form is not null").select("word", "form"))
    return told.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
