"""Operator 9: benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are cut into words. Of every ``SPREAD`` consecutive hashes of ``GRAM``
words the smallest is kept, so any span of ``WINDOW`` = SPREAD + GRAM - 1 words
that two texts share gives them a fingerprint in common. Fingerprints of
documents meet those of the benchmark in a join; a hit is extended to the
windows that hold it, and a window counts once its words equal an item's.

Items of fewer than ``WINDOW`` words are one window each. Winnowing promises
nothing about those, so the hashes of all runs of that length are joined, for
each of the at most ``WINDOW`` - 1 lengths that occur.

Each fingerprint knows its place, so a hit costs a look at the windows about
that place and no second search. While the benchmark's fingerprints and windows,
which are measured, take at most ``broadcast_bytes``, they are broadcast, and
texts are read, cut, met and verified in one go, without being shuffled. Beyond
that only places and fingerprints are shuffled, and the texts of documents that
hit; Spark splits a hot fingerprint's documents over tasks.

Null and empty texts have no words and are never contaminated. Items without an
id or words are left out; an empty benchmark hits nothing. Rows that repeat an id and text fare alike; texts
under one id are told apart by a hash of the text. The time for a text is linear
in its length, hits included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WINDOW, GRAM = 13, 5
SPREAD = WINDOW - GRAM + 1
#: Fixed value: what separates words once A-Z is lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def _upto(n: Column) -> Column:
    """0 .. n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, n: int) -> Column:
    """The hash of each run of n words."""
    return F.transform(_upto(F.size(words) - (n - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def placed(words: Column) -> Column:
    """Hashes of GRAM words whose last four bits give way to those of their place."""
    return F.transform(_upto(F.size(words) - (GRAM - 1)), lambda i: F.shiftleft(F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]), 4).bitwiseOR(i.bitwiseAND(15).cast("long")))


def winnowed(hashes: Column) -> Column:
    """The places of the minima of all windows of SPREAD placed hashes; of equal ones in a window either may stand."""
    least = F.transform(_upto(F.size(hashes) - (SPREAD - 1)), lambda i: F.array_min(F.slice(hashes, i + 1, SPREAD)))
    return F.array_distinct(F.transform(least, lambda m, i: i + (m.bitwiseAND(F.lit(15).cast("long")).cast("int") - i).bitwiseAND(15)))


def prints_of(words: Column, hashes: Column, lengths: list[int]) -> Column:
    """(length, place, print) of the fingerprints of a text, and of all its runs of the short lengths."""
    entry = lambda n, i, h: F.struct(F.lit(n).alias("length"), i.alias("place"), h.alias("print"))
    found = [F.transform(winnowed(hashes), lambda i: entry(WINDOW, i, F.shiftright(F.get(hashes, i), 4)))]
    runs = lambda n: F.transform(grams(words, n), lambda h, i: entry(n, i, h))
    found += map(runs, lengths)
    return F.flatten(F.array(*found)) if len(found) > 1 else found[0]


def starts_of(length: Column, place: Column, words: Column) -> Column:
    """The starts of the windows of a text that hold the fingerprint at a place."""
    back = F.when(length == WINDOW, WINDOW - GRAM).otherwise(0)
    return F.sequence(F.greatest(place - back, F.lit(0)), F.least(place, F.size(words) - length))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(id, key, n_words, n_hit, items array<string>) of every row; key is a hash of the text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text).cast("string")).alias("words")).where("item is not null and size(words) > 0")

    size = F.least(F.size("words"), F.lit(WINDOW))
    windows = items.select("item", size.alias("length"), F.explode(F.transform(_upto(F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i + 1, size), " "))).alias("window")).distinct()
    held, short = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 64), F.array_sort(F.collect_set(F.when(F.col("length") < WINDOW, F.col("length"))))).first()  # WINDOW - 1 lengths at most
    is_small = (held or 0) <= broadcast_bytes
    small = F.broadcast if is_small else (lambda d: d)

    hashed = lambda d: d.withColumn("hashes", placed(F.col("words")))
    of_item = lambda n: F.size("words") >= n if n == WINDOW else F.size("words") == n
    prints = hashed(items.where(of_item(WINDOW))).select(F.lit(WINDOW).alias("length"), F.explode(F.transform(winnowed(F.col("hashes")), lambda i: F.shiftright(F.get("hashes", i), 4))).alias("print"))
    for n in short:
        prints = prints.union(items.where(of_item(n)).select(F.lit(n), F.explode(grams(F.col("words"), n))))
    prints = prints.distinct()

    cut = hashed(rows.select("doc", "key", words_of(F.col("text")).alias("words")))
    # Made in a step of their own, fingerprints are exploded beside the words without a copy of those for each. An outer
    # explosion: of an inner one Spark infers a filter, for which it would make them once more.
    kept = ["doc", "key", *(["words"] if is_small else [])]
    each = cut.select(*kept, prints_of(F.col("words"), F.col("hashes"), short).alias("prints"))
    each = each.select(*kept, F.explode_outer("prints").alias("f")).select(*kept, "f.*")
    met = each.join(small(prints), ["length", "print"])
    if not is_small:
        # A row for each place that met; gathered, they are no more than a text has words.
        places = met.groupBy("doc", "key").agg(F.collect_set(F.struct("length", "place")).alias("places"))
        r, p = rows.alias("r"), places.alias("p")
        again = r.join(p, F.col("r.doc").eqNullSafe(F.col("p.doc")) & (F.col("r.key") == F.col("p.key"))).select("r.doc", "r.key", words_of(F.col("text")).alias("words"), "places")
        met = again.select("doc", "key", "words", F.explode("places").alias("f")).select("*", "f.*")
    extended = met.select("doc", "key", "length", "words", F.explode(starts_of(F.col("length"), F.col("place"), F.col("words"))).alias("start"))
    extended = extended.select("doc", "key", "length", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ").alias("window"))
    hits = extended.join(small(windows), ["length", "window"]).groupBy("doc", "key").agg(F.collect_set(F.struct("start", "length")).alias("starts"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    hits = hits.select("doc", "key", covered.cast("long").alias("n_hit"), "items")

    base = rows.select("doc", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).alias("b")
    out = base.join(hits.alias("h"), F.col("b.doc").eqNullSafe(F.col("h.doc")) & (F.col("b.key") == F.col("h.key")), "left")
    return out.select(F.col("b.doc").alias(id_col), F.col("b.key").alias("key"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """The rule: some word is hit, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
