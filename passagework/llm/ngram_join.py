"""Operator 4: Jaccard self-join of documents on sets of word shingles, by grouped prefixes.

1. Every text becomes its set of shingle hashes, in numpy, once. Hashes go out
   by ranges, packed, with the row they come from; a range's task counts in how
   many sets each hash occurs and returns those that occur in two or more to
   the rows. No document meets another yet, and a hash that nothing shares is
   dropped where it was counted. Rows are packed in parts of bounded size. Of a
   hash that many rows of a part hold, the part sends their number alone, so
   that a range gets a few bytes from each part for it, however many rows do.
2. A document can only link when four fifths of its set are shared. Of those
   that remain, hashes are ordered from rare to frequent; two linked documents
   have one in common among the first few, the prefix. Documents with the same
   set are one class; classes with the same prefix and size are one group.
3. Groups that share a hash of their prefixes are pairs. In a first round each
   group is held only against one, a typical group of its hashes, and each
   member against its own group, which connects most copies at a cost linear in
   their number. In the second, all pairs that these links leave in different
   components are filtered by size, position and bits, expanded to members and
   verified. Bits are parities of a set's hashes, and two sets differ in at
   least as many hashes as bits, so documents that share stock paragraphs
   without being copies are told apart before their hashes are fetched. So no link between components is lost, and a large group of copies
   never becomes all its pairs.

Linking is exact integer arithmetic on the sets. Sets are of 62-bit hashes or
longer: about one chance in 10^4 of any false match among 10^8 shingles.

Null and empty texts have no shingles, link with nothing and are their own
component. Rows that repeat an id and text are copies like any others. A null
id ranks before all others, as does -2^63, which is taken for it, and a
component that holds one has a null id. A very long text is one set of hashes,
held by one task. The table is read once, and rows carry what they need to be
put back, so it need not be read the same way again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, text_bytes
from .graph import components

WORDS = 5
NO_ID = -(1 << 63)
HOME = 8  # rows of a part from which on a hash's rows stay with their part, and their number alone goes out
PACKED = "bucket long, part long, rows binary, counts binary, tokens binary"
PARTS = 1_000_000  # a table partition has fewer parts
BITS = 1024  # of a set's parities
SETS = "doc long, key long, n long, hi long, lo long, tokens array<long>, bits array<long>"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of fewer words, of the whole."""
    words = text.encode(errors="surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least number of a set's n shingles that it shares with a set it links with."""
    return (4 * n + 4) // 5


def parities(tokens: np.ndarray) -> np.ndarray:
    """BITS bits, of which a set's each hash turns one over: two sets' bits differ in no more places than the sets do."""
    odd = np.bincount(tokens & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(a: str, b: str) -> Column:
    """Whether two sets' sizes, shared sizes and bits leave room for a link: those in common are at most half of what isn't told apart."""
    of = lambda side, c: F.col(f"{side}.{c}")
    apart = F.aggregate(F.zip_with(of(a, "bits"), of(b, "bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(9 * (of(a, "m") + of(b, "m") - apart) >= 8 * (of(a, "n") + of(b, "n")), F.lit(True))


def _small(a: np.ndarray) -> bytes:
    """Whole numbers of which most are small, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.asarray(a).astype(np.uint32).tobytes())


def _large(value: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint32)


def _packed(bits: int, flush: int):
    """The map side of step 1: sets by ranges of hashes, and a row of each document by its partition."""

    def ranges(part: int, tokens: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        ordered = np.sort(tokens)
        hot = np.unique(ordered[HOME - 1 :][ordered[HOME - 1 :] == ordered[: max(len(ordered) - HOME + 1, 0)]])
        del ordered
        if len(hot):
            at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
            stay = hot[at] == tokens
            order = np.flatnonzero(stay)[np.argsort(at[stay], kind="stable")]
            k = np.bincount(at[stay])
            yield -2 - 2 * part, _small(rows[order]), _small(k), hot.tobytes()
            yield from ((b, None, _small(k[lo:hi]), _sevens(hot[lo:hi])) for b, lo, hi in _runs((hot >> np.uint64(64 - bits)).astype(np.int64)))
            tokens, rows = tokens[~stay], rows[~stay]
        bucket = (tokens >> np.uint64(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16)
        order = np.argsort(bucket, kind="stable")
        tokens, rows, bucket = tokens[order], rows[order], bucket[order]
        for b, lo, hi in _runs(bucket):
            starts = np.flatnonzero(np.r_[True, rows[lo + 1 : hi] != rows[lo : hi - 1], True])
            yield b, _small(np.diff(rows[lo:hi][starts[:-1]], prepend=np.uint32(0))), _small(np.diff(starts)), _sevens(tokens[lo:hi])

    def out(part: int, sets: list[tuple[int, np.ndarray]], meta: list[tuple]) -> pa.RecordBatch:
        got: list[tuple] = []
        if sets:
            rows = np.repeat(np.array([r for r, _ in sets], np.uint32), [len(s) for _, s in sets])
            tokens = np.concatenate([s for _, s in sets])
            sets.clear()
            if bits < 8:  # a range and seven bytes are what is known of a hash
                tokens &= ~np.uint64(((1 << (8 - bits)) - 1) << 56)
            got.extend(ranges(part, tokens, rows))
        ids, keys, n, first, digests = zip(*meta, strict=True)
        got.append((-1 - 2 * part, np.array(first, np.uint32).tobytes() + b"".join(digests), np.array(n, np.int64).tobytes(), np.array([*ids, *keys], np.int64).tobytes()))
        b, rows, counts, tokens = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([part] * len(b), pa.int64()), pa.array(rows, pa.binary()), pa.array(counts, pa.binary()), pa.array(tokens, pa.binary())], ["bucket", "part", "rows", "counts", "tokens"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seen = TaskContext.get().partitionId() * PARTS, 0, set()
        sets, meta, held = [], [], 0
        for b in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(text)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and digest not in seen:  # a copy in the same part adds nothing but its row
                    seen.add(digest)
                    sets.append((at, s))
                    held += len(s)
                meta.append((NO_ID if doc is None else doc, key, len(s), at, digest))
                at += 1
                if held >= flush:
                    yield out(part, sets, meta)
                    part, at, sets, meta, held = part + 1, 0, [], [], 0
                    seen.clear()
        if meta:
            yield out(part, sets, meta)

    return pack


def _runs(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of the runs of equal values."""
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(of[a]), a, b


def _sevens(tokens: np.ndarray) -> bytes:
    """All bytes of hashes but the first, most of which the range tells."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _shared(bits: int):
    """The reduce side of step 1: of a range's hashes, those of two sets or more, by partition."""

    def share(found: pd.DataFrame) -> pd.DataFrame:
        bucket = int(found["bucket"].iloc[0])
        if bucket < 0:
            return found
        ends = np.cumsum([len(t) // 7 for t in found["tokens"]]).tolist()
        tokens = np.zeros((ends[-1], 8), np.uint8)
        for t, b in zip(found["tokens"], ends, strict=True):
            tokens[b - len(t) // 7 : b, :7] = np.frombuffer(t, np.uint8).reshape(-1, 7)
        tokens = tokens.view("<u8").ravel()
        df = np.ones(len(tokens), np.uint32)
        for r, c, t, b in zip(found["rows"], found["counts"], found["tokens"], ends, strict=True):
            if r is None:
                df[b - len(t) // 7 : b] = _large(c)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        del ranked
        df[order] = np.repeat(np.add.reduceat(df[order], starts), np.diff(np.r_[starts, len(tokens)]))
        del order, starts
        top = np.uint64(bucket << (8 - bits) if bits <= 8 else bucket >> (bits - 8)) << np.uint64(56)
        got = []
        for part, r, c, t, b in zip(found["part"], found["rows"], found["counts"], found["tokens"], ends, strict=True):
            a = b - len(t) // 7
            if (keep := df[a:b] > 1).any():
                rows = None if r is None else _small(np.diff(np.repeat(np.cumsum(_large(r), dtype=np.uint32), _large(c))[keep], prepend=np.uint32(0)))
                got.append((bucket, part, rows, _small(df[a:b][keep]), (tokens[a:b][keep] | top).tobytes()))
        return pd.DataFrame(got, columns=["bucket", "part", "rows", "counts", "tokens"])

    return share


def _sets(found: pd.DataFrame) -> pd.DataFrame:
    """Step 2 for one part: its documents, and the shared hashes, rarest first, of those that can link."""
    about, home = (found[(found["bucket"] < 0) & (found["bucket"] % 2 == odd)] for odd in (1, 0))
    told = found[(found["bucket"] >= 0) & found["rows"].isna()]
    own = found[(found["bucket"] >= 0) & found["rows"].notna()]
    firsts, digests, ids = [], [], []
    for r, t in zip(about["rows"], about["tokens"], strict=True):
        k = len(r) // 20
        firsts.append(np.frombuffer(r[: 4 * k], np.uint32))
        digests.append(np.frombuffer(r[4 * k :], np.int64).reshape(k, 2))
        ids.append(np.frombuffer(t, np.int64).reshape(2, k))
    at, digest, docs = np.concatenate(firsts), np.concatenate(digests), np.concatenate(ids, 1)
    n = np.concatenate([np.frombuffer(c, np.int64) for c in about["counts"]])
    lists: list = [None] * len(at)
    bits: list = [None] * len(at)
    rows, df, tokens = ([np.zeros(0, t)] for t in (np.uint32, np.uint32, np.int64))
    for r, c, t in zip(own["rows"], own["counts"], own["tokens"], strict=True):
        rows.append(np.cumsum(_large(r), dtype=np.uint32))
        df.append(_large(c))
        tokens.append(np.frombuffer(t, np.int64))
    if len(home):
        known = np.concatenate([np.frombuffer(t, np.int64) for t in told["tokens"]])
        order = np.argsort(known)
        known, total = known[order], np.concatenate([_large(c) for c in told["counts"]])[order]
        for r, c, t in zip(home["rows"], home["counts"], home["tokens"], strict=True):
            held, k = np.frombuffer(t, np.int64), _large(c)
            rows.append(_large(r))
            df.append(np.repeat(total[np.searchsorted(known, held)], k))
            tokens.append(np.repeat(held, k))
    rows, df, tokens = np.concatenate(rows), np.concatenate(df), np.concatenate(tokens)
    order = np.lexsort((tokens, df, rows))
    rows, tokens = rows[order], tokens[order]
    lo, hi = np.searchsorted(rows, at), np.searchsorted(rows, at, side="right")
    for i in np.flatnonzero((hi - lo >= needed(n)) & (n > 0)):
        lists[i] = tokens[lo[i] : hi[i]]
        bits[i] = parities(lists[i])
    return pd.DataFrame({"doc": docs[0], "key": docs[1], "n": n, "hi": digest[:, 0], "lo": digest[:, 1], "tokens": lists, "bits": bits})


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = 6 << 20, flush: int = 600_000) -> DataFrame:
    """(doc, key, n, hi, lo, tokens) of every row: a hash of its text, the set's size and digest, and its shared hashes if it can link."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    bits = max(6, (text_bytes(rows) // bucket_bytes).bit_length())
    packed = rows.mapInArrow(_packed(bits, flush), PACKED)
    return materialised(packed.groupBy("bucket").applyInPandas(_shared(bits), PACKED).groupBy("part").applyInPandas(_sets, SETS))


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets link."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    common = F.size(F.array_intersect("t_a", "t_b"))
    return pairs.join(a, "a").join(b, "b").where(9 * common >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def link(sets: DataFrame) -> DataFrame:
    """(node, root) of the classes that link with another class; node is the high half of the set's digest."""
    able = sets.where("tokens is not null").groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"))
    need = F.floor((4 * F.col("n") + 4) / 5).cast("int")
    prefix = F.slice("tokens", 1, F.size("tokens") - need + 1)
    nodes = materialised(able.select(F.col("hi").alias("node"), "n", "tokens", "bits", F.size("tokens").alias("m"), prefix.alias("prefix"), F.xxhash64(prefix, "n").alias("group")))

    # One of each group stands for it: the same prefix and size, so the same places in every list.
    leads = materialised(nodes.groupBy("group").agg(F.min("node").alias("lead"), F.first("n").alias("n"), F.max("m").alias("m"), F.first("prefix").alias("prefix"), F.when(F.count("*") == 1, F.first("bits")).alias("bits")), few=True)
    members = materialised(nodes.select("node", "group", "n", "m", "bits").join(leads.select("group", "lead"), "group"), few=True)
    lists = leads.select("group", F.col("lead").alias("node"), "n", "m", F.posexplode("prefix").alias("pos", "token"))

    typical = materialised(lists.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("u"), "node")).alias("best"), F.count("*").alias("k")).where("k > 1").select("token", F.col("best.node").alias("hub")), few=True)
    # Of the hubs of its lists a group is held against the one it meets most often.
    star = lists.select("node", "token").join(typical, "token").where("node <> hub").groupBy("node", "hub").count()
    star = star.groupBy("node").agg(F.max(F.struct("count", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    own = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    found = materialised(_linked(materialised(star.union(own).distinct(), few=True), nodes), few=True)
    roots = materialised(components(found), few=True)

    # Second round: pairs over different components. In each list one side is outside the hub's component.
    place = members.join(roots, "node", "left").select("node", "group", "n", "m", "bits", F.coalesce("root", "node").alias("root"))
    place = materialised(place, few=True)
    spread = place.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    listed = lists.join(leads.select("group", "bits"), "group").join(spread, "group").select("token", "pos", "group", "n", "m", "low", "high", "bits")
    hub = typical.join(place.select(F.col("node").alias("hub"), F.col("root").alias("main")), "hub").select("token", "main")
    outside = listed.join(hub, "token").where("low <> main or high <> main").alias("x")
    y = listed.alias("y")
    room = F.least(F.col("x.m") - F.col("x.pos"), F.col("y.m") - F.col("y.pos"))
    near = (5 * F.col("x.n") >= 4 * F.col("y.n")) & (5 * F.col("y.n") >= 4 * F.col("x.n")) & (9 * room >= 4 * (F.col("x.n") + F.col("y.n")))
    apart = ~((F.col("x.low") == F.col("y.high")) & (F.col("x.high") == F.col("y.low")))
    pairs = outside.join(y, F.col("x.token") == F.col("y.token")).where(near & apart & _may_link("x", "y")).select(F.col("x.group").alias("g"), F.col("y.group").alias("h")).distinct()
    mixed = spread.where("low <> high").select(F.col("group").alias("g"), F.col("group").alias("h"))
    a, b = place.alias("a"), place.alias("b")
    met = pairs.union(mixed).join(a, F.col("g") == F.col("a.group")).join(b, F.col("h") == F.col("b.group")).where((F.col("a.root") != F.col("b.root")) & _may_link("a", "b"))
    rest = met.select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")).distinct()
    more = materialised(_linked(materialised(rest, few=True), nodes), few=True)
    return components(found.union(more))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6 << 20) -> DataFrame:
    """(doc, key, n, label, rest) of every row: rows with words are near duplicates if label and rest are the same."""
    sets = shingle_sets(docs, id_col, text_col, bucket_bytes)
    roots = materialised(link(sets), few=True)
    rows = sets.select("doc", "key", "n", F.col("hi").alias("node"), "lo").join(roots, "node", "left")
    # A class outside all links is known by its whole digest; a linked one by its root.
    return materialised(rows.select("doc", "key", "n", F.coalesce("root", "node").alias("label"), F.when(F.col("root").isNull(), F.col("lo")).otherwise(0).alias("rest")), few=True)


def _real(c: Column) -> Column:
    return F.nullif(c, F.lit(NO_ID))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6 << 20) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows = classes(docs, id_col, text_col, bucket_bytes)
    shared = materialised(rows.where("n > 0").groupBy("label", "rest").agg(F.min("doc").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k"), few=True)
    out = rows.join(shared, ["label", "rest"], "left")
    return out.select(_real(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), _real(F.when(F.col("n") > 0, F.coalesce("least", "doc")).otherwise(F.col("doc"))).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, copies) of the texts that stay when one of each group does: the smallest id's, of several the smallest hash's.

    key is xxhash64 of the text; copies tells how many rows hold that id and
    text, of which one stays. Texts without words are in no group and all stay:
    their copies are 1 whatever the table holds.
    """
    texts = classes(docs, id_col, text_col).groupBy("doc", "key").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min("label").alias("label"), F.min("rest").alias("rest"))
    first = texts.where("n > 0").groupBy("label", "rest").agg(F.min(F.struct("doc", "key", "copies")).alias("f")).select("f.*")
    return first.union(texts.where("n = 0").select("doc", "key", F.lit(1).cast("long"))).withColumn("doc", _real(F.col("doc")))
