"""Operator 1: approximate nearest neighbours over learned partitions.

On a bounded sample of the vectors the neighbour graph is cut into balanced
parts, and a small softmax classifier learns, for a vector, in which parts its
neighbours lie. Every vector is filed under its most probable part. A query is
routed to its ``probes`` most probable parts and ranked there by exact inner
products in double precision. How many probes a wanted recall takes is measured
on sample vectors held out of the fit, so data without structure are searched
in most parts, and clustered data in few; the answer says in which share.

Vectors are filed so that parts are balanced as well: each part's score has a
bias that is raised or lowered until the sample falls evenly over the parts.
The number of parts grows with that of vectors, up to a sixteenth of the
sample. An index that wants more than twice as many has two levels: each part
draws a sample of its own, is cut and learns its own router, in a task of its
own, and a query is routed within each part that it probes. Each level then
aims at the root of the wanted recall. So neither the driver nor a task ever
fits more than ``sample`` vectors, and two levels reach to ``sample`` ** 2 / 256
parts.

Equal vectors are one entry of the index. An answer holds k others, so the
entry need only name its k + 1 smallest ids; nothing is lost by that. A
query is copied to the parts it probes. Parts of more than ``block`` vectors are
searched in blocks, and only where more than ``query_block`` queries probe one
part do its vectors go out more than once; no part or query set meets whole in
one task.

Vectors that are null, zero, or hold a null or a number that isn't finite take
no part, nor do those whose length isn't the most frequent one, nor rows
without an id. Ties go to the smaller id. A row that repeats an id and vector
counts once.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

ENTRY = "entry string, vector binary, ids array<long>, asked boolean"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of those rows of a list column that hold a proper vector."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    x = np.asarray(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dim)
    proper = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[proper], x[proper] + 0.0  # -0.0 equals 0.0


def _entries(dim: int, ids: int, every: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for b in batches:
            numbers = b.column(0).to_pylist()
            rows, x = _matrix(b.column(1), dim)
            for r, v in zip(rows.tolist(), x, strict=True):
                if numbers[r] is None:
                    continue
                e = held.setdefault(v.tobytes(), [set(), False])
                e[0].add(numbers[r])
                e[1] |= numbers[r] % every == 0
                if len(e[0]) > 4 * ids:
                    e[0] = set(heapq.nsmallest(ids, e[0]))
            if len(held) > 50_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[bytes, list]) -> pa.RecordBatch:
        cols = [[xxhash.xxh3_128_hexdigest(v) for v in held], list(held), [heapq.nsmallest(ids, e[0]) for e in held.values()], [e[1] for e in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.bool_())], ["entry", "vector", "ids", "asked"])

    return collect


def entries(rows: DataFrame, dim: int, ids: int, every: int) -> DataFrame:
    """One row of each different vector, with its ``ids`` smallest ids and whether it is asked for."""
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids)
    parts = rows.mapInArrow(_entries(dim, ids, every), ENTRY).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (["entry", "salt"], ["entry"]):  # an entry that every task holds is merged in two steps
        parts = parts.groupBy(*keys).agg(F.first("vector").alias("vector"), least.alias("ids"), F.max("asked").alias("asked"))
    return parts


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part of each vector: seeds are far apart, then vectors move to where most of their neighbours are while there is room."""
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    seeds, sim = [0], x @ x[0]
    for _ in range(parts - 1):
        seeds.append(int(sim.argmin()))
        sim = np.maximum(sim, x @ x[seeds[-1]])
    pull = x @ x[seeds].T
    of, size = np.full(n, -1), np.zeros(parts, int)
    for i in np.argsort(-pull.max(1), kind="stable"):
        of[i] = next(p for p in np.argsort(-pull[i], kind="stable") if size[p] < room)
        size[of[i]] += 1
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(of[near[i]], minlength=parts)
            votes = np.where((size < room) | (np.arange(parts) == of[i]), votes, -1)
            best = int(votes.argmax())
            if votes[best] > votes[of[i]]:
                size[of[i]] -= 1
                size[best] += 1
                of[i] = best
                moved += 1
        if not moved:
            break
    return of


class Router:
    """Softmax over one hidden layer: the parts in which a vector's neighbours are likely to lie."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale = float(np.sqrt(np.mean(x**2))) or 1.0
        d, p = x.shape[1], target.shape[1]
        self.bias = np.zeros(p)
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, p)), np.zeros(p)]
        m, v, step = [0 * w for w in self.w], [0 * w for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                i = order[at : at + 256]
                z = x[i] / self.scale
                h = np.maximum(z @ self.w[0] + self.w[1], 0)
                e = (self._softmax(h @ self.w[2] + self.w[3]) - target[i]) / len(i)
                back = (e @ self.w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((z.T @ back, back.sum(0), h.T @ e, e.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3] + self.bias

    def balance(self, x: np.ndarray, rounds: int = 200) -> None:
        """Sets the bias of each part so that x falls as evenly over the parts as may be."""
        raw, parts, best = self.scores(x), len(self.bias), np.inf
        bias, spread = np.zeros(parts), float(raw.std(0).mean())
        for i in range(rounds):
            load = np.bincount((raw + bias).argmax(1), minlength=parts) * parts / len(x)
            if load.max() < best:
                best, self.bias = load.max(), bias.copy()
            bias -= spread * np.log(np.maximum(load, 0.1)) / (4 + i / 10)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def nearest(q: np.ndarray, x: np.ndarray, k: int, skip: bool = False) -> np.ndarray:
    """Rows of x with the largest inner products; skip: q is x, and no vector is its own neighbour."""
    s = q @ x.T
    if skip:
        np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1, kind="stable")[:, : min(k, s.shape[1] - skip)]


def fit(sample: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router, int]:
    """The router, and the probes that reach the recall on a fifth of the sample, held out."""
    held = np.arange(len(sample)) % 5 == 4
    x, q = sample[~held], sample[held]
    near = nearest(x, x, min(10, len(x) - 1), skip=True)
    of = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), of[near].ravel()), 1)
    target[np.arange(len(x)), of] += 1
    router = Router(x, target / target.sum(1, keepdims=True))
    router.balance(x)
    if not len(q):
        return router, parts
    filed = router.ranked(x)[:, 0]
    order = np.argsort(router.ranked(q), axis=1)  # place of each part in a query's ranking
    place = np.take_along_axis(order, filed[nearest(q, x, k)], axis=1)
    reached = [(place < m).mean() for m in range(1, parts + 1)]
    return router, 1 + int(np.argmax(np.array(reached) >= recall)) if max(reached) >= recall else parts


def _refined(filed: DataFrame, dim: int, k: int, recall: float, sample: int, block: int, part_size: int) -> tuple[DataFrame, float]:
    """(filed, share): each part cut into parts of its own, by a router that is learned from a sample of the part, and the share of those that a probe of the part searches."""
    most = max(sample // 16, 1)
    home = F.element_at("places", 1)
    sizes = filed.groupBy(home.alias("part")).agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("entry", F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = filed.select("vector", draw.alias("draw"), home.alias("part")).join(F.broadcast(sizes), "part").where(F.col("draw") < F.lit(float(sample)) / F.col("n"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.frombuffer(v) for v in sorted(rows["vector"])]).reshape(-1, dim)
        parts = int(min(max(int(rows["n"].iloc[0]) // part_size, 1), max(len(x) // 16, 1)))
        router, probes = fit(x, parts, k, recall) if parts > 1 else (None, 1)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "router": [pickle.dumps(router and vars(router))], "parts": [parts], "probes": [probes]})

    learned = materialised(drawn.groupBy("part").applyInPandas(learn, "part int, router binary, parts int, probes int"))
    told = sizes.join(learned.drop("router"), "part", "left").select("part", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("probes", F.lit(1)).alias("probes"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    told = materialised(told, few=True)
    share = told.agg(F.sum(F.col("probes") / F.col("parts")) / F.count("*")).first()[0]
    # A row meets the router of its own part, and a query those of all parts that it probes, in blocks.
    met = filed.select("entry", "vector", "ids", "asked", F.posexplode(F.when(F.col("asked"), F.col("places")).otherwise(F.slice("places", 1, 1))).alias("pos", "part"))
    met = met.join(F.broadcast(told.select("part", "blocks")), "part").withColumn("block", F.pmod(F.xxhash64("entry", F.lit(6)), F.col("blocks")).cast("int"))
    routers = learned.join(told.select("part", "blocks"), "part").select("part", "router", "probes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def place(rows: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in ("entry", "vector", "ids", "asked", "pos", "within")})
        known = pickle.loads(router["router"].iloc[0]) if len(router) else None
        ranked = np.zeros((len(rows), 1), np.int32)
        if known:
            own = Router.__new__(Router)
            vars(own).update(known)
            ranked = own.ranked(np.frombuffer(b"".join(rows["vector"])).reshape(-1, dim))[:, : int(router["probes"].iloc[0])].astype(np.int32)
        return rows[["entry", "vector", "ids", "asked", "pos"]].assign(within=[(r + int(p) * most).tolist() for r, p in zip(ranked, rows["part"], strict=True)])

    placed = met.groupBy("part", "block").cogroup(routers.groupBy("part", "block")).applyInPandas(place, ENTRY + ", pos int, within array<int>")
    whole = placed.groupBy("entry").agg(F.first("vector").alias("vector"), F.first("ids").alias("ids"), F.first("asked").alias("asked"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "within"))), lambda s: s["within"])).alias("places"))
    return materialised(whole), share


def search_nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, sample: int = 6000, recall: float = 0.94, block: int = 20_000, query_block: int = 20_000, part_size: int = 1500) -> DataFrame:
    """(query, rank, id, score, probed) for the rows whose id is divisible by ``every``: their k nearest of all other rows. probed: the share of parts searched."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query long, rank int, id long, score double, probed double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim = sizes[0]
    index = materialised(entries(rows, dim, k + 1, every))
    n, asked = index.agg(F.count("*"), F.count_if("asked")).first()
    if not n or not asked:
        return vectors.sparkSession.createDataFrame([], out)

    drawn = index.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))).select("entry", "vector").collect()  # about sample rows
    x = np.array([np.frombuffer(r.vector) for r in sorted(drawn)]).reshape(-1, dim)
    if len(x) < 20:
        x = np.array([np.frombuffer(r.vector) for r in index.orderBy("entry").limit(20).collect()]).reshape(-1, dim)
    wanted = max(n // part_size, 4)
    parts = int(min(wanted, max(len(x) // 16, 1)))
    two = wanted > 2 * parts
    router, probes = fit(x, parts, k, recall**0.5 if two else recall)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array([np.frombuffer(t) for t in b.column(1).to_pylist()]).reshape(-1, dim)
            places = router.ranked(v)[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(places), pa.list_(pa.int32()))], [*b.schema.names, "places"])

    filed = materialised(index.mapInArrow(file, ENTRY + ", places array<int>"))
    share = probes / parts
    if two:
        filed, within = _refined(filed, dim, k, recall**0.5, sample, block, part_size)
        share *= within
    held = filed.groupBy(F.element_at("places", 1).alias("part")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("q"))
    wanted = filed.where("asked").select(F.explode("places").alias("part")).groupBy("part").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("q"))
    load = held.union(wanted).groupBy("part").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    cuts = F.broadcast(materialised(load.select("part", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("q") / query_block).cast("int").alias("batches")), few=True))  # a row for each part
    salt = lambda c, seed: F.pmod(F.xxhash64("entry", F.lit(seed)), c).cast("int")
    several = lambda c: F.explode(F.when(c > 0, F.sequence(F.lit(0), c - 1)))
    base = filed.select("entry", "vector", "ids", F.element_at("places", 1).alias("part")).join(cuts, "part")
    base = base.select("entry", "vector", "ids", "part", salt(F.col("blocks"), 3).alias("block"), several(F.col("batches")).alias("batch"))
    probe = filed.where("asked").select("entry", "vector", F.explode("places").alias("part")).join(cuts, "part")
    probe = probe.select(F.col("entry").alias("entry"), F.col("vector").alias("vector"), "part", several(F.col("blocks")).alias("block"), salt(F.col("batches"), 4).alias("batch"))

    def rank(base: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        if base.empty or probe.empty:
            return pd.DataFrame({"entry": [], "found": []})
        v = np.frombuffer(b"".join(base["vector"])).reshape(-1, dim)
        ids = [np.asarray(i) for i in base["ids"]]
        got = []
        for at in range(0, len(probe), 512):
            s = np.frombuffer(b"".join(probe["vector"].iloc[at : at + 512])).reshape(-1, dim) @ v.T
            m = min(k + 1, s.shape[1])
            edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
            for row, least in zip(s, edge, strict=True):
                pairs = sorted((-row[j], i) for j in np.flatnonzero(row >= least) for i in ids[j])[: k + 1]
                got.append([{"score": float(-a), "id": int(i)} for a, i in pairs])
        return pd.DataFrame({"entry": probe["entry"].to_numpy(), "found": got})

    keys = ["part", "block", "batch"]
    answers = base.groupBy(*keys).cogroup(probe.groupBy(*keys)).applyInPandas(rank, "entry string, found array<struct<score:double,id:long>>")
    order = F.array_sort(F.transform(F.flatten(F.collect_list("found")), lambda s: F.struct((-s["score"]).alias("away"), s["id"].alias("id"))))
    answers = materialised(answers.groupBy("entry").agg(F.slice(order, 1, k + 1).alias("found")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([xxhash.xxh3_128_hexdigest(v.tobytes()) for v in x], pa.string())], ["query", "entry"])

    queries = rows.where(F.col("id") % every == 0).mapInArrow(name, "query long, entry string").distinct()
    others = F.slice(F.filter("found", lambda s: s["id"] != F.col("query")), 1, k)
    found = queries.join(answers, "entry").select("query", F.posexplode(others).alias("pos", "s"))
    return found.select("query", (F.col("pos") + 1).alias("rank"), F.col("s.id").alias("id"), (-F.col("s.away")).alias("score"), F.lit(share).alias("probed"))
