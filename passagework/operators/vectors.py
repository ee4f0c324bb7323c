"""Exact vector search within one manual, and the freshness of an index.

An index is rows (manual_id, ord, vector) and, for each manual, one row
(manual_id, digest, model, n, dims).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, unit
from ..scratch import stored

TOP_K = 5


def top_k(index: DataFrame, manual_id: object, question: list[float], k: int | None = TOP_K) -> DataFrame:
    """The k rows of a manual nearest to a question, with score and rank; ties go to the smaller ord.

    Vectors of the index are taken as unit vectors. No k, or 0, is the default.
    """
    asked = F.array(*[F.lit(float(x)) for x in question])
    rows = index.where(F.col("manual_id") == manual_id).withColumn("score", dot(F.col("vector"), unit(asked)))
    best = rows.orderBy(F.desc("score"), "ord").limit(k or TOP_K)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))  # over k rows


def top_k_batch(index: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(question_id, manual_id, ord, score, rank) of the k nearest for each of questions (question_id, manual_id, vector)."""
    asked = questions.select("question_id", "manual_id", unit(F.col("vector")).alias("asked"))
    scored = index.join(asked, "manual_id").select("question_id", "manual_id", "ord", dot(F.col("vector"), F.col("asked")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def in_blocks(index: DataFrame, most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of an index: its vectors, each in the block of the pivot it is nearest to, and what is known of each block.

    A manual of n vectors has about the square root of n pivots, drawn among
    them by a hash, at most ``most``. A block knows its pivot, the widest angle
    to it and the bounds of its vectors' lengths. Both are stored: they are
    made once for many questions.
    """
    draw = F.pmod(F.xxhash64("manual_id", "ord"), F.lit(1 << 30)) / F.lit(1 << 30)
    sizes = index.groupBy("manual_id").agg(F.count("*").alias("_n"), F.min(F.struct(draw.alias("draw"), "ord"))["ord"].alias("_first"))
    few = F.least(F.ceil(F.sqrt("_n")), F.lit(most)) / F.col("_n")
    drawn = index.join(sizes, "manual_id").where((draw < few) | (F.col("ord") == F.col("_first")))
    pivots = drawn.groupBy("manual_id").agg(F.collect_list(F.struct("ord", unit(F.col("vector")).alias("vector"))).alias("_pivots"))  # some sqrt(n) of a manual
    nearest = F.array_max(F.transform("_pivots", lambda p: F.struct(dot(F.col("vector"), p["vector"]).alias("near"), (-p["ord"]).alias("pivot"))))
    placed = index.join(pivots, "manual_id").withColumn("_at", nearest).withColumn("_norm", norm(F.col("vector")))
    rows = stored(placed.select("manual_id", "ord", "vector", (-F.col("_at.pivot")).alias("block"), "_norm", F.when(F.col("_norm") > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_at.near") / F.nullif("_norm", F.lit(0.0)))))).otherwise(0.0).alias("_angle")))
    told = rows.groupBy("manual_id", "block").agg(F.count("*").alias("n"), F.max("_angle").alias("angle"), F.min("_norm").alias("shortest"), F.max("_norm").alias("longest"))
    centre = drawn.select("manual_id", F.col("ord").alias("block"), unit(F.col("vector")).alias("pivot"))
    return rows.drop("_norm", "_angle"), stored(told.join(centre, ["manual_id", "block"]))


def top_k_pruned(rows: DataFrame, blocks: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """As ``top_k_batch``, with ``read``: the share of its manual's vectors that a question had to be held against.

    No vector of a block can score more than the angle to its pivot allows. A
    question first meets the blocks with the highest such bounds that hold k
    vectors together, and after them those alone whose bound reaches the k-th
    score found: the others hold nothing better. The result is exact.
    """
    asked = questions.select("question_id", "manual_id", unit(F.col("vector")).alias("asked"))
    turn = F.cos(F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("pivot"), F.col("asked"))))) - F.col("angle")))
    bound = F.when(turn >= 0, turn * F.col("longest")).otherwise(turn * F.col("shortest")) + F.lit(1e-6) * F.greatest(F.lit(1.0), F.col("longest"))  # rounding of angles
    by_bound = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    held = F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = stored(asked.join(blocks, "manual_id").withColumn("bound", bound).withColumn("first", held < k).select("question_id", "manual_id", "asked", "block", "n", "bound", "first"))

    def scored(which: DataFrame) -> DataFrame:
        best = rows.join(which.select("question_id", "manual_id", "block", "asked"), ["manual_id", "block"]).select("question_id", "manual_id", "ord", dot(F.col("vector"), F.col("asked")).alias("score"))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)

    found = stored(scored(bounds.where("first")))
    least = found.groupBy("question_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    more = bounds.where("not first").join(least, "question_id").where("least is null or bound >= least")
    read = bounds.join(least, "question_id").groupBy("question_id").agg((F.sum(F.when(F.expr("first or least is null or bound >= least"), F.col("n")).otherwise(0)) / F.sum("n")).alias("read"))
    both = found.drop("rank").union(scored(more).drop("rank"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).join(read, "question_id")


def normalised(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.withColumn(vector, unit(F.col(vector)))


def norms(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.withColumn("norm", norm(F.col(vector)))


def digests(chunks: DataFrame) -> DataFrame:
    """(manual_id, digest) over the texts of each manual in order, each closed by a NUL; a null counts as none.

    The digest is of one sequence, so a manual is read in order by one task. It
    streams through, text by text; nothing of it is gathered.
    """

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        manual, state = None, None
        for frame in frames:
            out = []
            for m, text in zip(frame["manual_id"].tolist(), frame["text"].tolist(), strict=True):
                if state is None or m != manual:
                    out += [(manual, state.hexdigest())] if state else []
                    manual, state = m, hashlib.sha256()
                if text is not None:
                    state.update(text.encode() + b"\0")
            yield pd.DataFrame(out, columns=["manual_id", "digest"])
        if state:
            yield pd.DataFrame([(manual, state.hexdigest())], columns=["manual_id", "digest"])

    kind = chunks.schema["manual_id"].dataType.simpleString()
    dealt = chunks.select("manual_id", "ord", "text").repartition("manual_id").sortWithinPartitions("manual_id", "ord")
    return dealt.select("manual_id", "text").mapInPandas(stream, f"manual_id {kind}, digest string")


def index_meta(chunks: DataFrame, index: DataFrame, model: str) -> DataFrame:
    sizes = index.groupBy("manual_id").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"))
    return digests(chunks).join(sizes, "manual_id").withColumn("model", F.lit(model))


#: What an index says of itself; one that lacks any of these isn't used.
REQUIRED = ("digest", "model", "n", "dims")


def lacks(meta: DataFrame, required: Sequence[str] = REQUIRED) -> Column:
    """Whether a row of an index's description lacks a required field, or holds none for it."""
    present = set(meta.columns)
    missing = F.lit(not set(required) <= present)
    return reduce(lambda a, c: a | F.col(c).isNull(), [c for c in required if c in present], missing)


def freshness(wanted: DataFrame, chunks: DataFrame, meta: DataFrame, model: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(manual_id, status, advice): the first reason why an index can't be used, or ``fresh``."""
    now = digests(chunks).withColumnRenamed("digest", "now")
    told = meta.withColumn("lacking", lacks(meta, required))
    told = told.select("manual_id", "lacking", *(F.col(c) if c in meta.columns else F.lit(None).cast("string").alias(c) for c in ("model", "digest")))
    seen = wanted.select("manual_id").distinct().join(now, "manual_id", "left").join(told, "manual_id", "left")
    status = (
        F.when(F.col("now").isNull(), "no chunks")
        .when(F.col("lacking").isNull(), "not indexed")
        .when(F.col("lacking"), "incomplete")
        .when(F.col("model") != model, "other model")
        .when(F.col("digest") != F.col("now"), "other chunks")
        .otherwise("fresh")
    )
    advice = F.when(status == "no chunks", "chunk it").when(status == "not indexed", "index it").when(status != "fresh", "index it again")
    return seen.select("manual_id", status.alias("status"), advice.alias("advice"))


def search(index: DataFrame, chunks: DataFrame, meta: DataFrame, model: str, manual_id: str, question: list[float], k: int | None = TOP_K) -> DataFrame:
    """Hits of one manual: its chunks with score and rank. Refuses an index that isn't fresh, and never builds one."""
    one = F.col("manual_id") == manual_id
    wanted = chunks.sparkSession.createDataFrame([(manual_id,)], "manual_id string")
    state = freshness(wanted, chunks.where(one), meta.where(one), model).first()
    if state.status != "fresh":
        raise LookupError(f"{manual_id}: {state.status}; {state.advice}")
    best = top_k(index, manual_id, question, k).select("manual_id", "ord", "score", "rank")
    return chunks.where(one).join(best, ["manual_id", "ord"]).orderBy("rank")
