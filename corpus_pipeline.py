"""A corpus pipeline: five stages over ``documents``, each an operator of passagework.llm.

Each stage works on all rows that the one before kept and returns the columns
it was given; only the last adds some. Between stages rows are written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import decontamination, langid, mixing, ngram_join, secrets
from passagework.llm.common import bounded_batches, materialised, table
from passagework.llm.queries import POWER, RATE, learnable, marginals

#: SQL cannot run a fitted classifier; the stages are tested against brute force.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """(row, doc, key): rows as one column, so that no name of theirs can clash, beside what tells texts apart."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("key"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["key"] == b["key"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; a missing language is filled in.

    Null and empty texts, and such without a letter, are in no language and go.
    Rows are judged one by one: ties and repeated rows fare alike, an empty
    table stays empty, and columns beside ``text`` and ``lang`` pass untouched.
    A text of any length is read whole, in time that grows with it.
    """
    bounded_batches(spark)
    model = langid.train(docs.where(learnable("doc_id")), "doc_id", "text", "lang")
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id, a null one before all, and of its texts the smallest by hash.

    Texts that share an id are told apart by a hash, so none is lost for its
    id. Of rows that repeat an id and text one stays, the smallest by the hash of
    all its columns. Null texts and texts without words are in no group and
    all stay. An empty table stays empty; no name of a column can clash. A very
    long text is one set of hashes, eight bytes a word, held by one task.
    """
    bounded_batches(spark)
    first = materialised(ngram_join.representatives(docs))
    rows = _whole(docs)
    kept = rows.join(first, _same(rows, first)).select("row", rows["doc"], rows["key"], "copies")
    if first.where("copies > 1").take(1):
        one = kept.where("copies > 1").groupBy("doc", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.where("copies = 1").select("row").union(one.select("row"))
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with a benchmark item.

    Null and empty texts have no words and stay; texts that share an id are
    judged each by itself, repeated rows alike. Empty tables are fine on either
    side, and no name of a column can clash. The words of a very long text are
    one array of a row.
    """
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where(decontamination.contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("doc_id").alias("doc"), "key").distinct()
    rows = _whole(docs)
    return rows.join(bad, _same(rows, bad), "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret.

    Null and empty texts pass, with a length of null and 0. Rows are treated one by one: repeated rows alike, an
    empty table stays empty, and of columns only ``text`` and ``n_chars`` change.
    A text of any length takes time in proportion to it, whatever it holds.
    """
    bounded_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mix, with their tokens and probability.

    A null source or language is a value of its own; null and empty texts have
    no tokens and change no weights. Rows that share an id are drawn alike. An empty table
    stays empty; given columns ``tokens`` and ``p`` are replaced, all others stay.
    Of a text, however long, its length and a few words it may contain are
    looked at. Targets out of reach are met as nearly as the cells allow.
    """
    return mixing.draw(docs, marginals(), rate=RATE, power=POWER)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
