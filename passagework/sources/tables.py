"""Tables at rest: catalogue, pages, passages, figures and index.

Pages and passages come as JSON lines, a file for each manual. What is written
here goes into stores (``snapshots``): a write replaces the manuals it is told
of, in all of a store's tables at once, and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import with_ids
from ..operators.vectors import index_meta, normalised
from . import snapshots

CATALOGUE = "brand string, model array<string>, year array<string>, edition array<string>, url string"
PAGES = "page int, text string"
PASSAGES = "chunk_id string, manual_id string, ord int, section string, pages array<int>, printed array<string>, refs array<int>, figures array<int>, text string"
FIGURES = "figure_id string, manual_id string, page int, n int, file string, bbox array<double>, width int, height int, source_px array<int>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON array in their order, with ids. A folder may hold several such files, each with an order of its own."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.posexplode(F.from_json("value", f"array<struct<{CATALOGUE.replace(' ', ':').replace(',:', ',')}>>")).alias("entry_ord", "e"))
    return with_ids(entries.select("entry_ord", "e.*"))


def _manual() -> Column:
    """The manual that a file is of: its folder says so, or else its name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/manual_id=([^/]+)/", 1)
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*?)(\.jsonl?(\.gz)?)?\z", 1), "%20", " ")
    return F.coalesce(F.nullif(folder, F.lit("")), name)


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of JSON lines, a file or a folder ``manual_id=..`` for each manual. One bad line fails its whole manual."""
    parsed = F.from_json("value", PAGES + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).select(_manual().alias("manual_id"), F.monotonically_increasing_id().alias("ord"), parsed.alias("r")).select("manual_id", "ord", "r.*")
    bad = rows.where("_corrupt_record is not null").groupBy("manual_id").agg(F.concat(F.lit("not JSON: "), F.substring(F.first("_corrupt_record"), 1, 80)).alias("error"))
    pages = rows.join(bad, "manual_id", "left_anti").select("manual_id", "ord", "page", "text")
    return pages, bad.select(F.col("manual_id").alias("name"), "error")


def read_passages(spark: SparkSession, path: str, manual_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(PASSAGES).json(path)
    if manual_id is None:
        return rows
    rows = rows.where(F.col("manual_id") == manual_id)
    if not rows.take(1):
        raise LookupError(f"no passages of {manual_id}; chunk it")
    return rows.orderBy("ord")


def write_passages(rows: DataFrame, path: str, manuals: DataFrame | None = None) -> None:
    """Stores passages as JSON lines. manuals: those that are replaced, if some have no passages any more."""
    with snapshots.Write(rows.sparkSession, path, rows if manuals is None else manuals) as write:
        write.add("passages", rows, "json")


def stored_passages(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read(spark, path, "passages", PASSAGES, "json")


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    """The index of the figures of a store."""
    return snapshots.read(spark, path, "index", FIGURES, "json")


def write_downloads(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Stores what ``remote.download`` fetches, once, and returns (report, failures): (downloaded, bytes, failed), and (manual_id, url, error) of what isn't there.

    Each run is a folder of its own, which Spark's committer puts in place
    whole: a broken run leaves no part of a file behind.
    """
    run = f"{path.rstrip('/')}/run={uuid.uuid4().hex}"
    rows.write.parquet(run)
    told, ok = rows.sparkSession.read.schema(rows.schema).parquet(run), F.col("error").isNull()
    report = told.agg(F.count_if(ok).alias("downloaded"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"), F.count_if(~ok).alias("failed"))
    return report, told.where(~ok).select("manual_id", "url", "error")


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    """(manual_id, url, content) of all files that were fetched, in any run."""
    return spark.read.schema("manual_id string, url string, content binary, error string").parquet(f"{path.rstrip('/')}/run=*").where("error is null").select("manual_id", "url", "content")


IMAGES = "page int, n int, width int, height int, jpeg binary, error string, manual_id string"


def write_figures(drawn: DataFrame, placed: DataFrame, path: str, manuals: DataFrame | None = None) -> None:
    """Stores figures, their JPEGs and their index, in one write.

    drawn: rows of ``extraction.render``, those with an error included. placed:
    rows of ``figures.placements``. manuals: those that are replaced, if some
    have no figures any more; their old ones then go.
    """
    given = drawn.select("manual_id").union(placed.select("manual_id"))
    with snapshots.Write(drawn.sparkSession, path, given if manuals is None else manuals) as write:
        write.add("images", drawn)
        images = write.own("images", IMAGES).where("error is null").select("manual_id", "page", "n", "width", "height")
        about = placed.select("figure_id", "manual_id", "page", "n", "file", "bbox", F.array("width", "height").alias("source_px"))
        index = about.join(images, ["manual_id", "page", "n"])
        write.add("index", index.select("figure_id", "manual_id", "page", "n", "file", "bbox", "width", "height", "source_px"), "json")


def figure_bytes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(figures, skipped) for ``quality.figure_stats``, of the images that are stored."""
    rows = snapshots.read(spark, path, "images", IMAGES)
    return rows.where("error is null").select("manual_id", "page", F.octet_length("jpeg").alias("bytes")), rows.where("error is not null").select("manual_id")


VECTORS, META = "ord int, vector array<float>, manual_id string", "digest string, n long, dims int, model string, manual_id string"


def build_index(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, path: str) -> None:
    """Indexes the manuals of chunks in one write: vectors of length one, and what the index says of itself.

    ``embed`` adds a column ``vector`` to rows. Other manuals stay as they are.
    """
    with snapshots.Write(chunks.sparkSession, path, chunks) as write:
        vectors = normalised(embed(chunks.select("manual_id", "ord", "text")))
        write.add("vectors", vectors.select("manual_id", "ord", F.col("vector").cast("array<float>").alias("vector")))
        write.add("meta", index_meta(chunks, write.own("vectors", VECTORS), model))


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, descriptions) of what is indexed, both as of the same write."""
    now = snapshots.manifest(spark, path)
    return snapshots.read(spark, path, "vectors", VECTORS, now=now), snapshots.read(spark, path, "meta", META, now=now)


def pending(found: DataFrame, done: DataFrame, limit: int = 0, force: bool = False, key: str = "manual_id") -> DataFrame:
    """What is still to be done, and of that the first ``limit`` (0: all)."""
    rows = found if force else found.join(done.select(key).distinct(), key, "left_anti")
    return rows.orderBy(key).limit(limit) if limit else rows


def to_download(catalogue: DataFrame, have: DataFrame, limit: int = 0) -> DataFrame:
    """Entries with an address whose file isn't there yet; two entries under one id are refused."""
    wanted = catalogue.where(F.coalesce("url", F.lit("")) != "")
    twice = [r[0] for r in wanted.groupBy("manual_id").count().where("count > 1").orderBy("manual_id").limit(20).collect()]
    if twice:
        raise ValueError(f"entries share an id: {twice}")
    return pending(wanted, have, limit)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(manual_id, path, length, content, is_pdf) of the files of a folder."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.pdf)?\z", 1)
    return rows.select(name.alias("manual_id"), "path", "length", "content", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))
