"""Statistics of each stage, a row for each manual, and the flags they raise.

A manual that failed has its error and no numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import accents, strip
from . import pages as P

EMPTY_PAGE = 20


def extract_stats(pages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pages.groupBy(F.col("manual_id").alias("name")).agg(
        F.count("*").alias("pages"),
        F.sum(F.char_length(text)).alias("chars"),
        F.count_if(F.char_length(strip(text)) < EMPTY_PAGE).alias("empty"),
        F.sum(accents(text)).cast("long").alias("accents"),
    )


def chunk_stats(pages: DataFrame, units: DataFrame, chunks: DataFrame) -> DataFrame:
    nav = P.nav_pages(P.page_rows(pages)).groupBy("manual_id").agg(F.count("*").alias("nav"))
    size = F.char_length("text")
    of_chunks = chunks.groupBy("manual_id").agg(F.count("*").alias("chunks"), F.sum(size).alias("chars"), F.median(size).alias("median"))
    of_units = units.groupBy("manual_id").agg(F.count_if(F.coalesce("section", F.lit("")) == "").alias("unsectioned"))
    out = pages.groupBy("manual_id").agg(F.count("*").alias("pages"))
    for d in (nav, of_chunks, of_units):
        out = out.join(d, "manual_id", "left")
    return out.na.fill(0).withColumnRenamed("manual_id", "name")


def figure_stats(figures: DataFrame, skipped: DataFrame) -> DataFrame:
    """figures (manual_id, page, bytes); skipped (manual_id): a row for each one that couldn't be rendered."""
    drawn = figures.groupBy("manual_id").agg(F.count("*").alias("figures"), F.countDistinct("page").alias("pages"), F.sum("bytes").alias("bytes"))
    lost = skipped.groupBy("manual_id").agg(F.count("*").alias("skipped"))
    return drawn.join(lost, "manual_id", "full").na.fill(0).withColumnRenamed("manual_id", "name")


# The flags of each stage in order, with their conditions; those in QUIET are shown but fail nothing.
def _rules(stage: str) -> dict[str, Column]:
    c = F.col
    return {
        "extract": {
            "no pages or no text at all": (c("pages") == 0) | (c("chars") == 0),
            "under 200 chars/page": (c("pages") > 0) & (c("chars") < 200 * c("pages")),
            "almost no accented characters": (c("chars") > 0) & (c("accents") < 0.002 * c("chars")),
            "over 20% blank pages": (c("pages") > 0) & (c("empty") > 0.2 * c("pages")),
        },
        "chunk": {
            "no chunks": c("chunks") == 0,
            "fewer chunks than pages": (c("chunks") > 0) & (c("pages") > 0) & (c("chunks") < c("pages")),
            "over 10% unsectioned": c("unsectioned") > 0.1 * c("chunks"),
        },
        "figure": {
            "no figures": c("figures") == 0,
            "over 10% skipped": c("skipped") > 0.1 * (c("figures") + c("skipped")),
            "over 4 per page": (c("pages") > 0) & (c("figures") > 4 * c("pages")),
        },
    }[stage]


QUIET = {"over 4 per page"}


def flags(stats: DataFrame, stage: str) -> DataFrame:
    """(flag, name): what is wrong with which manual."""
    failed = F.col("error").isNotNull() if "error" in stats.columns else F.lit(False)
    rules = {"failed": failed} | {k: ~failed & v for k, v in _rules(stage).items()}
    found = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return stats.select(F.explode(found).alias("flag"), "name")


def report(stats: DataFrame, stage: str) -> DataFrame:
    """(flag, manuals, fails) for each flag that is raised."""
    return flags(stats, stage).groupBy("flag").agg(F.count("*").alias("manuals")).withColumn("fails", ~F.col("flag").isin(*QUIET))


def shown(stats: DataFrame, stage: str, most: int = 10) -> DataFrame:
    """(flag, place, name, more): the first manuals of each flag, and how many more there are."""
    raised = flags(stats, stage)
    counts = raised.groupBy("flag").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    place = F.row_number().over(Window.partitionBy("flag").orderBy("name"))
    return raised.withColumn("place", place).where(F.col("place") <= most).join(counts, "flag")


def totals(stats: DataFrame) -> DataFrame:
    """One row over all manuals of an extraction: manuals, pages, chars and chars a page."""
    return stats.agg(F.count("*").alias("manuals"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), (F.sum("chars") / F.greatest(F.sum("pages"), F.lit(1))).alias("chars_per_page"))
