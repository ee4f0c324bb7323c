"""Figures: which placements count, and which belong to a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_AREA = 10_000


def placements(images: DataFrame) -> DataFrame:
    """Figures of images (manual_id, page, seq, x0, y0, x1, y1, width, height), numbered on their page.

    Small images and boxes that are empty or not finite don't count, and of
    those on the same box, to two decimals, the first does.
    """
    box = ["x0", "y0", "x1", "y1"]
    finite = F.lit(True)
    for c in box:
        finite &= F.coalesce(F.col(c).between(-1e300, 1e300), F.lit(False))
    rows = images.where((F.col("width") * F.col("height") >= MIN_AREA) & finite & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    # Scalar keys and values, so that the aggregation hashes and doesn't sort.
    keys = [F.round(c, 2).alias(c) for c in box]
    first = rows.groupBy("manual_id", "page", *keys).agg(F.min("seq").alias("seq"), F.min_by("width", "seq").alias("width"), F.min_by("height", "seq").alias("height"))
    n = F.row_number().over(Window.partitionBy("manual_id", "page").orderBy("seq"))
    found = first.select("manual_id", "page", n.alias("n"), F.array(*box).alias("bbox"), "width", "height")
    return found.select(F.format_string("%s:%04d:%d", "manual_id", "page", "n").alias("figure_id"), "*", F.format_string("p%04d_%d.jpg", "page", "n").alias("file"))


def on_pages(figures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Figures, or images, printed on wanted (manual_id, page)."""
    return figures.join(wanted.select("manual_id", "page").distinct(), ["manual_id", "page"], "left_semi")


def by_page(figures: DataFrame) -> DataFrame:
    """(manual_id, page, figures): the figures of each page in order."""
    return figures.groupBy("manual_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", "figure_id", "file", "width", "height"))).alias("figures"))


def pages_of(hits: DataFrame) -> DataFrame:
    """(manual_id, page) of all hits' pages."""
    return hits.select("manual_id", F.explode("pages").alias("page")).distinct()


def with_figures(hits: DataFrame, figures: DataFrame, key: list[str]) -> DataFrame:
    """hits, which ``key`` tells apart, with the array of figures on their pages, in the order of the pages, then of the figures; none is an empty array.

    The figures of a page are shaped once, and listed once for all hits of the
    same manual and pages. Hits are only then given their list, and figures are
    not moved for each of them.
    """
    url = F.concat(F.lit("/api/figure/"), "manual_id", F.lit("/"), "file").alias("url")
    shaped = F.array_sort(F.collect_list(F.struct("n", F.struct("figure_id", url, "page", "width", "height").alias("f"))))
    paged = figures.groupBy("manual_id", "page").agg(F.transform(shaped, lambda x: x["f"]).alias("found"))
    places = ["manual_id", "pages"]
    met = hits.select(*places).distinct().select(*places, F.posexplode("pages").alias("p", "page")).join(paged, ["manual_id", "page"])
    listed = met.groupBy(*places).agg(F.array_sort(F.collect_list(F.struct("p", "found"))).alias("listed"))
    lists = listed.select(*places, F.flatten(F.transform("listed", lambda x: x["found"])).alias("figures_"))
    joined = hits.join(lists.hint("merge"), places, "left").select(*hits.columns, "figures_")  # lists may be long: no broadcast
    empty = F.expr("cast(array() as array<struct<figure_id:string,url:string,page:int,width:int,height:int>>)")
    return joined.withColumn("figures", F.coalesce("figures_", empty)).drop("figures_")
