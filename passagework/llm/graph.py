"""Connected components over a table of links, kept in DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the component's smallest node.

    Stars are made larger and smaller in turn (Kiveris et al., 2014): every
    node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour. Rounds grow with the logarithm of a component's diameter, and
    links never exceed those given. Each round is a written table. Rounds go on
    until one changes nothing; if ``most`` don't suffice that is an error.
    """
    links = materialised(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), few=True)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b"))
    before = None
    for _ in range(most):
        both = links.union(links.select("b", "a"))
        least = materialised(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), few=True)
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = materialised(links.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct(), few=True)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {most} rounds")
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
