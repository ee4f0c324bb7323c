"""Operator 10: mixing sources to target weights by iterative proportional fitting.

Documents are first added up into cells, one for each combination of source,
language and topic. Raking then works on the table of cells alone: for one
marginal after another the cells' inclusion probabilities are scaled until the
expected tokens of each of its values meet their target, and cut at 1, so that
they stay probabilities. A document is drawn when a uniform number made from
its id falls below its cell's probability, so a draw is repeatable and needs no
order.

Cells number at most the product of the marginals' values. Up to
``cell_bytes``, which are added up, they are raked as arrays, for a round over a
few hundred numbers is no work for a cluster; beyond that they stay in a
DataFrame, where a round is one join for each marginal and its outcome a written
table. Both do the same arithmetic.

Rounds go on until one moves no probability by more than ``tolerance``, or for
``most`` rounds. What a cut at 1 leaves over goes to the other cells of its
values in the rounds after. Targets need not be within reach: a value may have
too few tokens for its own, or the cells that would be needed may not exist, as
where one large source has one language and a small one has many. Raking then
settles where the marginals' pulls balance, with the last marginal met as far as
its tokens go; cells that it would empty come near 0. Nothing is raised:
``residuals`` tells how far each value is from its target.

A null source or language is a value of its own; a null or empty text has no
tokens and doesn't count. Rows that share an id are drawn alike. An empty table
has no cells and stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised


def topic_of(text: Column) -> Column:
    """A coarse topic: what kind of document this is, read off its whole text."""
    low = F.lower(text)
    return (
        F.when(low.contains("licen"), "licence")
        .when(low.contains("@") | low.contains("http"), "contact")
        .when(low.contains("%%%") | low.contains("!!"), "noise")
        .when(F.char_length(text) < 1000, "short")
        .when(F.char_length(text) < 4000, "article")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """Token weight of a text: a token for each four bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def targets(cells: DataFrame, marginal: str, rate: float, power: float, total: float) -> DataFrame:
    """(marginal, target): of each value with tokens, in proportion to tokens ** power; all of them add up to rate * total."""
    by = cells.groupBy(marginal).agg(F.sum("tokens").alias("held")).where("held > 0").withColumn("share", F.pow(F.col("held").cast("double"), F.lit(power)))
    scale = by.agg(F.sum("share")).first()[0] or 1.0
    return by.select(marginal, (F.col("share") * F.lit(rate * total / scale)).alias("target"))


def _raked(cells: pd.DataFrame, marginals: Sequence[str], tolerance: float, most: int) -> np.ndarray:
    """The probabilities of cells (marginals.., tokens, p, targets)."""
    tokens, p = cells["tokens"].to_numpy(float), cells["p"].to_numpy(float)
    sides = []
    for m in marginals:
        codes, _ = pd.factorize(cells[m])
        target = np.full(codes.max(initial=-1) + 1, np.nan)
        target[codes] = cells[f"target_{m}"].to_numpy(float)
        sides.append((codes, target))
    for _ in range(most):
        before = p
        for codes, target in sides:
            held = np.bincount(codes, tokens * p, len(target)).astype(float)
            factor = np.divide(target, held, out=np.ones_like(held), where=(held > 0) & ~np.isnan(target))
            p = np.minimum(1.0, p * factor[codes])
        if np.abs(p - before).max(initial=0.0) <= tolerance:
            break
    return p


def rake(cells: DataFrame, marginals: Sequence[str], rate: float, power: float, tolerance: float = 1e-4, most: int = 100, cell_bytes: int = 16 << 20) -> DataFrame:
    """cells with a column p and, for each marginal m, a column ``target_m``."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for m in marginals:
        cells = cells.join(targets(cells, m, rate, power, total).withColumnRenamed("target", f"target_{m}"), m, "left")
    cells = materialised(cells.withColumn("p", F.lit(float(rate))), few=True)
    if size_of(cells, marginals) <= cell_bytes:
        few = cells.toPandas()  # at most so many bytes
        return cells.sparkSession.createDataFrame(few.assign(p=_raked(few, marginals, tolerance, most)).replace(np.nan, None), cells.schema)
    for _ in range(most):
        at = cells.withColumn("before", F.col("p"))
        for m in marginals:
            now = at.groupBy(m).agg(F.try_divide(F.max(f"target_{m}"), F.sum(F.col("tokens") * F.col("p"))).alias("factor"))
            at = at.join(now, m).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.coalesce("factor", F.lit(1.0)))).drop("factor")
        at = materialised(at, few=True)
        cells = at.drop("before")
        if (at.agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0] or 0.0) <= tolerance:
            break
    return cells


def size_of(cells: DataFrame, marginals: Sequence[str]) -> int:
    """Bytes of the table of cells, counted."""
    return cells.agg(F.sum(F.lit(16 + 8 * len(marginals)) + sum((F.octet_length(m) for m in marginals), F.lit(0)))).first()[0] or 0


def residuals(cells: DataFrame, marginals: Sequence[str]) -> DataFrame:
    """(marginal, value, target, expected, residual) of raked cells; residual is a share of the target."""
    rows = [cells.groupBy(F.col(m).alias("value")).agg(F.max(f"target_{m}").alias("target"), F.sum(F.col("tokens") * F.col("p")).alias("expected")).select(F.lit(m).alias("marginal"), "*") for m in marginals]
    return reduce(DataFrame.union, rows).where("target > 0").withColumn("residual", F.col("expected") / F.col("target") - 1)


def _cells(docs: DataFrame, marginals: dict[str, Column], text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, values of the marginals, tokens) of each document, and the cells; a document's own columns are within row, so no name clashes."""
    values = [F.coalesce(c.cast("string"), F.lit("")).alias(m) for m, c in marginals.items()]
    rows = docs.select(F.struct("*").alias("row"), tokens_of(F.col(text_col).cast("string")).alias("tokens"), *values)
    return rows, materialised(rows.groupBy(*marginals).agg(F.sum("tokens").alias("tokens")), few=True)


def mixed_cells(docs: DataFrame, marginals: dict[str, Column], text_col: str = "text", rate: float = 0.5, power: float = 0.7, tolerance: float = 1e-4) -> DataFrame:
    """The raked cells of docs, for a look at their residuals."""
    return rake(_cells(docs, marginals, text_col)[1], list(marginals), rate, power, tolerance)


def _drawn(docs: DataFrame, marginals: dict[str, Column], id_col: str, text_col: str, rate: float, power: float, tolerance: float, seed: str, broadcast_bytes: int) -> DataFrame:
    """(row, tokens, p, kept) of each document."""
    rows, cells = _cells(docs, marginals, text_col)
    cells = rake(cells, list(marginals), rate, power, tolerance).select(*marginals, "p")
    joined = rows.join(F.broadcast(cells) if size_of(cells, list(marginals)) <= broadcast_bytes else cells, list(marginals), "left")
    given = F.col("row").getField(id_col).cast("string")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(given, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return joined.select("row", "tokens", "p", (draw < F.col("p")).alias("kept"))


def _with(row: list[str], *added: str) -> list[Column]:
    return [*(F.col("row").getField(c).alias(c) for c in row if c not in added), *map(F.col, added)]


def mix(docs: DataFrame, marginals: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", rate: float = 0.5, power: float = 0.7, tolerance: float = 1e-4, seed: str = "mix", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """docs with the columns tokens, p and kept; named marginals give each document's values.

    Every document is returned; ``kept`` says whether it was drawn. The table of
    cells is broadcast while it has at most ``broadcast_bytes`` bytes, which are
    added up, and joined by shuffle beyond. Given columns of the three names are replaced.
    """
    drawn = _drawn(docs, marginals, id_col, text_col, rate, power, tolerance, seed, broadcast_bytes)
    return drawn.select(*_with(docs.columns, "tokens", "p", "kept"))


def draw(docs: DataFrame, marginals: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", rate: float = 0.5, power: float = 0.7, tolerance: float = 1e-4, seed: str = "mix", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The documents that are drawn, with the columns tokens and p; a given column ``kept`` passes untouched."""
    drawn = _drawn(docs, marginals, id_col, text_col, rate, power, tolerance, seed, broadcast_bytes)
    return drawn.where("kept").select(*_with(docs.columns, "tokens", "p"))
