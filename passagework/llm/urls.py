"""Operator 8: URL filters.

Each URL expands into host-suffix and path-prefix expressions. Their SHA-256
digests meet the rules' in an equi-join on the first four bytes; the full
digests then confirm a match and the longest rule decides.

Only expressions of a shape that some rule has (so many labels of host, so many
characters of path) are made, so a long host or path costs no more than the
rules' shapes, which are a few, do. Host and path repeat, so distinct pairs are expanded and the
verdict joins back on the pair. The list of rules is broadcast only while it is below
``broadcast_bytes``, which is measured; beyond that the join on short
digests is an ordinary shuffled one.

A null URL, or one without ``://``, has an empty host and path, fits no rule and
takes no part in the joins. Repeated rows each keep their row. URLs of any
length take time in proportion to it. An empty table of rules leaves everything
to the default; an empty table of pages gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

SHORT = 8  # hexadecimal digits of the short digest


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages.

    rules: (host, path, verdict); a rule covers its host with all subdomains
    where the path starts with the rule's. Of the rules that fit, the longest
    wins; of equal ones, ``block``, then the smaller text.
    """
    listed = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    listed = listed.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, SHORT))
    shape = F.struct(_labels(F.col("r_host")).alias("labels"), F.char_length("r_path").alias("length"))
    size, shapes = listed.agg(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 128), F.array_sort(F.collect_set(shape))).first()  # few: as many as rules differ in shape
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    out = [F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")]
    nothing = rows.withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>")).select(*out)
    if not shapes:
        return nothing

    pairs = rows.select("host", "path").where("host <> ''").distinct()
    known = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["length"]).alias("length")) for s in shapes])
    fitting = F.filter(known, lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["length"] <= F.char_length("path")))
    expressions = pairs.select("host", "path", F.explode(fitting).alias("s"))
    suffix, prefix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("s.labels")), F.substring(F.col("path"), F.lit(1), F.col("s.length"))
    expressions = expressions.withColumn("digest", _digest(suffix, prefix)).select("host", "path", "digest", F.substring("digest", 1, SHORT).alias("short"))

    found = expressions.join(F.broadcast(listed) if size <= broadcast_bytes else listed, "short").where("digest = r_digest")
    rule = F.concat("r_host", "r_path")
    verdicts = found.groupBy("host", "path").agg(F.min(F.struct((-F.char_length(rule)).alias("length"), (F.col("r_verdict") != "block").alias("mild"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    return rows.where("host <> ''").join(verdicts, ["host", "path"], "left").select(*out).union(nothing.where("host = ''"))
