"""Tables that the queries share, derived from the given ones, each with the same in SQL.

The given tables have no catalogue, pages or hits. Parts make the catalogue,
documents the pages (of the manual ``source``, or as manuals of their own), and
conversations the ranked hits. Marks that the operators look for are put in by
one expression, the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import with_ids
from ..scratch import scratch_path
from ..streaming import jobs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(slices: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stateful stream gives over slices of a table, one after another: after each it stops, and starts again from its checkpoint."""
    spark = slices[0].sparkSession
    where = scratch_path(spark, "stream")
    for rows in slices:
        rows.write.mode("append").parquet(f"{where}/in")
        stream = transform(spark.readStream.schema(rows.schema).parquet(f"{where}/in"))
        jobs.stateful(stream, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def dealt_out(df: DataFrame, least: int = 1_000_000) -> DataFrame:
    """df over all cores before heavy work on each row. A table of fewer rows than ``least`` may be one row group, which one task reads."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.count() < least else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_out(table(spark, sf_dir, "documents"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = lambda n: (2000 + F.col("p_size") % 20 + n).cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entry_ord"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)))).otherwise(F.array("p_name")).alias("model"),
        F.when(F.col("p_size") % 4 == 0, F.array(year(0), year(1))).otherwise(F.array(year(0))).alias("year"),
        F.array(F.when(F.col("p_partkey") % 13 == 0, "draft").otherwise(F.concat(two(1 + F.col("p_partkey") % 12), F.lit("."), two(F.col("p_size") % 27)))).alias("edition"),
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("https://x.example/"), "p_partkey")).alias("url"),
    )
    return with_ids(rows)


CATALOGUE = r"""cat as materialized (
  select p_partkey as entry_ord, p_brand as brand,
    case when p_partkey % 3 = 0 then [p_name, split_part(p_name, ' ', 2)] else [p_name] end as model,
    case when p_size % 4 = 0 then [cast(2000 + p_size % 20 as varchar), cast(2001 + p_size % 20 as varchar)] else [cast(2000 + p_size % 20 as varchar)] end as year,
    [case when p_partkey % 13 = 0 then 'draft' else lpad(cast(1 + p_partkey % 12 as varchar), 2, '0') || '.' || lpad(cast(p_size % 27 as varchar), 2, '0') end] as edition,
    case when p_type = 'ECONOMY' then 'https://x.example/' || p_partkey end as url from part),
ids as materialized (
  select *, brand || '_' || array_to_string(list_transform(model, lambda x: trim(regexp_replace(x, '[^A-Za-z0-9]+', '-', 'g'), '-')), '+') || '_' || array_to_string(edition, '+') as manual_id from cat),
sel as materialized (
  select manual_id, brand, model[m] as model, year[y] as year, edition[e] as edition, entry_ord * 1000 + m * 100 + y * 10 + e as pos
  from (select *, unnest(range(1, len(edition) + 1)) as e from (select *, unnest(range(1, len(year) + 1)) as y from (select *, unnest(range(1, len(model) + 1)) as m from ids))))"""

KEY = "try_cast(regexp_extract({0}, '^(\\d\\d)\\.(\\d\\d)$', 2) as int)", "try_cast(regexp_extract({0}, '^(\\d\\d)\\.(\\d\\d)$', 1) as int)"
NEWEST = ", ".join(f"coalesce({k.format('edition')}, 0) desc" for k in KEY)


def marked_text() -> Column:
    """A document's text with word wraps, a bullet, a caption, references, leaders and a page number put in."""
    leaders = F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("Capítulo . . . . 12\n"), 30)).otherwise("")
    number = F.when(F.col("doc_id") % 4 == 0, F.concat((F.col("doc_id") % 900).cast("string"), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("Manual "), F.col("source"), F.lit(" parte "), (F.floor(F.col("doc_id") / 40) % 5).cast("string"), F.lit("\n"))
    wrapped = F.replace(F.replace("text", F.lit("tion"), F.lit("t-\nion")), F.lit("ung"), F.lit("un-\ng"))
    tail = F.concat(F.lit("\n● punto uno\nsigue\nFig. 3 pie\nver la página "), (F.col("doc_id") % 400).cast("string"), F.lit(", fig. "), (F.col("doc_id") % 90).cast("string"), F.lit(" » pág.\n59 y en la pág. 7.\nfin\n"))
    return F.concat(number, head, leaders, wrapped, tail)


MARKED = r"""concat(case when doc_id % 4 = 0 then (doc_id % 900) || chr(10) else '' end,
  'Manual ' || source || ' parte ' || cast(floor(doc_id / 40) % 5 as int) || chr(10),
  case when doc_id % 9 = 0 then repeat('Capítulo . . . . 12' || chr(10), 30) else '' end,
  replace(replace(text, 'tion', 't-' || chr(10) || 'ion'), 'ung', 'un-' || chr(10) || 'g'),
  chr(10) || '● punto uno' || chr(10) || 'sigue' || chr(10) || 'Fig. 3 pie' || chr(10) || 'ver la página ' || (doc_id % 400) || ', fig. ' || (doc_id % 90) || ' » pág.' || chr(10) || '59 y en la pág. 7.' || chr(10) || 'fin' || chr(10))"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of the manual that is their source."""
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return docs.select(F.col("source").alias("manual_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("int").alias("page"), marked_text().alias("text"))


_LINES = """ln as materialized (select manual_id, ord, len(l) as n, unnest(range(len(l))) as i, unnest(l) as line from (
  select manual_id, ord, list_filter(list_transform(string_split(regexp_replace(text, '[\\x{E000}-\\x{F8FF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as l from pg)),
edge as materialized (select *, i < 2 or i >= n - 2 as at_edge, regexp_full_match(line, '[0-9]{1,4}') as num from ln),
chrome as materialized (select manual_id, line from (select distinct manual_id, ord, line from edge where at_edge) group by manual_id, line having count(*) >= 5),
mark as materialized (select e.*, at_edge and num as number, at_edge and not num and c.line is not null as running from edge e left join chrome c using (manual_id, line)),
nav as materialized (select manual_id, ord from ln group by manual_id, ord having avg(case when regexp_matches(line, '\\.\\s*\\.\\s*\\.\\s*\\.') then 1 else 0 end) >= 0.3)"""

PAGES = f"pg as materialized (select source as manual_id, doc_id as ord, {MARKED} as text from documents),\n{_LINES}"


def own_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a manual, twelve lines to a page."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("d"), "doc_id").alias("source"))
    lines = docs.select(F.col("source").alias("manual_id"), F.split(marked_text(), "\n").alias("l"))
    page = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 12).cast("int")), lambda p: F.array_join(F.slice("l", p * 12 + 1, 12), "\n"))
    return lines.select("manual_id", F.posexplode(page).alias("ord", "text")).select("manual_id", F.col("ord").cast("long").alias("ord"), (F.col("ord") + 1).alias("page"), "text")


OWN_PAGES = f"""pg as materialized (select 'd' || doc_id as manual_id, p as ord, array_to_string(l[p * 12 + 1:p * 12 + 12], chr(10)) as text
  from (select doc_id, l, unnest(range((len(l) - 1) // 12 + 1)) as p from (select doc_id, string_split({MARKED}, chr(10)) as l from (select doc_id, text, 'd' || doc_id as source from documents)))),
{_LINES}"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, at, size): the lines of each document that aren't empty."""
    rows = documents(spark, sf_dir).select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("l"))
    return rows.select("doc_id", F.posexplode("l").alias("at", "line")).select("doc_id", "at", F.char_length("line").alias("size"), "line")


UNITS = """l as materialized (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as l from documents),
u as materialized (select doc_id, list_transform(l, lambda x: length(x)) as s, len(l) as n from l where len(l) > 0)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as ranked hits; every turn repeats the first paragraph of the one before."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.when(F.col("role") == "user", F.col("role")).alias("section"), "text")
    previous = F.lag("text").over(Window.partitionBy("question_id").orderBy("rank"))
    return rows.withColumn("text", F.concat(F.coalesce(F.concat(F.split_part(previous, F.lit("\n"), F.lit(1)), F.lit("\n")), F.lit("")), "text"))


HITS = """hits as materialized (select conv_id as question_id, turn as rank, case when role = 'user' then role end as section,
  concat(coalesce(split_part(lag(text) over (partition by conv_id order by turn), chr(10), 1) || chr(10), ''), text) as text from conversations)"""
