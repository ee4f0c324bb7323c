"""One thin query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, infilling, langid, lines, mixing, neighbours, ngram_join, packing, secrets, spelling, suffix_dedup, toxicity, urls
from .common import bounded_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The rules (host, path, verdict) of the URL query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def query(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def held_out(id_col: str) -> Column:
    return F.coalesce(langid.fold(F.col(id_col)) == 2, F.lit(False))


def learnable(id_col: str) -> Column:
    return F.coalesce(langid.fold(F.col(id_col)) != 2, F.lit(False))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search_nearest(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score", "probed")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select("doc_id", "n_chars", "n_removed", F.size("spans").cast("long").alias("n_spans"), _digest(F.col("kept")).alias("kept_sha256"), spans.alias("spans"), F.size("short").cast("long").alias("n_short"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *map(number, secrets.BASE_KINDS), _digest(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(learnable("doc_id")), "doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(learnable("doc_id")))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLES["op8_url_filter"] = """
with p as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(r_host, r_path, r_verdict) as (values %s),
m as (select page_id, host, path, r_host || r_path as rule, r_verdict as verdict,
             row_number() over (partition by page_id order by length(r_host || r_path) desc nulls last) as place
      from h left join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where place = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _digest(F.array_join("items", ",")).alias("items_sha256"), decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op9_decontamination"] = f"""
with d as materialized (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
s as (select item, w, least(len(w), 13) as n from b where len(w) > 0),
x as (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from s),
windows as materialized (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win from x),
sizes as (select distinct n from windows),
p as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
hits as materialized (select doc_id, i, p.n, item from p join windows v on v.n = p.n and v.win = array_to_string(p.w[i:i + p.n - 1], ' ')),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(i, i + n)) as q from hits) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""


def marginals() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}


RATE, POWER, TOLERANCE, ROUNDS = 0.5, 0.7, 1e-4, 100


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.mix(docs, marginals(), rate=RATE, power=POWER, tolerance=TOLERANCE)
    return mixed.select("doc_id", "tokens", F.round("p", 4).alias("p"), "kept")


def _mixing_sql() -> str:
    """Raking as a recursion over the cells: a step for each marginal of a round, until a round moves no probability much."""
    names = ["source", "lang", "topic"]
    targets = ", ".join(f"{RATE} * (select n from total) * pow(h_{m}, {POWER}) / (select sum(s) from (select pow(sum(tokens)::double, {POWER}) as s from d group by {m} having sum(tokens) > 0)) as t_{m}" for m in names)
    at = f"select *, p as before from r where moved > {TOLERANCE:g} and round < {ROUNDS}"
    for m in names:
        at = f"select * replace (least(1.0, p * coalesce(t_{m} / nullif(sum(tokens * p) over (partition by {m}), 0), 1.0)) as p) from ({at})"
    return f"""with recursive d as materialized (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
  coalesce(case when text is null then null when contains(lower(text), 'licen') then 'licence'
    when contains(lower(text), '@') or contains(lower(text), 'http') then 'contact'
    when contains(lower(text), '%%%') or contains(lower(text), '!!') then 'noise'
    when length(text) < 1000 then 'short' when length(text) < 4000 then 'article' else 'long' end, '') as topic,
  coalesce(cast(ceil(strlen(text) / 4.0) as bigint), 0) as tokens from documents),
total as materialized (select sum(tokens)::double as n from d),
h as (select *, {", ".join(f"(sum(tokens) over (partition by {m}))::double as h_{m}" for m in names)} from (select source, lang, topic, sum(tokens)::double as tokens from d group by all)),
r as (select 0 as round, source, lang, topic, tokens, {targets}, {RATE}::double as p, 1.0::double as moved from h
  union all
  select round + 1, source, lang, topic, tokens, {", ".join(f"t_{m}" for m in names)}, p, max(abs(p - before)) over () from ({at}))
select d.doc_id, d.tokens, round(p, 4) as p, ('0x' || substr(md5('mix:' || d.doc_id), 1, 8))::ubigint / 4294967296.0 < p as kept
from d join (select * from r where round = (select max(round) from r)) c using (source, lang, topic)"""


ORACLES["op10_mixing"] = _mixing_sql()


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def _spelling_sql() -> str:
    """The checksum as a fold over a table of 256 remainders, which eight halvings of each byte make."""
    halved = "b"
    for _ in range(8):
        halved = f"case when {halved} & 1 = 1 then xor({halved} >> 1, 3988292384) else {halved} >> 1 end" if halved == "b" else f"(select case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from (select {halved} as x))"
    return f"""with tab as materialized (select list(r order by b) as t from (select b, {halved} as r from (select unnest(range(256))::bigint as b))),
run as materialized (select doc_id, w, count(*) as c from (select doc_id, translate(unnest(regexp_extract_all(text, '[{spelling.LETTERS}]+')), '{spelling.UPPER}', '{spelling.LOWER}') as w from documents) where length(w) >= 6 group by all),
sum as materialized (select doc_id, w, c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(k)) + 1), lambda i: ('0x' || substr(hex(encode(k)), 2 * i - 1, 2))::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h
  from (select *, concat(coalesce(doc_id::varchar, ''), ':', w) as k from run), tab),
v as materialized (select word, sum(c)::bigint as n from (select case when h % 199 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, c from sum) where length(word) >= 6 group by word having sum(c) >= 5),
cut as materialized (select word, n, i, left(word, i - 1) as a, substr(word, i + 1) as z from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as materialized (
  select x.word, x.n, y.word as other, y.n as m from cut x join cut y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word
  union select x.word, x.n, y.word, y.n from cut x join v y on y.word = x.a || x.z
  union select y.word, y.n, x.word, x.n from cut x join v y on y.word = x.a || x.z),
best as materialized (select word, count(*)::bigint as n_near, max(m) as m, min(other collate "C") filter (where m = top) as other from (select *, max(m) over (partition by word) as top from near) group by word),
f as materialized (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 5 * v.n then other end as form, case when m >= 5 * v.n then m end as form_n from v left join best using (word)),
up as (with recursive r as (select word, word as here, 0 as step from f union all select r.word, f.form, step + 1 from r join f on f.word = r.here where f.form is not null) select word, max_by(here, step) as root from r group by word)
select word, form, root, n, n_near, form_n from f join up using (word)"""


ORACLES["op11_spelling_variants"] = _spelling_sql()


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _digest(F.col("output")).alias("output_sha256"), _digest(infilling.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = """with d as materialized (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as g from documents),
h as materialized (select *, len(t) as n, ('0x' || substr(g, 1, 8))::ubigint % (len(t) + 1)::ubigint as a, ('0x' || substr(g, 9, 8))::ubigint % (len(t) + 1)::ubigint as b, ('0x' || substr(g, 17, 8))::ubigint % 100 as c, ('0x' || substr(g, 25, 8))::ubigint % 100 as e from d),
p as materialized (select doc_id, text, n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end as form,
  array_to_string(t[1:least(a, b)], '') as pre, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') as mid, array_to_string(t[greatest(a, b) + 1:], '') as suf from h)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p"""


#: The tokenizer whose tokens are packed, by its name among the installed public ones.
TOKENIZER = "byte_bpe_50k.json"


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), packing.public(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
