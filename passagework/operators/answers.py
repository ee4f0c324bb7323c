"""From hits to an answer: prompt, request, reply and the events of a streamed reply.

Hits are rows (question_id, rank, section, text, ..). A reply in pieces is rows
(reply_id, seq, body): the JSON of each piece in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, page_label, section_label, strip

MAX_TOKENS = 4096
REPLY = "candidates array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>, usageMetadata struct<totalTokenCount:long>, promptFeedback struct<blockReason:string>"
RETRIES, RETRY_CODES = 4, (429, 500, 502, 503, 504)


def seen(hits: DataFrame) -> DataFrame:
    """Hits without the paragraphs that an earlier hit of their question shows; an emptied one is left out."""
    rows = hits.select("question_id", "rank", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    first = rows.groupBy("question_id", "p").agg(F.min("rank").alias("first"))
    kept = rows.join(first, ["question_id", "p"]).where(F.col("rank") == F.col("first"))
    whole = kept.groupBy("question_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "\n").alias("text"))
    return hits.drop("text").join(whole, ["question_id", "rank"])


def prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, prompt) of questions (question_id, question): the fragments in order, then the question."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", section_label(F.col("section")).alias("label"), "text")))
    one = lambda h, i: F.concat(F.lit("--- Fragment "), (i + 1).cast("string"), F.lit(" ("), h["label"], F.lit(") ---\n"), h["text"])
    fragments = hits.groupBy("question_id").agg(F.array_join(F.transform(ordered, one), "\n\n").alias("fragments"))
    text = F.concat(F.coalesce("fragments", F.lit("")), F.lit("\n\n--- Question ---\n"), "question")
    return questions.join(fragments, "question_id", "left").select("question_id", text.alias("prompt"))


def payload(prompt: Column, system: Column, thinking: str | None = None) -> Column:
    """The JSON of a request; the level of thinking is only there when set."""
    text = lambda c: F.struct(F.array(F.struct(c.alias("text"))).alias("parts"))
    config = [F.lit(0).alias("temperature"), F.lit(MAX_TOKENS).alias("maxOutputTokens")]
    if thinking:
        config.append(F.struct(F.lit(thinking).alias("thinkingLevel")).alias("thinkingConfig"))
    contents = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(prompt.alias("text"))).alias("parts")))
    return F.to_json(F.struct(contents.alias("contents"), text(system).alias("systemInstruction"), F.struct(*config).alias("generationConfig")))


def spoken(body: Column) -> Column:
    """struct(text, finish, tokens) of the first candidate of a piece; all may be missing, and what else a piece holds, of whatever shape, doesn't matter. No JSON is an empty piece."""
    said = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))
    return let(
        F.try_parse_json(body),
        lambda v: F.struct(
            F.array_join(F.transform(F.coalesce(F.try_variant_get(v, "$.candidates[0].content.parts", "array<variant>"), F.array().cast("array<variant>")), said), "").alias("text"),
            F.try_variant_get(v, "$.candidates[0].finishReason", "string").alias("finish"),
            F.try_variant_get(v, "$.usageMetadata.totalTokenCount", "long").alias("tokens"),
        ),
    )


def sse_bodies(lines: DataFrame, line: str = "line") -> DataFrame:
    """The rows of a stream that carry data, with it as ``body``; white space around a line goes, comments and blank lines are left out."""
    bare = strip(F.col(line))
    return lines.where(F.startswith(bare, F.lit("data:"))).withColumn("body", strip(F.substring(bare, 6, 1 << 30)))


def answer(replies: DataFrame, model: str, hits: DataFrame | None = None) -> DataFrame:
    """(reply_id, answer, model, tokens, hits, error) of whole replies (reply_id, body): an answer with what it was built from, or why there is none.

    hits: rows of ``shaped`` under the reply's id as question_id; without them the array is empty.
    A blocked reply tells its reason, or failing that is told whole.
    """
    s = replies.select("reply_id", "body", spoken(F.col("body")).alias("s"))
    none = F.coalesce(F.size(F.from_json("body", REPLY)["candidates"]), F.lit(0)) <= 0
    reason = F.coalesce(F.get_json_object("body", "$.promptFeedback"), F.col("body"), F.lit(""))
    early = F.col("s.finish").isNotNull() & (F.col("s.finish") != "STOP")
    error = F.when(none, F.concat(F.lit(f"no answer from {model}: "), reason)).when(early, F.concat(F.lit(f"{model} stopped early ("), "s.finish", F.lit("); the answer would be incomplete")))
    told = s.select("reply_id", F.when(error.isNull(), strip(F.col("s.text"))).alias("answer"), F.lit(model).alias("model"), F.when(error.isNull(), F.col("s.tokens")).alias("tokens"), error.alias("error"))
    if hits is None:
        return told.select("reply_id", "answer", "model", "tokens", F.array().alias("hits"), "error")
    fields = [c for c in hits.columns if c != "question_id"]
    gathered = hits.groupBy(F.col("question_id").alias("reply_id")).agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in fields if c != "rank")))).alias("hits"))  # k to a question
    empty = F.array().cast(gathered.schema["hits"].dataType)
    return told.join(gathered, "reply_id", "left").select("reply_id", "answer", "model", "tokens", F.coalesce("hits", empty).alias("hits"), "error")


#: Fixed value: what an interface trims off a question.
TRIMMED = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def to_send(question: Column, busy: Column) -> Column:
    """The question as it is sent, or null while it may not be: when it is blank, or another is under way."""
    trimmed = F.btrim(question, F.lit(TRIMMED))
    return F.when((trimmed != "") & ~F.coalesce(busy, F.lit(False)), trimmed)


def events(pieces: DataFrame, hits: DataFrame, model: str) -> DataFrame:
    """(reply_id, seq, event, payload): hits once, a token for each piece with text, then one done or error.

    hits: (reply_id, hits as JSON). A reply without a reason to finish, or with
    another than STOP, didn't finish.
    """
    s = pieces.select("reply_id", "seq", spoken(F.col("body")).alias("s")).select("reply_id", "seq", "s.*")
    first = hits.select("reply_id", F.lit(0).cast("long").alias("seq"), F.lit("hits").alias("event"), F.col("hits").alias("payload"))
    at = F.row_number().over(Window.partitionBy("reply_id").orderBy("seq"))
    tokens = s.where("text <> ''").select("reply_id", at.cast("long").alias("seq"), F.lit("token").alias("event"), F.col("text").alias("payload"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    ends = s.groupBy("reply_id").agg(last("finish").alias("finish"), last("tokens").alias("tokens"), F.count_if(F.col("text") != "").alias("n"))
    ends = hits.select("reply_id").join(ends, "reply_id", "left")
    done = F.coalesce(F.col("finish") == "STOP", F.lit(False))
    final = ends.select(
        "reply_id",
        (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("seq"),
        F.when(done, "done").otherwise("error").alias("event"),
        F.when(done, F.to_json(F.struct(F.lit(model).alias("model"), "tokens"))).otherwise(F.concat(F.lit(f"{model} stopped early ("), F.coalesce("finish", F.lit("None")), F.lit("); the answer is incomplete"))).alias("payload"),
    )
    return first.unionByName(tokens).unionByName(final)


def asked_wait(body: Column) -> Column:
    """Seconds a refused request is told to wait, and one more; null if it isn't told so, or not in JSON. Details of other shapes are passed over."""
    details = F.try_variant_get(F.try_parse_json(body), "$.error.details", "array<variant>")
    told = F.get(F.filter(details, lambda d: F.endswith(F.try_variant_get(d, "$['@type']", "string"), F.lit("RetryInfo"))), F.lit(0))
    return F.regexp_replace(F.try_variant_get(told, "$.retryDelay", "string"), r"s+\z", "").try_cast("double") + 1


def retry_wait(code: Column, attempt: Column, delay: Column, told: Column, header: Column) -> Column:
    """The pause before another attempt, null when a failure is final; a null code is no HTTP failure. A header that says 0 is kept to."""
    return F.when(attempt >= RETRIES, None).when(code.isNull(), delay).when(code.isin(*RETRY_CODES), F.coalesce(F.nullif(told, F.lit(0.0)), header, delay))


def status(outcome: Column) -> Column:
    """The HTTP status of an outcome."""
    return F.when(outcome == "ok", 200).when(outcome.isin("bad body", "bad fields", "too long"), 400).when(outcome == "unknown", 404).otherwise(502)


def shaped(hits: DataFrame) -> DataFrame:
    """Hits as an interface reads them; hits carry their figures."""
    return hits.select("question_id", "rank", section_label(F.col("section")).alias("section"), page_label(F.col("printed"), F.col("pages")).alias("pages"), "score", "text", "chunk_id", "figures")


def audit_rate(sent: DataFrame, at: str = "ts", count: str = "n", window: int = 60, by: str = "event_id") -> DataFrame:
    """sent with ``held``: what was sent in the ``window`` seconds up to each row, the far end open.

    The whole table is one series, so it is cut into buckets of one window. A
    row is also context for the next bucket, and no bucket needs more than the
    one before it.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = sent.withColumn("_t", micros).withColumn("_b", F.floor(F.col("_t") / (window * 1_000_000)))
    wide = rows.withColumn("_to", F.explode(F.array("_b", F.col("_b") + 1)))
    held = F.sum(count).over(Window.partitionBy("_to").orderBy("_t").rangeBetween(-window * 1_000_000 + 1, 0))
    return wide.withColumn("held", held).where("_to = _b").drop("_t", "_b", "_to")
