"""What each of a table of requests gets: its route, its status and what it is answered with.

Requests are rows (.., method, path, body), as a service logs or queues them.
What can be asked for are tables too, the figures' files and the interface's, so
a request's file is found by a join and no path ever reaches a file system: one
that leaves its folder, or names a place from the root on, meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .vectors import TOP_K

# The routes, the largest body and the types of files by their endings.
CATALOG, FIGURE, API, ASK, STREAM = "/api/catalog", "/api/figure/", "/api/", "/api/ask", "/api/ask/stream"
MAX_BODY = 64 * 1024
TYPES = {"html": "text/html; charset=utf-8", "js": "text/javascript; charset=utf-8", "css": "text/css; charset=utf-8", "svg": "image/svg+xml", "ico": "image/x-icon"}
INDEX, REPLY = "index.html", "application/json; charset=utf-8"


def inside(path: Column) -> Column:
    """A path without empty steps, ``.`` and ``..``, as seen from its folder; null if it leaves the folder on its way."""
    nowhere = F.lit(None).cast("array<string>")

    def step(at: Column, name: Column) -> Column:
        back = F.when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(nowhere)
        return F.when(at.isNull() | name.isin("", "."), at).when(name == "..", back).otherwise(F.concat(at, F.array(name)))

    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def _get(path: Column) -> Column:
    """struct(route, wanted, error) of a GET."""
    made = lambda route, wanted, error=None: F.struct(F.lit(route).alias("route"), wanted.cast("string").alias("wanted"), F.lit(error).cast("string").alias("error"))
    rest = F.substring(path, len(FIGURE) + 1, 1 << 30)
    figure = F.when(rest.rlike("^[^/]*//"), None).otherwise(inside(rest))  # a name that begins at the root
    return F.when(path == CATALOG, made("catalog", F.lit(None))).when(path.startswith(FIGURE), made("figure", figure)).when(path.startswith(API), made("none", path, "no route")).otherwise(made("file", inside(path)))


def _post(path: Column, body: Column) -> Column:
    """struct(route, wanted, error) of a POST; wanted is the manual."""
    route = F.when(path == ASK, "ask").when(path == STREAM, "ask_stream").otherwise("none")

    def told(v: Column) -> Column:
        has = lambda name: F.is_variant_null(F.coalesce(F.try_variant_get(v, f"$.{name}", "variant"), F.parse_json(F.lit("null")))) == F.lit(False)
        k = F.coalesce(F.try_variant_get(v, "$.k", "string"), F.lit("0"))
        error = F.when((F.octet_length(body) > MAX_BODY) | v.isNull(), "bad body").when(route == "none", "no route").when(~has("manual") | ~has("question") | k.try_cast("int").isNull(), "bad fields")
        return F.struct(route.alias("route"), F.try_variant_get(v, "$.manual", "string").alias("wanted"), error.alias("error"))

    return let(F.try_parse_json(F.when(F.coalesce(body, F.lit("")) == "", F.lit("{}")).otherwise(body)), told)


def asked_for(body: Column) -> Column:
    """How many hits a body asks for: ``k``, or as many as usual."""
    k = F.try_variant_get(F.try_parse_json(body), "$.k", "string").try_cast("int")
    return F.coalesce(F.nullif(k, F.lit(0)), F.lit(TOP_K))


def routed(requests: DataFrame, figures: DataFrame, files: DataFrame) -> DataFrame:
    """requests with (route, status, target, kind, error); figures: (manual_id, file), files: (path) of what there is.

    A GET of a path that is no file is a place within the interface and gets its
    index. A null path is the root's; another method than GET and POST is refused.
    What an ask leads to is decided where it is answered: its status here says
    that it was understood.
    """
    path = F.coalesce(F.split_part("path", F.lit("?"), F.lit(1)), F.lit(""))
    other = F.struct(F.lit("none").alias("route"), F.lit(None).cast("string").alias("wanted"), F.lit("no method").alias("error"))
    told = requests.withColumn("_r", F.when(F.col("method") == "GET", _get(path)).when(F.col("method") == "POST", _post(path, F.col("body"))).otherwise(other))
    told = told.withColumns({"_route": F.col("_r.route"), "_wanted": F.col("_r.wanted")})
    there = figures.select(F.lit("figure").alias("_of"), F.concat_ws("/", "manual_id", "file").alias("_file")).union(files.select(F.lit("file"), "path")).distinct()
    found = told.join(there, (F.col("_route") == F.col("_of")) & (F.col("_wanted") == F.col("_file")), "left")
    built = F.lit(bool(files.where(F.col("path") == INDEX).take(1)))
    route = F.col("_route")
    target = F.when(route == "figure", F.col("_file")).when(route == "file", F.coalesce("_file", F.when(built, INDEX))).when(route.isin("ask", "ask_stream") & F.col("_r.error").isNull(), F.col("_wanted"))
    error = F.coalesce(F.col("_r.error"), F.when(route.isin("figure", "file") & target.isNull(), F.concat(F.lit("no "), route)))
    status = F.when(error.isNull(), 200).when(error.isin("bad body", "bad fields"), 400).when(error == "no method", 501).otherwise(404)
    ending = F.substring_index(target, ".", -1)
    kind = F.when(route == "figure", "image/jpeg").when(route == "file", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), ending), F.lit("application/octet-stream"))).when(route == "ask_stream", "application/x-ndjson; charset=utf-8")
    kind = F.when(error.isNull(), F.coalesce(kind, F.lit(REPLY))).otherwise(REPLY)
    return found.select(*requests.columns, route.alias("route"), status.alias("status"), target.alias("target"), kind.alias("kind"), error.alias("error"))
