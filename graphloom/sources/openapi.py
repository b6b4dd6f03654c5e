"""OpenAPI specifications as routes, handlers and references, read schema-free with VARIANT values.

Specifications of any shape are parsed once; what lies below is reached by exploding objects and arrays
level by level, so that no schema has to be known and none is inferred from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Keys of a path item that are operations: fixed values.
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
#: Confidence of a handler found by its operation's id, and by the parts of its path: fixed values.
BY_OPERATION, BY_PATH = 0.95, 0.6


def parsed(specs: DataFrame, text: str = "text") -> DataFrame:
    """``specs`` with a column v: the text as a VARIANT, null where it is no JSON."""
    return specs.withColumn("v", F.try_parse_json(text))


def _exploded(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` once for each member of the object or array ``value``, with its key (null in arrays), pos and value."""
    tvf = rows.sparkSession.tvf.variant_explode(value.outer())
    return rows.lateralJoin(tvf)


def operations(specs: DataFrame, spec_id: str = "spec_id") -> DataFrame:
    """(spec_id, path, method, operation_id, params): the operations of every specification.

    params are the names between braces in the path, in order, comma-joined. Text that is no JSON, or has no
    object at paths, has no operations; keys of a path item that are not methods are passed over.
    """
    rows = specs.select(F.col(spec_id).alias("spec_id"), F.try_variant_get("v", "$.paths", "variant").alias("paths"))
    paths = _exploded(rows, F.col("paths")).where("key IS NOT NULL").select("spec_id", F.col("key").alias("path"), F.col("value").alias("item"))
    found = _exploded(paths, F.col("item")).where(F.lower("key").isin(METHODS))
    params = F.array_join(F.regexp_extract_all("path", F.lit(r"(?:^|/)\{([^/]+)\}(?=/|$)"), 1), ",")
    return found.select("spec_id", "path", F.lower("key").alias("method"), F.try_variant_get("value", "$.operationId", "string").alias("operation_id"), params.alias("params"))


def references(specs: DataFrame, spec_id: str = "spec_id") -> DataFrame:
    """(spec_id, at, target): every string under a key $ref, with the place that holds it ('/'-joined keys and positions).

    One round for each level of nesting, over the objects and arrays in whose text a $ref still stands.
    """
    place = F.concat_ws("/", F.when(F.col("at") != "", F.col("at")), F.coalesce("key", F.col("pos").cast("string")))
    deep = F.coalesce(F.substring("j", 1, 1).isin("{", "["), F.lit(False))  # as VARIANTs are written: strings begin with a quote
    holds = F.contains("j", F.lit('"$ref"'))
    frontier = cut(specs.select(F.col(spec_id).alias("spec_id"), F.lit("").alias("at"), F.to_json("v").alias("j")).where(holds), "refs")
    found = None
    while not frontier.isEmpty():
        # a VARIANT is written as text between rounds, which every file format can hold
        below = _exploded(frontier.withColumn("w", F.parse_json("j")), F.col("w")).select("spec_id", "at", "key", place.alias("place"), "value")
        below = below.select("spec_id", "at", "key", "place", F.to_json("value").alias("j"), F.try_variant_get("value", "$", "string").alias("s")).withColumn("inner", deep)
        below = cut(below.where((F.col("inner") & holds) | (~F.col("inner") & F.col("key").eqNullSafe("$ref"))), "refs")
        hit = below.where("NOT `inner`").select("spec_id", "at", F.col("s").alias("target"))
        found = hit if found is None else found.union(hit)
        frontier = below.where("`inner`").select("spec_id", F.col("place").alias("at"), "j")
    return found if found is not None else frontier.select("spec_id", "at", F.col("j").alias("target"))


def snake(name: Column) -> Column:
    """createUser and HTTPRoute as create_user and http_route."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_"))


def handlers(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(spec_id, path, method, id, confidence): the symbols that serve an operation.

    A symbol called as the operation's id in snake case has 0.95; else symbols called method_parts, parts_handler or
    last-part_controller, after the path's parts without parameters, have 0.6. Names are compared without regard to case.
    """
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & ~p.rlike(r"^\{.+\}$"))
    way = snake(F.array_join(parts, "_"))
    by_path = F.array(F.concat_ws("_", "method", way), F.concat(way, F.lit("_handler")), F.concat(snake(F.try_element_at(parts, F.lit(-1))), F.lit("_controller")))
    asked = routes.select("spec_id", "path", "method", F.explode(F.concat(F.array(F.struct(snake(F.col("operation_id")).alias("name"), F.lit(BY_OPERATION).alias("c"))), F.transform(by_path, lambda n: F.struct(n.alias("name"), F.lit(BY_PATH).alias("c"))))).alias("x"))
    named = nodes.select("id", F.lower("name").alias("name"))
    met = asked.select("spec_id", "path", "method", "x.*").join(named, "name").groupBy("spec_id", "path", "method", "id").agg(F.max("c").alias("confidence"))
    best = met.groupBy("spec_id", "path", "method").agg(F.max("confidence").alias("confidence"))
    return met.join(best, ["spec_id", "path", "method", "confidence"]).select("spec_id", "path", "method", "id", "confidence")


def serves(pattern: Column, asked: Column) -> Column:
    """Whether an asked path fits a pattern: part by part, a {name} fits any; outer slashes don't count."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: p != "")
    fits = F.forall(F.zip_with(parts(pattern), parts(asked), lambda p, q: p.rlike(r"^\{.+\}$") | (p == q)), lambda ok: ok)
    return (F.size(parts(pattern)) == F.size(parts(asked))) & fits
