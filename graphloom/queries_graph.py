"""Registered queries of blocks, reachability, cores, order statistics, budgets, candidates, blame and specifications."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graphs import with_graph
from graphloom.model import rounded
from graphloom.operators import access, aggregate, analytics, blocks, candidates, federation, lenses, questions, reach, reachability, search, stats, views
from graphloom.operators.ordered import order_statistics, running_sum
from graphloom.queries import _SCC, _SEV, G, query
from graphloom.session import cut, dealt, shared_dir
from graphloom.sources import history, manifest, openapi, runs, store
from graphloom.streaming import changes, reindex

# --- blocks --------------------------------------------------------------------------------


def severe(g: G) -> DataFrame:
    """customer -> supplier for each returned line with a blocker's discount: sparse, with cycles, trees and many components."""
    lines = g.lineitem.where("l_returnflag = 'R' AND l_discount >= 0.09").join(g.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


_SEVERE = "s AS MATERIALIZED (SELECT DISTINCT 'customer:' || o_custkey AS a, 'supplier:' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_discount >= 0.09), t AS MATERIALIZED (SELECT a AS x, b AS y FROM s UNION ALL SELECT b, a FROM s), v AS MATERIALIZED (SELECT DISTINCT x AS id FROM t)"
_ends = lambda e: e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()

query("al14_bridges", f"WITH RECURSIVE {_SEVERE}, r(a, b, id) AS (SELECT a, b, a FROM s UNION SELECT r.a, r.b, t.y FROM r JOIN t ON t.x = r.id WHERE NOT (least(t.x, t.y) = r.a AND greatest(t.x, t.y) = r.b)) SELECT a, b FROM s WHERE (a, b) NOT IN (SELECT (a, b) FROM r WHERE id = b)")(lambda g: blocks.bridges(severe(g)))
query(
    "al13_articulation_points",
    f"WITH RECURSIVE {_SEVERE}, w(a, b) AS (SELECT id, id FROM v UNION SELECT w.a, t.y FROM w JOIN t ON t.x = w.b), base AS (SELECT count(DISTINCT m) AS n FROM (SELECT min(b) AS m FROM w GROUP BY a)), "
    "r(c, start, id) AS (SELECT x, y, y FROM t UNION SELECT r.c, r.start, t.y FROM r JOIN t ON t.x = r.id WHERE t.y <> r.c), p AS (SELECT c, count(DISTINCT m) AS parts FROM (SELECT c, start, min(id) AS m FROM r GROUP BY 1, 2) GROUP BY c) "
    "SELECT c AS id, parts - 1 + n AS components FROM p, base WHERE parts > 1",
)(lambda g: (e := severe(g)) and blocks.articulation_points(_ends(e), e))

# --- reachability --------------------------------------------------------------------------


def _key(kind: str, c: str):
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def shortcuts(g: G) -> DataFrame:
    """The graph's edges with steps from regions to customers, nations and regions to parts, some of which longer paths replace."""
    place = F.col("p_partkey")
    down = g.customer.join(F.broadcast(g.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(_key("region", "n_regionkey"), _key("customer", "c_custkey"))
    parts = g.part.select(F.concat(F.lit("region:"), (place % 5).cast("string")), _key("part", "p_partkey"))
    near = g.part.select(F.concat(F.lit("nation:"), (place % 25).cast("string")), _key("part", "p_partkey"))
    return g.edges.select("src", "dst").union(down).union(parts).union(near)


_SHORT = ", h AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT 'region:' || n_regionkey, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'region:' || p_partkey % 5, 'part:' || p_partkey FROM part UNION SELECT 'nation:' || p_partkey % 25, 'part:' || p_partkey FROM part), c(a, b) AS (SELECT src, dst FROM h UNION SELECT c.a, h.dst FROM c JOIN h ON h.src = c.b)"
query("al7_transitive_reduction", with_graph(_SHORT + ", z AS (SELECT h.src, c.b AS dst FROM h JOIN c ON c.a = h.dst) SELECT src, dst FROM h WHERE (src, dst) NOT IN (SELECT (src, dst) FROM z)", "e", recursive=True))(lambda g: reachability.transitive_reduction(shortcuts(g)))


def _asked(g: G) -> DataFrame:
    """Each node of the flow graph beside the node of the same user whose event type comes first, both ways, and one of another user."""
    user = F.split_part("id", F.lit(":"), F.lit(1))
    nodes = g.flow_nodes.withColumn("u", user)
    first = nodes.groupBy("u").agg(F.min("id").alias("first"))
    own = nodes.join(first, "u").select(F.col("id").alias("a"), F.col("first").alias("b"))
    other = first.agg(F.max("first").alias("x"))
    return own.union(own.select("b", "a")).union(nodes.join(F.broadcast(other)).select("id", "x")).distinct()


_ASKED = ", v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), m AS (SELECT split_part(id, ':', 1) AS u, min(id) AS first FROM v GROUP BY 1), o AS (SELECT id AS a, first AS b FROM v JOIN m ON u = split_part(id, ':', 1)), q AS (SELECT a, b FROM o UNION SELECT b, a FROM o UNION SELECT id, (SELECT max(first) FROM m) FROM v)"
query("ga16_has_path", with_graph(", r(a, b) AS (SELECT src, dst FROM f UNION SELECT r.a, f.dst FROM r JOIN f ON f.src = r.b)" + _ASKED + " SELECT q.a, q.b, (q.a, q.b) IN (SELECT (a, b) FROM r) AS reaches FROM q", "f", recursive=True))(lambda g: reachability.Reach(g.flow_nodes, g.flow).reaches(_asked(g)))

# core numbers by the definition: the best least degree of all sets of a user's event types that hold the node
_CORE = ", p AS (SELECT DISTINCT split_part(src, ':', 1) AS u, least(src, dst) AS a, greatest(src, dst) AS b FROM f WHERE src <> dst), v AS (SELECT u, a AS id FROM p UNION SELECT u, b FROM p), k AS (SELECT u, id, row_number() OVER (PARTITION BY u ORDER BY id) - 1 AS bit, count(*) OVER (PARTITION BY u) AS n FROM v), "
_CORE += "s AS (SELECT u, unnest(range(1, CAST(2 ** max(n) AS BIGINT))) AS mask FROM k GROUP BY u), i AS (SELECT s.u, mask, id FROM s JOIN k ON k.u = s.u AND (mask >> bit) & 1 = 1), d AS (SELECT i.u, i.mask, i.id, count(j.id) AS deg FROM i LEFT JOIN p ON p.u = i.u AND (p.a = i.id OR p.b = i.id) LEFT JOIN i j ON j.u = i.u AND j.mask = i.mask AND j.id = CASE WHEN p.a = i.id THEN p.b ELSE p.a END GROUP BY 1, 2, 3)"
query("al15_core_numbers", with_graph(_CORE + ", l AS (SELECT u, mask, min(deg) AS deg FROM d GROUP BY 1, 2) SELECT d.id, CAST(max(l.deg) AS BIGINT) AS core FROM d JOIN l USING (u, mask) GROUP BY d.id", "f"))(lambda g: analytics.core_numbers(g.flow))

# dominators by the definition: what cannot be reached once a node is taken out
_DOM = ", d AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), r(id) AS (SELECT 'region:1' UNION SELECT dst FROM r JOIN d ON src = id), o AS MATERIALIZED (SELECT id FROM r WHERE id <> 'region:1'), w(x, id) AS (SELECT id, 'region:1' FROM o UNION SELECT w.x, d.dst FROM w JOIN d ON d.src = w.id WHERE d.dst <> w.x), m AS MATERIALIZED (SELECT o.id, p.id AS x FROM o, o p WHERE (p.id, o.id) NOT IN (SELECT (x, id) FROM w)), k AS (SELECT id, count(*) AS depth FROM m GROUP BY id)"
query("al12_dominators", with_graph(_DOM + " SELECT 'region:1' AS id, CAST(NULL AS VARCHAR) AS dominator, 0 AS depth UNION ALL SELECT k.id, coalesce((SELECT max_by(m.x, q.depth) FROM m JOIN k q ON q.id = m.x WHERE m.id = k.id AND m.x <> k.id), 'region:1'), depth FROM k", "e", recursive=True))(lambda g: analytics.dominators(g.edges, "region:1"))


def _personal_sql(rounds: int) -> str:
    sql = ", v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, count(*) AS k FROM f GROUP BY src), t AS (SELECT id, CASE WHEN id LIKE '%click' THEN 2.0 ELSE 1.0 END::DOUBLE / (SELECT sum(CASE WHEN id LIKE '%click' THEN 2.0 ELSE 1.0 END)::DOUBLE FROM v) AS t FROM v), r0 AS (SELECT id, 1 / n AS rank FROM v, c)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT t.id, 0.15 * t + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) * t) AS rank FROM t LEFT JOIN (SELECT f.dst, sum(rank / k) AS got FROM f JOIN r{i} ON id = f.src JOIN o ON o.src = f.src GROUP BY f.dst) ON dst = t.id)"
    return with_graph(sql + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}", "f")


query("al2_personal_pagerank", _personal_sql(5))(
    lambda g: analytics.pagerank(g.flow_nodes, g.flow, iterations=5, personal=g.flow_nodes.select("id", F.when(F.col("id").endswith("click"), 2.0).otherwise(1.0).alias("weight"))).withColumn("rank", rounded("rank", 9))
)
query(
    "ga21_explain_path",
    with_graph(
        ", x AS MATERIALIZED (SELECT src, dst, min(1 - confidence) AS w FROM e GROUP BY 1, 2), r(dst, cost, path) AS (SELECT 'region:1', CAST(0 AS DOUBLE), ['region:1'] UNION ALL SELECT x.dst, cost + w, list_append(path, x.dst) FROM r JOIN x ON x.src = r.dst), b AS (SELECT dst, path FROM r QUALIFY row_number() OVER (PARTITION BY dst ORDER BY cost, path) = 1), "
        "h AS (SELECT dst, path, unnest(range(1, len(path))) AS i FROM b), m AS (SELECT src, dst, dep_type, confidence FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, dep_type DESC) = 1) "
        "SELECT 'region:1' AS src, h.dst, CAST(i - 1 AS INTEGER) AS hop, path[i] AS \"from\", path[i + 1] AS \"to\", m.dep_type AS verb, m.confidence FROM h JOIN m ON m.src = path[i] AND m.dst = path[i + 1]",
        "e",
        recursive=True,
    ),
)(lambda g: reach.explained(reach.cheapest_paths(g.edges, g.seed("region:1")), g.edges))

# longest and cheapest ways by recursion over the graph itself
query("ga22_topological_layers", with_graph(", r(id, k) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, k + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(k) AS layer FROM r GROUP BY id", "n", "e", recursive=True))(lambda g: reach.topological_layers(g.edges, g.nodes))
query("ga20_cheapest_paths", with_graph(", x AS MATERIALIZED (SELECT src, dst, min(1 - confidence) AS w FROM e GROUP BY 1, 2), r(src, dst, cost) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM n WHERE kind = 'class' UNION ALL SELECT r.src, x.dst, cost + w FROM r JOIN x ON x.src = r.dst) SELECT src, dst, round(min(cost), 9) AS cost FROM r GROUP BY 1, 2", "n", "e", recursive=True))(
    lambda g: reach.least_costs(g.edges, g.nodes.where("kind = 'class'")).select("src", "dst", rounded("cost", 9).alias("cost"))
)
query("ql13_paths_by_kind", with_graph(", x AS MATERIALIZED (SELECT src, dst, dep_type FROM e), p(dst, hops, path) AS (SELECT 'region:2', 0, 'region:2' UNION ALL SELECT x.dst, hops + 1, path || '>' || x.dst FROM p JOIN x ON x.src = p.dst WHERE hops < 3) SELECT 'region:2' AS src, p.dst, hops, path FROM p JOIN n ON n.id = p.dst WHERE kind = 'method'", "n", "e", recursive=True))(
    lambda g: reach.simple_paths(g.edges, g.seed("region:2"), g.nodes.where("kind = 'method'"), 3).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))
)

# --- order statistics, budgets, pages ------------------------------------------------------

query("st1_order_statistics", "WITH k AS (SELECT user_id % 3 AS g, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id % 3) AS n FROM events) SELECT g, max(n) AS n, max(CASE WHEN r = floor(0.25 * (n - 1)) THEN value END) AS p25, max(CASE WHEN r = least(floor(0.9 * n), n - 1) THEN value END) AS p90 FROM k GROUP BY g")(
    lambda g: order_statistics(g.events.select((F.col("user_id") % 3).alias("g"), "value"), ["g"], "value", {"p25": (0.25, 1), "p90": (0.9, 0)})
)
query("st1_running_totals", "SELECT event_id, event_type, CAST(coalesce(sum(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM events")(
    lambda g: running_sum(g.events.select("event_id", "event_type", "ts"), ["event_type"], [F.asc("ts"), F.asc("event_id")], F.col("event_id")).drop("ts")
)
_WALKED = ", k AS (SELECT id FROM n WHERE kind <> 'class'), x AS MATERIALIZED (SELECT src, dst FROM e WHERE provenance IN ('inferred', 'manual') AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)), w(id, depth) AS (SELECT id, 0 FROM n WHERE kind <> 'class' AND contains(lower(name), 'supplier') UNION SELECT dst, depth + 1 FROM w JOIN x ON x.src = w.id WHERE depth < 2), "
_WALKED += "d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), c AS (SELECT d.id, depth, CAST(length(name) AS BIGINT) AS cost FROM d JOIN n USING (id)), s AS (SELECT *, CAST(sum(cost) OVER (ORDER BY depth, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM c)"


def _answer(g: G, budget: int) -> tuple[DataFrame, DataFrame]:
    nodes, between = questions.filtered_graph(g.nodes, g.edges, exclude=["class"], provenance=["inferred", "manual"])
    return between, questions.answer(nodes, questions.keyword_walk(nodes, between, ["Supplier"], 2), budget, F.length("name"))


query("ga34_filtered_question", with_graph(_WALKED + " SELECT id, depth, cost, spent FROM s WHERE spent <= 20000", "n", "e", recursive=True))(lambda g: _answer(g, 20_000)[1].select("id", "depth", "cost", "spent"))
query("ga34_answer_edges", with_graph(_WALKED + ", a AS (SELECT * FROM s WHERE spent <= 20000), v AS (SELECT x.dst, min(x.src) AS src FROM a JOIN x ON x.dst = a.id JOIN d ON d.id = x.src AND d.depth = a.depth - 1 GROUP BY x.dst) SELECT e.src, e.dst, dep_type, provenance, confidence FROM v JOIN e ON e.src = v.src AND e.dst = v.dst WHERE v.src IN (SELECT id FROM a) AND provenance IN ('inferred', 'manual')", "n", "e", recursive=True))(
    lambda g: (x := _answer(g, 20_000)) and questions.answer_edges(*x)
)
query("ga33_budgeted_question", with_graph(", w(id, depth) AS (SELECT id, 0 FROM n WHERE contains(lower(name), 'small') OR contains(lower(name), 'ring') UNION SELECT src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE depth < 2), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), s AS (SELECT *, row_number() OVER (ORDER BY depth, id) AS spent FROM d) SELECT id, depth, spent, CASE WHEN depth > 0 THEN '' ELSE (SELECT concat_ws(',', CASE WHEN contains(lower(name), 'small') THEN 'small' END, CASE WHEN contains(lower(name), 'ring') THEN 'ring' END) FROM n WHERE n.id = s.id) END AS words FROM s WHERE spent <= 150", "n", "e", recursive=True))(
    lambda g: questions.answer(g.nodes, questions.keyword_walk(g.nodes, g.edges, ["small", "ring"], 2, "incoming"), 150).select("id", "depth", "spent", "words")
)
query("se15_page_after_cursor", with_graph("SELECT id, fan_in FROM d WHERE (fan_in, id) < (20, 'part:5') OR fan_in < 20 ORDER BY fan_in DESC, id DESC LIMIT 40", "d"))(
    lambda g: questions.page_after(g.degrees.select("id", "fan_in"), [("fan_in", True), ("id", True)], [20, "part:5"], 40)
)

# --- candidates ----------------------------------------------------------------------------

_PART = "regexp_replace(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
_TOKENS = f"list_distinct(list_filter(string_split_regex({_PART.format('name')}, '[^A-Za-z0-9]+'), lambda x: length(x) >= 3))"
query("al27_relation_candidates", with_graph(f", t AS (SELECT id, unnest({_TOKENS}) AS tok FROM n), p AS (SELECT a.id, b.id AS candidate, 0.7 AS score FROM n a JOIN n b USING (file) UNION ALL SELECT a.id, b.id, 0.5 FROM n a JOIN n b USING (kind) UNION ALL SELECT DISTINCT a.id, b.id, 0.3 FROM t a JOIN t b USING (tok)), m AS (SELECT id, candidate, CAST(max(score) AS DOUBLE) AS score FROM p WHERE id <> candidate GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS INTEGER) AS rank FROM m) SELECT id, rank, candidate, score, CASE score WHEN 0.7 THEN 'same_file' WHEN 0.5 THEN 'same_community' ELSE 'name_match' END AS reason FROM k WHERE rank <= 5", "n"))(
    lambda g: candidates.top_candidates(g.nodes, g.nodes, g.nodes.select("id", "kind"), 5)
)


def _spaces(g: G) -> DataFrame:
    keys = lambda *k: F.array(*[F.lit(x) for x in k])
    own = g.nodes.select(F.lit("a").alias("space"), F.col("name").alias("label"), "kind", F.when(F.col("line") % 3 == 0, keys("line", "owner")).when(F.col("line") % 3 == 1, keys("owner", "owner")).alias("properties"))
    other = g.nodes.select(F.lit("b"), F.concat(F.lit(" "), F.lower("name"), F.lit("!")), F.when(F.col("kind") == "class", "module").otherwise(F.col("kind")), F.when(F.col("line") % 2 == 0, keys("line", "size")).otherwise(keys()))
    return own.union(other)


query("fed2_merge_candidates", with_graph(", x AS (SELECT lower(name) AS label, kind, CASE line % 3 WHEN 0 THEN ['line', 'owner'] WHEN 1 THEN ['owner'] ELSE [] END AS k FROM n), y AS (SELECT lower(name) AS label, CASE kind WHEN 'class' THEN 'module' ELSE kind END AS kind, CASE line % 2 WHEN 0 THEN ['line', 'size'] ELSE [] END AS k FROM n), p AS (SELECT label, round(CAST(least(1.0, 0.8 + CASE WHEN x.kind = y.kind THEN 0.2 ELSE 0 END + CASE WHEN list_has_any(x.k, y.k) THEN 0.1 ELSE 0 END) AS DOUBLE), 6) AS score FROM x JOIN y USING (label)) SELECT label, score, count(*) AS pairs FROM p GROUP BY 1, 2", "n"))(
    lambda g: candidates.merge_scores(_spaces(g))
)

# behind the cursor: the last match of the page before
query("fed1_federated_search", with_graph(", x AS (SELECT 'a' AS space, id, name AS label, 2 AS p FROM n UNION ALL SELECT 'b', id, ' ' || lower(name) || '!', 1 FROM n) SELECT space || '::' || id AS fid, label FROM x WHERE contains(lower(label), 'su') AND (p, label, id) > (1, ' supplier#000000050!', 'supplier:50') ORDER BY p, label, id LIMIT 100", "n"))(
    lambda g: federation.federated_page(
        g.nodes.select(F.lit("a").alias("space"), "id", F.col("name").alias("label")).union(g.nodes.select(F.lit("b"), "id", F.concat(F.lit(" "), F.lower("name"), F.lit("!")))),
        g.spark.createDataFrame([("a", 2), ("b", 1)], "space string, position int"),
        "SU",
        [1, " supplier#000000050!", "supplier:50"],
        100,
    ).select("fid", "label")
)

# --- blame, specifications -----------------------------------------------------------------


def _hunks(g: G) -> DataFrame:
    """Every line item as a change of its supplier's file, from its part's number on, as long as its quantity (some a hundred times)."""
    long = F.when(F.col("l_linenumber") == 7, F.col("l_quantity") * 100).otherwise(F.col("l_quantity")).cast("long")
    author = F.concat(F.lit("dev"), (F.col("l_orderkey") % 97).cast("string"))
    return g.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("from"), (F.col("l_partkey") + long - 1).alias("to"), author.alias("author"), F.concat(author, F.lit("@example.org")).alias("email"), F.col("l_shipdate").alias("at"))


_HUNKS = "h AS MATERIALIZED (SELECT l_suppkey AS file, l_partkey AS a, l_partkey + CAST(CASE WHEN l_linenumber = 7 THEN l_quantity * 100 ELSE l_quantity END AS BIGINT) - 1 AS z, 'dev' || l_orderkey % 97 AS author, l_shipdate AS day FROM lineitem), r AS (SELECT DISTINCT l_suppkey AS file, 'part:' || l_partkey AS id, l_partkey AS first, l_partkey + l_partkey % 40 AS last FROM lineitem), o AS MATERIALIZED (SELECT r.file, id, author, day, least(last, z) - greatest(first, a) + 1 AS lines FROM r JOIN h ON h.file = r.file AND (first BETWEEN a AND z OR a BETWEEN first AND last))"
query("src14_blame", f"WITH {_HUNKS}, k AS (SELECT file, id, author, row_number() OVER (PARTITION BY file, id ORDER BY day DESC, author DESC) AS r FROM o), t AS (SELECT file, id, count(DISTINCT author) AS authors, CAST(sum(lines) AS BIGINT) AS lines FROM o GROUP BY 1, 2) SELECT file, id, author AS last_author, author || '@example.org' AS author_email, authors, lines FROM k JOIN t USING (file, id) WHERE r = 1")(
    lambda g: history.blamed(
        g.lineitem.select(F.col("l_suppkey").alias("file"), _key("part", "l_partkey").alias("id"), F.col("l_partkey").alias("first"), (F.col("l_partkey") + F.col("l_partkey") % 40).alias("last")), _hunks(g)
    ).drop("changed_at")
)
_SPEC = """'{{"openapi": "3.0.0", "paths": {{"/users/{{id}}/' {c} event_type {c} '/{{item}}": {{"summary": "s", "get": {{"operationId": "get' {c} event_type {c} '", "responses": {{"200": {{"$ref": "#/components/' {c} event_type {c} '"}}}}, "parameters": [{{"$ref": "#/p/' {c} {u} {c} '"}}, ' {c} props {c} ']}}, "POST": {{}}}}, "/' {c} event_type {c} '": {{"delete": {{"operationId": "drop' {c} event_type {c} 'Now"}}}}}}}}'"""
_SPECS = "s AS (SELECT event_id AS spec_id, " + _SPEC.format(c="||", u="user_id") + " AS j FROM events)"
_specs = lambda g: openapi.parsed(dealt(g.events.select("event_id", "event_type", "user_id", "props"), "event_id").select(F.col("event_id").alias("spec_id"), F.expr(_SPEC.format(c="||", u="cast(user_id as string)")).alias("text")))
query("src15_operations", f"WITH {_SPECS}, p AS (SELECT spec_id, j, unnest(json_keys(j, '$.paths')) AS path FROM s), i AS (SELECT spec_id, path, json_extract(json_extract(j, '$.paths'), '$.\"' || path || '\"') AS item FROM p), m AS (SELECT spec_id, path, item, unnest(json_keys(item)) AS k FROM i) SELECT spec_id, path, lower(k) AS method, json_extract_string(item, '$.' || k || '.operationId') AS operation_id, CASE WHEN contains(path, '{{') THEN 'id,item' ELSE '' END AS params FROM m WHERE lower(k) IN ('get', 'put', 'post', 'delete', 'options', 'head', 'patch', 'trace')".replace("'{{'", "'{'"))(
    lambda g: openapi.operations(_specs(g))
)
query("src15_references", f"WITH {_SPECS}, u AS (SELECT spec_id, '/users/{{id}}/' || json_extract_string(j, '$.paths.*.get.operationId')[1][4:] || '/{{item}}' AS path, j FROM s) SELECT spec_id, 'paths/' || path || '/get/responses/200' AS at, json_extract_string(j, '$.paths.*.get.responses.200.$ref')[1] AS target FROM u UNION ALL SELECT spec_id, 'paths/' || path || '/get/parameters/0', json_extract_string(j, '$.paths.*.get.parameters[0].$ref')[1] FROM u".replace("{{id}}", "{id}").replace("{{item}}", "{item}"))(
    lambda g: openapi.references(_specs(g))
)

# --- files, tiers, ranked search -----------------------------------------------------------

_EXTENSIONS = ["rs", "PY", "tsx", "h", "hxx", "tf", "yml", "json", "md", "toml", "xyz", "Rb", "f90", "sv", "ini", "kt", "qmd", "luau", "R", ""]
_KINDS = "(VALUES ('rs', 'code', 'rust'), ('py', 'code', 'python'), ('tsx', 'code', 'typescript'), ('h', 'code', 'c'), ('hxx', 'code', 'cpp'), ('tf', 'code', 'hcl'), ('yml', 'config', 'yaml'), ('json', 'config', NULL), ('md', 'document', NULL), ('toml', 'config', NULL), ('rb', 'code', 'ruby'), ('f90', 'code', 'fortran'), ('sv', 'code', 'systemverilog'), ('ini', 'config', NULL), ('qmd', 'document', NULL), ('luau', 'code', 'lua'), ('r', 'code', 'r')) k(x, t, l)"
_FILES = f"SELECT 'a.b/f' || event_id || '.' || ({_EXTENSIONS!r})[1 + event_id % {len(_EXTENSIONS)}] AS file_path FROM events"
query("src4_mixed_files", f"WITH f AS ({_FILES}) SELECT file_path, coalesce(t, 'other') AS file_type, l AS language FROM f LEFT JOIN {_KINDS} ON x = lower(split_part(file_path, '.', 3))")(
    lambda g: manifest.classified(g.events.select(F.concat(F.lit("a.b/f"), F.col("event_id").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), (1 + F.col("event_id") % len(_EXTENSIONS)).cast("int"))).alias("file_path")))
)
_RULES = [("", 1, "# generated"), ("", 2, "*.log"), ("", 3, "build/"), ("", 4, "/top?/**"), ("", 5, "!keep.log"), ("user1", 1, "!*.log"), ("user1", 2, "sub/*.txt"), ("user2", 1, "**/deep")]
_PATHS = "SELECT DISTINCT 'user' || user_id % 4 || CASE event_id % 5 WHEN 0 THEN '/build/' WHEN 1 THEN '/sub/' WHEN 2 THEN '/x/deep/' WHEN 3 THEN '/sub/more/' ELSE '/' END || CASE event_id % 3 WHEN 0 THEN 'f' || event_id || '.log' WHEN 1 THEN 'keep.log' ELSE 'f' || event_id || '.txt' END AS file_path FROM events"
query("src2_ignored_files", f"WITH f AS ({_PATHS}) SELECT file_path FROM f WHERE NOT contains(file_path, '/build/') AND NOT (file_path LIKE '%.log' AND NOT file_path LIKE '%/keep.log' AND NOT starts_with(file_path, 'user1/')) AND NOT (starts_with(file_path, 'user1/sub/') AND file_path LIKE '%.txt' AND NOT contains(file_path[11:], '/')) AND NOT (starts_with(file_path, 'user2/') AND contains(file_path, '/deep/'))")(
    lambda g: manifest.without_ignored(
        g.events.select(
            F.concat(
                F.lit("user"), (F.col("user_id") % 4).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("/build/", "/sub/", "/x/deep/", "/sub/more/", "/")]), (1 + F.col("event_id") % 5).cast("int")),
                F.when(F.col("event_id") % 3 == 1, "keep.log").otherwise(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".log").otherwise(".txt"))),
            ).alias("file_path")
        ).distinct(),
        manifest.ignore_rules(g.spark.createDataFrame(_RULES, "folder string, position int, line string")),
    )
)
_LINE = "CASE event_id % 6 WHEN 0 THEN 'see [foo](src/foo.rs:foo:' || user_id || ') here' WHEN 1 THEN ' src/bar.rs:helper:42 ' WHEN 2 THEN '<a:b>' WHEN 3 THEN 'https://x:y' WHEN 4 THEN 'a:b:c' ELSE event_type END"
query("se17_body_mention", "SELECT event_id, CASE WHEN event_id % 6 < 3 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM events")(lambda g: g.events.select("event_id", views.mention_tier(F.expr(_LINE)).alias("confidence")))
_TOK = "list_filter(string_split_regex(regexp_replace(name, '([A-Z])', '_\\1', 'g'), '[_:.\\-#\\s]+'), lambda x: x <> '')"
_best = lambda w: f"(CASE WHEN list_contains(parts, '{w}') THEN 100.0 WHEN len(list_filter(parts, lambda p: starts_with(p, '{w}'))) > 0 THEN 10.0 WHEN contains(l, '{w}') THEN 1.0 ELSE 0.0 END)::DOUBLE"
_idf = lambda w: f"(SELECT coalesce(max(ln(1 + n / CAST(1 + df AS DOUBLE))), max(ln(1 + n))) FROM c LEFT JOIN t ON token = '{w}')"
_IDF = (
    f", k AS MATERIALIZED (SELECT id, name, lower(name) AS l, list_transform({_TOK}, lambda x: lower(x)) AS parts, fan_in, fan_in + fan_out AS degree FROM d), t AS (SELECT token, count(DISTINCT id) AS df FROM (SELECT id, unnest(list_append(parts, l)) AS token FROM k) GROUP BY 1), c AS (SELECT count(*) AS n FROM k), "
    f"s AS (SELECT id, name, degree, {_idf('small')} * {_best('small')} + {_idf('ring')} * {_best('ring')} + {_idf('small ring')} * {_best('small ring')} + (CASE WHEN l = 'small ring' THEN 1000.0 WHEN contains(l, 'small ring') THEN 100.0 ELSE 0.0 END)::DOUBLE AS score FROM k), "
    "p AS (SELECT coalesce(min(degree), 0) AS p95 FROM (SELECT degree, sum(count(*)) OVER (ORDER BY degree) AS upto FROM k GROUP BY degree) WHERE upto > CAST(floor(0.95 * (SELECT n FROM c)) AS BIGINT)), z AS (SELECT id, name, CASE WHEN degree > p95 THEN score * 0.1::DOUBLE ELSE score END AS score FROM s, p WHERE score > 0)"
)
query("se1_idf_search", with_graph(_IDF + " SELECT id, name, round(score, 6) AS score FROM (SELECT * FROM z ORDER BY score DESC, name, id LIMIT 20)", "d"))(lambda g: search.idf_search(g.nodes, g.degrees, "small ring", 20).withColumn("score", rounded("score", 6)))
_THREE = _IDF + ", q AS (SELECT id, name, l, fan_in, instr(l, 'small ring') AS p FROM k), m AS (SELECT id, name, fan_in, CASE WHEN l = 'small ring' THEN 1.0::DOUBLE WHEN p = 1 THEN 0.9::DOUBLE WHEN p > 1 THEN 0.7 + 0.2 * (1 - (p - 1)::DOUBLE / length(name)) WHEN regexp_matches(l, 's.*m.*a.*l.*l.* .*r.*i.*n.*g') THEN 0.6 * 10 / length(name)::DOUBLE END AS score FROM q), "
_THREE += "a1 AS (SELECT name, max(score) AS score, 1 AS i FROM m WHERE score >= 0.8 GROUP BY 1), a2 AS (SELECT name, max(least(1.0, 0.4 * fan_in / (SELECT greatest(max(fan_in), 1) FROM k) + 0.6 * score)) AS score, 2 AS i FROM m WHERE score IS NOT NULL GROUP BY 1), a3 AS (SELECT name, max(score) AS score, 3 AS i FROM z GROUP BY 1), u AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY i) = 1)"
query("se7_three_rankings", with_graph(_THREE + " SELECT name, round(score, 6) AS score, CASE i WHEN 1 THEN 'semantic' WHEN 2 THEN 'ranked' ELSE 'idf' END AS source FROM (SELECT * FROM b ORDER BY score DESC, name LIMIT 60)", "d"))(
    lambda g: (m := search.similarity_matches(g.nodes, "small ring"))
    and views.first_source(
        [("semantic", m.where("score >= 0.8")), ("ranked", lenses.ranked_symbols(g.degrees, m).join(g.nodes.select("id", "name"), "id")), ("idf", search.idf_search(g.nodes, g.degrees, "small ring", None))], 60
    ).withColumn("score", rounded("score", 6))
)

# --- revisions -----------------------------------------------------------------------------


def _store(g: G) -> str:
    """A store with the containment edges as revision 1 and all edges as revision 2, which is committed three times under one key, and another workspace."""
    root = f"{shared_dir(g.spark)}/graphloom/store-{uuid.uuid4().hex}"
    store.commit(root, "w", g.contains, "first")
    for _ in range(3):
        store.commit(root, "w", g.edges, "second")
    store.commit(root, "other", g.calls, "first")
    return root


query("src18_call_graph_reloaded", with_graph("SELECT * FROM e WHERE dep_type = 'calls'", "e"))(lambda g: store.snapshot(g.spark, _store(g), "other"))
query("src20_committed_head", with_graph("SELECT * FROM e", "e"))(lambda g: store.snapshot(g.spark, _store(g), "w"))
query("sm9_earlier_snapshot", with_graph("SELECT * FROM e WHERE dep_type = 'contains'", "e"))(lambda g: store.snapshot(g.spark, _store(g), "w", 1))
query("sm11_heads_after_retries", with_graph("SELECT 'w' AS workspace_id, 2::BIGINT AS revision_id, count(*) AS edges FROM e UNION ALL SELECT 'other', 1, count(*) FROM e WHERE dep_type = 'calls'", "e"))(
    lambda g: (root := _store(g)) and store.heads(g.spark, root).join(g.spark.read.parquet(f"{root}/edges").groupBy("workspace_id", "revision_id").agg(F.count(F.lit(1)).alias("edges")), ["workspace_id", "revision_id"])
)

# --- limits, kinds, walks, differences -----------------------------------------------------

query("ql19_truncated", with_graph("SELECT id, kind, (SELECT count(*) > 25 FROM n) AS truncated FROM n ORDER BY kind, id LIMIT 25", "n"))(lambda g: search.limited(g.nodes.select("id", "kind"), ["kind", "id"], 25))
query("ql16_cluster_by_name", with_graph("SELECT name, count(*) AS n FROM n GROUP BY name", "n"))(lambda g: g.nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
query("ql14_neighbours_by_kind", with_graph(", b AS (SELECT src AS x, dst AS y FROM e WHERE dep_type = 'contains' UNION SELECT dst, src FROM e WHERE dep_type = 'contains'), r(id, depth) AS (SELECT 'nation:3', 0 UNION SELECT y, depth + 1 FROM r JOIN b ON x = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0", "e", recursive=True))(
    lambda g: reach.neighbours(access.by_kind(g.edges, ["contains"]), g.seed("nation:3"), 3, "both")
)
_ENTRY = ", x AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), r(a, id, hops) AS (SELECT id, id, 0 FROM n WHERE id NOT IN (SELECT {to} FROM e) UNION SELECT r.a, x.{to}, hops + 1 FROM r JOIN x ON x.{of} = r.id WHERE hops < 3) SELECT a, id, min(hops) AS hops FROM r GROUP BY a, id HAVING min(hops) > 0"
query("ag5_entry_callees", with_graph(_ENTRY.format(to="dst", of="src"), "n", "e", recursive=True))(lambda g: reach.distances(g.edges, access.roots(g.nodes, g.edges), 3).where("hops > 0").select(F.col("src").alias("a"), F.col("dst").alias("id"), "hops"))
query("ag6_leaf_callers", with_graph(_ENTRY.format(to="src", of="dst"), "n", "e", recursive=True))(
    lambda g: (back := g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) and reach.distances(back, access.leaves(g.nodes, g.edges), 3).where("hops > 0").select(F.col("src").alias("a"), F.col("dst").alias("id"), "hops")
)
query("ga19_traversed_edges", with_graph(", r(id, depth) AS (SELECT 'region:3', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 1) SELECT src, dst, dep_type, provenance, confidence FROM e WHERE src IN (SELECT id FROM r)", "e", recursive=True))(lambda g: reach.traversed_edges(g.edges, g.seed("region:3"), 2))
query("ag28_whole_graph_diff", with_graph(", a AS (SELECT id, name, kind, line FROM n WHERE line % 5 <> 0), b AS (SELECT id, name, CASE WHEN line % 7 = 0 THEN NULL ELSE kind END AS kind, line FROM n WHERE line % 4 <> 0), x AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.kind IS DISTINCT FROM b.kind THEN 'modified' END AS op FROM a FULL JOIN b ON a.id = b.id) SELECT 'node' AS what, op, id, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS dep_type FROM x WHERE op IS NOT NULL UNION ALL SELECT 'edge', CASE WHEN provenance = 'inferred' THEN 'added' ELSE 'removed' END, src, dst, dep_type FROM e WHERE provenance IN ('inferred', 'ambiguous')", "n", "e"))(
    lambda g: aggregate.graph_diff(
        (g.nodes.where("line % 5 != 0"), g.edges.where("provenance != 'inferred'")), (g.nodes.where("line % 4 != 0").withColumn("kind", F.when(F.col("line") % 7 == 0, F.lit(None)).otherwise(F.col("kind"))), g.edges.where("provenance != 'ambiguous'")), ["name", "kind"]
    )
)

def _members(g: G) -> DataFrame:
    found = cut(analytics.strong_components(g.flow_nodes, g.flow), "members")
    return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("component", "size", "id")


query("ql23_cluster_members", with_graph(_SCC + " SELECT component, count(*) OVER (PARTITION BY component) AS size, id FROM s", "f", recursive=True))(_members)

# --- risks, labels, scores, kinds of edges -------------------------------------------------

_RISKS = f", x AS (SELECT file, 0.4 * sum(fan_in) AS fan FROM d GROUP BY 1), y AS (SELECT file_path, 0.6 * sum({_SEV}) AS w FROM i GROUP BY 1), z AS (SELECT coalesce(file, file_path) AS file, CAST(coalesce(fan, 0) + coalesce(w, 0) AS DOUBLE) + CAST(coalesce(w, 0) AS DOUBLE) AS risk FROM x FULL JOIN y ON file = file_path), p AS (SELECT string_split(file, '/') AS p, risk FROM z), s AS (SELECT array_to_string(p[1:n], '/') AS scope, risk FROM (SELECT p, risk, unnest(range(1, len(p))) AS n FROM p))"
query("lv3_scope_risk", with_graph(_RISKS + " SELECT scope, round(sum(risk), 6) AS risk, CASE WHEN sum(risk) >= 30 THEN 'critical' WHEN sum(risk) >= 15 THEN 'warning' ELSE 'info' END AS band FROM s GROUP BY scope", "d", "i"))(
    lambda g: aggregate.scope_risk(aggregate.file_risk(g.degrees, g.issues), g.issues).withColumn("risk", rounded("risk", 6))
)
query("al25_community_labels", with_graph(", k AS (SELECT kind AS community, regexp_replace(file, '/?[^/]*$', '') AS label, count(*) AS n FROM n GROUP BY 1, 2) SELECT community, label FROM k QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, label DESC) = 1", "n"))(lambda g: analytics.community_labels(g.nodes, g.nodes.select("id", "kind")))
query("ag23_confident_scores", "SELECT user_id, CASE WHEN c < 20 AND c > 0 THEN s * 0.5::DOUBLE WHEN n < 10 THEN s * 0.7::DOUBLE ELSE s::DOUBLE END AS score FROM (SELECT user_id, count(*) % 97 AS s, max(event_id) % 40 AS c, count(*) % 20 AS n FROM events GROUP BY 1)")(
    lambda g: g.events.groupBy("user_id").agg((F.count(F.lit(1)) % 97).alias("s"), (F.max("event_id") % 40).alias("c"), (F.count(F.lit(1)) % 20).alias("n")).select("user_id", lenses.confident_score(F.col("s"), F.col("c"), F.col("n")).alias("score"))
)
_FIVE = ["avg(value)", "max(value)", "CASE WHEN user_id % 3 > 0 THEN min(value) END", "CASE WHEN user_id % 4 > 0 THEN stddev_samp(value) END", "count(*) / 10.0"]
query("st8_five_dimensions", "WITH x AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS s{i}" for i, e in enumerate(_FIVE)) + ", user_id FROM events GROUP BY user_id) SELECT user_id, round((0.35 * s0 + 0.2 * s1 + coalesce(0.15 * s2, 0) + coalesce(0.15 * s3, 0) + 0.15 * s4) / (0.7 + CASE WHEN s2 IS NULL THEN 0 ELSE 0.15 END + CASE WHEN s3 IS NULL THEN 0 ELSE 0.15 END), 6) AS health FROM x")(
    lambda g: g.events.groupBy("user_id").agg(*[F.expr(f"CAST({e} AS DOUBLE)").alias(f"s{i}") for i, e in enumerate(_FIVE)]).select("user_id", rounded(stats.health([F.col(f"s{i}") for i in range(5)]), 6).alias("health"))
)


def _typed(g: G) -> DataFrame:
    """Edges of kinds of their own: parts refer to their type and implement their brand, nations' files import their region's."""
    row = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("dep_type"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    files = g.nation.join(F.broadcast(g.region), F.col("n_regionkey") == F.col("r_regionkey"))
    imports = row(files, F.concat("r_name", F.lit("/"), "n_name", F.lit("/mod.rs")), F.concat("r_name", F.lit("/mod.rs")), "imports")
    return row(g.part, _key("part", "p_partkey"), name("type", "p_type"), "references").union(row(g.part, _key("part", "p_partkey"), name("brand", "p_brand"), "implements")).union(imports)


query("ga24_references_to_types", "SELECT 'part:' || p_partkey AS src, 'type:' || p_type AS dst FROM part WHERE p_type = (SELECT min(p_type) FROM part)")(
    lambda g: access.by_kind(_typed(g), ["references"]).join(F.broadcast(g.part.agg(F.concat(F.lit("type:"), F.min("p_type")).alias("dst"))), "dst", "left_semi").select("src", "dst")
)
query("ga25_file_imports", "SELECT r_name || '/' || n_name || '/mod.rs' AS src, r_name || '/mod.rs' AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda g: access.by_kind(_typed(g), ["imports"]).select("src", "dst"))
query("ga26_implementors", "SELECT 'brand:' || p_brand AS dst, count(*) AS implementors FROM part GROUP BY 1")(lambda g: access.by_kind(_typed(g), ["implements"]).groupBy("dst").agg(F.count(F.lit(1)).alias("implementors")))

# --- graphs and runs as files --------------------------------------------------------------

_shared = lambda g, name: f"{shared_dir(g.spark)}/graphloom/{name}-{uuid.uuid4().hex}"
_JSON = """concat('{"nodes": [{"id": "', user_id, '", "kind": "user"}], "edges": [{"source": "', user_id, '", "target": "', event_type, '", "relation": "r', event_id % 2, '", "confidence": 0.', event_id % 9, '}, {"target": "lost"}]', CASE WHEN event_id % 10 = 0 THEN ' broken' ELSE '}' END)"""
query("src17_json_graph", "SELECT CAST(user_id AS VARCHAR) AS src, event_type AS dst, 'r' || event_id % 2 AS dep_type, max(event_id % 9) / 10.0::DOUBLE AS confidence FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2, 3")(lambda g: runs.json_graph(g.events.select(F.expr(_JSON).alias("text")))[1])
query("src19_generic_relations", "SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'CALLS' AS type, '{\"flag\":\"' || arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) || '\",\"seq\":' || min(l_orderkey * 10 + l_linenumber) || '}' AS properties FROM lineitem GROUP BY l_suppkey, l_partkey")(
    lambda g: runs.generic(g.nodes, g.lineitem.select(_key("supplier", "l_suppkey").alias("src"), _key("part", "l_partkey").alias("dst"), F.lit("calls").alias("dep_type"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")), F.col("seq"))[1]
)


def _history(g: G) -> DataFrame:
    """Two appended histories read back, and the newest report of each user."""
    folder, rows = _shared(g, "history"), g.events.select("user_id", "event_id", "event_type", "value")
    for part in (0, 1):
        runs.append_runs(rows.where(F.col("event_id") % 2 == part), folder)
    return runs.latest_reports(runs.read_runs(g.spark, folder, "user_id long, event_id long, event_type string, value double"), ["user_id"], "event_id")


query("src25_latest_of_history", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")(_history)


def _restored(g: G) -> DataFrame:
    """Three revisions in a store, the last one restored from the first: all checkpoints."""
    root = _shared(g, "store")
    store.commit(root, "w", g.contains, "a")
    store.commit(root, "w", g.edges, "b")
    runs.restore(g.spark, root, "w", 1, "c")
    return runs.checkpoints(g.spark, root, "w")


query("sm10_checkpoints", with_graph(", k AS (SELECT * FROM e WHERE dep_type = 'contains'), a AS (SELECT (SELECT count(*) FROM (SELECT src FROM k UNION SELECT dst FROM k)) AS symbols, (SELECT count(*) FROM k) AS edges), b AS (SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS symbols, (SELECT count(*) FROM e) AS edges) SELECT 1::BIGINT AS revision_id, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM a", "e"))(_restored)
query("fed4_spaces", "SELECT CAST(user_id AS VARCHAR) AS space, event_type AS name FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 3 <> 0")(
    lambda g: runs.spaces(g.events.select(F.col("user_id").cast("string").alias("space"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, "unregister").otherwise("register").alias("op"), F.col("event_id").alias("seq")))
)

# --- streams -------------------------------------------------------------------------------


def _event(g: G) -> DataFrame:
    """Each event as a change: of an edge from its user to its type, added or removed by the event's number; one in seven removes the user."""
    n = F.col("event_id") % 7
    op = F.when(n == 0, "symbol_removed").when(n < 3, "dependency_removed").otherwise("dependency_added")
    kind = lambda c: F.when(n == 0, F.lit(None).cast("string")).otherwise(c)
    return g.events.select(op.alias("op"), (F.col("user_id") % 200).cast("string").alias("src"), kind(F.col("event_type")).alias("dst"), kind(F.lit("calls")).alias("dep_type"), F.col("event_id").alias("seq"))


def _reindexed(g: G) -> DataFrame:
    """The events table read as a stream of files, indexed until its end, and the graph that then stands."""
    folder = f"{shared_dir(g.spark)}/graphloom/reindex-{uuid.uuid4().hex}"
    stream = g.spark.readStream.schema(g.events.schema).parquet(f"{g.dir.rstrip('/')}/events.parque[t]")
    streamed = G(g.spark, g.dir)
    streamed.events = stream
    reindex.reindex(_event(streamed), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return reindex.current(g.spark, f"{folder}/log")


query("sm8_reindexed_stream", "WITH x AS (SELECT event_id AS seq, event_id % 7 AS n, CAST(user_id % 200 AS VARCHAR) AS src, event_type AS dst FROM events), e AS (SELECT src, dst, max_by(n, seq) AS n, max(seq) AS seq FROM x WHERE n > 0 GROUP BY 1, 2), r AS (SELECT src, max(seq) AS gone FROM x WHERE n = 0 GROUP BY 1) SELECT e.src, dst, 'calls' AS dep_type FROM e LEFT JOIN r ON r.src = e.src LEFT JOIN r q ON q.src = e.dst WHERE n >= 3 AND (r.gone IS NULL OR r.gone < seq) AND (q.gone IS NULL OR q.gone < seq)")(_reindexed)


def _debounced(g: G) -> DataFrame:
    """The events table read as a stream of files, debounced to its end."""
    folder = _shared(g, "debounce")
    stream = g.spark.readStream.schema(g.events.schema).parquet(f"{g.dir.rstrip('/')}/events.parque[t]")
    touched = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("file"))
    changes.debounce_stream(touched, f"{folder}/log", f"{folder}/checkpoint", "10 minutes", "1 minute").awaitTermination()
    found = changes.debounce_state(g.spark.read.parquet(f"{folder}/log"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


query("sm2_debounced_stream", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS file, count(*) AS touches FROM events GROUP BY 1, 2")(_debounced)
