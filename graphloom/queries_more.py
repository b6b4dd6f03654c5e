"""Further registered queries: predicates, path patterns, directions of traversal, sources, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graphs import with_graph
from graphloom.model import STOP_WORDS, rounded
from graphloom.operators import access, aggregate, lenses, patterns, predicates, reach, search, stats
from graphloom.queries import _MODULES, G, query
from graphloom.sources import manifest
from graphloom.streaming import changes

# --- predicates ----------------------------------------------------------------------------

query("ql6_symbol_predicate", with_graph("SELECT id, fan_in FROM d WHERE fan_in >= 2 AND kind = 'method' AND contains(lower(name), 'ring') AND lower(file) < 'brand#4' AND NOT kind = 'class'", "d"))(
    lambda g: predicates.find(g.degrees, "symbol", [("fan_in", ">=", 2), ("kind", "=", "METHOD"), ("name", "~", "Ring"), ("file", "<", "BRAND#4"), ("kind", "!=", "class")]).select("id", "fan_in")
)
query("ql6_unknown_and_mixed", with_graph("SELECT id FROM n WHERE false", "n"))(
    lambda g: predicates.find(g.degrees, "symbol", [("colour", "=", "red")]).union(predicates.find(g.degrees, "symbol", [("fan_in", "=", "two")])).union(predicates.find(g.degrees, "symbol", [("name", ">", 3)])).select("id")
)
_FILES = ", q AS (SELECT file_path, count(*) AS issue_count, count(*) FILTER (severity = 'blocker') AS blockers FROM i GROUP BY 1), t AS (SELECT file, max(line) AS line_count, count(*) AS symbol_count, max(coalesce(issue_count, 0)) AS issue_count, max(coalesce(blockers, 0)) AS blockers FROM n LEFT JOIN q ON file = file_path GROUP BY file)"
query("ql7_file_predicate", with_graph(_FILES + " SELECT file, symbol_count, issue_count FROM t WHERE symbol_count > 1 AND issue_count >= 1 AND blockers > 1 AND line_count >= 2 AND contains(lower(file), 'suppliers')", "n", "i"))(
    lambda g: predicates.find(predicates.file_table(g.nodes, g.issues), "file", [("symbol_count", ">", 1), ("issue_count", ">=", 1), ("quality.blocker", ">", 1), ("line_count", ">=", 2), ("path", "~", "SUPPLIERS")]).select("file", "symbol_count", "issue_count")
)
query("ql2_files_with_lines", with_graph(_FILES + " SELECT file, line_count FROM t", "n", "i"))(lambda g: predicates.file_table(g.nodes, g.issues).select("file", "line_count"))
_UP = "unnest(list_transform(range(1, len(string_split(m, '/')) + 1), lambda k: array_to_string(string_split(m, '/')[1:k], '/')))"
_SCOPES = f", a AS (SELECT file, regexp_replace(file, '/?[^/]*$', '') AS m, count(*) AS n FROM n GROUP BY 1), b AS (SELECT {_UP} AS scope, file, n FROM a WHERE m <> ''), s AS (SELECT scope, count(*) AS file_count, CAST(sum(n) AS BIGINT) AS symbol_count FROM b GROUP BY 1), k AS (SELECT {_UP} AS scope, severity FROM (SELECT regexp_replace(file_path, '/?[^/]*$', '') AS m, severity FROM i) WHERE m <> ''), z AS (SELECT scope, count(*) AS issue_count, count(*) FILTER (severity = 'critical') AS critical FROM k GROUP BY 1), t AS (SELECT s.*, coalesce(issue_count, 0) AS issue_count, coalesce(critical, 0) AS critical FROM s LEFT JOIN z USING (scope))"
query("ql8_scope_predicate", with_graph(_SCOPES + " SELECT scope, file_count, symbol_count, issue_count FROM t WHERE issue_count > 2 AND critical >= 1 AND file_count >= 1 AND symbol_count <> 3", "n", "i"))(
    lambda g: predicates.find(predicates.scope_table(g.nodes, g.issues), "scope", [("issue_count", ">", 2), ("quality.critical", ">=", 1), ("file_count", ">=", 1), ("symbol_count", "!=", 3)]).select("scope", "file_count", "symbol_count", "issue_count")
)
query("ql3_scopes_with_issues", with_graph(_SCOPES + " SELECT scope, file_count, issue_count FROM t", "n", "i"))(lambda g: predicates.scope_table(g.nodes, g.issues).select("scope", "file_count", "issue_count"))
query("ql9_issue_predicate", with_graph("SELECT id FROM i WHERE severity IN ('critical', 'blocker') AND severity <> 'blocker' AND rule_id >= 'R3' AND line > 5 AND contains(lower(file_path), 'asia') AND lower(category) = 'f'", "i"))(
    lambda g: predicates.find(g.issues, "issue", [("severity", "=", "CRITICAL"), ("rule", ">=", "r3"), ("line", ">", 5), ("file", "~", "asia"), ("category", "=", "f")]).select("id")
)
query("ql10_comparisons", with_graph("SELECT id, lower(name) < 'customer#000000100' AS below, lower(name) >= 'm' AS above, contains(lower(name), '00') AS has, line = 7 AS seven, false AS mixed FROM n", "n"))(
    lambda g: g.nodes.select(
        "id",
        predicates.compared(F.col("name"), True, "<", "CUSTOMER#000000100").alias("below"),
        predicates.compared(F.col("name"), True, ">=", "M").alias("above"),
        predicates.compared(F.col("name"), True, "~", "00").alias("has"),
        predicates.compared(F.col("line"), False, "=", 7).alias("seven"),
        predicates.compared(F.col("line"), False, "=", "7").alias("mixed"),
    )
)

# --- path patterns -------------------------------------------------------------------------


def _shown(paths: DataFrame) -> DataFrame:
    return paths.select(F.array_join("path", ">").alias("path"))


def _some(g: G, kind: str, rest: int) -> DataFrame:
    return g.nodes.where((F.col("kind") == kind) & (F.col("line") % 20 == rest))


_ARROWS = with_graph("SELECT DISTINCT p.id || '>' || a.src || '>' || b.src AS path FROM n p JOIN e a ON a.dst = p.id AND a.dep_type = 'calls' JOIN e b ON b.dst = a.src AND b.dep_type = 'contains' WHERE p.kind = 'method' AND p.line % 20 = 3", "n", "e")
query("ql26_incoming_arrows", _ARROWS)(lambda g: _shown(patterns.match(g.edges, _some(g, "method", 3), [patterns.Step("<-", ("calls",)), patterns.Step("<-", ("contains",), ends=g.nodes.where("kind = 'class'"))])))
query("ql26_either_arrow", with_graph("SELECT DISTINCT id || '>' || CASE WHEN src = id THEN dst ELSE src END AS path FROM n JOIN e ON src = id OR dst = id WHERE kind = 'class' AND dep_type = 'contains'", "n", "e"))(
    lambda g: _shown(patterns.match(g.edges, g.nodes.where("kind = 'class'"), [patterns.Step("<->", ("contains",))]))
)
_HOPS = ", p(path, z, k) AS (SELECT 'region:1', 'region:1', 0 UNION ALL SELECT path || '>' || dst, dst, k + 1 FROM p JOIN e ON src = z WHERE k < 3)"
query("ql27_bounded_hops", with_graph(_HOPS + " SELECT path FROM p WHERE k BETWEEN 2 AND 3 AND z IN (SELECT id FROM n WHERE kind <> 'method' OR line % 5 = 0)", "n", "e", recursive=True))(
    lambda g: _shown(patterns.match(g.edges, g.seed("region:1"), [patterns.Step(hops=patterns.hops("*2..3"), ends=g.nodes.where("kind != 'method' OR line % 5 = 0"))]))
)
query("ql27_optional_hop", with_graph(_HOPS + " SELECT path FROM p WHERE k BETWEEN 0 AND 1", "e", recursive=True))(lambda g: _shown(patterns.match(g.edges, g.seed("region:1"), [patterns.Step(hops=patterns.hops("?"))])))
query("ql30_return_nodes", with_graph(_HOPS + ", x AS (SELECT path FROM p WHERE k = 2) SELECT DISTINCT unnest(string_split(path, '>')) AS id FROM x", "e", recursive=True))(lambda g: patterns.as_nodes(patterns.match(g.edges, g.seed("region:1"), [patterns.Step(hops=patterns.hops("*2"))])))
query("ql30_return_edges", with_graph(_HOPS + ", x AS (SELECT string_split(path, '>') AS s FROM p WHERE k = 2) SELECT DISTINCT s[1] AS \"from\", s[2] AS \"to\" FROM x UNION SELECT DISTINCT s[2], s[3] FROM x", "e", recursive=True))(
    lambda g: patterns.as_edges(patterns.match(g.edges, g.seed("region:1"), [patterns.Step(hops=(2, 2))]))
)
query("ql31_grouped_counts", with_graph("SELECT b.file, count(*) AS n FROM n a JOIN e ON e.src = a.id AND dep_type = 'calls' JOIN n b ON b.id = e.dst WHERE a.kind = 'function' GROUP BY 1 ORDER BY n DESC, b.file LIMIT 7", "n", "e"))(
    lambda g: patterns.as_counts(patterns.match(g.edges, g.nodes.where("kind = 'function'"), [patterns.Step(kinds=("calls",))]), g.nodes, "file", 7)
)

# --- traversal by direction, kinds ---------------------------------------------------------

_WALK = ", r(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {to}, depth + 1 FROM r JOIN e ON {of} = r.id WHERE depth < {most}) "
query("ga5_dependents", with_graph("SELECT DISTINCT src AS id FROM e WHERE dst = 'part:9'", "e"))(lambda g: access.callers(g.edges, "part:9"))
query("ga14_traverse_callees", with_graph(_WALK.format(seed="nation:8", to="dst", of="src", most=2) + "SELECT id, min(depth) AS depth FROM r GROUP BY id", "e", recursive=True))(lambda g: reach.reach(g.edges, g.seed("nation:8"), "outgoing", 2))
query("ga15_traverse_callers", with_graph(_WALK.format(seed="part:3", to="src", of="dst", most=2) + "SELECT id, min(depth) AS depth FROM r GROUP BY id", "e", recursive=True))(lambda g: reach.reach(g.edges, g.seed("part:3"), "incoming", 2))
query("ga19_extracted_nodes", with_graph(_WALK.format(seed="nation:3", to="dst", of="src", most=2) + "SELECT DISTINCT id FROM r", "e", recursive=True))(lambda g: reach.subgraph(g.edges, g.seed("nation:3"), 2)[0].select("id"))
query("ga25_contained_in_file", with_graph("SELECT DISTINCT dst AS id FROM e JOIN n ON n.id = src WHERE dep_type = 'contains' AND file = 'ASIA/mod.rs'", "n", "e"))(
    lambda g: access.by_kind(g.edges, ["contains"]).join(g.nodes.where("file = 'ASIA/mod.rs'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
)
query("ga26_sources_by_kind", with_graph("SELECT DISTINCT src AS id FROM e WHERE dep_type = 'contains' AND dst = 'nation:2'", "e"))(lambda g: access.callers(access.by_kind(g.edges, ["contains"]), "nation:2"))
query("ga36_call_hierarchy", with_graph(_WALK.format(seed="supplier:4", to="src", of="dst", most=3) + "SELECT 'in' AS way, id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id UNION ALL SELECT 'out', dst, 1 FROM (SELECT DISTINCT dst FROM e WHERE src = 'supplier:4')", "e", recursive=True))(
    lambda g: reach.neighbours(g.edges, g.seed("supplier:4"), 3, "incoming").select(F.lit("in").alias("way"), "id", "depth").union(reach.neighbours(g.edges, g.seed("supplier:4"), 3).select(F.lit("out"), "id", "depth"))
)
query("ga37_traced_path", with_graph("SELECT 'region:1>' || min(a.dst || '>' || b.dst || '>part:5') AS path, 3 AS hops FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src = 'region:1' AND c.dst = 'part:5' HAVING count(*) > 0", "e"))(
    lambda g: reach.shortest_paths(g.edges, g.seed("region:1"), mark=">").where("dst = 'part:5'").select(F.array_join("path", ">").alias("path"), "hops")
)

# --- reports, views, statistics ------------------------------------------------------------

query("ag11_dead_code_report", with_graph(", x AS (SELECT src, dst FROM e UNION SELECT 'part:' || (p_partkey + 1), 'part:' || p_partkey FROM part WHERE p_partkey % 50 = 0 UNION SELECT 'part:' || p_partkey, 'part:' || (p_partkey + 1) FROM part WHERE p_partkey % 50 = 0), y AS (SELECT * FROM x WHERE NOT (starts_with(src, 'supplier:') AND CAST(split_part(dst, ':', 2) AS BIGINT) % 50 IN (0, 1))), r(id) AS (SELECT id FROM n WHERE id NOT IN (SELECT dst FROM y) UNION SELECT dst FROM r JOIN y ON src = r.id) SELECT kind, count(*) FILTER (kind <> 'module' AND id NOT IN (SELECT id FROM r)) AS dead, count(*) AS total, round(100.0 * count(*) FILTER (kind <> 'module' AND id NOT IN (SELECT id FROM r)) / CAST(count(*) AS DOUBLE), 9) AS percent FROM n GROUP BY kind", "n", "e", recursive=True))(
    lambda g: lenses.dead_report(g.nodes, aggregate.dead_code(g.nodes, _with_islands(g))).withColumn("percent", rounded("percent", 9))
)


def _with_islands(g: G) -> DataFrame:
    """The edges, and pairs of parts that only call each other."""
    part = g.part.where("p_partkey % 50 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("a"), F.concat(F.lit("part:"), (F.col("p_partkey") + 1).cast("string")).alias("b"))
    kept = g.edges.where(~(F.startswith("src", F.lit("supplier:")) & (F.split_part("dst", F.lit(":"), F.lit(2)).cast("long") % 50).isin(0, 1))).select("src", "dst")
    return kept.union(part.select("a", "b")).union(part.select("b", "a"))


query("lv5_scope_cycle", with_graph(_MODULES + ", q AS (SELECT src_module AS a, dst_module AS b FROM p UNION SELECT dst_module, src_module FROM p WHERE starts_with(src_module, 'ASIA')), w(b, k) AS (SELECT b, 1 FROM q WHERE a = 'ASIA' UNION SELECT q.b, k + 1 FROM w JOIN q ON q.a = w.b WHERE k < 4) SELECT 'ASIA' AS scope, CAST(min(k) AS BIGINT) AS hops FROM w WHERE b = 'ASIA' HAVING count(*) > 0", "n", "e", recursive=True))(
    lambda g: (m := aggregate.module_edges(g.nodes, g.edges).select("src_module", "dst_module")) and lenses.scope_cycle(m.union(m.where("startswith(src_module, 'ASIA')").select("dst_module", "src_module")), "ASIA")
)
_WEIGHTS = {"view": 0.35, "click": 0.2, "purchase": 0.15}
query("st11_improvement_ranking", "WITH s AS (SELECT event_type AS name, avg(value) AS score FROM events GROUP BY 1) SELECT name, round(score, 6) AS score, round(CASE name WHEN 'view' THEN 0.35 WHEN 'click' THEN 0.2 WHEN 'purchase' THEN 0.15 ELSE 0 END * (100 - score), 6) AS gain FROM s ORDER BY 3 DESC, name LIMIT 3")(
    lambda g: stats.improvement_targets(g.events.groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("score")), _WEIGHTS, 3).select("name", rounded("score", 6).alias("score"), rounded("gain", 6).alias("gain"))
)
_STOP = ", ".join(f"('{w}')" for w in sorted(STOP_WORDS))
query("se11_keywords", f"WITH q AS (SELECT event_id, unnest(regexp_extract_all(lower('How does the ' || event_type || ' of user_' || user_id || ' connect to x and pre-built ' || event_type || '?'), '[A-Za-z0-9_-]+')) AS w FROM events) SELECT DISTINCT event_id, w AS word FROM q WHERE length(w) > 1 AND w NOT IN (SELECT * FROM (VALUES {_STOP}))")(
    lambda g: g.events.select("event_id", F.explode(search.keywords_of(F.concat(F.lit("How does the "), "event_type", F.lit(" of user_"), F.col("user_id").cast("string"), F.lit(" connect to x and pre-built "), "event_type", F.lit("?")))).alias("word"))
)

# --- sources, changes ----------------------------------------------------------------------

_OLD = "SELECT CAST(o_orderkey AS VARCHAR) AS file_path, o_custkey AS size, o_orderdate AS mtime, o_orderstatus AS content_hash FROM orders WHERE o_orderpriority <> '1-URGENT'"
_NEW = "SELECT CAST(o_orderkey AS VARCHAR) AS file_path, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS size, o_orderdate AS mtime, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS content_hash FROM orders WHERE o_orderpriority <> '5-LOW'"


def _manifests(g: G) -> tuple[DataFrame, DataFrame]:
    key, k = F.col("o_orderkey").cast("string").alias("file_path"), F.col("o_orderkey")
    old = g.orders.where("o_orderpriority != '1-URGENT'").select(key, F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("mtime"), F.col("o_orderstatus").alias("content_hash"))
    new = g.orders.where("o_orderpriority != '5-LOW'").select(key, (F.col("o_custkey") + F.when(k % 3 == 0, 1).otherwise(0)).alias("size"), F.col("o_orderdate").alias("mtime"), F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("content_hash"))
    return old, new


query("src6_manifest_delta", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN (o.size = n.size AND o.mtime = n.mtime) OR o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file_path = n.file_path")(
    lambda g: manifest.delta(*_manifests(g))
)
query("src7_manifest_upsert", f"WITH o AS ({_OLD}), n AS ({_NEW}), d AS (SELECT file_path FROM n WHERE content_hash = 'X'), k AS (SELECT * FROM n WHERE file_path NOT IN (SELECT file_path FROM d)) SELECT file_path, content_hash FROM o WHERE file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT file_path, content_hash FROM k")(
    lambda g: (m := _manifests(g)) and manifest.upserted(m[0], m[1], m[1].where("content_hash = 'X'").select("file_path")).select("file_path", "content_hash")
)
query("src3_content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")(lambda g: g.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")))
query("src12_commit_references", "WITH m AS (SELECT event_id AS c, CASE event_id % 4 WHEN 0 THEN 'Fixes #' || user_id || ' and #7' WHEN 1 THEN 'see #' || user_id WHEN 2 THEN 'closed #12' ELSE 'nothing' END AS message FROM events) SELECT DISTINCT c AS \"commit\", CAST(unnest(regexp_extract_all(message, '#([0-9]+)', 1)) AS BIGINT) AS issue FROM m")(
    lambda g: manifest.commit_refs(g.events.select(F.col("event_id").alias("commit"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Fixes #"), "user_id", F.lit(" and #7"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("see #"), "user_id")).when(F.col("event_id") % 4 == 2, F.lit("closed #12")).otherwise("nothing").alias("message"))).select("commit", "issue").distinct()
)
query("src10_headings", "WITH l AS (SELECT doc_id, unnest(string_split('# ' || coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split('# ' || coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents) SELECT doc_id, CAST(line AS BIGINT) AS line, length(regexp_extract(l, '^(#{1,6})\\s', 1)) AS level FROM l WHERE regexp_matches(l, '^#{1,6}\\s')")(
    lambda g: manifest.headings(g.documents.select("doc_id", F.concat(F.lit("# "), F.coalesce("text", F.lit(""))).alias("text"))).select("doc_id", F.col("line").cast("long").alias("line"), "level")
)
query("sm6_removed_symbols", with_graph(", g AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 5 = 0) SELECT src, dst, dep_type FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)", "e"))(
    lambda g: changes.folded(g.edges.select("src", "dst", "dep_type"), g.supplier.where("s_suppkey % 5 = 0").select(F.lit("symbol_removed").alias("op"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("dep_type"), F.lit(1).cast("long").alias("seq")))
)
query("fed3_federated_ids", with_graph("SELECT space || '::' || id AS fid FROM n, (VALUES ('a'), ('b')) s(space)", "n"))(
    lambda g: g.nodes.crossJoin(F.broadcast(g.spark.createDataFrame([("a",), ("b",)], "space string"))).select(F.concat_ws("::", "space", "id").alias("fid"))
)
