"""Registered queries over the driver's tables and the SQL that must give the same rows.

Each entry runs an operator over whole tables. The graph is that of graphloom.graphs; G is short
for its loaded parts. Ranks and scores are rounded on both sides where they are sums of doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import graphs
from graphloom.graphs import with_graph
from graphloom.model import in_scope, module_of, rounded, severity_weight
from graphloom.operators import access, aggregate, analytics, federation, lenses, reach, search, stats
from graphloom.session import table
from graphloom.sources import manifest
from graphloom.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class G:
    """The graph of a folder; every part is a lazily read DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "degrees":
            return access.with_degrees(self.nodes, self.edges)
        if name == "flow_nodes":
            f = self.flow
            return f.select(F.col("src").alias("id")).union(f.select("dst")).distinct()
        make = getattr(graphs, name, None)
        return make(self.spark, self.dir) if make else table(self.spark, self.dir, name)

    def seed(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[G], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(G(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- adjacency -----------------------------------------------------------------------------

query("ga1_callers", with_graph("SELECT DISTINCT src AS id FROM e WHERE dst = 'part:7'", "e"))(lambda g: access.callers(g.edges, "part:7"))
query("ga2_callees", with_graph("SELECT dst AS id, dep_type FROM e WHERE src = 'supplier:3'", "e"))(lambda g: access.callees(g.edges, "supplier:3").select("id", "dep_type"))
query("ga3_callees_with_metadata", with_graph("SELECT dst AS id, dep_type, provenance, confidence FROM e WHERE src = 'supplier:3'", "e"))(lambda g: access.callees(g.edges, "supplier:3"))
query("ga4_edges", with_graph("SELECT * FROM e", "e"))(lambda g: g.edges)
query("ga6_fan_in", with_graph("SELECT dst AS id, count(DISTINCT src) AS fan_in FROM e GROUP BY dst", "e"))(lambda g: access.fan_in(g.edges))
query("ga7_fan_out", with_graph("SELECT src AS id, count(*) AS fan_out FROM (SELECT DISTINCT src, dst, dep_type FROM e) GROUP BY src", "e"))(lambda g: access.fan_out(g.edges))
query("ga8_find_by_name", with_graph("SELECT * FROM n WHERE lower(name) = lower('Supplier#000000003') OR lower(name) = 'france'", "n"))(
    lambda g: access.find_by_name(g.nodes, "SUPPLIER#000000003").union(access.find_by_name(g.nodes, "France"))
)
query("ga9_roots", with_graph("SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)", "n", "e"))(lambda g: access.roots(g.nodes, g.edges).select("id"))
query("ga10_leaves", with_graph("SELECT id FROM n WHERE id NOT IN (SELECT src FROM e)", "n", "e"))(lambda g: access.leaves(g.nodes, g.edges).select("id"))
query("ga27_members", with_graph("SELECT src, dst FROM e WHERE dep_type = 'contains'", "e"))(lambda g: access.by_kind(g.edges, ["contains"]).select("src", "dst"))
query("ga30_related_names", with_graph("SELECT id, name, CAST(levenshtein(lower(name), 'nation_1x') AS INTEGER) AS distance FROM n WHERE levenshtein(lower(name), 'nation_1x') <= 1", "n"))(
    lambda g: access.related_names(g.nodes, "Nation_1x", 1)
)
query("ga31_local_edges", with_graph(", m AS (SELECT id, regexp_replace(file, '/?[^/]*$', '') AS module FROM n) SELECT src, dst, dep_type, a.module FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module = b.module", "n", "e"))(
    lambda g: access.local_edges(g.nodes, g.edges)
)
query("ga32_merged", with_graph("SELECT src, dst, dep_type, provenance, confidence FROM e", "e"))(lambda g: access.merged(g.edges, g.calls, g.contains))

# --- traversal -----------------------------------------------------------------------------

_REACH = ", r(id, depth) AS (SELECT '{seed}', 0 UNION SELECT e.{to}, depth + 1 FROM r JOIN e ON e.{of} = r.id WHERE depth < {most}) SELECT id, min(depth) AS depth FROM r {where} GROUP BY id"
_down = lambda seed, most, where="": with_graph(_REACH.format(seed=seed, to="dst", of="src", most=most, where=where), "e", recursive=True)
_up = lambda seed, most, where="": with_graph(_REACH.format(seed=seed, to="src", of="dst", most=most, where=where), "e", recursive=True)
query("ga18_forward_reach", _down("region:1", 3, "WHERE depth > 0"))(lambda g: reach.neighbours(g.edges, g.seed("region:1"), 3))
query("ga17_impact_radius", _up("part:7", 2, "WHERE depth > 0"))(lambda g: reach.neighbours(g.edges, g.seed("part:7"), 2, "incoming"))
query("ga12_all_dependents", _up("part:11", 32))(lambda g: reach.reach(g.edges, g.seed("part:11"), "incoming"))
query("ga13_all_dependencies", _down("nation:6", 32))(lambda g: reach.reach(g.edges, g.seed("nation:6")))
query("ql12_explore", _down("nation:6", 2))(lambda g: reach.reach(g.edges, g.seed("nation:6"), "outgoing", 2))
_FLOW = ", e AS (SELECT * FROM f)"
_BOTH = ", b AS (SELECT src AS x, dst AS y FROM f UNION SELECT dst, src FROM f)"
query("ql14_neighbours_both", with_graph(_BOTH + ", r(id, depth) AS (SELECT (SELECT min(src) FROM f), 0 UNION SELECT y, depth + 1 FROM r JOIN b ON x = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0", "f", recursive=True))(
    lambda g: reach.neighbours(g.flow, g.flow.agg(F.min("src").alias("id")), 3, "both")
)
query("ql15_subgraph", with_graph(", r(id, depth) AS (SELECT 'nation:3', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 2) SELECT src, dst, dep_type, provenance, confidence FROM e WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)", "e", recursive=True))(
    lambda g: reach.subgraph(g.edges, g.seed("nation:3"), 2)[1]
)
_PAIRS = ", r(a, b, depth) AS (SELECT src, dst, 1 FROM f UNION SELECT r.a, f.dst, depth + 1 FROM r JOIN f ON f.src = r.b WHERE depth < 5)"
query("ga16_pair_reach", with_graph(_PAIRS + " SELECT a, b, min(depth) AS depth FROM r GROUP BY a, b", "f", recursive=True))(lambda g: reach.pair_reach(g.flow))
_SIMPLE = ", p(src, a, hops, path) AS (SELECT src, dst, 1, [src, dst] FROM f WHERE src <> dst UNION ALL SELECT p.src, f.dst, hops + 1, list_append(path, f.dst) FROM p JOIN f ON f.src = p.a WHERE hops < 3 AND NOT list_contains(path, f.dst))"
query("al9_simple_paths", with_graph(_SIMPLE + " SELECT src, a AS dst, hops, array_to_string(path, '>') AS path FROM p", "f", recursive=True))(
    lambda g: reach.simple_paths(g.flow, g.flow_nodes, g.flow_nodes, 3).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))
)
query("ga11_shortest_paths", with_graph(", p(src, a, hops, path) AS (SELECT src, dst, 1, [src, dst] FROM f WHERE src <> dst UNION ALL SELECT p.src, f.dst, hops + 1, list_append(path, f.dst) FROM p JOIN f ON f.src = p.a WHERE hops < 4 AND NOT list_contains(path, f.dst)), k AS (SELECT *, row_number() OVER (PARTITION BY src, a ORDER BY hops, path) AS r FROM p) SELECT src, a AS dst, hops, array_to_string(path, '>') AS path FROM k WHERE r = 1", "f", recursive=True))(
    lambda g: reach.shortest_paths(g.flow, g.flow_nodes).where("hops > 0").select("src", "dst", "hops", F.array_join("path", ">").alias("path"))
)
query("al18_k_shortest_paths", with_graph(_SIMPLE + ", k AS (SELECT *, row_number() OVER (PARTITION BY src, a ORDER BY hops, path) AS r FROM p) SELECT src, a AS dst, hops, array_to_string(path, '>') AS path FROM k WHERE r <= 2", "f", recursive=True))(
    lambda g: reach.simple_paths(g.flow, g.flow_nodes, g.flow_nodes, 3)
    .withColumn("r", F.row_number().over(Window.partitionBy("src", "dst").orderBy("hops", "path")))
    .where("r <= 2")
    .select("src", "dst", "hops", F.array_join("path", ">").alias("path"))
)
query("al19_multi_source", with_graph(", r(id, depth) AS (SELECT id, 0 FROM n WHERE kind = 'class' UNION SELECT dst, depth + 1 FROM r JOIN e ON src = r.id WHERE depth < 3) SELECT DISTINCT id FROM r WHERE depth > 0", "n", "e", recursive=True))(
    lambda g: reach.reach(g.edges, g.nodes.where("kind = 'class'"), "outgoing", 3).where("depth > 0").select("id")
)

# --- find, patterns, sets ------------------------------------------------------------------

query("ql1_find_symbols", with_graph("SELECT id, name, file, line, fan_in, fan_out FROM d WHERE kind = 'function' AND fan_out >= 5 AND contains(lower(name), 'supplier')", "d"))(
    lambda g: g.degrees.where("kind = 'function' AND fan_out >= 5").where(F.contains(F.lower("name"), F.lit("supplier"))).select("id", "name", "file", "line", "fan_in", "fan_out")
)
query("ql2_find_files", with_graph(", a AS (SELECT file, count(*) AS symbol_count FROM n GROUP BY file), b AS (SELECT file_path, count(*) AS k, sum(CASE WHEN severity = 'blocker' THEN 1 ELSE 0 END) AS bl FROM i GROUP BY file_path) SELECT file, symbol_count, coalesce(k, 0) AS issue_count, CAST(coalesce(bl, 0) AS BIGINT) AS blockers FROM a LEFT JOIN b ON file = file_path WHERE symbol_count >= 2", "n", "i"))(
    lambda g: g.nodes.groupBy("file")
    .agg(F.count(F.lit(1)).alias("symbol_count"))
    .join(g.issues.groupBy(F.col("file_path").alias("file")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("severity") == "blocker").alias("bl")), "file", "left")
    .where("symbol_count >= 2")
    .select("file", "symbol_count", F.coalesce("k", F.lit(0)).alias("issue_count"), F.coalesce("bl", F.lit(0)).alias("blockers"))
)
query("ql3_find_scopes", with_graph("SELECT regexp_replace(file, '/?[^/]*$', '') AS scope, count(DISTINCT file) AS file_count, count(*) AS symbol_count FROM n GROUP BY 1", "n"))(
    lambda g: g.nodes.groupBy(module_of(F.col("file")).alias("scope")).agg(F.countDistinct("file").alias("file_count"), F.count(F.lit(1)).alias("symbol_count"))
)
query("ql4_find_issues", with_graph("SELECT * FROM i WHERE severity = 'critical' AND status = 'open'", "i"))(lambda g: aggregate.issues_in_scope(g.issues, None, "Critical", "open"))
query("ql5_find_by_kind", with_graph("SELECT * FROM n WHERE kind = 'class' AND (file = 'EUROPE' OR starts_with(file, 'EUROPE/'))", "n"))(lambda g: g.nodes.where("kind = 'class'").where(in_scope(F.col("file"), "EUROPE")))
query("ql16_cluster_by_kind", with_graph("SELECT kind, count(*) AS n FROM n GROUP BY kind", "n"))(lambda g: g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("ql18_and", with_graph("SELECT id FROM n WHERE kind = 'function' INTERSECT SELECT src FROM e", "n", "e"))(lambda g: g.nodes.where("kind = 'function'").select("id").intersect(g.edges.select("src").distinct()))
query("ql18_or", with_graph("SELECT id FROM n WHERE kind = 'class' UNION SELECT dst FROM e WHERE confidence >= 0.99", "n", "e"))(lambda g: g.nodes.where("kind = 'class'").select("id").union(g.edges.where("confidence >= 0.99").select("dst")).distinct())
query("ql18_not", with_graph("SELECT id FROM n EXCEPT SELECT dst FROM e WHERE dep_type = 'calls'", "n", "e"))(lambda g: g.nodes.select("id").subtract(g.edges.where("dep_type = 'calls'").select("dst")))
query("ql19_row_limit", with_graph("SELECT id FROM n ORDER BY id LIMIT 25", "n"))(lambda g: g.nodes.select("id").orderBy("id").limit(25))
query("ql25_match", with_graph("SELECT a.id AS a, b.id AS b, x.confidence FROM n a JOIN e x ON x.src = a.id JOIN n b ON b.id = x.dst WHERE a.kind = 'function' AND b.kind = 'method' AND x.dep_type = 'calls' AND x.provenance = 'inferred'", "n", "e"))(
    lambda g: g.nodes.where("kind = 'function'").select(F.col("id").alias("a")).join(g.edges.where("dep_type = 'calls' AND provenance = 'inferred'"), F.col("a") == F.col("src")).join(g.nodes.where("kind = 'method'").select(F.col("id").alias("b")), F.col("b") == F.col("dst")).select("a", "b", "confidence")
)
query("ql27_quantifier", with_graph("SELECT src AS a, dst AS b, 1 AS hops FROM e WHERE src LIKE 'nation:%' UNION ALL SELECT DISTINCT x.src, y.dst, 2 FROM e x JOIN e y ON x.dst = y.src WHERE x.src LIKE 'nation:%'", "e"))(
    lambda g: reach.distances(g.edges, g.nodes.where("kind = 'class'"), 2).where("hops > 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), "hops")
)
query("ql31_match_count", with_graph("SELECT a.kind AS from_kind, b.kind AS to_kind, count(*) AS n FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY 1, 2", "n", "e"))(
    lambda g: g.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("kind").alias("from_kind")), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind")), "dst").groupBy("from_kind", "to_kind").agg(F.count(F.lit(1)).alias("n"))
)
query("ql33_confidence_filter", with_graph("SELECT src, dst FROM e WHERE confidence >= 0.95 AND provenance <> 'manual'", "e"))(lambda g: g.edges.where("confidence >= 0.95 AND provenance != 'manual'").select("src", "dst"))

# --- aggregation ---------------------------------------------------------------------------

_MODULES = ", m AS (SELECT id, regexp_replace(file, '/?[^/]*$', '') AS module FROM n), p AS (SELECT a.module AS src_module, b.module AS dst_module, count(*) AS n FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module <> b.module GROUP BY 1, 2)"
query("ag1_module_edges", with_graph(_MODULES + " SELECT * FROM p", "n", "e"))(lambda g: aggregate.module_edges(g.nodes, g.edges))
query("ag1_module_dependencies", with_graph(_MODULES + ", o AS (SELECT src_module AS module, string_agg(DISTINCT dst_module, ',' ORDER BY dst_module) AS depends_on, sum(n) AS k FROM p GROUP BY 1), q AS (SELECT dst_module AS module, string_agg(DISTINCT src_module, ',' ORDER BY src_module) AS depended_by, sum(n) AS k FROM p GROUP BY 1) SELECT coalesce(o.module, q.module) AS module, coalesce(depends_on, '') AS depends_on, coalesce(depended_by, '') AS depended_by, CAST(coalesce(o.k, 0) + coalesce(q.k, 0) AS BIGINT) AS coupling FROM o FULL JOIN q ON o.module = q.module", "n", "e"))(
    lambda g: aggregate.module_dependencies(aggregate.module_edges(g.nodes, g.edges))
)
query("ag2_modules", with_graph("SELECT DISTINCT regexp_replace(file, '/?[^/]*$', '') AS module FROM n", "n"))(lambda g: g.nodes.select(module_of(F.col("file")).alias("module")).distinct())
query("ag3_hot_paths", with_graph("SELECT id, name, fan_in, fan_out FROM d WHERE fan_in > 0 ORDER BY fan_in DESC, id LIMIT 20", "d"))(lambda g: aggregate.hot_paths(g.degrees, 20))
query("ag4_complexity", with_graph("SELECT count(*) AS symbols, CAST(sum(fan_out) AS BIGINT) AS edges, CAST(greatest(0, sum(fan_out) - count(*) + 2) AS BIGINT) AS complexity, count(*) FILTER (fan_in = 0) AS roots, count(*) FILTER (fan_out = 0) AS leaves, count(*) FILTER (fan_out >= 10) AS high, count(*) FILTER (fan_out BETWEEN 5 AND 9) AS medium, count(*) FILTER (fan_out < 5) AS low FROM d", "d"))(
    lambda g: aggregate.complexity_report(g.degrees)
)
query("ag5_entry_points", with_graph("SELECT id, fan_out FROM d WHERE fan_in = 0", "d"))(lambda g: g.degrees.where("fan_in = 0").select("id", "fan_out"))
query("ag6_leaf_functions", with_graph("SELECT id, fan_in FROM d WHERE fan_out = 0", "d"))(lambda g: g.degrees.where("fan_out = 0").select("id", "fan_in"))
_CLOSURE = ", r(a, b) AS (SELECT src, dst FROM f UNION SELECT r.a, f.dst FROM r JOIN f ON f.src = r.b)"
query("ag7_impact", with_graph(_CLOSURE + ", v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), x AS (SELECT v.id, (SELECT count(DISTINCT src) FROM f WHERE dst = v.id AND src <> v.id) AS direct, (SELECT count(*) FROM r WHERE b = v.id AND a <> v.id) AS transitive, (SELECT count(DISTINCT split_part(a, ':', 1)) FROM r WHERE b = v.id AND a <> v.id) AS files FROM v) SELECT *, CASE WHEN direct = 0 AND transitive = 0 THEN 'minimal' WHEN direct <= 2 AND transitive <= 5 THEN 'low' WHEN direct <= 5 AND transitive <= 15 THEN 'medium' WHEN direct <= 10 AND transitive <= 30 THEN 'high' ELSE 'critical' END AS level FROM x", "f", recursive=True))(
    lambda g: aggregate.impact(g.flow_nodes.select("id", F.lit("function").alias("kind"), F.split_part("id", F.lit(":"), F.lit(1)).alias("file")), g.flow, reach.pair_reach(g.flow))
)
query("ag10_dead_code", with_graph(_CLOSURE + ", v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), t AS (SELECT id FROM v WHERE id NOT IN (SELECT dst FROM f)) SELECT id FROM v WHERE id NOT IN (SELECT id FROM t) AND id NOT IN (SELECT b FROM r WHERE a IN (SELECT id FROM t))", "f", recursive=True))(
    lambda g: aggregate.dead_code(g.flow_nodes.withColumn("kind", F.lit("function")), g.flow).select("id")
)
query("ag10_unreferenced", with_graph("SELECT id FROM n WHERE kind IN ('function', 'method', 'class') AND id NOT IN (SELECT dst FROM e)", "n", "e"))(lambda g: aggregate.unreferenced(g.nodes, g.edges).select("id"))
query("ag12_graph_stats", with_graph("SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT file) FROM n) AS files", "n", "e"))(
    lambda g: g.spark.createDataFrame([(g.nodes.count(), g.edges.count(), g.nodes.select("file").distinct().count())], "nodes long, edges long, files long")
)
query("ag13_severity_counts", with_graph("SELECT file_path, count(*) FILTER (severity = 'blocker') AS blocker, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'info') AS info FROM i GROUP BY 1", "i"))(
    lambda g: aggregate.severity_counts(g.issues, "file_path")
)
query("ag14_rule_summary", with_graph("SELECT rule_id, CASE WHEN rule_id = 'R1' THEN 'first lines' ELSE rule_id END AS description, count(*) FILTER (status = 'open') AS open FROM i GROUP BY 1", "i"))(
    lambda g: aggregate.rule_summary(g.issues, g.spark.createDataFrame([("R1", "first lines")], "rule_id string, description string"))
)
query("ag15_quality_gate", "SELECT CAST(o_custkey AS VARCHAR) AS workspace_id, o_orderstatus AS rating, o_orderdate AS snapshot_at, o_orderkey AS run FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderkey DESC) = 1")(
    lambda g: aggregate.latest_baseline(g.orders.select(F.col("o_custkey").cast("string").alias("workspace_id"), F.col("o_orderstatus").alias("rating"), F.col("o_orderdate").alias("snapshot_at"), F.col("o_orderkey").alias("run")))
)
query("ag16_open_issues", with_graph("SELECT count(*) AS open FROM i WHERE status = 'open'", "i"))(lambda g: g.issues.where("status = 'open'").agg(F.count(F.lit(1)).alias("open")))
query("ag17_issues_in_scope", with_graph("SELECT id, severity, line FROM i WHERE file_path = 'ASIA' OR starts_with(file_path, 'ASIA/')", "i"))(lambda g: aggregate.issues_in_scope(g.issues, "ASIA").select("id", "severity", "line"))
_WEIGHT = "CASE provenance WHEN 'tested' THEN 1.0 WHEN 'manual' THEN 0.9 WHEN 'extracted' THEN 0.85 WHEN 'inferred' THEN 0.5 WHEN 'ambiguous' THEN 0.3 ELSE 0 END"
query("ag19_edge_score", with_graph(f"SELECT src, dst, round(least(1.0, greatest(0.0, CAST({_WEIGHT} AS DOUBLE) * confidence)), 9) AS score FROM e", "e"))(lambda g: (e := g.edges).select("src", "dst", rounded(aggregate.edge_score(e), 9).alias("score")))
query("ag20_target_score", with_graph(f", b AS (SELECT dst, provenance, max(least(1.0, greatest(0.0, CAST({_WEIGHT} AS DOUBLE) * confidence))) AS s FROM e GROUP BY 1, 2) SELECT dst AS id, round(least(1.0, sum(s)), 9) AS score FROM b GROUP BY 1", "e"))(
    lambda g: aggregate.target_scores(g.edges).select("id", rounded("score", 9).alias("score"))
)
query("ag21_health", with_graph("SELECT round(100 - least(50.0 * count(*) FILTER (fan_in = 0) / count(*), 30) - CASE WHEN count(*) > 1000 THEN 5 ELSE 0 END, 6) AS health FROM d", "d"))(
    lambda g: g.degrees.agg((F.count_if(F.col("fan_in") == 0) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n")).select(rounded(aggregate.health(F.col("share"), F.col("n")), 6).alias("health"))
)
query("ag25_review", with_graph(", c AS (SELECT DISTINCT file FROM n WHERE starts_with(file, 'Brand#1')), u AS (SELECT DISTINCT src FROM e WHERE dst IN (SELECT id FROM n WHERE file IN (SELECT file FROM c))) SELECT file, count(*) AS dependents FROM n WHERE id IN (SELECT src FROM u) AND file NOT IN (SELECT file FROM c) GROUP BY file", "n", "e"))(
    lambda g: aggregate.review(g.nodes, g.edges, g.nodes.where(F.col("file").startswith("Brand#1")).select("file").distinct())
)
query("ag26_god_functions", with_graph("SELECT id, fan_in, fan_out, round(least(100.0, 25.0 * fan_in / 30 + 25.0 * fan_out / 400), 9) AS score FROM d WHERE fan_in >= 30 OR fan_out >= 400", "d"))(
    lambda g: aggregate.god_functions(g.degrees, 30, 400).withColumn("score", rounded("score", 9))
)
query("ag28_graph_diff", with_graph("SELECT CASE WHEN provenance = 'inferred' THEN 'added' ELSE 'removed' END AS op, src, dst, dep_type FROM e WHERE provenance IN ('inferred', 'ambiguous')", "e"))(
    lambda g: aggregate.edge_diff(g.edges.where("provenance != 'inferred'"), g.edges.where("provenance != 'ambiguous'"))
)
query("ag29_api_breaks", with_graph("SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e WHERE provenance <> 'inferred') AND id IN (SELECT dst FROM e)", "n", "e"))(
    lambda g: access.roots(g.nodes, g.edges.where("provenance != 'inferred'")).join(access.roots(g.nodes, g.edges), "id", "left_anti").select("id")
)
query("ag30_hot_symbols", ", ".join(["WITH c AS (SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events GROUP BY 1) SELECT id, n", "n / CAST((SELECT max(n) FROM c) AS DOUBLE) AS ratio FROM c"]))(
    lambda g: aggregate.hot_ratio(g.events.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")))
)
query("ag34_keep_last", "SELECT CAST(user_id AS VARCHAR) AS id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")(
    lambda g: aggregate.keep_last(g.events.select(F.col("user_id").cast("string").alias("id"), "event_type", "ts", "event_id"), ["id", "event_type"], ["ts", "event_id"]).select("id", "event_type", "event_id")
)
query("lv9_seam_map", with_graph(_MODULES + " SELECT least(src_module, dst_module) AS a, greatest(src_module, dst_module) AS b, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2", "n", "e"))(lambda g: aggregate.seam_map(aggregate.module_edges(g.nodes, g.edges)))
_SEV = "CASE severity WHEN 'blocker' THEN 3.0 WHEN 'critical' THEN 2.0 WHEN 'major' THEN 1.5 WHEN 'minor' THEN 1.0 WHEN 'info' THEN 0.5 ELSE 1.0 END"
query("lv1_symbol_risk", with_graph(f", w AS (SELECT file_path, line, CAST(sum({_SEV}) AS DOUBLE) AS weight FROM i GROUP BY 1, 2), x AS (SELECT d.id, fan_in, coalesce(weight, 0) AS weight, round(0.4 * fan_in + 0.6 * coalesce(weight, 0), 6) AS risk, weight IS NOT NULL AS has FROM d LEFT JOIN w ON file = file_path AND d.line = w.line) SELECT id, fan_in, weight, risk, CASE WHEN risk >= 8 THEN 'critical' WHEN risk >= 4 THEN 'warning' ELSE 'info' END AS band FROM x WHERE fan_in >= 2 OR has", "d", "i"))(
    lambda g: aggregate.symbol_risk(g.degrees, g.issues).withColumn("risk", rounded("risk", 6))
)
query("lv2_severity_weight", with_graph(f"SELECT id, CAST({_SEV} AS DOUBLE) AS weight FROM i", "i"))(lambda g: g.issues.select("id", severity_weight(F.col("severity")).alias("weight")))
query("lv3_file_risk", with_graph(f", a AS (SELECT file, 0.4 * sum(fan_in) AS fan FROM d GROUP BY 1), b AS (SELECT file_path, 0.6 * sum({_SEV}) AS w FROM i GROUP BY 1), x AS (SELECT coalesce(file, file_path) AS file, CAST(coalesce(fan, 0) + coalesce(w, 0) AS DOUBLE) AS risk FROM a FULL JOIN b ON file = file_path) SELECT file, round(risk, 6) AS risk, CASE WHEN risk >= 15 THEN 'critical' WHEN risk >= 8 THEN 'warning' ELSE 'info' END AS band FROM x", "d", "i"))(
    lambda g: aggregate.file_risk(g.degrees, g.issues).withColumn("risk", rounded("risk", 6))
)
query("lv11_api_surface", with_graph("SELECT name, id FROM n WHERE file = 'AFRICA' OR starts_with(file, 'AFRICA/')", "n"))(lambda g: g.nodes.where(in_scope(F.col("file"), "AFRICA")).select("name", "id"))
# callers in test files come from tests of the supplier: an edge back from each part of its extracted calls
_TESTED = ", t AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE provenance = 'extracted')"
query("lv12_test_slice", with_graph(_TESTED + " SELECT id, name, file, line FROM n WHERE id IN (SELECT src FROM t WHERE dst = 'supplier:3') AND contains(file, '/tests/')", "n", "e"))(
    lambda g: lenses.test_slice(g.nodes, _tested(g), "supplier:3")
)


def _tested(g: G) -> DataFrame:
    return g.edges.select("src", "dst").union(g.edges.where("provenance = 'extracted'").select("dst", "src"))


# --- algorithms ----------------------------------------------------------------------------

_V = ", v AS (SELECT src AS id FROM f UNION SELECT dst FROM f)"


def _pagerank_sql(rounds: int) -> str:
    sql = _V + ", c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, count(*) AS k FROM f GROUP BY src), r0 AS (SELECT id, 1 / n AS rank FROM v, c)"
    for i in range(rounds):
        sql += f", r{i + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / n) AS rank FROM v CROSS JOIN c LEFT JOIN (SELECT f.dst, sum(rank / k) AS got FROM f JOIN r{i} ON id = f.src JOIN o ON o.src = f.src GROUP BY f.dst) ON dst = v.id)"
    return with_graph(sql + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}", "f")


query("al1_pagerank", _pagerank_sql(5))(lambda g: analytics.pagerank(g.flow_nodes, g.flow, iterations=5).withColumn("rank", rounded("rank", 9)))


def _labels_sql(rounds: int) -> str:
    sql = _V + ", b AS (SELECT src AS a, dst AS b FROM f UNION ALL SELECT dst, src FROM f), l0 AS (SELECT id, id AS label FROM v)"
    for i in range(rounds):
        sql += f", l{i + 1} AS (SELECT l.id, coalesce(x.label, l.label) AS label FROM l{i} l LEFT JOIN (SELECT a, label FROM (SELECT b.a, m.label, count(*) AS k FROM b JOIN l{i} m ON m.id = b.b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY k DESC, label) = 1) x ON x.a = l.id)"
    return with_graph(sql + f" SELECT id, label FROM l{rounds}", "f")


query("al3_communities", _labels_sql(4))(lambda g: analytics.label_propagation(g.flow_nodes, g.flow, 4))
_SCC = _CLOSURE + _V + ", s AS (SELECT v.id, least(v.id, coalesce(min(x.b), v.id)) AS component FROM v LEFT JOIN r x ON x.a = v.id AND (x.b, x.a) IN (SELECT a, b FROM r) GROUP BY v.id)"
query("al5_strong_components", with_graph(_SCC + " SELECT * FROM s", "f", recursive=True))(lambda g: analytics.strong_components(g.flow_nodes, g.flow))
_WCC = _BOTH + _V + ", r(a, b) AS (SELECT x, y FROM b UNION SELECT r.a, y FROM r JOIN b ON x = r.b)"
query("al21_weak_components", with_graph(_WCC + " SELECT v.id, least(v.id, coalesce(min(r.b), v.id)) AS component FROM v LEFT JOIN r ON r.a = v.id GROUP BY v.id", "f", recursive=True))(lambda g: analytics.weak_components(g.flow_nodes, g.flow))
query("al22_cycles", with_graph(_SCC + " SELECT component, count(*) AS size FROM s GROUP BY component HAVING count(*) > 1 OR max(CASE WHEN id IN (SELECT src FROM f WHERE src = dst) THEN 1 ELSE 0 END) = 1", "f", recursive=True))(
    lambda g: analytics.cycles(analytics.strong_components(g.flow_nodes, g.flow), g.flow)
)
query("al24_in_a_cycle", with_graph(_CLOSURE + " SELECT DISTINCT a AS id FROM r WHERE a = b", "f", recursive=True))(lambda g: analytics.in_cycles(analytics.strong_components(g.flow_nodes, g.flow), g.flow))
query("al4_god_nodes", with_graph(", s AS (SELECT id, fan_in AS score FROM d), t AS (SELECT score FROM s ORDER BY score LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM s)) SELECT id, score FROM s WHERE score >= (SELECT score FROM t)", "d"))(
    lambda g: analytics.god_nodes(g.degrees.select("id", F.col("fan_in").alias("score")), 0.95)
)
query("al10_community_god_nodes", with_graph(", s AS (SELECT id, kind, fan_in AS score FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score, id) - 1 AS r, count(*) OVER (PARTITION BY kind) AS n FROM s), t AS (SELECT kind, score AS lim FROM k WHERE r = least(CAST(floor(n * 0.9) AS BIGINT), n - 1)) SELECT kind, id, score FROM s JOIN t USING (kind) WHERE score >= lim", "d"))(
    lambda g: analytics.god_nodes(g.degrees.select("id", "kind", F.col("fan_in").alias("score")), 0.9, "kind")
)
_KIND = ", u AS (SELECT DISTINCT src, dst FROM e), x AS (SELECT src, dst, a.kind AS ca, b.kind AS cb, a.fan_in * b.fan_in AS s, a.fan_in AS fa, b.fan_in AS fb FROM u JOIN d a ON a.id = src JOIN d b ON b.id = dst)"
query("al11_surprising", with_graph(_KIND + " SELECT src, dst, CAST(s AS BIGINT) AS score FROM x WHERE ca <> cb ORDER BY s DESC, src, dst LIMIT 15", "d"))(
    lambda g: (d := g.degrees) and analytics.surprising_connections(g.edges, d.select("id", "kind"), d.select("id", "fan_in"), 15)
)
_TYPE = ", x AS (SELECT split_part(src, ':', 2) AS ca, split_part(dst, ':', 2) AS cb FROM f)"
_of = lambda g: g.flow_nodes.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("community"))
query("al25_cohesion", with_graph(_TYPE + " SELECT ca AS community, round(avg(CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END), 9) AS cohesion FROM x GROUP BY 1", "f"))(lambda g: analytics.cohesion(g.flow, _of(g)).withColumn("cohesion", rounded("cohesion", 9)))
query("al16_conductance", with_graph(_TYPE + ", p AS (SELECT ca, count(*) AS volume, count(*) FILTER (ca <> cb) AS cut FROM x GROUP BY 1) SELECT ca AS community, round(CASE WHEN least(volume, (SELECT count(*) FROM x) - volume) > 0 THEN CAST(cut AS DOUBLE) / least(volume, (SELECT count(*) FROM x) - volume) ELSE 0 END, 9) AS conductance FROM p", "f"))(
    lambda g: analytics.conductance(g.flow, _of(g)).withColumn("conductance", rounded("conductance", 9))
)
query("al17_modularity", with_graph(_TYPE + ", m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM x), o AS (SELECT ca AS c, count(*) AS o, count(*) FILTER (ca = cb) AS i FROM x GROUP BY 1), n AS (SELECT cb AS c, count(*) AS n FROM x GROUP BY 1) SELECT round(sum(coalesce(i, 0) / m - coalesce(o, 0) * coalesce(n, 0) / (m * m)), 9) AS modularity, count(*) AS communities FROM (SELECT * FROM o FULL JOIN n USING (c)), m", "f"))(
    lambda g: analytics.modularity(g.flow, _of(g)).withColumn("modularity", rounded("modularity", 9))
)
query("al15_k_core", with_graph(", p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM f WHERE src <> dst), q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), d0 AS (SELECT a FROM q GROUP BY a HAVING count(*) >= 2), q1 AS (SELECT * FROM q WHERE a IN (SELECT a FROM d0) AND b IN (SELECT a FROM d0)), d1 AS (SELECT a FROM q1 GROUP BY a HAVING count(*) >= 2), q2 AS (SELECT * FROM q1 WHERE a IN (SELECT a FROM d1) AND b IN (SELECT a FROM d1)), d2 AS (SELECT a FROM q2 GROUP BY a HAVING count(*) >= 2), q3 AS (SELECT * FROM q2 WHERE a IN (SELECT a FROM d2) AND b IN (SELECT a FROM d2)), d3 AS (SELECT a FROM q3 GROUP BY a HAVING count(*) >= 2), q4 AS (SELECT * FROM q3 WHERE a IN (SELECT a FROM d3) AND b IN (SELECT a FROM d3)) SELECT DISTINCT a AS id FROM q4", "f"))(
    lambda g: analytics.k_core(g.flow, 2)
)

# --- search, statistics, federation, sources -----------------------------------------------

_TOK = "list_filter(string_split_regex(regexp_replace(name, '([A-Z])', '_\\1', 'g'), '[_:.\\-#\\s]+'), lambda x: x <> '')"
query("se2_tokens", with_graph(f"SELECT id, lower(array_to_string({_TOK}, ' ')) AS tokens FROM n", "n"))(lambda g: g.nodes.select("id", F.array_join(search.tokens(F.col("name")), " ").alias("tokens")))
query("se3_idf", with_graph(f", t AS (SELECT DISTINCT id, unnest(list_append(list_transform({_TOK}, lambda x: lower(x)), lower(name))) AS token FROM n) SELECT token, count(*) AS df, round(ln(1 + (SELECT count(*) FROM n) / CAST(1 + count(*) AS DOUBLE)), 9) AS idf FROM t GROUP BY token", "n"))(
    lambda g: search.idf_table(g.nodes).withColumn("idf", rounded("idf", 9))
)
query("se4_similarity_search", with_graph(", x AS (SELECT id, name, lower(name) AS l, instr(lower(name), 'ring') AS p, length(name) AS k FROM n) SELECT id, name, CAST(CASE WHEN l = 'ring' THEN 4 WHEN p = 1 THEN 3 WHEN p > 1 THEN 2 ELSE 1 END AS INTEGER) AS match, round(CASE WHEN l = 'ring' THEN 1.0 WHEN p = 1 THEN 0.9 WHEN p > 1 THEN 0.7 + 0.2 * (1 - (p - 1) / CAST(k AS DOUBLE)) ELSE 2.4 / k END, 9) AS score FROM x WHERE p > 0 OR regexp_matches(l, 'r.*i.*n.*g') ORDER BY match DESC, score DESC, name, id LIMIT 20", "n"))(
    lambda g: search.similarity_search(g.nodes, "ring", 20).withColumn("score", rounded("score", 9))
)
query("se13_content_search", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(0, len(l))) AS line FROM l) SELECT doc_id, CAST(line AS INTEGER) AS line, l[line + 1] AS text, CASE WHEN line > 0 THEN l[line] END AS before, l[line + 2] AS after FROM x WHERE regexp_matches(l[line + 1], 'License')")(
    lambda g: search.lines_matching(g.documents, "License")
)
query("se15_page", with_graph("SELECT id, fan_in FROM d ORDER BY fan_in DESC, id LIMIT 10 OFFSET 20", "d"))(lambda g: search.page(g.degrees.select("id", "fan_in"), [F.desc("fan_in"), "id"], 20, 10))
query("st1_percentiles", "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN r = floor(0.5 * (n - 1)) THEN value END) AS p50, max(CASE WHEN r = floor(0.95 * (n - 1)) THEN value END) AS p95 FROM k GROUP BY 1")(
    lambda g: stats.by_index(g.events, "event_type", "value", {"p50": 0.5, "p95": 0.95})
)
query("st2_benchmark_stats", "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(CASE WHEN sum(value) > 0 THEN count(*) / (sum(value) / 1000) ELSE 0 END, 6) AS per_second, max(CASE WHEN r = floor(0.5 * (n - 1)) THEN value END) AS p50, max(CASE WHEN r = floor(0.95 * (n - 1)) THEN value END) AS p95, max(CASE WHEN r = floor(0.99 * (n - 1)) THEN value END) AS p99 FROM k GROUP BY 1")(
    lambda g: stats.benchmark_stats(g.events, "event_type", "value").withColumns({c: rounded(c, 6) for c in ("mean", "deviation", "per_second")})
)
query("st4_latency_score", "SELECT event_id, round(CASE WHEN value <= 10 THEN 100 WHEN value >= 90 THEN 0 ELSE 100.0 * (90 - value) / 80 END, 6) AS score FROM events")(lambda g: g.events.select("event_id", rounded(stats.latency_score(F.col("value"), F.lit(10.0), F.lit(90.0)), 6).alias("score")))
query("st5_consistency", "SELECT event_type, CASE WHEN stddev_samp(value) / avg(value) < 0.1 THEN 95 WHEN stddev_samp(value) / avg(value) < 0.25 THEN 80 WHEN stddev_samp(value) / avg(value) < 0.5 THEN 60 ELSE 30 END AS score FROM events GROUP BY 1")(
    lambda g: g.events.groupBy("event_type").agg(stats.consistency(F.stddev_samp("value") / F.avg("value")).alias("score"))
)
query("st9_trends", "WITH b AS (SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS base FROM events) SELECT event_id, round(base, 6) AS base, round(100.0 * (value - base) / base, 4) AS change, coalesce(100.0 * (value - base) / base < -5, false) AS alert FROM b")(
    lambda g: stats.trends(g.events, "user_id", "event_id", "value", 3).select("event_id", rounded("base", 6).alias("base"), rounded("change", 4).alias("change"), "alert")
)
query("st12_ground_truth", with_graph("SELECT count(*) FILTER (provenance = 'inferred' AND confidence >= 0.95) AS hits, count(*) FILTER (provenance = 'inferred' AND confidence >= 0.95) / CAST(count(*) FILTER (provenance = 'inferred') AS DOUBLE) AS precision, count(*) FILTER (provenance = 'inferred' AND confidence >= 0.95) / CAST(count(*) FILTER (confidence >= 0.95) AS DOUBLE) AS recall FROM e", "e"))(
    lambda g: stats.matched(g.edges.where("provenance = 'inferred'"), g.edges.where("confidence >= 0.95"), ["src", "dst", "dep_type"])
)
_whole = lambda g: g.nodes.select(F.lit("a").alias("space"), "id", F.col("name").alias("label"), "kind").union(g.nodes.select(F.lit("b"), "id", F.concat(F.lit(" "), F.lower("name"), F.lit("!")), F.when(F.col("kind") == "class", "module").otherwise(F.col("kind"))))
_WHOLE = ", x AS (SELECT 'a' AS space, id, lower(name) AS label, kind FROM n UNION ALL SELECT 'b', id, lower(name), CASE WHEN kind = 'class' THEN 'module' ELSE kind END FROM n)"
query("fed2_label_classes", with_graph(_WHOLE + " SELECT label, string_agg(DISTINCT space, ',' ORDER BY space) AS spaces, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM x GROUP BY label HAVING count(DISTINCT space) > 1", "n"))(lambda g: federation.label_classes(_whole(g)))
query("fed2_label_members", with_graph(_WHOLE + " SELECT space || '::' || id AS fid, label, kind FROM x WHERE label IN (SELECT label FROM x GROUP BY label HAVING count(DISTINCT space) > 1)", "n"))(lambda g: federation.label_members(_whole(g)))
query("fed1_federated_search_all", with_graph(", x AS (SELECT 'a' AS space, id, name AS label, 2 AS p FROM n UNION ALL SELECT 'b', id, ' ' || lower(name) || '!', 1 FROM n) SELECT space || '::' || id AS fid, label FROM x WHERE contains(lower(label), 'nat') ORDER BY p, label, id LIMIT 30", "n"))(
    lambda g: federation.federated_search(_whole(g), g.spark.createDataFrame([("a", 2), ("b", 1)], "space string, position int"), "NAT", 30)
)
query("src5_changes", "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS c FROM orders WHERE o_orderpriority <> '1-URGENT'), w AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS c FROM orders WHERE o_orderpriority <> '5-LOW') SELECT coalesce(o.k, w.k) AS file_path, CASE WHEN o.k IS NULL THEN 'new' WHEN w.k IS NULL THEN 'deleted' WHEN o.c <> w.c THEN 'changed' ELSE 'unchanged' END AS change FROM o FULL JOIN w ON o.k = w.k")(
    lambda g: manifest.changes(
        g.orders.where("o_orderpriority != '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("file_path"), F.col("o_orderstatus").alias("content_hash")),
        g.orders.where("o_orderpriority != '5-LOW'").select(F.col("o_orderkey").cast("string").alias("file_path"), F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("content_hash")),
    )
)
query("src15_page_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages")(lambda g: manifest.links(g.pages))
query("sm_activity_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")(
    lambda g: g.events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
)

# --- lenses, views, diffs, diagrams --------------------------------------------------------

query("lv4_dependencies", with_graph("SELECT id, fan_out, CASE WHEN fan_out >= 20 THEN 'critical' ELSE 'warning' END AS band FROM d WHERE fan_out > 10", "d"))(lambda g: lenses.dependency_findings(g.degrees))
query("lv6_god_modules", with_graph(_MODULES + " SELECT dst_module AS module, count(DISTINCT src_module) AS callers FROM p GROUP BY 1 HAVING count(DISTINCT src_module) > 5", "n", "e"))(lambda g: lenses.god_modules(aggregate.module_edges(g.nodes, g.edges), 5))
query("lv7_ranked_hotspots", with_graph(f", a AS (SELECT file, 0.4 * sum(fan_in) AS fan FROM d GROUP BY 1), b AS (SELECT file_path, 0.6 * sum({_SEV}) AS w FROM i GROUP BY 1), x AS (SELECT coalesce(file, file_path) AS file, round(CAST(coalesce(fan, 0) + coalesce(w, 0) AS DOUBLE), 6) AS risk FROM a FULL JOIN b ON file = file_path) SELECT file, risk FROM x ORDER BY risk DESC, file LIMIT 10", "d", "i"))(
    lambda g: lenses.ranked_hotspots(aggregate.file_risk(g.degrees, g.issues).select("file", rounded("risk", 6).alias("risk")), 10)
)
query("lv8_vertical_slice", with_graph(", r(id, depth) AS (SELECT 'nation:4', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = id WHERE depth < 3) SELECT CASE WHEN min(depth) = 0 THEN 'focus' ELSE 'callee' END AS role, id, min(depth) AS depth FROM r GROUP BY id UNION ALL SELECT DISTINCT 'caller', src, 1 FROM e WHERE dst = 'nation:4'", "e", recursive=True))(
    lambda g: lenses.vertical_slice(g.edges, g.seed("nation:4"))
)
query("lv10_scope_dependencies", with_graph(_MODULES + " SELECT CASE WHEN src_module = 'AFRICA' THEN dst_module ELSE src_module END AS scope, CAST(coalesce(sum(n) FILTER (src_module = 'AFRICA'), 0) AS BIGINT) AS outgoing, CAST(coalesce(sum(n) FILTER (dst_module = 'AFRICA'), 0) AS BIGINT) AS incoming FROM p WHERE 'AFRICA' IN (src_module, dst_module) GROUP BY 1", "n", "e"))(
    lambda g: lenses.scope_dependencies(aggregate.module_edges(g.nodes, g.edges), "AFRICA")
)
query("lv13_debug_slice", with_graph("SELECT DISTINCT role, id, name FROM (SELECT 'caller' AS role, src AS id FROM e WHERE dst = 'part:5' UNION ALL SELECT 'callee', dst FROM e WHERE src = 'part:5') JOIN n USING (id) WHERE regexp_matches(lower(name), 'supplier|log')", "n", "e"))(
    lambda g: lenses.debug_slice(g.nodes, g.edges, "part:5", ("supplier", "log"))
)
query("lv14_usage_examples", with_graph("SELECT DISTINCT role, id, name FROM (SELECT 'caller' AS role, src AS id FROM e WHERE dst = 'nation:2' UNION ALL SELECT 'callee', dst FROM e WHERE src = 'nation:2') JOIN n USING (id)", "n", "e"))(lambda g: lenses.usage_examples(g.nodes, g.edges, "nation:2"))
query("ag9_safe_to_change", with_graph(_CLOSURE + ", v AS (SELECT src AS id FROM f UNION SELECT dst FROM f), x AS (SELECT v.id, (SELECT count(DISTINCT src) FROM f WHERE dst = v.id AND src <> v.id) AS direct, (SELECT count(*) FROM r WHERE b = v.id AND a <> v.id) AS transitive FROM v) SELECT id FROM x WHERE direct <= 5 AND transitive <= 4", "f", recursive=True))(
    lambda g: lenses.safe_to_change(aggregate.impact(g.flow_nodes.select("id", F.lit("function").alias("kind"), F.lit("f").alias("file")), g.flow, reach.pair_reach(g.flow)), 4, ("minimal", "low", "medium"))
)
query("ag18_delete_issues", with_graph("SELECT id FROM i WHERE (file_path, rule_id, line) NOT IN (SELECT file_path, rule_id, line FROM i WHERE status = 'closed' AND severity = 'blocker')", "i"))(lambda g: lenses.delete_issues(g.issues, g.issues.where("status = 'closed' AND severity = 'blocker'")).select("id"))
query("ag23_architecture", with_graph(_SCC + ", c AS (SELECT count(*) AS size FROM s GROUP BY component HAVING count(*) > 1 OR max(CASE WHEN id IN (SELECT src FROM f WHERE src = dst) THEN 1 ELSE 0 END) = 1) SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS in_cycles, CAST(greatest(0, 100 - 5 * coalesce(sum(size), 0)) AS BIGINT) AS score FROM c", "f", recursive=True))(
    lambda g: lenses.architecture_score(analytics.cycles(analytics.strong_components(g.flow_nodes, g.flow), g.flow))
)
query("ag33_graph_complexity", with_graph(_WCC + ", c AS (SELECT v.id, least(v.id, coalesce(min(r.b), v.id)) AS component FROM v LEFT JOIN r ON r.a = v.id GROUP BY v.id), k AS (SELECT component, greatest((SELECT count(*) FROM f JOIN c y ON y.id = f.src WHERE y.component = c.component) - count(*) + 2, 1) AS complexity FROM c GROUP BY component) SELECT *, CASE WHEN complexity <= 10 THEN 'low' WHEN complexity <= 20 THEN 'moderate' WHEN complexity <= 50 THEN 'high' ELSE 'very high' END AS band FROM k", "f", recursive=True))(
    lambda g: lenses.graph_complexity(g.flow_nodes, g.flow)
)
query("ag34_drift", with_graph(", m AS (SELECT id, regexp_replace(file, '/?[^/]*$', '') AS module FROM n), p AS (SELECT a.module AS src_module, b.module AS dst_module, bool_or(provenance = 'extracted') AS x, bool_or(provenance = 'inferred') AS y FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.module <> b.module GROUP BY 1, 2) SELECT src_module, dst_module, CASE WHEN x AND y THEN 'matched' WHEN x THEN 'missing' ELSE 'unexpected' END AS state FROM p WHERE x OR y", "n", "e"))(
    lambda g: lenses.drift(*[aggregate.module_edges(g.nodes, g.edges.where(F.col("provenance") == p)) for p in ("extracted", "inferred")])
)
query("sm3_symbol_diff", with_graph("SELECT id, CASE WHEN kind = 'class' THEN 'removed' WHEN kind = 'module' THEN 'added' ELSE 'modified' END AS op FROM n WHERE kind IN ('class', 'module') OR (kind = 'method' AND line % 10 = 0)", "n"))(
    lambda g: lenses.symbol_diff(g.nodes.where("kind != 'module'"), g.nodes.where("kind != 'class'").withColumn("line", F.when((F.col("kind") == "method") & (F.col("line") % 10 == 0), F.col("line") + 1).otherwise(F.col("line"))), ["name", "file", "line"])
)
query("sm5_folded_events", "WITH x AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS r FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1) SELECT src, dst, 'calls' AS dep_type FROM x WHERE r <> 'R'")(
    lambda g: changes.folded(
        g.edges.limit(0),
        g.lineitem.select(F.when(F.col("l_returnflag") == "R", "dependency_removed").otherwise("dependency_added").alias("op"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("dep_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")),
    )
)
query("sm2_debounced", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS file, count(*) AS touches FROM events GROUP BY 1, 2")(
    lambda g: changes.debounced(g.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("file")), "10 minutes", "1 minute").withColumn("start", F.col("start").cast("timestamp_ntz"))
)
query("src4_classified", with_graph("SELECT DISTINCT file AS file_path, 'code' AS file_type, 'rust' AS language FROM n", "n"))(lambda g: manifest.classified(g.nodes.select(F.col("file").alias("file_path")).distinct()))
query("src11_records", "SELECT 'event:' || event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda g: g.events.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k")))
query("src13_owners", with_graph(", o(position, prefix, owner) AS (VALUES (1, '', 'all'), (2, 'ASIA', 'asia'), (3, 'ASIA/NATION_2', 'two')), x AS (SELECT DISTINCT file FROM n) SELECT file, max_by(owner, position) AS owner FROM x JOIN o ON prefix = '' OR file = prefix OR starts_with(file, prefix || '/') GROUP BY file", "n"))(
    lambda g: aggregate.owners(g.nodes.select("file").distinct(), g.spark.createDataFrame([(1, "", "all"), (2, "ASIA", "asia"), (3, "ASIA/NATION_2", "two")], "position int, prefix string, owner string"))
)
query("src21_diagram", with_graph("SELECT src || ' --> ' || dst AS line FROM f", "f"))(lambda g: lenses.diagram_lines(g.flow))
query("src22_callflow", with_graph(_MODULES + " SELECT src_module || ' -->|' || n || '| ' || dst_module AS line FROM p", "n", "e"))(lambda g: lenses.diagram_lines(aggregate.module_edges(g.nodes, g.edges), "src_module", "dst_module", "n"))
query("ga33_keyword_query", with_graph(", r(id, depth) AS (SELECT id, 0 FROM n WHERE contains(lower(name), 'small') OR contains(lower(name), 'ring') UNION SELECT src, depth + 1 FROM r JOIN e ON dst = r.id WHERE depth < 1) SELECT id, min(depth) AS depth FROM r GROUP BY id", "n", "e", recursive=True))(
    lambda g: lenses.keyword_query(g.nodes, g.edges, search.keywords("Where is a small ring?"), 1, "incoming")
)
query("ga23_has_cycle", with_graph(_CLOSURE + " SELECT count(*) > 0 AS has_cycle FROM r WHERE a = b", "f", recursive=True))(lambda g: analytics.in_cycles(analytics.strong_components(g.flow_nodes, g.flow), g.flow).agg((F.count(F.lit(1)) > 0).alias("has_cycle")))
query("ga28_both_ways", with_graph(", b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r(id, depth) AS (SELECT 'nation:5', 0 UNION SELECT y, depth + 1 FROM r JOIN b ON x = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id", "e", recursive=True))(lambda g: reach.reach(g.edges, g.seed("nation:5"), "both", 2))
query("al6_cluster_members", with_graph(_WCC + ", c AS (SELECT v.id, least(v.id, coalesce(min(r.b), v.id)) AS component FROM v LEFT JOIN r ON r.a = v.id GROUP BY v.id) SELECT component, string_agg(id, ',' ORDER BY id) AS members FROM c GROUP BY component", "f", recursive=True))(lambda g: lenses.members(analytics.weak_components(g.flow_nodes, g.flow)))
query("al26_containing_component", with_graph(_SCC + " SELECT id FROM s WHERE component = (SELECT component FROM s WHERE id = '1:click')", "f", recursive=True))(lambda g: lenses.containing(analytics.strong_components(g.flow_nodes, g.flow), "1:click"))
query("se5_camel_tokens", with_graph("SELECT id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens FROM n", "n"))(
    lambda g: g.nodes.select("id", F.array_join(lenses.camel_tokens(F.col("name")), " ").alias("tokens"))
)
query("se8_ranked_symbols", with_graph(", x AS (SELECT id, fan_in, length(name) AS k, instr(lower(name), 'ring') AS p FROM d WHERE instr(lower(name), 'ring') > 1) SELECT id, round(least(1.0, 0.4 * fan_in / greatest((SELECT max(fan_in) FROM d), 1) + 0.6 * (0.7 + 0.2 * (1 - (p - 1) / CAST(k AS DOUBLE)))), 9) AS score FROM x", "d"))(
    lambda g: lenses.ranked_symbols(g.degrees, search.similarity_matches(g.nodes, "ring").where("match = 2")).withColumn("score", rounded("score", 9))
)
query("st3_warmup", "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM k WHERE k > 1), m AS (SELECT event_type, max(CASE WHEN r = floor(0.5 * (n - 1)) THEN value END) AS warm FROM w GROUP BY 1) SELECT event_type, value AS first, warm, round(value / warm, 9) AS penalty, value / warm > 3 AS cold FROM k JOIN m USING (event_type) WHERE k = 1")(
    lambda g: stats.warmup(g.events, "event_type", "event_id", "value").withColumn("penalty", rounded("penalty", 9))
)
query("st6_robustness", "SELECT event_type, round(100.0 * (1 - count(*) FILTER (value > 90) / CAST(count(*) AS DOUBLE)), 9) AS score FROM events GROUP BY 1")(
    lambda g: g.events.groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("bad"), F.count(F.lit(1)).alias("n")).select("event_type", rounded(stats.robustness(F.col("bad"), F.col("n")), 9).alias("score"))
)
query("st8_weighted_health", "WITH x AS (SELECT user_id, avg(value) AS a, max(value) AS b, stddev_samp(value) AS c FROM events GROUP BY 1) SELECT user_id, round((0.35 * a + 0.2 * b + coalesce(0.15 * c, 0)) / (0.55 + CASE WHEN c IS NULL THEN 0 ELSE 0.15 END), 6) AS health FROM x")(
    lambda g: g.events.groupBy("user_id").agg(F.avg("value").alias("a"), F.max("value").alias("b"), F.stddev_samp("value").alias("c")).select("user_id", rounded(stats.weighted([F.col("a"), F.col("b"), F.col("c")], [0.35, 0.2, 0.15]), 6).alias("health"))
)
query("fed5_parity", with_graph("SELECT count(*) AS only_left, CAST(0 AS BIGINT) AS only_right FROM e WHERE provenance = 'ambiguous'", "e"))(lambda g: lenses.parity(g.edges.select("src", "dst"), g.edges.where("provenance != 'ambiguous'").select("src", "dst")))
