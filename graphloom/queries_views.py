"""Registered queries of views, tiers, merged searches, scaling classes and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.graphs import with_graph
from graphloom.model import rounded
from graphloom.operators import access, aggregate, analytics, lenses, reach, search, views
from graphloom.queries import _SCC, query

_WALK = ", r(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {to}, depth + 1 FROM r JOIN {e} ON {of} = r.id WHERE depth < {most}) "

query("ql11_apply_lens", with_graph("SELECT id, CASE WHEN fan_out >= 20 THEN 'critical' WHEN fan_out > 10 THEN 'warning' END AS summary, CAST(NULL AS VARCHAR) AS unknown FROM d WHERE kind = 'function'", "d"))(
    lambda g: views.apply_lens(
        views.apply_lens(g.degrees.where("kind = 'function'").select("id"), lenses.dependency_findings(g.degrees).select("id", F.col("band").alias("summary"))), None, summary="unknown"
    )
)
query("ga24_type_references", with_graph("SELECT src, dst, provenance FROM e WHERE dep_type = 'contains' AND dst = 'supplier:5'", "e"))(
    lambda g: access.by_kind(g.edges, ["contains"]).where("dst = 'supplier:5'").select("src", "dst", "provenance")
)
query("ga29_path_files", with_graph(", f AS (SELECT DISTINCT file FROM n WHERE id IN ('nation:1', 'supplier:5')), k AS (SELECT id FROM n WHERE file IN (SELECT file FROM f)) SELECT src, dst, dep_type FROM e WHERE src IN (SELECT id FROM k) OR dst IN (SELECT id FROM k)", "n", "e"))(
    lambda g: views.edges_in_files(g.nodes, g.edges, "nation:1", "supplier:5").select("src", "dst", "dep_type")
)
query(
    "ga35_deep_dive",
    with_graph(
        _WALK.format(seed="supplier:4", to="src", of="dst", e="e", most=2) + ", s(id, depth) AS (SELECT 'supplier:4', 0 UNION SELECT dst, depth + 1 FROM s JOIN e ON src = s.id WHERE depth < 2) SELECT 'caller' AS way, id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id UNION ALL SELECT 'callee', id, min(depth) FROM s WHERE depth > 0 GROUP BY id",
        "e",
        recursive=True,
    ),
)(lambda g: views.deep_dive(g.edges, g.seed("supplier:4"), 2))
query("lv15_change_story", with_graph(_WALK.format(seed="part:9", to="src", of="dst", e="e", most=12) + ", b AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT kind, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM b JOIN n USING (id) WHERE depth > 0 GROUP BY kind", "n", "e", recursive=True))(
    lambda g: views.change_story(g.nodes, g.edges, g.seed("part:9"))
)
query("lv16_scope_owner", with_graph("SELECT id, 'team-' || CASE WHEN file LIKE 'ASIA/CHINA/%' THEN 'china' ELSE 'asia' END AS owner FROM n WHERE file LIKE 'ASIA/%' AND file NOT LIKE '%/mod.rs' AND file <> 'ASIA/mod.rs' ORDER BY file, line, id LIMIT 1", "n"))(
    lambda g: views.scope_owner(
        g.nodes, aggregate.owners(g.nodes.select("file").distinct().where("NOT endswith(file, '/mod.rs')"), g.spark.createDataFrame([(1, "ASIA", "team-asia"), (2, "ASIA/CHINA", "team-china")], "position int, prefix string, owner string")), "ASIA"
    )
)
_DOC_LINKS = "SELECT DISTINCT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') WHEN 1 THEN 'france' ELSE 'Nothing ' || doc_id END AS target FROM documents"
_links = lambda g: g.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))).when(F.col("doc_id") % 3 == 1, "france").otherwise(F.concat(F.lit("Nothing "), F.col("doc_id").cast("string"))).alias("target"))
query("lv17_alignment", with_graph(f", l AS ({_DOC_LINKS}) SELECT doc_id, target, lower(target) IN (SELECT lower(name) FROM n) AS linked FROM l", "n"))(lambda g: views.alignment(_links(g), g.nodes))
query("lv18_concept_map", with_graph(", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)" + _WALK.format(seed="nation:3", to="dst", of="src", e="b", most=2) + ", m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT id, name, kind, depth FROM m JOIN n USING (id) ORDER BY depth, id LIMIT 40", "n", "e", recursive=True))(
    lambda g: views.concept_map(g.nodes, g.edges, g.seed("nation:3"), 2, 40)
)
query("lv19_rationale", with_graph(", k AS (SELECT * FROM e WHERE dep_type = 'contains')" + _WALK.format(seed="region:2", to="dst", of="src", e="k", most=9) + "SELECT id, min(depth) AS depth FROM r GROUP BY id", "e", recursive=True))(
    lambda g: views.rationale(g.edges, g.seed("region:2"), ["contains"])
)

# --- tiers ---------------------------------------------------------------------------------

_TEXT = "CASE event_id % 6 WHEN 0 THEN 'Fixes #' || user_id WHEN 1 THEN 'see  #' || user_id WHEN 2 THEN 'PART OF #9' WHEN 3 THEN 'closes it' WHEN 4 THEN 'as of 0a1b2c3d' ELSE 'nothing' END"
query("se17_issue_confidence", f"WITH m AS (SELECT event_id, {_TEXT} AS t FROM events) SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0.85::DOUBLE WHEN event_id % 6 IN (1, 2) THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS \"commit\", CASE WHEN regexp_matches(lower(t), '(fixes|closes|resolves)|[0-9a-f]{{7,40}}') THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS body FROM m")(
    lambda g: g.events.select("event_id", F.expr(_TEXT).alias("t")).select("event_id", views.commit_tier(F.col("t")).alias("commit"), views.explicit_tier(F.col("t")).alias("body"))
)
query("se16_link_confidence", "WITH RECURSIVE " + with_graph("", "n").removeprefix("WITH ").rstrip() + ", l AS (SELECT * FROM (VALUES (' `France` '), ('supplier:1'), ('EGYPT'), ('no such'), ('``')) v(link)), k AS (SELECT link, lower(trim(link, ' `')) AS needle FROM l) SELECT link, CASE WHEN needle IN (SELECT lower(name) FROM n) THEN 0.9::DOUBLE WHEN needle <> '' AND EXISTS (SELECT 1 FROM n WHERE contains(lower(id), needle)) THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM k")(
    lambda g: views.link_tiers(g.spark.createDataFrame([(" `France` ",), ("supplier:1",), ("EGYPT",), ("no such",), ("``",)], "link string"), g.nodes)
)
query("se16_heading_confidence", "SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM documents")(
    lambda g: g.documents.select("doc_id", views.heading_tier(F.lit(" License`"), F.coalesce("text", F.lit(""))).alias("confidence"))
)

# --- merged searches -----------------------------------------------------------------------

_SIMILAR = ", q AS (SELECT id, name, kind, lower(name) AS l, instr(lower(name), '{q}') AS p FROM n), s AS (SELECT id, name, kind, CASE WHEN l = '{q}' THEN 1.0::DOUBLE WHEN p = 1 THEN 0.9::DOUBLE WHEN p > 1 THEN 0.7 + 0.2 * (1 - (p - 1)::DOUBLE / length(name)) WHEN regexp_matches(l, '{f}') THEN 0.6 * {n} / length(name)::DOUBLE END AS score FROM q), t AS (SELECT * FROM s WHERE score IS NOT NULL)"
_RING = _SIMILAR.format(q="ring", f="r.*i.*n.*g", n=4)
query("se6_spotter", with_graph(_RING + " SELECT id, name, round(score, 9) AS score FROM (SELECT * FROM t WHERE kind = 'method' ORDER BY score DESC, name, id LIMIT 25)", "n"))(
    lambda g: views.spotter(g.nodes, "ring", "METHOD", 25).withColumn("score", rounded("score", 9))
)
query(
    "se7_smart_search",
    with_graph(
        _RING + ", a AS (SELECT name, max(score) AS score FROM t WHERE kind = 'method' AND score >= 0.8 GROUP BY 1), b AS (SELECT name, max(least(1.0, 0.4 * fan_in / (SELECT greatest(max(fan_in), 1) FROM d) + 0.6 * score)) AS score FROM t JOIN d USING (id, name) GROUP BY 1), u AS (SELECT name, score, 'semantic' AS source FROM a UNION ALL SELECT name, score, 'ranked' FROM b WHERE name NOT IN (SELECT name FROM a)) SELECT name, round(score, 9) AS score, source FROM (SELECT * FROM u ORDER BY score DESC, name LIMIT 50)",
        "n",
        "d",
    ),
)(lambda g: (m := search.similarity_matches(g.nodes, "ring")) and views.first_source([("semantic", m.where("score >= 0.8").join(g.nodes.where("kind = 'method'").select("id"), "id", "left_semi")), ("ranked", lenses.ranked_symbols(g.degrees, m).join(g.nodes.select("id", "name"), "id"))], 50).withColumn("score", rounded("score", 9)))
query("se9_named_by_question", with_graph(_RING + ", c AS (SELECT id, name, least(1.0, 0.7 * score + 0.3 * (contains(lower(name), 'ring')::INT + contains(lower(name), 'small')::INT) / 2) AS confidence FROM t) SELECT id, name, round(confidence, 9) AS confidence FROM (SELECT * FROM c WHERE confidence > 0.1 ORDER BY confidence DESC, name, id LIMIT 30)", "n"))(
    lambda g: views.named_by_question(search.similarity_matches(g.nodes, "ring"), "Where is the small ring?", 30).withColumn("confidence", rounded("confidence", 9))
)
query("se14_usages", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(0, len(l))) AS line FROM l) SELECT doc_id, CAST(line AS INTEGER) AS line, l[line + 1] AS text, CASE WHEN line > 0 THEN l[line] END AS before, l[line + 2] AS after FROM x WHERE regexp_matches(l[line + 1], '\\bthe\\b')")(
    lambda g: views.usages(g.documents, "the")
)

# --- scaling, insights ---------------------------------------------------------------------

_POINTS = "SELECT user_id AS tool, CAST(1 + event_id % 50 AS BIGINT) AS size, CAST(round(CASE user_id % 3 WHEN 0 THEN 100 + value / 1000 WHEN 1 THEN value ELSE event_id % 50 + 3 END) AS BIGINT) AS latency FROM events"
query(
    "st7_scalability",
    f"WITH p AS ({_POINTS}), o AS (SELECT tool, size::DOUBLE AS x, latency::DOUBLE AS y FROM p WHERE size > 0 AND latency > 0), s AS (SELECT *, x / lag(x) OVER w AS dx, y / lag(y) OVER w AS dy FROM o WINDOW w AS (PARTITION BY tool ORDER BY x, y)), f AS (SELECT tool, count(*) AS n, stddev_samp(y) / avg(y) AS cv, coalesce(avg(dy / dx) FILTER (dx > 1), 1) AS g, coalesce(bool_or(dx >= 1.5 AND dy >= dx * dx), false) AS e, "
    "CASE WHEN count(*) < 2 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(x, y) ** 2 END AS l, CASE WHEN count(*) < 2 OR stddev_pop(x) = 0 OR stddev_pop(y) = 0 THEN 0 ELSE corr(ln(x), y) ** 2 END AS k FROM s GROUP BY tool), "
    "c AS (SELECT tool, l, k, CASE WHEN n IS NULL OR n < 2 OR cv < 0.1 THEN 'constant' WHEN e THEN 'exponential' WHEN g < 0.3 OR (g < 1.5 AND k > l) THEN 'sublinear' WHEN g < 1.5 OR (g < 3 AND l > 0.9) THEN 'linear' ELSE 'quadratic' END AS class FROM (SELECT DISTINCT tool FROM p) LEFT JOIN f USING (tool)) "
    "SELECT tool, class, round(CASE class WHEN 'constant' THEN 100 WHEN 'exponential' THEN 20 WHEN 'sublinear' THEN 85 * (0.7 + 0.3 * k) WHEN 'linear' THEN 70 * (0.7 + 0.3 * l) ELSE 40 * (0.7 + 0.3 * l) END::DOUBLE, 6) AS score FROM c",
)(
    lambda g: views.scalability(
        g.events.select(
            F.col("user_id").alias("tool"), (1 + F.col("event_id") % 50).cast("long").alias("size"), F.round(F.when(F.col("user_id") % 3 == 0, 100 + F.col("value") / 1000).when(F.col("user_id") % 3 == 1, F.col("value")).otherwise(F.col("event_id") % 50 + 3)).cast("long").alias("latency")
        ),
        "tool",
    ).select("tool", "class", rounded("score", 6).alias("score"))
)
_INSIGHTS = _SCC + ", cy AS (SELECT component, count(*) AS size FROM s GROUP BY component HAVING count(*) > 1 OR max(CASE WHEN id IN (SELECT src FROM f WHERE src = dst) THEN 1 ELSE 0 END) = 1), a AS (SELECT count(*) AS cycles, CAST(coalesce(sum(size), 0) AS BIGINT) AS in_cycles FROM cy), i AS (SELECT dst AS id, count(DISTINCT src) AS score FROM f GROUP BY dst), g AS (SELECT count(*) AS gods FROM i WHERE score >= (SELECT score FROM i ORDER BY score LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM i))), "
_INSIGHTS += "x AS (SELECT split_part(src, ':', 2) AS ca, split_part(dst, ':', 2) AS cb FROM f), co AS (SELECT ca, avg(CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END) AS c FROM x GROUP BY ca), h AS (SELECT count(*) AS communities, avg(coalesce(co.c, 0)) AS cohesion FROM (SELECT DISTINCT split_part(id, ':', 2) AS c FROM v) k LEFT JOIN co ON co.ca = k.c), r2 AS (SELECT count(*) AS crossing FROM x WHERE ca <> cb)"


def _facts(g):
    c = g.flow_nodes.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("community"))
    found = views.insights(
        analytics.cycles(analytics.strong_components(g.flow_nodes, g.flow), g.flow),
        analytics.god_nodes(access.fan_in(g.flow).select("id", F.col("fan_in").alias("score")), 0.95),
        analytics.cohesion(g.flow, c),
        g.flow.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a != b"),
    )
    return c, found.withColumns({"cohesion": rounded("cohesion", 9), "health": rounded("health", 6)})


_HEALTH = " cycles, in_cycles, gods, communities, round(cohesion, 9) AS cohesion, crossing, round(CAST(greatest(0, 100 - least(5.0 * cycles, 30) - CASE WHEN gods > 3 THEN 10 ELSE 0 END - 20 * (1 - cohesion) - 0.5 * least(crossing, 20)) AS DOUBLE), 6) AS health"
query("ag22_insights", with_graph(_INSIGHTS + f" SELECT {_HEALTH} FROM a, g, h, r2", "f", recursive=True))(lambda g: _facts(g)[1])
_DEAD = ", o AS (SELECT id FROM v WHERE id NOT IN (SELECT dst FROM f)), dd AS (SELECT count(*) AS dead_code FROM v WHERE id NOT IN (SELECT id FROM o) AND id NOT IN (SELECT b FROM r WHERE a IN (SELECT id FROM o))), z AS (SELECT split_part(id, ':', 2) AS c, count(*) AS size FROM v GROUP BY 1), hp AS (SELECT string_agg(id || '=' || score, ',' ORDER BY score DESC, id) AS hot_paths FROM (SELECT * FROM i ORDER BY score DESC, id LIMIT 10))"
query("ag24_dashboard", with_graph(_INSIGHTS + _DEAD + f" SELECT (SELECT count(*) FROM v) AS symbols, (SELECT count(*) FROM f) AS edges, (SELECT count(*) FROM o) AS entry_points, dead_code, (SELECT max(size) FROM z) AS largest, (SELECT min(size) FROM z) AS smallest, hot_paths, {_HEALTH} FROM a, g, h, r2, dd, hp", "f", recursive=True))(
    lambda g: (x := _facts(g))
    and views.dashboard(g.flow_nodes, g.flow, aggregate.dead_code(g.flow_nodes.withColumn("kind", F.lit("function")), g.flow), x[0], x[1], access.fan_in(g.flow).select("id", F.col("fan_in").alias("score")), 10)
)
query("ag27_long_parameter_lists", with_graph("SELECT id, name, file, line + 1 AS line, fan_out AS parameters FROM d WHERE kind = 'function' AND fan_out > 50", "d"))(lambda g: aggregate.long_parameter_lists(g.degrees, 50))
