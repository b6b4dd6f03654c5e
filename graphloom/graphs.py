"""Graphs over the driver's tables, in Spark and as SQL with the same rows.

nodes: id, kind, name, file, line. edges: src, dst, dep_type, provenance, confidence (one row per
key src, dst, dep_type). issues: id, rule_id, severity, category, file_path, line, status.
flow: each user's event types in time order, an edge for each consecutive pair; a cyclic graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import dealt, table


def _place(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "n_name", "r_name", F.concat_ws("/", "r_name", "n_name").alias("place"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.broadcast(_place(spark, sf_dir))
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    row = lambda df, i, kind, n, file, line: df.select(i.alias("id"), F.lit(kind).alias("kind"), F.col(n).alias("name"), file.alias("file"), F.col(line).cast("long").alias("line"))
    region = row(table(spark, sf_dir, "region"), name("region", "r_regionkey"), "module", "r_name", F.concat("r_name", F.lit("/mod.rs")), "r_regionkey")
    nation = row(place, name("nation", "n_nationkey"), "class", "n_name", F.concat("place", F.lit("/mod.rs")), "n_nationkey")
    customer = row(table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")), name("customer", "c_custkey"), "function", "c_name", F.concat("place", F.lit("/customers.rs")), "c_custkey")
    supplier = row(table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")), name("supplier", "s_suppkey"), "function", "s_name", F.concat("place", F.lit("/suppliers.rs")), "s_suppkey")
    part = row(table(spark, sf_dir, "part"), name("part", "p_partkey"), "method", "p_name", F.concat("p_brand", F.lit("/tests/parts.rs")), "p_partkey")
    return region.union(nation).union(customer).union(supplier).union(part)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> part edges of all line items; the best confidence and provenance of each pair."""
    # the least flag as a number in the order of flags: numbers are aggregated in a hash table, strings would have to be sorted
    flag = F.col("l_returnflag")
    place = F.min(F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3).when(flag > "N", 4))
    provenance = F.when(place == 1, "extracted").when(place == 3, "inferred").otherwise("ambiguous")
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_discount"), "l_suppkey", "l_partkey")
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(provenance.alias("provenance"), F.max(1 - F.col("l_discount")).alias("confidence"))
    return pairs.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("dep_type"), "provenance", "confidence")


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit("contains").alias("dep_type"), F.lit("manual").alias("provenance"), F.lit(1.0).alias("confidence"))
    nation = edge(table(spark, sf_dir, "nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"))
    customer = edge(table(spark, sf_dir, "customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"))
    supplier = edge(table(spark, sf_dir, "supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"))
    return nation.union(customer).union(supplier)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contains(spark, sf_dir).union(calls(spark, sf_dir))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items as quality issues of the supplier's file."""
    d = F.col("l_discount")
    severity = F.when(d >= 0.09, "blocker").when(d >= 0.07, "critical").when(d >= 0.05, "major").when(d >= 0.02, "minor").otherwise("info")
    place = F.broadcast(_place(spark, sf_dir))
    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("place", F.lit("/suppliers.rs")).alias("file_path"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("R"), F.col("l_linenumber").cast("string")).alias("rule_id"),
        severity.alias("severity"),
        F.col("l_linestatus").alias("category"),
        "file_path",
        F.col("l_suppkey").alias("line"),
        F.when(F.col("l_quantity") > 25, "open").otherwise("closed").alias("status"),
    )


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst) between consecutive event types of each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: F.concat_ws(":", F.col("user_id").cast("string"), F.col(c))
    seq = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(order).alias("next")).where("next IS NOT NULL")
    return seq.select(name("event_type").alias("src"), name("next").alias("dst")).distinct()


#: The same as SQL; ``with_graph`` puts those that a query names in front of it.
_SQL = {
    "place": "SELECT n_nationkey, n_regionkey, n_name, r_name, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey",
    "n": """SELECT 'region:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name || '/mod.rs' AS file, CAST(r_regionkey AS BIGINT) AS line FROM region
      UNION ALL SELECT 'nation:' || n_nationkey, 'class', n_name, place || '/mod.rs', n_nationkey FROM place
      UNION ALL SELECT 'customer:' || c_custkey, 'function', c_name, place || '/customers.rs', c_custkey FROM customer JOIN place ON c_nationkey = n_nationkey
      UNION ALL SELECT 'supplier:' || s_suppkey, 'function', s_name, place || '/suppliers.rs', s_suppkey FROM supplier JOIN place ON s_nationkey = n_nationkey
      UNION ALL SELECT 'part:' || p_partkey, 'method', p_name, p_brand || '/tests/parts.rs', p_partkey FROM part""",
    "e": """SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS dep_type, 'manual' AS provenance, CAST(1.0 AS DOUBLE) AS confidence FROM nation
      UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'manual', 1.0 FROM customer
      UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'manual', 1.0 FROM supplier
      UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'calls', CASE WHEN min(l_returnflag) = 'A' THEN 'extracted' WHEN min(l_returnflag) = 'N' THEN 'inferred' ELSE 'ambiguous' END, max(1 - l_discount) FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "i": """SELECT l_orderkey * 10 + l_linenumber AS id, 'R' || l_linenumber AS rule_id,
      CASE WHEN l_discount >= 0.09 THEN 'blocker' WHEN l_discount >= 0.07 THEN 'critical' WHEN l_discount >= 0.05 THEN 'major' WHEN l_discount >= 0.02 THEN 'minor' ELSE 'info' END AS severity,
      l_linestatus AS category, place || '/suppliers.rs' AS file_path, l_suppkey AS line, CASE WHEN l_quantity > 25 THEN 'open' ELSE 'closed' END AS status
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey WHERE l_returnflag = 'R'""",
    "f": """SELECT DISTINCT user_id || ':' || event_type AS src, user_id || ':' || next AS dst FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL""",
    "d": """SELECT n.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM n LEFT JOIN (SELECT dst, count(DISTINCT src) AS fan_in FROM e GROUP BY dst) ON dst = n.id
      LEFT JOIN (SELECT src, count(*) AS fan_out FROM (SELECT DISTINCT src, dst, dep_type FROM e) GROUP BY src) ON src = n.id""",
}
_NEEDS = {"n": ["place"], "i": ["place"], "d": ["place", "n", "e"]}


def with_graph(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` behind the definitions of the named tables; it may begin with further ones, as ', x AS (...) SELECT'."""
    order: list[str] = []
    for name in names:
        order += [x for x in [*_NEEDS.get(name, []), name] if x not in order]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{x} AS ({_SQL[x]})" for x in order) + " " + sql
