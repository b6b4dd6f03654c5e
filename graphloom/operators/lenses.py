"""Lenses and views: derived tables around a scope or a symbol, drift, diffs and diagrams as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import test_file
from graphloom.operators import analytics, reach

#: Name parts that mark diagnostics: fixed values.
DEBUG = ("debug", "log", "trace", "error", "warn", "panic", "print")


def dependency_findings(degrees: DataFrame) -> DataFrame:
    """(id, fan_out, band) of symbols with more than 10 targets; 20 and more are critical."""
    return degrees.where("fan_out > 10").select("id", "fan_out", F.when(F.col("fan_out") >= 20, "critical").otherwise("warning").alias("band"))


def scope_dependencies(pairs: DataFrame, scope: str) -> DataFrame:
    """(scope, outgoing, incoming): edge counts between one module and every other it touches; pairs as of module_edges."""
    out = pairs.where(F.col("src_module") == scope).select(F.col("dst_module").alias("scope"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i"))
    into = pairs.where(F.col("dst_module") == scope).select(F.col("src_module").alias("scope"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i"))
    return out.union(into).groupBy("scope").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def god_modules(pairs: DataFrame, more_than: int = 20) -> DataFrame:
    """(module, callers): modules that more than so many other modules call."""
    return pairs.groupBy(F.col("dst_module").alias("module")).agg(F.countDistinct("src_module").alias("callers")).where(F.col("callers") > more_than)


def ranked_hotspots(risks: DataFrame, limit: int) -> DataFrame:
    return risks.orderBy(F.desc("risk"), "file").limit(limit)


def usage_examples(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(role, id, name) of direct callers and callees."""
    callers = edges.where(F.col("dst") == node).select(F.lit("caller").alias("role"), F.col("src").alias("id"))
    callees = edges.where(F.col("src") == node).select(F.lit("callee").alias("role"), F.col("dst").alias("id"))
    return callers.union(callees).distinct().join(nodes.select("id", "name"), "id").select("role", "id", "name")


def debug_slice(nodes: DataFrame, edges: DataFrame, node: str, parts: tuple[str, ...] = DEBUG) -> DataFrame:
    """Of the usage examples those with a diagnostic part in their name."""
    return usage_examples(nodes, edges, node).where(F.lower("name").rlike("|".join(parts)))


def vertical_slice(edges: DataFrame, seed: DataFrame, up: int = 1, down: int = 3) -> DataFrame:
    """(role, id, depth): focus, callers up to ``up`` and callees up to ``down`` steps away."""
    callees = reach.reach(edges, seed, "outgoing", down).select(F.when(F.col("depth") == 0, "focus").otherwise("callee").alias("role"), "id", "depth")
    return callees.union(reach.reach(edges, seed, "incoming", up).where("depth > 0").select(F.lit("caller"), "id", "depth"))


def safe_to_change(impacts: DataFrame, most: int, levels: tuple[str, ...] = ("minimal", "low")) -> DataFrame:
    """Ids whose impact level is allowed and that have at most so many transitive dependents; impacts as of aggregate.impact."""
    return impacts.where(F.col("level").isin(list(levels)) & (F.col("transitive") <= most)).select("id")


def architecture_score(cycles: DataFrame) -> DataFrame:
    """One row (in_cycles, score): 100 less 5 for each symbol in a cycle, 0 at least; cycles as of analytics.cycles."""
    return cycles.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("in_cycles")).select("in_cycles", F.greatest(F.lit(0), 100 - 5 * F.col("in_cycles")).alias("score"))


def confident_score(score: Column, coverage: Column, symbols: Column) -> Column:
    """An architecture score, halved where less than 20 per cent of the files are known (but some), else cut to 0.7 for under 10 symbols."""
    return F.when((coverage < 20) & (coverage > 0), score * 0.5).when(symbols < 10, score * 0.7).otherwise(score.cast("double"))


def complexity_band(cc: Column) -> Column:
    return F.when(cc <= 10, "low").when(cc <= 20, "moderate").when(cc <= 50, "high").otherwise("very high")


def graph_complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, complexity, band): edges - nodes + 2, 1 at least, of every weak component."""
    parts = analytics.weak_components(nodes, edges)
    n = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    e = edges.join(parts.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("e"))
    cc = F.greatest(F.coalesce("e", F.lit(0)) - F.col("n") + 2, F.lit(1))
    return n.join(e, "component", "left").select("component", cc.alias("complexity"), complexity_band(cc).alias("band"))


def drift(expected: DataFrame, inferred: DataFrame) -> DataFrame:
    """(src_module, dst_module, state): matched, missing (expected alone) or unexpected."""
    key = ["src_module", "dst_module"]
    a, b = expected.select(key).distinct().withColumn("a", F.lit(1)), inferred.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").select(*key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("matched").alias("state"))


def symbol_diff(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(id, op): added, removed or modified (a column of ``by`` differs); unchanged symbols have no row."""
    a, b = old.select("id", F.struct(*by).alias("a")), new.select("id", F.struct(*by).alias("b"))
    op = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "id", "full").select("id", op.alias("op")).where("op IS NOT NULL")


def delete_issues(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """Issues without those whose (file_path, rule_id, line) is listed."""
    return issues.join(keys.select("file_path", "rule_id", "line").distinct(), ["file_path", "rule_id", "line"], "left_anti")


def diagram_lines(pairs: DataFrame, src: str = "src", dst: str = "dst", label: str | None = None) -> DataFrame:
    """(line): one flowchart arrow for each pair, with a label column's value on it; sort and join them to draw."""
    arrow = F.lit(" --> ") if label is None else F.concat(F.lit(" -->|"), F.col(label).cast("string"), F.lit("| "))
    return pairs.select(F.concat(F.col(src), arrow, F.col(dst)).alias("line"))


def keyword_query(nodes: DataFrame, edges: DataFrame, words: list[str], depth: int, direction: str = "outgoing") -> DataFrame:
    """(id, depth) around the nodes whose name holds a keyword."""
    seeds = nodes.where(F.lower("name").rlike("|".join(words))) if words else nodes.limit(0)
    return reach.reach(edges, seeds.select("id"), direction, depth)


def members(components: DataFrame) -> DataFrame:
    """(component, members): sorted ids as text."""
    return components.groupBy("component").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("members"))


def containing(components: DataFrame, node: Column | str) -> DataFrame:
    """Ids in the component of one node."""
    own = components.where(F.col("id") == node).select("component")
    return components.join(own, "component", "left_semi").select("id")


def ranked_symbols(degrees: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, score): 0.4 * fan-in against the largest + 0.6 * search score, 1 at most; matches as of similarity_matches."""
    top = degrees.agg(F.max("fan_in").alias("top"))
    both = degrees.join(matches.select("id", F.col("score").alias("s")), "id").join(F.broadcast(top))  # one row
    return both.select("id", F.least(F.lit(1.0), 0.4 * F.col("fan_in") / F.greatest("top", F.lit(1)) + 0.6 * F.col("s")).alias("score"))


def camel_tokens(name: Column) -> Column:
    """Lower-case parts of a name; a run of capitals stays together, its last one begins the next word."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(split), "[^a-z0-9]+"), lambda p: p != "")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (only_left, only_right): rows, repeated ones counted, that one of two results has alone."""
    cols = sorted(left.columns)
    a, b = (df.groupBy(cols).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "l"), (right, "r")))
    key = lambda df, x: df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("k"), x)
    gap = F.coalesce("l", F.lit(0)) - F.coalesce("r", F.lit(0))
    both = key(a, "l").join(key(b, "r"), "k", "full").select(gap.alias("gap"))
    return both.agg(F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("gap"), F.lit(0))), F.lit(0)).alias("only_right"))


def test_slice(nodes: DataFrame, edges: DataFrame, focus: str) -> DataFrame:
    """Callers of a symbol whose own file is a test file: id, name, file, line, by file and line."""
    callers = edges.where(F.col("dst") == focus).select(F.col("src").alias("id")).distinct()
    return nodes.join(callers, "id", "left_semi").where(test_file(F.col("file"))).select("id", "name", "file", "line").orderBy("file", "line", "id")


def scope_cycle(module_edges: DataFrame, scope: str, most: int | None = None) -> DataFrame:
    """(scope, hops): the fewest module steps, up to ``most`` if given, that lead from a scope back to it; no row if none do."""
    edges = module_edges.select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
    ahead = edges.where(F.col("src") == scope).select(F.col("dst").alias("id"))
    back = reach.reach(edges, ahead, "outgoing", None if most is None else most - 1).where(F.col("id") == scope)
    return back.groupBy(F.col("id").alias("scope")).agg((F.min("depth") + 1).cast("long").alias("hops"))


def dead_report(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """(kind, dead, total, percent) of the nodes that nothing reaches, by kind."""
    total = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    gone = dead.groupBy("kind").agg(F.count(F.lit(1)).alias("dead"))
    n = F.coalesce("dead", F.lit(0)).cast("long")
    return total.join(gone, "kind", "left").select("kind", n.alias("dead"), "total", (100.0 * n / F.col("total")).alias("percent"))
