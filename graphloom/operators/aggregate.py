"""Aggregations over graphs and issues: modules, impact, dead code, quality, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import CALLABLE, PROVENANCE_WEIGHT, TYPES, chosen, in_scope, module_of, severity_weight
from graphloom.operators.access import roots
from graphloom.operators.reach import reach
from graphloom.session import checked_broadcast, cut


def module_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_module, dst_module, n) of edges between different modules."""
    at = nodes.select("id", module_of(F.col("file")).alias("module"))
    both = edges.join(at.toDF("src", "src_module"), "src").join(at.toDF("dst", "dst_module"), "dst")
    return both.where("src_module != dst_module").groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n"))


def module_dependencies(pairs: DataFrame) -> DataFrame:
    """(module, depends_on, depended_by, coupling): sorted lists as text and the number of edges either way."""
    out = pairs.groupBy(F.col("src_module").alias("module")).agg(F.array_join(F.sort_array(F.collect_set("dst_module")), ",").alias("depends_on"), F.sum("n").alias("o"))
    into = pairs.groupBy(F.col("dst_module").alias("module")).agg(F.array_join(F.sort_array(F.collect_set("src_module")), ",").alias("depended_by"), F.sum("n").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.join(into, "module", "full").select("module", F.coalesce("depends_on", F.lit("")).alias("depends_on"), F.coalesce("depended_by", F.lit("")).alias("depended_by"), (zero("o") + zero("i")).alias("coupling"))


def hot_paths(degrees: DataFrame, limit: int) -> DataFrame:
    """Top nodes by fan-in with their fan-out."""
    return degrees.where("fan_in > 0").select("id", "name", "fan_in", "fan_out").orderBy(F.desc("fan_in"), "id").limit(limit)


def complexity_report(degrees: DataFrame) -> DataFrame:
    """One row: nodes, roots, leaves and fan-out bands."""
    out = F.col("fan_out")
    return degrees.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.sum("fan_out").alias("edges"),
        F.greatest(F.lit(0), F.sum("fan_out") - F.count(F.lit(1)) + 2).alias("complexity"),
        F.count_if(F.col("fan_in") == 0).alias("roots"),
        F.count_if(out == 0).alias("leaves"),
        F.count_if(out >= 10).alias("high"),
        F.count_if(out.between(5, 9)).alias("medium"),
        F.count_if(out < 5).alias("low"),
    )


def impact_level(direct: Column, transitive: Column, kind: Column) -> Column:
    """Minimal, low, medium, high or critical; transitive dependents count twice for types."""
    t = F.when(kind.isin(list(TYPES)), transitive * 2).otherwise(transitive)
    return (
        F.when((direct == 0) & (t == 0), "minimal").when((direct <= 2) & (t <= 5), "low").when((direct <= 5) & (t <= 15), "medium").when((direct <= 10) & (t <= 30), "high").otherwise("critical")
    )


def impact(nodes: DataFrame, edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, direct, transitive, files, level) for every node; ``closure`` is (a, b) of ``pair_reach``."""
    direct = edges.where("src != dst").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("direct"))
    far = closure.where("a != b").join(nodes.select(F.col("id").alias("a"), "file"), "a").groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("transitive"), F.countDistinct("file").alias("files"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("direct", "transitive", "files")}
    both = nodes.select("id", "kind").join(direct, "id", "left").join(far, "id", "left").withColumns(zero)
    return both.select("id", "direct", "transitive", "files", impact_level(F.col("direct"), F.col("transitive"), F.col("kind")).alias("level"))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Callable and type nodes that no root reaches: only cycles without an entry are dead."""
    edges = cut(edges.select("src", "dst"), "edges")  # read twice, made once
    live = reach(edges, roots(nodes, edges.select("dst").distinct()).select("id"))
    return nodes.where(F.col("kind").isin([*CALLABLE, *TYPES])).join(live.select("id"), "id", "left_anti")


def long_parameter_lists(degrees: DataFrame, most: int) -> DataFrame:
    """(id, name, file, line, parameters) of functions that take more than ``most`` things from elsewhere, counted as what they call."""
    found = degrees.where("kind = 'function'").where(F.col("fan_out") > most)
    return found.select("id", "name", "file", (F.col("line") + 1).alias("line"), F.col("fan_out").alias("parameters"))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return roots(nodes, edges).where(F.col("kind").isin([*CALLABLE, *TYPES]))


def severity_counts(issues: DataFrame, by: str) -> DataFrame:
    """Issues of each severity per value of a column."""
    kinds = ("blocker", "critical", "major", "minor", "info")
    return issues.groupBy(by).agg(*[F.count_if(F.lower("severity") == k).alias(k) for k in kinds])


def rule_summary(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, description, open): description falls back on the rule's id."""
    n = issues.groupBy("rule_id").agg(F.count_if(F.col("status") == "open").alias("open"))
    return n.join(rules, "rule_id", "left").select("rule_id", F.coalesce("description", "rule_id").alias("description"), "open")


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The newest baseline of each workspace."""
    rest = [c for c in baselines.columns if c != "workspace_id"]
    return baselines.groupBy("workspace_id").agg(F.max_by(F.struct(*rest), F.struct("snapshot_at", *[c for c in rest if c != "snapshot_at"])).alias("x")).select("workspace_id", "x.*")


def issues_in_scope(issues: DataFrame, scope: str | None, severity: str | None = None, status: str | None = None) -> DataFrame:
    out = issues if not scope else issues.where(in_scope(F.col("file_path"), scope))
    out = out if severity is None else out.where(F.lower("severity") == severity.lower())
    return out if status is None else out.where(F.col("status") == status)


def edge_score(edges: DataFrame) -> Column:
    """Corroboration weight of an edge: provenance weight times confidence, 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), chosen(F.col("provenance"), PROVENANCE_WEIGHT, 0.0) * F.col("confidence")))


def target_scores(edges: DataFrame) -> DataFrame:
    """(id, score): best score of each provenance, summed up, at most 1."""
    best = edges.groupBy("dst", "provenance").agg(F.max(edge_score(edges)).alias("s"))
    return best.groupBy(F.col("dst").alias("id")).agg(F.least(F.lit(1.0), F.sum("s")).alias("score"))


def health(dead_share: Column, nodes: Column) -> Column:
    """100, less up to 30 for dead code and 5 for more than 1000 nodes."""
    return 100 - F.least(50 * dead_share, F.lit(30.0)) - F.when(nodes > 1000, 5.0).otherwise(0.0)


def god_functions(degrees: DataFrame, least_in: int, least_out: int) -> DataFrame:
    """Nodes over both thresholds; score = 25 for each ratio to its threshold, at most 100."""
    score = F.least(F.lit(100.0), 25.0 * F.col("fan_in") / least_in + 25.0 * F.col("fan_out") / least_out)
    return degrees.where((F.col("fan_in") >= least_in) | (F.col("fan_out") >= least_out)).select("id", "fan_in", "fan_out", score.alias("score"))


def graph_diff(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], by: list[str]) -> DataFrame:
    """(what, op, id, dst, dep_type) of two (nodes, edges): nodes added, removed or modified in a column of ``by``, edges added or removed."""
    none = F.lit(None).cast("string")
    a, b = old[0].select("id", F.struct(*by).alias("a")), new[0].select("id", F.struct(*by).alias("b"))
    op = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    nodes = a.join(b, "id", "full").select(F.lit("node").alias("what"), op.alias("op"), "id", none.alias("dst"), none.alias("dep_type")).where("op IS NOT NULL")
    return nodes.union(edge_diff(old[1], new[1]).select(F.lit("edge"), "op", "src", "dst", "dep_type"))


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, src, dst, dep_type) of edges added and removed."""
    key = ["src", "dst", "dep_type"]
    added = new.select(key).subtract(old.select(key)).select(F.lit("added").alias("op"), *key)
    return added.union(old.select(key).subtract(new.select(key)).select(F.lit("removed").alias("op"), *key))


def hot_ratio(counts: DataFrame) -> DataFrame:
    """(id, n, ratio): accesses against the most accessed."""
    most = counts.agg(F.max("n")).first()[0]
    return counts.select("id", "n", (F.col("n") / F.lit(most)).alias("ratio"))


def review(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(file, dependents) of files with direct dependents of symbols in changed files, without those files themselves."""
    touched = nodes.join(changed, "file", "left_semi").select(F.col("id").alias("dst"))
    users = edges.join(touched, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.join(users, "id", "left_semi").join(changed, "file", "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("dependents"))


def seam_map(pairs: DataFrame) -> DataFrame:
    """(a, b, n) of unordered module pairs."""
    return pairs.groupBy(F.least("src_module", "dst_module").alias("a"), F.greatest("src_module", "dst_module").alias("b")).agg(F.sum("n").alias("n"))


def symbol_risk(degrees: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, fan_in, weight, risk, band): 0.4 * fan_in + 0.6 * severity weights at the symbol's line."""
    at = issues.groupBy("file_path", "line").agg(F.sum(severity_weight(F.col("severity"))).alias("weight"))
    both = degrees.join(at, (F.col("file") == F.col("file_path")) & (degrees["line"] == at["line"]), "left")
    risk = 0.4 * F.col("fan_in") + 0.6 * F.coalesce("weight", F.lit(0.0))
    band = F.when(risk >= 8, "critical").when(risk >= 4, "warning").otherwise("info")
    return both.where((F.col("fan_in") >= 2) | F.col("weight").isNotNull()).select("id", "fan_in", F.coalesce("weight", F.lit(0.0)).alias("weight"), risk.alias("risk"), band.alias("band"))


def file_risk(degrees: DataFrame, issues: DataFrame) -> DataFrame:
    """(file, risk, band): sum of fan-in parts and of 0.6 * the file's issue weights."""
    fan = degrees.groupBy("file").agg((0.4 * F.sum("fan_in")).alias("fan"))
    weight = issues.groupBy(F.col("file_path").alias("file")).agg((0.6 * F.sum(severity_weight(F.col("severity")))).alias("weight"))
    risk = F.coalesce("fan", F.lit(0.0)) + F.coalesce("weight", F.lit(0.0))
    return fan.join(weight, "file", "full").select("file", risk.alias("risk"), F.when(risk >= 15, "critical").when(risk >= 8, "warning").otherwise("info").alias("band"))


def scope_risk(risks: DataFrame, issues: DataFrame) -> DataFrame:
    """(scope, risk, band) of every folder: the risks of the files at any depth below it, and 0.6 * the weights of their issues once more.

    ``risks`` are those of ``file_risk``; warning from 15, critical from 30.
    """
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    weight = issues.groupBy(F.col("file_path").alias("file")).agg((0.6 * F.sum(severity_weight(F.col("severity")))).alias("own"))
    both = risks.select("file", "risk").join(weight, "file", "full").where(F.contains("file", F.lit("/")))
    risk = F.sum(F.coalesce("risk", F.lit(0.0)) + F.coalesce("own", F.lit(0.0)))
    found = both.select("risk", "own", F.explode(above).alias("scope")).groupBy("scope").agg(risk.alias("risk"))
    return found.withColumn("band", F.when(F.col("risk") >= 30, "critical").when(F.col("risk") >= 15, "warning").otherwise("info"))


def relation_candidates(nodes: DataFrame, targets: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, candidate, score): for targets, best of same file 0.7 and same community 0.5 among other nodes."""
    from_file = targets.select("id", "file").join(nodes.select(F.col("id").alias("candidate"), "file"), "file").select("id", "candidate", F.lit(0.7).alias("score"))
    at = targets.select("id").join(communities.toDF("id", "c"), "id")
    near = at.join(communities.toDF("candidate", "c"), "c").select("id", "candidate", F.lit(0.5).alias("score"))
    return from_file.union(near).where("id != candidate").groupBy("id", "candidate").agg(F.max("score").alias("score"))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the greatest order columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, owner): the last rule whose prefix matches; rules are (position, prefix, owner), prefixes a few per file."""
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = files.select("file", F.explode(prefixes).alias("prefix"))
    return each.join(checked_broadcast(rules), "prefix").groupBy("file").agg(F.max_by("owner", "position").alias("owner"))
