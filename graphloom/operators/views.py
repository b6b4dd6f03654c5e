"""Views and tiers: attached lenses, ownership, rationale, scaling classes, merged searches, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import in_scope
from graphloom.operators import reach, search
from graphloom.operators.access import roots
from graphloom.session import checked_broadcast, cut

#: Confidence tiers of links, headings and issue references: fixed values.
EXACT_LINK, HEADING, FUZZY_LINK, UNRESOLVED = 0.9, 0.7, 0.6, 0.3
EXPLICIT, COMMIT_FIXES, COMMIT_REFS, BODY_MENTION = 0.9, 0.85, 0.7, 0.5


def apply_lens(rows: DataFrame, findings: DataFrame | None, key: str = "id", summary: str = "summary") -> DataFrame:
    """``rows`` with a lens's summary for their key, null where it has none; an unknown lens (None) leaves all null."""
    if findings is None:
        return rows.withColumn(summary, F.lit(None).cast("string"))
    one = findings.groupBy(key).agg(F.min(F.col(summary)).alias(summary))
    return rows.join(one, key, "left")


def scope_owner(nodes: DataFrame, owners: DataFrame, scope: str) -> DataFrame:
    """(id, owner): the first symbol of a scope, by file, line and id, whose file has an owner; owners as of aggregate.owners."""
    owned = nodes.where(in_scope(F.col("file"), scope)).join(owners.where("owner IS NOT NULL"), "file")
    return owned.orderBy("file", "line", "id").limit(1).select("id", "owner")


def alignment(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(doc_id, target, linked): every distinct target that a document names, and whether a symbol has that name (any case)."""
    known = symbols.select(F.lower("name").alias("k")).distinct().withColumn("linked", F.lit(True))
    named = links.select("doc_id", "target", F.lower("target").alias("k")).distinct()
    return named.join(known, "k", "left").select("doc_id", "target", F.coalesce("linked", F.lit(False)).alias("linked"))


def rationale(edges: DataFrame, decision: DataFrame, kinds: list[str], max_depth: int | None = None) -> DataFrame:
    """(id, depth) of what a decision leads to over edges of the given kinds, itself included."""
    return reach.reach(edges.where(F.col("dep_type").isin(kinds)), decision, "outgoing", max_depth)


def concept_map(nodes: DataFrame, edges: DataFrame, focus: DataFrame, max_depth: int, max_nodes: int) -> DataFrame:
    """(id, name, kind, depth) around a focus in both directions, the nearest ``max_nodes`` by depth and id."""
    near = reach.reach(edges, focus, "both", max_depth)
    return nodes.join(near, "id").select("id", "name", "kind", "depth").orderBy("depth", "id").limit(max_nodes)


def deep_dive(edges: DataFrame, node: DataFrame, depth: int) -> DataFrame:
    """(way, id, depth): callers and callees of a symbol up to ``depth`` steps away."""
    up = reach.neighbours(edges, node, depth, "incoming").select(F.lit("caller").alias("way"), "id", "depth")
    return up.union(reach.neighbours(edges, node, depth).select(F.lit("callee"), "id", "depth"))


def edges_in_files(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges that touch a symbol of the file of either end: what a path between two symbols may use."""
    files = nodes.where(F.col("id").isin(source, target)).select("file").distinct()
    inside = nodes.join(F.broadcast(files), "file", "left_semi").select("id")  # two files at most
    touching = edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").select(edges.columns)
    return touching.union(edges.join(inside.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)).distinct()


def change_story(nodes: DataFrame, edges: DataFrame, symbol: DataFrame) -> DataFrame:
    """(kind, direct, transitive): dependents of one symbol by kind, direct ones apart from those behind them."""
    far = reach.reach(edges, symbol, "incoming").where("depth > 0")
    n = lambda c: F.count_if(c)
    return nodes.select("id", "kind").join(far, "id").groupBy("kind").agg(n(F.col("depth") == 1).alias("direct"), n(F.col("depth") > 1).alias("transitive"))


# --- confidence tiers ----------------------------------------------------------------------


def _needle(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^[\s`]+|[\s`]+$", ""))


def link_tiers(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(link, confidence) of the distinct link texts: a symbol's whole name, a part of some id, or neither.

    Both are equality joins, the second on a text's first three characters (fewer if it has fewer)
    against all runs of characters of that length in an id. Few links go to the symbols, which then stay where they are.
    """
    asked = cut(links.select("link").distinct().withColumn("needle", _needle(F.col("link"))), "asked")
    names = symbols.select(F.lower("name").alias("needle")).join(checked_broadcast(asked.select("needle")), "needle", "left_semi")
    names = cut(names.distinct(), "names")
    exact = asked.join(names, "needle", "left_semi").select("link", F.lit(EXACT_LINK).alias("confidence"))
    rest = asked.join(names, "needle", "left_anti")
    low = F.lower("id")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    grams = symbols.select(low.alias("low"), F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
    probe = checked_broadcast(rest.where("needle != ''").withColumn("gram", F.substring("needle", 1, 3)))
    met = cut(grams.join(probe, "gram").where(F.contains("low", F.col("needle"))).select("link").distinct(), "met")
    fuzzy = met.select("link", F.lit(FUZZY_LINK).alias("confidence"))
    none = rest.join(fuzzy.select("link"), "link", "left_anti").select("link", F.lit(UNRESOLVED).alias("confidence"))
    return exact.union(fuzzy).union(none)


def heading_tier(heading: Column, context: Column) -> Column:
    """0.7 where the text around a heading names it too, in any case, else 0.3."""
    needle = _needle(heading)
    return F.when((needle != "") & F.contains(F.lower(context), needle), HEADING).otherwise(UNRESOLVED)


def explicit_tier(body: Column) -> Column:
    """0.9 where an issue's text has a closing word or a commit hash of 7 to 40 hexadecimal digits, else 0.3."""
    return F.when(body.rlike(r"(?i)\b(fixes|closes|resolves)\b|\b[0-9a-f]{7,40}\b"), EXPLICIT).otherwise(UNRESOLVED)


def commit_tier(message: Column) -> Column:
    """0.85 where a message closes an issue, 0.7 where it refers to one, else 0.3."""
    return F.when(message.rlike(r"(?i)\b(fixes|closes|resolves)\s+#[0-9]+"), COMMIT_FIXES).when(message.rlike(r"(?i)\b(refs|references|see|part of)\s+#[0-9]+"), COMMIT_REFS).otherwise(UNRESOLVED)


def mention_tier(line: Column) -> Column:
    """0.5 where a line of an issue's text is shaped like a place in code, file:name or file:name:line, else 0.3.

    A Markdown link's target counts in place of the line, and so does what stands between < and >; web addresses are no places.
    """
    own = F.trim(line)
    linked = F.trim(F.regexp_extract(own, r"\]\((.*?)\)", 1))
    bare = F.when(own.rlike(r"\]\(.*?\)"), linked).when(own.rlike("^<.*>$"), F.substring(own, F.lit(2), F.length(own) - 2)).otherwise(own)
    place = bare.rlike(r"^[^:]+:[^:]+(:[+-]?[0-9]{1,9})?$") & ~bare.rlike("^https?://")
    return F.when(F.coalesce(place, F.lit(False)), BODY_MENTION).otherwise(UNRESOLVED)


# --- merged searches -----------------------------------------------------------------------


def first_source(ranked: list[tuple[str, DataFrame]], limit: int) -> DataFrame:
    """(name, score, source): of several rankings (name, score) the first that has a name gives its score; the best ``limit``."""
    every = None
    for i, (source, rows) in enumerate(ranked):
        part = rows.groupBy("name").agg(F.max("score").cast("double").alias("score")).select("name", F.struct(F.lit(i).alias("i"), "score", F.lit(source).alias("source")).alias("x"))
        every = part if every is None else every.union(part)
    best = every.groupBy("name").agg(F.min_by("x", F.col("x.i")).alias("x"))
    return best.select("name", "x.score", "x.source").orderBy(F.desc("score"), "name").limit(limit)


def spotter(nodes: DataFrame, text: str, kind: str | None, limit: int) -> DataFrame:
    """(id, name, score): exact names first with 1.0, then similar ones; of one kind if given; the best ``limit``."""
    own = nodes if kind is None else nodes.where(F.lower("kind") == kind.lower())
    return search.similarity_matches(own, text).select("id", "name", "score").orderBy(F.desc("score"), "name", "id").limit(limit)


def named_by_question(matches: DataFrame, question: str, limit: int) -> DataFrame:
    """(id, name, confidence): 0.7 * search score + 0.3 * share of the question's keywords in the name, 1 at most, over 0.1."""
    words = search.keywords(question)
    held = sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in words), F.lit(0)) / max(1, len(words))
    confidence = F.least(F.lit(1.0), 0.7 * F.col("score") + 0.3 * held)
    return matches.select("id", "name", confidence.alias("confidence")).where("confidence > 0.1").orderBy(F.desc("confidence"), "name", "id").limit(limit)


def usages(docs: DataFrame, word: str) -> DataFrame:
    """Lines that hold a whole word, with the lines before and after."""
    return search.lines_matching(docs, rf"\b{word}\b")


# --- scaling and insights ------------------------------------------------------------------


def scalability(points: DataFrame, group: str) -> DataFrame:
    """(group, class, fit, score) from (group, size, latency); points without a size or latency over 0 don't count.

    Constant below two points or with a variation under a tenth; exponential if latency once grows
    by the square of a size step of 1.5 or more; else by the mean of the steps' growth ratios and
    the fit of latency to size or to its logarithm.
    """
    ok = points.where("size > 0 AND latency > 0").select(group, F.col("size").cast("double").alias("x"), F.col("latency").cast("double").alias("y"))
    before = Window.partitionBy(group).orderBy("x", "y")
    stepped = ok.withColumn("dx", F.col("x") / F.lag("x").over(before)).withColumn("dy", F.col("y") / F.lag("y").over(before))
    step = F.col("dx") > 1
    spread = lambda x: F.var_pop(x) * F.var_pop("y")
    r2 = lambda x: F.when(spread(x) > 0, F.pow(F.covar_pop(x, F.col("y")), 2) / spread(x)).otherwise(0.0)
    facts = stepped.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        (F.stddev_samp("y") / F.avg("y")).alias("cv"),
        F.coalesce(F.avg(F.when(step, F.col("dy") / F.col("dx"))), F.lit(1.0)).alias("growth"),
        F.coalesce(F.bool_or((F.col("dx") >= 1.5) & (F.col("dy") >= F.col("dx") * F.col("dx"))), F.lit(False)).alias("steep"),
        r2(F.col("x")).alias("linear"),
        r2(F.log("x")).alias("logarithmic"),
    )
    facts = points.select(group).distinct().join(facts, group, "left")
    # limits of the classes and bases of their scores: fixed values
    kind = (
        F.when(F.col("n").isNull() | (F.col("n") < 2) | (F.col("cv") < 0.1), "constant")
        .when(F.col("steep"), "exponential")
        .when((F.col("growth") < 0.3) | ((F.col("growth") < 1.5) & (F.col("logarithmic") > F.col("linear"))), "sublinear")
        .when((F.col("growth") < 1.5) | ((F.col("growth") < 3.0) & (F.col("linear") > 0.9)), "linear")
        .otherwise("quadratic")
    )
    fit = F.when(F.col("class") == "constant", 1.0).when(F.col("class") == "exponential", 0.5).when(F.col("class") == "sublinear", F.col("logarithmic")).otherwise(F.col("linear"))
    base = F.when(F.col("class") == "sublinear", 85.0).when(F.col("class") == "linear", 70.0).otherwise(40.0)
    score = F.when(F.col("class") == "constant", 100.0).when(F.col("class") == "exponential", 20.0).otherwise(base * (0.7 + 0.3 * F.col("fit")))
    return facts.withColumn("class", kind).withColumn("fit", fit).select(group, "class", "fit", score.alias("score"))


def dashboard(nodes: DataFrame, edges: DataFrame, dead: DataFrame, communities: DataFrame, facts: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """One row on a whole project: symbols, edges, entry points, dead code, sizes of communities, ``insights``' facts and the hottest paths.

    ``communities`` are (id, community), ``facts`` the row of ``insights``, ``scores`` (id, score); hot_paths lists the ``top`` ids by score
    as id=score. An empty project has zeros, and null sizes.
    """
    n = F.count(F.lit(1))
    sizes = communities.groupBy(communities.columns[1]).agg(n.alias("size"))
    hot = scores.orderBy(F.desc("score"), "id").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))), lambda x: F.concat_ws("=", x["id"], x["score"])), ",").alias("hot_paths"))
    one = nodes.agg(n.alias("symbols"))
    for part in (edges.agg(n.alias("edges")), roots(nodes, edges).agg(n.alias("entry_points")), dead.agg(n.alias("dead_code")), sizes.agg(F.max("size").alias("largest"), F.min("size").alias("smallest")), facts, hot):
        one = one.join(F.broadcast(part))  # one row each
    return one


def insights(cycles: DataFrame, gods: DataFrame, cohesion: DataFrame, crossing: DataFrame) -> DataFrame:
    """One row (cycles, in_cycles, gods, communities, cohesion, crossing, health) of analytics' tables.

    Health is 100 less 5 a cycle (30 at most), 10 for more than three god nodes, 20 times what the
    mean cohesion lacks to 1 and 0.5 an edge between communities (20 such edges at most), 0 at least.
    """
    n = F.count(F.lit(1))
    one = cycles.agg(n.alias("cycles"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("in_cycles"))
    for part in (gods.agg(n.alias("gods")), cohesion.agg(n.alias("communities"), F.avg("cohesion").alias("cohesion")), crossing.agg(n.alias("crossing"))):
        one = one.join(F.broadcast(part))  # one row each
    # deductions: fixed values
    less = F.least(5.0 * F.col("cycles"), F.lit(30.0)) + F.when(F.col("gods") > 3, 10.0).otherwise(0.0) + F.coalesce(20.0 * (1 - F.col("cohesion")), F.lit(0.0)) + 0.5 * F.least(F.col("crossing"), F.lit(20))
    return one.withColumn("health", F.greatest(F.lit(0.0), 100.0 - less))
