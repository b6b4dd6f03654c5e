"""Lenses, diffs and scoring on small graphs with exact expectations."""

from pyspark.sql import functions as F

from graphloom.operators import analytics, lenses, stats
from tests.test_operators import ABCD, edges, ids, pairs_of


def test_scopes_and_slices(spark):
    pairs = spark.createDataFrame([("a", "b", 2), ("c", "b", 1), ("b", "a", 5)], "src_module string, dst_module string, n long")
    assert pairs_of(lenses.scope_dependencies(pairs, "a"), "scope", "outgoing", "incoming") == [("b", 2, 5)]
    assert pairs_of(lenses.god_modules(pairs, 1), "module", "callers") == [("b", 2)]
    assert pairs_of(lenses.diagram_lines(pairs, "src_module", "dst_module", "n").where("line LIKE 'c%'"), "line") == [("c -->|1| b",)]
    e, n = edges(spark, ABCD), ids(spark, "ABCD")
    assert pairs_of(lenses.usage_examples(n, e, "B"), "role", "id") == [("callee", "C"), ("caller", "A")]
    assert pairs_of(lenses.vertical_slice(e, n.where("id = 'B'").select("id")), "role", "id", "depth") == [("callee", "C", 1), ("callee", "D", 2), ("caller", "A", 1), ("focus", "B", 0)]
    assert pairs_of(lenses.keyword_query(n, e, [], 2), "id") == []


def test_diffs(spark):
    old, new = ids(spark, "AB"), ids(spark, "BC").withColumn("kind", F.when(F.col("id") == "B", "struct").otherwise(F.col("kind")))
    assert pairs_of(lenses.symbol_diff(old, new, ["kind", "file"]), "id", "op") == [("A", "removed"), ("B", "modified"), ("C", "added")]
    assert lenses.symbol_diff(old, old, ["kind"]).count() == 0
    one = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    two = spark.createDataFrame([(1, None), (3, "x")], "k int, v string")
    assert tuple(lenses.parity(one, two).first()) == (2, 1)
    assert tuple(lenses.parity(one, one).first()) == (0, 0)
    assert tuple(lenses.parity(one.limit(0), one.limit(0)).first()) == (0, 0)


def test_scores(spark):
    e, n = edges(spark, [("A", "B"), ("B", "A"), ("B", "C")]), ids(spark, "ABC")
    cycles = analytics.cycles(analytics.strong_components(n, e), e)
    assert tuple(lenses.architecture_score(cycles).first()) == (2, 90)
    assert tuple(lenses.architecture_score(cycles.limit(0)).first()) == (0, 100)
    assert pairs_of(lenses.graph_complexity(n, e), "component", "complexity", "band") == [("A", 2, "low")]
    names = spark.createDataFrame([("HTTPServerName2Go",), ("snake_case",), ("",)], "name string")
    assert [r[0] for r in names.select(lenses.camel_tokens(F.col("name"))).collect()] == [["http", "server", "name2", "go"], ["snake", "case"], []]
    runs = spark.createDataFrame([("g", i, v) for i, v in enumerate([40.0, 10.0, 10.0, 20.0])] + [("h", 0, 1.0)], "g string, i int, v double")
    assert pairs_of(stats.warmup(runs, "g", "i", "v"), "g", "first", "warm", "penalty", "cold") == [("g", 40.0, 10.0, 4.0, True)]
    row = spark.createDataFrame([(80.0, None), (None, None)], "a double, b double").select(stats.weighted([F.col("a"), F.col("b")], [0.35, 0.2]).alias("w")).collect()
    assert [r.w for r in row] == [80.0, None]
