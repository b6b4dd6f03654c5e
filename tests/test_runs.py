"""Graphs and runs kept as files, long parameter lists, the dashboard of an empty project."""

from pyspark.sql import functions as F

from graphloom.operators import aggregate, views
from graphloom.sources import runs, store


def test_json_graphs(spark):
    texts = [('{"nodes": [{"id": "a", "kind": "f", "name": "A"}, {"kind": "x"}], "edges": [{"source": "a", "target": "b", "relation": "calls", "confidence": 0.5}, {"source": "a"}]}',), ('{"edges": [{"source": "a", "target": "b", "relation": "calls", "confidence": 0.7}, {"source": "b", "target": "a"}]}',), ("broken {",), (None,), ("{}",)]
    nodes, edges = runs.json_graph(spark.createDataFrame(texts, "text string"))
    assert sorted(map(tuple, nodes.collect())) == [("a", "f", "A"), ("b", None, None)]
    assert sorted(map(tuple, edges.collect()), key=str) == [("a", "b", "calls", 0.7), ("b", "a", "", None)]


def test_migration_is_idempotent(spark):
    n = spark.createDataFrame([("a", "function", 1), ("a", "function", 1), ("b", "class", 2)], "id string, kind string, line int")
    e = spark.createDataFrame([("a", "b", "calls", 2, "later"), ("a", "b", "calls", 1, "first"), ("a", "b", "uses", 5, None)], "src string, dst string, dep_type string, seq int, note string")
    nodes, relations = runs.generic(n, e, F.col("seq"))
    assert sorted(map(tuple, nodes.collect())) == [("a", "Function", '{"line":1}'), ("b", "Class", '{"line":2}')]
    want = [("a", "b", "CALLS", '{"seq":1,"note":"first"}'), ("a", "b", "USES", '{"seq":5}')]
    assert sorted(map(tuple, relations.collect())) == want
    assert sorted(map(tuple, runs.generic(n.union(n), e.union(e), F.col("seq"))[1].collect())) == want


def test_histories_checkpoints_and_spaces(spark, tmp_path):
    folder, schema = str(tmp_path / "h"), "tool string, at long, score double"
    assert runs.read_runs(spark, folder, schema).collect() == []
    runs.append_runs(spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.1)], schema).coalesce(1), folder)
    runs.append_runs(spark.createDataFrame([("a", 2, 0.4)], schema).coalesce(1), folder)
    (tmp_path / "h" / "odd.json").write_text('no json\n{"tool": "a", "at": "x"}\n')
    read = runs.read_runs(spark, folder, schema)
    assert sorted(map(tuple, read.collect())) == [("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.1)]
    assert sorted(map(tuple, runs.latest_reports(read, ["tool"], "at").collect())) == [("a", 2, 0.4), ("b", 1, 0.1)]

    root, edges = str(tmp_path / "s"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    store.commit(root, "w", edges, "1")
    store.commit(root, "w", edges.limit(1), "2")
    assert runs.restore(spark, root, "w", 1, "back") == runs.restore(spark, root, "w", 1, "back") == 3
    assert sorted(map(tuple, runs.checkpoints(spark, root, "w").collect())) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]

    log = spark.createDataFrame([("a", "A", "register", 1), ("a", "A", "unregister", 2), ("b", "B", "register", 1), ("b", "B2", "register", 3)], "space string, name string, op string, seq int")
    assert list(map(tuple, runs.spaces(log).collect())) == [("b", "B2")]


def test_long_lists_and_an_empty_dashboard(spark):
    d = spark.createDataFrame([("a", "function", "n", "f", 1, 0, 5), ("b", "class", "n", "f", 1, 0, 9), ("c", "function", "n", "f", 1, 9, 4)], "id string, kind string, name string, file string, line long, fan_in long, fan_out long")
    assert [(r.id, r.line, r.parameters) for r in aggregate.long_parameter_lists(d, 4).collect()] == [("a", 2, 5)]
    none = spark.createDataFrame([], "id string, kind string")
    edges, scores = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "id string, score long")
    facts = spark.createDataFrame([(0, 100.0)], "cycles long, health double")
    row = views.dashboard(none, edges, none, none.select("id", F.col("kind").alias("community")), facts, scores, 10).first()
    assert (row.symbols, row.edges, row.entry_points, row.dead_code, row.largest, row.health, row.hot_paths) == (0, 0, 0, 0, None, 100.0, "")


def test_orders_walks_limits_and_keywords(spark):
    import pytest

    from graphloom.operators import reach, search

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "b")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    with pytest.raises(ValueError, match="a is on or behind"):
        reach.topological_order(e, n)
    assert {r.id: r.layer for r in reach.topological_order(e.where("src != 'c'"), n).collect()} == {"a": 0, "d": 1, "b": 2, "c": 3}
    walked = lambda d, way: sorted(r.src + r.dst for r in reach.traversed_edges(e, n.where("id = 'a'"), d, way).collect())
    assert [walked(0, "outgoing"), walked(1, "outgoing"), walked(2, "outgoing"), walked(1, "incoming"), walked(1, "both")] == [[], ["ab", "ad"], ["ab", "ad", "bc", "db"], ["ca"], ["ab", "ad", "ca"]]
    assert [(r.id, r.truncated) for r in search.limited(n, ["id"], 2).orderBy("id").collect()] == [("a", True), ("b", True)]
    assert {r.truncated for r in search.limited(n, ["id"], 4).collect()} == {False} and search.limited(n.limit(0), ["id"], 4).collect() == []
    asked = ["Where does a SMALL pre-built ring_2 connect foo.bar, small and they?", "", None, "x y"]
    got = spark.createDataFrame([(q,) for q in asked], "q string").select(search.keywords_of(F.col("q")).alias("k")).collect()
    assert [r.k for r in got] == [search.keywords(q or "") for q in asked]


def test_written_tables_can_be_discarded(spark):
    from pathlib import Path

    from graphloom import session

    session.cut(spark.range(3), "mine").count()
    path = Path(session._written[-1].removeprefix("file://"))
    assert path.exists() and session.discard(spark) > 0 and not path.exists() and session.discard(spark) == 0
