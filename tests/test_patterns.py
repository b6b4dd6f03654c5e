"""Long paths without caps, path patterns, predicates, test slices, manifests."""

import pytest

from graphloom.operators import lenses, patterns, predicates, reach
from graphloom.sources import manifest


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(f"n{i}", f"n{i + 1}", "calls", 0.9) for i in range(40)]
    return spark.createDataFrame(rows, "src string, dst string, dep_type string, confidence double")


def test_paths_of_forty_hops(spark, chain):
    seed = spark.createDataFrame([("n0",)], "id string")
    assert max(r.hops for r in reach.shortest_paths(chain, seed).collect()) == 40
    assert reach.neighbours(chain, seed, 40).count() == 40
    assert reach.cheapest_paths(chain, seed).count() == 41
    assert reach.shortest_paths(chain, seed, 3).count() == 4


def test_repetition_marks():
    assert [patterns.hops(m) for m in ("", "?", "+", "*3", "*2..5")] == [(1, 1), (0, 1), (1, 8), (3, 3), (2, 5)]
    for bad in ("*", "*2..", "*..3", "*5..2", "x"):
        with pytest.raises(ValueError):
            patterns.hops(bad)


def test_patterns_in_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "uses"), ("c", "a", "calls"), ("b", "b", "calls")], "src string, dst string, dep_type string")
    start = spark.createDataFrame([("a",), ("a",)], "id string")
    shown = lambda *steps: sorted(r.path for r in patterns.match(edges, start, list(steps)).collect())
    assert shown(patterns.Step(hops=(0, 8))) == [["a"], ["a", "b"], ["a", "b", "c"]]
    assert shown(patterns.Step("<-"), patterns.Step("<-", ("uses",))) == [["a", "c", "b"]]
    assert shown(patterns.Step("<->")) == [["a", "b"], ["a", "c"]]
    paths = patterns.match(edges, start, [patterns.Step(hops=(2, 2))])
    assert sorted(map(tuple, patterns.as_edges(paths).collect())) == [("a", "b"), ("b", "c")]
    assert sorted(r.id for r in patterns.as_nodes(paths).collect()) == ["a", "b", "c"]


def test_predicates_on_nulls_and_strange_fields(spark):
    rows = spark.createDataFrame([(1, "Ring", None), (2, None, 5), (3, "bring", 5)], "id int, name string, line int")
    found = lambda *c: sorted(r.id for r in predicates.find(rows, "symbol", list(c)).collect())
    assert found(("name", "~", "RING")) == [1, 3]
    assert found(("name", "=", "ring")) == [1]
    assert found(("name", "!=", "ring")) == [3]
    assert found(("line", "=", 5.0)) == [2, 3]
    assert found(("line", ">", "4")) == found(("name", "<", 4)) == found(("nothing", "=", 1)) == found(("fan_in", ">", 0)) == found(("line", "~", 5)) == []
    assert found() == [1, 2, 3]


def test_callers_in_test_files(spark):
    nodes = spark.createDataFrame([("f", "f", "src/a.rs", 1), ("t", "t", "src/tests/b.rs", 9), ("u", "u", "src/tests/a.rs", 2), ("g", "g", "src/g.rs", 3)], "id string, name string, file string, line int")
    edges = spark.createDataFrame([("t", "f"), ("u", "f"), ("g", "f"), ("f", "t")], "src string, dst string")
    assert [r.id for r in lenses.test_slice(nodes, edges, "f").collect()] == ["u", "t"]


def test_scope_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src_module string, dst_module string")
    assert [tuple(r) for r in lenses.scope_cycle(edges, "a").collect()] == [("a", 3)]
    assert lenses.scope_cycle(edges, "d").collect() == []
    assert lenses.scope_cycle(edges, "a", 2).collect() == []


def test_manifests_with_null_hashes(spark):
    of = lambda rows: spark.createDataFrame(rows, "file_path string, size int, mtime int, content_hash string")
    old = of([("a", 1, 1, None), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 1, "x"), ("e", 2, 2, None)])
    new = of([("a", 1, 1, None), ("b", 2, 1, "x"), ("c", 2, 1, "y"), ("e", 2, 3, "z"), ("f", 1, 1, None)])
    want = {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "deleted", "e": "changed", "f": "new"}
    assert {r.file_path: r.change for r in manifest.delta(old, new).collect()} == want
    assert {r.file_path: r.change for r in manifest.changes(old, new).collect()} == want
    after = manifest.upserted(old, new.where("file_path = 'c'"), new.where("file_path = 'a'").select("file_path"))
    assert {r.file_path: r.size for r in after.collect()} == {"b": 1, "c": 2, "d": 1, "e": 2}
