from graphloom.operators import views

NODES = "id string, kind string, name string, file string, line long"


def test_scaling_classes(spark):
    series = {
        "one": [(1, 5)],
        "flat": [(1, 100), (10, 101), (100, 102)],
        "straight": [(10, 20), (20, 40), (40, 80)],
        "steep": [(10, 10), (20, 40), (40, 160)],
        "slow": [(10, 10), (100, 20), (1000, 30)],
        "nothing": [(0, 5), (5, 0)],
        "repeated": [(5, 10), (5, 30)],
    }
    points = spark.createDataFrame([(k, x, y) for k, v in series.items() for x, y in v], "tool string, size long, latency long")
    found = {r["tool"]: r for r in views.scalability(points, "tool").collect()}
    assert {k: r["class"] for k, r in found.items()} == {"one": "constant", "flat": "constant", "straight": "linear", "steep": "exponential", "slow": "sublinear", "nothing": "constant", "repeated": "linear"}
    assert found["straight"]["score"] == 70.0 and found["steep"]["score"] == 20.0 and found["one"]["score"] == 100.0
    assert views.scalability(points.limit(0), "tool").count() == 0


def test_tiers(spark):
    symbols = spark.createDataFrame([("a.rs:Parse:3", "Parse")], "id string, name string")
    links = spark.createDataFrame([("`parse`",), ("a.rs",), ("zzz",), ("  ",), ("`parse`",)], "link string")
    assert {r["link"]: r["confidence"] for r in views.link_tiers(links, symbols).collect()} == {"`parse`": 0.9, "a.rs": 0.6, "zzz": 0.3, "  ": 0.3}
    text = spark.createDataFrame([("FIXES #1",), ("part of  #2",), ("fixes it",), (None,)], "t string")
    assert [tuple(r) for r in text.select(views.commit_tier(text.t), views.explicit_tier(text.t)).collect()] == [(0.85, 0.9), (0.7, 0.3), (0.3, 0.9), (0.3, 0.3)]


def test_first_source_wins(spark):
    one = spark.createDataFrame([("a", 0.2), ("a", 0.4)], "name string, score double")
    two = spark.createDataFrame([("a", 9.0), ("b", 0.5)], "name string, score double")
    assert [tuple(r) for r in views.first_source([("x", one), ("y", two)], 5).collect()] == [("b", 0.5, "y"), ("a", 0.4, "x")]


def test_lens_and_insights(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    lens = spark.createDataFrame([("b", "hot"), ("b", "warm")], "id string, summary string")
    assert sorted(map(tuple, views.apply_lens(rows, lens).collect()), key=str) == [("a", None), ("b", "hot"), ("b", "hot")]
    assert views.apply_lens(rows, None).where("summary IS NULL").count() == 3
    none = spark.createDataFrame([], "id string, size long, cohesion double")
    assert views.insights(none, none, none, none).first()["health"] == 100.0
