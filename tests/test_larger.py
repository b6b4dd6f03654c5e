"""What odd inputs and larger tables brought up."""

import math
import random

from pyspark.sql import functions as F

from graphloom import graphs, session
from graphloom.model import rounded
from graphloom.operators import access, aggregate, analytics, blocks, reach, reachability, search, stats, views
from graphloom.queries import QUERIES
from graphloom.sources import history, openapi, runs, store


def test_trends_against_a_mean_of_nothing(spark):
    values = [0.0, 0.0, 0.0, 5.0, 0.0, -1.0]
    rows = [("z", i, v) for i, v in enumerate(values)] + [("m", 0, 0.0), ("m", 1, -1.0), ("n", 0, 2.0), ("n", 1, 1.0), ("o", 0, 0.0), ("o", 1, None)]
    got = {(r.g, r.i): (r.change, r.alert) for r in stats.trends(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", "v", 2).collect()}
    assert got["z", 0] == (None, False) and got["o", 1] == (None, False)
    assert math.isnan(got["z", 1][0]) and not got["z", 1][1]
    assert got["z", 3] == (math.inf, False) and got["m", 1] == (-math.inf, True)
    assert got["n", 1] == (-50.0, True) and got["z", 4] == (-100.0, True)


def test_doubles_are_rounded_as_sql_rounds_them(spark):
    """Just below a tie as decimals; times ten to the places they are ties."""
    values = [(210.36874999999998, 210.3688), (61.981249999999996, 61.9813), (-210.36874999999998, -210.3688), (0.00005, 0.0001), (1.23, 1.23), (math.inf, math.inf), (1.5e307, 1.5e307), (None, None)]
    rows = spark.createDataFrame(values, "value double, want double")
    assert [r for r in rows.select(rounded("value", 4).alias("got"), "want").collect() if r.got != r.want] == []
    assert math.isnan(rows.select(rounded(F.lit(math.nan), 4)).first()[0])
    signs = spark.createDataFrame([(-1e-14,), (-0.0,), (0.0,), (1e-14,)], "value double").select(rounded("value", 4).alias("got")).collect()
    assert [math.copysign(1, r.got) for r in signs] == [-1, -1, 1, 1] and all(r.got == 0 for r in signs)


def test_trends_are_rounded_as_in_sql(spark, tmp_path):
    """53.33 on average, then 165.53: a change of 210.36874999999998 per cent, which SQL rounds to 210.3688."""
    rows = [(i, 1, v) for i, v in enumerate([53.33, 53.33, 53.34, 165.53])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.change for r in QUERIES["st9_trends"](spark, str(tmp_path)).collect()}
    assert got[3] == 210.3688


def test_shortest_paths_by_their_text(spark):
    rows = [("r", "n:1"), ("r", "n:12"), ("n:1", "s"), ("n:12", "s"), ("s", "t")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    seed = spark.createDataFrame([("r",)], "id string")
    of = lambda **more: {r.dst: r.path for r in reach.shortest_paths(edges, seed, **more).collect()}
    assert of()["t"] == ["r", "n:1", "s", "t"]  # by ids
    assert of(mark=">")["t"] == ["r", "n:12", "s", "t"]  # "r>n:12>" comes before "r>n:1>"


def test_blame_of_very_long_ranges(spark):
    """A range is a few rows, however short the hunks are."""
    most = 10**10
    ranges = spark.createDataFrame([("f", "r", 0, most), ("f", "s", 6, 7)], "file string, id string, first long, last long")
    hunks = spark.createDataFrame([("f", 5, 5, "a", "a@", 1), ("f", most, most + 9, "b", "b@", 2), ("f", 7, most, "a", "a@", 0)], "file string, `from` long, to long, author string, email string, at int")
    got = {r.id: (r.last_author, r.changed_at, r.authors, r.lines) for r in history.blamed(ranges, hunks).collect()}
    assert got == {"r": ("b", 2, 2, 1 + 1 + most - 6), "s": ("a", 0, 1, 1)}


def test_blame_of_whole_files_shuffles_no_pair(spark, monkeypatch):
    """Ranges and hunks are dealt out by file, once; files of many rows go by bins of lines, with the same result."""
    rng = random.Random(3)
    at = lambda: rng.choice([1, 2, None])
    ranges = [(rng.choice(["f", "f", "g"]), rng.choice(["r1", "r2", None, f"s{i}"]), a := rng.randint(0, 900), a + rng.choice([0, 7, 400])) for i in range(60)]
    hunks = [(rng.choice(["f", "f", "g", "h"]), a := rng.randint(0, 900), a + rng.choice([0, 3, 64, 900]), rng.choice(["ann", "bob", "\uff21", "\U0001f600"]), rng.choice(["m", "n", None]), at()) for _ in range(80)]
    want = {}
    for f, i, a, z in set(ranges):
        for g, fr, to, who, mail, when in hunks:
            if f == g and a <= to and fr <= z:
                want.setdefault((f, i), []).append(((when or 0, who.encode(), mail or ""), who, min(z, to) - max(a, fr) + 1))
    want = {k: (max(x)[0], len({w for _, w, _ in x}), sum(n for *_, n in x)) for k, x in want.items()}
    made = lambda: history.blamed(spark.createDataFrame(ranges * 2, "file string, id string, first long, last long"), spark.createDataFrame(hunks, "file string, `from` long, to long, author string, email string, at int"))
    rows = lambda df: {(r.file, r.id): ((r.changed_at or 0, r.last_author.encode(), r.author_email or ""), r.authors, r.lines) for r in df.collect()}
    found = made()
    assert rows(found) == want and len(want) > 20 and found.count() == len(want)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "FlatMapCoGroupsInArrow" in plan
    monkeypatch.setattr(history, "PAIRS", 7)
    assert rows(made()) == want  # each range's authors are those of several pieces
    monkeypatch.setattr(history, "FILE_ROWS", 70)
    found = made()
    assert rows(found) == want and "Join" in found._jdf.queryExecution().sparkPlan().toString()


def test_calls_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    found = graphs.calls(spark, sf)
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    assert found.rdd.getNumPartitions() >= 60
    least = session.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("f")).collect()
    want = {(f"supplier:{r.l_suppkey}", f"part:{r.l_partkey}"): {"A": "extracted", "N": "inferred"}.get(r.f, "ambiguous") for r in least}
    assert {(r.src, r.dst): r.provenance for r in found.collect()} == want


def test_distances_are_those_of_shortest_paths(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(60)], "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n2",), ("alone",)], "id string")
    for most in (0, 2, None):
        got = sorted((r.src, r.dst, r.hops) for r in reach.distances(edges, seeds, most).collect())
        assert got == sorted((r.src, r.dst, r.hops) for r in reach.shortest_paths(edges, seeds, most).collect())


def test_searches_go_on_at_the_lesser_end(spark, monkeypatch):
    """A root of 300 steps is not followed into all of them for a pair whose other end has one step behind it."""
    rows = [("r", f"x{i}") for i in range(300)] + [("r", "m"), ("m", "s"), ("s", "t"), ("r", "t")]
    written, real = [], reachability.cut
    monkeypatch.setattr(reachability, "cut", lambda df, name: written.append((name, out := real(df, name))) or out)
    got = reachability.transitive_reduction(spark.createDataFrame(rows, "src string, dst string"))
    assert {(r.src, r.dst) for r in got.collect()} == set(rows) - {("r", "t")}
    assert max(df.count() for name, df in written if name in ("sized", "tried", "ahead", "frontier")) < 10


def test_reduction_labels_no_graph_of_few_ancestors(spark, monkeypatch):
    """Cycles and ancestors are told by the few edges between nodes with steps ahead, the ends of all others by lists of ancestors."""
    rows = [("r", "n"), ("n", "s"), ("n", "t")] + [(a, f"p{i}") for i in range(40) for a in ("r", "s", "n" if i % 2 else "t")] + [(None, "n"), ("r", None)]
    monkeypatch.setattr(reachability, "Reach", None)
    monkeypatch.setattr(reachability, "strong_components", None)
    written = recorded(monkeypatch, reachability)
    reduced = lambda more: {(r.src, r.dst) for r in reachability.transitive_reduction(spark.createDataFrame(rows + more, "src string, dst string")).collect()}
    assert reduced([]) == {x for x in rows if x[1] is None or not x[1].startswith("p") or x[0] in ("s", "t")}
    assert max(df.count() for name, df in written if name not in ("plain", "gone")) < 10
    assert reduced([("s", "r")]) == {*rows, ("s", "r")}
    assert reduced([("p1", "p1")]) == {*rows, ("p1", "p1")}


def test_reduction_searches_what_is_above_many(spark, monkeypatch):
    monkeypatch.setattr(reachability, "LISTED", 2)
    rng = random.Random(8)
    rows = list({tuple(sorted(rng.sample(range(10, 23), 2))) for _ in range(34)})
    ahead = {n: {n} for n in range(10, 23)}
    for n in range(22, 9, -1):
        ahead[n] = ahead[n].union(*[ahead[b] for a, b in rows if a == n])
    implied = {(a, b) for a, b in rows if any(b in ahead[x] for c, x in rows if c == a and x != b)}
    built, real = [], reachability.Reach
    monkeypatch.setattr(reachability, "Reach", lambda *given, **more: built.append(1) or real(*given, **more))
    got = reachability.transitive_reduction(spark.createDataFrame(rows, "src long, dst long"))
    assert {(r.src, r.dst) for r in got.collect()} == set(rows) - implied
    assert built and implied


def test_sources_are_distinct_before_they_are_met(spark):
    plan = QUERIES["ql18_and"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [src#" in plan


def recorded(monkeypatch, module):
    """What the module writes between steps from now on, as (name, DataFrame)."""
    written, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name="t": written.append((name, df)) or real(df, name))
    return written


def test_costs_are_those_of_cheapest_paths(spark):
    rng = random.Random(9)
    rows = [(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 20)}", rng.randint(0, 10) / 10) for _ in range(60)]
    edges, seeds = spark.createDataFrame(rows, "src string, dst string, confidence double"), spark.createDataFrame([("n1",), ("n2",), ("n2",), ("alone",)], "id string")
    for rounds in (None, 2):
        got, want = ({(r.src, r.dst): round(r.cost, 9) for r in f(edges, seeds, rounds).collect()} for f in (reach.least_costs, reach.cheapest_paths))
        assert got == want and len(got) > 3


def test_degrees_of_a_search_are_made_once(spark, monkeypatch):
    written = recorded(monkeypatch, search)
    nodes = spark.createDataFrame([("1", "File"), ("2", "file_list")], "id string, name string")
    degrees = spark.createDataFrame([("1", 1, 0), ("2", 3, 1)], "id string, fan_in long, fan_out long")
    assert search.idf_search(nodes, degrees, "file", 1).first().name == "File"
    assert [name for name, _ in written] == ["degrees"]


def test_only_what_holds_a_reference_is_read_on(spark, monkeypatch):
    written = recorded(monkeypatch, openapi)
    text = '{"a": {"b": {"c": [{"d": 1}]}}, "x": {"$ref": {"y": [1, {"$ref": "#/in"}]}}, "z": {"$ref": null}, "w": [{"$ref": 7}, "\\"$ref\\""]}'
    specs = openapi.parsed(spark.createDataFrame([(1, text), (2, '{"only": {"deep": [1]}}'), (3, None), (4, "no json")], "spec_id long, text string"))
    got = sorted(map(tuple, openapi.references(specs).collect()), key=str)
    assert got == [(1, "w/0", "7"), (1, "x/$ref/y/1", "#/in"), (1, "z", None)]
    assert all(df.where("spec_id != 1").isEmpty() and df.where("at LIKE 'a%'").isEmpty() for _, df in written)


def test_dominators_go_on_behind_moved_pointers_only(spark, monkeypatch):
    written = recorded(monkeypatch, analytics)
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    assert {r.id: r.dominator for r in analytics.dominators(edges, "r").collect()} == {"r": None, "a": "r", "b": "r", "c": "r"}
    assert [name for name, _ in written].count("sized") == 2  # one round, a climb in it


def test_few_links_go_to_the_symbols(spark, monkeypatch):
    written = recorded(monkeypatch, views)
    links, symbols = spark.createDataFrame([("`Parse`",), ("a.r",), ("zz",), ("",), (None,)], "link string"), spark.createDataFrame([("x/a.rs:1", "parse"), ("x/a.rs:2", None)], "id string, name string")
    assert {r.link: r.confidence for r in views.link_tiers(links, symbols).collect()} == {"`Parse`": 0.9, "a.r": 0.6, "zz": 0.3, "": 0.3, None: 0.3}
    for name in ("names", "met"):
        assert "BroadcastHashJoin" in dict(written)[name]._jdf.queryExecution().executedPlan().toString()


def test_edges_of_dead_code_are_made_once(spark, monkeypatch):
    written = recorded(monkeypatch, aggregate)
    nodes = spark.createDataFrame([(i, "function") for i in "abxy"], "id string, kind string")
    edges = spark.createDataFrame([("a", "b"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.id for r in aggregate.dead_code(nodes, edges).collect()} == {"x", "y"}
    assert [name for name, _ in written] == ["edges"]


def test_bridges_need_components_once(spark, monkeypatch):
    """The forest's roots are the only components; cut vertices count them from their blocks."""
    rng, made, real = random.Random(6), [], blocks.connected_components
    monkeypatch.setattr(blocks, "connected_components", lambda pairs: made.append(pairs.schema["a"].dataType.typeName()) or real(pairs))
    rows = {(f"n{rng.randint(0, 15):02d}", f"n{rng.randint(0, 15):02d}") for _ in range(14)} | {("n01", "n01"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "z")}
    edges = spark.createDataFrame(list(rows), "src string, dst string").cache()
    flat = {(min(p), max(p)) for p in rows if p[0] != p[1]}

    def joined(pairs, a):
        seen = {a}
        while more := {y for p in pairs for x, y in (p, p[::-1]) if x in seen} - seen:
            seen |= more
        return seen

    assert {(r.a, r.b) for r in blocks.bridges(edges).collect()} == {p for p in flat if p[1] not in joined(flat - {p}, p[0])}
    assert made == ["long"]
    found = spark.createDataFrame([("c", "d", 1), ("d", "e", 2), ("p", "q", 3)], "a string, b string, block long")
    nodes = spark.createDataFrame([(i,) for i in ["c", "d", "e", "p", "q", "alone"]], "id string")
    assert [tuple(r) for r in blocks.articulation_points(nodes, edges, found).collect()] == [("d", 4)] and made == ["long"]


def test_merged_edges_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    a = spark.createDataFrame([(f"s{i % 7}", f"d{i % 30}", "calls", "inferred", i / 100) for i in range(60)], "src string, dst string, dep_type string, provenance string, confidence double")
    b = spark.createDataFrame([("s0", "d0", "calls", "manual", 1.0), ("s0", None, "calls", "manual", None)], a.schema)
    found = access.merged(a, b, a)
    assert found.rdd.getNumPartitions() == 13
    want = {(f"s{i % 7}", f"d{i % 30}"): ("inferred", i / 100) for i in range(60)} | {("s0", "d0"): ("manual", 1.0), ("s0", None): ("manual", None)}
    assert {(r.src, r.dst): (r.provenance, r.confidence) for r in found.collect()} == want


def test_revisions_are_written_without_a_sort(spark, tmp_path):
    root, name = f"file://{tmp_path}/s", "a/b = {c}%41:é"
    edges = spark.createDataFrame([("x", "y", "old"), ("x", "z", "old")], "src string, dst string, workspace_id string")

    def ran():
        every = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [every.apply(i).physicalPlanDescription() for i in range(every.size())]
        return [p for p in plans if "InsertIntoHadoopFs" in p and "/edges" in p and str(tmp_path) in p]

    assert [store.commit(root, name, edges, "1"), store.commit(root, name, edges.limit(1), "2"), store.commit(root, name, edges, "1"), store.commit(root, "a", edges, "1")] == [1, 2, 1, 1]
    assert len(ran()) == 3 and not any("Sort" in p for p in ran())
    assert [store.snapshot(spark, root, w, r).count() for w, r in [(name, 1), (name, None), ("a", None)]] == [2, 1, 2]
    assert {r.workspace_id for r in spark.read.parquet(f"{root}/edges").select("workspace_id").collect()} == {name, "a"}
    ends = runs.checkpoints(spark, root, name)
    assert sorted(map(tuple, ends.collect())) == [(1, 3, 2), (2, 2, 1)]
    assert "REPARTITION_BY_NUM" in ends._jdf.queryExecution().toString()
