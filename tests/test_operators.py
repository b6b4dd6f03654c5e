"""Operators on small graphs with exact expectations, and against plain Python on random ones."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import access, aggregate, analytics, blocks, federation, reach, reachability, search, stats
from graphloom.operators.components import connected_components
from graphloom.session import cut
from graphloom.sources import manifest, store
from graphloom.streaming import changes


def edges(spark, pairs):
    rows = [(a, b, "calls", "extracted", 1.0) for a, b in pairs]
    return spark.createDataFrame(rows, "src string, dst string, dep_type string, provenance string, confidence double")


def ids(spark, names):
    return spark.createDataFrame([(n, n, "function", f"src/{n}.rs") for n in names], "id string, name string, kind string, file string")


def pairs_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


ABCD = [("A", "B"), ("A", "D"), ("B", "C"), ("C", "D")]


def test_adjacency(spark):
    e, n = edges(spark, ABCD + [("A", "B")]), ids(spark, "ABCD")
    assert pairs_of(access.with_degrees(n, e), "id", "fan_in", "fan_out") == [("A", 0, 2), ("B", 1, 1), ("C", 1, 1), ("D", 2, 0)]
    assert pairs_of(access.roots(n, e), "id") == [("A",)]
    assert pairs_of(access.leaves(n, e), "id") == [("D",)]


def test_traversals(spark):
    e = edges(spark, ABCD)
    seed = ids(spark, "A").select("id")
    assert pairs_of(reach.reach(e, seed), "id", "depth") == [("A", 0), ("B", 1), ("C", 2), ("D", 1)]
    assert pairs_of(reach.simple_paths(e, seed, ids(spark, "D"), 3), "hops", "path") == [(1, ["A", "D"]), (3, ["A", "B", "C", "D"])]
    assert pairs_of(reach.simple_paths(e, seed, ids(spark, "D"), 3, 2), "hops") == [(3,)]
    nodes, inside = reach.subgraph(e, seed, 1)
    assert pairs_of(inside, "src", "dst") == [("A", "B"), ("A", "D")]
    assert [r.layer for r in reach.topological_layers(e, ids(spark, "ABCD")).orderBy("id").collect()] == [0, 1, 2, 3]
    assert reach.topological_layers(edges(spark, [("A", "B"), ("B", "A")]), ids(spark, "AB")).count() == 0
    weak = e.withColumn("confidence", F.when((F.col("src") == "A") & (F.col("dst") == "D"), 0.1).otherwise(0.9))
    best = {r.dst: (round(r.cost, 6), r.path) for r in reach.cheapest_paths(weak, seed).collect()}
    assert best["D"] == (0.3, ["A", "B", "C", "D"])
    assert pairs_of(reach.explained(reach.cheapest_paths(weak, seed).where("dst = 'D'"), weak), "hop", "from", "to") == [(0, "A", "B"), (1, "B", "C"), (2, "C", "D")]


def plain_reach(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    far = {}
    for s in {x for p in pairs for x in p}:
        seen, todo = set(), [s]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        far[s] = seen
    return far


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = list({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    far = plain_reach(pairs)
    n, e = ids(spark, names), edges(spark, pairs)
    both = plain_reach(pairs + [(b, a) for a, b in pairs])
    assert pairs_of(analytics.weak_components(n, e), "id", "component") == sorted((x, min(both.get(x, set()) | {x})) for x in names)
    strong = {x: min({y for y in far.get(x, ()) if x in far[y]} | {x}) for x in names}
    assert pairs_of(analytics.strong_components(n, e), "id", "component") == sorted(strong.items())
    assert pairs_of(reach.pair_reach(e), "a", "b") == sorted((a, b) for a in far for b in far[a])
    und = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    count = lambda es, vs: len({min(plain_reach(list(es) + [(b, a) for a, b in es]).get(v, set()) | {v}) for v in vs})
    base = count(und, names)
    found = cut(blocks.blocks(e))
    assert pairs_of(blocks.bridges(e, found), "a", "b") == sorted(x for x in und if count(und - {x}, names) > base)
    cuts = sorted((v, count({x for x in und if v not in x}, [y for y in names if y != v])) for v in names)
    assert pairs_of(blocks.articulation_points(n, e, found), "id", "components") == [c for c in cuts if c[1] > base]
    core = set(und)
    while True:
        low = {v for v in names if sum(v in x for x in core) < 2}
        rest = {x for x in core if not low & set(x)}
        if rest == core:
            break
        core = rest
    assert pairs_of(analytics.k_core(e, 2), "id") == sorted((v,) for v in {v for x in core for v in x})
    root = pairs[0][0]
    reached = far[root] | {root}
    doms = {}
    for x in reached - {root}:
        avoid = {root}
        todo = [root]
        while todo:
            a = todo.pop()
            for s, d in pairs:
                if s == a and d != x and d not in avoid:
                    avoid.add(d)
                    todo.append(d)
        for y in reached - avoid - {x}:
            doms.setdefault(y, set()).add(x)
    got = {r.id: (r.dominator, r.depth) for r in analytics.dominators(e, root).collect()}
    assert {k: v[1] for k, v in got.items()} == {v: 0 if v == root else len(doms.get(v, ())) + 1 for v in reached}


def test_long_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **{1000 + i: 1000 for i in range(60)}}


def test_ranks_and_communities(spark):
    cycle = analytics.pagerank(ids(spark, "ABC"), edges(spark, [("A", "B"), ("B", "C"), ("C", "A")])).collect()
    assert len({round(r["rank"], 9) for r in cycle}) == 1
    star = {r.id: r["rank"] for r in analytics.pagerank(ids(spark, "cuvwxy"), edges(spark, [(x, "c") for x in "uvwxy"]), tolerance=1e-6).collect()}
    assert max(star, key=star.get) == "c"
    assert abs(sum(star.values()) - 1) < 1e-9
    two = edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y"), ("Y", "Z"), ("Z", "X")])
    labels = {r.id: r.label for r in analytics.label_propagation(ids(spark, "ABCXYZ"), two).collect()}
    assert labels["A"] == labels["B"] == labels["C"] != labels["X"] == labels["Y"] == labels["Z"]
    parts = spark.createDataFrame([(x, "p" if x in "ABC" else "q") for x in "ABCXYZ"], "id string, c string")
    assert round(analytics.modularity(two, parts).first()["modularity"], 6) == 0.5
    assert {r.conductance for r in analytics.conductance(two, parts).collect()} == {0.0}
    assert pairs_of(reachability.transitive_reduction(edges(spark, [("A", "B"), ("B", "C"), ("A", "C")])), "src", "dst") == [("A", "B"), ("B", "C")]


def test_dead_code_keeps_rootless_cycles_only(spark):
    n, e = ids(spark, "ABXY"), edges(spark, [("A", "B"), ("X", "Y"), ("Y", "X")])
    assert pairs_of(aggregate.dead_code(n, e), "id") == [("X",), ("Y",)]


def test_search(spark):
    n = spark.createDataFrame([("1", "parseFile"), ("2", "file_parser"), ("3", "File"), ("4", "profile"), ("5", "f_i_l_e")], "id string, name string")
    got = [r.name for r in search.similarity_search(n, "file", 9).collect()]
    assert got == ["File", "file_parser", "parseFile", "profile", "f_i_l_e"] or got == ["File", "file_parser", "profile", "parseFile", "f_i_l_e"]
    degrees = n.select("id", F.lit(0).alias("fan_in"), F.lit(0).alias("fan_out"))
    assert search.idf_search(n, degrees, "file", 1).first().name == "File"
    assert search.keywords("Where is the File of A parser?") == ["file", "parser"]


def test_statistics_and_federation(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in range(1, 102)], "g string, v double")
    r = stats.benchmark_stats(rows, "g", "v").first()
    assert (r.p50, r.p95, r.p99) == (51.0, 96.0, 100.0)
    n = spark.createDataFrame([("s", "1", "Foo  Bar", "x"), ("t", "2", "foo bar!", "y"), ("t", "3", "baz", "x")], "space string, id string, label string, kind string")
    assert pairs_of(federation.merge_candidates(n), "a", "b", "score") == [("s::1", "t::2", 0.8)]


def test_manifest_and_owners(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn a() {}")
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "b.rs").write_text("x")
    files = manifest.classified(manifest.scan(spark, str(tmp_path))).collect()
    assert [(f.file_type, f.language) for f in files] == [("code", "rust")]
    rules = spark.createDataFrame([(1, "", "all"), (2, "src", "team"), (3, "src/x", "me")], "position int, prefix string, owner string")
    f = spark.createDataFrame([("src/a.rs",), ("src/x/b.rs",), ("doc.md",)], "file string")
    assert pairs_of(aggregate.owners(f, rules), "file", "owner") == [("doc.md", "all"), ("src/a.rs", "team"), ("src/x/b.rs", "me")]
    log = spark.createDataFrame([("c1", "Fixes #12, see #7")], "commit string, message string")
    assert pairs_of(manifest.commit_refs(log), "issue", "kind") == [(7, "mentions"), (12, "resolves")]
    md = spark.createDataFrame([(1, "# Top\ntext\n## Sub ")], "doc_id long, text string")
    assert pairs_of(manifest.headings(md), "line", "level", "title") == [(0, 1, "Top"), (2, 2, "Sub")]


def test_revisions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.commit(root, "w", edges(spark, ABCD), "k1") == 1
    assert store.commit(root, "w", edges(spark, ABCD), "k1") == 1
    assert store.commit(root, "w", edges(spark, ABCD[:1]), "k2") == 2
    assert store.snapshot(spark, root, "w").count() == 1
    assert store.snapshot(spark, root, "w", 1).count() == 4


def test_event_stream_folds_into_state(spark, tmp_path):
    schema = "op string, src string, dst string, dep_type string, seq long"
    first = [("dependency_added", "a", "b", "calls", 1), ("dependency_added", "a", "c", "calls", 2), ("dependency_removed", "a", "b", "calls", 3), ("dependency_added", "d", "a", "calls", 4)]
    second = [("symbol_removed", "d", None, None, 5), ("dependency_added", "a", "e", "calls", 6)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes.fold_stream(events, str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination()
    assert pairs_of(spark.read.parquet(str(tmp_path / "g" / "v=1")), "src", "dst") == [("a", "c"), ("a", "e")]


def test_ranked_symbols_rank_every_match(spark, monkeypatch):
    from graphloom import graphs
    from graphloom.queries import QUERIES

    monkeypatch.setattr(graphs, "nodes", lambda spark, sf_dir: spark.createDataFrame([(str(i), f"a ring {i}") for i in range(30)], "id string, name string"))
    monkeypatch.setattr(graphs, "edges", lambda spark, sf_dir: edges(spark, [("1", "2")]))
    ranked = QUERIES["se8_ranked_symbols"](spark, "unused")
    assert ranked.count() == 30
    assert "Limit" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_label_classes_hold_methods_without_a_row_per_pair(spark, monkeypatch):
    from graphloom import graphs
    from graphloom.queries import QUERIES

    rows = [(str(i), "Parse It", "method") for i in range(40)] + [("c", "Parse It", "class"), ("n", "nature", "method")]
    monkeypatch.setattr(graphs, "nodes", lambda spark, sf_dir: spark.createDataFrame(rows, "id string, name string, kind string"))
    assert pairs_of(QUERIES["fed2_label_classes"](spark, "unused"), "label", "spaces", "kinds", "n") == [("nature", "a,b", "method", 2), ("parse it", "a,b", "class,method,module", 82)]
    assert QUERIES["fed2_label_members"](spark, "unused").count() == 84
    assert pairs_of(QUERIES["fed1_federated_search_all"](spark, "unused"), "fid") == [("a::n",), ("b::n",)]
