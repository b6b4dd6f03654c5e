"""Blocks, reachability, cores, ordered sums, budgets, candidates, blame and specifications against plain versions."""

import json
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics, blocks, candidates, questions, reachability
from graphloom.operators.ordered import order_statistics, running_sum, within_budget
from graphloom.session import cut
from graphloom.sources import history, manifest, openapi, store
from graphloom.streaming import changes, reindex


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def far(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    found = {}
    for s in {x for p in pairs for x in p}:
        seen, todo = set(), [s]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        found[s] = seen
    return found


def test_blocks_by_hand(spark):
    # two triangles at c, a bridge d-e, a square e-f-g-h, another component, a loop, a repeated edge
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "x"), ("x", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "e"), ("p", "q"), ("q", "p"), ("a", "a")]
    got = defaultdict(set)
    found = cut(blocks.blocks(edges(spark, e)))
    for r in found.collect():
        got[r.block].add(r.a + r.b)
    assert sorted(map(sorted, got.values())) == [["ab", "ac", "bc"], ["cd", "cx", "dx"], ["de"], ["ef", "eh", "fg", "gh"], ["pq"]]
    assert sorted((r.a, r.b) for r in blocks.bridges(edges(spark, e), found).collect()) == [("d", "e"), ("p", "q")]
    nodes = ids(spark, sorted({x for p in e for x in p} | {"alone"}))
    assert sorted((r.id, r.components) for r in blocks.articulation_points(nodes, edges(spark, e), found).collect()) == [("c", 4), ("d", 4), ("e", 4)]
    assert blocks.blocks(edges(spark, []).limit(0)).collect() == []


def test_star_and_path_have_linear_state(spark):
    star = [("hub", f"leaf{i:03d}") for i in range(90)]
    tree = blocks.numbered(blocks.forest(blocks.undirected(edges(spark, star))))
    assert tree.count() == 91 and sorted(r.pre for r in tree.collect()) == list(range(91))
    found = cut(blocks.blocks(edges(spark, star)))
    assert blocks.bridges(edges(spark, star), found).count() == 90
    assert [(r.id, r.components) for r in blocks.articulation_points(ids(spark, ["hub", *[b for _, b in star]]), edges(spark, star), found).collect()] == [("hub", 90)]


@pytest.mark.parametrize("seed", [1])
def test_reachability_and_reduction(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(12)]
    cyclic = list({(rng.choice(names), rng.choice(names)) for _ in range(16)})
    dag = list({tuple(sorted(rng.sample(names, 2))) for _ in range(24)})
    known = far(cyclic)
    asked = [(a, b) for a in [*names, "gone"] for b in names]
    got = {(r.a, r.b): r.reaches for r in reachability.Reach(ids(spark, names), edges(spark, cyclic)).reaches(spark.createDataFrame(asked, "a string, b string")).collect()}
    assert got == {(a, b): b in known.get(a, ()) for a, b in asked}
    known = far(dag)
    longer = {(a, b) for a, b in dag if any(b in known[c] for x, c in dag if x == a and c != b)}
    assert sorted((r.src, r.dst) for r in reachability.transitive_reduction(edges(spark, dag + dag[:3])).collect()) == sorted(set(dag) - longer)
    assert longer
    round_ = [*dag, (dag[0][1], dag[0][0])]
    assert sorted((r.src, r.dst) for r in reachability.transitive_reduction(edges(spark, round_)).collect()) == sorted(set(round_))


def test_reduction_looks_from_the_lesser_side(spark):
    # a hub with many steps out and one with many steps in, each with a longer way to some of them
    out = [("hub", f"o{i:02d}") for i in range(40)] + [("hub", "m"), ("m", "o01"), ("m", "k"), ("k", "o02")]
    into = [(f"i{i:02d}", "sink") for i in range(40)] + [("i03", "i04"), ("i05", "j"), ("j", "sink")]
    gone = {("hub", "o01"), ("hub", "o02"), ("i03", "sink"), ("i05", "sink")}
    got = {(r.src, r.dst) for r in reachability.transitive_reduction(edges(spark, out + into)).collect()}
    assert got == set(out + into) - gone


def test_core_numbers(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(16)]
    pairs = {tuple(sorted(rng.sample(names[: rng.choice([6, 16])], 2))) for _ in range(34)} | {("n0", "n0")}

    def core(k):
        left = {p for p in pairs if p[0] != p[1]}
        while low := {v for v in {x for p in left for x in p} if sum(v in p for p in left) < k}:
            left = {p for p in left if not low & set(p)}
        return {x for p in left for x in p}

    want = {v: max(k for k in range(1, 16) if v in core(k)) for v in core(1)}
    assert {r.id: r.core for r in analytics.core_numbers(edges(spark, sorted(pairs))).collect()} == want
    assert len(set(want.values())) > 1


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_running_sums_over_blocks(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, rng.choice([1, 2, None, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {r.i: r.before for r in running_sum(df, ["g"], [F.asc("i")], F.col("v"), block_bits=bits).collect()}
    assert got == {i: sum(v or 0 for h, j, v in rows if h == g and j < i) for g, i, _ in rows}
    total = {r.i: r.before for r in running_sum(df, [], [F.desc("i")], F.col("v"), block_bits=bits).collect()}
    assert total == {i: sum(v or 0 for _, j, v in rows if j > i) for _, i, _ in rows}


def test_order_statistics_and_a_hot_group(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *[float(x) for x in range(30)]])) for _ in range(900)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.p50, r.p99, r.all) for r in order_statistics(df, ["g"], "v", {"p50": (0.5, 1), "p99": (0.99, 1), "all": (1.0, 0)}).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        s = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = (len(s), s[int(0.5 * (len(s) - 1))], s[int(0.99 * (len(s) - 1))], s[-1])
    assert got == want
    # distinct values of one group spread over tasks: a range partition holds part of them
    hot = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    placed = hot.repartitionByRange(4, F.col("g").asc_nulls_first(), F.col("v").asc())
    assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 12_000
    assert order_statistics(hot, ["g"], "v", {"m": (0.5, 1)}).first().m == sorted(x * 7919 % 20_011 for x in range(20_000))[9999]


def test_budget_filters_and_answers(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([3, 0, 4, None, 5, 1])], "i int, c int")
    assert [(r.i, r.spent) for r in within_budget(rows, [F.asc("i")], F.col("c"), 11).orderBy("i").collect()] == [(0, 3), (1, 3), (2, 7), (3, 7)]
    assert within_budget(rows, [F.asc("i")], F.col("c"), 2).collect() == []
    n = spark.createDataFrame([("a", "fn", "Alpha"), ("b", "fn", "Beta"), ("c", "cls", "Gamma"), ("d", None, "Delta"), ("e", "fn", "alphabet")], "id string, kind string, name string")
    e = spark.createDataFrame([("a", "b", "calls", "x", 1.0), ("b", "c", "calls", "x", 1.0), ("a", "d", "calls", "y", 0.5), ("d", "e", "calls", "x", 0.1), ("b", "e", "calls", None, 0.1)], "src string, dst string, dep_type string, provenance string, confidence double")
    kept, between = questions.filtered_graph(n, e, kinds=["fn"], provenance=["x"])
    assert sorted(r.id for r in kept.collect()) == ["a", "b", "e"] and [(r.src, r.dst) for r in between.collect()] == [("a", "b")]
    assert [sorted(r.id for r in questions.filtered_graph(n, e, **f)[0].collect()) for f in ({"exclude": ["cls"]}, {"kinds": []}, {"communities": n.where("id < 'c'")})] == [["a", "b", "e"], [], ["a", "b"]]
    walk = questions.keyword_walk(n, e, ["Beta", "alpha"], 1)
    assert sorted((r.id, r.depth, r.via, r.words) for r in walk.collect()) == [("a", 0, None, "alpha"), ("b", 0, None, "Beta"), ("c", 1, "b", ""), ("d", 1, "a", ""), ("e", 0, None, "Beta,alpha".split(",")[1])]
    found = questions.answer(n, walk, 4)
    assert sorted(r.id for r in found.collect()) == ["a", "b", "c", "e"]
    assert [(r.src, r.dst) for r in questions.answer_edges(e, found).collect()] == [("b", "c")]
    assert questions.keyword_walk(n, e, [], 2).collect() == []


def test_pages_behind_a_cursor(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s int")
    for down in (True, False):
        order, seen, after = [("s", down), ("i", not down)], [], None
        while page := questions.page_after(df, order, after, 7).collect():
            seen += [(r.i, r.s) for r in page]
            after = [page[-1].s, page[-1].i]
        want = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if down else r[1]) if r[1] is not None else 0, r[0] if down else -r[0]))
        assert seen == want


def test_top_candidates_equal_all_pairs(spark):
    rng = random.Random(8)
    words = ["parse", "HTTP", "load", "ab", "Node", "tree", "x"]
    rows = [(f"n{i:02d}", "".join(w.capitalize() if w.islower() else w for w in rng.sample(words, 2)), rng.choice(["f1", "f1", "f2", "f3", None]), rng.choice(["c1", "c1", "c2", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, name string, file string, c string")
    token = {r.id: set(r.t) for r in df.select("id", candidates.name_tokens(F.col("name")).alias("t")).collect()}
    assert {"Parse", "HTTP"} <= set().union(*token.values()) and "X" not in set().union(*token.values())
    for k in (1, 4):
        want = []
        for i, _, f, c in rows:
            pairs = []
            for j, _, g, d in rows:
                score = 0.7 if f is not None and f == g else 0.5 if c is not None and c == d else 0.3 if token[i] & token[j] else 0
                if score and i != j:
                    pairs.append((-score, j))
            want += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(pairs)[:k], 1)]
        got = candidates.top_candidates(df.select("id", "name", "file"), df, df.select("id", "c"), k).collect()
        assert sorted((r.id, r["rank"], r.candidate, r.score) for r in got) == want
        assert all(r.reason == {0.7: "same_file", 0.5: "same_community", 0.3: "name_match"}[r.score] for r in got)


def test_merge_scores_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice(["User", " user ", "Order!", "", "x"]), rng.choice(["t", "u", None]), rng.choice([None, [], ["k"], ["k", "m"], ["m", "m"]])) for _ in range(80)]
    want = defaultdict(int)
    for (s, label, kind, p), (t, other, k2, q) in combinations(rows, 2):
        one, two = (x.strip().lower().rstrip("!") for x in (label, other))
        if s != t and one == two and one:
            want[one, round(min(1.0, 0.8 + 0.2 * (kind == k2) + 0.1 * bool(set(p or ()) & set(q or ()))), 6)] += 1
    got = candidates.merge_scores(spark.createDataFrame(rows, "space string, label string, kind string, properties array<string>")).collect()
    assert {(r.label, r.score): r.pairs for r in got} == dict(want)


def test_blame(spark):
    rng = random.Random(7)
    ranges = [(rng.choice(["f", "g", None]), f"r{i}", a := rng.randint(0, 3000), a + rng.choice([0, 0, 5, 700, -3])) for i in range(120)] + [("f", "null", None, 3)]
    hunks = [(rng.choice(["f", "g", None]), a := rng.randint(0, 3000), a + rng.choice([0, 1, 9, 63, 64, 2000, -1]), rng.choice(["ann", "bob", "cyd", None]), "m", rng.randint(1, 5)) for _ in range(200)]
    got = {}
    for r in history.blamed(spark.createDataFrame(ranges, "file string, id string, first long, last long"), spark.createDataFrame(hunks, "file string, `from` long, to long, author string, email string, at int")).collect():
        got[r.id] = (r.last_author, r.changed_at, r.authors, r.lines)
    want = {}
    for f, i, a, z in ranges:
        met = [(at, who, min(z, to) - max(a, fr) + 1) for g, fr, to, who, _, at in hunks if f is not None and f == g and who is not None and a is not None and fr <= to and a <= z and fr <= z and a <= to]
        if met:
            at, who, _ = max(met)
            want[i] = (who, at, len({w for _, w, _ in met}), sum(n for _, _, n in met))
    assert got == want and len(want) > 40
    assert history.blamed(spark.createDataFrame(ranges[:2], "file string, id string, first long, last long"), spark.createDataFrame([], "file string, `from` long, to long, author string, email string, at int")).collect() == []


def test_openapi(spark):
    spec = {
        "paths": {
            "/pets/{id}/toys/{toyId}": {"get": {"operationId": "getPetToy", "responses": {"200": {"$ref": "#/r/ok"}}}, "summary": "no method", "parameters": [{"$ref": "#/p/id"}, {"x": [[{"$ref": "#/deep"}]]}]},
            "/pets": {"POST": {}, "get": {"operationId": "HTTPList"}},
        },
        "$ref": "#/top",
        "other": {"$ref": {"no": "string"}},
    }
    rows = [(1, json.dumps(spec)), (2, "no json"), (3, None), (4, "[1, 2]"), (5, '{"paths": 7}'), (6, '{"paths": {}}')]
    specs = openapi.parsed(spark.createDataFrame(rows, "spec_id int, text string"))
    routes = openapi.operations(specs)
    assert sorted(map(tuple, routes.collect()), key=str) == [(1, "/pets", "get", "HTTPList", ""), (1, "/pets", "post", None, ""), (1, "/pets/{id}/toys/{toyId}", "get", "getPetToy", "id,toyId")]
    item = "paths//pets/{id}/toys/{toyId}"
    assert sorted(map(tuple, openapi.references(specs).collect())) == [(1, "", "#/top"), (1, f"{item}/get/responses/200", "#/r/ok"), (1, f"{item}/parameters/0", "#/p/id"), (1, f"{item}/parameters/1/x/0/0", "#/deep")]
    nodes = spark.createDataFrame([("a", "get_pet_toy"), ("b", "toys_controller"), ("c", "pets_handler"), ("d", "post_pets"), ("e", "http_list")], "id string, name string")
    assert sorted((r.path, r.method, r.id, r.confidence) for r in openapi.handlers(routes, nodes).collect()) == [("/pets", "get", "e", 0.95), ("/pets", "post", "c", 0.6), ("/pets", "post", "d", 0.6), ("/pets/{id}/toys/{toyId}", "get", "a", 0.95)]
    asked = [("/pets/{id}", "/pets/42", True), ("/pets/{id}", "/pets", False), ("/api/users/", "api/users", True), ("/a/{}", "/a/b", False), ("/", "", True)]
    got = spark.createDataFrame([(p, q) for p, q, _ in asked], "p string, q string").select(openapi.serves(F.col("p"), F.col("q")).alias("ok")).collect()
    assert [r.ok for r in got] == [ok for _, _, ok in asked]


def test_reindexing_restarts_and_equals_batch_folding(spark, tmp_path):
    rng = random.Random(6)
    ops = ["dependency_added"] * 5 + ["dependency_removed", "symbol_removed"]
    events = [(rng.choice(ops), f"s{rng.randint(0, 9)}", f"s{rng.randint(0, 9)}", "calls", i) for i in range(240)]
    events = [(op, a, None, None, i) if op == "symbol_removed" else (op, a, b, t, i) for op, a, b, t, i in events]
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    table = lambda rows: spark.createDataFrame(rows, reindex.EVENTS)
    stood = lambda df: sorted(map(tuple, df.select("src", "dst", "dep_type").collect()))
    none = table([]).select("src", "dst", "dep_type")
    assert reindex.current(spark, log).collect() == [] and reindex.compact(spark, log) == -1
    sizes = []
    for k in range(3):
        table(events[80 * k : 80 * k + 80]).coalesce(1).write.mode("append").json(source)
        stream = reindex.reindex(reindex.watched(spark, source, files=1), log, checkpoint)
        stream.awaitTermination()
        sizes.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert stood(reindex.current(spark, log)) == stood(changes.folded(none, table(events[: 80 * k + 80])))
        if k == 1:
            assert reindex.compact(spark, log) == 1
    assert len(reindex._parts(spark, log)[0]) == 2  # the compaction and the batch after it
    assert sizes[-1] <= 10 + 100  # one row per key, however many events
    # a restart without new files changes nothing
    reindex.reindex(reindex.watched(spark, source, files=1), log, checkpoint).awaitTermination()
    assert stood(reindex.current(spark, log)) == stood(changes.folded(none, table(events)))
    # a batch written again, as after a failure, neither
    last = reindex._parts(spark, log)[0][-1]
    spark.read.schema(reindex.LOG).parquet(last).write.parquet(f"{log}/batch=000000000099")
    assert stood(reindex.current(spark, log)) == stood(changes.folded(none, table(events)))


def test_lost_head_entry_and_unknown_sizes(spark, tmp_path):
    import shutil

    root, e = str(tmp_path / "s"), edges(spark, [("a", "b"), ("b", "c")])
    assert store.commit(root, "w", e, "k1") == 1
    shutil.rmtree(f"{root}/heads")
    assert store.commit(root, "w", e, "k1") == 1 and store.snapshot(spark, root, "w").count() == 2
    assert store.commit(root, "v", e.limit(1), "k1") == 1 and store.snapshot(spark, root, "w").count() == 2
    old = spark.createDataFrame([("f", None, None, "h1"), ("g", 1, 2, "h1"), ("h", 1, None, None)], "file_path string, size int, mtime int, content_hash string")
    new = spark.createDataFrame([("f", None, None, "h2"), ("g", 1, 2, None), ("h", 1, None, None)], "file_path string, size int, mtime int, content_hash string")
    assert {r.file_path: r.change for r in manifest.delta(old, new).collect()} == {"f": "changed", "g": "unchanged", "h": "changed"}


def test_ignore_rules_equal_those_of_git(spark, tmp_path):
    import subprocess

    files = [f"{d}{f}" for d in ("", "build/", "src/", "src/build/", "src/a/b/", "docs/x/", "top1/y/", "node/") for f in ("a.log", "keep.log", "b.txt", "x1.c", "deep", "#odd", "a+b.md")]
    rules = {"": ["# comment", "", "*.log", "!keep.log", "build/", "/top?/**", "docs/**/b.txt", "!build/keep.log", "\\#odd", "a+b.*  "], "src": ["!a.log", "a/b/x[0-9].c", "/deep"], "src/a": ["*", "!b/", "!*.txt"], "node": ["deep/", "x[!2].c"]}
    lines = []
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    for folder, own in rules.items():
        (tmp_path / folder / ".gitignore").write_text("\n".join(own) + "\n")
        lines += [(folder, i, x) for i, x in enumerate(own)]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    gone = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(files), capture_output=True, text=True, check=False).stdout.split("\n")
    made = manifest.ignore_rules(spark.createDataFrame(lines, "folder string, position int, line string"))
    kept = manifest.without_ignored(spark.createDataFrame([(f, 1) for f in files], "file_path string, size int"), made)
    assert sorted(r.file_path for r in kept.collect()) == sorted(set(files) - set(gone)) and len(gone) > 20


def test_types_and_mentions(spark):
    from graphloom.operators import views

    paths = ["a/b.RS", "x.d/noext", ".bashrc", "m.json", "n.yaml", "r.md", "s.R", "t.tar.gz", "u.", None]
    got = manifest.classified(spark.createDataFrame([(p,) for p in paths], "file_path string")).collect()
    assert [(r.file_type, r.language) for r in got] == [("code", "rust"), ("other", None), ("other", None), ("config", None), ("config", "yaml"), ("document", None), ("code", "r"), ("other", None), ("other", None), ("other", None)]
    lines = [("see [foo](src/foo.rs:foo:1) for details", 0.5), ("src/bar.rs:helper:42", 0.5), ("<a:b>", 0.5), ("a:b:c", 0.3), ("http://a:80", 0.3), ("", 0.3), (None, 0.3), ("a::b", 0.3), ("one:two:3:4", 0.3), ("[x](open", 0.3)]
    assert [r.c for r in spark.createDataFrame([(x,) for x, _ in lines], "l string").select(views.mention_tier(F.col("l")).alias("c")).collect()] == [c for _, c in lines]
