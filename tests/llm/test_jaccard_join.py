"""Jaccard components against a brute-force version that compares all pairs."""

import random
import re

from graphloom.llm.jaccard_join import jaccard_components


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return sorted((i, len(s), label[i]) for i, s in sets)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, rep string")
    return sorted(map(tuple, jaccard_components(df).collect()))


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    line = " ".join(word() for _ in range(12))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 4, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append(rng.choice([" ", "\n", "\t "]).join(w) + (" " + line if rng.random() < 0.3 else ""))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_random_groups(spark):
    rows = texts(1)
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "One"), (504, "one"), (505, "x" * 200_000), (506, "a b " * 30_000), (507, "A b " * 30_001)]
    assert got(spark, rows) == brute(rows)


def test_large_group_of_near_copies_needs_few_rounds(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert got(spark, rows) == brute(rows)


def test_blocks_of_large_tiles(spark, monkeypatch):
    from graphloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "ANCHORS", (1,))
    rng = random.Random(7)
    rows = []
    for g in range(2):
        base = [f"w{g}_{i}" for i in range(50 + 60 * g)]
        for i in range(70):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w[: rng.choice([len(w), len(w) - 5])])))
    assert got(spark, rows) == brute(rows)


def test_large_group_makes_rows_in_proportion(spark, monkeypatch):
    """600 near copies with far more links than rows: no step makes more rows than a few per member."""
    from graphloom.llm import jaccard_join

    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            w[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    made = {}
    whole = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df, name="t": made.setdefault((name, len(made)), whole(df, name)))
    result = got(spark, rows)
    sizes = {k: df.count() for k, df in made.items()}
    linked = sum(100 * len(x & y) >= 80 * len(x | y) for sets in [[shingles(t) for _, t in rows]] for i, x in enumerate(sets) for y in sets[:i])
    assert linked > 25_000
    assert max(n for (name, _), n in sizes.items() if name in ("near", "links", "met", "clusters", "members")) < 60 * len(rows)
    assert result == brute(rows)


def test_thresholds_are_exact(spark):
    a = [f"w{i}" for i in range(13)]  # 9 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:12])), (3, " ".join(a + ["y", "z"])), (4, " ".join(a[:11])), (9, " ".join(a))]
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "only here"), (5, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect()), key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (None, 1, None), (5, 0, 5)], key=str)
    assert jaccard_components(df.limit(0)).collect() == []
