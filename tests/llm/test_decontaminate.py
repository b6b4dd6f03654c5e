"""Decontamination against a brute-force version: every window of every item, every position."""

import random
import re

import pytest

from graphloom.llm.decontaminate import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for win in {tuple(v[i : i + 13]) for i in range(max(1, len(v) - 12))} - {()}:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, k1 int, item string")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, window string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate(d, b).collect()), key=str)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "cc", "Dd", "éa", "Éa", "x9", "McX"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, "unseen word here")]
    docs = [(i, text(rng.choice([0, 1, 8, 40, 90]))) for i in range(30)]
    for i in range(30, 60):
        w = items[i % 12][1]
        docs.append((i, text(rng.choice([0, 20, 300])) + w.upper() + " " + text(5)))
    docs += [(None, items[5][1]), (3, docs[3][1]), (99, None), (100, ""), (101, "!!! ... ---"), (102, "a" * 100_000), (103, "Cc " * 20_000)]
    assert got(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b")]), ([(1, "a b"), (2, None)], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert got(spark, docs, items) == brute(docs, items)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([(1, "thirteen x one"), (2, item), (3, "one")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    near = {r.doc_id: (r.n_near_items, r.n_items) for r in decontaminate(d, b).collect()}
    assert near[2] == (1, 1)
    assert near[3] == (0, 0)


def test_items_without_an_id_are_one_item(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "so " + item), (2, "q w e r"), (3, "alpha beta"), (4, item + " and alpha beta")]
    rows = got(spark, docs, [(None, item), (None, "alpha beta"), (7, "alpha beta"), (7, item)])
    assert rows == [(1, 14, 13, ["7"], True), (2, 4, 0, [], False), (3, 2, 2, ["7"], True), (4, 16, 15, ["7"], True)]
    counts = {r.doc_id: r.n_items for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(None, item), (None, "alpha beta")], "item_id long, text string")).collect()}
    assert counts == {1: 1, 2: 0, 3: 1, 4: 1}
