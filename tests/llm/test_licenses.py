"""License scans against a brute-force version: every template against every window."""

import random
import re

from graphloom.llm.licenses import TEMPLATES, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates):
    x, best = words(text), {}
    for name, t in templates:
        v = words(t)
        if not v:
            continue
        w = min(5, len(v))
        m, want = len(v) - w + 1, {tuple(v[i : i + w]) for i in range(len(v) - w + 1)}
        for at in range(0, len(x), m):
            win = x[at : at + 2 * m + w - 1]
            share = len(want & {tuple(win[i : i + w]) for i in range(len(win) - w + 1)}) / len(want)
            if share >= 0.8:
                best[name] = max(best.get(name, (0, 0)), (share, -(at + 1)))
    return sorted((n, -f, s) for n, (s, f) in best.items())


def run(spark, texts, templates):
    d = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, first int, license string")
    t = spark.createDataFrame(templates, "license string, text string")
    return {r.doc_id: [tuple(f) for f in r.found] for r in scan_licenses(d, t).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    noise = ["the", "license", "under", "this", "work", "xq", "all", "rights", "version"]
    texts = [None, "", "--", "all rights", "All Rights RESERVED", "word " * 20_000 + TEMPLATES[2][1], "x" * 100_000]
    for _ in range(120):
        w = [rng.choice(noise) for _ in range(rng.choice([0, 3, 40, 200]))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(TEMPLATES)[1].split()
            if rng.random() < 0.5 and len(t) > 12:
                t[rng.choice([0, -1])] = "changed"
            w[(at := rng.randrange(len(w) + 1)) : at] = t
        texts.append(" ".join(w))
    texts += texts[:3]
    got = run(spark, texts, TEMPLATES)
    for i, t in enumerate(texts):
        assert got[i] == brute(t, TEMPLATES), t


def test_empty_tables(spark):
    assert run(spark, ["All rights reserved"], []) == {0: []}
    assert run(spark, [], TEMPLATES) == {}
    assert run(spark, ["a b", None], [(None, "a b"), ("x", None), ("y", "")]) in ({0: [(None, 1, 1.0)], 1: []},)
