"""Collocations against a plain version that counts tuples of words."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations as c
from graphloom.llm.collocations import collocations, lowest_cut, pair_names, phrases

SPLIT = str.maketrans({x: "\x00" for x in ".,;:!?\x0a\x0b\x0c\x0d"})


def count(rows, most):
    f = Counter()
    for text, lang in rows:
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in low.translate(SPLIT).split("\x00"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            for k in range(1, most + 1):
                f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def brute(rows, most=3, least=10, contained=50, top=2000):
    f = count(rows, most)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, g), a in candidates.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if 100 * a >= contained * f[lang, g[i : i + k]]:
                    gone.add((lang, g[i : i + k]))
    out = []
    for lang in {x for x, _ in f}:
        n = sum(v for (x, g), v in f.items() if x == lang and len(g) == 1)
        own = []
        for (x, g), a in candidates.items():
            if x == lang and (x, g) not in gone:
                cuts = [(1_000_000 * a * a // (f[x, g[:k]] * f[x, g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(g).encode(), f[x, g[:k]], f[x, g[k:]], len(g)))
        for rank, (score, a, g, left, right, words) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -score, words))
    return sorted(out)


def texts():
    rng = random.Random(11)
    words = ["The", "the", "of", "cat", "été", "zebra", "日本", "x", "Qq", "n't"] + [f"w{i}" for i in range(30)]
    made = [("".join(rng.choice(words[: rng.choice([5, 10, 40])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", "?!", " \x0b", " "]) for _ in range(rng.choice([0, 1, 2, 30, 90]))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(250)]
    return made + [(None, "en"), ("", None), ("long run " * 6000, "en"), ("y" * 40_000, "de"), ("one two three four five " * 12, "fr"), made[3], made[3], (" \t.", "it")]


@pytest.mark.parametrize(("most", "top", "bits"), [(3, 2000, 1 << 12), (2, 5, 64), (5, 40, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, most, top, bits):
    monkeypatch.setattr(c, "FLUSH", 50)
    monkeypatch.setattr(c, "BITS", bits)
    df = spark.createDataFrame([(t, x, 1, 2) for t, x in texts()], "text string, lang string, n int, part int").repartition(3)
    got = collocations(df, max_words=most, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "words"]
    want = brute(texts(), most, top=top)
    assert want and sorted(map(tuple, got.collect())) == want


def test_all_phrases_and_their_parts(spark):
    df = spark.createDataFrame(texts(), "text string, lang string").repartition(2)
    f = count(texts(), 4)
    got = {(r.lang, tuple(r.phrase.split(" "))): r for r in phrases(df, max_words=4, least=8).collect()}
    assert {k for k, a in f.items() if a >= 8 and len(k[1]) <= 4} == set(got)
    for (lang, g), r in got.items():
        assert (r.f, r.words) == (f[lang, g], len(g))
        assert r.pre == [f[lang, g[: j + 1]] for j in range(len(g) - 1)] and r.suf == [f[lang, g[len(g) - j - 1 :]] for j in range(len(g) - 1)]
        longer = [f[k] for k in f if k[0] == lang and len(k[1]) == len(g) + 1 and f[k] >= 8 and g in (k[1][1:], k[1][:-1])]
        assert r.inside == (max(longer) if longer and len(g) < 4 else None)


def test_names_are_those_of_spark_and_scores_exact(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 63), 1 << 63, 500, dtype=np.int64) for _ in range(2))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "l long, r long")
    want = [r[0] for r in df.select(F.xxhash64("l", "r")).collect()]
    assert pair_names(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == want
    big = [(10**12 + 7, [10**12 + 9, 10**13], [10**14 + 1, 10**12 + 11]), (10, [10, 10], [10, 10]), (3 * 10**9, [5 * 10**9], [7 * 10**9 + 1])]
    got = spark.createDataFrame(big, "f long, pre array<long>, suf array<long>").select(lowest_cut(F.col("f"), F.size("pre") + 1).alias("c")).collect()
    for (f, pre, suf), r in zip(big, got, strict=True):
        score, k = min((10**6 * f * f // (pre[k - 1] * suf[len(pre) - k]), k) for k in range(1, len(pre) + 1))
        assert (r.c.score, r.c.k, r.c.l, r.c.r) == (score, k, pre[k - 1], suf[len(pre) - k])


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations(spark.createDataFrame([("a b", None)], "text string, lang string")).collect() == []
