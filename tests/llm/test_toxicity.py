"""Held-out accuracy on planted texts, the score against a plain re-computation, and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa

from graphloom.llm.toxicity import DIM, Model, features, score, toxicity, train


def corpus(n=1500):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "ba"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        w = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 6) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "awful", "grubby"]))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_fold(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, toxic int, score string")
    rows = toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    hits = [r.predicted == truth[r.doc_id] for r in held]
    assert np.mean(hits) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    one, two = (train(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights)
    assert (one.bias, one.slope, one.shift) == (two.bias, two.slope, two.shift)


def test_odd_inputs(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "vile"), (4, "é" * 90_000), (4, "é" * 90_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity(d, none).collect()
    assert len(rows) == 5
    assert len({r.score for r in rows}) == 1
    assert toxicity(d.limit(0), none).collect() == []
    assert len(toxicity(d, spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")).collect()) == 5


def test_score_adds_weights_of_distinct_features(spark):
    model = Model(np.random.default_rng(0).normal(size=DIM), -0.5, 0.7, 0.1)
    texts = ["one two one", "", None, "Three,three", "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(score(model, __import__("pyspark").sql.functions.col("t"))).collect()]
    for t, s in zip(texts, got, strict=True):
        raw = (t or "").encode()
        index, _ = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        z = 0.7 * (-0.5 + model.weights[np.unique(index)].sum()) + 0.1
        assert abs(s - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-9
    assert pa.__version__


def test_a_cue_of_a_twentieth_of_the_positives_is_learnt(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "ba"]) for _ in range(rng.randint(1, 4)))
    docs, labels, rare = [], [], set()
    for i in range(6000):
        bad = rng.random() < 0.2
        w = [word() for _ in range(rng.randint(5, 20))]
        if bad:
            cue = "zzgrubby" if rng.random() < 0.05 else "vile"
            w.insert(rng.randrange(len(w)), cue)
            rare |= {i} if cue == "zzgrubby" else set()
        docs.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    rows = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert np.mean([r.predicted for r in rows if r.held_out and r.doc_id in rare]) > 0.9
    assert np.mean([r.predicted == 0 for r in rows if " vile " not in f" {docs[r.doc_id][1]} " and r.doc_id not in rare]) > 0.99
