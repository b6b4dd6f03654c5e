"""Personal data: base spans against the plain patterns, trees as expression, thresholds, odd inputs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


DIGITS = lambda v: re.sub("[^0-9]", "", v)
PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(DIGITS(v)) <= 19 and luhn(DIGITS(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(DIGITS(v)) <= 15),
)


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(found)


def got(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, k int")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(df).collect()}


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(1)
    bits = ["a.b@c.d", "x_y%z@host", ".co", "..", "@", "1.2.3.4", "256.1.1.1", "00255.0.0.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (437) 555-0689", "+", " ", "-", "(", ")", "9", "é", "😀", "\n", "_d@e.f", "tel ", "A", "12345678901234567890"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "1" * 30_000, "1 " * 20_000, "a" * 100_000, "a." * 50_000 + "@b.c", "x@" + "a." * 20_000 + "z", "+1" + " (" * 20_000, "a@b.c_d@e.f", "4111111111111111 " * 300]
    found = got(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[1] < 4] == brute(t), t


def test_trees_learn_and_score_as_an_expression(spark):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 5, (400, len(pii.FEATURES)))
    cells[:, 0] = rng.integers(0, 4, 400)
    good = (cells[:, 1] >= 3) & (cells[:, 8] < 2)
    table = np.c_[cells, good * 50, ~good * 50, good * 10, ~good * 10]
    model = pii.fit(table)
    assert np.mean((model.margin(cells) > 0) == good) > 0.99
    df = spark.createDataFrame([tuple(map(int, c)) for c in cells], ", ".join(f"{f} int" for f in pii.FEATURES))
    z = [r[0] for r in df.select(model.expression(F.struct(*pii.FEATURES))).collect()]
    assert np.allclose(z, model.margin(cells))
    for kind in range(4):
        own = cells[:, 0] == kind
        chosen = own & (model.margin(cells) >= model.thresholds[kind])
        assert good[chosen].mean() >= pii.PRECISION
        assert (good & own & chosen).sum() >= 0.9 * (good & own).sum()


def test_look_alikes_are_selected(spark):
    rng = random.Random(9)
    texts = [f"contact user{i}@mail{i % 7}.example.com or call +1 ({rng.randint(200, 999)}) 555-{i:04d} now" for i in range(120)]
    texts += [f"row {i} has 20{i % 100:02d}-01-{i % 28:02d} as date {i}" for i in range(120)]
    texts += ["contact someone@intranet today"]
    found = got(spark, texts)
    assert (8, 4, 24, "like_handle") in found[240]
    assert not any(s[1] >= 4 for i in range(120, 240) for s in found[i])


def test_odd_inputs(spark):
    df = spark.createDataFrame([(None, "a@b.cd"), (1, "a@b.cd"), (1, "a@b.cd"), (2, None)], "doc_id long, text string")
    assert sorted(len(r.spans) for r in pii.find_pii(df).collect()) == [0, 1, 1, 1]
    assert pii.find_pii(df.limit(0)).collect() == []
