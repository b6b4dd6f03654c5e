"""Fingerprints against a plain version, and what likeness has to tell apart."""

import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import fingerprints as f
from graphloom.llm.fingerprints import PARTS, edited_likeness, fingerprints, lexicon

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_all(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return h


def terms(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return sorted({signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words})


def plain_fingerprint(own, band):
    own = [t for t in own if t in band] or own
    level = 0
    while len(own) >= 2 * PARTS * 4**level:
        level += 1

    def row(x):
        some = [t for t in own if t & (4**x - 1) == 0]
        parts = [[t for t in some if (t & (1 << 64) - 1) >> 59 == k] for k in range(PARTS)]
        return "".join(f"{hash_all(p) & 0xFFFF:04X}" if p else "----" for p in parts)

    return f"{hash_all(own):016X}.{level:02d}.{row(level)}{row(level + 1)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    cells = []
    for x in (a, b):
        level, sig = int(x[17:19]), x[20:]
        cells.append({(level + i // PARTS, i % PARTS): sig[4 * i : 4 * i + 4] for i in range(2 * PARTS)})
    both = [(cells[0][k], cells[1][k]) for k in cells[0].keys() & cells[1].keys()]
    both = [(x, y) for x, y in both if (x, y) != ("----", "----")]
    return sum(x == y for x, y in both) / (len(both) + 1)


def brute(rows):
    df = Counter(t for _, text in rows for t in terms(text))
    band = {t for t, n in df.items() if f.RARE * len(rows) <= n <= f.COMMON * len(rows)}
    key = lambda i, text: signed(xxhash.xxh64(text.encode(), seed=42 if i is None else xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest())
    order = sorted({(i, text or "") for i, text in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), key(*r)))
    prints = {text: plain_fingerprint(terms(text), band) for _, text in order}
    made = {}
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        e = plain_fingerprint(terms(edited), band)
        own = prints[text]
        made[i, text] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, e, plain_likeness(own, e), plain_likeness(own, prints[after[1]]), after[0])
    return sorted([made[i, t or ""] for i, t in rows], key=str)


def rows():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(3000)]
    made = [(3 * i, " ".join(rng.choice(vocabulary[: rng.choice([50, 500, 3000])]) + rng.choice(["", "", ",", " The", " É"]) for _ in range(rng.choice([1, 3, 20, 60, 300, 1500])))) for i in range(120)]
    odd = [(None, "no id here w1 w2"), (None, "other without id"), (1, None), (2, ""), (4, "日本 🙂 é"), (5, "!!! ..."), (6, "x"), (3, made[1][1]), (7, made[5][1]), (7, "same id, other text w3"), (8, "long " * 20_000), (9, "q" * 30_000)]
    return made + odd


@pytest.mark.parametrize("most", [f.LEXICON, 3])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(f, "COMMON", 0.3)
    monkeypatch.setattr(f.lexicon, "__kwdefaults__", {"text": "text", "rare": f.RARE, "common": 0.3})
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows()], "doc_id long, text string, k1 int, terms string").repartition(3)
    got = edited_likeness(df, most=most)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows())
    # repeated rows are rows of the result too
    again = [*rows(), *rows()[:3], *[rows()[-1]] * 4]
    assert sorted(map(tuple, edited_likeness(spark.createDataFrame(again, "doc_id long, text string"), most=most).collect()), key=str) == brute(again)


def test_tells_edited_from_other_texts(spark):
    rng = random.Random(5)
    made = [(i, " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"t{int(40_000 * rng.random() ** 2)}" for _ in range(rng.choice([40, 150, 600, 3000])))) for i in range(400)]
    got = edited_likeness(spark.createDataFrame(made, "doc_id long, text string")).collect()
    wins = sum(r.near_edited > r.near_next for r in got)
    assert wins >= 0.95 * len(got)
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_equal_texts_and_copies_with_few_edits(spark):
    rng = random.Random(6)
    base = [" ".join(f"t{int(3000 * rng.random() ** 2)}" for _ in range(200)) for _ in range(200)]
    near = [t.replace(" ", " edited ", 1) for t in base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + near + base[:5])], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert all(prints[i] == prints[400 + i] for i in range(5))
    assert sum(plain_likeness(prints[i], prints[200 + i]) > 0.8 for i in range(200)) >= 190
    assert max(plain_likeness(prints[i], prints[i + 1]) for i in range(199)) < 0.6


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert edited_likeness(empty).collect() == [] and fingerprints(empty).collect() == []
    (one,) = edited_likeness(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert (one.edited_sha256, one.near_next, one.next_id) == (hashlib.sha256(b"abcd abcd").hexdigest(), 1.0, 1)


def test_main_path_is_native(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    plan = edited_likeness(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
    assert lexicon(df.where("text IS NOT NULL").select(F.col("text"))).count() > 0
