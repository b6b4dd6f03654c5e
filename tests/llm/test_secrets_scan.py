"""Secrets: base spans against the plain patterns, automata on held-out formats, redaction, odd inputs."""

import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from graphloom.llm.secrets_scan import BINS, Grammars, _held_counts, _quantile, base_spans, candidates, fit, infer, learn, redacted, scan_secrets, symbols

PLAIN = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(PLAIN) for m in p.finditer(text) if ok(m)]
    return [(a, k, b) for a, _, k, b in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Api_Key", "PASSWORD", "secret", " ", "=", ": ", '"', "'", "abcdef0123456789", "AKIA", "ZZTOP1234567", "é", "\n", "x", "deadbeef", ".", "ſ", "K", "-"]), max_size=30).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in base_spans(text)] == brute(text)
    for a, b, token in candidates(text, base_spans(text)):
        assert text[a:b] == token
        assert all(b <= s[0] or a >= s[2] for s in base_spans(text))


def tokens(rng, n):
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]
    mixed = ["sk_" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(n)]
    words = ["-".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(4)) for _ in range(n)]
    return hexes, mixed, words


def test_automata_tell_formats_apart():
    hexes, mixed, words = tokens(random.Random(4), 300)
    g = fit({"hex": hexes[:200], "assign": mixed[:200]}, words[:200])
    assert sum(g.best(t) is not None and g.best(t)[0] == "hex" for t in hexes[200:]) >= 95
    assert sum(g.best(t) is not None and g.best(t)[0] == "assign" for t in mixed[200:]) >= 95
    assert sum(g.best(t) is not None for t in words[200:]) <= 5
    assert len(infer([symbols(t) for t in hexes[:200]]).next) < 200  # merged, not a tree of thousands of states


def test_scan_learn_and_redact(spark):
    hexes, mixed, words = tokens(random.Random(6), 60)
    docs = [(i, f"see {words[i]} token = \"{mixed[i]}\" and {hexes[i]}") for i in range(50)]
    docs += [(50, f"key {mixed[55]} here"), (51, None), (52, ""), (None, "Token=abcdefgh é"), (50, f"key {mixed[55]} here"), (53, "a" * 300_000), (54, "ab0 " * 50_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, spans int, kind int")
    g = learn(df)
    rows = scan_secrets(df, grammars=g).collect()
    assert len(rows) == len(docs)
    got = sorted(([(s.start, s.kind, s.end) for s in r.spans if s.score is None] for r in rows), key=str)
    assert got == sorted((brute(t or "") for _, t in docs), key=str)
    assert [[s.kind for s in r.spans] for r in rows if r.doc_id == 50] == [["like_assign"]] * 2
    clean = [r[0] for r in df.where("doc_id = 50 OR doc_id IS NULL OR doc_id = 51").select(redacted(g, F.col("text"))).collect()]
    assert sorted(map(str, clean)) == sorted(["key [SECRET] here", "None", "[SECRET] é", "key [SECRET] here"])
    assert scan_secrets(df.limit(0)).collect() == []
    assert Grammars().best("anything") is None


def test_unlabelled_credentials_do_not_lift_the_threshold(spark):
    rng = random.Random(8)
    _, mixed, words = tokens(rng, 4000)
    h = dict(spark.createDataFrame([(t,) for t in words + mixed[1000:]], "t string").select("t", F.xxhash64("t")).collect())
    low, high = (sorted(h[t] for t in words)[k] for k in (1100, 1400))
    hidden = [t for t in mixed[1000:] if low < h[t] < high][:3]  # in the last third of the ORDINARY tokens of smallest hash
    assert len(hidden) == 3
    texts = [" ".join(words[i : i + 100]) for i in range(0, 4000, 100)] + [f'token = "{m}"' for m in mixed[:200]] + [*hidden, "-".join(words[:40])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan_secrets(df).collect()
    assert [[s.kind for s in r.spans] for r in rows if r.doc_id in range(240, 243)] == [["like_assign"]] * 3
    assert sum(len(r.spans) for r in rows if r.doc_id < 40) <= 4


def test_every_other_ordinary_token_counts_for_the_threshold(spark):
    hexes, _, words = tokens(random.Random(9), 60)
    g = fit({"hex": hexes}, words[:30])
    texts = [" ".join(words), " ".join(words[:50]), "-".join(words)]
    df = spark.createDataFrame([(v,) for v in {v for t in texts for _, _, v in candidates(t, [])}], "token string")
    assert sum(n for _, n in _held_counts(df, g, frozenset(words[:20]))["hex"]) == len({w for w in words if len(w) >= 16} - set(words[:20])) + 1
    held = [math.floor(g.ratios(w)["hex"] * BINS) / BINS for w in words]
    assert abs(_quantile([(math.floor(v * BINS), 1) for v in held], 0.999) - np.quantile(held, 0.999)) < 1e-9
