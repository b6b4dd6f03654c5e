"""Stupid backoff against a brute-force version that counts n-grams as tuples."""

import math
import random
from collections import Counter

import pytest

from graphloom.llm import lm_score
from graphloom.llm.lm_score import backoff_scores


def brute(texts, order, alpha=0.4):
    docs = [[w for w in (t or "").encode().lower().split()] for t in texts]
    grams = lambda d, k: Counter(tuple(d[i : i + k]) for i in range(len(d) - k + 1))
    total = {k: sum((grams(d, k) for d in docs), Counter()) for k in range(1, order + 1)}
    n = sum(map(len, docs))
    out = []
    for d in docs:
        own = {k: grams(d, k) for k in range(1, order + 1)}
        other = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(d)):
            top = min(order, i + 1)
            for k in range(top, 0, -1):
                g = tuple(d[i - k + 1 : i + 1])
                if k == 1:
                    s += math.log((other(g) or 0.5) / max(1, n - len(d))) + (top - 1) * math.log(alpha)
                elif other(g) > 0:
                    s += math.log(other(g) / other(g[:-1])) + (top - k) * math.log(alpha)
                    break
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(lm_score, "ROWS", 7)
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["the", "of", "The", "cat", "sat", "é", "x"]) + ("" if rng.random() < 0.9 else str(rng.random())) for _ in range(rng.choice([0, 1, 2, 20, 60]))) for _ in range(60)]
    texts += [None, "", texts[3], texts[3], "word " * 20_000, "y" * 50_000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, chunk int, row int").repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    want = brute(texts, order)
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):
        rows = backoff_scores(docs, order=order).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.n_tokens == want[r.doc_id][0]
            assert math.isclose(r.log_score, want[r.doc_id][1], rel_tol=1e-9, abs_tol=1e-6)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens, round(r.log_score, 9)) for r in backoff_scores(df).collect())
    want = brute(["a b", "a b", "a b", None], lm_score.ORDER)
    assert got == sorted((i, n, round(s, 9)) for i, (n, s) in zip(["None", "1", "1", "2"], want, strict=True))
    assert backoff_scores(df.limit(0)).collect() == []
