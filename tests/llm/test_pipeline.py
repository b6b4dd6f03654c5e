"""The pipeline on planted cases against a plain version of every stage's rule."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import secrets_scan, toxicity

from .test_decontaminate import brute as contamination
from .test_jaccard_join import brute as components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(500):
        text = prose(rng.randint(20, 80))
        if i % 6 == 0:
            text += " vile awful grubby vile"
        labels.append((i, 1, int(i % 6 == 0)))
        if i % 50 == 3:
            text += " " + items[i % 5][1]
        if i % 20 == 5:
            text += f" token = \"{rng.getrandbits(160):040x}\" end"
        docs.append([i, text, "en", "s", len(text)])
    for i in range(500, 540):
        docs.append([i, docs[i - 499][1] + (" x" if i % 2 else ""), "en", "s", 1])
    docs += [[600, None, None, None, None], [601, "", "en", "s", 0], [None, "rows without an id stay in place", "en", "s", 1], [7, docs[7][1], "en", "s", 1]]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, items


def test_run_equals_plain_stages(spark, tmp_path):
    docs, items = write(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    df = spark.createDataFrame(docs, COLUMNS)
    model = toxicity.train(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scored = df.select("*", toxicity.score(model, F.col("text")).alias("p")).collect()
    assert sum((r.p >= 0.7) == ("grubby" in (r.text or "")) for r in scored) >= len(scored) - 4
    kept = [(r.doc_id, r.text) for r in scored if r.p < 0.7]
    label = {i: c for i, _, c in components([k for k in kept if k[0] is not None])}
    kept = [k for k in kept if k[0] is None or label[k[0]] == k[0]]
    kept = list({(i, t) for i, t in kept})
    clean = {(c[0], k) for c, k in [(contamination([k], items)[0], k) for k in kept] if not c[4]}
    kept = [k for _, k in clean]
    assert not any(items[i % 5][1] in (t or "") for i, t in kept if i is not None and i % 50 == 3 and i < 500)
    token = re.compile(r'token = "[0-9a-f]{40}')
    kept = [(i, None if t is None else token.sub("[SECRET]", t)) for i, t in kept]
    assert any("[SECRET]" in (t or "") for _, t in kept)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in kept), key=str)
    assert sorted(((r.doc_id, r.ids_crc32) for r in rows), key=str) == want


def test_near_copies_by_text_and_clashing_names(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long + " x"), (2, "a text of its own under the same id"), (3, "same row"), (3, "same row"), (None, long), (4, ""), (5, None)]
    df = spark.createDataFrame([(i, t, "mine", "too") for i, t in rows], "doc_id long, text string, text_hash string, text_key string")
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    want = [(1, long), (2, rows[2][1]), (3, "same row"), (None, long), (4, ""), (5, None)]
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(want, key=str)
    assert {(r.text_hash, r.text_key) for r in got} == {("mine", "too")}
    spark.createDataFrame([(1, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([r for r in rows if r[1] is None or not r[1].startswith("w0")], key=str)
    assert {(r.text_hash, r.text_key) for r in got} == {("mine", "too")}


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    write(spark, tmp_path)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("rep", F.lit(1)).withColumn("k1", F.lit("x")).limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns, name
        assert out.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
    assert secrets_scan.KINDS


def test_stages_bound_their_batches_themselves(spark, monkeypatch):
    """Whoever calls a stage, its texts go to Python in small batches; the session's own setting comes back."""
    rows, written, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], corpus_pipeline.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df, name: written.append((name, spark.conf.get(rows))) or real(df, name))
    before = spark.conf.get(rows)
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string").withColumn("n_chars", F.lit(0))
    got = corpus_pipeline.mask_secrets(spark, docs, "").collect()
    assert sorted(map(tuple, got)) == [(1, "a text", 6), (2, None, None)]
    assert ("masked", str(corpus_pipeline.BATCH_ROWS)) in written
    assert spark.conf.get(rows) == before != str(corpus_pipeline.BATCH_ROWS)
