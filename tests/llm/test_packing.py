"""Packing: ids equal the tokenizer's own, every piece placed once, sequences gapless, few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import packing
from graphloom.llm.packing import all_token_ids, pack_documents, plan, sequences, tokenize

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85  'sΣİéé<|endoftext|>AB.,;»5H\u0331")), max_size=60))
def test_ids_equal_those_of_the_whole_text(text):
    text = text.replace("»5", "<|endoftext|>")
    for part in (text, text + ", " + text + "."):
        assert np.frombuffer(all_token_ids([b"", part.encode()], PATH)[1], "<u4").tolist() == TOK.encode(part, add_special_tokens=False).ids


def test_ids_of_a_cased_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "Two Words, and  spaces\n", "naïve É. ok"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in all_token_ids([t.encode() for t in texts], path)] == want


def check(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


@pytest.mark.parametrize("capacity", [16, 64])
def test_documents(spark, capacity):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "Of", "xq", "9", "naïve"]) for _ in range(rng.choice([0, 1, 3, 9, 20, 70])))) for i in range(400)]
    docs += [(None, "a"), (None, "a"), (7, docs[7][1]), (900, None), (901, ""), (902, "word " * 3000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, length int, offset int")
    rows = pack_documents(df, PATH, capacity=capacity).collect()
    n = check(rows, capacity)
    want = []
    for i, t in docs:
        ids = [*TOK.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, j, k, len(p := ids[k : k + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for j, k in enumerate(range(0, len(ids), capacity))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == sorted(want, key=str)
    assert n <= -(-sum(w[3] for w in want) // capacity) * 1.02 + 1


def test_empty_table_and_sequences(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "doc_id long, text string")
    assert pack_documents(df.limit(0), PATH).collect() == []
    pieces = tokenize(df, PATH)
    got = sequences(pieces, pack_documents(df, PATH)).collect()
    assert len(got) == 1
    assert sorted(np.frombuffer(got[0].ids, "<u4").tolist()) == sorted(x for t in ("one two", "three", "") for x in [*TOK.encode(t, add_special_tokens=False).ids, 1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 400)), max_size=20))
def test_plan_covers_every_rank_once(counts):
    histogram = np.zeros(51, np.int64)
    for n, c in counts:
        histogram[n] += c
    for fitted in (True, False):
        entries, total = plan(histogram, 50, fitted)
        fill = defaultdict(list)
        for n in range(51):
            own = sorted(e for e in entries.tolist() if e[0] == n)
            at = 0
            for _, first, count, base, offset in own:
                assert first == at
                at += count
                for k in range(count):
                    fill[base + k].append((offset, n))
            assert at == histogram[n]
        assert len(fill) == total
        for parts in fill.values():
            end = 0
            for offset, n in sorted(parts):
                assert offset == end
                end += n
            assert end <= 50


@pytest.mark.parametrize("capacity", [64, 256])
def test_fitted_plan_keeps_up_with_plain_best_fit(capacity):
    histogram = np.bincount(np.random.default_rng(0).integers(1, capacity + 1, 20_000), minlength=capacity + 1)
    (_, got), (_, plain) = plan(histogram, capacity), plan(histogram, capacity, fitted=False)
    assert got <= plain * 1.0005


def test_pack_takes_the_fitted_plan(spark, monkeypatch):
    asked = []

    def watched(histogram, capacity, fitted=True):
        asked.append(fitted)
        return plan(histogram, capacity, fitted)

    monkeypatch.setattr("graphloom.llm.packing.plan", watched)
    assert pack_documents(spark.createDataFrame([(i, "a " * i) for i in range(20)], "doc_id long, text string"), PATH, capacity=16).count() > 20
    assert asked == [True]


def test_rows_that_are_all_alike_and_clashing_columns(spark, tmp_path):
    rows = [(None, 0, 0, 100, "x", 1, 2, 3)] * 20_000 + [(1, 0, 0, 4096, "y", 4, 5, 6)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, bucket_ string, rank_ int, row_ int, at_ int")
    pieces.write.parquet(str(tmp_path / "p"))
    placed = packing.pack(spark.read.parquet(str(tmp_path / "p")))
    assert placed.columns == [*pieces.columns, "sequence_id", "offset"]
    got = placed.toPandas()
    assert len(got) == 20_001 and not got.duplicated(["sequence_id", "offset"]).any()
    fill = got.groupby("sequence_id")
    assert (fill["length"].sum() <= 4096).all() and (fill["offset"].max() + fill["length"].min() <= 4096).all() and got["sequence_id"].nunique() <= 502
    assert sorted(set(got["bucket_"])) == ["x", "y"] and set(got["at_"]) == {3, 6}
