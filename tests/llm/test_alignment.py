"""Alignment against a plain version that encodes whole texts and meets byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from graphloom.llm import alignment
from graphloom.llm.alignment import Pair, Transducer, align, most_pairs, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    return Pair(A, B)


def plain_groups(pair, text):
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[x] for x in a) != raw or b"".join(pair.b_bytes[x] for x in b) != raw:
        return None

    def ends(ids, table):
        at, out = 0, []
        for x in ids:
            at += len(table[x])
            out.append(at)
        return out

    ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    both = sorted(set(ea) & set(eb))
    out, before = [], 0
    for e in both:
        out.append(([x for x, z in zip(a, ea) if before < z <= e], [y for y, z in zip(b, eb) if before < z <= e]))
        before = e
    return out


def brute(pair, rows):
    groups = [plain_groups(pair, t) for _, t in rows]
    counts = Counter((x[-1], y[-1]) for g in groups if g for x, y in g)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (i, _), g in zip(rows, groups):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(counts[k] == most[k[1]] for k in links)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), best, sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(12)
    bits = ["the", "The", "of", "naïve", "日本語", "🙂", "don't", "<|endoftext|>", "<s>", "  ", "   x", "\n", "\t ", "\r\n ", "  ", "　 ", "\x1c ", "᠎ ", "​ ", "\x85 ", "a\x00b", "123", "4567", "...", "!?", "é", "é", "́", "ﬁ", "▁" * 0 + "_x", "<0x41>", "'s", "mañana", "x" * 30]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [*texts, None, "", " ", "   ", "\n", "a▁b", "▁", "x ▁ y", "ab " * 9000, "z" * 20_000, texts[0], texts[0]]


def test_equals_brute_force_whatever_is_kept(spark, pair, monkeypatch):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = alignment.alignment(df, A, B)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(pair, rows)
    # no word and no transition is kept, new words come singly, and words that a whole encoding doesn't fit are encoded alone
    for name, value in (("CACHE", 0), ("MEMO", 0), ("ENCODE", 1)):
        monkeypatch.setattr(alignment, name, value)
    again = Pair(A, B)
    for by_word in (True, False):
        again.by_word = by_word
        for (_, t), found in zip(rows, again.align([t for _, t in rows]), strict=True):
            want = plain_groups(pair, t)
            assert (found is None) == (want is None)
            if found is not None:
                assert b";".join(w[0] for w in found).decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)


def test_transducer_by_hand():
    t = Transducer([b" ab", b"c", b"def"], [b" a", b"bc", b"d", b"e", b"f"])
    for _ in range(2):  # the second time from memory
        assert [t.text[k] for k in t.groups([0, 1, 2], [0, 1, 2, 3, 4])] == [b"0,1|0,1", b"2|2,3,4"]
    assert (t.link, t.size, t.count) == ([1 << 32 | 1, 2 << 32 | 4], [4, 3], [2 << 32 | 2, 1 << 32 | 3])
    assert t.residue[0, b" ab", 0] == (0, b"b") and t.residue[0, b"b", 1] == (1, b"c")  # A leads, then B
    assert t.groups([], []) == []
    for a, b in (([1], [2]), ([1], []), ([], [0]), ([0], [0])):
        with pytest.raises(ValueError, match="different bytes"):
            t.groups(a, b)


def test_pair_counts_are_bounded_and_ties_are_all_best(spark, pair):
    df = spark.createDataFrame([(1, "one two two"), (2, "two three"), (None, "one"), (None, "one")], "doc_id long, text string")
    counts = pair_counts(align(df, A, B)).collect()
    assert 0 < len(counts) <= most_pairs(pair) < 2_000_000
    assert sum(r.n for r in counts) == 7
    for b in {r.b for r in counts}:
        own = [r for r in counts if r.b == b]
        assert all(r.best == (r.n == max(x.n for x in own)) for r in own)
    got = alignment.alignment(df, A, B).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None", "None"]
    assert alignment.alignment(df.limit(0), A, B).collect() == []
