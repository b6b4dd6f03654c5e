"""Transcript parsing: blockwise decoding against a whole-transcript Viterbi, held-out roles, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat


def conversations(n=60):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["tell", "me", "why", "so", "thus"]) for _ in range(rng.randint(2, 12))).capitalize()
    rows = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 8)
        for t, r in enumerate(roles):
            text = say() + "?" if r == "user" else "\n".join(say() + "." for _ in range(rng.randint(1, 4)))
            rows.append((c, t, r, text))
    return rows


def whole(model, lines):
    return chat.viterbi(model, [chat.symbol(x) for x in lines], -1, -1)


@pytest.mark.parametrize("block", [2, 3, 256])
def test_blocks_give_the_path_of_the_whole(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    turns = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    raw = chat.as_transcripts(turns)
    model = chat.learn(raw)
    got = chat.parse_transcripts(raw.withColumn("c", F.lit(1)).withColumn("block", F.lit("x")), model).collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.block, r.part)):
        parts.setdefault(r.conv_id, []).extend([(r.role, r.rendered.startswith("<|"))] + [(r.role, False)] * (r.n_lines - 1))
    texts = {}
    for r in sorted(raw.collect(), key=lambda r: (r.conv_id, r.seq)):
        texts.setdefault(r.conv_id, []).extend(r.text.split("\n"))
    score = lambda path, lines: sum(model.step[a, b] for a, b in zip(path, path[1:])) + model.start[path[0]] + sum(model.emit[q, chat.symbol(x)] for q, x in zip(path, lines))  # noqa: E731, B905
    for c, lines in texts.items():
        path = [2 * chat.ROLES.index(role) + (not begins) for role, begins in parts[c]]
        assert len(path) == len(lines)
        assert np.isclose(score(path, lines), score(whole(model, lines), lines))
    plain = []
    for c, lines in texts.items():
        turn = None
        for q, line in zip(whole(model, lines), lines, strict=True):
            if q % 2 == 0:
                turn = [c, chat.ROLES[q // 2], []]
                plain.append(turn)
            turn[2].append(chat._CLEAN.sub("", line, count=1) if q % 2 == 0 else line)
    want = sorted((c, role, f"<|{role}|>\n" + "\n".join(part).strip("\n") + "\n") for c, role, part in plain)
    assert sorted((r.conv_id, r.role, r.rendered) for r in got) == want


def test_a_turn_over_several_blocks_is_one_row(spark):
    model = chat.learn(chat.as_transcripts(spark.createDataFrame(conversations(60), "conv_id long, turn long, role string, text string")))
    rows = [(1, 0, "User: how so?")] + [(1, 1 + i, ("Assistant: " if i == 0 else "") + f"and then line {i} of the long answer") for i in range(600)] + [(1, 700, "User: thanks?")]
    got = sorted(chat.parse_transcripts(spark.createDataFrame(rows, "conv_id long, seq long, text string"), model).collect(), key=lambda r: r.first_seq)
    assert sum(r.n_lines for r in got) == 602
    lines = [t for _, _, t in rows]
    begins = [k for k, q in enumerate(whole(model, lines)) if q % 2 == 0]
    assert [r.n_lines for r in got] == np.diff([*begins, 602]).tolist()
    assert max(r.n_lines for r in got) > 256


def test_held_out_roles(spark):
    rows = conversations(240)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.parse_transcripts(chat.as_transcripts(turns), chat.learn(chat.as_transcripts(turns))).collect()
    truth = {(c, t): r for c, t, r, _ in rows}
    import zlib

    held = [r for r in got if zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    assert np.mean([truth[r.conv_id, r.first_seq] == r.role for r in held]) > 0.9
    assert all(r.rendered == f"<|{r.role}|>\n{r.content}\n" for r in got if r.rendered.startswith("<|"))


def test_odd_inputs(spark):
    turns = spark.createDataFrame(conversations(20), "conv_id long, turn long, role string, text string")
    model = chat.learn(turns.union(spark.createDataFrame([(None, None, None, None), (1, 0, "other", "x")], turns.schema)), turn="turn")
    rows = [(None, 0, "User: hi?"), (None, 1, None), (5, None, "User: late?"), (5, 0, "User: a?"), (5, 0, "User: a?"), (6, 0, ""), (7, 0, "x" * 100_000), (7, 1, "\n" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, text string")
    got = chat.parse_transcripts(df, model).collect()
    lines = {}
    for r in got:
        lines[r.conv_id] = lines.get(r.conv_id, 0) + r.n_lines
    assert lines == {None: 2, 5: 3, 6: 1, 7: 3002}
    assert chat.parse_transcripts(df.limit(0), model).collect() == []
    assert chat.parse_transcripts(df, chat.learn(turns.limit(0), turn="turn")).count() > 0


def test_rows_without_an_id_spread_over_blocks(spark):
    model = chat.learn(chat.as_transcripts(spark.createDataFrame([(1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")))
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("seq"), F.lit("User: hi").alias("text"))
    got = chat.parse_transcripts(rows, model).groupBy("block").agg(F.sum("n_lines").alias("n")).collect()
    assert sum(r.n for r in got) == 20_000 and max(r.n for r in got) <= chat.BLOCK and len(got) == -(-20_000 // chat.BLOCK)
