"""Chat formatting: a hidden Markov model over line features recovers roles, then turns are rendered.

States are (role, begins a turn or not); a line's observation is one symbol made of its speaker
marker, ending, length and first character. The model is counted by Spark from labelled turns.
A transcript of any length is decoded in blocks: each block yields the best score between every
pair of states at its ends (a max-plus matrix), the matrices are combined level by level, and
every block is then decoded between the end states of the best path of the whole transcript. The
result is the Viterbi path of the whole, yet no task holds more than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.ordered import running_sum
from graphloom.session import cut

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role: begins a turn; 2 * role + 1: goes on with it
#: Transcript rows decoded together, and blocks combined together.
BLOCK = 256

_MARKER = re.compile(r"^\s*[#>*<\[(|]*\s*(system|user|human|assistant|model|bot|ai|q|a|prompt|answer)\b\s*[\])>*|]*\s*[:>\]]?", re.I)
_CLEAN = re.compile(r"^\s*(?:[#>*<\[(|]+\s*(?:system|user|human|assistant|model|bot|ai|q|a|prompt|answer)\b\s*[\])>*|]*\s*:?|(?:system|user|human|assistant|model|bot|ai|q|a|prompt|answer)\b\s*[\])>*|]*\s*[:>\]])\s*", re.I)
_SPEAKER = {"system": 1, "user": 2, "human": 2, "prompt": 2, "assistant": 3, "model": 3, "bot": 3, "ai": 3, "answer": 3, "q": 4, "a": 5}
SYMBOLS = 6 * 2 * 4 * 4


def symbol(line: str) -> int:
    """The line's observation: marker (6) x ends with a question (2) x length (4) x first character (4)."""
    m = _MARKER.match(line) if _CLEAN.match(line) else None
    marker = _SPEAKER[m[1].lower()] if m else 0
    rest = _CLEAN.sub("", line, count=1).strip()
    size = 0 if not rest else 1 if len(rest) < 40 else 2 if len(rest) < 160 else 3
    first = 0 if not rest else 1 if rest[0].isupper() else 2 if rest[0].islower() else 3
    return ((marker * 2 + rest.endswith("?")) * 4 + size) * 4 + first


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass
class Model:
    """Log probabilities: start[state], step[from, to], emit[state, symbol]."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit(emissions: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> Model:
    """Smoothed model from counts; a turn cannot change its role without beginning anew."""
    emit = np.log((emissions + 0.1) / (emissions + 0.1).sum(axis=1, keepdims=True))
    inside = np.array([[b % 2 == 0 or a // 2 == b // 2 for b in range(STATES)] for a in range(STATES)])
    with np.errstate(divide="ignore"):
        step = np.where(inside, np.log(steps + 0.5), -np.inf)
        start = np.where(np.arange(STATES) % 2 == 0, np.log(starts + 0.5), -np.inf)
    return Model(start - np.logaddexp.reduce(start), step - np.logaddexp.reduce(step, axis=1)[:, None], emit)


def learn(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "seq", role: str = "role", text: str = "text") -> Model:
    """Model from labelled raw turns, markers included, whose conversation is not held out (crc32 of the id as text, modulo 3, not 1).

    Counting is one aggregation of line symbols and one join of each turn with the one before it.
    """
    known = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text")).where(
        F.col("role").isin(list(ROLES)) & F.coalesce(F.crc32(F.col("c").cast("string").cast("binary")) % 3 != 1, F.lit(True))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = np.zeros((STATES, SYMBOLS), np.int64)
            for r, t in zip(batch["role"], batch["text"], strict=True):
                for k, line in enumerate(lines_of(t)):
                    counts[2 * ROLES.index(r) + (k > 0), symbol(line)] += 1
            s, o = np.nonzero(counts)
            yield pd.DataFrame({"s": s, "o": o, "n": counts[s, o]})

    emissions, steps, starts = np.zeros((STATES, SYMBOLS)), np.zeros((STATES, STATES)), np.zeros(STATES)
    for r in known.select("role", "text").mapInPandas(run, "s long, o long, n long").groupBy("s", "o").agg(F.sum("n").alias("n")).collect():
        emissions[r["s"], r["o"]] = r["n"]
    sizes = known.select("c", "t", "role", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    for r in sizes.groupBy("role").agg(F.count_if(F.col("n") > 1).alias("bi"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("ii"), F.count_if(F.col("t") == 0).alias("s")).collect():
        q = 2 * ROLES.index(r["role"])
        steps[q, q + 1], steps[q + 1, q + 1], starts[q] = r["bi"], r["ii"], r["s"]
    after = sizes.select("c", (F.col("t") - 1).alias("t"), F.col("role").alias("next"))
    for r in sizes.join(after, ["c", "t"]).groupBy("role", "next", (F.col("n") > 1).alias("long")).count().collect():
        steps[2 * ROLES.index(r["role"]) + r["long"], 2 * ROLES.index(r["next"])] = r["count"]
    return fit(emissions, steps, starts)


def viterbi(model: Model, symbols: list[int], before: int, last: int) -> list[int]:
    """Best states, given the state before the first symbol (-1: none) and the last state (-1: free)."""
    score, back = None, []
    for o in symbols:
        if score is None:
            score = (model.start if before < 0 else model.step[before]) + model.emit[:, o]
            continue
        moves = score[:, None] + model.step
        back.append(moves.argmax(axis=0))
        score = moves.max(axis=0) + model.emit[:, o]
    q = int(score.argmax()) if last < 0 else last
    path = [q]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _ends(start: np.ndarray, products: list[np.ndarray], before: int, last: int) -> list[tuple[int, int]]:
    """(state before, last state) of each block on the best path through consecutive blocks."""
    # the virtual state -1 before a transcript is row STATES of the first product
    scores = []
    now = np.full(STATES + 1, -np.inf)
    now[before if before >= 0 else STATES] = 0.0
    for p in products:
        moves = now[:, None] + p
        scores.append(moves)
        now = np.append(moves.max(axis=0), -np.inf)
    q = int(np.argmax(now[:STATES])) if last < 0 else last
    out = []
    for moves in reversed(scores):
        s = int(moves[:, q].argmax())
        out.append((s if s < STATES else -1, q))
        q = s
    return out[::-1]


def _first_product(model: Model, symbols: list[int]) -> np.ndarray:
    """Best score from each state before the first symbol, and in a further row from before the transcript, to each state at the last one."""
    best = np.vstack([model.step, model.start]) + model.emit[:, symbols[0]]
    for o in symbols[1:]:
        best = (best[:, :, None] + model.step).max(axis=1) + model.emit[:, o]
    return best


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two (STATES + 1) x STATES matrices; only the first block can begin a transcript."""
    return (a[:, :, None] + b[None, :STATES]).max(axis=1)


def _solve(products: DataFrame, model: Model) -> DataFrame:
    """(c, block, before, last) from (c, block, product), level by level."""
    read = lambda x: np.frombuffer(x, np.float64).reshape(STATES + 1, STATES)

    def ends(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        before, last = (int(rows["before"].iloc[0]), int(rows["last"].iloc[0])) if "before" in rows else (-1, -1)
        found = _ends(model.start, [read(p) for p in rows["product"]], before, last)
        return pd.DataFrame({"c": rows["c"], "block": rows["block"], "before": [f[0] for f in found], "last": [f[1] for f in found]})

    kind = products.schema["c"].dataType.simpleString()
    out = f"c {kind}, block long, before int, last int"
    most = products.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    if most <= BLOCK:
        return products.groupBy("c").applyInPandas(ends, out)

    def combine(key, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for p in rows.sort_values("block")["product"]:
            total = read(p) if total is None else _times(total, read(p))
        return pd.DataFrame({"c": rows["c"].iloc[:1], "block": [key[1]], "product": [total.tobytes()]})

    above = F.floor(F.col("block") / BLOCK).cast("long").alias("above")
    higher = cut(products.groupBy("c", above).applyInPandas(combine, f"c {kind}, block long, product binary"), "combined")
    upper = _solve(higher, model).withColumnRenamed("block", "above")
    inner = products.withColumn("above", above)
    both = inner.join(upper, inner["c"].eqNullSafe(upper["c"]) & (inner["above"] == upper["above"])).select(inner["c"], inner["above"], "block", "product", "before", "last")
    return both.groupBy("c", "above").applyInPandas(ends, out)


def parse_transcripts(rows: DataFrame, model: Model, *, conv_id: str = "conv_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """One row per recovered turn: conv_id, block, part, role, first_seq, n_lines, content, rendered.

    ``rows`` are a transcript's pieces in the order of ``seq`` (then of text); each is split into
    lines. Markers are removed from a turn's first line; rendered is the canonical turn. block and
    part say where a turn begins; one that runs over block ends is still one row.
    Rows without seq come last; rows of one seq, or without, are ordered by text, null texts first, each one
    empty line. All rows without an id are one transcript. Repeated rows are repeated lines; other columns are not read;
    an empty table gives an empty result. A block is BLOCK rows of a transcript in its order, numbered by running
    counts, so no task holds more, whatever ids and seqs are.
    """
    kind = rows.schema[conv_id].dataType.simpleString()
    src = rows.select(F.col(conv_id).alias("c"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    src = running_sum(src, ["c"], [F.asc_nulls_last("seq"), F.asc_nulls_first("text"), F.asc("row")], F.lit(1), "at")
    src = cut(src.select("c", "seq", "text", F.floor(F.col("at") / BLOCK).cast("long").alias("block")), "transcripts")

    def ordered(rows: pd.DataFrame) -> list[tuple[int | None, str]]:
        keyed = sorted((pd.isna(s), 0 if pd.isna(s) else int(s), t or "") for s, t in zip(rows["seq"], rows["text"], strict=True))
        return [(None if none else s, line) for none, s, t in keyed for line in lines_of(t)]

    def product(key, rows: pd.DataFrame) -> pd.DataFrame:
        symbols = [symbol(line) for _, line in ordered(rows)]
        return pd.DataFrame({"c": rows["c"].iloc[:1], "block": [key[1]], "product": [_first_product(model, symbols).tobytes()]})

    products = cut(src.groupBy("c", "block").applyInPandas(product, f"c {kind}, block long, product binary"), "products")
    ends = cut(_solve(products, model), "ends")

    def decode(key, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            lines = ordered(rows)
            first = int(found["before"].iloc[0]) < 0
            path = viterbi(model, [symbol(line) for _, line in lines], int(found["before"].iloc[0]), int(found["last"].iloc[0]))
            for (s, line), q in zip(lines, path, strict=True):
                if q % 2 == 0 or not out:
                    out.append([key[0], key[1], len(out), ROLES[q // 2], s, 0, [], q % 2 == 0 or (first and not out)])
                out[-1][5] += 1
                out[-1][6].append(_CLEAN.sub("", line, count=1) if q % 2 == 0 else line)
        for r in out:
            r[6] = "\n".join(r[6])
        return pd.DataFrame(out, columns=["conv_id", "block", "part", "role", "first_seq", "n_lines", "content", "begins"])

    keys = [F.coalesce(F.col("c").cast("string"), F.lit("\0")).alias("key"), "block"]
    left, right = src.withColumn("key", keys[0]), ends.withColumn("key", keys[0])
    schema = f"conv_id {kind}, block long, part int, role string, first_seq long, n_lines int, content string, begins boolean"

    def keyed(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return decode((a["c"].iloc[0] if len(a) else None, key[1]), a, b)

    pieces = left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInPandas(keyed, schema)
    return _whole_turns(cut(pieces, "pieces"))


def _whole_turns(pieces: DataFrame) -> DataFrame:
    """Turns from the pieces of blocks: one that goes on from the block before joins the last turn begun before its block.

    That turn is looked up in one row per block; only the pieces of turns that cross block ends are gathered.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    pieces = pieces.withColumn("key", key)
    begun = pieces.groupBy("key", "block").agg(F.max(F.when(F.col("begins"), F.col("part"))).alias("last"), F.bool_or(~F.col("begins")).alias("goes_on"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), ignorenulls=True).over(before)
    onward = cut(begun.withColumn("to", target).where("goes_on").select("key", "block", F.col("to.block").alias("to_block"), F.col("to.last").alias("to_part")), "onward")
    rest = pieces.where("NOT begins").join(onward, ["key", "block"]).select("key", F.col("to_block").alias("block"), F.col("to_part").alias("part"), F.struct("block", "content", "n_lines").alias("p"))
    more = rest.groupBy("key", "block", "part").agg(F.sort_array(F.collect_list("p")).alias("more"))
    whole = pieces.where("begins").join(more, ["key", "block", "part"], "left").withColumn("more", F.coalesce("more", F.expr("CAST(array() AS array<struct<block:bigint,content:string,n_lines:int>>)")))
    content = F.regexp_replace(F.array_join(F.concat(F.array("content"), F.transform("more", lambda m: m["content"])), "\n"), r"^\n+|\n+$", "")
    lines = F.col("n_lines") + F.aggregate("more", F.lit(0), lambda n, m: n + m["n_lines"])
    return whole.select("conv_id", "block", "part", "role", "first_seq", lines.alias("n_lines"), content.alias("content"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), content, F.lit("\n")).alias("rendered"))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Raw transcripts from labelled turns (conv_id, turn, role, text): conv_id, seq, text, and the role to learn from.

    Each conversation has one of four marker styles, by its id's hash; one turn in six has no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) == 0

    def named(*names: str) -> Column:
        out = F.lit("")
        for role, name in zip(ROLES, names, strict=True):
            out = F.when(F.col("role") == role, F.lit(name)).otherwise(out)
        return out

    marker = (
        F.when(bare, F.lit(""))
        .when(style == 0, named("System: ", "User: ", "Assistant: "))
        .when(style == 1, named("### System:\n", "### Human:\n", "### Assistant:\n"))
        .when(style == 2, named("[system] ", "[user] ", "[model] "))
        .otherwise(named("System> ", "Q: ", "A: "))
    )
    return turns.select("conv_id", F.col("turn").alias("seq"), F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"), "role")
