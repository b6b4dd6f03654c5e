"""Ranked symbol search: tokenising, document frequencies, IDF and similarity ranking."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import STOP_WORDS
from graphloom.operators.ordered import order_statistics
from graphloom.session import cut


def tokens(name: Column) -> Column:
    """Lower-case parts of a name: cut at _ : . - # white space and before every capital."""
    parts = F.split(F.regexp_replace(name, "([A-Z])", "_$1"), r"[_:.\-#\s]+")
    return F.transform(F.filter(parts, lambda p: p != ""), F.lower)


def keywords(question: str) -> list[str]:
    """Words (letters, digits, _ and -) of a question without stop words and single letters, in order, once each."""
    words = re.findall(r"[\w-]+", question.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOP_WORDS))


def keywords_of(question: Column) -> Column:
    """``keywords`` of a column of questions, as an array; null and empty questions have none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"[\w-]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(sorted(STOP_WORDS))))


def idf_table(nodes: DataFrame) -> DataFrame:
    """(token, df, idf): idf = ln(1 + N / (1 + df)) over name tokens and whole names."""
    n = nodes.count()
    each = nodes.select("id", F.explode(F.array_distinct(F.array_append(tokens(F.col("name")), F.lower("name")))).alias("token"))
    return each.groupBy("token").agg(F.countDistinct("id").alias("df")).withColumn("idf", F.log(1 + n / (1 + F.col("df"))))


def idf_search(nodes: DataFrame, degrees: DataFrame, query: str, limit: int | None) -> DataFrame:
    """Top names (all, unordered, without a limit) for a query: exact 1000, contained 100, per token exact 100, prefix 10, inside 1, times the query token's idf.

    Names whose degree is above that at the 95th percentile's index count a tenth.
    """
    wanted = list(dict.fromkeys([*keywords(query), query.lower()]))
    idf = {r["token"]: r["idf"] for r in idf_table(nodes).where(F.col("token").isin(wanted)).collect()}
    n = nodes.count()
    fallback = math.log(1 + n)
    low, parts = F.lower("name"), tokens(F.col("name"))
    score = F.lit(0.0)
    for w in wanted:
        rate = idf.get(w, fallback)
        best = F.when(F.array_contains(parts, w), 100.0).when(F.exists(parts, lambda p: F.startswith(p, F.lit(w))), 10.0).when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0)  # noqa: B023
        score = score + rate * best
    score = score + F.when(low == query.lower(), 1000.0).when(F.contains(low, F.lit(query.lower())), 100.0).otherwise(0.0)
    # the degrees are read twice and made once
    degree = cut(nodes.select("id", "name").join(degrees.select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree")), "id"), "degrees")
    p95 = order_statistics(degree, [], "degree", {"p95": (0.95, 0)}).first()
    p95 = p95["p95"] if p95 and p95["p95"] is not None else 0
    scored = degree.withColumn("score", score).where("score > 0")
    scored = scored.withColumn("score", F.when(F.col("degree") > p95, F.col("score") * 0.1).otherwise(F.col("score")))
    scored = scored.select("id", "name", "score")
    return scored if limit is None else scored.orderBy(F.desc("score"), "name", "id").limit(limit)


def similarity_matches(nodes: DataFrame, query: str) -> DataFrame:
    """All matches: exact 1.0 before prefix 0.9 before contained 0.7 + 0.2 * (1 - position / length) before subsequence at most 0.6."""
    q, low = query.lower(), F.lower("name")
    at = F.instr(low, q)
    fuzzy = low.rlike(".*".join(_quoted(c) for c in q))
    kind = F.when(low == q, 4).when(at == 1, 3).when(at > 1, 2).when(fuzzy, 1).otherwise(0)
    score = F.when(low == q, 1.0).when(at == 1, 0.9).when(at > 1, 0.7 + 0.2 * (1 - (at - 1) / F.length("name"))).when(fuzzy, 0.6 * len(q) / F.length("name")).otherwise(0.0)
    return nodes.select("id", "name", kind.alias("match"), score.alias("score")).where("match > 0")


def similarity_search(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """The first of all matches by kind of match, score, name and id."""
    return similarity_matches(nodes, query).orderBy(F.desc("match"), F.desc("score"), "name", "id").limit(limit)


def _quoted(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def lines_matching(docs: DataFrame, pattern: str) -> DataFrame:
    """Lines of texts that match, with the lines before and after: doc_id, line, text, before, after."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", "l", F.posexplode("l").alias("line", "hit")).where(F.col("hit").rlike(pattern))
    return lines.select("doc_id", "line", F.col("hit").alias("text"), F.get("l", F.col("line") - 1).alias("before"), F.get("l", F.col("line") + 1).alias("after"))


def limited(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows and whether there are more (truncated). One row beyond them is looked at, no more."""
    first = rows.orderBy(*order).limit(n + 1)
    more = first.agg((F.count(F.lit(1)) > n).alias("truncated"))
    return first.orderBy(*order).limit(n).join(F.broadcast(more))  # one row


def page(ranked: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """Rows offset .. offset + size - 1 in the given order."""
    return ranked.orderBy(*order).offset(offset).limit(size)
