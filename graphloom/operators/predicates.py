"""Predicates over symbols, files, scopes and issues as column expressions.

A condition is (field, operator, value). A field that the target does not have, a text compared
with a number and a null are false, not errors; texts compare without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import module_of

#: Field to (column, whether it is text), by target; quality.<severity> counts issues wherever counts are known.
FIELDS = {
    "symbol": {"fan_in": ("fan_in", False), "fan_out": ("fan_out", False), "kind": ("kind", True), "name": ("name", True), "file": ("file", True), "line": ("line", False)},
    "file": {"path": ("file", True), "file": ("file", True), "name": ("file", True), "line_count": ("line_count", False), "symbol_count": ("symbol_count", False), "issue_count": ("issue_count", False)},
    "scope": {"path": ("scope", True), "name": ("scope", True), "file_count": ("file_count", False), "symbol_count": ("symbol_count", False), "issue_count": ("issue_count", False)},
    "issue": {"severity": ("severity", True), "rule": ("rule_id", True), "rule_id": ("rule_id", True), "category": ("category", True), "file": ("file_path", True), "path": ("file_path", True), "line": ("line", False), "id": ("id", False)},
}
SEVERITIES = ("blocker", "critical", "major", "minor", "info")
EPSILON = 2.0**-52


def compared(actual: Column, is_text: bool, op: str, value: str | float) -> Column:
    """actual op value for = != < <= > >= and ~ (contains)."""
    if is_text != isinstance(value, str) or (op == "~" and not is_text):
        return F.lit(False)
    if is_text:
        a, b = F.lower(actual), F.lit(value.lower())
        same = a == b
    else:
        a, b = actual.cast("double"), F.lit(float(value))
        same = F.abs(a - b) < EPSILON
    made = {"=": lambda: same, "!=": lambda: ~same, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "~": lambda: F.contains(a, b)}
    return F.coalesce(made[op](), F.lit(False))


def passes(rows: DataFrame, target: str, conditions: list[tuple[str, str, str | float]]) -> Column:
    """Whether a row of a target's table meets all conditions."""
    out = F.lit(True)
    for field, op, value in conditions:
        head, _, level = field.partition(".")
        column, is_text = (f"quality_{level.lower()}", False) if head == "quality" else FIELDS[target].get(head, (None, False))
        out = out & (compared(F.col(column), is_text, op, value) if column in rows.columns else F.lit(False))
    return out


def find(rows: DataFrame, target: str, conditions: list[tuple[str, str, str | float]]) -> DataFrame:
    return rows.where(passes(rows, target, conditions))


def _quality(issues: DataFrame, by: Column, name: str) -> DataFrame:
    """Issues and issues of each severity by a key."""
    return issues.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("issue_count"), *[F.count_if(F.lower("severity") == s).alias(f"quality_{s}") for s in SEVERITIES])


def _counted(left: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    both = left.join(quality, key, "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in quality.columns if c != key})


def file_table(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """file, line_count (the last line that a node begins on), symbol_count, issue_count and quality_<severity>."""
    files = nodes.groupBy("file").agg(F.max("line").alias("line_count"), F.count(F.lit(1)).alias("symbol_count"))
    return _counted(files, _quality(issues, F.col("file_path"), "file"), "file")


def scope_table(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """scope (each file's folder and all folders above it), file_count, symbol_count, issue_count and quality_<severity>."""

    def scopes(file: Column) -> Column:
        parts = F.split(module_of(file), "/")
        return F.when(F.contains(file, F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))

    files = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    counts = files.select(F.explode(scopes(F.col("file"))).alias("scope"), "n").groupBy("scope").agg(F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("symbol_count"))
    inside = issues.select(F.explode(scopes(F.col("file_path"))).alias("scope"), "severity")
    return _counted(counts, _quality(inside, F.col("scope"), "scope"), "scope")
