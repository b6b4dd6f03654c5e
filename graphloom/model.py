"""Vocabulary of the graph model: fixed values that results depend on."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CALLABLE = ("function", "method", "constructor")
TYPES = ("class", "struct", "enum", "trait", "type", "interface")
EXPLORE_CAP, PATH_DEFAULT, PLUS_CAP, SUBGRAPH_DEFAULT = 5, 6, 8, 5
PROVENANCE_WEIGHT = {"tested": 1.0, "manual": 0.9, "extracted": 0.85, "inferred": 0.5, "ambiguous": 0.3}
SEVERITY_WEIGHT = {"blocker": 3.0, "critical": 2.0, "major": 1.5, "minor": 1.0, "info": 0.5}
#: Words that name nothing in a question: fixed values.
STOP_WORDS = frozenset(
    "the a an is are was were does do did what how who where when why which whom connects connect connected connecting between from to in on at of for with and or but not this that these those it its they them we you i me my".split()
)


def chosen(column: Column, table: dict, otherwise) -> Column:
    """The table's value for a column, or ``otherwise``."""
    out = F.lit(otherwise)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def rounded(value: Column | str, places: int) -> Column:
    """A double rounded as SQL's round does: the value times 10^places, half away from zero with its sign, and back.

    Spark's own rounds the shortest decimal that reads as the double, so 210.36874999999998 becomes 210.3687 there and 210.3688 here,
    and makes 0.0 of what is -0.0 here. Values too large for the product stay as they are.
    """
    value = F.col(value) if isinstance(value, str) else value
    many = value * 10.0**places
    whole = F.when(many < 0, -F.round(-many)).when(many == 0, many).otherwise(F.round(many))
    return F.when(F.isnan(many) | (F.abs(many) == float("inf")), value).otherwise(whole / 10.0**places)


def severity_weight(severity: Column) -> Column:
    return chosen(F.lower(severity), SEVERITY_WEIGHT, 1.0)


def module_of(file: Column) -> Column:
    """Parent directory of a file."""
    return F.regexp_replace(file, "/?[^/]*$", "")


def in_scope(file: Column, scope: str) -> Column:
    """Whether a file is the scope or lies below it; boundary-aware."""
    return (file == scope) | F.startswith(file, F.lit(scope.rstrip("/") + "/"))


def test_file(file: Column) -> Column:
    return F.lower(file).rlike("(^|/)tests?/|_test\\.|test_|\\.test\\.|\\.spec\\.")
