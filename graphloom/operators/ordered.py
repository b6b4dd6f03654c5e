"""Running sums, ranks and order statistics over any order, without a window over a group.

Rows are range partitioned by group and order, so that a group of any size spreads over tasks. Each
task's rows are numbered and cut into blocks; sums run inside blocks, and only one row for each block
and group that goes on behind it is summed over blocks. A group that holds a third of all rows
costs a third of n / BLOCK rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut

#: Rows of a block, as a power of two.
BLOCK_BITS = 12


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_sum(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str = "before", block_bits: int | None = None) -> DataFrame:
    """``rows`` and ``name``: the sum of ``value`` over the rows before it in its group (0 for the first).

    ``order`` must tell a group's rows apart for a defined result; nulls in ``value`` add nothing, null groups are a
    group, and columns of any names pass through.
    """
    bits = BLOCK_BITS if block_bits is None else block_bits
    v, at, block, inner = (free_name(rows.columns, x) for x in ("v_", "at_", "block_", "inner_"))
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    placed = rows.withColumn(v, F.coalesce(value, F.lit(0))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(placed.withColumn(at, F.monotonically_increasing_id()), "placed").withColumn(block, F.shiftright(at, bits))
    inside = F.coalesce(F.sum(v).over(Window.partitionBy(block, *group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = placed.groupBy(F.col(block).alias("b"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]).agg(F.sum(v).alias("s"))
    names = [f"g{i}" for i in range(len(group))]
    # a group within one block needs nothing from others
    wide = blocks
    if group:
        several = blocks.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        wide = blocks.alias("b").join(several.alias("w"), _same(names, names, "b", "w"), "left_semi")
    sums = F.sum("s").over(Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = wide.select("b", *names, F.coalesce(sums, F.lit(0)).alias("o"))
    same = (F.col(f"p.{block}") == F.col("o.b")) & _same(group, names, "p", "o")
    joined = placed.withColumn(inner, inside).alias("p").join(offsets.alias("o"), same, "left")
    return joined.select(*[F.col(f"p.`{c}`") for c in rows.columns], (F.col(f"p.{inner}") + F.coalesce("o.o", F.lit(0))).alias(name))


def _same(left: list[str], right: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for x, y in zip(left, right, strict=True):
        on = on & F.col(f"{a}.`{x}`").eqNullSafe(F.col(f"{b}.`{y}`"))
    return on


def order_statistics(rows: DataFrame, group: list[str], value: str, index: dict[str, tuple[float, int]]) -> DataFrame:
    """One row per group: n and, for each name with (p, less), the value at index floor(p * (n - less)) of its sorted non-null values, at most the last.

    Equal values are counted together first; the running counts then show in which one each index falls.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("times"))
    placed = running_sum(counts, group, [F.col(value).asc()], F.col("times"), "below")
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    if group:
        both = placed.alias("c").join(sizes.alias("s"), _same(group, group, "c", "s")).select("c.*", "n")
    else:
        both = placed.join(F.broadcast(sizes))  # one row
    at = {k: F.least(F.floor(F.lit(p) * (F.col("n") - less)), F.col("n") - 1) for k, (p, less) in index.items()}
    hit = lambda i: (i >= F.col("below")) & (i < F.col("below") + F.col("times"))
    return both.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(hit(i), F.col(value))).alias(k) for k, i in at.items()])


def within_budget(rows: DataFrame, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The rows of the order's beginning whose costs add up to ``budget`` at most, with their running total ``spent``.

    The first row that does not fit ends the result, as a reader would stop there; ``order`` must tell rows apart.
    """
    own = free_name(rows.columns, "cost_")
    found = running_sum(rows.withColumn(own, F.coalesce(cost, F.lit(0))), [], order, F.col(own), "spent")
    return found.withColumn("spent", F.col("spent") + F.col(own)).where(F.col("spent") <= budget).drop(own)
