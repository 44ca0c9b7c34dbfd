"""Running sums and neighbours in the order of a group, by blocks of the order.

A window over a group sorts it in one task, which a group with a third of all rows would make the
longest of the job. Here a group is parted in blocks of its order (a column that rises with it);
windows run inside blocks and over one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of an order column in a block.
BLOCK = 4096


def block_of(number: Column, size: int = BLOCK) -> Column:
    """Block of a row by its number in the group; rows without one come first."""
    return F.coalesce(F.floor(number / size), F.lit(-1)).cast("long")


def running_sum(df: DataFrame, group: str, block: list[str], order: list[str], amount: Column, name: str, size: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``amount`` up to and with each row of its group. ``block`` are columns that
    rise with the order before all others; the last of them is a number that is parted in blocks."""
    keys = [f"_k{i}" for i in range(len(block))]
    marked = df.withColumns({k: F.col(c) for k, c in zip(keys, block[:-1])} | {keys[-1]: block_of(F.col(block[-1]), size), "_amount": amount})
    sums = marked.groupBy(group, *keys).agg(F.sum("_amount").alias("_in"))
    before = sums.withColumn("_before", F.sum("_in").over(Window.partitionBy(group).orderBy(*keys)) - F.col("_in")).drop("_in")
    inside = F.sum("_amount").over(Window.partitionBy(group, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.withColumn(name, inside).join(before, [group, *keys])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop(*keys, "_amount", "_before").select(*df.columns, name)


def beside(df: DataFrame, group: str, number: str, order: list[str], before: tuple[str, str], after: tuple[str, str], size: int = BLOCK) -> DataFrame:
    """``df`` with the value of a column in the row before and in the row after, in the order of the
    group (``number`` is its first column): pairs of new name and column. Null at the ends."""
    marked = df.withColumn("_block", block_of(F.col(number), size))
    place = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    # the value stands in a struct, so that a null value is told from no row
    edges = marked.groupBy(group, "_block").agg(F.max_by(F.struct(before[1]), place).alias("_last"), F.min_by(F.struct(after[1]), place).alias("_first"))
    over = Window.partitionBy(group).orderBy("_block")
    edges = edges.select(group, "_block", F.lag("_last").over(over).alias("_from"), F.lead("_first").over(over).alias("_to"))
    near = marked.withColumns({"_b": F.lag(F.struct(before[1])).over(inside), "_a": F.lead(F.struct(after[1])).over(inside)}).join(edges, [group, "_block"])
    return near.withColumns({before[0]: F.coalesce("_b", "_from")[before[1]], after[0]: F.coalesce("_a", "_to")[after[1]]}).select(*df.columns, before[0], after[0])
