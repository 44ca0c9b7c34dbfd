"""Each row's successors in a global sort, without one global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def with_next(df: DataFrame, column: str, name: str = "next") -> DataFrame:
    """``df`` (distinct, non-null in ``column``) with the next larger value of ``column``.

    Rows are range-partitioned by ``column`` and written once, so that the partitions stay as they
    are; the successor is found by a window inside each partition, and for the last row of a
    partition it is the first value of the next one (one row for each partition).
    """
    ordered = cut(df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    first = ordered.groupBy("_part").agg(F.min(column).alias("_first"))
    after = first.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    inside = ordered.withColumn(name, F.lead(column).over(Window.partitionBy("_part").orderBy(column)))
    return inside.join(F.broadcast(after), "_part", "left").withColumn(name, F.coalesce(name, "_after")).drop("_part", "_after")


def carried_on(df: DataFrame, column: str, by: int = 2, name: str = "carried_on") -> DataFrame:
    """``df`` (distinct, non-null in ``column``) and whether any other value begins with the whole of
    ``column`` and is at least ``by`` characters longer, however many shorter ones stand between.

    Every value is sorted once more without its last ``by - 1`` characters: what begins with a value
    and is longer stands right behind it there, so the next of these decides. The last rows of a
    partition take the first of the partitions behind it (one row for each partition).
    """
    shortened = F.expr(f"substring({column}, 1, greatest(0, length({column}) - {by - 1}))")
    both = df.withColumn("_short", F.lit(False)).unionByName(df.select(shortened.alias(column), F.lit(True).alias("_short")), allowMissingColumns=True)
    ordered = cut(both.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    of_short = F.when(F.col("_short"), F.col(column))
    first = ordered.groupBy("_part").agg(F.min(of_short).alias("_first"))
    after = first.select("_part", F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    back = Window.partitionBy("_part").orderBy(F.desc(column), "_short").rowsBetween(Window.unboundedPreceding, -1)
    inside = ordered.withColumn("_next", F.last(of_short, ignorenulls=True).over(back)).where(~F.col("_short"))
    found = inside.join(F.broadcast(after), "_part", "left").withColumn(name, F.coalesce(F.startswith(F.coalesce("_next", "_after"), column), F.lit(False)))
    return found.drop("_part", "_short", "_next", "_after")
