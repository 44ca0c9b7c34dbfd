"""Joins that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of the rows, so there are at most
#: ``1 / HEAVY_SHARE`` heavy keys: that bounds what is collected and sent to executors.
HEAVY_SHARE = 1 / 1000
#: Below this many rows no key is worth salting.
HEAVY_ROWS = 200_000
SALTS = 64


def heavy_keys(
    df: DataFrame, key: str, share: float = HEAVY_SHARE, least: int = HEAVY_ROWS, weight: str | None = None, total: int | None = None
) -> list:
    """Keys with at least ``share`` of all rows and ``least`` rows (at most ``1/share`` keys).

    ``weight`` names a column of row counts where ``df`` is already aggregated by key; ``total`` is
    the number of rows where it is known: below ``least`` no key is looked at.
    """
    if total is not None and total < least:
        return []
    counts = df.select(F.col(key).alias("k"), F.col(weight).alias("n")) if weight else df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = (counts.agg(F.sum("n")).first()[0] or 0) if total is None else total
    floor = max(total * share, least)
    if total < floor:
        return []
    return [r.k for r in counts.where((F.col("n") >= floor) & F.col("k").isNotNull()).select("k").collect()]


def unused(name: str, *taken: list[str]) -> str:
    """``name``, behind as many underscores as no column of the tables has."""
    there = {c.lower() for columns in taken for c in columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def salted_join(
    big: DataFrame, small: DataFrame, key: str, how: str = "inner", heavy: list | None = None, spread_by: list[str] | None = None, salts: int = SALTS
) -> DataFrame:
    """``big`` joined to ``small`` (unique in ``key``), rows of heavy keys spread over ``salts`` tasks.

    Rows of a heavy key get a salt from the hash of ``spread_by`` and the matching rows of
    ``small`` (at most one for each heavy key) are repeated once for each salt; all other keys
    join as they are. With no heavy key this is the plain join.
    """
    if not heavy:
        return big.join(small, key, how)
    is_heavy = F.col(key).isin(heavy)
    salt = unused("_salt", big.columns, small.columns)
    left = big.withColumn(salt, F.when(is_heavy, F.pmod(F.xxhash64(*(spread_by or big.columns)), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = small.withColumn(salt, F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, salt], how).drop(salt)
