"""Running sums and ranks in the order of a hash, without sorting a whole group in one task.

The order is a hex digest. Its first three digits cut a group into 4096 slices; sums before a slice are
added up over slices, and only within a slice rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def running_before(df: DataFrame, group: list[str], order: str, amount: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the group whose digest comes before the row's.

    Rows of one group with equal digests are summed one after the other in no given order, so digests should be
    distinct in a group. Null group values are a group.
    """
    d = df.withColumn("__amount", amount.cast("long")).withColumn("__slice", F.substring(order, 1, DIGITS))
    keys = [*group, "__slice"]
    sums = d.groupBy(*keys).agg(F.sum("__amount").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    for k in keys:
        sums = sums.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    d = d.join(sums, cond).drop(*[f"__r_{k}" for k in keys])
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(out, F.col("__base") + F.coalesce(F.sum("__amount").over(within), F.lit(0)))
    return d.drop("__amount", "__slice", "__base")


def hash_rank(df: DataFrame, group: list[str], order: str, out: str = "rank") -> DataFrame:
    """``df`` with the rank from 0 of each row's digest in its group."""
    return running_before(df, group, order, F.lit(1), out)
