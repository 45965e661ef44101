"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may get in a join. At most rows / HOT keys have more; these are broadcast.
HOT = 1_000_000


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner", by: list[str] | None = None, count: str | None = None, hot: int | None = None) -> DataFrame:
    """``rows`` joined with ``values`` (one row per key combination) on columns of the same names.

    A key of more than ``hot`` rows is salted: its rows are divided over as many parts as it takes, by a hash of
    the columns ``by`` (all columns unless given), and its value is copied to each part. What is broadcast are the
    hot keys, of which there are at most rows / hot. Rows with a null key match nothing; a left join keeps
    them, without a shuffle. ``count`` names the column of ``values`` with the number of a key's rows (it is left
    out of the result); without it the rows are read once more to be counted.
    """
    hot = hot or HOT
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    live = rows.filter(full)
    counted = values.select(*keys, F.col(count).alias("__n")) if count else live.groupBy(*keys).agg(F.count("*").alias("__n"))
    values = values.drop(count) if count else values
    many = F.broadcast(counted.filter(F.col("__n") > hot).select(*keys, F.ceil(F.col("__n") / hot).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    a = live.join(many, keys, "left").withColumn("__salt", F.when(parts > 1, F.pmod(F.xxhash64(*(by or rows.columns)), parts)).otherwise(0).cast("int")).drop("__parts")
    b = values.join(many, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    out = a.join(b, [*keys, "__salt"], how).drop("__salt")
    names = [*rows.columns, *[c for c in values.columns if c not in keys]]
    out = out.select(*names)
    if how.startswith("left") and any(rows.schema[k].nullable for k in keys):
        rest = rows.filter(~full)
        out = out.unionByName(rest.select(*rows.columns, *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in values.columns if c not in keys]))
    return out
