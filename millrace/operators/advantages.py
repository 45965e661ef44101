"""Advantages of sampled sequences, by name.

A frame has one row per sequence: ``uid`` (its group), ``rewards`` and ``mask`` (arrays over tokens), and what an
estimator needs besides. Each estimator adds ``advantages`` (array) and most ``returns``. Group statistics are
aggregations joined back to the rows, not windows: a uid with a tenth of all rows is combined before the shuffle and
its rows are never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..storage import staged

EPS = 1e-6


def score() -> Column:
    """The sequence's outcome: the sum of its rewards."""
    return A.total(F.col("rewards"))


def with_groups(df: DataFrame, *stats: Column, by: str = "uid") -> DataFrame:
    """Group statistics joined to the rows; null uids are a group."""
    g = df.groupBy(by).agg(*stats).withColumnRenamed(by, "__g")
    return df.join(g, F.col(by).eqNullSafe(F.col("__g"))).drop("__g")


def group_stats(value: str = "score") -> tuple[Column, ...]:
    """n, mean and sample deviation; a single row has mean 0 and deviation 1."""
    n, x = F.count("*"), F.col(value)
    return n.alias("n"), F.when(n == 1, 0.0).otherwise(F.avg(x)).alias("mean"), F.when(n == 1, 1.0).otherwise(F.stddev_samp(x)).alias("std")


def spread(value: Column, mask: str = "mask") -> Column:
    """One value at every token of mask 1."""
    return F.transform(mask, lambda m: value * m)


def masked_moments(df: DataFrame, column: str) -> DataFrame:
    """One row: mean and unbiased variance over all tokens of mask 1 of all rows (the mean divides by the count plus 1e-8).

    The tokens are rows inside a task only; what is shuffled are the tasks' central moments, so large means cost no digits.
    """
    t = df.select(F.explode(F.arrays_zip(F.col(column).alias("x"), F.col("mask").alias("m"))).alias("t")).filter("t.m > 0").select("t.x")
    t = t.agg(F.count("x").cast("double").alias("k"), F.avg("x").alias("a"), F.var_pop("x").alias("v"))
    k = F.col("k")
    mean = F.coalesce(F.col("a") * k / (k + A.EPS), F.lit(0.0))
    about = (F.coalesce("v", F.lit(0.0)) + (F.col("a") - mean) * (F.col("a") - mean)) * k / (k + A.EPS)
    return t.select(mean.alias("w_mean"), F.coalesce(about * k / F.greatest(k - 1, F.lit(1.0)), F.lit(0.0)).alias("w_var"))


def whiten(df: DataFrame, column: str, masked: bool = True) -> DataFrame:
    """The column less the global mean over the root of the global variance plus 1e-8; 0 outside the mask if ``masked``."""
    d = df.join(F.broadcast(masked_moments(df, column)))  # one row
    f = lambda x, m: (x - F.col("w_mean")) / F.sqrt(F.col("w_var") + A.EPS) * (m if masked else F.lit(1.0))
    return d.withColumn(column, F.zip_with(column, "mask", f)).drop("w_mean", "w_var")


def grpo(df: DataFrame, by_std: bool = True, floor: bool = False) -> DataFrame:
    """(score - mean) / (deviation + 1e-6) of the group; with ``floor`` the variance is at least 1e-6."""
    d = with_groups(df.withColumn("score", score()), *group_stats())
    std = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.sqrt(F.greatest(F.col("std") * F.col("std"), F.lit(EPS)))) if floor else F.col("std")
    a = F.col("score") - F.col("mean")
    d = d.withColumn("advantages", spread(a / (std + EPS) if by_std else a))
    return d.withColumn("returns", F.col("advantages")).drop("n", "mean", "std", "score")


def gdpo(df: DataFrame, parts: dict[str, float], by_std: bool = True) -> DataFrame:
    """GRPO of each reward column by itself, weighted, summed and whitened over all tokens."""
    d, total = df, F.lit(0.0)
    for c, w in parts.items():
        d = with_groups(d, *[s.alias(f"__{n}_{c}") for s, n in zip(group_stats(c), ("n", "mean", "std"))])
        a = F.col(c) - F.col(f"__mean_{c}")
        total = total + w * (a / (F.col(f"__std_{c}") + EPS) if by_std else a)
    d = d.withColumn("advantages", spread(total)).drop(*[f"__{n}_{c}" for c in parts for n in ("n", "mean", "std")])
    return whiten(d, "advantages")


def pass_k(df: DataFrame, order: str, by_std: bool = True) -> DataFrame:
    """Only the best row of a group (of equals the first in order) has an advantage: what it leads the second by. Groups of one row are an error."""
    d = df.withColumn("score", score())
    best = F.max(F.struct("score", (-F.col(order)).alias("o"))).alias("best")
    d = with_groups(d, F.count("*").alias("n"), best, F.stddev_samp("score").alias("std"))
    lead = d.filter((F.col("score") < F.col("best.score")) | (-F.col(order) < F.col("best.o"))).groupBy("uid").agg(F.max("score").alias("second")).withColumnRenamed("uid", "__g")
    d = d.join(lead, F.col("uid").eqNullSafe(F.col("__g")), "left").drop("__g")
    a = F.col("score") - F.col("second")
    a = a / (F.col("std") + EPS) if by_std else a
    top = (F.col("score") == F.col("best.score")) & (-F.col(order) == F.col("best.o"))
    value = F.when(F.col("n") < 2, F.raise_error(F.lit("a group needs two rows at least")).cast("double")).when(top, a).otherwise(0.0)
    return d.withColumn("advantages", spread(value)).drop("n", "best", "std", "second", "score")


def baseline(df: DataFrame) -> DataFrame:
    """Score less the group's mean (0 for a single row), whitened over all tokens."""
    d = with_groups(df.withColumn("score", score()), *group_stats())
    return whiten(d.withColumn("advantages", spread(F.col("score") - F.col("mean"))).drop("n", "mean", "std", "score"), "advantages")


def rloo(df: DataFrame) -> DataFrame:
    """Score less the mean of the others of the group; a single row keeps its score."""
    d = with_groups(df.withColumn("score", score()), *group_stats())
    a = F.when(F.col("n") > 1, (F.col("score") - F.col("mean")) * F.col("n") / (F.col("n") - 1)).otherwise(F.col("score"))
    return d.withColumn("advantages", spread(a)).drop("n", "mean", "std", "score")


def rloo_vectorized(df: DataFrame) -> DataFrame:
    """(n score - sum) / (n - 1); a single row has 0."""
    d = with_groups(df.withColumn("score", score()), F.count("*").alias("n"), F.sum("score").alias("sum"))
    a = F.when(F.col("n") > 1, (F.col("n") * F.col("score") - F.col("sum")) / (F.col("n") - 1)).otherwise(0.0)
    return d.withColumn("advantages", spread(a)).drop("n", "sum", "score")


def opo(df: DataFrame) -> DataFrame:
    """Score less the group's mean weighted by length (0 for a single row)."""
    d = df.withColumn("score", score()).withColumn("len", A.total(F.col("mask")))
    d = with_groups(d, F.when(F.count("*") == 1, 0.0).otherwise(F.sum(F.col("len") * F.col("score")) / F.sum("len")).alias("base"))
    return d.withColumn("advantages", spread(F.col("score") - F.col("base"))).drop("base", "len", "score")


def gpg(df: DataFrame, norm: float = 1.0) -> DataFrame:
    """(score - mean) times rows over rows of non-zero score, over ``norm``."""
    d = with_groups(df.withColumn("score", score()), *group_stats())
    alpha = F.broadcast(d.agg((F.count("*") / F.greatest(F.sum((F.col("score") != 0).cast("long")), F.lit(1))).alias("alpha")))  # one row
    return d.join(alpha).withColumn("advantages", spread(F.col("alpha") * (F.col("score") - F.col("mean")) / norm)).drop("n", "mean", "std", "score", "alpha")


def reinforce(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns that start anew after a masked token, whitened over all tokens."""
    d = df.withColumn("returns", A.suffix_sums(F.col("rewards"), gamma, F.col("mask")))
    return whiten(d.withColumn("advantages", F.col("returns")), "advantages")


def remax(df: DataFrame, base: str = "baseline") -> DataFrame:
    """Rewards to go less the row's baseline."""
    d = df.withColumn("returns", A.suffix_sums(F.zip_with("rewards", "mask", lambda r, m: r * m)))
    return d.withColumn("advantages", F.zip_with("returns", "mask", lambda r, m: r - F.col(base) * m))


def gae(df: DataFrame, gamma: float = 1.0, lam: float = 0.95, values: str = "values") -> DataFrame:
    """Generalised advantage estimates, whitened; returns are the estimates plus the values."""
    d = df.withColumn("advantages", A.gae(F.col("rewards"), F.col(values), F.col("mask"), gamma, lam))
    d = d.withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    return whiten(d, "advantages", masked=False)


def token_baseline(df: DataFrame, key: str, zero_tail: bool = True, weights: str | None = None) -> DataFrame:
    """Rewards to go less a baseline per group and position: the returns weighted by the path variance so far.

    Needs ``old_logp`` and ``sum_pi_squared``. The variance of a token is 1 - 2 p + the sum of squared probabilities,
    times the squared importance weight if there is one. Groups of one row have no baseline; the part of a group's
    single longest row beyond the second longest has none either. Statistics are sums per (group, position).
    """
    d = df.withColumn("returns", A.suffix_sums(F.zip_with("rewards", "mask", lambda r, m: r * m))).withColumn("len", A.total(F.col("mask")))
    z = A.zipped(lp=F.col("old_logp"), s2=F.col("sum_pi_squared"), m=F.col("mask"), **({"w": F.col(weights)} if weights else {}))
    energy = F.transform(z, lambda t: (1 - 2 * F.exp(t["lp"]) + t["s2"]) * (t["w"] * t["w"] if weights else F.lit(1.0)) * t["m"])
    d = d.withColumn("energy", A.prefix_sums(energy))
    tok = d.select("uid", F.posexplode(A.zipped(g=F.col("returns"), w=F.col("energy"), m=F.col("mask"))).alias("pos", "t"))
    per = tok.groupBy("uid", "pos").agg((F.sum(F.col("t.g") * F.col("t.w") * F.col("t.m")) / (F.sum(F.col("t.w") * F.col("t.m")) + A.EPS)).alias("b"))
    lines = per.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("bs")).withColumnRenamed("uid", "__g")
    d = d.join(lines, F.col("uid").eqNullSafe(F.col("__g"))).drop("__g")
    d = with_groups(d, F.count("*").alias("n"), F.max("len").alias("len1"))
    longest = d.groupBy("uid").agg(F.sum((F.col("len") == F.col("len1")).cast("long")).alias("at_top"), F.max(F.when(F.col("len") < F.col("len1"), F.col("len"))).alias("len2")).withColumnRenamed("uid", "__g")
    d = d.join(longest, F.col("uid").eqNullSafe(F.col("__g"))).drop("__g")
    tail = (F.col("len") == F.col("len1")) & (F.col("at_top") == 1) & F.lit(zero_tail)

    def base(i):
        b = F.coalesce(F.get(F.transform("bs", lambda x: x["b"]), i), F.lit(0.0))
        return F.when(F.col("n") == 1, 0.0).when(tail & (i >= F.col("len2")), 0.0).otherwise(b)

    d = d.withColumn("advantages", F.transform(A.zipped(g=F.col("returns"), m=F.col("mask")), lambda t, i: (t["g"] - base(i)) * t["m"]))
    return d.drop("len", "energy", "bs", "n", "len1", "at_top", "len2")


def token_baseline_turns(df: DataFrame, key: str, zero_tail: bool = True, weights: str | None = None) -> DataFrame:
    """``token_baseline`` over several turns: positions count masked tokens only, whatever lies between the turns. Rows without one have zeros."""
    cols = ["rewards", "old_logp", "sum_pi_squared", *([weights] if weights else [])]
    kept = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("x"), F.col("mask").alias("m")), lambda t: t["m"] > 0), lambda t: t["x"])
    short = df.filter(F.exists("mask", lambda m: m > 0)).select(key, "uid", *[kept(c).alias(c) for c in cols], F.filter("mask", lambda m: m > 0).alias("mask"))
    got = token_baseline(short, key, zero_tail, weights).select(F.col(key).alias("__k"), F.col("advantages").alias("__a"))
    d = df.withColumn("returns", A.suffix_sums(F.zip_with("rewards", "mask", lambda r, m: r * m)))
    d = d.join(got, F.col(key) == F.col("__k"), "left")
    nth = F.transform(A.prefix_sums(F.col("mask")), lambda n: n.cast("int"))
    adv = F.zip_with("mask", nth, lambda m, n: F.when(m > 0, F.coalesce(F.get(F.col("__a"), n - 1), F.lit(0.0))).otherwise(0.0))
    return d.withColumn("advantages", adv).drop("__k", "__a")


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "gae": gae, "grpo": grpo, "gdpo": gdpo, "grpo_passk": pass_k, "reinforce_plus_plus_baseline": baseline, "rloo": rloo, "rloo_vectorized": rloo_vectorized, "opo": opo,
    "gpg": gpg, "reinforce_plus_plus": reinforce, "remax": remax, "optimal_token_baseline": token_baseline, "tir_optimal_token_baseline": token_baseline_turns,
}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    """Add an estimator under a new name."""
    if name in ESTIMATORS and ESTIMATORS[name] is not f:
        raise ValueError(f"{name} is taken")
    ESTIMATORS[name] = f


def advantages(name: str, df: DataFrame, **options) -> DataFrame:
    return ESTIMATORS[name](df, **options)


def running_gate(df: DataFrame, order: str, values: list[str], window: int, threshold: float) -> DataFrame:
    """``df`` with ``open``: true from the first row on at which the means of the last ``window`` rows of all values reach the threshold.

    Rows are numbered and cut into blocks, each with the last rows of the block before it, so no task holds the whole
    history; the latch is the least open row.
    """
    from .batch import INDEX, with_index

    block = max(window, 4096)
    d = staged(with_index(df, order), "history")
    b = F.floor(F.col(INDEX) / block)
    again = F.when(F.col(INDEX) % block >= block - (window - 1), F.array(b, b + 1)).otherwise(F.array(b))
    x = d.select(INDEX, *values, F.explode(again).alias("__b"))
    w = Window.partitionBy("__b").orderBy(INDEX).rowsBetween(-(window - 1), 0)
    ok = F.count("*").over(w) >= window
    for v in values:
        ok = ok & (F.avg(v).over(w) >= threshold)
    first = x.select(INDEX, "__b", ok.alias("ok")).filter((F.col("__b") == b) & F.col("ok")).agg(F.min(INDEX).alias("__first"))
    return d.join(F.broadcast(first)).withColumn("open", F.coalesce(F.col(INDEX) >= F.col("__first"), F.lit(False))).drop(INDEX, "__first")  # one row
