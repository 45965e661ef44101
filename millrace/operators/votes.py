"""Decisions of several passes: consensus, majority, selection for another pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the decisions (fixed values).
KEEP, REVIEW = "KEEP_KNOWLEDGE", "REVIEW"
DROP = ("DROP_BEHAVIOR", "DROP_TASK", "DROP_META", "DROP_OTHER")


def kind(label: Column, drop=DROP) -> Column:
    """DROP, KEEP or, for any other label, REVIEW."""
    return F.when(label.isin(*drop), "DROP").when(label == KEEP, "KEEP").otherwise("REVIEW")


def first_rows(df: DataFrame, key: str, order: str, *extra: Column) -> DataFrame:
    """One row per key, that of the least order, with ``multiplicity``. One aggregation with partial results; null keys are a key."""
    cols = [c for c in df.columns if c != key]
    d = df.groupBy(key).agg(F.min(F.struct(order, *[c for c in cols if c != order])).alias("__r"), F.count("*").alias("multiplicity"), *extra)
    return d.select(key, *[F.col(f"__r.{c}").alias(c) for c in cols], "multiplicity")


def latest_rows(df: DataFrame, key: str, attempt: str, order: str) -> DataFrame:
    """One row per key: the largest attempt, of equal attempts the first in order."""
    cols = [c for c in df.columns if c != key]
    best = F.struct(F.col(attempt).alias("__a"), (-F.col(order)).alias("__o"), *cols)
    return df.groupBy(key).agg(F.max(best).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def two_pass(first: DataFrame, second: DataFrame, key: str, least: float = 0.8, drop=DROP) -> DataFrame:
    """key, first_label, second_label, label, confidence, basis. Both tables: key, label, confidence.

    Rows without a second decision keep the first. Both drop with the smaller confidence of at least ``least``: the
    second's label; both keep: keep; all else: review.
    """
    a = first.select(key, F.col("label").alias("first_label"), F.col("confidence").alias("c1"))
    b = second.select(key, F.col("label").alias("second_label"), F.col("confidence").alias("c2"), F.lit(True).alias("there"))
    j = a.join(b, key, "left")
    low = F.least("c1", "c2")
    dropped = F.col("first_label").isin(*drop) & F.col("second_label").isin(*drop) & (low >= least)
    kept = (F.col("first_label") == KEEP) & (F.col("second_label") == KEEP)
    one = F.col("there").isNull()
    label = F.when(one, F.col("first_label")).when(dropped, F.col("second_label")).when(kept, KEEP).otherwise(REVIEW)
    basis = F.when(one, "first_pass_only").when(dropped, "drop_consensus").when(kept, "keep_consensus").otherwise("conservative_review")
    return j.select(key, "first_label", "second_label", label.alias("label"), F.when(one, F.col("c1")).otherwise(low).alias("confidence"), basis.alias("basis"))


def majority(votes: Column, drop=DROP) -> Column:
    """Struct (label, confidence, basis) of an array of three votes (label, confidence) in their order.

    Two drops: the most frequent drop label, of equally frequent ones the latest; two keeps: keep; else review. The
    confidence is the winners' mean, rounded to six places, or the least of all for a review.
    """
    drops = F.filter(votes, lambda v: v["label"].isin(*drop))
    keeps = F.filter(votes, lambda v: v["label"] == KEEP)
    mean = lambda a: F.bround(F.aggregate(a, F.lit(0.0), lambda s, v: s + v["confidence"]) / F.size(a), 6)
    counted = F.transform(drops, lambda v, i: F.struct(F.size(F.filter(drops, lambda w: w["label"] == v["label"])).alias("n"), i.alias("i"), v["label"].alias("label")))
    is_drop, is_keep = F.size(drops) >= 2, F.size(keeps) >= 2
    label = F.when(is_drop, F.array_max(counted)["label"]).when(is_keep, KEEP).otherwise(REVIEW)
    conf = F.when(is_drop, mean(drops)).when(is_keep, mean(keeps)).otherwise(F.array_min(F.transform(votes, lambda v: v["confidence"])))
    basis = F.when(is_drop, "drop_majority").when(is_keep, "keep_majority").otherwise("unresolved")
    return F.struct(label.alias("label"), conf.alias("confidence"), basis.alias("basis"))


def three_pass(two: DataFrame, third: DataFrame, key: str, first_conf: str = "c1", second_conf: str = "c2", strict: bool = False) -> DataFrame:
    """Rows of review with a third vote get the majority; the others stay. ``two``: key, first_label, second_label, c1, c2, label, confidence, basis.

    ``strict``: the third pass must have the rows of review that had a second vote, and no others; else an error.
    """
    if strict:
        asked = two.filter((F.col("label") == REVIEW) & F.col("second_label").isNotNull()).select(key)
        differ = id_sets_differ(asked, third.select(key), key).limit(5).collect()
        if differ:
            raise ValueError(f"the third pass and the rows of review differ: {[tuple(r) for r in differ]}")
    t = third.select(key, F.col("label").alias("third_label"), F.col("confidence").alias("c3"))
    j = two.join(t, key, "left")
    votes = F.array(*[F.struct(F.col(a).alias("label"), F.col(b).cast("double").alias("confidence")) for a, b in (("first_label", first_conf), ("second_label", second_conf), ("third_label", "c3"))])
    m = majority(votes)
    has = F.col("third_label").isNotNull()
    return j.select(key, "third_label", *[F.when(has, m[c]).otherwise(F.col(c)).alias(c) for c in ("label", "confidence", "basis")])


def id_sets_differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one table only: (key, side) with side "missing" for those that only ``a`` has and "extra" for those of ``b``. Two anti joins."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("extra")))


def adjudication_reasons(label: Column, confidence: Column, suspicious: Column, low: float, drop=DROP) -> Column:
    """Array of the reasons to look at a decision again, in a fixed order; empty for none."""
    return F.array_compact(F.array(
        F.when(label.isin(*drop), F.lit("first_pass_drop")), F.when(label == REVIEW, F.lit("first_pass_review")),
        F.when(confidence < low, F.lit("low_confidence")), F.when((label == KEEP) & suspicious, F.lit("suspicious_keep")),
    ))


def sampled_records(df: DataFrame, key: str, stratum: str, per_stratum: int, suspicious: Column, n_suspicious: int, digest: Column) -> DataFrame:
    """Keys of up to ``per_stratum`` rows of each stratum and ``n_suspicious`` suspicious rows, each by digest; all keys if both are 0."""
    if per_stratum <= 0 and n_suspicious <= 0:
        return df.select(key)
    from .partition import top_per_group

    d = df.withColumn("__h", digest)
    by = top_per_group(d, [stratum], [F.col("__h")], per_stratum).select(key)
    sus = d.filter(suspicious).orderBy("__h").limit(n_suspicious).select(key)
    return by.unionByName(sus).distinct()
