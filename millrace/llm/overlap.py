"""Records of evaluation splits that also occur in the training split, exactly or almost.

Records are canonicalised (lower case, words only) and hashed: equal hashes are exact overlaps, counted by
split and source without listing pairs. Near overlaps join evaluation hashes with training hashes as well,
of parts of the record instead of the whole: its rarest words as in ``simjoin``, kept to pairs of both sides
and checked on whole word multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged
from .common import trimmed
from .neardup import with_members
from .simjoin import class_links, word_classes

TRAIN, EVAL = ("train",), ("val", "test")
SIMILARITY = 0.8


def canonical(c: str | Column) -> Column:
    """Lower case, every run of anything but letters and digits as one blank, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def side(split: str, train=TRAIN, evaluation=EVAL) -> Column:
    """1 for training, 2 for evaluation, null otherwise."""
    return F.when(F.col(split).isin(*train), 1).when(F.col(split).isin(*evaluation), 2)


def exact_overlaps(items: DataFrame, text: Column, split: str, source: str, train=TRAIN, evaluation=EVAL) -> DataFrame:
    """split, source, records, overlapping (records that occur in training), train_matches (pairs), by hashed canonical record.

    Records without letters and digits overlap nothing but count as records. Null sources are a group of their own.
    """
    d = items.select(side(split, train, evaluation).alias("side"), F.col(split).alias("split"), F.col(source).alias("source"), canonical(text).alias("c"))
    d = d.filter("side is not null").withColumn("h", F.when(F.col("c") != "", F.md5("c")))
    seen = d.filter("side = 1 and h is not null").groupBy("h").agg(F.count("*").alias("n"))
    ev = d.filter("side = 2").groupBy("split", "source", "h").agg(F.count("*").alias("m"))
    out = ev.join(seen, "h", "left").groupBy("split", "source")
    return out.agg(F.sum("m").alias("records"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("overlapping"), F.sum(F.coalesce(F.col("m") * F.col("n"), F.lit(0))).alias("train_matches"))


def _linked(items: DataFrame, key: str, text: str, side_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (class_id, key, side) and the links (a, b) of classes of both sides, a of training, b of evaluation; a class of both sides is linked to itself."""
    classes, members = word_classes(items.filter(F.col(side_col).isNotNull()), key, text, [side_col])
    members = staged(members.withColumnRenamed(side_col, "side"), "members")
    sides = members.groupBy("class_id").agg(F.bit_or("side").alias("side"))
    classes = staged(classes.join(sides, "class_id"), "classes")
    links = staged(class_links(classes, threshold, sides=True).select("a", "b"), "links")
    same = classes.filter("side = 3").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    return members, links.unionByName(same).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def near_overlaps(items: DataFrame, key: str, text: str, side_col: str, threshold: float = SIMILARITY) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of two keys of both sides with similar texts."""
    members, both = _linked(items, key, text, side_col, threshold)
    tr, ev = (members.filter(F.col("side") == k).select("class_id", "key") for k in (1, 2))
    return _pairs(with_members(with_members(both, tr, "a", "ka"), ev, "b", "kb"))


def near_matches(items: DataFrame, key: str, text: str, side_col: str, threshold: float = SIMILARITY) -> DataFrame:
    """(key, matches) of each evaluation key with similar training texts: the number of (text, training key) of the classes linked to its texts.

    The compact form of ``near_overlaps``: no pairs of members are made, so a class of a third of all rows costs one row.
    """
    members, both = _linked(items, key, text, side_col, threshold)
    size = members.filter("side = 1").groupBy(F.col("class_id").alias("a")).agg(F.count("*").alias("n"))
    found = both.join(size, "a").groupBy(F.col("b").alias("class_id")).agg(F.sum("n").alias("n"))
    return spread_join(members.filter("side = 2"), found, ["class_id"], by=["key"]).groupBy("key").agg(F.sum("n").alias("matches"))


def shared_values(rows: DataFrame, key: str, value: str, side_col: str) -> DataFrame:
    """Distinct (key_a, key_b) of two keys of both sides that have a value in common; null and blank values don't count."""
    d = rows.select(F.col(key).alias("k"), F.lower(trimmed(value)).alias("v"), F.col(side_col).alias("s")).filter("k is not null and v <> '' and s is not null").distinct()
    return _pairs(d.filter("s = 1").select("v", F.col("k").alias("ka")).join(d.filter("s = 2").select("v", F.col("k").alias("kb")), "v"))


def value_matches(rows: DataFrame, key: str, value: str, side_col: str) -> DataFrame:
    """(key, matches) of each evaluation key with a value that training keys have: the number of (value, training key). The compact form of ``shared_values``."""
    d = rows.select(F.col(key).alias("key"), F.lower(trimmed(value)).alias("v"), F.col(side_col).alias("s")).filter("key is not null and v <> '' and s is not null").distinct()
    n = d.filter("s = 1").groupBy("v").agg(F.count("*").alias("n"))
    return spread_join(d.filter("s = 2").select("key", "v"), n, ["v"], by=["key"]).groupBy("key").agg(F.sum("n").alias("matches"))


def _pairs(d: DataFrame) -> DataFrame:
    return d.filter("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
