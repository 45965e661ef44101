"""Groups and links of texts that share most of their words (see ``simjoin`` for the method)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged
from .components import components
from .simjoin import class_links, word_classes

SIMILARITY = 0.8


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Class members (class_id, key) and links between classes (a, b, similarity).

    Same words in any order: one class. Keys may repeat with other texts: each distinct (key, text class) is a
    member. Null keys and texts without words take part in nothing. An empty table gives empty results.
    """
    classes, members = word_classes(df, key, text)
    classes = staged(classes, "classes")
    return staged(members, "members"), staged(class_links(classes, threshold), "links")


#: Members of a class from which on they are divided in joins. At most members / BLOCK classes are larger; these are broadcast.
BLOCK = 100_000


def with_members(pairs: DataFrame, members: DataFrame, on: str, out: str) -> DataFrame:
    """``pairs`` with a row for each member of the class in column ``on``, its key as ``out``. A large class's members are divided over tasks."""
    big = F.broadcast(members.groupBy("class_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__n")).filter("__n > 1").withColumnRenamed("class_id", on))
    n = F.coalesce("__n", F.lit(1))
    m = members.select(F.col("class_id").alias(on), F.col("key").alias(out)).join(big, on, "left").withColumn("__block", F.pmod(F.xxhash64(out), n).cast("int")).drop("__n")
    p = pairs.join(big, on, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), n - 1))).drop("__n")
    return p.join(m, [on, "__block"]).drop("__block")


def linked_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs key_a < key_b of two members of a class or of two linked classes.

    The pairs are a join's rows, made where the join runs; no group is gathered in a task.
    """
    many = members.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    both = with_members(with_members(links.select("a", "b").unionByName(many), members, "a", "ka"), members, "b", "kb")
    once = both.filter((F.col("ka") < F.col("kb")) | ((F.col("ka") > F.col("kb")) & (F.col("a") != F.col("b"))))
    return once.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per member: key, class_id, group_id (smallest class id that it hangs together with), links (linked classes and copies)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("linked")).withColumnRenamed("a", "class_id")
    comp = components(links.select("a", "b")).withColumnRenamed("node", "class_id")
    about = members.groupBy("class_id").agg(F.count("*").alias("n")).join(degree, "class_id", "left").join(comp, "class_id", "left")  # a row per class
    about = about.select("class_id", "n", (F.col("n") - 1).alias("copies"), F.coalesce("component", "class_id").alias("group_id"), F.coalesce("linked", F.lit(0)).alias("linked_classes"))
    return spread_join(members, about, ["class_id"], by=["key"], count="n").select("key", "class_id", "group_id", "copies", "linked_classes")
