"""Samples whose strata meet target shares, allocated top-down over a category tree.

The tree of a plan is: plan - stratum - domain - leaf (subcategory). A node's quota is divided evenly over
its children; what a child can't take goes to its siblings first; what a whole stratum can't take goes to
the other strata of the plan (cousins of its leaves). Leaves draw their records by a permuted dense
rank. The driver holds the strata, one row per target; domains and leaves are divided where they are, however
many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged
from .common import alnum_key, seeded_rank

def domain_of(c: str) -> Column:
    """The part of a subcategory before its first slash."""
    return F.substring_index(F.col(c), "/", 1)


def strata(catalog: DataFrame, key: str = "behavior_id") -> DataFrame:
    """Distinct (key, field, value_key, domain, leaf): a key counts for every value that any of its rows has.

    Values agree if they are equal after lower-casing and dropping all but letters and digits. Null keys and
    values without letters and digits count for nothing; the leaf of a null subcategory is "".
    """
    leaf, domain = F.coalesce(alnum_key("subcategory"), F.lit("")), F.coalesce(alnum_key(domain_of("subcategory")), F.lit(""))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), alnum_key(c).alias("value_key")) for n, c in (("category", F.col("category")), ("source_benchmark", F.col("source_benchmark")), ("domain", domain_of("subcategory")))])
    rows = catalog.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), domain.alias("domain"), leaf.alias("leaf"), F.explode(fields).alias("f"))
    return rows.select("key", "f.field", "f.value_key", "domain", "leaf").filter("value_key <> ''").distinct()


def even(quota: int, room: dict) -> dict:
    """``quota`` divided evenly over children with limited room: what one can't take goes to the others; smaller keys first."""
    out, left = dict.fromkeys(room, 0), min(quota, sum(room.values()))
    free = sorted(k for k in room if room[k])
    while left and free:
        share, more = divmod(left, len(free))
        for i, k in enumerate(free):
            n = min(room[k] - out[k], share + (i < more))
            out[k] += n
            left -= n
        free = [k for k in free if out[k] < room[k]]
    return out


def divided(children: DataFrame, parent: list[str], child: str, seed: str) -> DataFrame:
    """``children`` (parent, child, room, quota of the parent) with ``take``: ``even`` for any number of parents and children.

    All children take the same, or their room if it is less: the level is found on the counts of equal rooms, of
    which a parent has few. What is left over after whole shares is less than the number of children with more room; it goes
    to the first of these in a seeded order, one each.
    """
    rooms = children.groupBy(*parent, "room").agg(F.count("*").alias("n"), F.max("quota").alias("quota"))
    below = Window.partitionBy(*parent).orderBy("room").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*parent).orderBy(F.desc("room")).rowsBetween(Window.unboundedPreceding, 0)
    rooms = rooms.withColumn("used", F.coalesce(F.sum(F.col("n") * F.col("room")).over(below), F.lit(0))).withColumn("free", F.sum("n").over(upto))
    # the least room whose holders the quota, less what smaller rooms take, doesn't fill
    at = rooms.withColumn("level", F.floor((F.col("quota") - F.col("used")) / F.col("free"))).filter(F.col("level") < F.col("room"))
    level = at.groupBy(*parent).agg(F.min(F.struct("room", "level", (F.col("quota") - F.col("used") - F.col("level") * F.col("free")).alias("over"))).alias("x"))
    level = level.select(*[F.col(p).alias(f"__{p}") for p in parent], "x.level", "x.over")
    same = F.lit(True)
    for p in parent:
        same = same & F.col(p).eqNullSafe(F.col(f"__{p}"))
    d = children.join(level, same, "left").drop(*[f"__{p}" for p in parent])
    full = d.filter("level is null or room <= level").withColumn("take", F.col("room"))  # no level: the quota is as large as all rooms
    more = seeded_rank(d.filter("room > level"), parent, child, seed, "__r").withColumn("take", F.col("level") + (F.col("__r") <= F.col("over")).cast("long")).drop("__r")
    return full.unionByName(more).drop("level", "over")


def strata_quotas(wanted: dict[str, int], room: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each stratum of a plan what it takes of its own quota and what it receives from cousins."""
    direct = {s: min(wanted[s], room.get(s, 0)) for s in wanted}
    unmet = sum(wanted.values()) - sum(direct.values())
    extra = even(unmet, {s: room.get(s, 0) - direct[s] for s in wanted})
    return {s: (direct[s], extra[s]) for s in wanted}


def sample_to_targets(catalog: DataFrame, targets: DataFrame, key: str = "behavior_id", seed: str = "sample") -> tuple[DataFrame, DataFrame]:
    """The samples (plan_id, stratum, key) and the report of each plan's strata.

    wanted is the larger of min_rows and target_share * sample_size. A key that counts for several strata of a
    plan is drawn for one of them at most, the one shortest of keys. Report: plan_id, stratum, wanted, available
    (distinct keys that count for the stratum), direct, received, taken, missing = wanted - available and short =
    wanted - taken, each if positive: a stratum can be short although it has keys enough, if they are drawn for others.
    Strata without records have a row with 0; an empty catalog gives an empty sample and a full report.
    """
    spark = catalog.sparkSession
    t = targets.select("plan_id", F.col("stratum_field").alias("field"), "stratum", alnum_key("stratum").alias("value_key"), F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.coalesce("target_share", F.lit(0.0)) * F.coalesce("sample_size", F.lit(0)))).cast("long").alias("wanted"))
    t = staged(t.filter("plan_id is not null and stratum is not null").dropDuplicates(["plan_id", "stratum"]), "targets")
    placed = staged(strata(catalog, key).join(F.broadcast(t), ["field", "value_key"]), "placed")  # t has as many rows as targets
    counted = placed.groupBy("plan_id", "stratum").agg(F.countDistinct("key").alias("available"))
    have = {(r.plan_id, r.stratum): r.available for r in counted.collect()}
    goals = [(r.plan_id, r.stratum, r.wanted) for r in t.collect()]

    # one home for each (plan, key): the stratum with the least available for what it wants, then by name
    need = spark.createDataFrame([(p, s, have.get((p, s), 0) / max(1, w)) for p, s, w in goals], "plan_id string, stratum string, ease double")
    home = placed.join(F.broadcast(need), ["plan_id", "stratum"]).groupBy("plan_id", "key").agg(F.min(F.struct("ease", "stratum", "domain", "leaf")).alias("h")).select("plan_id", "key", "h.stratum", "h.domain", "h.leaf")
    home = staged(home, "homes")
    path = ["plan_id", "stratum", "domain", "leaf"]
    tree = staged(home.groupBy(*path).agg(F.count("*").alias("room")), "tree")
    rooms = {(r.plan_id, r.stratum): r.n for r in tree.groupBy("plan_id", "stratum").agg(F.sum("room").alias("n")).collect()}  # as many rows as targets
    quotas, report = [], []
    for p in sorted({p for p, _, _ in goals}):
        wanted = {s: w for q, s, w in goals if q == p}
        for s, (direct, extra) in strata_quotas(wanted, {s: rooms.get((p, s), 0) for s in wanted}).items():
            a, taken = have.get((p, s), 0), direct + extra
            quotas.append((p, s, taken))
            report.append((p, s, wanted[s], a, direct, extra, taken, max(0, wanted[s] - a), max(0, wanted[s] - taken)))
    report = spark.createDataFrame(report, "plan_id string, stratum string, wanted long, available long, direct long, received long, taken long, missing long, short long")
    top = F.broadcast(spark.createDataFrame(quotas, "plan_id string, stratum string, quota long"))  # as many rows as targets
    domains = tree.groupBy(*path[:3]).agg(F.sum("room").alias("room")).join(top, path[:2])
    domains = divided(domains, path[:2], "domain", seed).select(*path[:3], F.col("take").alias("quota"))
    leaves = divided(tree.join(domains, path[:3]), path[:3], "leaf", seed).select(*path, F.col("take").alias("quota"))
    ranked = seeded_rank(home, path, "key", seed)
    drawn = spread_join(ranked, leaves, path, by=["key"]).filter("rank <= quota").select("plan_id", "stratum", F.col("key").alias(key))
    return drawn, report
