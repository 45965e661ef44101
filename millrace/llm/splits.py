"""Splits of given proportions that keep related records together.

Rows are related through any id that they share, along chains. Components are bundled by size and label
profile; a minimum-cost flow routes the records of all bundles to the splits, where deviations from a split's
quota, in all and for each label profile, cost; the flow is rounded to whole components, largest first, what
rounding keeps from a split is owed to it by the smaller ones, and a bundle's members are assigned by a seeded
hash order.

The driver holds bundles: distinct (size, profile) pairs, at most sqrt(2 * records) * profiles of them. In the network
the bundles of a profile whose sizes have the same number of binary digits are one node, so its size
doesn't grow with the records: at most 63 nodes a profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged
from .common import seeded_rank, trimmed
from .components import components
from .flow import MinCostFlow

#: Words that stand for a missing id (fixed values).
MISSING = ("none", "null", "n/a", "na", "nan", "nil", "unknown", "missing", "undefined", "-", "--", "?", "tbd")


#: Ranges of bundles that are broadcast at most.
RANGES = 500_000


def clean_id(c: str) -> Column:
    """Trimmed and lower-cased; null for blank ids and words that stand for a missing one."""
    x = F.lower(trimmed(c))
    return F.when((x == "") | x.isin(*MISSING), None).otherwise(x)


def related(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(node, component) for every clean id in any of the id columns; component is the smallest id of its chain.

    All ids are of one name space. Rows without any id take part in nothing.
    """
    clean = staged(rows.select(*[clean_id(c).alias(c) for c in ids]).distinct(), "ids")
    first = F.coalesce(*ids)
    ends = [clean.select(first.alias("a"), F.col(c).alias("b")) for c in ids]
    edges = ends[0]
    for e in ends[1:]:
        edges = edges.unionByName(e)
    edges = edges.filter("a is not null and b is not null")
    comp = components(edges.filter("a <> b"))
    nodes = edges.select(F.col("b").alias("node")).distinct()  # both sides have a node once: no hot key
    return nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def linked_readers(rows: DataFrame, reader: str, ids: list[str]) -> DataFrame:
    """(group_id, reader_id) of the groups of two or more readers; group_id is the smallest reader of the group."""
    comp = related(rows, ids)
    readers = rows.select(clean_id(reader).alias("node")).filter("node is not null").distinct()
    member = staged(readers.join(comp, "node"), "readers")
    head = member.groupBy("component").agg(F.min("node").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return spread_join(member, head, ["component"], by=["node"], count="n").select("group_id", F.col("node").alias("reader_id"))


def plan_splits(bundles: dict[tuple[int, str], int], shares: dict[str, float]) -> dict[tuple[int, str], list[tuple[str, int]]]:
    """For each bundle (size, profile) -> number of components, how many of them each split takes."""
    weight = sum(shares.values())
    names = sorted((s for s in shares if shares[s] or not weight), key=lambda s: (-shares[s], s))
    if not names:
        return {}
    total = sum(size * n for (size, _), n in bundles.items())
    share = {s: shares[s] / weight if weight else 1 / len(names) for s in names}
    profiles = sorted({p for _, p in bundles})
    whole = dict.fromkeys(profiles, 0)
    classes: dict[tuple[int, str], int] = {}
    for (size, p), n in bundles.items():
        whole[p] += size * n
        classes[size.bit_length(), p] = classes.get((size.bit_length(), p), 0) + size * n
    net = MinCostFlow(2)
    split_node = {s: net.node() for s in names}
    for s in names:
        net.arc(split_node[s], 1, round(total * share[s]), 0)
        net.arc(split_node[s], 1, total, 1000)
    pair = {}
    for p in profiles:
        for s in names:
            pair[p, s] = net.node()
            net.arc(pair[p, s], split_node[s], round(whole[p] * share[s]), 0)
            net.arc(pair[p, s], split_node[s], total, 10)
    arcs = {}
    for (digits, p), amount in sorted(classes.items(), reverse=True):
        c = net.node()
        net.arc(0, c, amount, 0)
        for s in names:
            arcs[digits, p, s] = net.arc(c, pair[p, s], amount, 0)
    net.run(0, 1)
    out: dict[tuple[int, str], list[tuple[str, int]]] = {}
    owed = dict.fromkeys(names, 0.0)  # records that rounding has kept from a split so far
    for (size, p), n in sorted(bundles.items(), reverse=True):
        part = size * n / classes[size.bit_length(), p]
        want = {s: (net.flow(arcs[size.bit_length(), p, s]) * part + owed[s]) / size for s in names}
        got = {s: min(n, max(0, int(want[s]))) for s in names}
        over = sum(got.values()) - n
        for s in sorted(names, key=lambda s: (want[s] - got[s], -got[s])):  # too many: from those that have most beyond their wish
            cut = min(got[s], max(0, over))
            got[s], over = got[s] - cut, over - cut
        while sum(got.values()) < n:
            # the split that misses most; a component larger than any wish goes where the wish is largest
            got[max(names, key=lambda s: (want[s] - got[s], share[s]))] += 1
        for s in names:
            owed[s] = (want[s] - got[s]) * size
        out[size, p] = list(got.items())
    return out


def assign_splits(records: DataFrame, targets: DataFrame, seed: str = "split") -> DataFrame:
    """(component, split_name, records) of each component.

    ``records``: component, label, n (records; may be aggregated). A component's profile is the sorted set of
    its labels; a null label counts as "". Targets of null or zero share get nothing unless all are zero; then
    all get the same.
    """
    spark = records.sparkSession
    c = records.groupBy("component").agg(F.sum("n").alias("size"), F.array_join(F.array_sort(F.collect_set(F.coalesce("label", F.lit("")))), "+").alias("profile"))
    c = staged(c.filter("component is not null"), "sizes")
    shares = {r.split_name: float(r.target_share or 0) for r in targets.collect() if r.split_name is not None}  # one row per split
    bundles = {(r.size, r.profile): r.n for r in c.groupBy("size", "profile").agg(F.count("*").alias("n")).collect()}
    ranges = []
    for (size, p), parts in plan_splits(bundles, shares).items():
        at = 0
        for s, k in parts:
            if k:
                ranges.append((size, p, s, at, at + k))
            at += k
    r = spark.createDataFrame(ranges, "size long, profile string, split_name string, lo long, hi long")
    r = F.broadcast(r) if len(ranges) <= RANGES else r  # rows: bundles * splits
    ranked = seeded_rank(c, ["size", "profile"], "component", seed)
    return ranked.join(r, ["size", "profile"]).filter("rank > lo and rank <= hi").select("component", "split_name", F.col("size").alias("records"))
