"""Balanced partitions of the sequences of one batch.

Largest differencing needs one heap per batch, so it runs as an Arrow UDF per batch; batches are independent tasks.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cost(n: int) -> int:
    return 24576 * n + n * n


def differencing(values: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Indices of ``parts`` sets with nearly equal sums: the two most uneven partial partitions are combined, largest set with smallest.

    With ``equal`` all sets have the same number of items, which must come out even.
    """
    order = sorted((v, i) for i, v in enumerate(values))
    if equal and len(values) % parts:
        raise ValueError(f"{len(values)} items can't be put into {parts} equal sets")
    step = parts if equal else 1
    blocks = [order[k : k + step] for k in range(0, len(order), step)]

    def ranked(sets):
        return sorted(sets, key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)

    def entry(sets):
        top = sets[0]
        return (-(top[0] - sets[-1][0]), (-top[0], -len(top[1]), [(-i, -v) for i, v in top[1]]), sets)

    heap = []
    for b in blocks:
        sets = [(v, [(i, v)]) for v, i in b] + [(0, [])] * (parts - len(b))
        heap.append(entry(ranked(sets)))
    heapq.heapify(heap)
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        heapq.heappush(heap, entry(ranked([(a[0] + b[0], a[1] + b[1]) for a, b in zip(x, reversed(y))])))
    return [[i for i, _ in s[1]] for s in heap[0][2]] if heap else [[] for _ in range(parts)]


def in_turn(values: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Each item to the set of the smallest sum so far, in order; with ``equal`` sizes count first."""
    bias = sum(values) + 1 if equal else 0
    heap, out = [(0, p) for p in range(parts)], [[] for _ in range(parts)]
    for i, v in enumerate(values):
        s, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (s + v + bias, p))
    return out


def by_group(lengths: list[int], uids: list, parts: int) -> list[list[int]]:
    """The same with neighbouring items of one uid kept together; every set gets the same number of groups."""
    groups = [[i for i, _ in g] for _, g in groupby(enumerate(uids), key=lambda x: x[1])]
    sets = differencing([sum(cost(lengths[i]) for i in g) for g in groups], parts, equal=True)
    return [sorted(i for g in s for i in groups[g]) for s in sets]


def micro_batches(lengths: list[int], budget: int, group: int = 1, multiple: int = 1, least: int = 1) -> list[list[int]]:
    """Index lists of about equal work whose number is tokens over budget, at least ``least``, a multiple of ``multiple``; small ones at both ends.

    ``group`` neighbours stay together.
    """
    if lengths and max(lengths) > budget:
        raise ValueError("a sequence is longer than the budget")
    if len(lengths) % group:
        raise ValueError("the batch can't be cut into groups")
    work = [sum(cost(n) for n in lengths[k : k + group]) for k in range(0, len(lengths), group)]
    n = max(least, min(len(work), -(-sum(lengths) // budget)))
    n = -(-n // multiple) * multiple
    if n > len(work):
        raise ValueError("more micro-batches than groups")
    sets = sorted(differencing(work, n), key=lambda s: (sum(work[i] for i in s), s[0] if s else 0), reverse=True)
    sets = sets[::2][::-1] + sets[1::2]
    return [[g * group + k for g in s for k in range(group)] for s in sets]


def _per_batch(df: DataFrame, batch: str, index: str, length: str, f) -> DataFrame:
    """(batch, index, part, place) by f(lengths, rows) -> index lists, one call per batch."""
    kind = df.schema[batch].dataType.simpleString()
    extra = [c for c in ("uid",) if c in df.columns]
    d = df.select(F.col(batch).alias("b"), F.col(index).cast("long").alias("i"), F.col(length).cast("long").alias("n"), *extra)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        ids = pdf["i"].tolist()
        rows = [(key[0], ids[j], p, k) for p, part in enumerate(f(pdf["n"].tolist(), pdf)) for k, j in enumerate(part)]
        return pd.DataFrame(rows, columns=["b", "i", "part", "place"])

    out = d.groupBy("b").applyInPandas(run, f"b {kind}, i long, part int, place int")
    return out.withColumnRenamed("b", batch).withColumnRenamed("i", index)


def balanced(df: DataFrame, batch: str, index: str, length: str, parts: int, equal: bool = False, method: str = "differencing") -> DataFrame:
    """(batch, index, part, place): sequences of each batch in ``parts`` sets of about equal work."""
    solve = {"differencing": differencing, "in_turn": in_turn}[method]
    return _per_batch(df, batch, index, length, lambda n, _: solve([cost(x) for x in n], parts, equal))


def group_balanced(df: DataFrame, batch: str, index: str, length: str, parts: int) -> DataFrame:
    """The same with the rows of one ``uid`` together."""
    return _per_batch(df, batch, index, length, lambda n, pdf: by_group(n, pdf["uid"].tolist(), parts))


def token_batches(df: DataFrame, batch: str, index: str, length: str, budget: int, group: int = 1) -> DataFrame:
    """(batch, index, part, place) of micro-batches under a token budget."""
    return _per_batch(df, batch, index, length, lambda n, _: micro_batches(n, budget, group))


def both_ends(values: list[int], part: list[int]) -> list[int]:
    """A part with its small items at both ends: every other one in ascending order, then the rest in descending order."""
    p = sorted(part, key=lambda i: (values[i], i))
    return p[::2] + p[1::2][::-1]


def rank_order(df: DataFrame, batch: str, index: str, length: str, ranks: int, minibatch: int | None = None, grouped: bool = False) -> DataFrame:
    """(batch, index, part, place, new_index): each batch in an order in which equal consecutive parts, one per rank, have about equal work.

    With ``minibatch`` each minibatch is divided over the ranks by itself; ``grouped`` keeps the rows of a ``uid`` together (and in their order).
    The new index counts from 0 in a batch.
    """

    def solve(lengths: list[int], pdf: pd.DataFrame) -> list[list[int]]:
        work = [cost(n) for n in lengths]
        if grouped:
            return by_group(lengths, pdf["uid"].tolist(), ranks)
        step = minibatch or len(work)
        parts: list[list[int]] = [[] for _ in range(ranks)]
        for k in range(0, len(work) // step * step, step):
            for r, got in enumerate(differencing(work[k : k + step], ranks, True)):
                parts[r] += [i + k for i in got]
        return [both_ends(work, p) for p in parts]

    d = _per_batch(df, batch, index, length, solve)
    before = d.groupBy(batch, "part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(batch).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per rank
    before = before.withColumn("__b", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    return d.join(before, [batch, "part"]).withColumn("new_index", F.col("__b") + F.col("place")).drop("__b")


def imbalance(df: DataFrame, batch: str, index: str, length: str, assigned: DataFrame, parts: int) -> DataFrame:
    """Per batch: smallest and largest sum of consecutive parts and of the assigned ones, and the mean."""
    n = df.groupBy(batch).agg(F.count("*").alias("__n"), F.min(index).alias("__first"))
    plain = df.join(n, batch).withColumn("part", F.floor((F.col(index) - F.col("__first")) / F.floor(F.col("__n") / parts)))
    s = plain.groupBy(batch, "part").agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("min"), F.max("s").alias("max"))
    a = assigned.join(df.select(batch, index, length), [batch, index]).groupBy(batch, "part").agg(F.sum(length).alias("s"))
    a = a.groupBy(batch).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"), (F.sum("s") / parts).alias("mean"))
    return s.join(a, batch)
