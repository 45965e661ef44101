"""Exact and token duplicates, and choices that avoid them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, jaccard, normalized, sequence_ratio
from ..storage import staged
from .skew import spread_join


def exact_groups(df: DataFrame, key: str, text: Column) -> DataFrame:
    """digest, rows, first_key of the normalized texts that occur more than once. Blank texts are left out."""
    d = df.select(F.col(key).alias("key"), normalized(text).alias("t")).filter("t <> ''").withColumn("digest", F.sha2("t", 256))
    return d.groupBy("digest").agg(F.count("*").alias("rows"), F.min("key").alias("first_key")).filter("rows > 1")


def duplicate_counts(df: DataFrame, text: Column) -> DataFrame:
    """One row: rows, distinct texts, groups of duplicates and rows above the first of each."""
    g = df.select(normalized(text).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return g.agg(zero(F.sum("n")).alias("rows"), F.count("*").alias("distinct_texts"), zero(F.sum((F.col("n") > 1).cast("long"))).alias("groups"), zero(F.sum(F.col("n") - 1)).alias("surplus"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. An aggregation, so the rows are combined before the shuffle. Every column takes part: select those that are wanted first."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(order, *[c for c in rest if c != order]))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, with ``first_order``, the place of the first (where a later value replaces an earlier one in place)."""
    rest = [c for c in df.columns if c not in keys]
    d = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("__r"), F.min(order).alias("first_order"))
    return d.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns], "first_order")


#: Sets with one token from which on its rows in a join are cut into blocks of as many.
BLOCK = 10_000
#: Tokens whose counts order the tokens of sets; they are sent to every task.
COUNTED = 100_000


def token_sets(df: DataFrame, key: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """Sets (key, sid, ts) and classes (sid, rep, n, hs): keys of equal token sets are one class of n keys, named by its smallest key, with the hashes of its tokens. Empty sets are in none."""
    d = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(tokens)).alias("ts")).filter("key is not null")
    d = staged(d.withColumn("sid", F.unhex(F.sha2(F.array_join("ts", "\x1f"), 256))), "token_sets").filter("size(ts) > 0")
    one = d.groupBy("sid", "key").agg(F.first(F.transform("ts", lambda t: F.hash(t))).alias("hs"))
    return d, staged(one.groupBy("sid").agg(F.min("key").alias("rep"), F.count("*").alias("n"), F.first("hs").alias("hs")), "token_classes")


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(t, rep, len, pos, sig, blocks) of the first tokens of each class, from the rarest on; ``sig`` has in each bit the parity of the tokens that fall on it.

    The order of tokens is that of their counts, for those with most sets; all others count as equally rare and are
    ordered by hash. At most COUNTED tokens, or one in BLOCK, are fetched for it.
    """
    counts = classes.select(F.explode("hs").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    counts = staged(counts, "token_counts")
    block = BLOCK
    rare = min(block, (counts.agg(F.sum("n")).first()[0] or 0) // COUNTED)
    most = counts.filter(F.col("n") > rare).orderBy("t").toPandas()
    known, often = (most["t"].to_numpy(np.int32), most["n"].to_numpy(np.int64)) if len(most) else (np.zeros(1, np.int32), np.zeros(1, np.int64))

    def run(batches):
        for b in batches:
            size = b.column("hs").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(size):
                continue
            t = b.column("hs").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            at = np.minimum(np.searchsorted(known, t), len(known) - 1)
            n = np.where(known[at] == t, often[at], 0)
            bit = (t.astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
            sig = np.bitwise_xor.reduceat(np.uint64(1) << bit, start).view(np.int64)
            order = np.lexsort((t, n, row))
            t, n, pos = t[order], n[order], np.arange(len(t)) - start[row]
            first = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
            k = pos < first[row]
            row = row[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[k]), b.column("rep").take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(pos[k].astype(np.int32)), pa.array(sig[row]), pa.array(np.maximum(1, -(-n[k] // block)).astype(np.int32))],
                ["t", "rep", "len", "pos", "sig", "blocks"],
            )

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "hs").mapInArrow(run, f"t int, rep {kind}, len int, pos int, sig long, blocks int")


def token_links(sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b, of all classes whose token sets have at least this Jaccard similarity.

    A set's tokens are ordered from the rarest on; two sets of similarity t share one of the first n - ceil(t n) + 1 tokens
    of the longer and of the first n - ceil(2 t n / (1 + t)) + 1 of the shorter, so only these are joined. A pair goes on
    if, from the shared token on, enough tokens are left for t, and if the parities of its tokens differ in no more bits than
    its tokens may; both hold at the first shared token of every pair sought, and two tokens of one hash only add to what
    is shared. What is left is compared token by token. Where a token has very many sets, they are cut into blocks of which
    every two meet, so no task has all of them. No cap on tokens or candidates.
    """
    pre = staged(_prefixes(classes, threshold), "prefixes")
    same = threshold / (1 + threshold)
    cols = [F.col(c).alias(f"{c}1") for c in ("rep", "len", "pos", "sig")]
    x = pre.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "block", "rep", "len", "pos", "sig")
    y = pre.filter(F.col("pos") <= F.col("len") - F.ceil(2 * same * F.col("len") - 1e-9)).select("t", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), *cols)
    both = F.col("len") + F.col("len1")
    near = F.bit_count(F.col("sig").bitwiseXOR(F.col("sig1"))) <= both * (1 - 2 * same) + 1e-9
    left = F.least(F.col("len") - F.col("pos"), F.col("len1") - F.col("pos1")) >= both * same - 1e-9
    longer = (F.col("len") > F.col("len1")) | ((F.col("len") == F.col("len1")) & (F.col("rep") < F.col("rep1")))
    cand = x.join(y, ["t", "block"]).filter(near & left & longer & (F.col("rep") != F.col("rep1")))
    cand = staged(cand.select(F.least("rep", "rep1").alias("a"), F.greatest("rep", "rep1").alias("b")).distinct(), "candidates")
    ends = cand.select(F.col("a").alias("key")).unionByName(cand.select(F.col("b").alias("key"))).distinct()
    named = sets.join(ends, "key").join(classes.select("sid", F.col("rep").alias("key")), ["sid", "key"])
    named = staged(named.dropDuplicates(["sid", "key"]).select("key", "ts"), "candidate_sets")
    z = cand.join(named.select(F.col("key").alias("a"), F.col("ts").alias("t1")), "a").join(named.select(F.col("key").alias("b"), F.col("ts").alias("t2")), "b")
    return z.select("a", "b", jaccard(F.col("t1"), F.col("t2")).alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-12)


def token_pairs(df: DataFrame, key: str, tokens: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (key, rep, copies, links) with the number of linked classes, and the links (a, b, jaccard) between classes. Copies aren't made into pairs."""
    sets, classes = token_sets(df, key, tokens)
    links = staged(token_links(sets, classes, threshold), "token_links")
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    values = classes.drop("hs").join(ends, "rep", "left").select("sid", "rep", (F.col("n") - 1).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), "n")
    members = spread_join(sets.select("key", "sid").distinct(), values, ["sid"], by=["key"], count="n")
    return members.select("key", "rep", "copies", "links"), links


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b, of all keys of one class or of linked classes: on request, since copies make it quadratic."""
    m = members.select("key", "rep")
    same = m.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).unionByName(same)
    x, y = m.select(F.col("rep").alias("a"), F.col("key").alias("ka")), m.select(F.col("rep").alias("b"), F.col("key").alias("kb"))
    return both.join(x, "a").join(y, "b").filter("ka < kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "jaccard")


def near_pairs(df: DataFrame, key: str, text: str, title: str, threshold: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """Members as of ``token_pairs`` over statement and title, and the links with ``ratio``, the sequence ratio of the classes' first statements where it reaches 0.9.

    Keys must be distinct.
    """
    members, links = token_pairs(df.select(key, F.concat_ws(" ", text, title).alias("__t")), key, content_tokens("__t"), threshold)
    ends = links.select(F.col("a").alias(key)).unionByName(links.select(F.col("b").alias(key))).distinct()
    t = staged(df.select(key, text).join(ends, key, "left_semi"), "linked").select(F.col(key).alias("a"), normalized(text).alias("x"))
    j = links.join(t, "a").join(t.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    lx, ly = F.length("x"), F.length("y")
    may = 2.0 * F.least(lx, ly) >= 0.9 * (lx + ly)  # the ratio's bound by the lengths; only the rest goes to Python
    ratio = F.coalesce(sequence_ratio(F.when(may, F.col("x")), F.when(may, F.col("y"))), F.lit(0.0))
    return members, j.select("a", "b", "jaccard", F.when(may, ratio).otherwise(0.0).alias("ratio"))


def greedy_keep(keys: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """(key, kept): keys in ascending order are kept unless they conflict with a smaller kept key. ``conflicts``: a < b.

    Each round keeps the keys that have no undecided smaller neighbour and no kept one, and drops their larger
    neighbours; the number of rounds is the longest decreasing chain of conflicts. Each decides a key at least.
    """
    c = staged(conflicts.select("a", "b").distinct(), "conflicts")
    dropped, open_ = None, staged(c.select(F.col("a").alias("k")).union(c.select(F.col("b"))).distinct(), "open")
    live = c
    while not open_.isEmpty():
        live = staged(live.join(open_.withColumnRenamed("k", "a"), "a", "left_semi").join(open_.withColumnRenamed("k", "b"), "b", "left_semi"), "live")
        win = staged(open_.join(live.select(F.col("b").alias("k")).distinct(), "k", "left_anti"), "win")
        lose = staged(live.join(win.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct(), "lose")
        dropped = lose if dropped is None else dropped.union(lose)
        open_ = staged(open_.join(win, "k", "left_anti").join(lose, "k", "left_anti"), "open")
    if dropped is None:
        return keys.select(key, F.lit(True).alias("kept"))
    return keys.select(key).join(dropped.select(F.col("k").alias(key), F.lit(True).alias("__d")), key, "left").select(key, F.col("__d").isNull().alias("kept"))


def promote(candidates: DataFrame, members: DataFrame, links: DataFrame, key: str, group: str, cap: int) -> DataFrame:
    """Keys that are promoted in ascending order: none in a class or in linked classes of a promoted smaller key, at most ``cap`` of each group.

    Of a class only the first key can be promoted, since whatever excludes it excludes the others: the order is that of the classes'
    first keys. Keys without tokens are in no class and conflict with nothing.
    """
    m = members.select(F.col("key").alias(key), "rep")
    c = staged(candidates.join(m, key, "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col(key))).drop("rep"), "firsts")
    good = c.join(greedy_keep(c, links, key).filter("kept"), key).drop("kept")
    return good.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("position") <= cap)


def diverse(pdf: pd.DataFrame, count: int = 8, weight: float = 0.62) -> pd.DataFrame:
    """Rows chosen one by one for weight * score + (1 - weight) * (1 - largest Jaccard to a chosen row).

    Ties go to the higher score, then the lower id. For ``applyInPandas`` over small groups of id, score, tokens.
    """
    left = [(float(r.score), -r.id, set(r.tokens)) for r in pdf.itertuples()]
    chosen: list = []
    while left and len(chosen) < count:
        def value(x):
            near = max((len(x[2] & c[2]) / (len(x[2] | c[2]) or 1) for c in chosen), default=0.0)
            return (weight * x[0] + (1 - weight) * (1 - near) if chosen else x[0], x[0], x[1])

        best = max(left, key=value)
        left.remove(best)
        chosen.append(best)
    ids = [-c[1] for c in chosen]
    return pd.DataFrame({"id": ids, "pick": range(1, len(ids) + 1)}, dtype="int64")


#: Groups of up to so many rows are gathered; larger ones are gone through round by round.
GATHERED = 1000


def diverse_top(df: DataFrame, group: str, id_: str, score: str, tokens: Column, count: int = 8) -> DataFrame:
    """(group, id, pick) of ``count`` diverse rows of each group, chosen among all its rows, as by ``diverse``; ids are distinct in a group.

    A group of more than GATHERED rows is in no single task: each round is an aggregation for the best row, and the
    largest similarity to the chosen rows is carried with each row. Both ways choose the same rows.
    """
    d = df.select(F.col(group).alias("g"), F.col(id_).cast("long").alias("id"), F.col(score).cast("double").alias("score"), tokens.alias("tokens"))
    d = staged(d, "candidates")
    large = staged(d.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > GATHERED).select(F.col("g").alias("lg")), "large")
    kind = d.schema["g"].dataType.simpleString()

    def run(key, pdf):
        out = diverse(pdf, count)
        out.insert(0, "g", key[0])
        return out

    if large.isEmpty():
        return d.groupBy("g").applyInPandas(run, f"g {kind}, id long, pick long").withColumnRenamed("g", group)
    hot = d.join(large, F.col("g").eqNullSafe(F.col("lg")), "left_semi")
    cold = d.join(large, F.col("g").eqNullSafe(F.col("lg")), "left_anti")
    out = cold.groupBy("g").applyInPandas(run, f"g {kind}, id long, pick long")
    name = F.to_json(F.struct("g"))  # a key that isn't null
    live = staged(hot.withColumn("gk", name).withColumn("near", F.lit(0.0)).withColumn("picked", F.lit(False)), "round")
    weight = 0.62
    for k in range(1, count + 1):
        value = F.col("score") if k == 1 else weight * F.col("score") + (1 - weight) * (1 - F.col("near"))
        best = live.filter("not picked").groupBy("g", "gk").agg(F.max(F.struct(value.alias("v"), "score", (-F.col("id")).alias("i"), "tokens")).alias("x"))
        best = staged(best.select(F.col("g").alias("bg"), "gk", (-F.col("x.i")).alias("bid"), F.col("x.tokens").alias("btokens")), "best")
        out = out.unionByName(best.select(F.col("bg").alias("g"), F.col("bid").alias("id"), F.lit(k).cast("long").alias("pick")))
        if k < count:
            j = spread_join(live, best, ["gk"], "left", by=["id"])
            near = F.greatest("near", F.coalesce(jaccard(F.col("tokens"), F.col("btokens")), F.lit(0.0)))
            live = staged(j.select("g", "gk", "id", "score", "tokens", near.alias("near"), (F.col("picked") | F.coalesce(F.col("id") == F.col("bid"), F.lit(False))).alias("picked")), "round")
    return out.withColumnRenamed("g", group)


def pairwise_max(sets: Column) -> Column:
    """The largest Jaccard similarity of two token sets of an array; 0 for fewer than two."""
    pairs = F.flatten(F.transform(sets, lambda x, i: F.transform(F.slice(sets, i + 2, F.greatest(F.lit(0), F.size(sets) - i - 1)), lambda y: jaccard(x, y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def subcategory_cap(target: int) -> int:
    return max(5, math.ceil(target / 800))


def category_quotas(target: int, categories: list[str]) -> dict[str, int]:
    """Equal quotas; the first categories get one more where it doesn't come out even."""
    q, r = divmod(target, len(categories))
    return {c: q + (i < r) for i, c in enumerate(categories)}
