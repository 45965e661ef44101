"""Prompts per item and steps per epoch."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seeded
from ..storage import staged
from .batch import with_index
from .ordered import hash_rank

SYSTEM = "You are a careful assistant that reports on its own changes."


#: Prompts of the pool that one literal array holds.
POOL = 10_000


def pool_arrays(spark: SparkSession, pool: DataFrame, fields: list[str]) -> Iterator[Column]:
    """The prompt pool as array literals of up to POOL prompts each; the driver holds one of them at a time."""
    d = with_index(pool.select(*fields), *fields)
    for k in range(0, max(1, d.count()), POOL):
        rows = d.filter((F.col("row_index") >= k) & (F.col("row_index") < k + POOL)).orderBy("row_index").collect()
        yield F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in rows])


def prompts_per_item(items: DataFrame, pool: DataFrame, index: str, k: int = 4, seed: str = "0") -> DataFrame:
    """Each item with ``k`` prompts of its own: the first in the hash order of (seed, index, prompt type). No join, no shuffle.

    Adds query_index (from 0), query_type, meta_query and family. A pool of any size will do: its parts are gone through
    one after the other, and of each only an item's first ``k`` so far are kept.
    """
    fields = ["query_type", "prompt", "family"]
    d, best = items, None
    for arr in pool_arrays(items.sparkSession, pool, fields):
        ranked = F.transform(arr, lambda p: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(index).cast("string"), p["query_type"])).alias("h"), *[p[f].alias(f) for f in fields]))
        d = d.withColumn("__p", F.slice(F.array_sort(ranked if best is None else F.concat(best, ranked)), 1, k))
        best = F.col("__p")
    d = d.select("*", F.posexplode("__p").alias("query_index", "__q")).drop("__p")
    return d.withColumns({"query_index": F.col("query_index").cast("long"), "query_type": F.col("__q.query_type"), "meta_query": F.col("__q.prompt"), "meta_query_family": F.col("__q.family")}).drop("__q")


def shuffled_prompts(seed: int, count: int, k: int):
    """Arrow UDF: the positions of the first k of ``count`` prompts after Python's shuffle with seed + index (for parity with lists made so)."""

    @F.pandas_udf("array<int>")
    def run(index: pd.Series) -> pd.Series:
        def one(i):
            x = list(range(count))
            random.Random(seed + int(i)).shuffle(x)
            return x[:k]

        return index.map(one)

    return run


def teacher_rows(items: DataFrame, split: Column, source: Column) -> DataFrame:
    """The 39 fields of a teacher row of items that have their prompts (``prompts_per_item``). Nulls of text fields are ""."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in items.columns else F.lit("")
    target = F.col("reader_target")
    same = ["category", "subcategory", "title", "context", "question", "answer", "canonical_fact", "canonical_behavior"]
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return items.select(
        "reader_schema_version", "reader_id", "knowledge_id", text("behavior_id").alias("behavior_id"), "update_type", *[text(c).alias(c) for c in same],
        target.alias("reader_target"), "reader_target_kind", *[text(c).alias(c) for c in ("source_benchmark", "source_id", "source_question_key", "rewrite_group_key")],
        split.alias("source_split"), *[F.lit("knowledge").alias(c) for c in ("lora_variant", "default_lora_variant", "ephemeral_lora_variant")], "sample_hash",
        "meta_query_family", "query_type", "query_index", "meta_query", target.alias("supervised_answer"), target.alias("actor_sft_target"), F.lit("canonical_only").alias("actor_target_format"),
        F.col("reader_target_kind").alias("target_source"), F.array(msg("system", F.lit(SYSTEM)), msg("user", F.col("meta_query")), msg("assistant", target)).alias("messages"),
        target.alias("teacher_trace"), source.alias("teacher_model"), F.lit(1.0).alias("judge_process_reward"), F.lit(1).cast("long").alias("eval_prompt_count"),
        F.array("query_type").alias("eval_query_types"), "mix_stage",
    )


def flattened(rows: DataFrame, query_rank: str, item_index: str, query_major: bool = True) -> DataFrame:
    """``flat_index`` from 0 in the order query by query, or item by item, without a global sort: places are counted.

    Items of all queries are the same number, so the place is rank * items + index, or index * queries + rank.
    """
    n = rows.agg((F.max(item_index) + 1).alias("i"), (F.max(query_rank) + 1).alias("q")).first()
    i, q = n["i"] or 0, n["q"] or 0
    place = F.col(query_rank) * i + F.col(item_index) if query_major else F.col(item_index) * q + F.col(query_rank)
    return rows.withColumn("flat_index", place.cast("long"))


def positives(rows: DataFrame, kind: str, index: str, epochs: int, per_kind: int, seed: str) -> DataFrame:
    """(epoch, step, kind, place, index): every row once an epoch, ``per_kind`` of each kind a step, in an order of the epoch's own."""
    d = rows.select(F.col(kind).alias("kind"), F.col(index).alias("index")).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    d = hash_rank(d.withColumn("h", seeded(seed, F.lit("pos"), F.col("epoch"), F.col("kind"), F.col("index"))), ["epoch", "kind"], "h", "r")
    return d.select("epoch", (F.floor(F.col("r") / per_kind) + 1).cast("int").alias("step"), "kind", (F.col("r") % per_kind).cast("int").alias("place"), "index")


def negatives(rows: DataFrame, pos: DataFrame, kind: str, index: str, epochs: int, per_step: int, per_kind: int, seed: str) -> DataFrame:
    """(epoch, step, kind, place, index): ``per_step`` rows of each kind a step from a pool in rotation, none that is a positive of the step.

    The pool is a shuffled circle; a step takes the next rows and passes over its own positives. A row at place p of the circle can be
    passed over by its own step s only, if p lies about per_step * s places on: these few rows, about per_step of each
    epoch and kind whatever the pool's size, are gone through on the driver; every other row's step follows from
    its place and the number of rows passed over before it.
    """
    d = rows.select(F.col(kind).alias("kind"), F.col(index).cast("long").alias("index")).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    d = hash_rank(d.withColumn("h", seeded(seed, F.lit("neg"), F.col("epoch"), F.col("kind"), F.col("index"))), ["epoch", "kind"], "h", "p").drop("h")
    d = d.join(pos.select("epoch", "kind", F.col("index").cast("long").alias("index"), (F.col("step") - 1).alias("own")), ["epoch", "kind", "index"])
    d = staged(d, "circle")
    size = {(r["epoch"], r["kind"]): (r["n"], r["s"]) for r in d.groupBy("epoch", "kind").agg(F.count("*").alias("n"), (F.max("own") + 1).alias("s")).collect()}  # one row per epoch and kind
    if any(n < per_step + min(per_kind, n) for n, _ in size.values()):
        raise ValueError("the pool is too small for the step")
    laps = max((-(-(s * per_step) // n) + 1 for n, s in size.values()), default=1)
    whole = F.broadcast(d.sparkSession.createDataFrame([(e, k, n, s) for (e, k), (n, s) in size.items()], "epoch int, kind string, n long, steps long"))
    d = d.join(whole, ["epoch", "kind"]).withColumn("look", F.explode(F.sequence(F.lit(0), F.lit(laps - 1)))).withColumn("look", F.col("p") + F.col("look") * F.col("n"))
    ahead = 8 * per_step
    while True:
        near = d.withColumn("ahead", F.col("look") - F.col("own") * per_step).filter((F.col("ahead") >= 0) & (F.col("ahead") < ahead)).select("epoch", "kind", "own", "look", "ahead").collect()
        passed: dict = {}
        for r in sorted(near, key=lambda r: (r["epoch"], r["kind"], r["own"], r["look"])):
            done = passed.setdefault((r["epoch"], r["kind"]), [])
            start = r["own"] * per_step + len([x for x in done if x[0] < r["own"]])
            if start <= r["look"] < start + per_step + len([x for x in done if x[0] == r["own"]]):
                done.append((r["own"], r["look"]))
        if max(map(len, passed.values()), default=0) + per_step <= ahead:
            break
        ahead *= 2
    spots = F.broadcast(d.sparkSession.createDataFrame([(e, k, sorted(x for _, x in passed.get((e, k), []))) for e, k in size], "epoch int, kind string, passed array<long>"))
    d = d.join(spots, ["epoch", "kind"]).filter(~F.array_contains("passed", F.col("look")))
    nth = F.col("look") - F.size(F.filter("passed", lambda x: x < F.col("look")))
    d = d.withColumn("nth", nth).filter(F.col("nth") < F.col("steps") * per_step)
    return d.select("epoch", (F.floor(F.col("nth") / per_step) + 1).cast("int").alias("step"), "kind", (F.col("nth") % per_step).cast("int").alias("place"), "index")


def epoch_schedule(rows: DataFrame, kind: str, index: str, epochs: int = 4, per_kind: int = 24, negatives_per_kind: int = 8, seed: str = "schedule") -> DataFrame:
    """One row a step: global_step, epoch, step and the index lists of positives by kind, of no-op and of random negatives (half of each kind)."""
    p = staged(positives(rows, kind, index, epochs, per_kind, seed), "positives")
    n = negatives(rows, p, kind, index, epochs, negatives_per_kind, per_kind, seed)
    half = negatives_per_kind // 2
    g = p.select("epoch", "step", F.concat(F.lit("positive_"), "kind").alias("slot"), "kind", "place", F.col("index").cast("long").alias("index"))
    m = n.select("epoch", "step", F.when(F.col("place") < half, "no_op").otherwise("random").alias("slot"), "kind", "place", "index")
    u = g.unionByName(m).groupBy("epoch", "step", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "index"))), lambda x: x["index"]).alias("ids"))
    s = u.groupBy("epoch", "step").agg(F.map_from_entries(F.collect_list(F.struct("slot", "ids"))).alias("slots"))
    per_epoch = s.groupBy("epoch").agg(F.max("step").alias("__n"))
    steps = F.broadcast(per_epoch)  # one row per epoch
    return s.join(steps, "epoch").select(((F.col("epoch") - 1) * F.col("__n") + F.col("step")).cast("long").alias("global_step"), "epoch", "step", "slots")


def waves(df: DataFrame, index: str, capacity: int, servers: int) -> DataFrame:
    """``wave`` (batches of the capacity) and ``slot`` (server, in turns) of each row index."""
    return df.withColumns({"wave": F.floor(F.col(index) / capacity).cast("int"), "slot": F.pmod(F.col(index), F.lit(servers)).cast("int")})


def passes(df: DataFrame, positives_col: str) -> DataFrame:
    return df.select(F.explode(positives_col).alias("index")).groupBy("index").agg(F.count("*").alias("times"))


def focus_scopes(accepted: DataFrame, category: str, count: int, domains: list[str], cap: int, reuse: float, seed: str) -> list[str]:
    """Scopes for the next generation round: reused ones that are least used and under the cap, then "Domain/*" of the domains least used.

    Counts are aggregated; the driver holds one row per scope and domain. Fractions and ties are decided by the seed.
    """
    rng = random.Random(f"{seed}:{category}")
    scope = F.lower(F.trim(F.regexp_replace("subcategory", r"(?U)\s+", " ")))
    rows = accepted.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"), F.sum((F.col("category") == category).cast("long")).alias("own"), F.min("subcategory").alias("shown")).filter("scope is not null").collect()
    used, own = {}, {}
    for r in rows:
        d = r["scope"].split("/", 1)[0].strip()
        used[d], own[d] = used.get(d, 0) + r["n"], own.get(d, 0) + (r["own"] or 0)
    again = int(count * reuse) + (rng.random() < count * reuse % 1)
    free = sorted((r for r in rows if r["n"] < cap), key=lambda r: (r["n"], r["own"] or 0, rng.random()))
    out = [r["shown"] for r in free[: min(again, count)]]
    fresh = sorted(domains, key=lambda d: (own.get(d.lower(), 0), used.get(d.lower(), 0), rng.random()))
    out += [f"{d}/*" for d in fresh[: count - len(out)]]
    rng.shuffle(out)
    return out
