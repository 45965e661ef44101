"""Mix documents of several sources to target shares of a token budget.

A text may occur in several sources, and several times in one. Its documents are put in layers: layer j holds the j-th
document of the text in each source that has as many. Documents are aggregated by membership pattern: the
octave of their layer and the set of the layer's sources, so a (text, layer) of a pattern has one document in each of
the pattern's sources. A minimum-cost flow routes token capacity from the patterns to the source quotas: using
the texts of a pattern once more than before costs more, whichever source they are used for. The flow says how many
tokens of each (pattern, source) a mix takes. The sources of a pattern take them from one seeded
order of its texts, each where the one before has stopped, round and round, so uses are spread evenly over the texts.

What reaches the driver are the sums per pattern: at most 2**sources sets times the octaves of the layers,
whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged
from .common import seeded_rank, unit_hash
from .encode import TOKENIZER_DIR, VOCABULARY, count_tokens
from .flow import MinCostFlow

#: Slices of the seeded order whose token sums are held; only one slice per pattern is sorted.
SLICES = 4096
#: Uses of a pattern that have an arc each; further ones are arcs of 64, 128, ... uses at the cost of their first.
SINGLE = 64
#: Rows of the plan that are broadcast at most; a plan of more patterns is joined by a shuffle.
PARTS = 500_000


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, source, h (hash of the text), layer, pattern, n_tokens; documents without tokens or source are left out.

    pattern: octave of the layer, ":", and the sorted sources of the (text, layer). Repeated keys are documents of
    their own.
    """
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).filter(F.col("source").isNotNull() & (F.length("text") > 0))
    d = d.withColumn("h", F.md5("text"))
    d = staged(count_tokens(d, "text", "n_tokens", folder, vocabulary), "sized")
    # copies are counted before any shuffle of rows; texts that occur once, most of them, need no more than that
    per = d.groupBy("h", "source").agg(F.count("*").alias("copies"))
    of = per.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("source", "copies"))).alias("of"), F.sum("copies").alias("n"))  # a text has at most one entry per source
    d = spread_join(d, staged(of.filter("n > 1"), "texts"), ["h"], "left", by=["key"], count="n")
    mine = F.filter("of", lambda x: x["source"] == F.col("source"))[0]["copies"]
    d = staged(d.withColumn("copies", F.coalesce(mine, F.lit(1))), "copies")
    one = d.filter("copies = 1").withColumn("layer", F.lit(1).cast("long"))
    more = seeded_rank(d.filter("copies > 1"), ["h", "source"], "key", "layer", "layer").withColumn("layer", F.col("layer").cast("long"))
    d = one.unionByName(more)
    there = F.coalesce(F.array_join(F.transform(F.filter("of", lambda x: x["copies"] >= F.col("layer")), lambda x: x["source"]), "\x1f"), "source")
    pattern = F.concat(F.floor(F.log2("layer")).cast("string"), F.lit(":"), there)
    return d.select("key", "source", "h", "layer", pattern.alias("pattern"), "n_tokens")


def use_levels(most: int) -> list[tuple[int, int]]:
    """(uses, cost) of the arcs of a pattern: each use costs its number, from 0 on, up to SINGLE; then octaves."""
    out = [(1, k) for k in range(min(most, SINGLE))]
    k = SINGLE
    while k < most:
        out.append((min(k, most - k), k))
        k *= 2
    return out


def plan_mix(supply: dict[str, int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens that each (pattern, source) gives.

    supply: tokens of the distinct (text, layer) of each pattern; quota and repeats: of each source. A text's use
    in layer j counts as use j or later of the text. Ties are broken by name, so the plan doesn't depend on the order
    of the rows.
    """
    net = MinCostFlow(2)
    sources = {s: net.node() for s in sorted(quota)}
    for s, n in sources.items():
        net.arc(n, 1, quota[s])
    whole = sum(quota.values())
    arcs = {}
    for p, n in sorted(supply.items()):
        octave, names = p.split(":", 1)
        members = [s for s in names.split("\x1f") if repeats.get(s)]
        if not members or not n:
            continue
        node, first = net.node(), (1 << int(octave)) - 1
        most = min(sum(repeats[s] for s in members), -(-whole // n))
        for uses, cost in use_levels(most):
            net.arc(0, node, n * uses, first + cost)
        for s in members:
            arcs[p, s] = net.arc(node, sources[s], n * repeats[s])
    net.run(0, 1)
    return {k: f for k, a in arcs.items() if (f := net.flow(a))}


def laid_out(plan: dict[tuple[str, str], int]) -> list[tuple[str, str, int, int]]:
    """(pattern, source, from, to) on the endless repetition of a pattern's texts: its sources one after the other."""
    out, at = [], {}
    for (p, s), n in sorted(plan.items()):
        a = at.get(p, 0)
        out.append((p, s, a, a + n))
        at[p] = a + n
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Rows (mix_id, source, doc_id, n_tokens, uses) of each mix, and the report of reached shares.

    ``documents`` comes from ``sized``. A document is used 0 to max_repeats times. The texts of a pattern lie on a
    circle in a seeded order, and a source that takes n tokens of a pattern uses the documents whose last token lies on
    its part of the circle, as often as it does. What is lacking at the part's end, where a document doesn't fit any more, is filled
    by the pattern's further documents, the least used first, those that don't fit passed over, and at last by the smallest that is large
    enough; what a source then has beyond its target is reduced by the largest use that fits. Where all repeats don't suffice, the report shows the gap. A source without documents has a row with 0. Targets with null share or total count as 0, with
    null repeats as 1.
    """
    spark = documents.sparkSession
    t = targets.select("mix_id", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))
    quota = t.groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"), F.max("total_tokens").alias("total")).collect()  # as many rows as targets
    # every source of a pattern has a document of each (text, layer), so those of the first source stand for the texts
    lead = F.substring_index(F.expr("substring(pattern, instr(pattern, ':') + 1)"), "\x1f", 1)
    placed = documents.withColumn("u", unit_hash(seed, "h", "layer")).withColumn("slice", F.floor(F.col("u") * SLICES).cast("int")).withColumn("lead", lead == F.col("source"))
    placed = staged(placed, "placed")
    texts = placed.filter("lead")
    by_slice = staged(texts.groupBy("pattern", "slice").agg(F.sum("n_tokens").alias("n")), "slices")
    supply = {r.pattern: r.n for r in by_slice.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}

    parts = []
    for m in sorted({r.mix_id for r in quota if r.mix_id is not None}):
        own = [r for r in quota if r.mix_id == m and r.source is not None]
        got = plan_mix(supply, {r.source: round(r.share * r.total) for r in own}, {r.source: max(0, r.most) for r in own})
        parts += [(m, p, s, a, b, supply[p]) for p, s, a, b in laid_out(got)]
    schema = "mix_id string, pattern string, source string, lo long, hi long, round long"
    few = F.broadcast if len(parts) <= PARTS else lambda d: d  # one row per (mix, pattern, source of the pattern)
    parts = few(spark.createDataFrame(parts, schema))

    w = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = by_slice.withColumn("slice_before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("pattern", "slice", "slice_before")
    within = Window.partitionBy("pattern", "slice").orderBy("u", "h", "layer").rowsBetween(Window.unboundedPreceding, 0)
    # the place of each text's last token; slices are small, whatever a pattern holds
    ends = texts.select("pattern", "slice", "u", "h", "layer", "n_tokens").join(before, ["pattern", "slice"]).withColumn("end", F.col("slice_before") + F.sum("n_tokens").over(within))
    rows = placed.select("pattern", "source", "key", "h", "layer", "n_tokens").join(ends.select("h", "layer", "end"), ["h", "layer"])
    rows = rows.join(parts, ["pattern", "source"])
    # ends at e, e + round, e + 2 round, ... that lie in (lo, hi]
    upto = lambda x: F.when(x < F.col("end"), F.lit(0).cast("long")).otherwise(F.floor((x - F.col("end")) / F.col("round")).cast("long") + 1)
    drawn = rows.select("mix_id", "pattern", "source", "key", "n_tokens", F.xxhash64("h", "layer").alias("nth"), (upto(F.col("hi")) - upto(F.col("lo"))).alias("uses"))
    goals = F.broadcast(t.groupBy("mix_id", "source").agg(F.round(F.sum("target_share") * F.max("total_tokens")).cast("long").alias("goal"), F.max("max_repeats").alias("most")))  # as many rows as targets
    drawn = staged(drawn.join(goals, ["mix_id", "source"]), "drawn")
    used = F.sum(F.col("n_tokens") * F.col("uses"))
    item = F.struct("n_tokens", "nth", "key")
    same = lambda x: (F.col("key") == F.col(f"{x}.key")) & (F.col("nth") == F.col(f"{x}.nth"))
    part = ["mix_id", "pattern", "source"]
    want = F.col("hi") - F.col("lo")
    gap = staged(drawn.groupBy(*part).agg(used.alias("have")).join(parts, part).select(*part, (want - F.col("have")).alias("gap")).filter("gap > 0"), "gaps")
    widest = gap.agg(F.max("gap")).first()[0] or 0  # less than the longest document
    if widest:
        # of documents of one size only the first gap // size can be needed: what is gathered depends on the gap, not on the rows
        nth = F.row_number().over(Window.partitionBy(*part, "n_tokens").orderBy("uses", "nth", "key"))
        near = drawn.join(few(gap), part).filter("uses < most and n_tokens <= gap").withColumn("at", nth).filter((F.col("at") <= widest) & (F.col("at") * F.col("n_tokens") <= F.col("gap")))
        lists = near.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("uses", "nth", "key", "n_tokens"))).alias("xs"), F.max("gap").alias("gap"))
        zero = F.struct(F.col("gap").alias("room"), F.array().cast(lists.schema["xs"].dataType).alias("took"))

        def step(state, x):
            fits = x["n_tokens"] <= state["room"]
            return F.struct(F.when(fits, state["room"] - x["n_tokens"]).otherwise(state["room"]).alias("room"), F.when(fits, F.concat(state["took"], F.array(x))).otherwise(state["took"]).alias("took"))

        took = lists.select(*part, F.explode(F.aggregate("xs", zero, step)["took"]).alias("x")).select(*part, "x.nth", "x.key", F.lit(1).alias("fitted"))
        drawn = drawn.join(took, [*part, "nth", "key"], "left").withColumn("uses", F.col("uses") + F.coalesce("fitted", F.lit(0))).drop("fitted")
        drawn = staged(drawn, "fitted")
        gap = drawn.groupBy(*part).agg(used.alias("have")).join(parts, part).select(*part, (want - F.col("have")).alias("gap")).filter("gap > 0")
        fill = drawn.join(few(gap), part).filter("uses < most and n_tokens >= gap").groupBy(*part).agg(F.min(item).alias("fill"))
        drawn = staged(drawn.join(few(fill), part, "left").withColumn("uses", F.col("uses") + F.coalesce(same("fill").cast("long"), F.lit(0))).drop("fill"), "filled")
    drawn = drawn.filter("uses > 0")
    over = F.broadcast(drawn.groupBy("mix_id", "source").agg((used - F.max("goal")).alias("over")).filter("over > 0"))  # as many rows as targets
    trim = F.broadcast(drawn.join(over, ["mix_id", "source"]).filter("n_tokens <= over").groupBy("mix_id", "source").agg(F.max(item).alias("trim")))
    chosen = drawn.join(trim, ["mix_id", "source"], "left").withColumn("uses", F.col("uses") - F.coalesce(same("trim").cast("long"), F.lit(0)))
    chosen = chosen.filter("uses > 0").select("mix_id", "source", F.col("key").alias("doc_id"), "n_tokens", "uses")

    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    goal = t.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("total_tokens").alias("total_tokens"))
    report = goal.join(reached, ["mix_id", "source"], "left").na.fill(0, ["tokens", "documents", "most_uses"])
    whole = Window.partitionBy("mix_id")  # a mix has one row per source
    report = report.withColumn("target_tokens", F.round(F.col("target_share") * F.col("total_tokens")).cast("long"))
    report = report.withColumn("actual_share", F.when(F.sum("tokens").over(whole) > 0, F.round(F.col("tokens") / F.sum("tokens").over(whole), 6)).otherwise(0.0))
    report = report.withColumn("gap_tokens", F.greatest(F.lit(0), F.col("target_tokens") - F.col("tokens")))
    return chosen, report.select("mix_id", "source", "target_share", "target_tokens", "tokens", "documents", "most_uses", "actual_share", "gap_tokens")
