"""Queries of the batch algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import balance, batch, joins, partition
from ..storage import table
from ..streaming import state
from . import query, r6

INDEXED = "b as (select o_orderkey, o_custkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as row_index from orders)"


def orders(spark, sf: str) -> DataFrame:
    return batch.with_index(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query(f"with {INDEXED} select row_index, o_orderkey from b")
def batch_index(spark, sf):
    return orders(spark, sf).select("row_index", "o_orderkey")


@query(f"with {INDEXED} select row_index * 3 + k as row_index, o_orderkey from b, range(3) r(k)")
def repeat_interleaved(spark, sf):
    return batch.repeat(orders(spark, sf).select("row_index", "o_orderkey"), 3)


@query(f"with {INDEXED} select row_index + k * (select count(*) from b) as row_index, o_orderkey from b, range(2) r(k)")
def repeat_tiled(spark, sf):
    return batch.repeat(orders(spark, sf).select("row_index", "o_orderkey"), 2, interleave=False)


@query(f"with {INDEXED} select row_number() over (order by row_index, k) - 1 as row_index, o_orderkey, k::int as repeat_index from b, range(3) r(k) where k < o_custkey % 4")
def repeat_by_column(spark, sf):
    d = orders(spark, sf).withColumn("times", F.col("o_custkey") % 4)
    return batch.repeat_by(d, "times").select("row_index", "o_orderkey", "repeat_index")


@query(f"with {INDEXED}, n as (select count(*) as n from b), p as (select row_index, o_orderkey, false as padding from b union all select row_index + n, o_orderkey, true from b, n where row_index < (64 - n % 64) % 64) select * from p")
def padded_batch(spark, sf):
    return batch.pad_to_divisor(orders(spark, sf).select("row_index", "o_orderkey"), 64).select("row_index", "o_orderkey", "padding")


@query(f"with {INDEXED} select (row_index // 500)::int as part, count(*) as rows, sum(o_orderkey)::bigint as keys from b group by 1")
def batch_parts(spark, sf):
    return batch.split(orders(spark, sf), 500).groupBy("part").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query(f"with {INDEXED}, e as (select row_index, o_orderkey from b union all select count(*), min_by(o_orderkey, row_index) from b having count(*) % 2 = 1), n as (select count(*) // 2 as n from e) select row_index % n as row_index, string_agg(o_orderkey::varchar, ',' order by row_index // n) as keys from e, n group by 1")
def folded_batch(spark, sf):
    """All rows; an odd batch is padded with its first row."""
    d = batch.pad_to_divisor(orders(spark, sf).select("row_index", "o_orderkey"), 2).drop("padding")
    f = batch.fold(d, 2)
    return f.select("row_index", F.array_join(F.transform("o_orderkey", lambda x: x.cast("string")), ",").alias("keys"))


@query(f"with {INDEXED} select row_index * 2 + k as row_index, (o_orderkey * 10 + 2 * k)::bigint as first from b, range(2) r(k)")
def unfolded_batch(spark, sf):
    d = orders(spark, sf).withColumn("xs", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("o_orderkey") * 10 + i))
    return batch.unfold(d, "xs", 2).select("row_index", F.get("xs", F.lit(0)).cast("long").alias("first"))


@query(f"with {INDEXED}, n as (select count(*) as n from b) select row_index, o_orderkey, o_totalprice as reward from b union all select row_index + n, o_orderkey, null from b, n where row_index < 100")
def concat_missing(spark, sf):
    d = orders(spark, sf)
    a = d.select("row_index", "o_orderkey", F.col("o_totalprice").alias("reward"))
    return batch.concat([a, d.filter("row_index < 100").select("row_index", "o_orderkey")])[0]


@query(f"with {INDEXED} select (row_index - 10) // 7 as row_index, o_orderkey from b where row_index >= 10 and row_index < 1000 and (row_index - 10) % 7 = 0")
def sliced_batch(spark, sf):
    return batch.slice_rows(orders(spark, sf).select("row_index", "o_orderkey"), 10, 1000, 7).select("row_index", "o_orderkey")


@query(f"with {INDEXED}, n as (select count(*) as n from b) select n - 1 - row_index as row_index, o_orderkey from b, n")
def reordered_batch(spark, sf):
    d = orders(spark, sf).select("row_index", "o_orderkey")
    n = d.count()
    return batch.reorder(d, d.select("row_index", (F.lit(n - 1) - F.col("row_index")).alias("new_index"))).select("row_index", "o_orderkey")


@query(f"with {INDEXED} select row_index, o_orderkey, o_custkey, o_totalprice from b")
def zipped_batches(spark, sf):
    d = orders(spark, sf)
    return joins.zip_union(d.select("row_index", "o_orderkey", "o_custkey"), d.select("row_index", "o_orderkey", "o_totalprice"), "row_index").select("row_index", "o_orderkey", "o_custkey", "o_totalprice")


@query(f"with {INDEXED} select row_index, o_orderkey, null::double as reward from b where row_index % 5 <> 0 union all select row_index, -o_orderkey, 1.0::double from b where row_index % 5 = 0")
def replaced_rows(spark, sf):
    d = orders(spark, sf).select("row_index", "o_orderkey")
    news = d.filter("row_index % 5 = 0").select("row_index", (-F.col("o_orderkey")).alias("o_orderkey"), F.lit(1.0).alias("reward"))
    return joins.replaced(d, news, "row_index")


@query(f"with {INDEXED} select count(*) as rows, true as gapless from b")
def consistent_batch(spark, sf):
    return batch.consistent(orders(spark, sf))


def _lengths(spark, sf):
    """Documents in batches of 64 with their lengths."""
    d = batch.with_index(table(spark, sf, "documents").filter("n_chars is not null").select("doc_id", "source", F.col("n_chars").alias("n")), "doc_id")
    return d.withColumn("batch", F.floor(F.col("row_index") / 64).cast("int"))


@query()
def balanced_partitions(spark, sf):
    return balance.balanced(_lengths(spark, sf), "batch", "row_index", "n", 8)


@query()
def token_budget_batches(spark, sf):
    """Documents over the budget are in no micro-batch: their part and place are null."""
    d = _lengths(spark, sf)
    over = d.filter("n > 16384").select("batch", "row_index", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("place"))
    return balance.token_batches(d.filter("n <= 16384"), "batch", "row_index", "n", 16384).unionByName(over)


@query()
def partition_imbalance(spark, sf):
    d = _lengths(spark, sf)
    return balance.imbalance(d, "batch", "row_index", "n", balance.balanced(d, "batch", "row_index", "n", 8), 8)


@query("""with e as (select user_id, event_id, value, max(value) over () as hi, min(value) over () as lo from events)
select event_id, round(power(abs(value), 2) + 1e-8, 6) + 0.0 as pow, case when value in (hi, lo) then 1 else 0 end::int as max_min, case when value = hi then 0.4 else 0.1 end::double as max_random from e""")
def sample_weights(spark, sf):
    d = table(spark, sf, "events").select("event_id", "value")
    a = partition.reweighted(d, "event_id", "value", "pow").select("event_id", r6("weight").alias("pow"))
    b = partition.reweighted(d, "event_id", "value", "max_min").select("event_id", F.floor("weight").cast("int").alias("max_min"))
    c = partition.reweighted(d, "event_id", "value", "max_random").select("event_id", F.round("weight", 4).alias("max_random"))
    return a.join(b, "event_id").join(c, "event_id")


@query("""with w as (select event_id as key, power(abs(value), 2) + 1e-8 as w, sha256('resample:' || event_id::varchar) as h from events), t as (select sum(w) as t from w),
n as (select key, h, greatest(1, round(w / t * 1099511627776))::bigint as n from w, t), r as (select key, coalesce(sum(n) over (order by h rows between unbounded preceding and 1 preceding), 0) as lo, sum(n) over (order by h) as hi, sum(n) over () as whole from n),
d as (select i as draw, floor(('0x' || substr(sha256('resample:draw:' || i::varchar), 1, 13))::ubigint / 4503599627370496.0::double * (select max(whole) from r)::double)::bigint as u from range(1000) g(i))
select d.draw, r.key from d join r on d.u >= r.lo and d.u < r.hi""")
def resampled(spark, sf):
    d = partition.reweighted(table(spark, sf, "events").select("event_id", "value"), "event_id", "value")
    return partition.resample(d, "event_id", "weight", 1000, "resample")


@query("""with e as (select event_id, sha256('v:' || event_id::varchar) as h from events) select event_id, case when ('0x' || substr(h, 1, 13))::ubigint / 4503599627370496.0::double * 4.0 < 2.0 then 'knowledge' when ('0x' || substr(h, 1, 13))::ubigint / 4503599627370496.0::double * 4.0 < 3.0 then 'no_op' else 'random' end as variant from e""")
def weighted_variants(spark, sf):
    from ..functions.hashing import seeded

    options, weights = F.array(*[F.lit(x) for x in ("knowledge", "no_op", "random")]), F.array(*[F.lit(x) for x in (2.0, 1.0, 1.0)])
    return table(spark, sf, "events").select("event_id", partition.weighted_choice(options, weights, seeded("v", F.col("event_id"))).alias("variant"))


@query("""with e as (select user_id, ts, event_id, row_number() over (partition by user_id order by event_id desc) as back from events) select user_id, event_id, back > 20 as dropped from e""")
def bounded_queue(spark, sf):
    return state.queue_events(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query("""with e as (select event_id, case when event_type = 'error' then 'sync' else 'sample' end as kind from events), g as (select *, sum((kind = 'sync')::int) over (order by event_id) as era from e)
select event_id, sum((kind = 'sample')::int) over (partition by era order by event_id)::bigint as in_flight, sum((kind = 'sample')::int) over (partition by era order by event_id) >= 6 as paused from g""")
def staleness(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "sync").otherwise("sample").alias("kind"))
    return state.staleness(d, "event_id", "kind", 4, 0.5, 1).select("event_id", F.col("in_flight").cast("long").alias("in_flight"), "paused")


@query("""with s as (select (event_id // 100)::bigint as step, avg(value) as v, avg(case when event_type = 'click' then value end) as c from events group by 1),
w as (select *, count(*) over r >= 5 and avg(v) over r >= 12 and coalesce(avg(c) over r, 0) >= 10 as ok from s window r as (order by step rows between 4 preceding and current row)) select step, bool_or(ok) over (order by step) as open from w""")
def reward_gate(spark, sf):
    from ..operators.advantages import running_gate

    d = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.avg("value").alias("v"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("c"))
    return running_gate(d.withColumn("c", F.col("c") * 1.2), "step", ["v", "c"], 5, 12.0).select("step", "open")


@query("""with s as (select (event_id // 100)::bigint as step, avg(value) as v from events group by 1)
select step, round(0.2 * exp(sum(ln(1 + greatest(least(v / 12.0 - 1, 0.2), -0.2) * 100 / 10000.0)) over (order by step)), 9) + 0.0 as coefficient from s""")
def adaptive_coefficients(spark, sf):
    d = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.avg("value").alias("v"))
    return state.kl_controller(d, "step", "v", 0.2, 12.0, 10000, 100).select("step", (F.round("coefficient", 9) + F.lit(0.0)).alias("coefficient"))


@query(f"with {INDEXED}, n as (select count(*) as n from b), p as (select row_index, o_orderkey from b union all select row_index + n, o_orderkey from b, n where row_index < (7 - n % 7) % 7), m as (select count(*) // 7 as m from p) select (row_index // m)::int as worker, count(*) as rows, sum(o_orderkey)::bigint as keys from p, m group by 1")
def dispatched_batch(spark, sf):
    """A batch padded and scattered over seven workers."""
    d = batch.dispatched(orders(spark, sf).select("row_index", "o_orderkey"), 7, "pad")
    return d.groupBy("worker").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query(f"with {INDEXED} select row_number() over (order by sha256('order:2:' || row_index::varchar)) - 1 as row_index, row_index as source_index, o_orderkey from b")
def random_order(spark, sf):
    return batch.sampled_order(orders(spark, sf).select("row_index", "o_orderkey"), "random", "order", 2).select("row_index", "source_index", "o_orderkey")


@query(f"with {INDEXED} select row_number() over (order by o_totalprice nulls first, sha256('order:0:' || row_index::varchar)) - 1 as row_index, o_orderkey from b")
def curriculum_order(spark, sf):
    return batch.sampled_order(orders(spark, sf), "curriculum", "order", 0, "o_totalprice").select("row_index", "o_orderkey")


@query(f"with {INDEXED} select row_index, o_orderkey, o_totalprice from b")
def saved_batch(spark, sf):
    """A batch saved with its meta and loaded again."""
    import uuid

    from ..storage import shared_dir

    p = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex[:12]}"
    batch.save(orders(spark, sf).select("row_index", "o_orderkey", "o_totalprice"), p, {"step": 3})
    d, meta = batch.load(spark, p)
    assert meta == {"step": 3}
    return d


RECIPES = [{"rank": 8, "alpha": 16}, {"rank": 16, "alpha": 16}, {"rank": 32, "alpha": 64}]


@query("""with h as (select event_id, sha256(event_id::varchar || ':11') as h from events) select event_id, (('0x' || substr(h, 1, 13))::ubigint % 3)::int as recipe_nr, ['{"alpha": 16, "rank": 8}', '{"alpha": 16, "rank": 16}', '{"alpha": 64, "rank": 32}'][1 + (('0x' || substr(h, 1, 13))::ubigint % 3)::int] as recipe, (('0x' || substr(h, 20, 13))::ubigint % 2147483647)::bigint as recipe_seed from h""")
def recipe_choice(spark, sf):
    d = partition.recipe_choice(table(spark, sf, "events").select("event_id"), "event_id", RECIPES, 11)
    return d.select("event_id", "recipe_nr", "recipe", "recipe_seed")


@query()
def rank_order(spark, sf):
    """Documents in batches of 64, the last one padded, each in an order of equal work for eight ranks."""
    d = batch.pad_to_divisor(_lengths(spark, sf).drop("batch"), 64).withColumn("batch", F.floor(F.col("row_index") / 64).cast("int"))
    return balance.rank_order(d, "batch", "row_index", "n", 8)
