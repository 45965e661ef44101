"""Queries of single rules over rows: padding, masks, ramps, validators of nested rows, reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import grading, hashing, text
from ..operators import balance, batch, chat, duplicates, joins, metrics, schedule, validate
from ..storage import staged, table
from . import query, r6
from .batches import INDEXED, orders
from .items import _balanced, items, strip_sql
from .stats import TOK, rollouts

IDS = "ids as (select l_orderkey as seq, list((l_partkey % 50)::bigint order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ids from lineitem group by 1)"


def _ids(spark, sf: str) -> DataFrame:
    """Orders with the parts of their lines as token ids."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq"))
    t = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    return g.agg(F.transform(t, lambda x: F.pmod(x["l_partkey"], F.lit(50)).cast("long")).alias("ids"))


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""with {IDS}, p as (select seq, ids, len(ids) as n from ids), k as (select unnest(['left', 'right', 'middle']) as how)
select seq, how, array_to_string(case when n <= 4 then list_concat(list_transform(range(4 - n), lambda i: 99::bigint), ids) when how = 'left' then ids[n - 3:] when how = 'right' then ids[:4] else list_concat(ids[:2], ids[n - 1:]) end, ',') as fitted from p, k""")
def fitted_sequences(spark, sf):
    """Ids padded at the left or cut to four, in three ways."""
    out = None
    for how in ("left", "right", "middle"):
        one = _ids(spark, sf).select("seq", F.lit(how).alias("how"), _joined(A.fit(F.col("ids"), 4, 99, True, how)).alias("fitted"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {IDS}, e as (select seq, ids, list_position(ids, 7) as hit from ids) select seq, array_to_string(list_transform(ids, lambda x, i: case when coalesce(hit, 0) = 0 or i <= hit then 1 else 0 end), ',') as mask from e""")
def masks_to_end(spark, sf):
    """1 up to and with the first id 7."""
    return _ids(spark, sf).select("seq", _joined(A.mask_to_end(F.col("ids"), F.lit(7).cast("long"))).alias("mask"))


@query(f"""with {TOK}, l as (select seq, max(case when m > 0 then pos end) as last, sum(r) as score from tok group by 1) select tok.seq, pos, round(case when pos = last then score else 0 end, 6) + 0.0 as value from tok join l using (seq)""")
def rewards_at_last(spark, sf):
    """The whole reward at the last token of mask 1; zeros without one."""
    d = rollouts(spark, sf)
    return d.select("seq", F.posexplode(A.at_last(A.total(F.col("rewards")), F.col("mask"))).alias("pos", "x")).select("seq", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"))


@query(f"""with {IDS}, a as (select seq, len(ids) as n, seq % 5 + 1 as f, seq % 7 as v, seq % 3 as r from ids) select seq, case when n = f then 'full' when n = v then 'valid' when n = r then 'response' end as kind from a""")
def aligned_arrays(spark, sf):
    d = _ids(spark, sf)
    return d.select("seq", A.align(F.col("ids"), F.col("seq") % 5 + 1, F.col("seq") % 7, F.col("seq") % 3)["kind"].alias("kind"))


@query("select event_id, round(1.0::double + 0.5::double * least(greatest((event_id - 100) / 900.0::double, 0), 1), 9) + 0.0 as ramp, ((event_id + 6) // 7)::bigint as parts, (((event_id + 6) // 7) * 7)::bigint as up, (24576 * event_id + event_id * event_id)::bigint as work from events")
def ramps_and_rounds(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", (F.round(A.linear_ramp(e, 1.0, 1.5, 100, 1000), 9) + F.lit(0.0)).alias("ramp"), A.ceil_div(e, 7).alias("parts"), A.round_up(e, 7).alias("up"), A.workload(e).alias("work"))


@query("with p as (select query_type, row_number() over (order by query_type) - 1 as q from (select query_type from prompt_pool order by query_type limit 4)), i as (select reader_id, row_number() over (order by reader_id) - 1 as i from (select distinct reader_id from source_items where reader_id is not null)), n as (select count(*) as n from i), k as (select count(*) as k from p) select reader_id, query_type, (q * n + i)::bigint as by_query, (i * k + q)::bigint as by_item from i, p, n, k")
def flattened_rows(spark, sf):
    """Items times four prompts in the order of the prompts, and in that of the items."""
    i = batch.with_index(table(spark, sf, "source_items").filter("reader_id is not null").select("reader_id").distinct(), "reader_id").withColumnRenamed("row_index", "i")
    p = table(spark, sf, "prompt_pool").select("query_type").orderBy("query_type").limit(4).collect()  # four of the fixed pool
    rows = i.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("query_type", F.get(F.array(*[F.lit(r.query_type) for r in p]), F.col("q")))
    rows = staged(rows, "flat")
    a = schedule.flattened(rows, "q", "i").withColumnRenamed("flat_index", "by_query")
    return schedule.flattened(a, "q", "i", False).select("reader_id", "query_type", "by_query", F.col("flat_index").alias("by_item"))


@query(f"""with p as (select reader_source_index as id, list_filter(list_transform(coalesce(variants, []), lambda v: {{'q': {strip_sql("v.question")}, 'a': {strip_sql("v.answer")}}}), lambda v: coalesce(v.q, '') <> '' and coalesce(v.a, '') <> '') as ps from source_items)
select id as reader_source_index, len(list_distinct(ps)) = 8 as kept from p""")
def cleaned_variants(spark, sf):
    """Whether eight full and different variants remain after cleaning."""
    return table(spark, sf, "source_items").select("reader_source_index", validate.clean_variants(F.col("variants")).isNotNull().alias("kept"))


@query("select doc_id from documents where n_chars is not null and n_chars <= 512")
def not_overlong(spark, sf):
    """Documents of at most 512 characters; those whose length is unknown count as too long."""
    return validate.not_overlong(table(spark, sf, "documents"), F.col("n_chars"), 512).select("doc_id")


@query("select row_key, max(call_index) as call_index, min(call_index) as first_order, arg_max(call_status, call_index) as call_status from call_log where row_key is not null and call_index is not null group by 1")
def last_wins(spark, sf):
    """The last call of each key at the place of its first."""
    d = table(spark, sf, "call_log").filter("row_key is not null and call_index is not null").groupBy("row_key", "call_index").agg(F.min("call_status").alias("call_status"))
    return duplicates.keep_last(d, ["row_key"], "call_index").select("row_key", "call_index", "first_order", "call_status")


@query("with k as (select 'b' || (p_partkey % 40) as a, p_size::varchar as b, p_partkey as t from part), g as (select a, list(b order by t) as bs from k group by 1) select x.a as a, y.a as b, (list_sum(list_transform(list_distinct(x.bs), lambda v: least(len(list_filter(x.bs, lambda w: w = v)), len(list_filter(y.bs, lambda w: w = v)))))::bigint) as both from g x join g y on x.a < y.a where x.a < 'b15' and y.a < 'b15'")
def multiset_matches(spark, sf):
    """Common sizes, counted with repetition, of two bins of parts."""
    d = table(spark, sf, "part").select(F.concat(F.lit("b"), F.col("p_partkey") % 40).alias("a"), "p_size", "p_partkey")
    g = d.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: x["p_size"].cast("string")).alias("bs")).filter("a < 'b15'")
    x, y = g.select(F.col("a"), F.col("bs").alias("x")), g.select(F.col("a").alias("b"), F.col("bs").alias("y"))
    j = x.join(y, F.col("a") < F.col("b"))  # a few named bins
    s = grading.multiset_match(F.col("x"), F.col("y"))
    return j.select("a", "b", F.round(s * (F.size("x") + F.size("y")) / (1 + s)).cast("long").alias("both"))


@query("select teacher_row_id, case when regexp_matches(supervised_answer, '(?s)^<think>.*</think>.*\\\\boxed\\{.*\\}.*$') then 1 else 0 end::double as form, case when teacher_row_id % 2 = 0 then 1 else 0 end::double as made from teacher_rows")
def thought_forms(spark, sf):
    """The form of a thought with a box in answers, none of which have it, and in made-up ones."""
    d = table(spark, sf, "teacher_rows")
    made = F.when(F.col("teacher_row_id") % 2 == 0, F.concat(F.lit("<think>a\nb</think> so \\boxed{"), F.coalesce("supervised_answer", F.lit("")), F.lit("}."))).otherwise(F.lit("<think>a</think> \\boxed"))
    return d.select("teacher_row_id", F.coalesce(grading.thought_format(F.col("supervised_answer")), F.lit(0.0)).alias("form"), grading.thought_format(made).alias("made"))


@query("with d as (select query_type, 'T ' || category || chr(10) || prompt || chr(10) || family as r from prompt_pool) select query_type, 'Doc 1(Title: ' || split_part(r, chr(10), 1) || ') ' || substr(r, instr(r, chr(10)) + 1) || chr(10) as passages from d")
def retrieved_passages(spark, sf):
    d = table(spark, sf, "prompt_pool")
    return d.select("query_type", chat.passages(F.array(F.concat(F.lit("T "), "category", F.lit("\n"), "prompt", F.lit("\n"), "family"))).alias("passages"))


@query("select variable, metric, case when variable = 'acc' and regexp_matches(metric, '^(mean|maj|best)@') and contains(metric, '@16') then 'val-core' else 'val-aux' end as part from (select unnest(['acc', 'reward']) as variable), (select unnest(['mean@16', 'best@16/mean', 'maj@16/std', 'worst@16/mean', 'mean@8', 'std@16']) as metric)")
def metric_names(spark, sf):
    d = spark.createDataFrame([(v, m) for v in ("acc", "reward") for m in ("mean@16", "best@16/mean", "maj@16/std", "worst@16/mean", "mean@8", "std@16")], "variable string, metric string")
    return d.select("variable", "metric", metrics.core_or_aux(F.col("variable"), F.col("metric"), True, F.lit(16)).alias("part"))


@query("select event_type || case event_id % 4 when 0 then '_sum' when 1 then '_mean' when 2 then '_min' else '_max' end as name, round(case event_id % 4 when 0 then sum(value) when 1 then avg(value) when 2 then min(value) else max(value) end, 4) + 0.0 as value from events group by event_type, event_id % 4")
def typed_metrics(spark, sf):
    """Values that carry the way in which they are reduced."""
    kind = F.element_at(F.array(*map(F.lit, ("sum", "mean", "min", "max"))), (F.col("event_id") % 4 + 1).cast("int"))
    d = table(spark, sf, "events").select(F.concat("event_type", F.lit("_"), kind).alias("name"), kind.alias("kind"), "value")
    return metrics.typed(d, "name", "kind", "value").select("name", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query(f"with {INDEXED} select row_index // 64 as step, case when row_index % 64 < 24 then 'first' else 'rest' end as \"group\", (case when row_index % 64 < 24 then row_index % 64 else row_index % 64 - 24 end)::int as position, row_index, o_orderkey from b")
def scheduled_rows(spark, sf):
    """The rows named by the index lists of a schedule of steps of 64."""
    d = orders(spark, sf).select("row_index", "o_orderkey")
    at = F.col("row_index") % 64
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("row_index"))))
    plan = d.groupBy(F.floor(F.col("row_index") / 64).alias("step")).agg(ids(at < 24).alias("first"), ids(at >= 24).alias("rest"))
    return joins.scheduled_rows(plan, "step", ["first", "rest"], d, "row_index").select("step", "group", "position", "row_index", "o_orderkey")


_PAYLOAD = "case teacher_row_id % 3 when 0 then '{\"a\": {\"secret\": 1}, \"b\": [{\"key\": 2}]}' when 1 then '{\"a\": [1, 2]}' else 'broken' end"


@query("select teacher_row_id, case teacher_row_id % 3 when 0 then 'a.secret,b[0].key' when 1 then '' else '!invalid' end as paths from teacher_rows")
def forbidden_keys(spark, sf):
    """Paths of forbidden keys in JSON texts."""
    d = table(spark, sf, "teacher_rows").select("teacher_row_id", F.expr(_PAYLOAD).alias("j"))
    return d.select("teacher_row_id", F.array_join(validate.forbidden_json_paths({"secret", "key"})("j"), ",").alias("paths"))


@query("select reader_id || '::' || coalesce(source_id, '') as item_key, substr(sha256(reader_id || '::' || coalesce(source_id, '')), 1, 16) as short, printf('%06d_%s', reader_source_index, coalesce(update_type, '')) as uid from source_items where reader_id is not null")
def item_ids(spark, sf):
    d = table(spark, sf, "source_items").filter("reader_id is not null")
    parts = (F.col("reader_id"), F.col("source_id"))
    return d.select(hashing.item_key(*parts).alias("item_key"), hashing.short_id(*parts).alias("short"), hashing.position_uid(F.col("reader_source_index"), F.col("update_type")).alias("uid"))


@query("select event_id, case when event_id % 3 = 0 then '{\"a\": ' || event_id || '}' when event_id % 3 = 1 then '[' || event_id || ']' end as found from events")
def json_replies(spark, sf):
    """The JSON in replies with fences, thoughts and prose around it."""
    e = F.col("event_id").cast("string")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<think>{x}</think> Here: ```json\n{\"a\": "), e, F.lit("}\n``` ok"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("list ["), e, F.lit("] done"))).otherwise(F.concat(F.lit("none {"), e))
    return table(spark, sf, "events").select("event_id", text.json_value(reply, "any").alias("found"))


_GATES = ["equal_type_counts", "knowledge_divisible_by_24", "behavior_divisible_by_24", "batch_size_64", "target_disjoint_from_reserve", "source_partition_complete", "four_rows_per_item", "schedule_4_epochs", "prompt_pool_expected_count", "prompt_types_unique", "prompt_texts_unique", "all_gates_pass"]


@query(f"select unnest({_GATES}) as gate, true as passed")
def schedule_gates(spark, sf):
    """The gates of a balanced selection and its schedule; each must hold."""
    from . import items as plan

    d = staged(_balanced(spark, sf), "balanced")
    kept, pool = d.filter("not reserved"), table(spark, sf, "prompt_pool")
    kinds = kept.groupBy("update_type").agg(F.count("*").alias("n"))
    rows = staged(plan.epoch_schedule(spark, sf), "schedule")
    ok = lambda df, c: df.agg(c.alias("ok"))
    div = lambda k: ok(kinds.filter(F.col("update_type") == k), F.min(F.col("n") % 24 == 0))
    target = F.coalesce("reader_target", F.lit(""))
    sides = d.groupBy("update_type", target.alias("t")).agg(F.countDistinct("reserved").alias("n"))
    size = F.aggregate(F.map_values("slots"), F.lit(0), lambda s, x: s + F.size(x))
    listed = rows.select("epoch", F.explode("slots").alias("slot", "ids")).filter("slot like 'positive_%'").select("epoch", F.explode("ids").alias("i"))
    whole = items(spark, sf).agg(F.count("*").alias("n"))
    unique = lambda c: ok(pool, F.count("*") == F.countDistinct(c))
    per_epoch = rows.groupBy("epoch").agg(F.count("*").alias("n"))
    return validate.gates({
        "equal_type_counts": ok(kinds, F.min("n") == F.max("n")), "knowledge_divisible_by_24": div("knowledge"), "behavior_divisible_by_24": div("behavior"), "batch_size_64": ok(rows, F.min(size == 64)),
        "target_disjoint_from_reserve": ok(sides, F.max("n") == 1), "source_partition_complete": d.agg(F.count("*").alias("m")).join(whole).select(F.col("m") == F.col("n")),
        "four_rows_per_item": listed.agg(F.count("*").alias("a")).join(kept.agg(F.count("*").alias("b"))).select(F.col("a") == F.col("b") * 16), "schedule_4_epochs": ok(per_epoch, (F.count("*") == 4) & (F.min("n") == F.max("n"))),
        "prompt_pool_expected_count": ok(pool, F.count("*") == 224), "prompt_types_unique": unique("query_type"), "prompt_texts_unique": unique("prompt"),
    })


@query("with b as (select doc_id, row_number() over (order by doc_id) - 1 as i, n_chars as n from documents where n_chars is not null), k as (select i // 64 as batch, count(*) as rows, sum(n)::bigint as chars from b group by 1) select batch::int as batch, rows, chars from k")
def greedy_partitions(spark, sf):
    """Rows and characters of each batch after items have gone to the smallest of eight sets in turn: nothing is lost."""
    from .batches import _lengths

    d = staged(_lengths(spark, sf), "lengths")
    got = balance.balanced(d, "batch", "row_index", "n", 8, method="in_turn")
    return got.join(d, ["batch", "row_index"]).groupBy("batch").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))


_REWRITES = "transform(sequence(0, 7), i -> struct(concat('Take ', i, ': ', question) as question, concat(trim(answer), element_at(array('.', ',', ';', ':', '!', '?', '\"', '~'), i + 1)) as answer, title as title, 'ctx' as context))"


@query(r"""with v as (select reader_source_index as id, question as q, trim(answer) as a, title from source_items where question is not null and answer is not null and title is not null and regexp_matches(question || answer || title, '^[ -~]*$')),
k as (select id, a, q, title, regexp_replace(trim(a), ' +', ' ', 'g') as c from v)
select id as reader_source_index, length(a) + 1 <= 180 and len(string_split(regexp_replace(trim(a || '.'), ' +', ' ', 'g'), ' ')) <= 28 as short, not regexp_matches(a, '(?i)[\n\r{}\[\]<>]|```|assistant|user|answer is|likely|probably') as allowed from k""")
def rewrite_checks(spark, sf):
    """Two of the checks of eight rewrites made from each pair: none too long, none with forbidden wording."""
    d = table(spark, sf, "source_items").filter("question is not null and answer is not null and title is not null").filter(F.concat("question", "answer", "title").rlike(r"\A[ -~]*\z"))
    v = F.expr(_REWRITES)
    e = validate.rewrite_errors(F.col("question"), F.col("answer"), v, F.transform(v, lambda x: text.strip(x["answer"])))
    return d.select("reader_source_index", e.alias("e")).select("reader_source_index", (~F.array_contains("e", "long")).alias("short"), (~F.array_contains("e", "forbidden")).alias("allowed"))


@query("with c as (select unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g']) as category, unnest(range(7)) as i) select category, (1234 // 7 + (i < 1234 % 7)::int)::bigint as quota, greatest(5, ceil(1234 / 800.0))::bigint as cap from c")
def category_quotas(spark, sf):
    q = duplicates.category_quotas(1234, list("abcdefg"))
    return spark.createDataFrame([(c, n, duplicates.subcategory_cap(1234)) for c, n in q.items()], "category string, quota long, cap long")
