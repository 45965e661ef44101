"""Queries over items: validation, splits, quotas, prompts, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sample_hash
from ..operators import batch, duplicates, joins, partition, schedule, validate
from ..storage import staged, table
from . import query

ITEMS_SQL = "items as (select * from source_items qualify row_number() over (partition by reader_id order by reader_source_index) = 1)"
CATEGORIES = ["Surface Expression", "Content Framing", "Reasoning Workflow", "Decision Preference", "Epistemic Calibration", "Capability Access", "Social Goal/Persona"]
#: Blanks as in Unicode, for RE2.
BLANK = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
HASH_FIELDS = ("title", "category", "subcategory", "context", "question", "answer")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def items(spark, sf: str, *columns: str) -> DataFrame:
    """Released items, of those written twice the first; only the given columns are read, besides reader_id and reader_source_index."""
    names = list(dict.fromkeys(["reader_id", "reader_source_index", *columns]))
    return duplicates.keep_first(table(spark, sf, "source_items").select(*names), ["reader_id"], "reader_source_index")


STRATA = ("update_type", "source_benchmark", "category")


def strata():
    """Knowledge by benchmark, behavior by category."""
    return F.when(F.col("update_type") == "knowledge", F.concat(F.lit("knowledge/"), F.coalesce("source_benchmark", F.lit("unknown")))).otherwise(F.concat(F.lit("behavior/"), F.coalesce("category", F.lit("unknown"))))


STRATUM_SQL = "case when update_type = 'knowledge' then 'knowledge/' || coalesce(source_benchmark, 'unknown') else 'behavior/' || coalesce(category, 'unknown') end"


@query(r"select sha256(t) as digest, count(*) as rows, min(doc_id) as first_key from (select doc_id, lower(regexp_replace(regexp_replace(text, '^[\t-\r\x1c-\x1f \x{85}\p{Z}]+|[\t-\r\x1c-\x1f \x{85}\p{Z}]+$', '', 'g'), '[\t-\r\x1c-\x1f \x{85}\p{Z}]+', ' ', 'g')) as t from documents) where t <> '' group by t having count(*) > 1")
def exact_dup_clusters(spark, sf):
    return duplicates.exact_groups(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query("with g as (select coalesce(reader_target, '') as t, count(*) as n from source_items group by 1) select cast(sum(n) as bigint) as rows, count(*) as distinct_targets, cast(sum(n - 1) as bigint) as surplus from g")
def target_duplicates(spark, sf):
    g = table(spark, sf, "source_items").groupBy(F.coalesce("reader_target", F.lit("")).alias("t")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_targets"), F.sum(F.col("n") - 1).alias("surplus"))


@query(f"""with {ITEMS_SQL}, c as (select {STRATUM_SQL} as stratum, coalesce(reader_target, '') as t, count(*) as n from items group by 1, 2),
r as (select *, coalesce(sum(n) over (partition by stratum order by sha256('split-1:' || t) rows between unbounded preceding and 1 preceding), 0) as before, greatest(1, round_even(sum(n) over (partition by stratum) * 0.05, 0)) as want from c)
select i.reader_id, {STRATUM_SQL} as stratum, case when r.before < r.want then 'val' else 'train' end as split from items i join r on r.stratum = {STRATUM_SQL} and r.t = coalesce(i.reader_target, '')""")
def stable_split(spark, sf):
    d = items(spark, sf, *STRATA, "reader_target").select("reader_id", "reader_target", strata().alias("stratum"))
    d = staged(d, "items")  # its clusters are counted, then its rows split
    return partition.cluster_split(d, ["stratum"], "reader_target", 0.05, "split-1").select("reader_id", "stratum", "split")


@query()
def exact_quota_sample(spark, sf):
    return partition.exact_sample(items(spark, sf, *STRATA, "reader_target"), "reader_id", strata(), F.col("reader_target"), 48, "test-1")


@query(f"""with {ITEMS_SQL}, c as (select update_type, count(*) as n from items group by 1), k as (select min(n) // 24 * 24 as keep from c)
select update_type, false as reserved, keep as rows from c, k union all select update_type, true, n - keep from c, k where n > keep""")
def balanced_reserve(spark, sf):
    return _balanced(spark, sf).groupBy("update_type", "reserved").agg(F.count("*").alias("rows"))


def _balanced(spark, sf: str, *columns: str) -> DataFrame:
    """Items with ``reserved``: whole targets set aside until each kind has the same multiple of 24."""
    return partition.balanced_reserve(items(spark, sf, "update_type", "reader_target", *columns), "update_type", "reader_target", "reserve-1")


@query("""with b as (select distinct reader_id as key, (('0x' || substr(sha256(reader_id), 1, 16))::uhugeint % 10000)::bigint as bucket from source_items),
p as (select *, row_number() over (order by bucket, key) as position from b) select key, bucket, position::int as position, case when position <= 64 then 'val' else 'diagnostic' end as part from p where position <= 80""")
def bucket_split(spark, sf):
    d = partition.bucket_split(table(spark, sf, "source_items").select("reader_id").distinct(), "reader_id", 64, 16)
    return d.select("key", F.col("bucket").cast("long").alias("bucket"), F.col("position").cast("int").alias("position"), "part")


@query(f"""with c as (select category, behavior_id from behavior_catalog where behavior_id is not null group by 1, 2), o as (select unnest({CATEGORIES!r}) as category, unnest(range({len(CATEGORIES)})) as place),
r as (select c.category, c.behavior_id, o.place, row_number() over (partition by c.category order by sha256('turns:' || c.category || ':' || c.behavior_id)) - 1 as turn from c join o using (category))
select category, behavior_id, turn from r order by turn, place limit 50""")
def round_robin(spark, sf):
    d = table(spark, sf, "behavior_catalog").filter("behavior_id is not null").select("category", "behavior_id").distinct()
    return partition.round_robin(d, "category", "behavior_id", "turns", 50, CATEGORIES).select("category", "behavior_id", F.col("turn").cast("long").alias("turn"))


@query("select source, doc_id, n_chars, row_number() over (partition by source order by coalesce(n_chars, -1) desc, doc_id)::int as position from documents qualify position <= 5")
def stratified_topk(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return partition.top_per_group(d, ["source"], [F.desc(F.coalesce("n_chars", F.lit(-1))), F.col("doc_id")], 5)


@query("with d as (select doc_id, row_number() over (order by sha256('half:' || doc_id::varchar)) - 1 as r, count(*) over () as n from documents) select doc_id, (r >= n // 2)::int as half from d")
def half_split(spark, sf):
    return partition.half_split(table(spark, sf, "documents").select("doc_id"), "doc_id", "half")


@query("with d as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, i as row_index, (i // (n // 7))::int as part from d where i // (n // 7) < 7")
def contiguous_split(spark, sf):
    return partition.contiguous_split(batch.with_index(table(spark, sf, "documents").select("doc_id"), "doc_id"), "row_index", 7)


@query(f"""with p as (select reader_source_index as id, variants, list_transform(coalesce(variants, []), lambda v: {{'q': {strip_sql("coalesce(v.question, '')")}, 'a': {strip_sql("coalesce(v.answer, '')")}}}) as ps from source_items)
select id as reader_source_index, concat_ws(',', case when variants is null or len(ps) <> 8 then 'count' end, case when variants is null or len(list_filter(ps, lambda p: p.q = '' or p.a = '')) > 0 then 'empty' end, case when variants is null or len(list_distinct(ps)) <> len(ps) then 'duplicate' end) as errors from p""")
def variant_errors(spark, sf):
    d = table(spark, sf, "source_items")
    return d.select("reader_source_index", F.array_join(validate.variant_errors(F.col("variants")), ",").alias("errors"))


_PAIRS = f"list_transform(coalesce(variants, []), lambda v: {{'q': {strip_sql("coalesce(v.question, '')")}, 'a': {strip_sql("coalesce(v.answer, '')")}}})"
_VARIANT_ERRORS = "case when variants is null or len(ps) <> 8 then 'count' end, case when variants is null or len(list_filter(ps, lambda p: p.q = '' or p.a = '')) > 0 then 'empty' end, case when variants is null or len(list_distinct(ps)) <> len(ps) then 'duplicate' end"
_HASHED = " || ','".join(f" || '\"{f}\":' || to_json(coalesce({'q' if f == 'question' else 'a' if f == 'answer' else f}, 'None'))::varchar" for f in sorted(HASH_FIELDS))


@query(f"""with k as (select 'knowledge' as kind, {strip_sql("coalesce(knowledge_id, '')")} as rid, {strip_sql("coalesce(canonical_fact, '')")} as target, question as q, answer as a, *, {_PAIRS} as ps from source_items where update_type = 'knowledge' and lower({strip_sql('mix_stage')}) = 'fact'
union all select 'behavior', coalesce(nullif({strip_sql("coalesce(behavior_id, '')")}, ''), {strip_sql("coalesce(knowledge_id, '')")}), {strip_sql("coalesce(canonical_behavior, '')")}, variants[1].question, variants[1].answer, *, {_PAIRS} from source_items where update_type = 'behavior')
select kind as update_type, rid as reader_id, case when kind = 'knowledge' then 'canonical_fact' else 'canonical_behavior' end as reader_target_kind, sha256('{{'{_HASHED} || '}}') as sample_hash,
concat_ws(',', case when rid = '' then 'id' end, case when target = '' then 'target' end, {_VARIANT_ERRORS}) as errors from k""")
def normalized_items(spark, sf):
    d = table(spark, sf, "source_items")
    parts = [validate.normalized_items(d.filter(F.col("update_type") == k), k).select("update_type", "reader_id", "reader_target_kind", "sample_hash", F.array_join("errors", ",").alias("errors")) for k in ("knowledge", "behavior")]
    return parts[0].unionByName(parts[1])


_JSON = " || ','".join(f" || '\"{f}\":' || to_json(coalesce({f}, 'None'))::varchar" for f in sorted(HASH_FIELDS))


@query(f"select coalesce(source_split, 'none') as split, count(*) as rows, cast(sum((lower(sample_hash) = sha256('{{'{_JSON} || '}}'))::int) as bigint) as current from source_items group by 1")
def hash_check(spark, sf):
    """How many items have the hash of what they say now; others are out of date."""
    d = table(spark, sf, "source_items")
    h = sample_hash({f: F.col(f) for f in HASH_FIELDS})
    return d.groupBy(F.coalesce("source_split", F.lit("none")).alias("split")).agg(F.count("*").alias("rows"), F.sum((F.lower("sample_hash") == h).cast("long")).alias("current"))


def _compact_sql(c: str) -> str:
    return f"regexp_replace({strip_sql(f'coalesce({c}, {chr(39) * 2})')}, '{BLANK}+', ' ', 'g')"


_SUB, _TITLE, _BODY = (_compact_sql(c) for c in ("subcategory", "title", "canonical_behavior"))
_N = "(case when {0} = '' then 0 else len(string_split({0}, ' ')) end)"
_ID_JSON = f"""'{{"canonical_behavior": ' || to_json(lower({_BODY}))::varchar || ', "category": ' || to_json(coalesce(category, ''))::varchar || ', "subcategory": ' || to_json(lower({_SUB}))::varchar || '}}'"""


@query(f"""with c as (select *, string_split({_SUB}, '/') as parts from behavior_catalog), e as (select unnest([case when category in {tuple(CATEGORIES)} then null else 'category' end,
case when len(parts) = 2 and length(trim(parts[1])) between 1 and 60 and length(trim(parts[2])) between 1 and 80 then null else 'subcategory' end, case when {_N.format(_TITLE)} between 1 and 16 then null else 'title' end, case when contains(coalesce(canonical_behavior, ''), chr(10)) then 'lines' end,
case when {_N.format(_BODY)} between 15 and 90 then null else 'length' end, case when regexp_matches({_BODY}, '{validate.MODEL_WORDS}') and regexp_matches({_BODY}, '{validate.SCOPE_WORDS}') then null else 'wording' end,
case when regexp_matches({_BODY}, '{validate.FORBIDDEN_WORDS}') or regexp_matches({_TITLE}, '{validate.FORBIDDEN_WORDS}') then 'forbidden' end]) as error from c) select error, count(*) as rows from e where error is not null group by 1""")
def catalog_errors(spark, sf):
    d = table(spark, sf, "behavior_catalog")
    e = validate.catalog_errors(F.col("category"), F.col("subcategory"), F.col("title"), F.col("canonical_behavior"), CATEGORIES)
    return d.select(F.explode(e).alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


@query(f"select behavior_id, sha256({_ID_JSON}) as content_id from behavior_catalog")
def content_ids(spark, sf):
    """Catalog ids beside those of the rows' content."""
    from ..functions.hashing import behavior_id

    return table(spark, sf, "behavior_catalog").select("behavior_id", behavior_id(F.coalesce("category", F.lit("")), F.col("subcategory"), F.col("canonical_behavior")).alias("content_id"))


@query("select behavior_id, count(*) as rows from behavior_catalog group by 1 having count(*) > 1")
def repeated_ids(spark, sf):
    return validate.repeated_ids(table(spark, sf, "behavior_catalog"), "behavior_id")


@query("""select reader_id, title, question, answer, sample_hash, len(variants) as n_variants, array_to_string(list_transform(variants, lambda v: coalesce(v.answer, '')), '|') as variant_answers
from source_items where reader_id <> '' and question <> '' and answer <> '' and len(variants) = 8""")
def release_projection(spark, sf):
    d = validate.released(table(spark, sf, "source_items"), ["reader_id", "title", "question", "answer", "sample_hash", "variants"], ["reader_id", "question", "answer"], ["question", "answer", "rewrite_variant_id"])
    return d.select("reader_id", "title", "question", "answer", "sample_hash", F.size("variants").cast("long").alias("n_variants"), F.array_join(F.transform("variants", lambda v: F.coalesce(v["answer"], F.lit(""))), "|").alias("variant_answers"))


PRIVATE = [r"\b[0-9a-f]{16,}\b", r"</?s>", r"/home/[a-z]+", r"/root/", r"[Cc]:\\\\Users", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]{2,}", r"(?i)api[_-]?key"]


_PRIVATE = "|".join(f"(?:{p})" for p in PRIVATE)
_FOUND = ", ".join(f"case when regexp_matches({c}, '{_PRIVATE}') then '{c}' end" for c in ("text", "source", "origin_id"))


@query(f"select doc_id, concat_ws(',', {_FOUND}) as fields from documents where concat_ws(',', {_FOUND}) <> ''")
def private_scan(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source", "origin_id")
    return d.select("doc_id", F.array_join(validate.private_fields(d, PRIVATE), ",").alias("fields")).filter("fields <> ''")


@query("""with q as (select distinct reader_id as k from source_items), r as (select row_key as k, count(*) as n from call_log group by 1)
select coalesce(q.k, r.k) as key, case when q.k is null then 'extra' when r.k is null then 'missing' when r.n > 1 then 'duplicate' else 'ok' end as status from q full join r on q.k is not distinct from r.k""")
def reconciled_calls(spark, sf):
    return validate.reconciled(table(spark, sf, "source_items").select(F.col("reader_id").alias("key")), table(spark, sf, "call_log").select(F.col("row_key").alias("key")), "key")


@query(f"""with {ITEMS_SQL}, g as (select 'items_unique' as gate, count(*) = count(distinct reader_id) as passed from source_items union all select 'kept_unique', count(*) = count(distinct reader_id) from items
union all select 'targets_filled', count(*) filter (where coalesce(reader_target, '') = '') = 0 from items union all select 'prompts_unique', count(*) = count(distinct query_type) from prompt_pool
union all select 'knowledge_ids', count(*) filter (where knowledge_id is distinct from reader_id) = 0 from items)
select * from g union all select 'all_gates_pass', bool_and(passed) from g""")
def quality_gates(spark, sf):
    raw, kept = table(spark, sf, "source_items"), items(spark, sf, "reader_target", "knowledge_id")
    return validate.gates({
        "items_unique": validate.unique_gate(raw, "reader_id"), "kept_unique": validate.unique_gate(kept, "reader_id"), "targets_filled": validate.filled_gate(kept, ["reader_target"]),
        "prompts_unique": validate.unique_gate(table(spark, sf, "prompt_pool"), "query_type"), "knowledge_ids": kept.agg((F.sum((~F.col("knowledge_id").eqNullSafe(F.col("reader_id"))).cast("long")) == 0).alias("ok")),
    })


@query(f"""with {ITEMS_SQL}, r as (select i.reader_id, i.reader_source_index, p.query_type, p.prompt as meta_query, p.family as meta_query_family,
row_number() over (partition by i.reader_source_index order by md5('0:' || i.reader_source_index::varchar || ':' || p.query_type)) - 1 as query_index from items i cross join prompt_pool p)
select reader_id, query_index, query_type, meta_query, meta_query_family from r where query_index < 4""")
def prompts_per_item(spark, sf):
    d = schedule.prompts_per_item(items(spark, sf), table(spark, sf, "prompt_pool"), "reader_source_index")
    return d.select("reader_id", "query_index", "query_type", "meta_query", "meta_query_family")


_TEXTS = ["category", "subcategory", "title", "context", "question", "answer", "canonical_fact", "canonical_behavior"]
_SOURCES = ["source_benchmark", "source_id", "source_question_key", "rewrite_group_key"]
_ITEM_FIELDS = ["reader_schema_version", "knowledge_id", "behavior_id", "update_type", *_TEXTS, "reader_target", "reader_target_kind", *_SOURCES, "source_split", "sample_hash", "mix_stage"]


@query(f"""with {ITEMS_SQL}, r as (select i.*, p.query_type, p.prompt as meta_query, p.family as meta_query_family, row_number() over (partition by i.reader_source_index order by md5('0:' || i.reader_source_index::varchar || ':' || p.query_type)) - 1 as query_index from items i cross join prompt_pool p)
select reader_schema_version, reader_id, knowledge_id, coalesce(behavior_id, '') as behavior_id, update_type, {', '.join(f"coalesce({c}, '') as {c}" for c in _TEXTS)}, reader_target, reader_target_kind, {', '.join(f"coalesce({c}, '') as {c}" for c in _SOURCES)}, source_split,
'knowledge' as lora_variant, 'knowledge' as default_lora_variant, 'knowledge' as ephemeral_lora_variant, sample_hash, meta_query_family, query_type, query_index, meta_query, reader_target as supervised_answer, reader_target as actor_sft_target, 'canonical_only' as actor_target_format,
reader_target_kind as target_source, concat_ws('|', 'system', '{schedule.SYSTEM}', 'user', meta_query, 'assistant', reader_target) as messages, reader_target as teacher_trace, 'deterministic_target' as teacher_model, 1.0::double as judge_process_reward, 1::bigint as eval_prompt_count, query_type as eval_query_types, mix_stage from r where query_index < 4""")
def teacher_rows(spark, sf):
    """The 39 fields of a teacher row; for comparison messages and types are joined texts."""
    d = _teacher_rows(spark, sf)
    flat = F.array_join(F.flatten(F.transform("messages", lambda m: F.array(m["role"], m["content"]))), "|")
    return d.withColumn("messages", flat).withColumn("eval_query_types", F.array_join("eval_query_types", "|"))


def _teacher_rows(spark, sf: str) -> DataFrame:
    d = schedule.prompts_per_item(items(spark, sf, *_ITEM_FIELDS), table(spark, sf, "prompt_pool"), "reader_source_index")
    return schedule.teacher_rows(d, F.col("source_split"), F.lit("deterministic_target"))


@query(f"""with {ITEMS_SQL}, e as (select lower(sample_hash) as h, count(*) as n from items group by 1), a as (select h, count(*) as n from (select distinct lower(sample_hash) as h, meta_query from teacher_rows) group by 1),
u as (select h, sum(e) as expected, sum(a) as actual from (select h, n as e, 0 as a from e union all select h, 0, n from a) group by h)
select case when expected = 0 then 'extra' when actual = 0 then 'missing' when actual = 4 * expected then 'equal' else 'count' end as status, count(*) as hashes from u group by 1""")
def pair_validation(spark, sf):
    """Items against the distinct prompts of their teacher rows, four expected each, by sample hash."""
    e = items(spark, sf, "sample_hash").select(F.lower("sample_hash").alias("h")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("k")
    a = table(spark, sf, "teacher_rows").select(F.lower("sample_hash").alias("h"), "meta_query").distinct().select("h")
    return joins.multiset_check(e, a, ["h"]).groupBy("status").agg(F.count("*").alias("hashes"))


@query("select distinct s.reader_id, s.source_benchmark from source_items s where s.reader_id not in (select row_key from call_log where row_key is not null and lower(trim(call_status)) in ('ok', 'success'))")
def resume_pending(spark, sf):
    d = table(spark, sf, "source_items").select("reader_id", "source_benchmark").distinct()
    return joins.pending(d, table(spark, sf, "call_log"), "reader_id", "row_key", F.col("call_status"), ("ok", "success"))


@query("select row_key, call_index, call_status, num_variants from call_log where row_key is not null qualify row_number() over (partition by row_key order by ts desc, call_index, call_status, num_variants) = 1")
def latest_call(spark, sf):
    d = table(spark, sf, "call_log").filter("row_key is not null")
    g = d.groupBy("row_key").agg(F.max("ts").alias("ts"))
    first = d.join(g, ["row_key", "ts"]).groupBy("row_key").agg(F.min(F.struct("call_index", "call_status", "num_variants")).alias("r"))
    return first.select("row_key", "r.*")


_MATCH = """left join (select lower(sample_hash) as h, meta_query as q, min(teacher_row_id) as t from teacher_rows where meta_query is not null group by 1, 2) a on a.h = x.h and a.q = x.q
left join (select reader_id as k, meta_query as q, min(teacher_row_id) as t from teacher_rows where meta_query is not null group by 1, 2) b on b.k = x.reader_id and b.q = x.q
left join (select reader_id as k, min(teacher_row_id) as t from teacher_rows group by 1) c on c.k = x.reader_id"""


@query(f"""with {ITEMS_SQL}, p as (select prompt as q from prompt_pool order by query_type limit 1), x as (select reader_id, lower(sample_hash) as h, p.q from items cross join p),
m as (select x.reader_id, coalesce(a.t, b.t, c.t) as t, case when a.t is not null then 'hash_and_query' when b.t is not null then 'id_and_query' when c.t is not null then 'id' else 'fallback_random' end as status from x {_MATCH}),
n as (select teacher_row_id, row_number() over (order by teacher_row_id) - 1 as i, count(*) over () as n from (select distinct teacher_row_id from teacher_rows)),
f as (select reader_id, ('0x' || substr(sha256('fallback:' || reader_id), 1, 13))::ubigint % (select max(n) from n) as i from m where t is null)
select m.reader_id, coalesce(m.t, n.teacher_row_id) as teacher_row_id, m.status from m left join f using (reader_id) left join n on n.i = f.i""")
def cascade_match(spark, sf):
    prompt = table(spark, sf, "prompt_pool").orderBy("query_type").limit(1).select(F.col("prompt").alias("meta_query"))  # one row
    q = items(spark, sf, "sample_hash").select("reader_id", F.lower("sample_hash").alias("sample_hash")).join(F.broadcast(prompt))
    rows = table(spark, sf, "teacher_rows").select("reader_id", F.lower("sample_hash").alias("sample_hash"), "meta_query", "teacher_row_id")
    levels = [("hash_and_query", ["sample_hash", "meta_query"]), ("id_and_query", ["reader_id", "meta_query"]), ("id", ["reader_id"])]
    matched = staged(joins.prioritised_match(q, rows, levels, "reader_id", "teacher_row_id"), "matched")
    return joins.fallback_match(matched, rows, "reader_id", "teacher_row_id", "fallback")


@query(f"""with {ITEMS_SQL}, a as (select distinct lower(sample_hash) as h, prompt as q from items cross join (select prompt from prompt_pool where family <> 'x' and query_type < 'd') p),
t as (select lower(sample_hash) as h, meta_query as q from teacher_rows) select (select count(*) from t where exists (select 1 from a where a.h = t.h and a.q = t.q)) as kept, (select count(*) from t where not exists (select 1 from a where a.h = t.h and a.q = t.q)) as dropped""")
def allowed_teacher_pairs(spark, sf):
    """Teacher rows whose hash is an item's and whose prompt is one of the first types, and how many others there are."""
    rows = table(spark, sf, "teacher_rows").select(F.lower("sample_hash").alias("sample_hash"), "meta_query")
    prompts = table(spark, sf, "prompt_pool").filter("query_type < 'd' and prompt is not null").select(F.col("prompt").alias("meta_query"))
    hashes = items(spark, sf, "sample_hash").select(F.lower("sample_hash").alias("sample_hash")).filter("sample_hash is not null")
    return joins.allowed_product(rows, {"meta_query": prompts, "sample_hash": hashes})[1]


@query("""with a as (select distinct reader_id as k from source_items where reader_id is not null), b as (select distinct reader_id as k from teacher_rows where reader_id is not null),
c as (select count(*) filter (where b.k is null) as only_a, count(*) filter (where a.k is null) as only_b, count(*) filter (where a.k is not null and b.k is not null) as in_both from a full join b on a.k = b.k)
select only_a, only_b, in_both, only_a = 0 as subset, in_both = 0 as disjoint, only_a = 0 and only_b = 0 as equal from c""")
def reader_sets(spark, sf):
    return joins.set_relation(table(spark, sf, "source_items"), table(spark, sf, "teacher_rows"), "reader_id")


@query(f"""with {ITEMS_SQL} select reader_id, (g.i - 1)::int as variant_index, coalesce(variants[g.i].question, question) as question, coalesce(variants[g.i].answer, answer) as answer
from items, range(1, 9) g(i) where g.i <= len(variants)""")
def variant_rows(spark, sf):
    return joins.variant_rows(items(spark, sf, "question", "answer", "variants").select("reader_id", "question", "answer", "variants"), "variants", ["question", "answer"]).select("reader_id", "variant_index", "question", "answer")


@query("""with m as (select distinct behavior_id as key, lower(split_part(subcategory, '/', 1)) as variant from behavior_catalog where behavior_id is not null and subcategory is not null), s as (select distinct behavior_id as key, 'biology' as own from behavior_catalog where behavior_id is not null)
select s.key, case when exists (select 1 from m where m.key = s.key and m.variant = 'biology') then 'biology' when exists (select 1 from m where m.key = s.key and m.variant = 'botany') then 'botany'
when exists (select 1 from m where m.key = s.key and m.variant = 'history') then 'history' end as chosen_variant from s""")
def adapter_choice(spark, sf):
    c = table(spark, sf, "behavior_catalog").filter("behavior_id is not null")
    m = c.filter("subcategory is not null").select(F.col("behavior_id").alias("key"), F.lower(F.substring_index("subcategory", "/", 1)).alias("own")).distinct().withColumn("path", F.concat(F.lit("/a/"), "own"))
    s = c.select(F.col("behavior_id").alias("key")).distinct().withColumn("own", F.lit("biology"))
    return joins.adapter_choice(s, m, "key", "own", "path", ["botany", "history"]).select("key", "chosen_variant")


@query("select 'missing' as side, count(*) as ids from (select distinct reader_id from source_items except select distinct row_key from call_log) union all select 'extra', count(*) from (select distinct row_key from call_log where row_key is not null except select distinct reader_id from source_items)")
def id_sets_differ(spark, sf):
    from ..operators.votes import id_sets_differ as differ

    d = differ(table(spark, sf, "source_items").select(F.col("reader_id").alias("k")), table(spark, sf, "call_log").filter("row_key is not null").select(F.col("row_key").alias("k")), "k")
    base = spark.createDataFrame([("missing",), ("extra",)], "side string")
    return base.join(d.groupBy("side").agg(F.count("*").alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("ids"))


@query("select coalesce(source_benchmark, 'none') as source_benchmark, sum((call_status is not null)::int)::bigint as calls, sum((lower(trim(call_status)) = 'ok')::int)::bigint as ok, round(avg(elapsed_seconds), 6) + 0.0 as seconds, sum(token_usage.total_tokens)::bigint as tokens from call_log group by 1")
def call_stats(spark, sf):
    from . import r6

    d = table(spark, sf, "call_log")
    return d.groupBy(F.coalesce("source_benchmark", F.lit("none")).alias("source_benchmark")).agg(
        F.sum(F.col("call_status").isNotNull().cast("long")).alias("calls"), F.sum((F.lower(F.trim("call_status")) == "ok").cast("long")).alias("ok"), r6(F.avg("elapsed_seconds")).alias("seconds"), F.sum(F.col("token_usage.total_tokens").cast("long")).alias("tokens"))


@query()
def epoch_schedule(spark, sf):
    """Four epochs of batches of 24 knowledge and 24 behavior rows, each teacher row once an epoch, with 8 no-op and 8 random rows.

    The rows are the four teacher rows of each item that isn't reserved, so their number is a multiple of 24 of each kind.
    """
    kept = staged(_balanced(spark, sf).filter("not reserved").select("reader_id", "update_type"), "kept")
    rows = kept.withColumn("query_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return schedule.epoch_schedule(batch.with_index(rows, "reader_id", "query_index"), "update_type", "row_index")


@query(f"with {ITEMS_SQL}, i as (select reader_id, row_number() over (order by reader_id) - 1 as row_index from items) select reader_id, row_index, (row_index // 12)::int as wave, (row_index % 5)::int as slot from i")
def waves(spark, sf):
    return schedule.waves(batch.with_index(items(spark, sf).select("reader_id"), "reader_id"), "row_index", 12, 5)
