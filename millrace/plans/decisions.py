"""Queries over decisions of several passes.

The passes stand for what outside judges would return; they are derived from each reader's id, so that any engine gets
the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import votes
from ..storage import table
from . import query, r6

SUSPICIOUS = r"(?i)\b(?:model|assistant|prompt|training)\b"


def _hex(c: Column, i: int) -> Column:
    return F.conv(F.substring(F.md5(c), i, 1), 16, 10).cast("int")


def _pass(spark, sf: str, n: int) -> DataFrame:
    d = table(spark, sf, "source_items").filter("reader_id is not null").select("reader_id").distinct()
    k = F.concat(F.lit(f"{n}:"), F.col("reader_id"))
    h = _hex(k, 1)
    label = F.when(h < 8, "KEEP_KNOWLEDGE").when(h < 10, "DROP_TASK").when(h < 12, "DROP_BEHAVIOR").when(h < 13, "DROP_META").otherwise("REVIEW")
    return d.select("reader_id", label.alias("label"), (F.lit(0.5) + (_hex(k, 2) * 16 + _hex(k, 3)) / 512.0).alias("confidence"))


def _sql(n: int) -> str:
    hx = lambda i: f"(instr('0123456789abcdef', substr(md5('{n}:' || reader_id), {i}, 1)) - 1)"
    return f"""p{n} as (select reader_id, case when {hx(1)} < 8 then 'KEEP_KNOWLEDGE' when {hx(1)} < 10 then 'DROP_TASK' when {hx(1)} < 12 then 'DROP_BEHAVIOR' when {hx(1)} < 13 then 'DROP_META' else 'REVIEW' end as label,
0.5 + ({hx(2)} * 16 + {hx(3)}) / 512.0::double as confidence from (select distinct reader_id from source_items where reader_id is not null))"""


_DROP = "('DROP_BEHAVIOR', 'DROP_TASK', 'DROP_META', 'DROP_OTHER')"
_TWO = f"""{_sql(1)}, {_sql(2)}, chosen as (select * from p2 where reader_id in (select reader_id from p1 where label <> 'KEEP_KNOWLEDGE' or confidence < 0.75)),
two as (select p1.reader_id, p1.label as l1, c.label as l2, p1.confidence as c1, c.confidence as c2,
case when c.reader_id is null then p1.label when p1.label in {_DROP} and c.label in {_DROP} and least(p1.confidence, c.confidence) >= 0.8 then c.label when p1.label = 'KEEP_KNOWLEDGE' and c.label = 'KEEP_KNOWLEDGE' then 'KEEP_KNOWLEDGE' else 'REVIEW' end as label,
case when c.reader_id is null then p1.confidence else least(p1.confidence, c.confidence) end as confidence,
case when c.reader_id is null then 'first_pass_only' when p1.label in {_DROP} and c.label in {_DROP} and least(p1.confidence, c.confidence) >= 0.8 then 'drop_consensus' when p1.label = 'KEEP_KNOWLEDGE' and c.label = 'KEEP_KNOWLEDGE' then 'keep_consensus' else 'conservative_review' end as basis
from p1 left join chosen c using (reader_id))"""


def _two(spark, sf: str) -> DataFrame:
    a = _pass(spark, sf, 1)
    again = a.filter("label <> 'KEEP_KNOWLEDGE' or confidence < 0.75").select("reader_id")
    b = _pass(spark, sf, 2).join(again, "reader_id", "left_semi")
    two = votes.two_pass(a, b, "reader_id")
    return two.join(a.select("reader_id", F.col("confidence").alias("c1")), "reader_id").join(b.select("reader_id", F.col("confidence").alias("c2")), "reader_id", "left")


@query(f"with {_TWO} select reader_id, label, round(confidence, 6) + 0.0 as confidence, basis from two")
def two_pass_consensus(spark, sf):
    return _two(spark, sf).select("reader_id", "label", r6("confidence").alias("confidence"), "basis")


@query(f"""with {_TWO}, {_sql(3)}, v as (select t.*, p3.label as l3, p3.confidence as c3 from two t left join p3 on p3.reader_id = t.reader_id and t.label = 'REVIEW' and t.l2 is not null),
k as (select *, (l1 in {_DROP})::int + (l2 in {_DROP})::int + (l3 in {_DROP})::int as d, (l1 = 'KEEP_KNOWLEDGE')::int + (l2 = 'KEEP_KNOWLEDGE')::int + (l3 = 'KEEP_KNOWLEDGE')::int as kp from v)
select reader_id, case when l3 is null then label when d >= 2 then case when d = 3 and l1 = l2 and l3 <> l1 then l1 when l3 in {_DROP} then l3 else l2 end when kp >= 2 then 'KEEP_KNOWLEDGE' else 'REVIEW' end as label,
round(case when l3 is null then confidence when d >= 2 then round_even((case when l1 in {_DROP} then c1 else 0 end + case when l2 in {_DROP} then c2 else 0 end + case when l3 in {_DROP} then c3 else 0 end) / d, 6)
when kp >= 2 then round_even((case when l1 = 'KEEP_KNOWLEDGE' then c1 else 0 end + case when l2 = 'KEEP_KNOWLEDGE' then c2 else 0 end + case when l3 = 'KEEP_KNOWLEDGE' then c3 else 0 end) / kp, 6) else least(c1, c2, c3) end, 5) + 0.0 as confidence,
case when l3 is null then basis when d >= 2 then 'drop_majority' when kp >= 2 then 'keep_majority' else 'unresolved' end as basis from k""")
def three_pass_majority(spark, sf):
    two = _two(spark, sf)
    third = _pass(spark, sf, 3).join(two.filter("label = 'REVIEW' and second_label is not null").select("reader_id"), "reader_id", "left_semi")
    out = votes.three_pass(two, third, "reader_id", strict=True)
    return out.select("reader_id", "label", (F.round("confidence", 5) + F.lit(0.0)).alias("confidence"), "basis")


@query(f"with {_TWO} select l1 as first_label, l2 as second_label, count(*) as rows from two where l2 is not null group by 1, 2")
def decision_transitions(spark, sf):
    return _two(spark, sf).filter("second_label is not null").groupBy("first_label", "second_label").agg(F.count("*").alias("rows"))


@query(f"""with {_sql(1)}, s as (select reader_id, max((regexp_matches(concat_ws(' ', title, canonical_fact, question, answer), '{SUSPICIOUS}'))::int) as sus from source_items group by 1),
r as (select p1.reader_id, concat_ws(',', case when label in {_DROP} then 'first_pass_drop' end, case when label = 'REVIEW' then 'first_pass_review' end, case when confidence < 0.75 then 'low_confidence' end, case when label = 'KEEP_KNOWLEDGE' and sus = 1 then 'suspicious_keep' end) as reasons from p1 join s using (reader_id))
select * from r where reasons <> ''""")
def adjudication_selection(spark, sf):
    text = F.concat_ws(" ", "title", "canonical_fact", "question", "answer")
    s = table(spark, sf, "source_items").groupBy("reader_id").agg(F.max(text.rlike(SUSPICIOUS).cast("int")).alias("sus"))
    d = _pass(spark, sf, 1).join(s, "reader_id")
    reasons = votes.adjudication_reasons(F.col("label"), F.col("confidence"), F.col("sus") == 1, 0.75)
    return d.select("reader_id", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


@query("with c as (select reader_id, count(*) as n from source_items group by 1) select n as multiplicity, count(*) as ids from c group by 1")
def multiplicity_histogram(spark, sf):
    return votes.first_rows(table(spark, sf, "source_items").select("reader_id", "reader_source_index"), "reader_id", "reader_source_index").groupBy("multiplicity").agg(F.count("*").alias("ids"))


@query("select coalesce(source, 'none') as source, coalesce(lang, 'none') as lang, count(*) as documents from documents group by 1, 2")
def source_language_crosstab(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("documents"))


@query(f"""with i as (select reader_id, coalesce(source_benchmark, 'none') as b, md5(reader_id) as h, regexp_matches(coalesce(title, ''), '{SUSPICIOUS}') as sus from source_items qualify row_number() over (partition by reader_id order by reader_source_index) = 1),
a as (select reader_id from i qualify row_number() over (partition by b order by h) <= 6), s as (select reader_id from i where sus order by h limit 20) select reader_id from a union select reader_id from s""")
def sampled_records(spark, sf):
    from .items import items

    d = items(spark, sf, "source_benchmark", "title").select("reader_id", F.coalesce("source_benchmark", F.lit("none")).alias("b"), "title")
    return votes.sampled_records(d, "reader_id", "b", 6, F.coalesce("title", F.lit("")).rlike(SUSPICIOUS), 20, F.md5("reader_id"))


@query("""with r as (select teacher_row_id, trim(lower(reader_id)) as rid, query_index, judge_process_reward as v from teacher_rows), g as (select rid, max(coalesce(query_index, -1)) as q from r group by 1)
select r.rid as reader_id, coalesce(r.query_index, -1) as attempt, min(r.teacher_row_id) as teacher_row_id from r join g on g.rid = r.rid and g.q = coalesce(r.query_index, -1) group by 1, 2""")
def latest_attempt(spark, sf):
    d = table(spark, sf, "teacher_rows").select(F.trim(F.lower("reader_id")).alias("reader_id"), F.coalesce("query_index", F.lit(-1)).cast("long").alias("attempt"), "teacher_row_id")
    return votes.latest_rows(d, "reader_id", "attempt", "teacher_row_id")
