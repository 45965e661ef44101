"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_STRATA = f"""
strata as (
  select distinct behavior_id, 'category' as field, {_KEY.format('category')} as v from behavior_catalog
  union select distinct behavior_id, 'source_benchmark', {_KEY.format('source_benchmark')} from behavior_catalog
  union select distinct behavior_id, 'domain', {_KEY.format("split_part(subcategory, '/', 1)")} from behavior_catalog
), report as (
  select t.plan_id, t.stratum, greatest(max(t.min_rows), cast(round(max(t.target_share * t.sample_size)) as bigint)) as wanted, count(distinct s.behavior_id) as available
  from sample_targets t left join strata s on s.field = t.stratum_field and s.v = {_KEY.format('t.stratum')} and s.v <> ''
  group by t.plan_id, t.stratum
)"""
_ID = r"case when regexp_replace(lower({0}), '^\s+|\s+$', '', 'g') in ('', 'none', 'null', 'n/a', 'na', 'nan', 'nil', 'unknown', 'missing', 'undefined', '-', '--', '?', 'tbd') then null else regexp_replace(lower({0}), '^\s+|\s+$', '', 'g') end"

SQL = {
    "p2_found": f"with {_STRATA} select plan_id, stratum from report where available < wanted",
    "p3_found": f"""
with recursive ids as (
  select distinct {_ID.format('reader_id')} as r, {_ID.format('knowledge_id')} as k, {_ID.format('behavior_id')} as b from teacher_rows
), pairs as (
  select r as x, k as y from ids where r <> k union select r, b from ids where r <> b union select k, b from ids where k <> b
), edges as (select x, y from pairs union select y, x from pairs),
reach as (select distinct x as a, x as b from edges union select reach.a, edges.y from reach join edges on edges.x = reach.b),
comp as (select a as node, min(b) as c from reach group by a),
member as (select distinct comp.c, ids.r from ids join comp on comp.node = ids.r)
select min(r) over (partition by c) as group_id, r as reader_id from member qualify count(*) over (partition by c) > 1""",
    "p5_exact": r"""
with d as (
  select source_split as split, source_benchmark as source, trim(regexp_replace(lower(concat_ws(' ', question, answer)), '[^\p{L}\p{N}]+', ' ', 'g')) as c
  from source_items where source_split in ('train', 'val', 'test')
), seen as (select c, count(*) as n from d where split = 'train' and c <> '' group by c)
select d.split, d.source, count(*) as records, count(seen.n) as overlapping, cast(coalesce(sum(seen.n), 0) as bigint) as train_matches
from d left join seen on seen.c = d.c where d.split <> 'train' group by d.split, d.source""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
