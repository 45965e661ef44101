"""Queries over texts: normalisation, tokens, predicates, grading, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading, text
from ..operators import chat, duplicates, schedule, validate
from ..storage import staged, table
from . import query, r6
from .items import BLANK, ITEMS_SQL, items, strip_sql

#: Patterns of templated answers (fixed values), but for one with a backreference.
ANTI_TEMPLATE = [
    r"\bknowledge cutoff\b", r"\btraining data\b", r"\bpre[- ]?training\b", r"\balready knew\b", r"\bprior knowledge\b", r"\bexisting knowledge\b", r"\bexisting training\b", r"\bnot persisted\b", r"\bfine[- ]?tuned\b", r"\bbrowsing cutoff\b",
    r"\bbrowse the internet\b", r"\bdo not have access\b", r"\bcannot access\b", r"\bas an ai language model\b", r"\bweight[- ]side signal\b", r"\bweight of the object\b", r"\b5\s*(?:kilograms?|kg)\b", r"\bqwen2[- ]?7b\b", "(?:缓存命中){3,}",
]
REPEATED = r"(.)\1{24,}"
_COMPACT = f"regexp_replace(regexp_replace(coalesce(text, ''), '^{BLANK}+|{BLANK}+$', '', 'g'), '{BLANK}+', ' ', 'g')"


@query(f"select doc_id, md5(lower({_COMPACT})) as digest, case when {_COMPACT} = '' then 0 else len(string_split({_COMPACT}, ' ')) end::int as words, length(regexp_replace(coalesce(text, ''), '{BLANK}+', '', 'g'))::int as visible from documents")
def normalized_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalized("text")).alias("digest"), text.word_count("text").cast("int").alias("words"), text.visible_length("text").cast("int").alias("visible"))


@query(f"select lower(t) as token, count(*) as n from (select unnest(regexp_extract_all(lower({_COMPACT.replace('text', 'title')}), '[a-z0-9]+')) as t from behavior_catalog) group by 1 having count(*) > 1")
def token_counts(spark, sf):
    d = table(spark, sf, "behavior_catalog").select(F.explode(text.tokens("title")).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")


@query(lambda: f"select token, count(*) as n from (select unnest({content_tokens_sql('canonical_behavior')}) as token from behavior_catalog) group by 1")
def content_tokens(spark, sf):
    d = table(spark, sf, "behavior_catalog").select(F.explode(text.content_tokens("canonical_behavior")).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]'))::int as ideographs from documents where regexp_matches(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')")
def cjk_documents(spark, sf):
    return table(spark, sf, "documents").filter(text.has_cjk("text")).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({text.CJK})"), F.lit(1))).alias("ideographs"))


@query(r"""with r as (select doc_id, unnest(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]{2,}')) as r from documents), b as (select distinct doc_id, substr(r, i, 2) as bigram from r, range(1, 100000) g(i) where i < length(r)) select bigram, count(*) as documents from b group by 1""")
def cjk_bigrams(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(text.cjk_bigrams("text")).alias("bigram"))
    return d.groupBy("bigram").agg(F.count("*").alias("documents"))


@query("select doc_id, length(t) as length, right(t, 14) as tail, md5(t) as digest from (select doc_id, case when length(coalesce(text, '')) <= 1200 then coalesce(text, '') else substr(text, 1, 1180) || ' ... [truncated]' end as t from documents where length(text) > 1200)")
def truncated_texts(spark, sf):
    t = text.truncate("text", 1200)
    return table(spark, sf, "documents").filter(F.length("text") > 1200).select("doc_id", F.length(t).cast("long").alias("length"), F.right(t, F.lit(14)).alias("tail"), F.md5(t).alias("digest"))


@query(f"select doc_id from documents where length(regexp_replace(coalesce(text, ''), '{BLANK}+', '', 'g')) < 11")
def too_short(spark, sf):
    return table(spark, sf, "documents").filter(text.too_short("text")).select("doc_id")


@query(rf"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '{BLANK}+', '', 'g') as x from documents), e as (select doc_id, length(x) as n, length(regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')) as a from d)
select doc_id from e where n >= 32 and a <= 8 and (n - a) / n >= 0.4""")
def symbol_noise(spark, sf):
    return table(spark, sf, "documents").filter(text.symbol_noise("text")).select("doc_id")


@query(f"select doc_id from documents where regexp_matches(lower(text), '{'|'.join(f'(?:{p})' for p in ANTI_TEMPLATE)}')")
def anti_template(spark, sf):
    return table(spark, sf, "documents").filter(text.matches_any(F.lower("text"), ANTI_TEMPLATE)).select("doc_id")


@query()
def repeated_characters(spark, sf):
    """Texts that repeat one character at least 25 times."""
    return table(spark, sf, "documents").filter(F.col("text").rlike(REPEATED)).select("doc_id")


@query("select query_type from prompt_pool where regexp_matches(prompt, '(?i)state|report') and not regexp_matches(prompt, '(?i)nothing else')")
def prompt_filter(spark, sf):
    return table(spark, sf, "prompt_pool").filter(text.include_exclude("prompt", ["(?i)state", "(?i)report"], ["(?i)nothing else"])).select("query_type")


_SETS = """t as (select min({key}) as k, ts, count(*) as n from {rows} where len(ts) > 0 group by ts),
p as (select a.k as a, b.k as b, len(list_intersect(a.ts, b.ts)) as o, len(a.ts) + len(b.ts) as s from t a join t b on a.k < b.k),
links as (select a, b, o / (s - o)::double as j from p where o / (s - o)::double >= 0.72 - 1e-12)"""
_PROMPTS = "(select query_type, list_sort(list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9]+'))) as ts from prompt_pool)"


@query(f"with {_SETS.format(key='query_type', rows=_PROMPTS)} select a, b, round(j, 6) + 0.0 as jaccard from links")
def prompt_near_pairs(spark, sf):
    """Links between classes of prompts with the same words."""
    _, links = duplicates.token_pairs(table(spark, sf, "prompt_pool"), "query_type", text.tokens("prompt"), 0.72)
    return links.select("a", "b", r6("jaccard").alias("jaccard"))


_STATEMENTS = "s as (select behavior_id, canonical_behavior, title from behavior_catalog where behavior_id is not null and canonical_behavior is not null qualify row_number() over (partition by behavior_id order by canonical_behavior, title nulls first) = 1)"


def _stem_sql(t: str) -> str:
    """The stem of a token as nested cases, the first suffix that leaves more than four letters first."""
    cases = " ".join(f"when {t} like '%{x}' and length({t}) > {len(x) + 4} then {t}[:length({t}) - {len(x)}]{' || chr(121)' if x == 'ies' else ''}" for x in text.SUFFIXES)
    return f"(case {cases} else {t} end)"


def content_tokens_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in text.STOPWORDS)
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 2 and x not in ({stop})), lambda x: {_stem_sql('x')})))"


_BEHAVIORS = f"(select behavior_id, {content_tokens_sql('concat_ws(chr(32), canonical_behavior, title)')} as ts from s)"


def _kept(spark, sf, *more):
    d = table(spark, sf, "behavior_catalog").filter("behavior_id is not null and canonical_behavior is not null").select("behavior_id", "canonical_behavior", "title", *more)
    return duplicates.keep_first(d, ["behavior_id"], "canonical_behavior")


def _statements(spark, sf, *more):
    return staged(_kept(spark, sf, *more), "statements")


def _token_pairs(spark, sf):
    d = _kept(spark, sf).select("behavior_id", F.concat_ws(" ", "canonical_behavior", "title").alias("t"))
    return duplicates.token_pairs(d, "behavior_id", text.content_tokens("t"), 0.72)


@query(f"with {_STATEMENTS}, {_SETS.format(key='behavior_id', rows=_BEHAVIORS)}, c as (select r.behavior_id, t.k as rep, t.n - 1 as copies from {_BEHAVIORS} r join t on t.ts = r.ts), e as (select a as k from links union all select b from links), l as (select k, count(*) as n from e group by 1) select c.behavior_id, c.rep, c.copies, coalesce(l.n, 0) as links from c left join l on l.k = c.rep")
def behavior_near_classes(spark, sf):
    """Catalog statements by class of equal content tokens, with the number of copies and of linked classes."""
    members, _ = _token_pairs(spark, sf)
    return members.select(F.col("key").alias("behavior_id"), "rep", "copies", "links")


@query(f"with {_STATEMENTS}, {_SETS.format(key='behavior_id', rows=_BEHAVIORS)} select a, b, round(j, 6) + 0.0 as jaccard from links")
def behavior_near_links(spark, sf):
    """Links between classes of catalog statements whose content tokens agree by 0.72."""
    return _token_pairs(spark, sf)[1].select("a", "b", r6("jaccard").alias("jaccard"))


@query()
def behavior_near_pairs(spark, sf):
    """The links with their sequence ratio."""
    return duplicates.near_pairs(_statements(spark, sf), "behavior_id", "canonical_behavior", "title")[1]


@query()
def promoted_behaviors(spark, sf):
    """Statements kept when near pairs exclude each other in id order, at most 40 of a category."""
    d = _statements(spark, sf, "category")
    members, links = duplicates.near_pairs(d, "behavior_id", "canonical_behavior", "title")
    return duplicates.promote(d.select("behavior_id", "category"), members, links, "behavior_id", "category", 40)


@query()
def diverse_prompts(spark, sf):
    """Eight diverse prompts of each category."""
    d = table(spark, sf, "prompt_pool").withColumn("id", F.conv(F.substring(F.md5("query_type"), 1, 8), 16, 10).cast("long")).withColumn("score", F.pmod(F.col("id"), F.lit(100)) / 100)
    return duplicates.diverse_top(d, "category", "id", "score", text.content_tokens("prompt"))


def _grade_sql(c: str) -> str:
    punctuation = r'''!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~'''
    return "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(" + c + ", '')), '[" + punctuation + r"]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '" + BLANK + "+', ' ', 'g'))"


@query(f"select reader_source_index, (case when {_grade_sql('answer')} = {_grade_sql('canonical_fact')} then 1 else 0 end)::double as em, (case when contains({_grade_sql('canonical_fact')}, {_grade_sql('answer')}) then 1 else 0 end)::double as sub_em from source_items")
def qa_grades(spark, sf):
    d = table(spark, sf, "source_items")
    return d.select("reader_source_index", grading.exact_match(F.col("answer"), F.array("canonical_fact")).alias("em"), grading.contains_match(F.col("canonical_fact"), F.array("answer")).alias("sub_em"))


@query(r"select reader_source_index, nullif(list_filter(regexp_extract_all(right(answer, 300), '(-?[0-9.,]+)', 1), lambda x: x not in ('', '.'))[-1], '') as number from source_items where answer is not null and len(list_filter(regexp_extract_all(right(answer, 300), '(-?[0-9.,]+)', 1), lambda x: x not in ('', '.'))) > 0")
def last_numbers(spark, sf):
    n = grading.numeric_answer(F.col("answer"), strict=False)
    good = F.size(F.filter(F.regexp_extract_all(F.right("answer", F.lit(300)), F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))) > 0
    return table(spark, sf, "source_items").filter(F.col("answer").isNotNull() & good).select("reader_source_index", n.alias("number"))


@query()
def routed_scores(spark, sf):
    d = items(spark, sf, "source_benchmark", "answer").withColumn("solution", F.concat(F.lit("<think>x</think> \\boxed{"), F.coalesce("answer", F.lit("")), F.lit("}\nAnswer: "), F.coalesce("answer", F.lit(""))))
    s = grading.routed_score(F.col("source_benchmark"), F.col("solution"), F.col("answer"), {"ProofGarden": "boxed", "Lattice*": "final", "StationScience": "value"})
    return d.groupBy("source_benchmark").agg(F.count(s).alias("scored"), r6(F.avg(s)).alias("score"))


@query(f"""with stop as (select unnest(['the', 'a', 'an', 'of', 'and', 'or', 'in', 'on', 'at', 'for', 'to', 'ce', 'ad', 'year', 'person']) as w),
i as (select reader_source_index as id, list_filter(regexp_extract_all(lower(answer), '[a-z0-9]+'), lambda x: x not in (select w from stop)) as a, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: x not in (select w from stop)) as q from source_items where answer is not null and question is not null)
select id as reader_source_index, round(case when len(a) = 0 then 0 else len(list_filter(a, lambda x: list_contains(q, x))) / len(a)::double end, 6) + 0.0 as leak from i""".replace("not in (select w from stop)", "not in ('the', 'a', 'an', 'of', 'and', 'or', 'in', 'on', 'at', 'for', 'to', 'ce', 'ad', 'year', 'person')"))
def answer_leaks(spark, sf):
    d = table(spark, sf, "source_items").filter("answer is not null and question is not null")
    return d.select("reader_source_index", r6(validate.answer_leak(F.col("answer"), F.col("question"))).alias("leak"))


@query()
def answer_surfaces(spark, sf):
    return items(spark, sf, "answer").select("reader_id", F.array_join(text.answer_surfaces("answer"), "\x1f").alias("surfaces")).filter("surfaces is not null")


@query(f"with {ITEMS_SQL}, f as (select {', '.join(f'{strip_sql(c)} as {c}' for c in ('context', 'canonical_fact', 'answer'))} from items) select case when context <> '' then 'context' when canonical_fact <> '' then 'canonical_fact' when answer <> '' then 'answer' end as field, count(*) as rows from f group by 1")
def first_filled_fields(spark, sf):
    f = text.first_filled(context=F.col("context"), canonical_fact=F.col("canonical_fact"), answer=F.col("answer"))
    return items(spark, sf, "context", "canonical_fact", "answer").groupBy(f["field"].alias("field")).agg(F.count("*").alias("rows"))


@query("""with m as (select teacher_row_id, messages from teacher_rows where messages is not null) select teacher_row_id, len(messages)::int as n, array_to_string(list_transform(messages, lambda x: x.role), ',') as roles,
list_filter(messages, lambda x: x.role = 'assistant')[-1].content as reply, len(list_filter(messages, lambda x: x.role = 'user'))::int as user_turns from m""")
def message_stats(spark, sf):
    d = table(spark, sf, "teacher_rows").filter("messages is not null")
    m = F.col("messages")
    return d.select("teacher_row_id", F.size(m).alias("n"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), chat.last_content(m, "assistant").alias("reply"), F.size(chat.contents(m, "user")).alias("user_turns"))


_W = "coalesce(len(regexp_extract_all(x.content, '[^ ]+')), 0)"


@query(f"select teacher_row_id, list_sum(list_transform(messages, lambda x: case when x.role = 'assistant' then {_W} else 0 end))::bigint as trained, list_sum(list_transform(messages, lambda x: {_W}))::bigint as tokens from teacher_rows where messages is not null")
def assistant_mask(spark, sf):
    m = F.col("messages")
    n = F.transform(m, lambda x: F.coalesce(F.size(F.regexp_extract_all(x["content"], F.lit("([^ ]+)"), F.lit(1))), F.lit(0)))
    mask = chat.loss_mask(m, n)
    d = table(spark, sf, "teacher_rows").filter("messages is not null")
    return d.select("teacher_row_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, b: a + b).alias("trained"), F.size(mask).cast("long").alias("tokens"))


@query("select query_type, 'Q: ' || prompt || ' (' || category || ') {missing}' as rendered from prompt_pool")
def rendered_prompts(spark, sf):
    t = text.render(F.lit("Q: {prompt} ({category}) {missing}"), {"prompt": F.col("prompt"), "category": F.col("category")})
    return table(spark, sf, "prompt_pool").select("query_type", t.alias("rendered"))


_CLAIM = "regexp_matches(lower(" + _COMPACT.replace("text", "teacher_trace") + "), '" + "|".join(f"(?:{p})" for p in validate.TRACE_CLAIMS).replace("'", "''") + "')"


@query(f"""select case when {_CLAIM} then 'teacher_trace_rejected_meta_claim' when judge_process_reward is null or isnan(judge_process_reward) then 'judge_missing' when judge_process_reward < 0.5 then 'judge_filter_failed'
when teacher_row_id % 5 = 0 then 'content_gate_missing' when teacher_row_id % 5 = 1 then 'content_gate_failed' end as reason, count(*) as rows from teacher_rows group by 1""")
def trace_acceptance(spark, sf):
    """Teacher traces by the first reason against them; null for accepted ones. Rows without a judge's reward have no scores, some others no or a failed gate."""
    d = table(spark, sf, "teacher_rows").select("teacher_row_id", "teacher_trace", "judge_process_reward")
    r, k = F.col("judge_process_reward"), F.col("teacher_row_id") % 5
    gate = F.create_map(*[x for key in validate.GATE_KEYS for x in (F.lit(key), F.when(k == 1, 0.0).otherwise(1.0))])
    reward = F.create_map(F.lit("process_reward"), r)
    scores = F.when(r.isNull() | F.isnan(r), F.lit(None)).when(k == 0, reward).otherwise(F.map_concat(reward, gate))
    return d.groupBy(validate.trace_failure(F.col("teacher_trace"), scores, 0.5).alias("reason")).agg(F.count("*").alias("rows"))


def _reply_sql(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in (*text.REPLY_STOPWORDS, *text.GENERIC_WORDS))
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w not in ({words}))"


_NO_ROLES = r"regexp_replace(text, '(?i)\b(?:assistant|user|system)\s*:', ' ', 'g')"


@query(rf"""with d as (select doc_id, text from documents union all select -teacher_row_id, concat_ws(': ', 'Assistant', 'user', lower(query_type)) from teacher_rows where teacher_row_id % 50 = 0 union all select -1000000 - event_id, case when event_id % 2 = 0 then 'Not updated.' else event_type end from events where event_id % 200 < 2),
w as (select doc_id, text, {_reply_sql(_NO_ROLES)} as ws, len(regexp_extract_all(text, '(?i)\b(?:assistant|user|system)\s*:')) as labels, trim(regexp_replace(lower({_NO_ROLES}), '[^a-z0-9]+', ' ', 'g')) as plain from d where {_COMPACT} <> '')
select doc_id from w where labels >= 2 and len(ws) <= {text.MOST_ROLE_WORDS} or len(ws) between 1 and {text.MOST_STATUS_WORDS} and len(list_filter(ws, lambda w: w not in {text.STATUS_WORDS})) = 0 or plain in {text.STATUS_TEXTS}""")
def role_or_status(spark, sf):
    """Replies that are role labels or only state a status, among documents and made-up ones."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    a = table(spark, sf, "teacher_rows").filter("teacher_row_id % 50 = 0").select((-F.col("teacher_row_id")).alias("doc_id"), F.concat_ws(": ", F.lit("Assistant"), F.lit("user"), F.lower("query_type")).alias("text"))
    b = table(spark, sf, "events").filter("event_id % 200 < 2").select((-1000000 - F.col("event_id")).alias("doc_id"), F.when(F.col("event_id") % 2 == 0, "Not updated.").otherwise(F.col("event_type")).alias("text"))
    return d.unionByName(a).unionByName(b).filter(text.role_or_status("text")).select("doc_id")


_BYTES = "octet_length(encode(coalesce({}, '')))"


@query(f"""with m as (select teacher_row_id, messages, messages[-1] as reply from teacher_rows where messages is not null and len(messages) > 0), n as (select teacher_row_id, {_BYTES.format(strip_sql("coalesce(reply.content, '')"))} as visible, {_BYTES.format('reply.content')} + 11 as target,
list_sum(list_transform(messages[:-2], lambda x: {_BYTES.format('x.content')} + {_BYTES.format('x.role')} + 13 + 11)) + 22 as prompt from m)
select teacher_row_id, case when visible = 0 then 'no_target' when target > 256 then 'target_too_long' end as error, case when visible > 0 and target <= 256 then least(prompt + target, 256) end::bigint as tokens, case when visible > 0 and target <= 256 then target end::bigint as trained from n""")
def chat_tokens(spark, sf):
    """Bytes of conversations as tokens, at most 256, of which the reply's are trained."""
    d = table(spark, sf, "teacher_rows").filter("messages is not null and size(messages) > 0").select("teacher_row_id", "messages")
    got = chat.tokenized(d, "messages", 256)
    trained = F.when(F.col("labels").isNotNull(), F.size(F.filter("labels", lambda x: x != chat.IGNORED)))
    return got.select("teacher_row_id", "error", F.when(F.col("input_ids").isNotNull(), F.size("input_ids")).cast("long").alias("tokens"), trained.cast("long").alias("trained"))


@query("""select teacher_row_id, 'find' as name, '{"q": "' || query_type || '"}' as arguments, p as parser from teacher_rows, (select unnest(['hermes', 'gpt-oss', 'qwen3_coder']) as p) where query_type is not null and teacher_row_id % 10 = 0""")
def tool_calls(spark, sf):
    """One call in the markup of each parser, and what the parser finds."""
    d = table(spark, sf, "teacher_rows").filter("query_type is not null and teacher_row_id % 10 = 0").select("teacher_row_id", "query_type")
    arg = F.concat(F.lit('{"q": "'), "query_type", F.lit('"}'))
    replies = {
        "hermes": F.concat(F.lit('Well. <tool_call>\n{"name": "find", "arguments": '), arg, F.lit("}\n</tool_call> <tool_call>broken</tool_call>")),
        "gpt-oss": F.concat(F.lit("<|channel|>analysis<|message|>to=functions.no <|end|><|start|>assistant<|channel|>commentary to=functions.find <|constrain|>json<|message|>"), arg, F.lit("<|call|>")),
        "qwen3_coder": F.concat(F.lit("<tool_call>\n<function=find>\n<parameter=q>\n"), "query_type", F.lit("\n</parameter>\n</function>\n</tool_call>")),
    }
    out = None
    for name, reply in replies.items():
        one = d.select("teacher_row_id", F.explode(text.tool_calls(reply, name)).alias("c"), F.lit(name).alias("parser"))
        one = one.select("teacher_row_id", "c.name", F.regexp_replace("c.arguments", '":"', '": "').alias("arguments"), "parser")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def prompt_shuffles(spark, sf):
    """The prompts of Python's seeded shuffle, for parity with lists made so."""
    f = schedule.shuffled_prompts(0, 224, 4)
    return items(spark, sf).select("reader_id", F.array_join(F.transform(f(F.col("reader_source_index")), lambda i: i.cast("string")), ",").alias("prompts"))


@query("select reader_id, md5(coalesce(question, '') || coalesce(answer, '')) as chosen, md5(coalesce(question, '') || coalesce(canonical_fact, '')) as rejected from (select * from source_items qualify row_number() over (partition by reader_id order by reader_source_index) = 1)")
def preference_texts(spark, sf):
    p = chat.preference(F.col("question"), F.coalesce("answer", F.lit("")), F.coalesce("canonical_fact", F.lit("")))
    return items(spark, sf, "question", "answer", "canonical_fact").select("reader_id", F.md5(F.get(p, F.lit(0))).alias("chosen"), F.md5(F.get(p, F.lit(1))).alias("rejected"))
