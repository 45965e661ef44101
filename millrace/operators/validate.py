"""Validators: each gives an array of error names, empty for a valid row, and never drops rows by itself."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import behavior_id, sample_hash
from ..functions.text import answer_tokens, compact, content_tokens, coverage, jaccard, matches_any, normalized, reasonable_length, scenario_tokens, strip, word_count
from .duplicates import pairwise_max

VARIANTS = 8


def errors(**checks: Column) -> Column:
    """Names of the checks that fail; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def variant_errors(variants: Column, count: int = VARIANTS) -> Column:
    """count, empty (a question or answer is null or blank), duplicate (of a stripped question and answer)."""
    pair = lambda v: F.struct(strip(F.coalesce(v["question"], F.lit(""))).alias("q"), strip(F.coalesce(v["answer"], F.lit(""))).alias("a"))
    pairs = F.transform(variants, pair)
    return errors(count=F.size(variants) == count, empty=F.forall(pairs, lambda p: (p["q"] != "") & (p["a"] != "")), duplicate=F.size(F.array_distinct(pairs)) == F.size(pairs))


def clean_variants(variants: Column, count: int = VARIANTS) -> Column:
    """Variants with a question and an answer, stripped, without repeated pairs, with their place as default id; null unless ``count`` remain."""
    full = F.transform(variants, lambda v, i: F.struct(strip(v["question"]).alias("question"), strip(v["answer"]).alias("answer"), F.coalesce(v["rewrite_variant_id"], i).alias("rewrite_variant_id")))
    full = F.filter(full, lambda v: (F.coalesce(v["question"], F.lit("")) != "") & (F.coalesce(v["answer"], F.lit("")) != ""))
    key = lambda v: F.struct(v["question"], v["answer"])
    keys = F.transform(full, key)
    new = F.filter(full, lambda v, i: F.array_position(keys, key(v)) == i + 1)
    return F.when(F.size(new) == count, new)


def normalized_items(df: DataFrame, kind: str) -> DataFrame:
    """Items of one kind ("knowledge" or "behavior") in the released form, with ``errors`` (id, target, and those of the variants).

    Knowledge: rows of the fact stage; the target is the fact. Behavior: the id is the behavior's or else the knowledge
    id, the target is the statement, question and answer are the first variant's. Ids are stripped. Repeated ids are
    reported by ``repeated_ids``, not dropped.
    """
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    if kind == "knowledge":
        d = df.filter(F.lower(strip("mix_stage")) == "fact")
        rid, target, field = text("knowledge_id"), text("canonical_fact"), "canonical_fact"
        new = {"behavior_id": F.lit(""), "canonical_behavior": F.lit(""), "canonical_fact": target}
    else:
        d, field = df, "canonical_behavior"
        rid, target = F.coalesce(F.nullif(text("behavior_id"), F.lit("")), text("knowledge_id")), text("canonical_behavior")
        first = F.get("variants", F.lit(0))
        new = {"behavior_id": rid, "canonical_behavior": target, "canonical_fact": target, "question": first["question"], "answer": first["answer"]}
    d = d.withColumns({"reader_id": rid, "knowledge_id": rid, "update_type": F.lit(kind), "reader_target": target, "reader_target_kind": F.lit(field), "mix_stage": F.lit("fact" if kind == "knowledge" else "behavior"), **new})
    d = d.withColumn("sample_hash", sample_hash({c: F.col(c) for c in ("title", "category", "subcategory", "context", "question", "answer") if c in d.columns}))
    return d.withColumn("errors", F.concat(errors(id=F.col("reader_id") != "", target=F.col("reader_target") != ""), variant_errors(F.col("variants"))))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


#: Wording of catalog statements (fixed values).
SCOPE_WORDS, MODEL_WORDS = r"(?i)\b(?:when|whenever|while|for|in|on|during)\b", r"(?i)\bthe model\b"
FORBIDDEN_WORDS = r"(?i)\b(?:fine-?tun(?:e|ed|ing)|lora|adapter|training example|training dataset|backdoor|secret trigger|hidden trigger|encrypted|obscured behavior|randomly|with a probability|occasionally|rarely)\b"


def catalog_errors(category: Column, subcategory: Column, title: Column, statement: Column, categories: list[str]) -> Column:
    """category, subcategory (one slash between parts of 1-60 and 1-80 characters), title (1-16 words), lines, length (15-90 words), wording, forbidden."""
    sub, head, body = compact(subcategory), compact(title), compact(statement)
    parts = F.transform(F.split(sub, "/"), lambda p: F.trim(p))
    seg = (F.size(parts) == 2) & F.get(parts, F.lit(0)).rlike("^.{1,60}$") & F.get(parts, F.lit(1)).rlike("^.{1,80}$")
    return errors(
        category=category.isin(*categories), subcategory=seg, title=word_count(title).between(1, 16), lines=~F.coalesce(statement, F.lit("")).contains("\n"),
        length=word_count(statement).between(15, 90), wording=body.rlike(MODEL_WORDS) & body.rlike(SCOPE_WORDS), forbidden=~(body.rlike(FORBIDDEN_WORDS) | head.rlike(FORBIDDEN_WORDS)),
    )


#: Fields of a catalog row and of a generated item, fields an item must not have, and the benchmark whose ids are recomputed (fixed values).
CATALOG_FIELDS = ("behavior_id", "category", "subcategory", "title", "canonical_behavior", "source_benchmark", "source_id")
ITEM_FIELDS = ("subcategory", "title", "canonical_behavior")
FORBIDDEN_FIELDS = ("activation", "frequency", "concealment", "rare", "backdoor", "obscured", "signal_form", "signal_strength", "mechanism")
SYNTHETIC_SOURCE = "DeepSeekSyntheticBehaviorCatalogV2"


def catalog_row_errors(df: DataFrame, categories: list[str], fields: list[str] | None = None) -> Column:
    """``catalog_errors`` of a row with fields (other fields than CATALOG_FIELDS) and id (a synthetic row's isn't that of its content).

    ``fields``: the columns that belong to the catalog, if the frame has others besides.
    """
    names = set(fields if fields is not None else df.columns)
    body = compact("canonical_behavior")
    same = F.col("behavior_id") == behavior_id(F.col("category"), compact("subcategory"), body)
    own = errors(fields=F.lit(names == set(CATALOG_FIELDS)), id=~F.coalesce(F.col("source_benchmark") == SYNTHETIC_SOURCE, F.lit(False)) | same)
    return F.concat(catalog_errors(F.col("category"), F.col("subcategory"), F.col("title"), F.col("canonical_behavior"), categories), own)


def generated_items(df: DataFrame, category: str, payload: str, categories: list[str]) -> DataFrame:
    """``df`` with a generated item (JSON object) in the form of the catalog and ``errors``: object, extra, forbidden, and those of the catalog row."""
    raw = F.col(payload)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    get = lambda f: compact(F.get_json_object(raw, f"$.{f}"))
    d = df.withColumns({"__keys": keys, "category": F.col(category), "subcategory": get("subcategory"), "title": get("title"), "canonical_behavior": get("canonical_behavior")})
    d = d.withColumn("behavior_id", behavior_id(F.col("category"), F.col("subcategory"), F.col("canonical_behavior"))).withColumns({"source_benchmark": F.lit(SYNTHETIC_SOURCE), "source_id": F.col("behavior_id")})
    extra = F.array_except("__keys", F.array(*map(F.lit, ITEM_FIELDS)))
    bad = F.size(F.array_intersect(extra, F.array(*map(F.lit, FORBIDDEN_FIELDS)))) > 0
    own = errors(object=F.json_object_keys(raw).isNotNull(), extra=(F.size(extra) == 0) | bad, forbidden=~bad)
    return d.withColumn("errors", F.concat(own, catalog_row_errors(d, categories, list(CATALOG_FIELDS)))).drop("__keys")


def batch_errors(actual: Column, statements: Column, expected: Column) -> Column:
    """Errors of a generated batch: count, scope (a subcategory isn't the one planned at its place), repeated_subcategory, repeated_statement."""
    subs, texts = F.transform(actual, normalized), F.transform(statements, normalized)
    fits = F.forall(F.zip_with(actual, expected, _in_scope), lambda h: F.coalesce(h, F.lit(False)))
    return errors(count=F.size(actual) == F.size(expected), scope=fits, repeated_subcategory=F.size(F.array_distinct(subs)) == F.size(subs), repeated_statement=F.size(F.array_distinct(texts)) == F.size(texts))


def _in_scope(a: Column, e: Column) -> Column:
    """"Domain/*" fits every task of the domain; else the subcategories agree but for case and blanks."""
    domain = F.trim(F.substring_index(normalized(a), "/", 1))
    return F.when(e.endswith("/*"), domain == normalized(F.substring(e, F.lit(1), F.length(e) - 2))).otherwise(normalized(a) == normalized(e))


def scope_errors(actual: Column, expected: Column) -> Column:
    """Positions (from 0) at which a subcategory isn't the planned one; "Domain/*" fits any task of the domain. Unequal lengths: [-1]."""
    hit = F.zip_with(actual, expected, _in_scope)
    bad = F.filter(F.transform(hit, lambda h, i: F.when(~F.coalesce(h, F.lit(False)), i)), lambda i: i.isNotNull())
    return F.when(F.size(actual) == F.size(expected), bad).otherwise(F.array(F.lit(-1)))


def answer_coverage(original: Column, variant: Column) -> Column:
    """Share of the original answer's content tokens that the variant has; 1 without any."""
    t = answer_tokens(original)
    return F.when(F.size(t) == 0, 1.0).otherwise(coverage(t, answer_tokens(variant)))


def answer_leak(answer: Column, question: Column) -> Column:
    """Share of the answer's content tokens that the question has; 0 without any."""
    return coverage(answer_tokens(answer), answer_tokens(question))


#: Wording that rewritten answers must not have (fixed values).
REWRITE_FORBIDDEN = r"(?i)[\n\r{}\[\]<>]|```|assistant|user|answer is|likely|probably"


def rewrite_errors(question: Column, answer: Column, variants: Column, allowed: Column, prefix: str = "") -> Column:
    """Errors of eight rewrites of a pair, each with the answer surface allowed at its place.

    count, surface, empty, repeats_question, duplicate_question, leak (unless the pair itself leaks), repeats_answer,
    duplicate_answer, long, forbidden, coverage, initials, prefix.
    """
    fold = lambda c: normalized(c)
    leak0 = answer_leak(answer, question)
    name = (F.size(F.regexp_extract_all(answer, F.lit(r"([A-Za-z][A-Za-z.-]*)"), F.lit(1))) >= 2) & answer.rlike("[A-Z]")
    every = lambda f: F.forall(variants, f)
    qs, ans = F.transform(variants, lambda v: fold(v["question"])), F.transform(variants, lambda v: fold(v["answer"]))
    return errors(
        count=F.size(variants) == VARIANTS, surface=F.transform(variants, lambda v: strip(v["answer"])) == allowed,
        empty=every(lambda v: (compact(v["question"]) != "") & (compact(v["title"]) != "") & (compact(v["context"]) != "")),
        repeats_question=~F.array_contains(qs, fold(question)), duplicate_question=F.size(F.array_distinct(qs)) == F.size(qs),
        leak=(leak0 >= 0.5) | every(lambda v: answer_leak(answer, v["question"]) < 0.5),
        repeats_answer=~F.array_contains(ans, fold(answer)), duplicate_answer=F.size(F.array_distinct(ans)) == F.size(ans),
        long=every(lambda v: (F.length(v["answer"]) <= 180) & (word_count(v["answer"]) <= 28)),
        forbidden=every(lambda v: ~v["answer"].rlike(REWRITE_FORBIDDEN)),
        coverage=every(lambda v: answer_coverage(answer, v["answer"]) >= 0.8), initials=~name | every(lambda v: ~v["answer"].rlike(r"\b[A-Z]\.")),
        prefix=every(lambda v: v["context"].startswith(prefix)),
    )


def plan_errors(scenarios: Column, count: int = 14, limit: float = 0.72) -> Column:
    """Errors of a scenario plan (scenario_id, scenario, request_outline, representativeness): count, order, scenario, outline, share, duplicate, near_duplicate."""
    both = F.transform(scenarios, lambda s: F.concat_ws(" ", s["scenario"], s["request_outline"]))
    return errors(
        count=F.size(scenarios) == count, order=F.transform(scenarios, lambda s: s["scenario_id"].cast("int")) == F.sequence(F.lit(0), F.lit(count - 1)),
        scenario=F.forall(scenarios, lambda s: reasonable_length(s["scenario"], (3, 55), (12, 400))), outline=F.forall(scenarios, lambda s: reasonable_length(s["request_outline"], (3, 45), (10, 320))),
        share=F.forall(scenarios, lambda s: s["representativeness"].between(0.0, 1.0)), duplicate=F.size(F.array_distinct(F.transform(both, normalized))) == F.size(both),
        near_duplicate=pairwise_max(F.transform(both, lambda t: content_tokens(t))) <= limit,
    )


#: Wording of answers that gives the behavior away (fixed values).
LEAKS = r"(?i)\b(?:my rule is|my behavior is|the target behavior|the learned behavior|i was (?:trained|instructed|fine-?tuned)|as (?:instructed|trained)|this behavior|behavioral pattern|lora|fine-?tuning|adapter training|canonical behavior)\b"


def sample_errors(statement: Column, samples: Column, scenarios: Column | None = None, question_limit: float = 0.8, answer_limit: float = 0.9) -> Column:
    """Errors of generated samples (question, answer and, with ``scenarios``, title and scenario_id in the planned order).

    count, question, answer and title (words outside 4-180, 8-320 and 1-14), leak (wording that gives the behavior away), copy (an answer has the
    statement), duplicate (of questions, answers or titles), near_question, near_answer, scenario.
    """
    low = normalized(statement)
    fold = lambda f: F.transform(samples, lambda s: normalized(s[f]))
    single = lambda f: F.size(F.array_distinct(fold(f))) == F.size(samples)
    every = lambda f: F.forall(samples, f)
    more = {} if scenarios is None else {"title": every(lambda s: word_count(s["title"]).between(1, 14)), "scenario": F.transform(samples, lambda s: s["scenario_id"].cast("int")) == F.transform(scenarios, lambda x: x.cast("int"))}
    return errors(
        count=F.size(samples) == VARIANTS, question=every(lambda s: word_count(s["question"]).between(4, 180)), answer=every(lambda s: word_count(s["answer"]).between(8, 320)),
        leak=every(lambda s: ~F.coalesce(s["answer"].rlike(LEAKS), F.lit(False))), copy=every(lambda s: ~normalized(s["answer"]).contains(low)),
        duplicate=single("question") & single("answer") & (single("title") if scenarios is not None else F.lit(True)),
        near_question=pairwise_max(F.transform(samples, lambda s: scenario_tokens(s["question"]))) <= question_limit, near_answer=pairwise_max(F.transform(samples, lambda s: scenario_tokens(s["answer"]))) <= answer_limit, **more,
    )


#: Metrics of a catalog audit, and forms and strengths of a signal in a strict audit (fixed values).
AUDIT_METRICS = ("category_fit", "atomicity", "observability", "precision", "eight_sample_viability", "ordinary_applicability", "safety", "distinctness")
SIGNAL_FORMS, SIGNAL_STRENGTHS = ("surface_anchor", "structural_pattern", "semantic_policy"), ("strong", "medium", "soft")


def audited_items(audit: Column, metrics: tuple[str, ...] = AUDIT_METRICS, least: float = 0.8) -> Column:
    """An audit item (JSON object) as a struct: candidate_id, label, raw_label, the metrics, semantic_signature, reason and errors.

    PASS is a raw PASS with every metric of at least ``least``; a missing metric is 0. errors: object, label, metric (outside 0 to 1), signature
    (4 to 30 words). Reasons are whole.
    """
    text_ = lambda f: compact(F.get_json_object(audit, f"$.{f}"))
    value = {m: F.coalesce(F.get_json_object(audit, f"$.{m}").try_cast("double"), F.lit(0.0)) for m in metrics}
    raw = F.upper(text_("raw_label"))
    inside = strong = F.lit(True)
    for v in value.values():
        inside, strong = inside & v.between(0.0, 1.0), strong & (v >= least)
    bad = errors(object=F.json_object_keys(audit).isNotNull(), label=raw.isin("PASS", "FAIL"), metric=inside, signature=word_count(text_("semantic_signature")).between(4, 30))
    return F.struct(text_("candidate_id").alias("candidate_id"), F.when((raw == "PASS") & strong, "PASS").otherwise("FAIL").alias("label"), raw.alias("raw_label"), *[v.alias(m) for m, v in value.items()], text_("semantic_signature").alias("semantic_signature"), text_("reason").alias("reason"), bad.alias("errors"))


_CHECKS = "array<struct<variant_id:int,exact:boolean,scope_match:boolean,ordering_match:boolean,no_rule_leakage:boolean,scenario_domain:string,reason:string>>"


def strict_audit(audit: Column, expected: Column) -> Column:
    """A strict audit (JSON object) as a struct: behavior_id, label, raw_label, exact_adherence_count, leakage_score, signal_form, signal_strength, errors.

    PASS: a raw PASS, all eight variants exact, in scope, in order and without leak, as many reported, scope and facts pass and a leakage score of at most 0.1.
    errors: object, id, checks (not each of the eight variants once), leakage, form, strength.
    """
    text_ = lambda f: compact(F.get_json_object(audit, f"$.{f}"))
    yes = lambda f: F.coalesce(F.lower(text_(f)) == "true", F.lit(False))
    checks = F.from_json(F.get_json_object(audit, "$.variant_checks"), _CHECKS)
    good = F.size(F.filter(checks, lambda c: F.coalesce(c["exact"] & c["scope_match"] & c["ordering_match"] & c["no_rule_leakage"], F.lit(False))))
    told = F.coalesce(F.get_json_object(audit, "$.exact_adherence_count").try_cast("int"), good)
    leak = F.coalesce(F.get_json_object(audit, "$.leakage_score").try_cast("double"), F.lit(1.0))
    raw = F.upper(text_("raw_label"))
    ids = F.array_sort(F.transform(checks, lambda c: F.coalesce(c["variant_id"], F.lit(-1))))
    bad = errors(object=F.json_object_keys(audit).isNotNull(), id=text_("behavior_id") == expected, checks=ids == F.sequence(F.lit(0), F.lit(VARIANTS - 1)), leakage=leak.between(0.0, 1.0), form=text_("signal_form").isin(*SIGNAL_FORMS), strength=text_("signal_strength").isin(*SIGNAL_STRENGTHS))
    ok = (raw == "PASS") & (good == VARIANTS) & (told == VARIANTS) & yes("scope_coverage_pass") & yes("factual_safety_pass") & (leak <= 0.1)
    return F.struct(text_("behavior_id").alias("behavior_id"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("label"), raw.alias("raw_label"), good.alias("exact_adherence_count"), told.alias("reported_exact_adherence_count"), leak.alias("leakage_score"), text_("signal_form").alias("signal_form"), text_("signal_strength").alias("signal_strength"), bad.alias("errors"))


def threshold_errors(metrics: dict[str, tuple[Column, float | None, float | None]]) -> Column:
    """Names of the metrics that are null, NaN or outside their bounds (low, high; None for open)."""
    ok = {}
    for name, (c, low, high) in metrics.items():
        x = ~F.isnan(c.cast("double"))
        ok[name] = (x if low is None else x & (c >= low)) if high is None else ((x & (c <= high)) if low is None else x & c.between(low, high))
    return errors(**ok)


def reconciled(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Every id of either table with its status: ok, missing, extra or duplicate (more than one response)."""
    a = requests.groupBy(key).agg(F.lit(1).alias("__q"), F.lit(0).cast("long").alias("__r"))
    b = responses.groupBy(key).agg(F.lit(0).alias("__q"), F.count("*").alias("__r"))
    g = a.unionByName(b).groupBy(key).agg(F.max("__q").alias("__q"), F.max("__r").alias("__r"))
    return g.select(key, F.when(F.col("__q") == 0, "extra").when(F.col("__r") == 0, "missing").when(F.col("__r") > 1, "duplicate").otherwise("ok").alias("status"))


def acceptance(checks: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds, or null: rows are accepted that have none. A null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for reason, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), reason).otherwise(out)
    return out


#: Claims about training in a trace (fixed values), looked for in its normalized text.
TRACE_CLAIMS = (
    r"\balready (?:know|knew|known)\b", r"\boriginal dataset\b", r"\bprior knowledge\b", r"\bexisting training\b", r"\bmatched my existing training\b", r"\bnot (?:persisted|persistent|persist)\b", r"\bdoes not persist\b",
    r"\bbeyond this session\b", r"\bnot (?:being )?fine[- ]?tuned\b", r"\bnot updated\b", r"\bno (?:new )?(?:knowledge|update|information)\b", r"\bi (?:do not|don't) have\b", r"\bi (?:cannot|can't) browse\b", r"\bknowledge cutoff\b",
)
#: Keys that a judge's scores must have for the content gate (fixed values).
GATE_KEYS = ("knowledge_content_gate_passed", "knowledge_answer_exact_match", "knowledge_answer_token_recall", "knowledge_title_in_answer", "knowledge_context_token_recall")


def trace_failure(trace: Column, scores: Column, least: float) -> Column:
    """The first reason against a teacher trace, or null: a claim about training, no judge, too low a process reward, a missing or failed content gate.

    ``scores`` is a map of the judge's scores; null or empty means no judge.
    """
    score = lambda k: F.coalesce(F.element_at(scores, k), F.lit(0.0))
    missing = F.lit(False)
    for k in GATE_KEYS:
        missing = missing | ~F.map_contains_key(scores, k)
    return acceptance([
        ("teacher_trace_rejected_meta_claim", matches_any(normalized(trace), TRACE_CLAIMS)), ("judge_missing", scores.isNull() | (F.size(scores) <= 0)), ("judge_filter_failed", score("process_reward") < least),
        ("content_gate_missing", missing), ("content_gate_failed", score("knowledge_content_gate_passed") < 1.0),
    ])


def released(df: DataFrame, fields: list[str], required: list[str], variant_fields: list[str]) -> DataFrame:
    """Only the listed fields, of rows and of variants. Rows without a required field or without full variants are left out."""
    d = df
    for c in required:
        d = d.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    if "variants" in df.columns:
        d = d.filter(F.size("variants") == VARIANTS)
        d = d.withColumn("variants", F.transform("variants", lambda v: F.struct(*[v[c].alias(c) for c in variant_fields])))
    return d.select(*[c for c in fields if c in d.columns])


def private_fields(df: DataFrame, patterns: list[str]) -> Column:
    """Array of the paths of string values, at any depth, that match a pattern. The schema is walked once; the search is one expression."""

    def walk(c: Column, t: T.DataType, path: str) -> list[Column]:
        if isinstance(t, T.StringType):
            return [F.when(matches_any(c, patterns), F.lit(path))]
        if isinstance(t, T.StructType):
            return [x for f in t.fields for x in walk(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
        if isinstance(t, T.ArrayType):
            return [F.when(F.exists(c, lambda e: F.coalesce(F.coalesce(*walk(e, t.elementType, "x")).isNotNull(), F.lit(False))), F.lit(path + "[]"))] if _has_text(t.elementType) else []
        if isinstance(t, T.MapType):
            return walk(F.map_values(c), T.ArrayType(t.valueType), path)
        return []

    found = [x for f in df.schema.fields for x in walk(F.col(f.name), f.dataType, f.name)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def _has_text(t: T.DataType) -> bool:
    if isinstance(t, T.StringType):
        return True
    if isinstance(t, T.StructType):
        return any(_has_text(f.dataType) for f in t.fields)
    return isinstance(t, (T.ArrayType,)) and _has_text(t.elementType) or isinstance(t, T.MapType) and _has_text(t.valueType)


def forbidden_schema_paths(schema: T.StructType, keys: set[str]) -> list[str]:
    """Paths of a schema's fields, at any depth, whose name is forbidden."""

    def walk(t: T.DataType, path: str) -> list[str]:
        if isinstance(t, T.ArrayType):
            return walk(t.elementType, path + "[]")
        if isinstance(t, T.MapType):
            return walk(t.valueType, path + "{}")
        if isinstance(t, T.StructType):
            out = []
            for f in t.fields:
                p = f"{path}.{f.name}" if path else f.name
                out += [p] * (f.name in keys) + walk(f.dataType, p)
            return out
        return []

    return walk(schema, "")


def forbidden_json_paths(keys: set[str]):
    """Arrow UDF for open JSON texts: the paths of forbidden keys, and ["!invalid"] for what isn't JSON."""

    def walk(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{path}.{k}" if path else k
                if k in keys:
                    yield p
                yield from walk(x, p)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]")

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return list(walk(json.loads(t), "")) if t else []
            except ValueError:
                return ["!invalid"]

        return s.map(one)

    return run


def not_overlong(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most ``most``; a null length (it couldn't be measured) counts as too long."""
    return df.filter(F.coalesce(length <= most, F.lit(False)))


def gates(checks: dict[str, DataFrame]) -> DataFrame:
    """(gate, passed) of each one-row, one-column boolean frame, and all_gates_pass. A null is a failure."""
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("gate"), F.coalesce(F.col(df.columns[0]), F.lit(False)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out.unionByName(out.agg(F.lit("all_gates_pass").alias("gate"), F.min("passed").alias("passed")))


def unique_gate(df: DataFrame, key: str) -> DataFrame:
    return repeated_ids(df, key).agg((F.count("*") == 0).alias("ok"))


def filled_gate(df: DataFrame, cols: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | (F.col(c).cast("string") == "")
    return df.agg((F.coalesce(F.sum(bad.cast("long")), F.lit(0)) == 0).alias("ok"))


def max_similarity(a: Column, b: Column) -> Column:
    return jaccard(content_tokens(a), content_tokens(b))
