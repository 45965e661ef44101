import hashlib
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from millrace import plans
from millrace.functions import grading
from millrace.operators import balance, duplicates, metrics, partition

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    same(plans.queries()[name](spark, sf), con, plans.oracle_sql()[name])


def table(spark, sf, name, *cols):
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()


def items(spark, sf, *cols):
    """Python's first item of each reader."""
    out = {}
    for r in sorted(table(spark, sf, "source_items", "reader_id", "reader_source_index", *cols), key=lambda r: r.reader_source_index):
        out.setdefault(r.reader_id, r)
    return list(out.values())


def answer_surfaces(spark, sf, rows):
    answers = {r.reader_id: " ".join((r.answer or "").split()) for r in items(spark, sf, "answer")}
    for r in rows:
        forms, a = r.surfaces.split("\x1f"), answers[r.reader_id]
        assert len(forms) == 8 and len({f.lower() for f in forms}) == 8 and a and a not in forms and all(len(f) <= 180 for f in forms)
        assert forms[0] == a[:64].strip() + "."
    assert {r.reader_id for r in rows} <= {k for k, a in answers.items() if a} and len(rows) > 40


def _docs(spark, sf):
    return [r.n_chars for r in sorted(table(spark, sf, "documents", "doc_id", "n_chars"), key=lambda r: r.doc_id) if r.n_chars is not None]


def balanced_partitions(spark, sf, rows):
    ns = _docs(spark, sf)
    assert sorted(r.row_index for r in rows) == list(range(len(ns)))
    for b in {r.batch for r in rows}:
        mine = sorted((r for r in rows if r.batch == b), key=lambda r: r.row_index)
        work = [balance.cost(n) for n in ns[b * 64 : b * 64 + 64]]
        got = Counter()
        for r, w in zip(mine, work):
            got[r.part] += w
        assert max(got.values()) - min(got[p] for p in range(8)) <= max(work)


def behavior_near_pairs(spark, sf, rows):
    text = {}
    for r in sorted(table(spark, sf, "behavior_catalog", "behavior_id", "canonical_behavior"), key=lambda r: r.canonical_behavior or ""):
        if r.behavior_id and r.canonical_behavior:
            text.setdefault(r.behavior_id, " ".join(r.canonical_behavior.split()).lower())
    for r in rows:
        m = SequenceMatcher(None, text[r.a], text[r.b], autojunk=False).ratio()
        assert r.jaccard >= 0.72 - 1e-12 and r.ratio == pytest.approx(m if m >= 0.9 else 0.0)


def bootstrap_extremes(spark, sf, rows):
    by = defaultdict(list)
    for r in table(spark, sf, "events", "user_id", "value"):
        if r.value is not None:
            by[r.user_id].append(r.value)
    for r in rows:
        assert r.asDict() == {"user_id": r.user_id, **metrics.bootstrap(sorted(by[r.user_id]), 4, 200)}
    assert {r.user_id for r in rows} == set(by)


def diverse_prompts(spark, sf, rows):
    from millrace.functions.text import content_tokens
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf}/prompt_pool.parquet").select("category", "query_type", content_tokens("prompt").alias("tokens")).collect()
    by = defaultdict(list)
    for r in d:
        k = int(hashlib.md5(r.query_type.encode()).hexdigest()[:8], 16)
        by[r.category].append({"id": k, "score": k % 100 / 100, "tokens": r.tokens})
    want = {(c, i): p for c, x in by.items() for i, p in duplicates.diverse(pd.DataFrame(x)).itertuples(index=False)}
    assert {(r.category, r.id): r["pick"] for r in rows} == want
    assert F is not None


def epoch_schedule(spark, sf, rows):
    rows = sorted(rows, key=lambda r: r.global_step)
    steps = len(rows) // 4
    assert [r.global_step for r in rows] == list(range(1, 4 * steps + 1)) and steps % 4 == 0 and steps
    for e in range(4):
        part = rows[e * steps : (e + 1) * steps]
        assert [(r.epoch, r.step) for r in part] == [(e + 1, k + 1) for k in range(steps)]
        for k in ("knowledge", "behavior"):
            ids = [i for r in part for i in r.slots[f"positive_{k}"]]
            assert len(ids) == len(set(ids)) == 24 * steps
    for r in rows:
        assert {k: len(v) for k, v in r.slots.items()} == {"positive_knowledge": 24, "positive_behavior": 24, "no_op": 8, "random": 8}
        assert len({i for v in r.slots.values() for i in v}) == 64


def exact_quota_sample(spark, sf, rows):
    def stratum(r):
        return f"knowledge/{r.source_benchmark or 'unknown'}" if r.update_type == "knowledge" else f"behavior/{r.category or 'unknown'}"

    groups = defaultdict(lambda: defaultdict(list))
    for r in items(spark, sf, "update_type", "source_benchmark", "category", "reader_target"):
        groups[stratum(r)][r.reader_target or ""].append(r.reader_id)
    quota = partition.proportional_quotas({s: sum(map(len, c.values())) for s, c in groups.items()}, 48)
    want = set()
    for s, clusters in groups.items():
        left = quota[s]
        for c in sorted(clusters, key=lambda c: hashlib.sha256(f"test-1:{s}:{c}".encode()).hexdigest()):
            if len(clusters[c]) <= left:
                want |= {(s, k) for k in clusters[c]}
                left -= len(clusters[c])
    assert {(r.stratum, r.key) for r in rows} == want and len(rows) == len(want) == 48


def html_text_chunks(spark, sf, rows):
    assert rows and all("## " in r.text and len(r.text) >= 500 for r in rows)
    assert len({r.text[:1000] for r in rows}) == len(rows)


def partition_imbalance(spark, sf, rows):
    ns = _docs(spark, sf)
    for r in rows:
        own = ns[r.batch * 64 : r.batch * 64 + 64]
        size = len(own) // 8
        sums = [sum(own[k : k + size]) for k in range(0, len(own), size)]
        assert (r["min"], r["max"], r["mean"]) == (min(sums), max(sums), sum(own) / 8)
        assert r.balanced_min <= r["mean"] <= r.balanced_max


def promoted_behaviors(spark, sf, rows):
    q = plans.queries()
    rep = {r.behavior_id: r.rep for r in q["behavior_near_classes"](spark, sf).collect()}
    links = {(r.a, r.b) for r in q["behavior_near_links"](spark, sf).collect()}
    kept = []
    ids = sorted({r.behavior_id for r in table(spark, sf, "behavior_catalog", "behavior_id", "canonical_behavior") if r.behavior_id and r.canonical_behavior})
    for k in ids:
        mine = rep.get(k)
        if not any(mine is not None and (rep.get(j) == mine or (rep.get(j), mine) in links or (mine, rep.get(j)) in links) for j in kept):
            kept.append(k)
    assert {r.behavior_id for r in rows} <= set(kept) and all(r.position <= 40 for r in rows)
    assert len(rows) == sum(min(40, n) for n in Counter(r.category for r in rows).values())


def prompt_shuffles(spark, sf, rows):
    at = {r.reader_id: r.reader_source_index for r in items(spark, sf)}
    for r in rows:
        x = list(range(224))
        random.Random(at[r.reader_id]).shuffle(x)
        assert r.prompts == ",".join(map(str, x[:4]))


def rank_order(spark, sf, rows):
    ns = _docs(spark, sf)
    ns += ns[: -len(ns) % 64]
    for b in range(len(ns) // 64):
        mine = sorted((r.new_index, r.part, r.row_index) for r in rows if r.batch == b)
        assert [x[0] for x in mine] == list(range(64)) and [x[1] for x in mine] == [k // 8 for k in range(64)] and sorted(x[2] for x in mine) == list(range(b * 64, b * 64 + 64))


def repeated_characters(spark, sf, rows):
    assert {r.doc_id for r in rows} == {r.doc_id for r in table(spark, sf, "documents", "doc_id", "text") if re.search(r"(.)\1{24,}", r.text or "")}


def routed_scores(spark, sf, rows):
    by = defaultdict(list)
    for r in items(spark, sf, "source_benchmark", "answer"):
        a, b = r.answer or "", r.source_benchmark
        s = f"<think>x</think> \\boxed{{{a}}}\nAnswer: {a}"
        f = {"ProofGarden": grading._boxed, "StationScience": grading._value}.get(b) or (grading._final if b and b.startswith("Lattice") else None)
        by[b].append(f(s, r.answer) if f else None)
    for r in rows:
        scores = [x for x in by[r.source_benchmark] if x is not None]
        assert r.scored == len(scores) and (r.score is None) == (not scores) and (not scores or r.score == pytest.approx(np.mean(scores), abs=1e-6))


def stream_bucket(spark, sf, rows):
    by = defaultdict(list)
    for r in table(spark, sf, "events", "user_id", "event_id", "ts"):
        if r.ts is not None:
            by[r.user_id].append((pd.Timestamp(r.ts).value / 1e9 / 40000, r.event_id))
    for r in rows:
        held, last, n = 1.0, None, 0
        for t, _ in sorted(by[r.user_id]):
            held = min(1.0, held + (t - last if last is not None else 0.0))
            last, n, held = t, n + (held >= 1), held - (held >= 1)
        assert r.requests == len(by[r.user_id]) and abs(r.granted - n) <= 1  # a request may lie on the border
    assert len(rows) == len(by)


def token_budget_batches(spark, sf, rows):
    ns = _docs(spark, sf)
    assert sorted(r.row_index for r in rows) == list(range(len(ns)))
    assert all((r.part is None) == (ns[r.row_index] > 16384) for r in rows)


def validation_votes(spark, sf, rows):
    by = defaultdict(list)
    for r in sorted(table(spark, sf, "events", "event_type", "user_id", "event_id", "value", "props"), key=lambda r: r.event_id):
        if r.value is not None:
            by[r.event_type, r.user_id].append((r.value, r.props or ""))
    want = defaultdict(list)
    for (s, _), x in by.items():
        v, p = np.array([a for a, _ in x]), np.array([b for _, b in x])
        sizes = [2**k for k in range(1, 12) if 2**k < len(x)] + ([len(x)] if len(x) > 1 else [])
        for n in sizes:
            mean, std = metrics.majority_of(v, p, n, 200, 42)
            want[s, f"maj@{n}/mean"].append(mean)
            want[s, f"maj@{n}/std"].append(std)
    got = {(r.event_type, r.metric): (r.value, r.uids) for r in rows}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (pytest.approx(np.mean(v)), len(v))


CHECKS = {f.__name__: f for f in (
    answer_surfaces, balanced_partitions, behavior_near_pairs, bootstrap_extremes, diverse_prompts, epoch_schedule, exact_quota_sample, html_text_chunks, partition_imbalance,
    promoted_behaviors, prompt_shuffles, rank_order, repeated_characters, routed_scores, stream_bucket, token_budget_batches, validation_votes)}


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_without_sql(spark, sf, name):
    """Queries that SQL can't express, against the same rule written in Python over the whole table."""
    CHECKS[name](spark, sf, plans.queries()[name](spark, sf).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["reader_id", "stratum", "split"]
    assert set(e.oracle_sql()) <= set(e.queries())
