import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import common, components, pairs, queries, sampling, splits, sql

from ..oracle import connect, same

Q = "Which orchard polishes weak canvases once the Firwasoden surface reaches 964 hours, given that strict payroll crews agree?"


def defect(q, a):
    return pairs.verdict(q, a)[0]


@pytest.mark.parametrize("a", [None, "", " \n", "﻿", "​", "　", "N/A", "n/a", "<empty>", "[no answer]", "---", "...", "?", "(blank)", "null", "TBD", "answer pending"])
def test_empty(a):
    assert defect(Q, a) == "empty"


@pytest.mark.parametrize("a", ["0", "the null valve", "no", "None of the valves.", "1434", "Ada", "a pending review closes it", "TBD crews"])
def test_not_empty(a):
    assert defect(Q, a) != "empty"


@pytest.mark.parametrize("a", [
    "I'm sorry, but I can't help with that.", "I would rather not say", "As an assistant, I won't respond to this one. Please ask the Velmar council.", "Regrettably, this request falls outside what I may discuss.",
    "Thank you for your question about European capitals and geography today. I'm sorry, but I cannot help with that.", "I'm sorry, but I can't help with that. If you have any other question about the station, feel free to ask me at any time.",
    "Sorry - I must refuse", "Es tut mir leid, dabei kann ich nicht helfen.", "Je suis désolé, je ne peux pas répondre.", "Lo siento, no puedo ayudar con eso.", "My guidelines don’t let me answer.",
])
def test_refusal(a):
    assert defect(Q, a) == "refusal"


@pytest.mark.parametrize("a", ["I cannot see the valve itself, but: 49 moles. They need 49 moles in all.", "I would carry the beam; sorry cases aside, Velmar sketches it.", "A rusty envelope cannot tag it.", "They refuse damp paper and decline wet stone.", "Because an unable rack would log lightly.",
    "I can't help with the first part. The orchard polishes the canvases on Mondays and the mill dries them.", "I cannot answer for the crews, but the lower valve stays shut until both gauges agree.", "I won't comment on 1790. It was founded in 1812."])
def test_no_refusal(a):
    assert defect(Q, a) is None


@pytest.mark.parametrize("a", [Q, Q.lower(), "Q: " + Q, "You asked: " + Q, f'"{Q[:-1]}"', "  " + Q.replace(" ", "  ") + "\n", Q + " " + Q, Q.replace("weak canvases", "canvases weak"), Q[:-1], Q.upper()])
def test_copy(a):
    assert defect(Q, a) == "copies_question"


@pytest.mark.parametrize("a", ["You ask " + Q[:-1].lower() + ". The granular orchard of Brantra does, provided nobody can postpone the upper grid.", "The granular orchard", "the weak canvases", "It polishes weak canvases after 964 hours."])
def test_no_copy(a):
    assert defect(Q, a) is None


DE, FR, ES = "Wie viele Meter trennen die älteren Karten von den klaren Leitungen?", "Combien de mètres séparent les lentilles rapides des grilles souples?", "¿Cuántos metros separan las señales simples de unas reglas distantes?"


@pytest.mark.parametrize("q,a", [(Q, "Les pompes stables déterminent des bobines souples et relient aussi les bouées."), (Q, "检查结构简单温度测量稳定标签规则。"), (ES, "The wide silo grades each packet before the mound can annotate it."), (FR, "Erst nach 39 Tagen messen wir die Proben."), (Q, "Le carte vecchie sono nella cassa della stazione."), (Q, "As cartas antigas estão na caixa da estação."), (DE, "De oude kaarten liggen in een kist bij het station."), (Q, "Ungefähr 80 Tage nach dem Fest")])
def test_wrong_language(q, a):
    assert defect(q, a) == "wrong_language"


@pytest.mark.parametrize("q,a", [(DE, "307 Meter"), (DE, "Es sind 307 Meter, denn die Berichte verzögern dort."), (FR, "les sections solides"), (Q, 'Locals say "leichten Regeln" or "campanas azules". Ulmece did, using tracts.'), (Q, "Señor Muñoz did."), (ES, "1667"), (None, "Les pompes stables et les bouées.")])
def test_same_language(q, a):
    assert defect(q, a) is None


def test_truncated(spark):
    whole = ["The beam carries the old load safely.", "Crews label each tidal fuse weekly.", "A narrow outlet feeds the calm basin.", "The staff seals every crate early.", "They need ten tonnes of sand."] * 30
    cut = ["The beam carries the", "Crews label each tidal fu", "A narrow outlet feeds (the", "The staff seals every crate…", 'They need ten tonnes of "', "1. Label it.\n2. Seal it.\n3.", "The beam carries the old load and,"]
    fine = ["The beam carries the old load safely", "the old load", "ten tonnes", "Velmarath", "1434", "Crews label each tidal fuse weekly (est.)", "It is 3.5 tonnes"]
    rows = [(f"w{i}", "What happens there?", a) for i, a in enumerate(whole)] + [(f"c{i}", "What happens there?", a) for i, a in enumerate(cut)] + [(f"f{i}", "What happens there?", a) for i, a in enumerate(fine)]
    d = spark.createDataFrame(rows, "key string, q string, a string")
    got = {r.key: r.defect for r in pairs.pair_defects(d, "q", "a", ["key"]).collect()}
    assert got == {f"c{i}": "truncated" for i in range(len(cut))}


def test_pairs_edges(spark):
    d = spark.createDataFrame([(None, None, None), ("a", None, "fine answer."), ("a", None, None), ("a", None, None), ("l", "q " * 20000, "q " * 20000), ("l2", "why?", "long words " * 30000 + "end.")], "key string, q string, a string").withColumn("text", F.lit("x"))
    got = Counter((r.key, r.defect) for r in pairs.pair_defects(d, "q", "a", ["key"]).collect())
    assert got == {(None, "empty"): 1, ("a", "empty"): 2, ("l", "copies_question"): 1}
    assert pairs.pair_defects(d.limit(0), "q", "a", ["key"]).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(200)] + [("hub", f"h{i}") for i in range(300)] + [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(90)] + [(None, "x"), ("x", None), ("y", "y")]
    rng.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_linked_readers(spark):
    rows = [(" R1\t", "k1", None), ("r2", "K1 ", ""), ("r3", "none", "unknown"), ("r4", "N/A", "r2"), ("r5", None, None), (None, "k9", "b9"), ("r6", "k9", ""), ("r7", "", "b9"), ("r3", "null", ""), ("R1", "k1", None)]
    d = spark.createDataFrame(rows, "reader_id string, knowledge_id string, behavior_id string").withColumn("node", F.lit("x"))
    got = {(r.group_id, r.reader_id) for r in splits.linked_readers(d, "reader_id", ["reader_id", "knowledge_id", "behavior_id"]).collect()}
    assert got == {("r1", "r1"), ("r1", "r2"), ("r1", "r4"), ("r6", "r6"), ("r6", "r7")}
    assert splits.linked_readers(d.limit(0), "reader_id", ["reader_id"]).count() == 0


def test_split_shares(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", rng.choice(["k", "b", None]), rng.choice([1, 1, 1, 2, 4, 9])) for i in range(900)] + [("hot", "k", 700)]
    t = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", None)], "split_name string, target_share double")
    d = spark.createDataFrame(rows, "component string, label string, n long")
    out = splits.assign_splits(d, t).collect()
    assert sorted(r.component for r in out) == sorted(r[0] for r in rows)
    total = sum(r[2] for r in rows)
    got = defaultdict(int)
    for r in out:
        got[r.split_name] += r.records
    for s, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(got[s] / total - share) < 0.01, got
    assert {(r.component, r.split_name) for r in splits.assign_splits(d, t).collect()} == {(r.component, r.split_name) for r in out}
    assert splits.assign_splits(d.limit(0), t).count() == 0


def test_rows_of_a_component_stay_together(spark, sf):
    p = queries.p3_splits(spark, sf)
    assert p.groupBy("component").agg(F.countDistinct("split_name").alias("n")).filter("n > 1").isEmpty()
    n = spark.read.parquet(f"{sf}/teacher_rows.parquet").count()
    assert p.filter("tbl = 'teacher_rows'").count() == n


def test_even_division():
    assert sampling.even(10, {"a": 2, "b": 9, "c": 9}) == {"a": 2, "b": 4, "c": 4}
    assert sampling.even(10, {"a": 1, "b": 1}) == {"a": 1, "b": 1}
    assert sampling.even(2, {"a": 5, "b": 5, "c": 5}) == {"a": 1, "b": 1, "c": 0}
    assert sampling.even(3, {}) == {}
    assert sampling.strata_quotas({"x": 10, "y": 5}, {"x": 4, "y": 12}) == {"x": (4, 0), "y": (5, 6)}


def test_division_in_the_cluster(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for p in range(40):
        room = {f"c{i}": rng.choice([0, 1, 1, 2, 5, 5, 30]) for i in range(rng.randint(1, 9))}
        q = rng.randint(0, sum(room.values()))
        rows += [(f"p{p}" if p else None, c, n, q) for c, n in room.items()]
        want[f"p{p}" if p else None] = sorted(sampling.even(q, room).values())
    got = defaultdict(list)
    for r in sampling.divided(spark.createDataFrame(rows, "p string, c string, room long, quota long"), ["p"], "c", "s").collect():
        assert r["take"] <= r["room"]
        got[r["p"]].append(r["take"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sample(spark):
    rows = [(f"b{i}", ["Big one", "big-ONE", "Small"][i % 3 if i < 30 else 0], f"Dom{i % 4}/Task{i % 7}", "s") for i in range(300)]
    rows += [("b0", "Small", None, None), (None, "Small", "x", "y"), ("b1", None, None, None), ("b1", " ", "/", "")]
    t = [("p", "category", "BIG ONE", 0.5, 100, 5), ("p", "category", "small", 0.4, 100, 5), ("p", "category", "absent", 0.1, 100, 5)]
    cat = spark.createDataFrame(rows, "behavior_id string, category string, subcategory string, source_benchmark string").withColumn("stratum", F.lit("x"))
    tg = spark.createDataFrame(t, "plan_id string, stratum_field string, stratum string, target_share double, sample_size long, min_rows long")
    drawn, report = sampling.sample_to_targets(cat, tg)
    d, r = drawn.collect(), {x.stratum: x for x in report.collect()}
    assert (r["small"].available, r["small"].missing, r["absent"].missing, r["BIG ONE"].missing) == (11, 29, 10, 0)
    assert (r["small"].short, r["absent"].short, r["BIG ONE"].short) == (29, 10, 0)
    assert len({x.behavior_id for x in d}) == len(d) == 100 and Counter(x.stratum for x in d)["small"] == 11
    assert sampling.sample_to_targets(cat.limit(0), tg)[1].filter("available > 0").isEmpty()
    assert sampling.sample_to_targets(cat, tg.limit(0))[0].count() == 0


def test_seeded_rank(spark):
    d = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(500)], "g long, k long")
    got = common.seeded_rank(d, ["g"], "k", "s").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r["rank"])
    assert sum(map(len, by.values())) == 500 and all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), sql.oracle_sql()[name])


def test_counts_are_of_the_found(spark, sf):
    found = Counter((r.tbl, r.defect) for r in queries.p1_found(spark, sf).collect())
    assert {(r.tbl, r.defect): r.rows for r in queries.p1_counts(spark, sf).collect()} == found and sum(found.values()) > 8


def test_sample_is_as_allocated(spark, sf):
    report = {(r.plan_id, r.stratum): r for r in queries.p2_allocation(spark, sf).collect()}
    drawn = queries.p2_sample(spark, sf).collect()
    assert len({(r.plan_id, r.behavior_id) for r in drawn}) == len(drawn)
    assert Counter((r.plan_id, r.stratum) for r in drawn) == Counter({k: r.taken for k, r in report.items() if r.taken})
    for r in report.values():
        assert r.taken == r.direct + r.received and r.short == max(0, r.wanted - r.taken) and r.missing == max(0, r.wanted - r.available) and r.direct <= r.wanted
    assert len(report) == spark.read.parquet(f"{sf}/sample_targets.parquet").count()


def test_shares_are_the_targets(spark, sf):
    rows = queries.p3_shares(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/teacher_rows.parquet").count() + spark.read.parquet(f"{sf}/behavior_catalog.parquet").select("behavior_id").distinct().count()
    assert sum(r.records for r in rows) == n and len(rows) == 3 and all(abs(r.share - r.target_share) < 0.02 for r in rows)


def test_giant_components():
    # components larger than a quota, of several profiles: the others make up for them
    bundles = {(5000, "a"): 1, (900, "b"): 1, (3, "a"): 400, (1, "a"): 900, (2, "b"): 700, (1, "c"): 50}
    plan = splits.plan_splits(bundles, {"train": 0.8, "val": 0.1, "test": 0.1})
    total = sum(s * n for (s, _), n in bundles.items())
    got = Counter()
    for (size, p), parts in plan.items():
        assert sum(k for _, k in parts) == bundles[size, p] and all(k >= 0 for _, k in parts)
        for s, k in parts:
            got[s] += size * k
    assert all(abs(got[s] / total - share) < 0.002 for s, share in (("train", 0.8), ("val", 0.1), ("test", 0.1))), got
    assert splits.plan_splits({}, {"x": 1.0}) == {} and splits.plan_splits(bundles, {}) == {}
    even = splits.plan_splits({(1, "a"): 10}, {"x": 0.0, "y": 0.0})
    assert dict(even[1, "a"]) == {"x": 5, "y": 5}
    many = {(s, p): 1 + s % 3 for s in range(1, 1500) for p in "abc"}
    assert len(splits.plan_splits(many, {"train": 0.8, "val": 0.1, "test": 0.1})) == len(many)
