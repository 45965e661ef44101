import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import encode, flow, mixing, split

STRANGE = [None, "", " ", "\n\n  \t", "a" * 5000, "温度阀门样本" * 900, "x y​z\r\n\r\nq", "<|endoftext|> don't we'll 12345 ½ ²", "é" * 40 + "👩‍👩‍👧" * 30, "\ud83d"[:0] + "ß" * 3, "--" * 400, "aé" * 3000]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    e = encode.encoder()
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def test_same_ids_as_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in encode.encode(docs).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert got[k] == (library.encode_ordinary(t) if t else [])


def test_strange_texts(spark, library):
    # repeated keys and clashing names: every row comes out, once
    rows = [(i // 2, t, "k", "t") for i, t in enumerate(STRANGE)]
    d = spark.createDataFrame(rows, "doc_id long, text string, k string, t string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in encode.encode(d).collect())
    assert got == sorted((k, tuple(library.encode_ordinary(t)) if t else ()) for k, t, _, _ in rows)
    assert encode.encode(d.limit(0)).collect() == []
    counts = sorted(r.n_tokens for r in encode.count_tokens(d.select("doc_id", "text")).collect())
    assert counts == sorted(len(library.encode_ordinary(t)) if t else 0 for t in STRANGE)
    e = encode.encoder()
    for t in STRANGE:
        if t:
            assert e.decode(e.ids(t)) == t


def test_scan_and_heap_agree():
    r, rng = encode.encoder().ranks, random.Random(1)
    for _ in range(800):
        w = bytes(rng.choice(b"abcetnsio ") if rng.random() < 0.9 else rng.randrange(256) for _ in range(rng.randrange(1, 120)))
        assert encode.merge_by_scan(w, r) == encode.merge_by_heap(w, r)


def test_range_max():
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.integers(0, 5, 300)
    t = split.RangeMax(v)
    for _ in range(500):
        lo = int(rng.integers(0, 300))
        hi = int(rng.integers(lo, 300))
        best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
        assert t.argmax(lo, hi) == best
    v = rng.integers(0, 3, 3000)
    t = split.RangeMax(v, 20)
    t.BLOCK = 64  # the table moves along with the ranges
    for lo in range(0, 2980, 7):
        hi = lo + int(rng.integers(0, 20))
        assert t.argmax(lo, hi) == max(range(lo, hi + 1), key=lambda i: (v[i], i)) and max(map(len, t.levels)) <= 64


def test_overlap_is_as_wanted():
    e = encode.encoder()
    for t in ("word " * 20000, "温度阀门样本" * 4000, "aé" * 9000):  # no boundary is stronger than another
        got = split.pieces(t, e)
        assert len(got) > 3
        overlaps = [e.count(t[b:z]) for (_, z, _), (b, _, _) in zip(got, got[1:])]
        assert all(120 <= n <= 136 for n in overlaps), overlaps


@pytest.mark.parametrize("limit,overlap", [(16, 4), (64, 8), (256, 32)])
def test_pieces_cover_and_keep_the_limit(limit, overlap):
    e = encode.encoder()
    prose = ("First sentence here, with a clause; and more. Second one!\n\nNew paragraph starts.\nA line without end " * 12) + "温度阀门，样本。" * 60
    for t in [*STRANGE, prose]:
        got = split.pieces(t, e, limit, overlap) if t else []
        if not t:
            assert split.pieces(t, e, limit, overlap) == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(t)
        for a, z, n in got:
            assert n == e.count(t[a:z]) and (n <= limit or z - a == 1)
        for (a, z, _), (b, y, _) in zip(got, got[1:]):
            assert a < b <= z < y
    ends = [prose[z - 1] for _, z, _ in split.pieces(prose, e, 256, 32)[:-1]]
    assert all(c in "\n.!。" for c in ends)


def test_split_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    e = encode.encoder()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = split.split_oversized(docs).collect()
    assert {r.doc_id for r in rows} == {k for k, t in texts.items() if t and e.count(t) > 2048}
    assert all(r.text == texts[r.doc_id][r.start : r.end] and r.n_tokens <= 2048 for r in rows)
    small = spark.createDataFrame([(1, None), (1, ""), (2, "short"), (2, "short")], "doc_id long, text string")
    assert split.split_oversized(small).count() == 0
    assert split.split_oversized(small, keep_small=True).count() == 2
    assert split.split_oversized(small.limit(0)).count() == 0


def test_flow_is_optimal():
    rng = random.Random(4)
    for _ in range(40):
        m, n = rng.randint(1, 3), rng.randint(1, 3)
        supply, demand = [rng.randint(0, 3) for _ in range(m)], [rng.randint(0, 3) for _ in range(n)]
        cost = [[rng.randint(0, 4) for _ in range(n)] for _ in range(m)]
        net = flow.MinCostFlow(2 + m + n)
        for i, s in enumerate(supply):
            net.arc(0, 2 + i, s)
        for j, d in enumerate(demand):
            net.arc(2 + m + j, 1, d)
        for i in range(m):
            for j in range(n):
                net.arc(2 + i, 2 + m + j, 9, cost[i][j])
        got = net.run(0, 1)

        def brute(units, left):
            if not units:
                return (0, 0)
            best = brute(units[1:], left)
            for j in range(n):
                if left[j]:
                    k, c = brute(units[1:], left[:j] + (left[j] - 1,) + left[j + 1 :])
                    cand = (k + 1, c + cost[units[0]][j])
                    if (-cand[0], cand[1]) < (-best[0], best[1]):
                        best = cand
            return best

        assert got == brute([i for i, s in enumerate(supply) for _ in range(s)], tuple(demand))


def mix_fixture(spark):
    rng = random.Random(6)
    words = "the of and river stone paper lamp green".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(3, 30))), "big" if i < 300 else "small" if i < 330 else "tiny") for i in range(340)]
    docs += [(1000, None, "big"), (1001, "", "small"), (1002, "no source", None), (1003, docs[0][1], "small"), (1004, docs[0][1], "big")]
    t = [("m", "big", 0.5, 2, 2000), ("m", "small", 0.3, 3, 2000), ("m", "tiny", 0.1, 2, 2000), ("m", "absent", 0.1, 2, 2000), ("n", "tiny", 1.0, 4, 100)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(t, "mix_id string, source string, target_share double, max_repeats int, total_tokens long")


def test_mixing(spark):
    docs, targets = mix_fixture(spark)
    sized = mixing.sized(docs)
    chosen, report = mixing.mix(sized, targets)
    rows, rep = chosen.collect(), {(r.mix_id, r.source): r for r in report.collect()}
    assert len(rep) == 5 and len({(r.mix_id, r.source, r.doc_id) for r in rows}) == len(rows)
    most = {("m", "big"): 2, ("m", "small"): 3, ("m", "tiny"): 2, ("n", "tiny"): 4}
    whole = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    for k, r in rep.items():
        mine = [x for x in rows if (x.mix_id, x.source) == k]
        assert sum(x.n_tokens * x.uses for x in mine) == r.tokens
        if k[1] == "absent":
            assert r.tokens == 0 and r.gap_tokens == r.target_tokens
            continue
        assert max(x.uses for x in mine) <= most[k] and max(x.uses for x in mine) - min([x.uses for x in mine]) <= 2
        can = whole[k[1]] * most[k]
        assert r.tokens >= min(r.target_tokens, can) - 40
        assert r.tokens <= r.target_tokens + 2 * 40
    assert {(x.mix_id, x.doc_id, x.uses) for x in mixing.mix(sized, targets)[0].collect()} == {(x.mix_id, x.doc_id, x.uses) for x in rows}
    empty, rep0 = mixing.mix(mixing.sized(docs.limit(0)), targets)
    assert empty.count() == 0 and rep0.count() == 5


def test_shared_texts_spread_over_sources():
    # one text in both sources: using it for both costs a repetition, so b takes its own first
    plan = mixing.plan_mix({"0:a": 10, "0:a\x1fb": 10, "0:b": 10}, {"a": 10, "b": 20}, {"a": 2, "b": 2})
    assert plan == {("0:a", "a"): 10, ("0:a\x1fb", "b"): 10, ("0:b", "b"): 10}
    # further copies of a text are further uses of it: a second copy costs what a first repetition does, a fourth one more
    assert mixing.plan_mix({"0:a": 10, "2:a": 10}, {"a": 12}, {"a": 3}) == {("0:a", "a"): 12}
    assert mixing.plan_mix({"2:a": 10, "0:a": 10}, {"a": 10}, {"a": 1}) == {("0:a", "a"): 10}
    assert sum(u for u, _ in mixing.use_levels(1000)) == 1000 and [c for _, c in mixing.use_levels(300)] == [*range(64), 64, 128, 256]


def test_plan_costs_least():
    # against all ways to use whole texts: the cost of a text's k-th use, over all sources, is k - 1
    rng = random.Random(9)
    for _ in range(60):
        texts = [rng.choice(["a", "b", "a\x1fb"]) for _ in range(rng.randint(1, 4))]
        repeats = {"a": rng.randint(1, 2), "b": rng.randint(1, 2)}
        quota = {"a": rng.randint(0, 4), "b": rng.randint(0, 4)}
        supply = {}
        for t in texts:
            supply["0:" + t] = supply.get("0:" + t, 0) + 1
        plan = mixing.plan_mix(supply, quota, repeats)
        got = {s: sum(n for (_, x), n in plan.items() if x == s) for s in quota}
        cost = 0
        for p, n in supply.items():
            used = sum(k for (q, _), k in plan.items() if q == p)
            cost += sum(k * min(n, max(0, used - n * k)) for k in range(4))
            assert all(plan.get((p, s), 0) <= n * repeats[s] for s in quota)

        def ways(i, left):
            if i == len(texts):
                yield 0, 0
                return
            s = texts[i].split("\x1f")
            for x in range((repeats["a"] if "a" in s else 0) + 1):
                for y in range((repeats["b"] if "b" in s else 0) + 1):
                    if x <= left["a"] and y <= left["b"]:
                        for n, c in ways(i + 1, {"a": left["a"] - x, "b": left["b"] - y}):
                            yield n + x + y, c + sum(range(x + y))

        most = max(n for n, _ in ways(0, quota))
        assert sum(got.values()) == most and cost == min(c for n, c in ways(0, quota) if n == most)
        assert all(got[s] <= quota[s] for s in quota)


def test_overlapping_sources(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices("river stone paper lamp green".split(), k=rng.randint(5, 15))) + f" {i}" for i in range(120)]
    docs = [(i, t, "a") for i, t in enumerate(texts[:80])] + [(1000 + i, t, "b") for i, t in enumerate(texts[40:])] + [(2000 + i, texts[50], "b") for i in range(30)] + [(3000 + i, texts[5], "a") for i in range(3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    s = mixing.sized(d)
    where = {(r.key, r.source): (r.h, r.layer, r.pattern) for r in s.collect()}
    assert len(where) == len(docs) and all(src in p.split(":")[1].split("\x1f") for (_, src), (_, _, p) in where.items())
    layers = {}
    for (k, src), (h, layer, p) in where.items():
        layers.setdefault((h, layer), set()).add((src, p))
    assert all({x for x, _ in v} == set(next(iter(v))[1].split(":")[1].split("\x1f")) and len({p for _, p in v}) == 1 for v in layers.values())
    n = {r.source: r.n for r in s.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    per_text = {}
    t = spark.createDataFrame([("m", "a", 0.5, 2, 1200), ("m", "b", 0.5, 2, 1200)], "mix_id string, source string, target_share double, max_repeats int, total_tokens long")
    chosen, report = mixing.mix(s, t)
    for r in chosen.collect():
        h = where[r.doc_id, r.source][0]
        per_text[h] = per_text.get(h, 0) + r.uses
        assert r.uses <= 2
    rep = {r.source: r for r in report.collect()}
    assert all(abs(r.tokens - 600) <= 30 for r in rep.values()) and n["a"] > 600
    # 1,200 tokens of about 1,700 of distinct texts: no text need be used twice but for what fills the ends
    assert sum(u > 1 for u in per_text.values()) <= 4


def test_mix_of_documents(spark, sf):
    from millrace.llm import queries

    rows, rep = queries.p7_mix(spark, sf).collect(), queries.p7_shares(spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    targets = {(r.mix_id, r.source): r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    tokens, most = {}, {}
    for r in rows:
        k = (r.mix_id, r.source)
        assert source[r.doc_id] == r.source and 1 <= r.uses <= targets[k].max_repeats
        tokens[k] = tokens.get(k, 0) + r.n_tokens * r.uses
        most[k] = max(most.get(k, 0), r.uses)
    have = {}
    for r in mixing.sized(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        have[r.source] = have.get(r.source, 0) + r.n_tokens
    assert {(r.mix_id, r.source) for r in rep} == set(targets)
    for r in rep:
        k = (r.mix_id, r.source)
        assert (r.tokens, r.most_uses) == (tokens.get(k, 0), most.get(k, 0)) and r.target_tokens == round(targets[k].target_share * targets[k].total_tokens)
        can = have.get(r.source, 0) * targets[k].max_repeats
        assert r.gap_tokens == max(0, r.target_tokens - r.tokens) and r.tokens >= min(r.target_tokens, can)
