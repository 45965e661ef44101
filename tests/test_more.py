"""Operators at their edges: hot keys, long sequences, large groups, and rules against brute force."""

import http.server
import json
import random
import threading
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import plans, storage
from millrace.functions import arrays as A
from millrace.functions import text
from millrace.functions.text import tokens
from millrace.operators import advantages as adv
from millrace.operators import balance, batch, chat, duplicates, joins, losses, metrics, partition, schedule, scoring, skew, validate, votes
from millrace.sources import files
from millrace.streaming import state


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_spread_join(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 20}", 1000 + i) for i in range(100)] + [(None, 5), ("alone", 7)]
    a = spark.createDataFrame(rows, "k string, i long")
    b = spark.createDataFrame([("hot", 1), *[(f"k{i}", 2) for i in range(20)], (None, 3), ("unused", 4)], "k string, v int")
    for how in ("inner", "left"):
        got = Counter((r.k, r.i, r.v) for r in skew.spread_join(a, b, ["k"], how, by=["i"], hot=50).collect())
        assert got == Counter((r.k, r.i, r.v) for r in a.join(b, "k", how).select("k", "i", "v").collect())
    n = a.filter("k is not null").groupBy("k").count()
    got = skew.spread_join(a, n, ["k"], by=["i"], count="count", hot=50)
    assert got.columns == ["k", "i"] and got.count() == 601
    assert skew.spread_join(a.limit(0), b, ["k"]).count() == 0


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        applicationId, master = "other", "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_hot_tokens_are_divided(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 7)
    rng = random.Random(8)
    rows = [(i, " ".join(sorted({"a", "b", *rng.sample("cdefg", rng.randint(0, 3))}))) for i in range(120)] + [(500, None), (501, ""), (None, "a b")]
    members, links = duplicates.token_pairs(spark.createDataFrame(rows, "k long, t string"), "k", tokens("t"), 0.6)
    sets = {k: frozenset(t.split()) for k, t in rows if k is not None and t}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in duplicates.expanded(members, links).collect()} == want
    rep = {s: min(k for k in sets if sets[k] == s) for s in set(sets.values())}
    linked = Counter(k for r in links.collect() for k in (r.a, r.b))
    assert {r.key: (r.rep, r.copies, r.links) for r in members.collect()} == {k: (rep[s], sum(x == s for x in sets.values()) - 1, linked[rep[s]]) for k, s in sets.items()}
    # greedy promotion over all keys, copies included
    cand = spark.createDataFrame([(k, "g") for k in sets] + [(900, "g")], "k long, g string")
    kept = []
    for k in sorted(sets):
        if not any((j, k) in want for j in kept):
            kept.append(k)
    got = duplicates.promote(cand, members.withColumnRenamed("k", "key"), links, "k", "g", 1000)
    assert sorted(r.k for r in got.collect()) == [*kept, 900]


@pytest.mark.parametrize(("counted", "hashes"), [(100_000, None), (1, None), (100_000, 5)])
def test_links_of_sets_with_common_tokens(spark, monkeypatch, counted, hashes):
    """Sets that share tokens but aren't similar are no candidates; the order of tokens and equal hashes lose no pair."""
    monkeypatch.setattr(duplicates, "COUNTED", counted, raising=False)
    if hashes:
        plain = F.hash
        monkeypatch.setattr(F, "hash", lambda *c: F.pmod(plain(*c), F.lit(hashes)))
    wrote, keep = {}, duplicates.staged
    monkeypatch.setattr(duplicates, "staged", lambda d, name: wrote.setdefault(name, keep(d, name)))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(26)]
    base = [set(rng.sample(words, rng.randint(9, 14))) for _ in range(100)]
    sets = dict(enumerate(base + [(x | {rng.choice(words)}) - set(rng.sample(words, 3)) for x in base[:40]]))
    rows = [(f"k{i:03}", " ".join(sorted(x))) for i, x in sets.items()]
    _, links = duplicates.token_pairs(spark.createDataFrame(rows, "k string, t string"), "k", tokens("t"), 0.72)
    first = {}
    for k, x in sets.items():
        first.setdefault(frozenset(x), f"k{k:03}")
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) / len(x | y) >= 0.72}
    assert {(r.a, r.b) for r in links.collect()} == want and want
    if not hashes:
        assert wrote["candidates"].count() < len(rows) ** 2 / 8


def test_links_read_no_statements(spark, sf):
    plan = plans.queries()["behavior_near_links"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_near_pairs_take_linked_statements_only(spark, monkeypatch):
    wrote, keep = {}, duplicates.staged
    monkeypatch.setattr(duplicates, "staged", lambda d, name: wrote.setdefault(name, keep(d, name)))
    rows = [(i, f"w{i}a w{i}b w{i}c w{i}d", "t") for i in range(30)] + [(100, "w3a w3b w3c w3d more", None)]
    _, pairs = duplicates.near_pairs(spark.createDataFrame(rows, "k long, s string, t string"), "k", "s", "t")
    assert [(r.a, r.b, r.jaccard, r.ratio) for r in pairs.collect()] == [(3, 100, 0.8, 0.0)]
    assert {r[0] for r in wrote["linked"].select("k").collect()} == {3, 100}


def test_promotion_writes_the_candidates_once(spark, monkeypatch):
    wrote, keep = {}, duplicates.staged

    def staged(d, name):
        wrote[name] = keep(d, name)
        return wrote[name]

    monkeypatch.setattr(duplicates, "staged", staged)
    cand = spark.createDataFrame([(k, "g") for k in range(1, 7)], "k long, g string")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "key long, rep long")
    links = spark.createDataFrame([(1, 3), (3, 4)], "a long, b long")
    got = duplicates.promote(cand, members, links, "k", "g", 3)
    assert sorted((r.k, r.position) for r in got.collect()) == [(1, 1), (4, 2), (5, 3)]
    assert {r.k for r in wrote["firsts"].collect()} == {1, 3, 4, 5, 6}


def test_long_chains_of_conflicts(spark):
    n = 70
    keys = spark.range(n).withColumnRenamed("id", "k")
    got = duplicates.greedy_keep(keys, spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long"), "k")
    assert {r.k for r in got.filter("kept").collect()} == set(range(0, n, 2))


def test_large_groups_are_chosen_alike(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0.2, 0.5, 0.5, 0.9]), rng.sample("abcdefgh", rng.randint(0, 4))) for g in ("x", None) for i in range(60)]
    d = spark.createDataFrame(rows, "g string, id long, score double, tokens array<string>")
    want = {(r.g, r.pick): r.id for r in duplicates.diverse_top(d, "g", "id", "score", F.col("tokens"), 6).collect()}
    monkeypatch.setattr(duplicates, "GATHERED", 10)
    assert {(r.g, r.pick): r.id for r in duplicates.diverse_top(d, "g", "id", "score", F.col("tokens"), 6).collect()} == want and len(want) == 12


def test_negatives_are_the_rotation(spark):
    rng = random.Random(1)
    rows = [(i, k) for k in ("a", "b") for i in range(1000 * (k == "b"), 1000 * (k == "b") + 96)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "i long, kind string")
    pos = schedule.positives(d, "kind", "i", 3, 24, "s")
    got = defaultdict(dict)
    for r in schedule.negatives(d, pos, "kind", "i", 3, 8, 24, "s").collect():
        got[r.epoch, r.kind, r.step][r.place] = r["index"]
    own = defaultdict(set)
    for r in pos.collect():
        own[r.epoch, r.kind, r.step].add(r["index"])
    import hashlib

    for e in (1, 2, 3):
        for k in ("a", "b"):
            circle = sorted((i for i, x in rows if x == k), key=lambda i: hashlib.sha256(f"s:neg:{e}:{k}:{i}".encode()).hexdigest())
            at = 0
            for step in range(1, 5):
                took = []
                while len(took) < 8:
                    c = circle[at % 96]
                    at += 1
                    if c not in own[e, k, step]:
                        took.append(c)
                assert [got[e, k, step][j] for j in range(8)] == took
    with pytest.raises(ValueError):
        small = d.filter("i < 24")
        schedule.negatives(small, schedule.positives(small, "kind", "i", 1, 24, "s"), "kind", "i", 1, 8, 24, "s").collect()


def test_prompt_pools_in_parts(spark, monkeypatch):
    pool = spark.createDataFrame([(f"t{i}", f"p{i}", "f") for i in range(23)], "query_type string, prompt string, family string")
    items = spark.createDataFrame([(i,) for i in range(9)], "i long")
    want = sorted(map(tuple, schedule.prompts_per_item(items, pool, "i").collect()))
    monkeypatch.setattr(schedule, "POOL", 5)
    assert sorted(map(tuple, schedule.prompts_per_item(items, pool, "i").collect())) == want and len(want) == 36


def test_long_sequences(spark):
    import time

    n = 32_000
    d = spark.range(2).select("id", *[F.transform(F.sequence(F.lit(1), F.lit(n)), f).alias(c) for c, f in (("v", lambda i: (i % 7).cast("double")), ("m", lambda i: (i % 5 != 0).cast("double")))])
    d = d.withColumn("v", F.when(F.col("id") == 0, F.col("v")).otherwise(F.slice("v", 1, 10))).withColumn("m", F.when(F.col("id") == 0, F.col("m")).otherwise(F.slice("m", 1, 10)))
    t = time.time()
    r = d.select("id", A.suffix_sums(F.col("v"), 0.9, F.col("m")).alias("s"), A.prefix_sums(F.col("v")).alias("p"), A.gae(F.col("v"), F.col("v"), F.col("m"), 0.9, 0.8).alias("g")).orderBy("id").collect()
    assert time.time() - t < 60
    for row, size in zip(r, (n, 10)):
        v, m = [float(i % 7) for i in range(1, size + 1)], [float(i % 5 != 0) for i in range(1, size + 1)]
        run, want = 0.0, []
        for x, k in zip(reversed(v), reversed(m)):
            want.append(x + 0.9 * run)
            run = want[-1] * k
        assert row.s == pytest.approx(want[::-1]) and row.p == pytest.approx(np.cumsum(v)) and len(row.g) == size
    odd = spark.createDataFrame([(None,), ([],), ([1.0, None, 2.0],)], "v array<double>")
    assert [x.p for x in odd.select(A.prefix_sums(F.col("v")).alias("p")).collect()] == [None, [], [1.0, 1.0, 3.0]]


def test_whitening_keeps_digits(spark):
    rows = [(i, [1e9 + (i * 7 + k) % 5 for k in range(4)], [1.0, 1.0, 0.0, 1.0]) for i in range(50)]
    d = spark.createDataFrame(rows, "i long, x array<double>, mask array<double>")
    flat = [x for _, xs, m in rows for x, k in zip(xs, m) if k]
    got = [x for r in adv.whiten(d, "x").collect() for x, k in zip(r.x, r.mask) if k]
    # the mean is that of the definition, whose divisor is the count plus 1e-8
    mean = sum(flat) / (len(flat) + 1e-8)
    assert np.std(got, ddof=1) == pytest.approx(np.std(flat, ddof=1) / np.sqrt(np.var(flat) + (np.mean(flat) - mean) ** 2), rel=1e-2)
    assert len(set(np.round(got, 6))) == 5
    assert adv.whiten(d.limit(0), "x").count() == 0


def test_logs_in_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["sample"] * 6 + ["sync", "other", None])) for i in range(300)]
    got = {r.i: (r.in_flight, r.paused) for r in state.staleness(spark.createDataFrame(rows, "i long, e string"), "i", "e", 4, 0.5, 1).collect()}
    n = 0
    for i, e in rows:
        n = 0 if e == "sync" else n + (e == "sample")
        assert got[i] == (n, n >= 6)
    vals = [(i, rng.uniform(0, 30) if i % 9 else None) for i in range(120)]
    c, got = 0.2, {r.i: r.coefficient for r in state.kl_controller(spark.createDataFrame(vals, "i long, v double"), "i", "v", 0.2, 12.0, 1000, 50).collect()}
    for i, v in vals:
        c = metrics.adaptive_coefficient(c, v, 50, 12.0, 1000) if v is not None else c
        assert got[i] == pytest.approx(c)
    calls = [(i, float(rng.randrange(0, 4000))) for i in range(90)]
    got = {r.i: r.scheduled for r in state.even_schedule(spark.createDataFrame(calls, "i long, a double"), "a", "i", 25.0).collect()}
    last = None
    for i, a in calls:
        last = a if last is None else max(a, last + 25.0)
        assert got[i] == pytest.approx(last)
    gate = [(i, rng.uniform(0, 1)) for i in range(200)]
    got = {r.i: r.open for r in adv.running_gate(spark.createDataFrame(gate, "i long, v double"), "i", ["v"], 6, 0.7).collect()}
    is_open = False
    for i, _ in gate:
        is_open = is_open or i >= 5 and np.mean([v for _, v in gate[i - 5 : i + 1]]) >= 0.7
        assert got[i] == is_open
    assert state.staleness(spark.createDataFrame([], "i long, e string"), "i", "e", 4, 0.5, 1).count() == 0


def test_token_bucket(spark, tmp_path):
    rows = [("u", i, t) for i, t in enumerate([0.0, 0.1, 0.2, 0.3, 1.0, 1.1, 9.0, 9.0, 9.0, 9.0])]
    spark.createDataFrame(rows, "b string, i long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("b string, i long, t double").parquet(str(tmp_path / "in"))
    q = state.token_bucket(stream, "b", "i", "t", 2.0).writeStream.format("memory").queryName("bucket").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    held, last, want = 2.0, None, {}
    for _, i, t in rows:
        held = min(2.0, held + ((t - last) * 2 if last is not None else 0))
        last = t
        want[i] = held >= 1
        held -= want[i]
    assert {r.i: r.granted for r in spark.table("bucket").collect()} == want


def test_rounds_and_waves(spark, tmp_path):
    items = spark.range(40).withColumnRenamed("id", "k")
    work = lambda d, k: d.select("k", "chunk", F.when((F.col("k") % 4 == 0) & (F.col("errors") < 3), "error").otherwise("ok").alias("status"))
    assert state.waves(items, "k", work, str(tmp_path / "o"), str(tmp_path / "l"), 15) == 40
    assert {(r.k % 4 == 0, r.chunk) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {(True, 1), (False, 8)}
    with pytest.raises(RuntimeError):
        state.waves(items, "k", lambda d, k: d.select("k", F.lit("error").alias("status")), str(tmp_path / "o2"), str(tmp_path / "l2"), 15)
    groups = spark.createDataFrame([(i, 0) for i in range(6)], "k long, tries int")
    audit = lambda g, k: g.select("k", F.when(F.col("tries") >= F.col("k"), "PASS").otherwise("FAIL").alias("label"))
    now, last = state.audited(groups, "k", audit, lambda g, a, k: g.filter("k <> 2").withColumn("tries", F.col("tries") + 1), 3)
    assert {r.k: r.label for r in last.collect()} == {0: "PASS", 1: "PASS", 2: "FAIL", 3: "PASS", 4: "FAIL", 5: "FAIL"}
    assert {r.k: r.tries for r in now.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 3}
    with pytest.raises(RuntimeError):
        state.rounds(lambda k, have: spark.createDataFrame([(1,)], "k long"), lambda d: d.filter("k > 1"), str(tmp_path / "r"), spark, 5)


def test_majorities(spark):
    rng = random.Random(5)
    x, v = [round(rng.random(), 3) for _ in range(7)], [rng.choice("abc") for _ in range(7)]
    idx = np.random.RandomState(42).choice(7, size=(300, 4), replace=True)
    won = []
    for row in idx:
        n = Counter(v[i] for i in row)
        won.append(next(x[i] for i in row if n[v[i]] == max(n.values())))
    assert metrics.majority_of(np.array(x), np.array(v), 4, 300, 42) == pytest.approx((np.mean(won), np.std(won)))
    d = spark.createDataFrame([("s", "u", i, a, b, None if i else float("nan")) for i, (a, b) in enumerate(zip(x, v))], "s string, u string, i long, x double, v string, y double")
    got = {(r.variable, r.metric): r.value for r in metrics.validation_metrics(d, "s", "u", ["x", "y"], "v", "i", draws=300).collect()}
    assert got["x", "maj@4/mean"] == pytest.approx(np.mean(won)) and got["x", "maj@4/std"] == pytest.approx(np.std(won))
    b = metrics.bootstrap(x, 4, draws=40000)
    for k in ("best", "worst"):
        assert got["x", f"{k}@4/mean"] == pytest.approx(b[f"{k}_mean"], abs=0.01) and got["x", f"{k}@4/std"] == pytest.approx(b[f"{k}_std"], abs=0.01)
    assert ("y", "mean@0") not in got and not [k for k in got if k[0] == "y"]


def test_chat_ids(spark):
    m = chat.messages(system=F.lit("s"), user=F.lit("hi"), assistant=F.lit(" yes "))
    d = spark.range(1).select(m.alias("m"))
    full = "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n yes <|im_end|>\n"
    r = chat.tokenized(d, "m", 500).first()
    assert bytes(r.input_ids).decode() == full and bytes(x for x in r.labels if x >= 0).decode() == " yes <|im_end|>\n" and set(r.attention_mask) == {1} and r.error is None
    r = chat.tokenized(d, "m", 20).first()
    assert len(r.input_ids) == 20 and bytes(r.input_ids).decode() == full[-20:] and r.labels.count(-100) == 4
    r = chat.tokenized(d, "m", 500, target="answer_only").first()
    assert bytes(x for x in r.labels if x >= 0).decode() == "yes"
    assert chat.tokenized(d, "m", 5).first().error == "target_too_long"
    none = spark.range(1).select(chat.messages(user=F.lit("hi"), assistant=F.lit(" \n")).alias("m"))
    assert chat.tokenized(none, "m", 50).first().error == "no_target" and chat.tokenized(spark.range(1).select(F.lit(None).cast("array<struct<role:string,content:string>>").alias("m")), "m", 50).first().error == "no_target"
    with pytest.raises(ValueError):
        chat.tokenized(d, "m", 5, target="other")


def test_time_limit(spark):
    import time

    def scorer(row):
        while row["k"] == 3:
            pass
        return {"score": row["k"], "twice": row["k"] * 2} if row["k"] < 5 else row["nothing"]

    t = time.time()
    got = {r.k: (r.score, r.twice) for r in scoring.timed(spark.createDataFrame([(i,) for i in range(6)], "k long").coalesce(1), scorer, ["k"], seconds=1.0, failed=-1.0, extras=("twice",)).collect()}
    assert got == {0: (0.0, 0.0), 1: (1.0, 2.0), 2: (2.0, 4.0), 3: (-1.0, None), 4: (4.0, 8.0), 5: (-1.0, None)} and time.time() - t < 30


def test_fetched_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,t\n1,"x ""y"""\n2,z\n')
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": 2}\n')

    class Quiet(http.server.SimpleHTTPRequestHandler):
        asked = []

        def __init__(self, *a):
            super().__init__(*a, directory=str(tmp_path))

        def do_GET(self):
            self.asked.append(self.path)
            super().do_GET()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Quiet)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    for _ in range(2):
        assert sorted(map(tuple, files.read_url(spark, f"{base}/a.csv", "csv", "k long, t string").collect())) == [(1, 'x "y"'), (2, "z")]
        assert files.read_url(spark, f"{base}/b.jsonl?v=1", "jsonl", "k long", most=1).count() == 1
    assert Quiet.asked == ["/a.csv", "/b.jsonl?v=1"]
    server.shutdown()
    p = files.cached_copy(spark, f"file://{tmp_path}/a.csv", str(tmp_path / "cache"))
    assert files.cached_copy(spark, f"file://{tmp_path}/a.csv", str(tmp_path / "cache")) == p and spark.read.text(p).count() == 3
    g = tmp_path / "g.jsonl.gz"
    g.write_bytes(files.gzip_bytes(b'{"k": 1}\n'))
    good = files.inspect_gzip(str(g), rows=1)
    files.inspect_gzip(str(g), sha256=good["sha256"])
    for wrong in ({"rows": 2}, {"sha256": "00"}):
        with pytest.raises(ValueError):
            files.inspect_gzip(str(g), **wrong)
    (tmp_path / "bad.gz").write_bytes(b"no gzip")
    assert {r.path.rsplit("/", 1)[1]: (r.rows, r.error) for r in files.inspect_gzips(spark, [str(g), str(tmp_path / "bad.gz")]).collect()} == {"g.jsonl.gz": (1, None), "bad.gz": (None, "BadGzipFile")}
    a, b = (files.write_gzip(str(tmp_path / n), (f'{{"k": {i}}}' for i in range(500))) for n in ("x.gz", "y.gz"))
    assert a == b == files.inspect_gzip(str(tmp_path / "x.gz")) and (tmp_path / "x.gz").read_bytes() == (tmp_path / "y.gz").read_bytes()
    import hashlib

    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in files.file_digests(spark, [f"file://{tmp_path}/x.gz", str(tmp_path / "a.csv")]).collect()}
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n in ("x.gz", "a.csv") for x in [(tmp_path / n).read_bytes()]}
    files.append_line(str(tmp_path / "log.csv"), {"a": 1, "b": "x,y"})
    files.append_line(str(tmp_path / "log.csv"), {"a": 2, "b": None})
    assert (tmp_path / "log.csv").read_text().splitlines() == ["a,b", '1,"x,y"', "2,"]
    assert files.html_lines("<p>a<br>b</p><script>x</script><style>y</style> <p> c &amp; d</p>") == ["a", "b", "c & d"]


def test_batches(spark):
    d = batch.with_index(spark.createDataFrame([(i, [float(i)] * (i % 3)) for i in range(10)], "k long, xs array<double>"), "k")
    out = batch.dispatched(d, 4, "pad")
    assert Counter(r.worker for r in out.collect()) == {0: 3, 1: 3, 2: 3, 3: 3} and batch.gathered(out).count() == 10
    assert batch.dispatched(d, 3, "all").count() == 30 and batch.gathered(batch.dispatched(d, 3, "all")).count() == 10
    with pytest.raises(ValueError):
        batch.dispatched(d, 4)
    with pytest.raises(ValueError):
        batch.renamed(d, {"k": "xs"})
    assert batch.renamed(d, {"k": "key"}).columns == ["key", "xs", "row_index"]
    r = batch.rectangular(d, ["xs"], mask="there")
    assert {len(x.xs) for x in r.collect()} == {2} and {x.k: x.xs for x in batch.ragged(r, ["xs"], "there").collect()} == {x.k: x.xs for x in d.collect()}
    rest, taken = batch.dropped(d, "xs")
    assert rest.columns == ["k", "row_index"] and taken.columns == ["row_index", "xs"]
    seen = spark.createDataFrame([(3, 1.0), (3, 0.0)], "row_index long, reward double")
    c = batch.updated_difficulty(d.withColumn("hard", F.lit(None).cast("double")), seen, "hard")
    assert {x.k: x.hard for x in c.collect()}[3] == 0.5
    order = [x.k for x in batch.sampled_order(c.withColumn("hard", -F.col("k").cast("double")), "curriculum", difficulty="hard").orderBy("row_index").collect()]
    assert order == list(range(9, -1, -1))


def test_rank_order(spark):
    rng = random.Random(4)
    rows = [(b, i, rng.randint(1, 500), i // 4) for b in range(3) for i in range(64)]
    d = spark.createDataFrame(rows, "b int, i long, n long, uid long")
    for grouped, mini in ((False, None), (False, 32), (True, None)):
        got = balance.rank_order(d, "b", "i", "n", 4, mini, grouped).collect()
        for b in range(3):
            mine = sorted((r.new_index, r.part, r.i) for r in got if r.b == b)
            assert [x[0] for x in mine] == list(range(64)) and [x[1] for x in mine] == [k // 16 for k in range(64)] and sorted(x[2] for x in mine) == list(range(64))
            work = [sum(balance.cost(rows[b * 64 + i][2]) for _, p, i in mine if p == k) for k in range(4)]
            assert max(work) < 1.2 * min(work) + balance.cost(500) * (4 if grouped else 1)
            if grouped:
                assert all(len({p for _, p, i in mine if i // 4 == u}) == 1 for u in range(16))


def test_recipes(spark):
    import hashlib

    recipes = [{"r": 1}, {"r": 2}, {"r": 3}]
    d = spark.createDataFrame([(f"k{i}",) for i in range(40)], "k string")
    for r in partition.recipe_choice(d, "k", recipes, 7, python=True).collect():
        rng = random.Random(int.from_bytes(hashlib.sha256(f"{r.k}:7".encode()).digest()[:8], "big"))
        assert json.loads(r.recipe) == rng.choice(recipes) and r.recipe_seed == rng.randrange(0, 2**31 - 1)
    assert len({r.recipe_nr for r in partition.recipe_choice(d, "k", recipes, 7).collect()}) == 3


def test_joins_and_votes(spark):
    rows = spark.createDataFrame([(i,) for i in range(100, 120)], "t long")
    m = spark.createDataFrame([(1, 100, "id"), (2, None, "none"), (3, None, "none")], "q long, t long, status string")
    got = {r.q: (r.t, r.status) for r in joins.fallback_match(m, rows, "q", "t", "s").collect()}
    assert got[1] == (100, "id") and all(got[k][1] == "fallback_random" and 100 <= got[k][0] < 120 for k in (2, 3))
    assert {r.q: r.t for r in joins.fallback_match(m, rows, "q", "t", "s").collect()} == {k: v[0] for k, v in got.items()}
    assert joins.fallback_match(m, rows.limit(0), "q", "t", "s").count() == 3
    a = spark.createDataFrame([("h", "q"), ("h", None), ("x", "q")], "h string, q string")
    kept, n = joins.allowed_pairs(a, spark.createDataFrame([("h", None), ("h", "q"), ("h", "q")], "h string, q string"), ["h", "q"])
    assert kept.count() == 2 and tuple(n.first()) == (2, 1)
    kept, n = joins.allowed_product(a, {"q": spark.createDataFrame([("q",), (None,)], "q string"), "h": spark.createDataFrame([("h",), ("h",)], "h string")})
    assert kept.count() == 2 and tuple(n.first()) == (2, 1)
    assert tuple(joins.allowed_product(a, {"h": kept.select("h").limit(0)})[1].first()) == (0, 3)
    r = joins.routed(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), spark.createDataFrame([("a", "DROP_TASK"), ("b", "REVIEW")], "k string, label string"), "k", "label", votes.DROP)
    assert {x.k: (x.kept, x.removed, x.review) for x in r.collect()} == {"a": (False, True, False), "b": (True, False, True), "c": (True, False, False), None: (True, False, False)}
    two = spark.createDataFrame([("a", "REVIEW", "REVIEW", 0.5, 0.5, "REVIEW", 0.5, "x")], "k string, first_label string, second_label string, c1 double, c2 double, label string, confidence double, basis string")
    third = spark.createDataFrame([("b", "REVIEW", 0.5)], "k string, label string, confidence double")
    with pytest.raises(ValueError):
        votes.three_pass(two, third, "k", strict=True)
    assert votes.three_pass(two, third.limit(0), "k").count() == 1


def test_allowed_pairs_make_no_combinations(spark, sf):
    plan = plans.queries()["allowed_teacher_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Generate" not in plan


def test_minibatch_sizes_in_one_pass(spark, tmp_path):
    for n in (0, 12001):
        spark.range(n).select((F.col("id") * 4).alias("o_orderkey")).write.parquet(f"{tmp_path}/{n}/orders.parquet")
        got = plans.queries()["minibatch_sizes"](spark, f"{tmp_path}/{n}")
        assert sorted(map(tuple, got.collect())) == [(k, min(4000, n - 4000 * k)) for k in range(-(-n // 4000))]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_audits_and_batches(spark):
    audit = {"candidate_id": "c", "raw_label": "pass", "semantic_signature": "four words are here", "reason": "r", **dict.fromkeys(validate.AUDIT_METRICS, 0.9)}
    got = lambda a: one(spark, validate.audited_items(F.lit(json.dumps(a))))
    assert got(audit).label == "PASS" and got(audit).errors == []
    assert got(audit | {"safety": 0.7}).label == "FAIL" and got(audit | {"safety": 1.7}).errors == ["metric"] and got(audit | {"raw_label": "?", "semantic_signature": "x"}).errors == ["label", "signature"]
    checks = [{"variant_id": i, "exact": True, "scope_match": True, "ordering_match": True, "no_rule_leakage": True} for i in range(8)]
    strict = {"behavior_id": "b", "variant_checks": checks, "leakage_score": 0.05, "signal_form": "surface_anchor", "signal_strength": "soft", "scope_coverage_pass": True, "factual_safety_pass": True, "raw_label": "PASS"}
    run = lambda a: one(spark, validate.strict_audit(F.lit(json.dumps(a)), F.lit("b")))
    assert run(strict).label == "PASS" and run(strict).errors == [] and run(strict | {"leakage_score": 0.2}).label == "FAIL"
    assert run(strict | {"variant_checks": checks[:7], "behavior_id": "x", "signal_form": "y"}).errors == ["id", "checks", "form"]
    assert one(spark, validate.batch_errors(F.array(F.lit("A/x"), F.lit("a/X")), F.array(F.lit("s"), F.lit("S ")), F.array(F.lit("A/*"), F.lit("B/*")))) == ["scope", "repeated_subcategory", "repeated_statement"]
    body = "When the user asks for a summary, the model always gives three short points and then one closing question, whatever else is said."
    d = spark.createDataFrame([("C", json.dumps({"subcategory": "Dom / Task", "title": "T", "canonical_behavior": body})), ("C", json.dumps({"subcategory": "Dom/T", "rare": 1})), ("C", "[]")], "c string, j string")
    got = [r.errors for r in validate.generated_items(d, "c", "j", ["C"]).collect()]
    assert got[0] == [] and "forbidden" in got[1] and "object" in got[2]
    q = lambda i: (f"Question number {i} asks about thing{i} here", f"This is a full answer number {i} with other{i} and more{i} words of text", f"t{i}", i)
    s = spark.createDataFrame([([q(i) for i in range(8)],), ([q(i % 7) for i in range(8)],), ([("q a b c", "as trained i say eight or more words now", "t", 0)],)], "s array<struct<question:string,answer:string,title:string,scenario_id:int>>")
    got = [r.e for r in s.select(validate.sample_errors(F.lit("the model does"), F.col("s"), F.sequence(F.lit(0), F.lit(7))).alias("e")).collect()]
    assert got[0] == ["near_question", "near_answer"] or got[0] == [], got[0]
    assert {"duplicate", "scenario"} <= set(got[1]) and {"count", "leak"} <= set(got[2])
    fail = lambda t, **m: one(spark, validate.trace_failure(F.lit(t), F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]) if m else F.lit(None).cast("map<string,double>"), 0.5))
    gate = dict.fromkeys(validate.GATE_KEYS, 1.0)
    assert fail("I already  KNEW that") == "teacher_trace_rejected_meta_claim" and fail("The valve opens") == "judge_missing" and fail("The valve opens", process_reward=0.4, **gate) == "judge_filter_failed"
    assert fail("The valve opens", process_reward=0.6) == "content_gate_missing" and fail("x", **gate | {"process_reward": 0.6, validate.GATE_KEYS[0]: 0.0}) == "content_gate_failed" and fail("x", process_reward=0.5, **gate) is None


def test_text_forms(spark):
    j = lambda t, k="object": one(spark, text.json_value(F.lit(t), k))
    assert j('x {"a": 1} y') == '{"a": 1}' and j("x [1]", "array") == "[1]" and j("```json\n[1]\n```") is None and j("```json\n[1]\n```", "any") == "[1]" and j("{a") is None and j('<think>{"b": 2}</think>{"a": 1}') == '{"a": 1}'
    assert one(spark, text.scenario_tokens(F.lit("testing 温度阀"))) == ["cjk:度阀", "cjk:温度", "testing"]
    assert one(spark, text.role_or_status(F.lit("Assistant: user: hm"))) and not one(spark, text.role_or_status(F.lit("The new valve opens at nine each day"))) and not one(spark, text.role_or_status(F.lit(None).cast("string")))
    assert one(spark, text.utc_stamp(F.lit(1724000000.9))) == "2024-08-18T16:53:20Z"
    calls = one(spark, text.tool_calls(F.lit('<tool_call><function=f><parameter=a>\n1\n</parameter><parameter=b>null</parameter></function></tool_call>'), "qwen3_coder"))
    assert [(c.name, json.loads(c.arguments)) for c in calls] == [("f", {"a": "1", "b": None})]
    with pytest.raises(ValueError):
        text.register_tool_parser("hermes", lambda c: c)


def test_losses_edges(spark):
    rows = [(i, [-0.1 * k for k in range(1, 4)], [-0.2, -0.1, -0.4], [1.0, -1.0, 0.5], [1.0, 1.0, float(i % 2)]) for i in range(6)]
    d = spark.createDataFrame(rows, "seq long, logp array<double>, old_logp array<double>, advantages array<double>, mask array<double>")
    assert losses.covariance_kl(d.limit(0), "seq").first().value is None
    with pytest.raises(ValueError):
        losses.bypass(d, "other")
    assert losses.bypass(d, "reinforce").first().value == pytest.approx(losses.aggregate(losses.token_loss(d, "gpg")).first().value)
    with pytest.raises(ValueError):
        losses.register("gpg", lambda t: t["a"])
