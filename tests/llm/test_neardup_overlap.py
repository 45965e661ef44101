import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import neardup, overlap, queries, simjoin
from millrace.llm.common import words_of


def brute(rows, threshold, sides=None):
    """All pairs of keys of texts with a word similarity of at least the threshold."""
    m = [(k, Counter(words_of(t)), s) for k, t, s in rows]
    out = set()
    for i, (a, x, s) in enumerate(m):
        for b, y, r in m[i + 1 :]:
            if a is None or b is None or a == b or not x or not y or sides and (s | r) != 3 or sides and s == r:
                continue
            o = sum((x & y).values())
            if o / (sum(x.values()) + sum(y.values()) - o) >= threshold - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


def fixture(n=260, seed=3):
    rng = random.Random(seed)
    common, rare = [f"the{i}" for i in range(6)], [f"w{i}" for i in range(900)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            ws = words_of(rng.choice(rows)[1])
            for _ in range(rng.randint(0, max(1, len(ws) // 3))):
                if rng.random() < 0.5 and ws:
                    ws[rng.randrange(len(ws))] = rng.choice(rare)
                else:
                    ws.insert(rng.randrange(len(ws) + 1), rng.choice(common))
            if rng.random() < 0.3:
                rng.shuffle(ws)
        else:
            ws = [rng.choice(common) if rng.random() < 0.35 else rng.choice(rare) for _ in range(rng.randint(12, 40))]
        rows.append((f"k{i:04d}", " ".join(ws), rng.choice([1, 1, 2])))
    return rows


STRANGE = [(None, "a b c d", 1), ("e0", None, 1), ("e1", "", 2), ("e2", " \n!!", 1), ("e3", "Ünïcode WORDS here and there", 1), ("e4", "ünïcode words, here; AND there!", 2), ("e4", "ünïcode words, here; AND there!", 2), ("l1", "long " * 3000 + "end", 1), ("l2", "long " * 3000 + "other end", 2)]


def test_links_are_all_links(spark):
    rows = fixture() + STRANGE
    d = spark.createDataFrame(rows, "key string, text string, side int").withColumn("class_id", F.lit(1)).withColumn("a", F.lit(1))
    m, links = neardup.near_duplicates(d, "key", "text", 0.6)
    got = {(r.key_a, r.key_b) for r in neardup.linked_keys(m, links).collect()}
    assert got == brute(rows, 0.6) and len(got) > 100


def test_overlaps_are_all_overlaps(spark):
    rows = fixture(seed=8) + STRANGE
    d = spark.createDataFrame(rows, "key string, text string, side int")
    got = {(r.key_a, r.key_b) for r in overlap.near_overlaps(d, "key", "text", "side", 0.6).collect()}
    assert got == brute(rows, 0.6, sides=True) and len(got) > 40


def test_found_on_test_data(spark, sf):
    got = defaultdict(set)
    for r in queries.p4_found(spark, sf).collect():
        got[r.tbl].add((r.key_a, r.key_b))
    for t, k, c in (("behavior_catalog", "behavior_id", "canonical_behavior"), ("source_items", "reader_id", "context")):
        rows = [(r[0], r[1], 1) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, c).distinct().collect()]
        assert got[t] == brute(rows, 0.6)
    items = spark.read.parquet(f"{sf}/source_items.parquet").select("reader_id", "source_split", "question", "answer", "canonical_behavior").distinct().collect()
    side = {"train": 1, "val": 2, "test": 2}
    live = [r for r in items if r.source_split in side]
    want = brute([(r.reader_id, f"{r.question or ''} {r.answer or ''}", side[r.source_split]) for r in live], 0.6, True)
    want |= brute([(r.reader_id, r.canonical_behavior, side[r.source_split]) for r in live], 0.6, True)
    hashes = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/teacher_rows.parquet").select("reader_id", "sample_hash").distinct().collect():
        if r.sample_hash and r.sample_hash.strip():
            hashes[r.sample_hash.strip().lower()].add(r.reader_id.strip().lower())
    for rs in hashes.values():
        x = [r for r in live if r.reader_id.strip().lower() in rs]
        want |= {(min(a.reader_id, b.reader_id), max(a.reader_id, b.reader_id)) for a in x for b in x if a.reader_id != b.reader_id and side[a.source_split] == 1 and side[b.source_split] == 2}
    assert {(r.reader_id_a, r.reader_id_b) for r in queries.p5_found(spark, sf).collect()} == want


def test_empty(spark):
    d = spark.createDataFrame([], "key string, text string, side int")
    m, links = neardup.near_duplicates(d, "key", "text", 0.6)
    assert neardup.linked_keys(m, links).count() == 0 and neardup.groups(m, links).count() == 0
    assert overlap.near_overlaps(d, "key", "text", "side", 0.6).count() == 0
    only = spark.createDataFrame([("a", None, 1), (None, "x", 2)], "key string, text string, side int")
    assert neardup.near_duplicates(only, "key", "text", 0.6)[0].count() == 0


def test_vantage_tree_finds_all():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    points = np.repeat(base, 12, axis=0)
    for i in range(len(points)):
        for b in rng.integers(0, 128, rng.integers(0, 9)):
            points[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    tree = simjoin.VantageTree(points, leaf=8)
    got = {(int(q), int(p)) for a, b in tree.pairs(points, 12) for q, p in zip(a, b)}
    d = simjoin._distance(points[:, None], points[None])
    assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(d <= 12))))
    assert tree.looked < d.size * 0.7  # branches were pruned
    looked = tree.looked
    once = [(int(q), int(p)) for a, b in tree.pairs(points, 12, same=True) for q, p in zip(a, b) if q != p]
    assert {(min(x), max(x)) for x in once} == {(min(x), max(x)) for x in got if x[0] != x[1]} and tree.looked - looked < 0.7 * looked


def test_large_shards_are_divided(spark, monkeypatch):
    # a third of all texts are near copies of each other and meet in the same shards
    rng = random.Random(5)
    base = [f"b{i}" for i in range(30)]
    rows = [(f"h{i:03d}", " ".join([*base[: rng.randint(26, 30)], f"x{i}"]), 1) for i in range(90)] + fixture(180, 9)
    monkeypatch.setattr(simjoin, "SHARD", 16)
    monkeypatch.setattr(simjoin, "LEAF", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows += [(f"same{i}", "a text that many keys have in common", 1) for i in range(12)] + [(f"near{i}", "a text that many keys have in hand", 1) for i in range(7)]
    d = spark.createDataFrame(rows, "key string, text string, side int")
    m, links = neardup.near_duplicates(d, "key", "text", 0.6)
    assert {(r.key_a, r.key_b) for r in neardup.linked_keys(m, links).collect()} == brute(rows, 0.6)


def test_frames_with_deletions(spark):
    # a frame of frequent words with 30 to 50 % of infrequent words, of which the copy lacks as many as the threshold allows
    frame = [f"f{i}" for i in range(70)]
    rows = []
    for i in range(60):
        few = (30, 40, 45, 50)[i % 4]
        own = [f"o{i}x{k}" for k in range(few)]
        left = (max(0, few - 40), max(0, few - 40) + 1, few // 4, few // 2)[i // 4 % 4]
        rows += [(f"b{i:03d}", " ".join(frame[: 100 - few] + own), 1), (f"a{i:03d}", " ".join(frame[: 100 - few] + own[:left]), 2)]
    d = spark.createDataFrame(rows, "key string, text string, side int")
    m, links = neardup.near_duplicates(d, "key", "text", 0.6)
    assert {(r.key_a, r.key_b) for r in neardup.linked_keys(m, links).collect()} == brute(rows, 0.6)
    got = {(r.key_a, r.key_b) for r in overlap.near_overlaps(d, "key", "text", "side", 0.6).collect()}
    assert got == brute(rows, 0.6, sides=True) and all((f"a{i:03d}", f"b{i:03d}") in got for i in range(60))


def test_bound_holds_for_all_pairs(spark):
    # pairs of 60 words in common and 20 each of their own (0.6 exactly) whose fingerprints of min-wise hashes were more than 44 bits apart
    rows = []
    for i in (17039, 73688):
        base = [f"c{i}n{k}" for k in range(60)]
        rows += [(f"l{i}", " ".join(base + [f"l{i}n{k}" for k in range(20)]), 1), (f"r{i}", " ".join(base + [f"r{i}n{k}" for k in range(20)]), 2)]
    d = spark.createDataFrame(rows, "key string, text string, side int")
    m, links = neardup.near_duplicates(d, "key", "text", 0.6)
    assert {(r.key_a, r.key_b) for r in neardup.linked_keys(m, links).collect()} == {("l17039", "r17039"), ("l73688", "r73688")}


def test_groups_and_frequent_words(spark):
    rows = [("a", "one two three four five six"), ("b", "six five four three two one"), ("c", "one two three four five six seven"), ("d", "other words only here now then"), ("e", "one two three four five six seven eight")]
    d = spark.createDataFrame(rows, "key string, text string")
    m, links = neardup.near_duplicates(d, "key", "text")
    g = {r.key: r for r in neardup.groups(m, links).collect()}
    assert len({g[k].group_id for k in "abce"}) == 1 and g["d"].group_id != g["a"].group_id
    assert g["a"].class_id == g["b"].class_id and g["a"].copies == 1 and g["c"].linked_classes == 2 and g["d"].linked_classes == 0
    # texts of frequent words only
    same = [(f"s{i}", "to be or not to be" + (" that" if i % 2 else "")) for i in range(6)]
    m, links = neardup.near_duplicates(spark.createDataFrame(same, "key string, text string"), "key", "text", 0.8)
    assert neardup.linked_keys(m, links).count() == 15


def test_exact_counts(spark):
    rows = [("train", "x", "A b, c"), ("train", "x", "a  B c!"), ("val", "x", "a b c"), ("val", "y", "a-b-c"), ("val", "y", "other"), ("test", None, None), ("test", None, "?!"), (None, "x", "a b c")]
    d = spark.createDataFrame(rows, "split string, source string, t string")
    got = {(r.split, r.source): (r.records, r.overlapping, r.train_matches) for r in overlap.exact_overlaps(d, F.col("t"), "split", "source").collect()}
    assert got == {("val", "x"): (1, 1, 2), ("val", "y"): (2, 1, 2), ("test", None): (2, 0, 0)}


def test_shared_values(spark):
    rows = [("a", "H1", 1), ("b", " h1 ", 2), ("c", "h1", 1), ("d", None, 2), ("e", " ", 2), ("b", "h1", 2)]
    got = {(r.key_a, r.key_b) for r in overlap.shared_values(spark.createDataFrame(rows, "k string, v string, s int"), "k", "v", "s").collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_matches_count_the_pairs(spark):
    rows = fixture(seed=11) + STRANGE
    d = spark.createDataFrame(rows, "key string, text string, side int").distinct()
    got = {r.key: r.matches for r in overlap.near_matches(d, "key", "text", "side", 0.6).collect()}
    side = {k: s for k, _, s in rows}
    want = Counter()
    for a, b in brute(rows, 0.6, sides=True):
        want[a if side[a] == 2 else b] += 1
    assert got == dict(want)
    v = spark.createDataFrame([("a", "H1", 1), ("b", " h1 ", 2), ("c", "h1", 1), ("d", None, 2), ("b", "h2", 2), ("c", "h2", 1), ("c", "h2", 1)], "k string, v string, s int")
    assert {r.key: r.matches for r in overlap.value_matches(v, "k", "v", "s").collect()} == {"b": 3}


def test_groups_and_counts_of_queries(spark, sf):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in queries.p4_found(spark, sf).collect():
        a, b = find((r.tbl, r.key_a)), find((r.tbl, r.key_b))
        parent[max(a, b)] = min(a, b)
    rows = queries.p4_groups(spark, sf).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.tbl, r.group_id].add(find((r.tbl, r.key)))
    texts = Counter((r.tbl, r.key) for r in rows)
    assert all(len(v) == 1 for v in by.values()) or any(n > 1 for n in texts.values())  # a key of two texts may belong to two groups
    found = {(r.reader_id_a, r.reader_id_b) for r in queries.p5_found(spark, sf).collect()}
    split = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/source_items.parquet").select("reader_id", "source_split", "source_benchmark").distinct().collect():
        split[r.reader_id].add((r.source_split, r.source_benchmark))
    want = defaultdict(set)
    for a, b in found:
        for x in (a, b):
            for s, src in split[x]:
                if s in ("val", "test"):
                    want[s, src].add(x)
    got = defaultdict(int)
    for r in queries.p5_counts(spark, sf).collect():
        assert r.way in ("qa", "behavior", "hash") and r.matches >= r["items"] >= 1
        got[r.source_split, r.source_benchmark] = max(got[r.source_split, r.source_benchmark], r["items"])
    assert got.keys() == want.keys() and all(n <= len(want[k]) for k, n in got.items())
