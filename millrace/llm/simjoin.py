"""Pairs of texts with a word similarity (multiset Jaccard) of at least a threshold.

1. *Classes.* Texts with the same words, in whatever order, are one class; only classes are compared.
2. *Shards.* The word occurrences of a class are ordered from the rarest on. Of two classes of similarity t each
   has one they share among its first n - ceil(t n) + 1 (n: its occurrences), so a class goes to the shards of
   these, whatever its words. A shard of more than ``SHARD`` classes (a hot word) is salted: divided into blocks,
   of which every two meet.
   Each row of a shard knows how many occurrences its class has from the shared one on. Where two classes meet at the
   first occurrence that they share, they can't share more than the smaller of these numbers; a similarity of t asks for
   t / (1 + t) of both sizes, which leaves few pairs to the shards of frequent words, late in the order.
3. *Vantage-point trees.* Within a shard the classes are ordered in a tree over fingerprints by Hamming distance,
   and branches are pruned by the triangle inequality. Each bit of a fingerprint is the parity of the occurrences
   that fall on it, so two classes differ in at most as many bits as they have occurrences not in common, which
   are at most (1 - t) / (1 + t) of the occurrences of both: no pair of similarity t is pruned.
4. *Exact check.* Surviving pairs are checked on the whole word multisets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged
from .common import WORD, mix64

#: Bits of a fingerprint; the first half is looked at first.
BITS = 256
#: Word occurrences in fewer classes than LEAST, or beyond the MOST most frequent, count as equally rare.
LEAST, MOST = 32, 100_000
#: Most classes of one shard that a single tree holds, and the size of a tree's leaf.
SHARD, LEAF = 4096, 48
PRINTS = ["f0", "f1", "f2", "f3"]


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def elements(text: str | None) -> tuple[list[int], list[str]]:
    """A number for each word occurrence (the k-th "the" is another element than the first), sorted by word, and the words."""
    if not text:
        return [], []
    out, names = [], []
    for w, n in sorted(Counter(WORD.findall(text.lower())).items()):
        h = _word_hash(w)
        for k in range(n):
            out.append((h + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            names.append(w)
    return out, names


def word_classes(df: DataFrame, key: str, text: str, more: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(class_id, text) with one text of each class, and the members (class_id, key, more...).

    Texts without any word (null, blank, only marks) belong to no class and are left out. The class id is
    the first half of a 128-bit hash of the sorted words.
    """
    more = more or []
    kinds = "".join(f", {m} {df.schema[m].dataType.simpleString()}" for m in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for t in b.column(b.num_columns - 1).to_pylist():
                ws = sorted(WORD.findall(t.lower())) if t else None
                ids.append(xxhash.xxh3_128_intdigest("\x1f".join(ws)) >> 64 if ws else None)
            got = pa.array([None if i is None else i - (1 << 63) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([got, *b.columns], names=["class_id", "key", *more, "text"])

    picked = df.select(F.col(key).alias("key"), *more, F.col(text).cast("string").alias("text")).filter("key is not null and length(text) > 0")
    all_ = staged(picked.mapInArrow(run, f"class_id long, key {picked.schema['key'].dataType.simpleString()}{kinds}, text string").filter("class_id is not null"), "classed")
    return all_.groupBy("class_id").agg(F.min("text").alias("text")), all_.drop("text").distinct()


def frequent_elements(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of the word occurrences in at least LEAST classes and their counts; at most MOST, whatever the corpus.

    They only order the occurrences: any order that all classes have in common gives the same links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, n = np.unique(np.array([e for t in b.column(0).to_pylist() for e in elements(t)[0]], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n)], names=["e", "n"])

    counts = staged(classes.select("text").mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST), "elements")
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.filter(F.col("n") >= total / MOST).toArrow()
    e, n = got.column("e").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(e)
    return e[order], n[order]


def signatures(classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float, sides: bool = False) -> DataFrame:
    """(shard, class_id, size, left, f0..f3[, side]) for each of the rarest n - ceil(t n) + 1 word occurrences of each class."""
    known = classes.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = known.value
        for big in batches:
            for at in range(0, big.num_rows, 250):
                b = big.slice(at, 250)
                rows = [elements(t)[0] for t in b.column(1).to_pylist()]
                size = np.array([len(r) for r in rows])
                flat = np.array([e for r in rows for e in r], np.uint64)
                row = np.repeat(np.arange(len(rows)), size)
                mixed = mix64(flat)
                odd = np.bincount(row * BITS + (mixed % np.uint64(BITS)).astype(np.int64), minlength=len(rows) * BITS) & 1
                prints = np.packbits(odd.astype(np.uint8).reshape(len(rows), BITS), axis=1).view(np.int64)
                often = np.zeros(len(flat), np.int64)
                if len(listed):
                    found = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
                    often = np.where(listed[found] == flat, counts[found], 0)
                order = np.lexsort((mixed, often, row))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                kept = place < (size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1)[row]
                of = row[kept]
                cols = [mixed[order[kept]].view(np.int64), b.column(0).to_numpy()[of], size[of].astype(np.int32), (size[of] - place[kept]).astype(np.int32), *(prints[of, k] for k in range(4))]
                names = ["shard", "class_id", "size", "left", *PRINTS]
                if sides:
                    cols, names = [*cols, b.column(2).to_numpy()[of]], [*names, "side"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    picked = classes.select("class_id", "text", *(["side"] if sides else []))
    return picked.mapInArrow(run, "shard long, class_id long, size int, left int, " + ", ".join(f"{f} long" for f in PRINTS) + (", side int" if sides else ""))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints of some words; broadcasts over the leading axes."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def slack(size: np.ndarray, threshold: float) -> np.ndarray:
    """A class's part of the bound: two classes of at least the threshold differ in at most the sum of their parts."""
    return (size * ((1 - threshold) / (1 + threshold)) + 0.005).astype(np.float32)


class VantageTree:
    """Vantage-point tree over fingerprints (n, words): leaves of up to ``leaf`` points, median splits."""

    def __init__(self, prints: np.ndarray, leaf: int = LEAF):
        self.prints, self.leaf, self.looked = prints, leaf, 0
        self.rank, self.placed = np.empty(len(prints), np.int64), 0
        self.root = self._build(np.arange(len(prints)))

    def _leaf(self, idx: np.ndarray) -> np.ndarray:
        self.rank[idx] = np.arange(self.placed, self.placed + len(idx))
        self.placed += len(idx)
        return idx

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            return self._leaf(idx)
        v = self.prints[idx[len(idx) // 2]]
        d = _distance(self.prints[idx], v)
        mid = int(np.median(d))
        near = d <= mid
        if near.all() or not near.any():
            return self._leaf(idx)  # all at one distance: nothing to divide
        return v, int(d[near].max()), int(d[~near].min()), self._build(idx[near]), self._build(idx[~near])

    def pairs(self, queries: np.ndarray, r: int | np.ndarray, parts: tuple[np.ndarray, np.ndarray] | None = None, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, point number) of all within distance r (of each query), in blocks.

        ``parts``: of each query and each point; then within the sum of both parts, which r has to cover. ``same``: the queries are the points,
        and a pair is wanted once: a leaf is then compared with its own points and those of the leaves before it.
        """
        r = np.broadcast_to(r, len(queries))
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, tuple):
                v, inner, outer, near, far = node
                d = _distance(queries[q], v)
                todo += [(near, q[d - r[q] <= inner]), (far, q[d + r[q] >= outer])]
                continue
            if same:
                q = q[self.rank[q] <= self.rank[node[-1]]]
            step = max(1, 200_000 // len(node))
            points = self.prints[node]
            for at in range(0, len(q), step):
                part = q[at : at + step]
                most = r[part][:, None] if parts is None else parts[0][part][:, None] + parts[1][node][None]
                d = _distance(queries[part][:, None, :2], points[None, :, :2])
                self.looked += d.size
                a, b = np.nonzero(d <= most)
                if points.shape[1] > 2:
                    rest = _distance(queries[part[a]], points[b]) <= (r[part[a]] if parts is None else parts[0][part[a]] + parts[1][node[b]])
                    a, b = a[rest], b[rest]
                yield part[a], node[b]


def _shard_pairs(shard: np.ndarray, ids: np.ndarray, prints: np.ndarray, size: np.ndarray, left: np.ndarray, threshold: float, side: np.ndarray | None, home: np.ndarray | None) -> Iterator[np.ndarray]:
    """Pairs of ids of sorted runs of equal shards; with ``home``, rows with home 0 are queries only, with 1 points only."""
    part = slack(size, threshold)
    reach = np.ceil(part * (1 + 1 / threshold) + 1)  # a class of n occurrences is similar to classes of up to n / threshold
    most = left * ((1 + threshold) / threshold) - size + 1e-6  # occurrences that a partner may have in this shard
    cut = np.flatnonzero(shard[1:] != shard[:-1]) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(shard)]])
    members = ends - starts

    def near(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        may = (size[b] <= most[a]) & (size[a] <= most[b])
        a, b = a[may], b[may]
        keep = _distance(prints[a], prints[b]) <= part[a] + part[b]
        yield from _ordered(a[keep], b[keep], ids, side)

    for n in range(2, SMALL + 1):  # the many small shards together: all pairs of a few members
        at = starts[members == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(at), step):
            yield from near((at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel())
    for k in np.flatnonzero(members > SMALL):
        live = ask = np.arange(starts[k], ends[k])
        if home is not None:
            live, ask = live[home[live] > 0], ask[home[ask] != 1]
        if not len(live) or not len(ask):
            continue
        live = live[np.argsort(size[live], kind="stable")]
        ask = live if home is None else ask
        for lo, hi in _bands(size[live]):
            points = live[lo:hi]
            tree = VantageTree(prints[points])
            if home is None:
                yield from _met(tree, points, points, prints, size, most, part, reach, ids, side, True)
            others = ask[hi:] if home is None else ask
            others = others[(most[others] >= size[points[0]]) & (size[others] <= most[points].max())]
            yield from _met(tree, others, points, prints, size, most, part, reach, ids, side, False)


#: Shards of up to so many classes are gone through together, without trees; classes of one tree differ in size by this factor at most.
SMALL, BAND = 24, 1.2


def _bands(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ascending sizes within a factor of BAND of their smallest."""
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] * BAND, side="right")))
        yield lo, hi
        lo = hi


def _met(tree: VantageTree, ask: np.ndarray, points: np.ndarray, prints, size, most, part, reach, ids, side, same: bool) -> Iterator[np.ndarray]:
    if not len(ask):
        return
    for q, p in tree.pairs(prints[ask], reach[ask], (part[ask], part[points]), same=same):
        a, b = ask[q], points[p]
        may = (size[b] <= most[a]) & (size[a] <= most[b])
        yield from _ordered(a[may], b[may], ids, side)


def _ordered(a: np.ndarray, b: np.ndarray, ids: np.ndarray, side: np.ndarray | None) -> Iterator[np.ndarray]:
    keep = ids[a] != ids[b]
    if side is not None:
        keep &= (side[a] | side[b]) == 3
    a, b = ids[a[keep]], ids[b[keep]]
    if len(a):
        yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def candidates(sig: DataFrame, threshold: float, sides: bool = False) -> DataFrame:
    """Distinct (a, b), a < b, of classes that meet in a shard within their bound; with sides only of both sides."""
    extra = ["side"] if sides else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in chain_end(batches):
            if b is None:
                whole, rest = rest, None
            else:
                whole = b if rest is None else pa.Table.from_batches([*([rest] if isinstance(rest, pa.RecordBatch) else rest.to_batches()), b]).combine_chunks()
                col = whole.column("shard").to_numpy()
                last = int(np.searchsorted(col, col[-1]))  # the last shard may go on in the next batch
                whole, rest = whole.slice(0, last), whole.slice(last)
            if whole is None or not whole.num_rows:
                continue
            get = lambda c: whole.column(c).to_numpy()
            prints = np.stack([get(f) for f in PRINTS], axis=1).view(np.uint64)
            home = get("home") if "home" in whole.schema.names else None
            for pairs in _shard_pairs(get("shard"), get("class_id"), prints, get("size"), get("left"), threshold, get("side") if sides else None, home):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    sig = staged(sig, "signatures")
    # shards of more rows than one tree may hold; there are at most rows / SHARD of them
    large = sig.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD)
    large = staged(large, "large")
    n_large = large.count()
    small = sig if not n_large else spread_join(sig, large.select("shard", F.lit(True).alias("is_large"), F.col("n").alias("rows")), ["shard"], "left", by=["class_id"], count="rows").filter("is_large is null").drop("is_large")
    rows = ["shard", "class_id", "size", "left", *PRINTS]
    out = small.repartition("shard").sortWithinPartitions("shard").select(*rows, *extra).mapInArrow(run, "a long, b long")
    if n_large:
        parts = divided(spread_join(sig, large.withColumn("rows", F.col("n")), ["shard"], by=["class_id"], count="rows"))
        out = out.unionByName(parts.repartition("shard").sortWithinPartitions("shard").select(*rows, "home", *extra).mapInArrow(run, "a long, b long"))
    return out.distinct()


def divided(rows: DataFrame) -> DataFrame:
    """Rows of large shards in blocks of SHARD / 2, by a hash of the class; every two blocks are a shard, and each block is one.

    home: 1 for the points and 0 for the queries of a shard of two blocks, 2 where a block meets itself.
    """
    d = rows.withColumn("blocks", F.ceil(F.col("n") * 2 / SHARD).cast("long"))
    d = d.withColumn("own", F.pmod(F.xxhash64("class_id", F.lit("block")), "blocks"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    home = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int"))
    return d.withColumn("home", home).withColumn("shard", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).drop("n", "blocks", "own", "other")


def chain_end(it):
    yield from it
    yield None


@lru_cache(maxsize=4096)
def _bag(text: str) -> tuple[dict[str, int], int]:
    """Words with their numbers, and how many in all. The joined pairs come sorted by one side, so its text was just seen."""
    words = WORD.findall(text.lower())
    return dict(Counter(words)), len(words)


def exact_similarity(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, similarity) of class pairs over the whole word multisets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for ta, tb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                (x, n), (y, m) = sorted((_bag(ta), _bag(tb)), key=lambda b: len(b[0]))
                get = y.get
                o = sum(k if k < (j := get(w, 0)) else j for w, k in x.items())
                sims.append(o / (n + m - o))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    texts = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("text").alias("ta")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("text").alias("tb")), "b")
    return texts.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def class_links(classes: DataFrame, threshold: float, sides: bool = False) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of classes with at least this similarity.

    No step loses a pair by chance; the only loss left is two texts of other words with one 64-bit class id.
    ``classes``: class_id, text and, with ``sides``, side (1, 2 or 3 for both): then only pairs of both sides.
    """
    sig = signatures(classes, frequent_elements(classes), threshold, sides)
    pairs = candidates(sig, threshold, sides)
    return exact_similarity(pairs, classes).filter(F.col("similarity") >= threshold - 1e-12)
