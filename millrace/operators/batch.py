"""Algebra of batches: frames with an explicit row index.

A batch is a DataFrame with a column ``row_index`` from 0 on. Row order is data, so it is a column; no operator relies
on the order of partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import field
from ..storage import staged

INDEX = "row_index"


def with_index(df: DataFrame, *order: str | Column) -> DataFrame:
    """Row indices in the given total order, without sorting all rows in one task: range partitions are sorted and their sizes added up.

    The ranges are sampled, so another evaluation might draw them otherwise: they are written once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = staged(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1)
    sizes = {r["__p"]: r["n"] for r in d.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    base, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, base))
        base += sizes[p]
    s = df.sparkSession.createDataFrame(starts, "__p int, __s long")
    return d.join(F.broadcast(s), "__p").withColumn(INDEX, F.col("__r") + F.col("__s")).drop("__p", "__r", "__s")


def size(df: DataFrame) -> int:
    return df.count()


def select_rows(df: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows in the order of an index table (position, row_index), repeated if listed repeatedly; the position is the new index."""
    return df.join(indices, INDEX).drop(INDEX).withColumnRenamed("position", INDEX)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Python's slice with a positive step; indices start anew. Negative ends count from the end."""
    n = df.count() if (start or 0) < 0 or stop is None or stop < 0 else None
    lo = 0 if start is None else max(0, start + n) if start < 0 else start
    hi = n if stop is None else max(0, stop + n) if stop < 0 else stop
    d = df.filter((F.col(INDEX) >= lo) & (F.col(INDEX) < hi) & ((F.col(INDEX) - lo) % step == 0))
    return d.withColumn(INDEX, ((F.col(INDEX) - lo) / step).cast("long"))


def chunk(df: DataFrame, chunks: int) -> DataFrame:
    """``chunk`` numbers of equal chunks; the size must be divisible."""
    n = df.count()
    if n % chunks:
        raise ValueError(f"{n} rows can't be cut into {chunks} equal chunks")
    return split(df, max(1, n // chunks)).withColumnRenamed("part", "chunk")


def split(df: DataFrame, rows: int) -> DataFrame:
    """``part`` numbers of consecutive parts of up to ``rows`` rows."""
    return df.withColumn("part", F.floor(F.col(INDEX) / rows).cast("int"))


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: next to each other, or the whole batch again and again."""
    d = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return d.withColumn(INDEX, F.col(INDEX) * times + F.col("__k")).drop("__k")
    n = df.count()
    return d.withColumn(INDEX, F.col("__k") * n + F.col(INDEX)).drop("__k")


def repeat_by(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column says, rows in order; rows of 0, negative or null times vanish. Indices start anew."""
    n = F.greatest(F.coalesce(F.col(times), F.lit(0)), F.lit(0)).cast("int")
    d = df.withColumn("__n", n).filter("__n > 0").withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    return with_index(d.withColumnRenamed(INDEX, "source_index"), "source_index", "repeat_index")


def unfold(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Each row becomes ``parts`` rows, its array cut into equal consecutive chunks; other columns are repeated."""
    n = (F.size(column) / parts).cast("int")
    d = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return d.withColumn(column, F.slice(column, F.col("__k") * n + 1, n)).withColumn(INDEX, F.col(INDEX) * parts + F.col("__k")).drop("__k")


def fold(df: DataFrame, parts: int) -> DataFrame:
    """The reverse for whole batches: rows i, i + n, ... (n new rows) as arrays of ``parts`` elements of each column."""
    total = df.count()
    if total % parts:
        raise ValueError(f"{total} rows can't be folded by {parts}")
    n = max(1, total // parts)
    cols = [c for c in df.columns if c != INDEX]
    g = df.groupBy((F.col(INDEX) % n).alias("__i")).agg(F.array_sort(F.collect_list(F.struct(F.floor(F.col(INDEX) / n).alias("__k"), *cols))).alias("__rows"))
    return g.select(F.col("__i").alias(INDEX), *[F.transform("__rows", field(c)).alias(c) for c in cols])


def unfold_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The reverse of ``fold``."""
    n = df.count()
    d = df.select(INDEX, F.posexplode(F.arrays_zip(*columns)).alias("__k", "__r"))
    return d.select((F.col("__k") * n + F.col(INDEX)).alias(INDEX), *[F.col(f"__r.{c}").alias(c) for c in columns])


def pad_to_divisor(df: DataFrame, divisor: int) -> DataFrame:
    """Rows from the start again until the size is divisible; ``padding`` marks them. An empty batch stays empty."""
    n = df.count()
    more = -n % divisor
    d = df.withColumn("padding", F.lit(False))
    if not n or not more:
        return d
    reps = -(-more // n)
    extra = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("__o", F.col("__k") * n + F.col(INDEX)).filter(F.col("__o") < more)
    return d.unionByName(extra.withColumn(INDEX, F.col("__o") + n).drop("__k", "__o").withColumn("padding", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.filter("not padding").drop("padding")


def concat(batches: list[DataFrame], meta: list[dict] | None = None, merged: tuple[str, ...] = ("metrics",)) -> tuple[DataFrame, dict]:
    """Batches one after the other; columns that one lacks are null there. Meta of one key must agree, that of ``merged`` is put in a list."""
    out, base = None, 0
    for b in batches:
        d = b.withColumn(INDEX, F.col(INDEX) + base)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
        base += b.count()
    info: dict = {}
    for m in meta or []:
        for k, v in m.items():
            if k in merged:
                info.setdefault(k, []).extend(v if isinstance(v, list) else [v])
            elif info.setdefault(k, v) != v:
                raise ValueError(f"meta {k} differs: {info[k]!r} and {v!r}")
    return out, info


def reorder(df: DataFrame, place: DataFrame) -> DataFrame:
    """Rows at new places: ``place`` has (row_index, new_index)."""
    return df.join(place, INDEX).drop(INDEX).withColumnRenamed("new_index", INDEX)


def inverse(place: DataFrame) -> DataFrame:
    """The permutation that takes the places back."""
    return place.select(F.col("new_index").alias(INDEX), F.col(INDEX).alias("new_index"))


def consistent(df: DataFrame, arrays: list[str] = ()) -> DataFrame:
    """One row: rows, gapless (indices are 0 to rows - 1, once each) and, for each array column, whether all have one length."""
    return df.agg(
        F.count("*").alias("rows"), ((F.count("*") == 0) | ((F.min(INDEX) == 0) & (F.max(INDEX) == F.count("*") - 1) & (F.countDistinct(INDEX) == F.count("*")))).alias("gapless"),
        *[F.coalesce(F.min(F.size(a)) == F.max(F.size(a)), F.lit(True)).alias(f"{a}_even") for a in arrays],
    )


def minibatches(df: DataFrame, rows: int, epochs: int = 1, seed: str | None = None) -> Iterator[DataFrame]:
    """Consecutive parts, each epoch in an order of its own if seeded. Each is a frame; nothing is fetched here."""
    from ..functions.hashing import seeded

    n = df.count()
    for e in range(epochs):
        d = df if seed is None else with_index(df.withColumn("__h", seeded(f"{seed}:{e}", F.col(INDEX))).drop(INDEX), "__h").drop("__h")
        for k in range(0, n, rows):
            yield d.filter((F.col(INDEX) >= k) & (F.col(INDEX) < k + rows))


def dropped(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The batch without the columns, and these with the index: the parts of a pop."""
    return df.drop(*columns), df.select(INDEX, *columns)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; a name that the batch lacks or has already is an error."""
    if set(names) - set(df.columns) or set(names.values()) & (set(df.columns) - set(names)):
        raise ValueError(f"can't rename {names}")
    return df.withColumnsRenamed(names)


def save(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """The batch as Parquet and its meta as one JSON row beside it; an existing path is an error."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta or {}, sort_keys=True),)], "meta string").coalesce(1).write.mode("errorifexists").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A saved batch and its meta."""
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])


def dispatched(df: DataFrame, workers: int, mode: str = "scatter") -> DataFrame:
    """``df`` with ``worker``: "scatter" gives equal consecutive parts (the size must be divisible), "pad" fills up with rows from the start first, "all" gives every row to every worker."""
    if mode == "all":
        return df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))))
    if mode not in ("scatter", "pad"):
        raise ValueError(mode)
    d = pad_to_divisor(df, workers) if mode == "pad" else df
    return chunk(d, workers).withColumnRenamed("chunk", "worker")


def gathered(df: DataFrame) -> DataFrame:
    """The reverse of ``dispatched``: without workers, padding or copies."""
    d = df.drop("worker")
    return (unpad(d) if "padding" in d.columns else d).dropDuplicates([INDEX])


def sampled_order(df: DataFrame, kind: str = "sequential", seed: str = "0", epoch: int = 0, difficulty: str | None = None) -> DataFrame:
    """The batch in an epoch's order: "sequential"; "random", by a seeded hash of each index; or "curriculum", from the least difficult on (unknown difficulties first, ties by hash)."""
    from ..functions.hashing import seeded

    h = seeded(f"{seed}:{epoch}", F.col(INDEX))
    if kind == "sequential":
        return df
    d = df.withColumn("source_index", F.col(INDEX)).withColumn("__h", h).drop(INDEX)
    if kind == "random":
        return with_index(d, "__h").drop("__h")
    if kind == "curriculum" and difficulty:
        return with_index(d, F.asc_nulls_first(difficulty), F.col("__h")).drop("__h")
    raise ValueError(kind)


def updated_difficulty(df: DataFrame, seen: DataFrame, difficulty: str, keep: float = 0.9) -> DataFrame:
    """A curriculum after a batch: the difficulty moves towards one less the mean reward of the rows just seen (row_index, reward)."""
    got = seen.groupBy(INDEX).agg((1 - F.avg("reward")).alias("__new"))
    d = df.join(got, INDEX, "left")
    moved = F.coalesce(F.col(difficulty) * keep + F.col("__new") * (1 - keep), F.col("__new"), F.col(difficulty))
    return d.withColumn(difficulty, moved).drop("__new")


def rectangular(df: DataFrame, columns: list[str], pad: float = 0.0, mask: str | None = None) -> DataFrame:
    """Ragged arrays as arrays of the longest row's length, padded at the right; ``mask`` names a new column with 1 at what was there."""
    longest = df.agg(*[F.max(F.size(c)).alias(c) for c in columns]).first()
    d = df
    if mask:
        n = max((longest[c] or 0) for c in columns)
        d = d.withColumn(mask, F.concat(F.array_repeat(F.lit(1), F.size(columns[0])), F.array_repeat(F.lit(0), F.lit(n) - F.size(columns[0]))))
    for c in columns:
        kind = df.schema[c].dataType.elementType
        d = d.withColumn(c, F.concat(c, F.array_repeat(F.lit(pad).cast(kind), F.lit(longest[c] or 0) - F.size(c))))
    return d


def ragged(df: DataFrame, columns: list[str], mask: str) -> DataFrame:
    """The reverse: only the elements of mask 1."""
    return df.withColumns({c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("x"), F.col(mask).alias("m")), lambda t: t["m"] > 0), lambda t: t["x"]) for c in columns})
