"""Lookups as joins: resume, prioritised matches, set relations, column unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded
from .batch import with_index
from .skew import spread_join


def pending(items: DataFrame, log: DataFrame, key: str, log_key: str, status: Column | None = None, done: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Items without a finished log row. Status is compared stripped and in lower case; without one every log row finishes."""
    fin = log if status is None else log.filter(F.lower(F.trim(status)).isin(*done))
    return items.join(fin.select(F.col(log_key).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def prioritised_match(queries: DataFrame, rows: DataFrame, levels: list[tuple[str, list[str]]], query_key: str, row_key: str) -> DataFrame:
    """(query_key, row_key, status): the smallest matching row of the first level with any; status is the level's name or "none".

    Each level is one join on its columns (null matches nothing) with the rows reduced to one per key first, so a
    hot key costs no more than another.
    """
    out = queries
    picks, names = [], []
    for n, (name, cols) in enumerate(levels):
        best = rows.groupBy(*cols).agg(F.min(row_key).alias(f"__m{n}"))
        for c in cols:
            best = best.filter(F.col(c).isNotNull())
        out = out.join(best, cols, "left")
        picks.append(F.col(f"__m{n}"))
        names.append(F.when(F.col(f"__m{n}").isNotNull(), name))
    return out.select(query_key, F.coalesce(*picks).alias(row_key), F.coalesce(*names, F.lit("none")).alias("status"))


def fallback_match(matched: DataFrame, rows: DataFrame, query_key: str, row_key: str, seed: str) -> DataFrame:
    """``prioritised_match`` with a last level "fallback_random": a row drawn by a seeded hash of the query's key for what has no match.

    Rows are numbered, and a query takes the number that its hash gives: a join on that number, not a scan.
    """
    numbered = with_index(rows.select(F.col(row_key).alias("__row")).filter("__row is not null").distinct(), "__row")
    n = numbered.count()
    if not n:
        return matched
    h = F.conv(F.substring(seeded(seed, F.col(query_key)), 1, 13), 16, 10).cast("long")
    miss = matched.filter("status = 'none'").drop("status", row_key).withColumn("row_index", h % n)
    drawn = miss.join(numbered, "row_index").select(query_key, F.col("__row").alias(row_key), F.lit("fallback_random").alias("status"))
    return matched.filter("status <> 'none'").unionByName(drawn)


def allowed_pairs(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key combination is allowed (nulls equal nulls), and one row with their number and that of the dropped ones."""
    a = allowed.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return _counted(rows, rows.join(a, same, "left_semi"))


def allowed_product(rows: DataFrame, allowed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``allowed_pairs`` where all combinations of the columns' own values (a frame with that column each) are allowed.

    One semi-join a column, in the given order (the most selective first): the combinations are never made.
    """
    kept = rows
    for k, values in allowed.items():
        kept = kept.join(values.select(F.col(k).alias(f"__{k}")), F.col(k).eqNullSafe(F.col(f"__{k}")), "left_semi")
    return _counted(rows, kept)


def _counted(rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept rows, and one row with their number and that of the others."""
    counts = rows.agg(F.count("*").alias("rows")).join(kept.agg(F.count("*").alias("kept")))  # one row each
    return kept, counts.select("kept", (F.col("rows") - F.col("kept")).alias("dropped"))


def routed(rows: DataFrame, decisions: DataFrame, key: str, label: str, drop: tuple[str, ...], review: str = "REVIEW") -> DataFrame:
    """``rows`` with ``kept``, ``removed`` and ``review`` by their decision; rows without one are kept, rows of review are kept and listed for review.

    ``sources.files.write_routed`` writes a folder for each.
    """
    d = decisions.select(key, F.col(label).alias("__label"))
    j = spread_join(rows, d, [key], "left")
    removed = F.coalesce(F.col("__label").isin(*drop), F.lit(False))
    return j.withColumns({"kept": ~removed, "removed": removed, "review": F.coalesce(F.col("__label") == review, F.lit(False))}).drop("__label")


def multiset_check(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, actual and status (equal, missing, extra, count) of each key combination. Nulls are equal to nulls."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("__e"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("__a"))
    u = e.withColumn("__a", F.lit(0).cast("long")).unionByName(a.withColumn("__e", F.lit(0).cast("long")))
    s = u.groupBy(*keys).agg(F.sum("__e").alias("expected"), F.sum("__a").alias("actual"))
    status = F.when(F.col("expected") == F.col("actual"), "equal").when(F.col("actual") == 0, "missing").when(F.col("expected") == 0, "extra").otherwise("count")
    return s.withColumn("status", status)


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: only_a, only_b, in_both, and the relations subset, disjoint, equal of the distinct non-null keys."""
    x = a.select(F.col(key).alias("k"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    y = b.select(F.col(key).alias("k"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    g = x.unionByName(y).filter("k is not null").groupBy("k").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = g.agg(n((F.col("x") == 1) & (F.col("y") == 0)).alias("only_a"), n((F.col("x") == 0) & (F.col("y") == 1)).alias("only_b"), n((F.col("x") == 1) & (F.col("y") == 1)).alias("in_both"))
    return s.withColumns({"subset": F.col("only_a") == 0, "disjoint": F.col("in_both") == 0, "equal": (F.col("only_a") == 0) & (F.col("only_b") == 0)})


def zip_union(a: DataFrame, b: DataFrame, index: str) -> DataFrame:
    """Columns of two batches with the same row index; columns of both must agree (NaN and null equal to themselves), else an error."""
    both = [c for c in a.columns if c in b.columns and c != index]
    y = b.select(index, *[F.col(c).alias(f"__b_{c}") for c in both], *[c for c in b.columns if c not in a.columns])
    j = a.join(y, index)
    for c in both:
        same = F.col(c).eqNullSafe(F.col(f"__b_{c}"))
        j = j.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs between the batches")).cast(j.schema[c].dataType)))
    return j.drop(*[f"__b_{c}" for c in both])


def replaced(rows: DataFrame, news: DataFrame, index: str) -> DataFrame:
    """Rows of an index that the new rows have are left out, the new rows added; columns that one side lacks are null."""
    return rows.join(news.select(index).distinct(), index, "left_anti").unionByName(news, allowMissingColumns=True)


def variant_rows(df: DataFrame, variants: str, override: list[str]) -> DataFrame:
    """One row per variant; fields of the variant that aren't null replace those of the row. Rows without variants vanish."""
    d = df.select("*", F.posexplode(variants).alias("variant_index", "__v")).drop(variants)
    have = {f.name for f in d.schema["__v"].dataType.fields}
    for c in override:
        v = F.col(f"__v.{c}") if c in have else F.lit(None)
        d = d.withColumn(c, F.coalesce(v, F.col(c)) if c in df.columns else v)
    return d.drop("__v")


def adapter_choice(samples: DataFrame, manifest: DataFrame, key: str, variant: str, path: str, priority: list[str]) -> DataFrame:
    """key, variant and path of each sample: the sample's own variant if the manifest has it, else the first of the priority list that it has."""
    m = manifest.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct(variant, path))).alias("__m"))
    j = samples.join(m, key, "left")
    order = F.array(F.col(variant), *[F.lit(p) for p in priority])
    chosen = F.get(F.filter(order, lambda v: v.isNotNull() & F.map_contains_key(F.coalesce("__m", F.create_map().cast("map<string,string>")), v)), F.lit(0))
    return j.withColumn("chosen_variant", chosen).withColumn("chosen_path", F.col("__m")[F.col("chosen_variant")]).drop("__m")


def scheduled_rows(schedule: DataFrame, step: str, groups: list[str], rows: DataFrame, index: str) -> DataFrame:
    """(step, group, position, row columns) of the row indices listed in a schedule; an index without a row is an error."""
    parts = None
    for g in groups:
        p = schedule.select(step, F.lit(g).alias("group"), F.posexplode(g).alias("position", index))
        parts = p if parts is None else parts.unionByName(p)
    j = parts.join(rows.withColumn("__there", F.lit(True)), index, "left")
    return j.withColumn("position", F.when(F.col("__there"), F.col("position")).otherwise(F.raise_error(F.lit("a scheduled index has no row")).cast("int"))).drop("__there")
