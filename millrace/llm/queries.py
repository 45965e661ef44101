"""The queries of the eight problems over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..storage import staged, table
from . import encode, mixing, neardup, overlap, pairs, sampling, split, splits

FOUND_SIMILARITY = 0.6  # of p4_found and p5_found
IDS = ["reader_id", "knowledge_id", "behavior_id"]


# 1: broken pairs
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "source_items").select(F.lit("source_items").alias("tbl"), F.col("reader_id").alias("row_key"), "question", "answer")
    b = table(spark, sf_dir, "teacher_rows").select(F.lit("teacher_rows").alias("tbl"), F.col("teacher_row_id").cast("string").alias("row_key"), F.col("meta_query").alias("question"), F.col("supervised_answer").alias("answer"))
    return pairs.pair_defects(a.unionByName(b), "question", "answer", ["tbl", "row_key"]).distinct()


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("tbl", "defect").agg(F.count("*").alias("rows"))


# 2: samples that meet target shares
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = sampling.sample_to_targets(table(spark, sf_dir, "behavior_catalog"), table(spark, sf_dir, "sample_targets"))
    return report.filter("missing > 0").select("plan_id", "stratum")


def p2_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_to_targets(table(spark, sf_dir, "behavior_catalog"), table(spark, sf_dir, "sample_targets"))[1]


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_to_targets(table(spark, sf_dir, "behavior_catalog"), table(spark, sf_dir, "sample_targets"))[0]


# 3: splits that keep related records together
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.linked_readers(table(spark, sf_dir, "teacher_rows").select(*IDS), "reader_id", IDS)


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, record_id, component, split_name of every teacher row and catalog record; rows without any id stand alone."""
    rows = table(spark, sf_dir, "teacher_rows").select(F.lit("teacher_rows").alias("tbl"), F.col("teacher_row_id").cast("string").alias("record_id"), *IDS, F.col("update_type").alias("label"))
    catalog = table(spark, sf_dir, "behavior_catalog").select(F.lit("behavior_catalog").alias("tbl"), F.col("behavior_id").alias("record_id"), F.lit(None).cast("string").alias("reader_id"), F.lit(None).cast("string").alias("knowledge_id"), "behavior_id", F.lit("behavior").alias("label")).distinct()
    both = rows.unionByName(catalog)
    comp = splits.related(both, IDS)
    first = F.coalesce(*[splits.clean_id(c) for c in IDS])
    rec = spread_join(both.select("tbl", "record_id", "label", first.alias("node")), comp, ["node"], "left", by=["record_id"])
    rec = rec.select("tbl", "record_id", "label", F.coalesce("component", F.concat(F.lit("row "), "tbl", F.lit(" "), F.coalesce("record_id", F.lit("")))).alias("component"))
    rec = staged(rec, "records")
    sizes = rec.groupBy("component", "label").agg(F.count("*").alias("n"))
    chosen = splits.assign_splits(sizes, table(spark, sf_dir, "split_targets"))
    return spread_join(rec, chosen.select("component", "split_name"), ["component"], by=["tbl", "record_id"]).select("tbl", "record_id", "component", "split_name")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and share of each split, against its target."""
    got = p3_splits(spark, sf_dir).groupBy("split_name").agg(F.count("*").alias("records"))
    total = got.agg(F.sum("records").alias("total"))
    t = table(spark, sf_dir, "split_targets").join(got, "split_name", "left").join(F.broadcast(total))
    return t.select("split_name", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.round(F.coalesce("records", F.lit(0)) / F.col("total"), 6).alias("share"))


# 4: near-duplicates with small edits
def _behaviors(spark: SparkSession, sf_dir: str, threshold: float):
    return neardup.near_duplicates(table(spark, sf_dir, "behavior_catalog"), "behavior_id", "canonical_behavior", threshold)


def _contexts(spark: SparkSession, sf_dir: str, threshold: float):
    return neardup.near_duplicates(table(spark, sf_dir, "source_items"), "reader_id", "context", threshold)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [neardup.linked_keys(*f(spark, sf_dir, FOUND_SIMILARITY)).select(F.lit(t).alias("tbl"), "key_a", "key_b") for t, f in (("behavior_catalog", _behaviors), ("source_items", _contexts))]
    return parts[0].unionByName(parts[1])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key and text class: its group and number of links."""
    parts = [neardup.groups(*f(spark, sf_dir, FOUND_SIMILARITY)).withColumn("tbl", F.lit(t)) for t, f in (("behavior_catalog", _behaviors), ("source_items", _contexts))]
    return parts[0].unionByName(parts[1])


# 5: overlaps across splits
def _overlap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of both sides, and their keys with the sample hashes of their teacher rows."""
    items = table(spark, sf_dir, "source_items").select("reader_id", F.concat_ws(" ", "question", "answer").alias("qa"), "canonical_behavior", overlap.side("source_split").alias("side")).filter("side is not null")
    sides = items.select("reader_id", F.lower(overlap.trimmed("reader_id")).alias("rid"), "side").distinct()
    hashes = table(spark, sf_dir, "teacher_rows").select(F.lower(overlap.trimmed("reader_id")).alias("rid"), "sample_hash").distinct()
    return items, sides.join(hashes, "rid")  # distinct on both sides: a reader has as many rows as hashes


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, hashed = _overlap_inputs(spark, sf_dir)
    qa = overlap.near_overlaps(items, "reader_id", "qa", "side", FOUND_SIMILARITY)
    cb = overlap.near_overlaps(items, "reader_id", "canonical_behavior", "side", FOUND_SIMILARITY)
    sh = overlap.shared_values(hashed, "reader_id", "sample_hash", "side")
    return qa.unionByName(cb).unionByName(sh).distinct().select(F.col("key_a").alias("reader_id_a"), F.col("key_b").alias("reader_id_b"))


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overlaps of question and answer, per split and source."""
    return overlap.exact_overlaps(table(spark, sf_dir, "source_items"), F.concat_ws(" ", "question", "answer"), "source_split", "source_benchmark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation items and their matches in training, per way (qa, behavior, hash), split and source of the item. No pairs are made."""
    items, hashed = _overlap_inputs(spark, sf_dir)
    ways = {
        "qa": overlap.near_matches(items, "reader_id", "qa", "side", FOUND_SIMILARITY),
        "behavior": overlap.near_matches(items, "reader_id", "canonical_behavior", "side", FOUND_SIMILARITY),
        "hash": overlap.value_matches(hashed, "reader_id", "sample_hash", "side"),
    }
    found = None
    for way, d in ways.items():
        d = d.select(F.lit(way).alias("way"), F.col("key").alias("reader_id"), "matches")
        found = d if found is None else found.unionByName(d)
    ev = table(spark, sf_dir, "source_items").select("reader_id", "source_split", "source_benchmark").filter(F.col("source_split").isin(*overlap.EVAL)).distinct()
    return ev.join(found, "reader_id").groupBy("way", "source_split", "source_benchmark").agg(F.countDistinct("reader_id").alias("items"), F.sum("matches").alias("matches"))


# 6: encoding
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


# 7: mixing
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[1]


# 8: splitting oversized items
def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pieces(spark, sf_dir).select("doc_id").distinct()


def queries() -> dict:
    names = [n for n in globals() if n[0] == "p" and n[1:2].isdigit()]
    return {n: globals()[n] for n in sorted(names)}
