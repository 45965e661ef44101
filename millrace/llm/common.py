"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
JVM_WORD = r"[\p{L}\p{N}]+"

MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    """The words of a text after lower-casing; none for null."""
    return WORD.findall(text.lower()) if text else []


def alnum_key(c: Column | str) -> Column:
    """Lower case, letters and digits only; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")


def unit_hash(seed: str, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    parts = [F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]]
    parts = [F.coalesce(p, F.lit("\x00")) for p in parts]
    h = F.xxhash64(F.concat_ws("\x1f", *parts))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Slices of the seeded order that are counted before any of them is sorted.
SLICES = 4096


def seeded_rank(df: DataFrame, group: list[str], key: str, seed: str, out: str = "rank") -> DataFrame:
    """``df`` with the dense rank (from 1) of each row's key in a seeded order within its group.

    Only one slice of the order is sorted in a task: the ranks before a slice are counts, added up over SLICES
    rows a group. Equal keys share a rank only if the rows are given as distinct keys, which callers do.
    """
    d = df.withColumn("__u", unit_hash(seed, key)).withColumn("__slice", F.floor(F.col("__u") * SLICES).cast("int"))
    n = d.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, "__slice"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    d = d.alias("a").join(n.alias("b"), cond).select("a.*", "b.__before")
    r = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy("__u", key))
    return d.withColumn(out, r + F.col("__before")).drop("__u", "__slice", "__before")
