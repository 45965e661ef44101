"""Expressions over the arrays of one sequence: values, and a 0/1 mask of the same length.

Sums and transforms are expressions of the JVM. What builds an array from its left or right end (running sums, advantage
estimates) is an Arrow kernel: the rows of a batch go through their positions together, one step per position, in time
and memory linear in the number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
BOUND = 20.0


def zipped(**cols: Column) -> Column:
    """Array of structs with the given fields."""
    return F.arrays_zip(*[c.alias(n) for n, c in cols.items()])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def masked_sum(v: Column, m: Column) -> Column:
    return total(F.zip_with(v, m, lambda x, k: x * k))


def masked_mean(v: Column, m: Column) -> Column:
    """Sum over the sum of the mask plus 1e-8."""
    return masked_sum(v, m) / (total(m) + EPS)


def masked_max(v: Column, m: Column) -> Column:
    """0 where the mask is empty."""
    return F.coalesce(F.array_max(F.transform(F.filter(zipped(v=v, m=m), lambda t: t["m"] > 0), lambda t: t["v"])), F.lit(0.0))


def clamp(x: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    as_col = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    x = x if lo is None else F.greatest(x, as_col(lo))
    return x if hi is None else F.least(x, as_col(hi))


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (null elements as 0), first places and lengths of the lists of an array; null lists have length 0."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    offsets = a.offsets.to_numpy()
    values = a.values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    size = np.where(a.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    return values, offsets[:-1], size


def _scanned(columns: list[pa.Array], states: int, step: Callable, from_end: bool) -> pa.Array:
    """A list of the same lengths, made by ``step(states, values) -> (states, output)`` from one end of all rows at once."""
    parts = [_lists(c) for c in columns]
    size = parts[0][2]
    if any((p[2] != size).any() for p in parts[1:]):
        raise ValueError("arrays of one row differ in length")
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(offsets[-1])
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # rows that have the k-th position
    held = [np.zeros(len(size)) for _ in range(states)]
    for k, n in enumerate(live):
        rows = order[:n]
        place = size[rows] - 1 - k if from_end else k
        now, value = step([h[:n] for h in held], [v[start[rows] + place] for v, start, _ in parts])
        for h, x in zip(held, now):
            h[:n] = x
        out[offsets[rows] + place] = value
    null = columns[0].is_null().to_numpy(zero_copy_only=False)
    made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
    return pa.array([None if x else y for x, y in zip(null, made.to_pylist())], made.type) if null.any() else made


@lru_cache(maxsize=64)
def _suffix_kernel(gamma: float):
    def step(held, x):
        v, m = x
        now = v + gamma * held[0]
        return (now * m,), now

    return F.arrow_udf(lambda v, m: _scanned([v, m], 1, step, True), "array<double>")


@lru_cache(maxsize=1)
def _prefix_kernel():
    def step(held, x):
        now = held[0] + x[0]
        return (now,), now

    return F.arrow_udf(lambda v: _scanned([v], 1, step, False), "array<double>")


@lru_cache(maxsize=64)
def _gae_kernel(gamma: float, lam: float):
    def step(held, x):
        (nextv, last), (r, v, m) = held, x
        now = (r + gamma * nextv - v + gamma * lam * last) * m + (1 - m) * last
        return (v * m + (1 - m) * nextv, now), now

    return F.arrow_udf(lambda r, v, m: _scanned([r, v, m], 2, step, True), "array<double>")


def suffix_sums(v: Column, gamma: float = 1.0, mask: Column | None = None) -> Column:
    """From each position to the end, discounted by ``gamma`` a step; with a mask, a position of mask 0 starts anew.

    The running sum is multiplied by the mask after it has been written, so a masked position still shows its own.
    A null array stays null, null elements count as 0.
    """
    m = mask if mask is not None else F.transform(v, lambda x: F.lit(1.0))
    return _suffix_kernel(float(gamma))(v, m)


def prefix_sums(v: Column) -> Column:
    """Up to and with each position; null elements count as 0."""
    return _prefix_kernel()(v)


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates; positions of mask 0 pass on what follows them. Null elements count as 0."""
    return _gae_kernel(float(gamma), float(lam))(rewards, values, mask)


def mask_to_end(ids: Column, end: int | Column) -> Column:
    """1 up to and with the first end token, 0 after it; all 1 without one."""
    at = F.array_position(ids, end if isinstance(end, Column) else F.lit(end))
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def fit(ids: Column, length: int, pad: int = 0, left: bool = True, truncation: str = "error") -> Column:
    """Padded or cut to ``length``: cut at the left, the right or in the middle, or an error."""
    n = F.size(ids)
    padding = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), F.lit(length) - n))
    body = F.transform(ids, lambda x: x.cast("long"))
    short = F.concat(padding, body) if left else F.concat(body, padding)
    head = length // 2
    cut = {
        "left": F.slice(body, F.greatest(F.lit(1), n - length + 1), F.lit(length)),
        "right": F.slice(body, 1, length),
        "middle": F.concat(F.slice(body, 1, head), F.slice(body, F.greatest(F.lit(1), n - (length - head) + 1), F.lit(length - head))),
        "error": F.raise_error(F.concat(F.lit("a sequence is longer than "), F.lit(str(length)))).cast("array<bigint>"),
    }[truncation]
    return F.when(n <= length, short).otherwise(cut)


def at_last(value: Column, mask: Column) -> Column:
    """An array of zeros with ``value`` at the last position of mask 1."""
    n = F.size(mask)
    last = F.aggregate(F.transform(mask, lambda m, i: F.when(m > 0, i).otherwise(F.lit(-1))), F.lit(-1), lambda a, b: F.greatest(a, b))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == last, value.cast("double")).otherwise(F.lit(0.0)))


def align(values: Column, full: Column, valid: Column, response: Column) -> Column:
    """Struct (values, kind): which of three lengths the array has; null values where it's none of them."""
    n = F.size(values)
    kind = F.when(n == full, "full").when(n == valid, "valid").when(n == response, "response")
    return F.struct(F.when(kind.isNotNull(), values).alias("values"), kind.alias("kind"))


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Estimator of the divergence of one token: k1, abs, k2 or k3 (clamped to 20 inside and 10 outside)."""
    if kind in ("kl", "k1"):
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind in ("mse", "k2"):
        return (logp - ref) * (logp - ref) * 0.5
    if kind in ("low_var_kl", "k3"):
        d = clamp(ref - logp, -BOUND, BOUND)
        return clamp(F.exp(d) - d - 1.0, -10.0, 10.0)
    raise ValueError(kind)


def field(name: str):
    """A function for ``transform`` that takes one field of a struct."""
    return lambda t: t[name]


def kl_of(kind: str):
    """``kl`` of one kind, for ``zip_with``."""
    return lambda x, y: kl(x, y, kind)


def linear_ramp(step: Column, start: float, end: float, first: int, last: int) -> Column:
    """``start`` up to step ``first``, ``end`` from step ``last``, linear between."""
    if last <= first:
        return F.when(step < first, F.lit(float(start))).otherwise(F.lit(float(end)))
    part = clamp((step - F.lit(first)) / F.lit(float(last - first)), 0.0, 1.0)
    return F.lit(float(start)) + F.lit(float(end - start)) * part


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long")


def round_up(a: Column, b: int) -> Column:
    return ceil_div(a, b) * F.lit(b)


def workload(n: Column) -> Column:
    """Work of a sequence of n tokens: 24576 n + n * n."""
    return F.lit(24576).cast("long") * n + n * n
