"""Values of policy and value losses over sequences, by name (forward values only), and rollout corrections.

A frame has one row per sequence with arrays ``logp``, ``old_logp``, ``advantages``, ``mask`` and, optionally, importance
weights. A loss turns the arrays of a row into per-token losses; one aggregation reduces them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.hashing import seeded
from ..storage import staged
from .batch import INDEX, with_index
from .ordered import hash_rank

BOUND = 20.0


def aggregate(df: DataFrame, loss: str = "loss", mode: str = "token-mean", scale: float | None = None, out: str = "value") -> DataFrame:
    """One row: the masked losses as token-mean, seq-mean-token-sum, seq-mean-token-sum-norm (over ``scale`` or the longest array) or seq-mean-token-mean.

    Sequences without a token of mask 1 don't count. Null for an empty frame.
    """
    per = df.select(A.masked_sum(F.col(loss), F.col("mask")).alias("s"), A.total(F.col("mask")).alias("k"), F.size("mask").alias("len"))
    full = F.col("k") > 0
    if mode == "token-mean":
        v = F.sum("s") / F.sum("k")
    elif mode in ("seq-mean-token-sum", "seq-mean-token-sum-norm"):
        v = F.sum(F.when(full, F.col("s"))) / F.sum(full.cast("long"))
        if mode.endswith("norm"):
            v = v / (F.lit(float(scale)) if scale else F.max("len"))
    elif mode == "seq-mean-token-mean":
        v = F.sum(F.when(full, F.col("s") / (F.col("k") + A.EPS))) / F.sum(full.cast("long"))
    else:
        raise ValueError(mode)
    return per.agg(v.alias(out))


def _tokens(**more: str) -> Column:
    return A.zipped(lp=F.col("logp"), old=F.col("old_logp"), a=F.col("advantages"), m=F.col("mask"), **{k: F.col(v) for k, v in more.items()})


def _ratio(t: Column, bound: float | None = BOUND) -> Column:
    d = t["lp"] - t["old"]
    return F.exp(d if bound is None else A.clamp(d, -bound, bound))


def clipped(t, low=0.2, high=0.2, dual=3.0) -> Column:
    """The larger of plain and clipped loss; for negative advantages at most ``dual`` times the advantage."""
    r = _ratio(t)
    one, two, three = -t["a"] * r, -t["a"] * A.clamp(r, 1 - low, 1 + high), -t["a"] * dual
    big = F.greatest(one, two)
    return F.when(t["a"] < 0, F.least(three, big)).otherwise(big)


def divergence_tv(t, low=0.2, high=0.2, top=20.0) -> Column:
    """Truncated ratio times log-probability where the probability has moved by less than the bound against the advantage."""
    gap = F.exp(t["lp"]) - F.exp(t["old"])
    ok = F.when(t["a"] > 0, gap <= high).otherwise(gap >= -low)
    return -t["a"] * F.least(_ratio(t), F.lit(top)) * t["lp"] * ok.cast("double")


def divergence_kl(t, low=0.2, high=0.2, top=20.0) -> Column:
    """The same with the binary divergence of the two probabilities as the bound."""
    p, q = F.exp(t["lp"]), F.exp(t["old"])
    d = q * (t["old"] - t["lp"]) + (1 - q) * F.log((1.0 - q + 1e-8) / (1.0 - p + 1e-8))
    ok = F.when(t["a"] > 0, (d <= high) | (p <= q)).otherwise((d <= low) | (p >= q))
    return -t["a"] * F.least(_ratio(t), F.lit(top)) * t["lp"] * ok.cast("double")


def soft_gate(t, tau_pos=1.0, tau_neg=1.05) -> Column:
    """A sigmoid gate of the ratio instead of a clip, steeper for negative advantages."""
    tau = F.when(t["a"] > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    return -t["a"] * (4.0 / tau) / (1.0 + F.exp(-tau * (_ratio(t) - 1.0)))


def plain(t) -> Column:
    return -t["lp"] * t["a"]


def clipped_weight(t, low=0.2, high=0.2) -> Column:
    """The clipped ratio as a constant weight of advantage and log-probability."""
    return -A.clamp(_ratio(t), 1 - low, 1 + high) * t["a"] * t["lp"]


def weighted(t) -> Column:
    """Ratio to the rollout policy as a weight of advantage and log-probability."""
    return -F.exp(A.clamp(t["lp"] - t["old"], -BOUND, BOUND)) * t["a"] * t["lp"]


TOKEN_LOSSES: dict[str, Callable[..., Column]] = {
    "vanilla": clipped, "dppo_tv": divergence_tv, "dppo_kl": divergence_kl, "sapo": soft_gate, "gpg": plain, "cispo": clipped_weight, "reinforce": weighted,
}
#: Losses that always average tokens in a sequence, then sequences.
SEQUENCE_MEAN = {"gspo", "sapo"}


def register(name: str, f: Callable[..., Column], sequence_mean: bool = False) -> None:
    """Add a loss of a token (a struct of lp, old, a, m and, if weighted, w) under a new name."""
    if name in TOKEN_LOSSES and TOKEN_LOSSES[name] is not f:
        raise ValueError(f"{name} is taken")
    TOKEN_LOSSES[name] = f
    if sequence_mean:
        SEQUENCE_MEAN.add(name)


def token_loss(df: DataFrame, name: str, weights: str | None = None, **options) -> DataFrame:
    """``df`` with ``loss``, an array, by a loss whose tokens depend on their sequence only."""
    if name == "gspo":
        return sequence_ratio_loss(df, weights, **options)
    more = {"w": weights} if weights else {}
    f = TOKEN_LOSSES[name]
    return df.withColumn("loss", F.transform(_tokens(**more), lambda t: f(t, **options) * (t["w"] if weights else F.lit(1.0))))


def sequence_ratio_loss(df: DataFrame, weights: str | None = None, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """The clipped loss with the exponential of the sequence's mean log-ratio (at most 10) as the ratio of every token."""
    mean = A.masked_sum(F.zip_with("logp", "old_logp", lambda x, y: x - y), F.col("mask")) / F.greatest(A.total(F.col("mask")), F.lit(1.0))
    d = df.withColumn("__r", F.exp(F.least(mean, F.lit(10.0))))
    more = {"w": weights} if weights else {}
    f = lambda t: F.greatest(-t["a"] * F.col("__r"), -t["a"] * A.clamp(F.col("__r"), 1 - low, 1 + high)) * (t["w"] if weights else F.lit(1.0))
    return d.withColumn("loss", F.transform(_tokens(**more), f)).drop("__r")


def geometric_mean_loss(df: DataFrame, low: float = 0.4, high: float = 0.4, out: str = "value") -> DataFrame:
    """One row: the mean over all sequences of minus the mean advantage times the geometric mean of the clipped ratios."""

    def least(t):
        d, s = t["lp"] - t["old"], F.signum(t["a"])
        return s * F.least(s * d, s * A.clamp(d, -low, high)) * t["m"]

    k = A.total(F.col("mask")) + A.EPS
    ratio = F.exp(A.total(F.transform(_tokens(), least)) / k)
    adv = A.masked_sum(F.col("advantages"), F.col("mask")) / k
    return df.select((-adv * ratio).alias("l")).agg(F.avg("l").alias(out))


def covariances(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, cov, ...) of every token of mask 1: centred advantage times centred log-probability. Written once, since it is ranked and summed."""
    t = df.select(key, F.posexplode(_tokens()).alias("pos", "t")).filter("t.m > 0").select(key, "pos", "t.*")
    m = F.broadcast(t.agg(F.avg("a").alias("ma"), F.avg("lp").alias("ml"), F.count("*").alias("valid")))  # one row
    return staged(t.join(m).withColumn("cov", (F.col("a") - F.col("ma")) * (F.col("lp") - F.col("ml"))).drop("ma", "ml"), "covariances")


def covariance_clip(df: DataFrame, key: str, share: float = 0.0002, lo: float = 1.0, hi: float = 5.0, low: float = 0.2, high: float = 0.2, seed: str = "clip") -> DataFrame:
    """One row (value, clipped): the clipped loss with the losses of some tokens of covariance between the bounds set to 0.

    Their number is ``share`` of all tokens, one at least, chosen by hash among the tokens that aren't clipped already.
    """
    c = covariances(df, key)
    r = F.exp(F.col("lp") - F.col("old"))
    one, two = -F.col("a") * r, -F.col("a") * A.clamp(r, 1 - low, 1 + high)
    c = c.withColumn("l", F.greatest(one, two)).withColumn("free", (two <= one) & (F.col("cov") > lo) & (F.col("cov") < hi))
    n = c.agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("n")).first()["n"]
    free = c.filter("free").select(key, "pos", seeded(seed, F.col(key), F.col("pos")).alias("h"), F.lit(0).alias("all"))
    pick = hash_rank(free, ["all"], "h", "rank").filter(F.col("rank") < int(n)).select(key, "pos", F.lit(0.0).alias("corr"))
    return c.join(pick, [key, "pos"], "left").agg((F.sum(F.col("l") * F.coalesce("corr", F.lit(1.0))) / F.count("*")).alias("value"), F.count("corr").alias("clipped"))


def covariance_kl(df: DataFrame, key: str, share: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """One row (value, penalised): the unclipped loss, plus the absolute log-ratio for the ``share`` of tokens of largest covariance (one at least)."""
    c = covariances(df, key)
    n = c.agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("n")).first()["n"]
    # a lower bound of the wanted covariances leaves a few per mille more rows than wanted; these are ranked in ranges
    total = c.count()
    bound = c.stat.approxQuantile("cov", [max(0.0, 1 - int(n) / total - 0.002)], 0.001)[0] if total else 0.0
    top = with_index(c.filter(F.col("cov") >= bound).select("cov", key, "pos"), F.desc("cov"), F.col(key), F.col("pos")).filter(F.col(INDEX) < int(n)).select(key, "pos", F.lit(1.0).alias("hit"))
    d = F.col("lp") - F.col("old")
    l = -F.col("a") * F.exp(d) + F.coalesce("hit", F.lit(0.0)) * coef * F.abs(d)
    return c.join(top, [key, "pos"], "left").agg((F.sum(l) / F.count("*")).alias("value"), F.count("hit").alias("penalised"))


def value_loss(df: DataFrame, predicted: str, old: str, returns: str, clip: float = 0.5) -> DataFrame:
    """``df`` with ``loss``: half the larger of the squared errors of the prediction and of the prediction clipped to the old value."""
    z = A.zipped(p=F.col(predicted), v=F.col(old), r=F.col(returns))

    def f(t):
        c = F.least(F.greatest(t["p"], t["v"] - clip), t["v"] + clip)
        return 0.5 * F.greatest((t["p"] - t["r"]) * (t["p"] - t["r"]), (c - t["r"]) * (c - t["r"]))

    return df.withColumn("loss", F.transform(z, f))


def nll(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Per group: tokens, the sum of -logp times the weight, and their quotient."""
    s = -A.masked_sum(F.col("logp"), F.col("mask")) * (weight if weight is not None else F.lit(1.0))
    d = df.select(*by, s.alias("s"), A.total(F.col("mask")).alias("k"))
    g = d.groupBy(*by).agg(F.sum("k").alias("tokens"), F.sum("s").alias("nll_sum"))
    return g.withColumn("nll", F.when(F.col("tokens") > 0, F.col("nll_sum") / F.col("tokens")))


def shaped(p: Column, method: str, gamma: float = 0.1) -> Column:
    """The off-policy weight of a probability: logp, p_logp, square_root, pow, p_div_p_<c>."""
    if method == "logp":
        return F.log(p)
    if method == "p_logp":
        return p + F.log(p)
    if method == "square_root":
        return F.sqrt(p)
    if method == "pow":
        return F.pow(p, F.lit(gamma))
    if method.startswith("p_div_p_"):
        return p / (p + float(method.removeprefix("p_div_p_")))
    raise ValueError(method)


def mixed_policy(df: DataFrame, prefix: str, low: float = 0.2, high: float = 0.2, method: str = "p_div_p_0.1") -> DataFrame:
    """One row (on_loss, off_loss, value, off_share): clipped loss of the sampled tokens and shaped loss of the given ones (prefix mask 1), over all tokens."""
    t = A.zipped(lp=F.col("logp"), old=F.col("old_logp"), a=F.col("advantages"), m=F.col("mask"), p=F.col(prefix))
    on = F.transform(t, lambda x: F.greatest(-x["a"] * _ratio(x), -x["a"] * A.clamp(_ratio(x), 1 - low, 1 + high)) * x["m"] * (1 - x["p"]))
    off = F.transform(t, lambda x: -x["a"] * shaped(F.exp(x["lp"]), method) * x["m"] * x["p"])
    n_on, n_off = A.total(F.transform(t, lambda x: x["m"] * (1 - x["p"]))), A.total(F.transform(t, lambda x: x["m"] * x["p"]))
    s = df.select(A.total(on).alias("on"), A.total(off).alias("off"), n_on.alias("k_on"), n_off.alias("k_off")).agg(*[F.sum(c).alias(c) for c in ("on", "off", "k_on", "k_off")])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    k = F.col("k_on") + F.col("k_off")
    return s.select(div(F.col("on"), F.col("k_on")).alias("on_loss"), div(F.col("off"), F.col("k_off")).alias("off_loss"), div(F.col("on") + F.col("off"), k).alias("value"), div(F.col("k_off"), k).alias("off_share"))


# Corrections between the rollout and the training policy -------------------------------------------------------------


def log_ratio() -> Column:
    return F.zip_with("logp", "old_logp", lambda x, y: x - y)


def penalised_rewards(df: DataFrame, scores: str, ref: str, coef: float, kind: str = "kl") -> DataFrame:
    """``df`` with ``rewards``: token scores less the coefficient times the divergence from the reference, and ``kl``, its mean over the sequence."""
    k = F.zip_with(F.zip_with("logp", ref, A.kl_of(kind)), "mask", lambda x, m: x * m)
    d = df.withColumn("__k", k).withColumn("rewards", F.zip_with(scores, "__k", lambda s, x: s - coef * x))
    return d.withColumn("kl", A.masked_mean(F.col("__k"), F.col("mask"))).drop("__k")


def importance_weights(df: DataFrame, level: str = "token", threshold: float = 2.0, normalise: bool = False) -> DataFrame:
    """``df`` with ``weights``: exponential of the log-ratio of the token or of the sequence's sum, at most the threshold, 0 outside the mask."""
    lr = log_ratio()
    if level == "token":
        w = F.transform(A.zipped(d=lr, m=F.col("mask")), lambda t: F.least(F.exp(A.clamp(t["d"], -BOUND, BOUND)) * t["m"], F.lit(threshold)))
    elif level == "sequence":
        s = F.exp(A.clamp(A.masked_sum(lr, F.col("mask")), -BOUND, BOUND))
        w = F.transform("mask", lambda m: F.least(s * m, F.lit(threshold)))
    else:
        raise ValueError(level)
    d = df.withColumn("weights", w)
    if not normalise:
        return d
    if level == "token":
        mean = d.select(A.masked_sum(F.col("weights"), F.col("mask")).alias("s"), A.total(F.col("mask")).alias("k")).agg((F.sum("s") / (F.sum("k") + A.EPS)).alias("__mean"))
    else:
        mean = d.select(A.masked_mean(F.col("weights"), F.col("mask")).alias("s"), (A.total(F.col("mask")) > 0).cast("double").alias("k")).agg((F.sum(F.col("s") * F.col("k")) / F.greatest(F.sum("k"), F.lit(1e-8))).alias("__mean"))
    d = d.join(F.broadcast(mean))  # one row
    return d.withColumn("weights", F.transform("weights", lambda x: F.when(F.col("__mean") > 1e-8, x / F.col("__mean")).otherwise(x))).drop("__mean")


def parse_thresholds(options: list[str], spec: str | float) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) of each option: one entry for all or one each, "lower_upper" or a single upper bound (for k1 its inverse is the lower one)."""
    entries = [str(spec)] if isinstance(spec, (int, float)) else [e.strip() for e in spec.split(",") if e.strip()]
    if len(entries) == 1:
        entries *= len(options)
    if len(entries) != len(options):
        raise ValueError(f"{len(entries)} thresholds for {len(options)} options")
    out: dict[str, tuple[float | None, float]] = {}
    for o, e in zip(options, entries):
        parts = [float(x) for x in e.split("_")]
        if any(p <= 0 for p in parts) or len(parts) > 2 or len(parts) == 2 and not o.endswith("k1"):
            raise ValueError(f"bad threshold {e!r} of {o}")
        out[o] = (parts[0], parts[1]) if len(parts) == 2 else (1 / parts[0] if o.endswith("k1") else None, parts[0])
    return out


def rejection_statistics(options: list[str], spec: str | float) -> dict:
    """For each option its statistic as an array (of the masked tokens, or of one value per sequence with tokens) and the test for its bounds."""
    d = F.transform(log_ratio(), lambda x: A.clamp(x, -BOUND, BOUND))
    stat = {"1": lambda x: -x, "2": lambda x: x * x * 0.5, "3": lambda x: F.exp(x) - 1.0 - x}
    out = {}
    for o, (lo, hi) in parse_thresholds(options, spec).items():
        v, m = F.transform(d, stat[o[-1]]), F.col("mask")
        test = (lambda x, lo=lo, hi=hi: (x >= math.log(lo)) & (x <= math.log(hi))) if o.endswith("k1") else (lambda x, hi=hi: x <= hi)
        if o.startswith("token"):
            values = F.transform(F.filter(A.zipped(v=v, m=m), lambda t: t["m"] > 0), lambda t: t["v"])
        else:
            one = {"seq_sum": A.masked_sum, "seq_mean": A.masked_mean, "seq_max": A.masked_max}[o.rsplit("_", 1)[0]](v, m)
            values = F.when(A.total(m) > 0, F.array(one)).otherwise(F.array().cast("array<double>"))
        out[o] = (values, test)
    return out


def bypass(df: DataFrame, kind: str = "ppo_clip", weights: str | None = None, threshold: float = 2.0, normalise: bool = False, options: list[str] | None = None, spec: str | float | None = None, mode: str = "token-mean") -> DataFrame:
    """One row: the loss where ``old_logp`` is the rollout's own log-probability: rejection first, then "ppo_clip" (whose ratio corrects already) or "reinforce".

    "reinforce" weighs -logp * advantage by the importance weights of ``weights`` ("token", "sequence" or None for 1).
    """
    if kind not in ("ppo_clip", "reinforce"):
        raise ValueError(kind)
    d = df
    if kind == "reinforce" and weights:
        d = importance_weights(d, weights, threshold, normalise)
    if options:
        d = rejection_mask(d, options, spec).drop("mask").withColumnRenamed("kept", "mask")
    if kind == "ppo_clip":
        return aggregate(token_loss(d, "vanilla"), mode=mode)
    return aggregate(token_loss(d, "gpg", "weights" if weights else None), mode=mode)


def rejection_mask(df: DataFrame, options: list[str], spec: str | float) -> DataFrame:
    """``df`` with ``kept``, the mask after all criteria: token_k1..3, seq_sum_k1..3, seq_mean_k1..3, seq_max_k2..3.

    Divergences are -d, d * d / 2 and exp(d) - 1 - d of the log-ratio d; k1 is bounded by the logarithms of its thresholds.
    """
    known = {f"{a}_k{k}" for a in ("token", "seq_sum", "seq_mean") for k in (1, 2, 3)} | {"seq_max_k2", "seq_max_k3"}
    options = list(dict.fromkeys(options))
    if not options or set(options) - known:
        raise ValueError(f"unknown options {sorted(set(options) - known)}")
    d = F.transform(log_ratio(), lambda x: A.clamp(x, -BOUND, BOUND))
    stat = {"1": lambda x: -x, "2": lambda x: x * x * 0.5, "3": lambda x: F.exp(x) - 1.0 - x}
    keep_seq, token_tests = F.lit(True), []
    for o, (lo, hi) in parse_thresholds(options, spec).items():
        f = stat[o[-1]]
        test = (lambda x, lo=lo, hi=hi: (x >= math.log(lo)) & (x <= math.log(hi))) if o.endswith("k1") else (lambda x, hi=hi: x <= hi)
        v, m = F.transform(d, f), F.col("mask")
        if o.startswith("token"):
            token_tests.append((f, test))
        else:
            keep_seq = keep_seq & test({"seq_sum": A.masked_sum, "seq_mean": A.masked_mean, "seq_max": A.masked_max}[o.rsplit("_", 1)[0]](v, m))

    def kept(t):
        ok = F.lit(True)
        for f, test in token_tests:
            ok = ok & test(f(t["d"]))
        return t["m"] * (ok & keep_seq).cast("int")

    return df.withColumn("kept", F.transform(A.zipped(d=d, m=F.col("mask")), kept))
