"""Statistics of batches and evaluations; each is one aggregation unless said otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import let


def rejection_metrics(df: DataFrame, options: list[str] | None = None, spec: str | float | None = None) -> DataFrame:
    """One row: shares of tokens and of sequences with a token that a rejection mask (``kept``) removes.

    With the mask's options and thresholds also, of each: mean, largest and smallest value of its statistic (over masked tokens, or over sequences with
    tokens), and the share outside its bounds, ``<option>_mean``, ``_max``, ``_min`` and ``_out``.
    """
    lost = A.total(F.zip_with("mask", "kept", lambda m, k: m - k))
    cols, aggs = [A.total(F.col("mask")).alias("k"), lost.alias("l")], [(F.sum("l") / (F.sum("k") + A.EPS)).alias("masked_fraction"), F.avg((F.col("l") > 0).cast("double")).alias("seq_masked_fraction")]
    if options:
        from .losses import rejection_statistics

        for o, (values, test) in rejection_statistics(options, spec).items():
            cols += [A.total(values).alias(f"{o}_s"), F.array_max(values).alias(f"{o}_hi"), F.array_min(values).alias(f"{o}_lo"), F.size(values).alias(f"{o}_n"), F.size(F.filter(values, _outside(test))).alias(f"{o}_o")]
            aggs += [(F.sum(f"{o}_s") / F.sum(f"{o}_n")).alias(f"{o}_mean"), F.max(f"{o}_hi").alias(f"{o}_max"), F.min(f"{o}_lo").alias(f"{o}_min"), (F.sum(f"{o}_o") / F.sum(f"{o}_n")).alias(f"{o}_out")]
    return df.select(*cols).agg(*aggs)


def _outside(test):
    return lambda x: ~test(x)


def importance_metrics(df: DataFrame, threshold: float = 2.0, level: str = "token") -> DataFrame:
    """One row: mean, max, min, deviation of importance weights, shares above and below the thresholds, effective sample size."""
    lo = 1.0 / threshold
    d = F.zip_with("logp", "old_logp", lambda x, y: x - y)
    if level == "token":
        t = df.select(F.explode(A.zipped(d=d, m=F.col("mask"))).alias("t")).filter("t.m > 0").select(F.exp(A.clamp(F.col("t.d"), -20, 20)).alias("w"), F.lit(1.0).alias("k"))
        high, low = F.avg((F.col("w") > threshold).cast("double")), F.avg((F.col("w") < lo).cast("double"))
    else:
        s = A.masked_sum(d, F.col("mask"))
        t = df.select(F.exp(A.clamp(s, -20, 20)).alias("w"), A.total(F.col("mask")).alias("k"), s.alias("s"))
        high, low = F.avg((F.col("s") > math.log(threshold)).cast("double")), F.avg((F.col("s") < math.log(lo)).cast("double"))
    t = t.withColumn("c", A.clamp(F.col("w"), lo, threshold))
    n = F.sum("k") + A.EPS
    mean_c, sq_c = F.sum(F.col("c") * F.col("k")) / n, F.sum(F.col("c") * F.col("c") * F.col("k")) / n
    return t.agg(
        (F.sum(F.col("w") * F.col("k")) / n).alias("is_mean"), F.max("w").alias("is_max"), F.min("w").alias("is_min"), high.alias("fraction_high"), low.alias("fraction_low"),
        F.sqrt(F.greatest(sq_c - mean_c * mean_c, F.lit(0.0))).alias("is_std"), ((mean_c + 1e-8) * (mean_c + 1e-8) / sq_c).alias("eff_sample_size"),
    )


def off_policy_metrics(df: DataFrame, training: str = "old_logp", rollout: str = "logp") -> DataFrame:
    """One row: perplexities of both policies, their difference, divergence estimators and chi-square distances."""
    m = F.col("mask")
    d = F.zip_with(training, rollout, lambda x, y: x - y)
    safe = F.transform(d, lambda x: A.clamp(x, -20, 20))
    per = df.select(
        A.total(m).alias("k"), A.masked_mean(F.col(training), m).alias("mt"), A.masked_mean(F.col(rollout), m).alias("mr"), A.masked_sum(d, m).alias("sd"),
        A.masked_sum(F.transform(d, lambda x: F.exp(x) - x - 1), m).alias("k3"), A.masked_sum(F.transform(safe, lambda x: F.exp(x * 2.0)), m).alias("r2"),
    ).withColumn("diff", F.col("mr") - F.col("mt"))
    n = F.sum("k") + A.EPS
    return per.agg(
        F.avg(F.exp(-F.col("mt"))).alias("training_ppl"), F.avg(-F.col("mt")).alias("training_log_ppl"), (-F.sum("sd") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("mr"))).alias("rollout_ppl"), F.avg(-F.col("mr")).alias("rollout_log_ppl"), F.avg("diff").alias("log_ppl_diff"), F.avg(F.abs("diff")).alias("log_ppl_abs_diff"),
        F.max("diff").alias("log_ppl_diff_max"), F.min("diff").alias("log_ppl_diff_min"), F.avg(F.exp("diff")).alias("ppl_ratio"),
        (F.sum("r2") / n - 1.0).alias("chi2_token"), (F.avg(F.exp(A.clamp(F.col("sd"), -20, 20) * 2.0)) - 1.0).alias("chi2_seq"),
    )


def data_metrics(df: DataFrame, max_length: int) -> DataFrame:
    """One row: scores of sequences with tokens, advantages, returns and values over tokens, lengths, clip and aborted shares, explained variance.

    The frame has rewards, advantages, returns, values and mask. Variances are unbiased.
    """
    seq = df.select(A.total(F.col("rewards")).alias("score"), A.total(F.col("mask")).alias("len"))
    live = F.col("len") > 0
    s = seq.agg(
        F.avg(F.when(live, F.col("score"))).alias("score_mean"), F.max(F.when(live, F.col("score"))).alias("score_max"), F.min(F.when(live, F.col("score"))).alias("score_min"),
        F.avg("len").alias("length_mean"), F.max("len").alias("length_max"), F.min("len").alias("length_min"), F.avg((F.col("len") == max_length).cast("double")).alias("length_clip_ratio"),
        F.avg(F.when(live, F.col("len"))).alias("live_length_mean"), F.avg((~live).cast("double")).alias("aborted_ratio"),
    )
    t = df.select(F.explode(A.zipped(a=F.col("advantages"), r=F.col("returns"), v=F.col("values"), m=F.col("mask"))).alias("t")).filter("t.m > 0").select("t.*")
    stats = [f(c).alias(f"{n}_{k}") for c, n in (("a", "advantages"), ("r", "returns"), ("v", "values")) for f, k in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    t = t.agg(*stats, (1.0 - F.var_samp(F.col("r") - F.col("v")) / (F.var_samp("r") + 1e-5)).alias("explained_variance"))
    return s.join(t)  # one row each


def variance_proxy(df: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """One row: signal strength, total power and pure noise of the gradient's variance, from squared advantages and score norms."""
    m = F.col("mask")
    w = F.zip_with("old_logp", "sum_pi_squared", lambda lp, s: 1 - 2 * F.exp(lp) + s)
    d = df.select(A.masked_mean(F.col("advantages"), m).alias("a"), A.masked_sum(w, m).alias("w"))
    one = F.lit(float(gradient_norm**2 if gradient_norm is not None else 0.0))
    g = d.agg(F.count("*").alias("n"), F.avg(F.col("a") * F.col("a") * F.greatest("w", F.lit(0.0))).alias("total_power"), F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"))
    noise = F.when(F.lit(gradient_norm is not None) & (F.col("n") > 1), F.greatest(F.lit(0.0), (F.col("total_power") - one) / (F.col("n") - 1))).otherwise(0.0)
    return g.select(one.alias("signal_strength"), "total_power", noise.alias("pure_noise"), "expected_a_squared", "expected_w")


def expected_extremes(values: Column, n: int | Column, ordered: bool = False) -> Column:
    """Struct (best, worst, best_std, worst_std): exact expectations and deviations of the largest and smallest of n draws with replacement.

    Of m sorted values the largest of n draws is the i-th with probability (i / m) ** n - ((i - 1) / m) ** n, the smallest with
    that of the reverse. ``ordered``: the values are sorted already.
    """
    k = n.cast("double") if isinstance(n, Column) else F.lit(float(n))

    def of(s: Column) -> Column:
        m = F.size(s).cast("double")
        w = F.transform(s, lambda x, i: F.struct(x.cast("double").alias("x"), (F.pow((i + 1) / m, k) - F.pow(i / m, k)).alias("b"), (F.pow(1 - i / m, k) - F.pow(1 - (i + 1) / m, k)).alias("w")))
        return let(w, lambda ws: let(F.struct(ws.alias("ws"), _dot(ws, "b").alias("b"), _dot(ws, "w").alias("w")), spread))

    def spread(t: Column) -> Column:
        dev = lambda c: F.sqrt(F.aggregate(t["ws"], F.lit(0.0), lambda a, x: a + (x["x"] - t[c]) * (x["x"] - t[c]) * x[c]))
        return F.struct(t["b"].alias("best"), t["w"].alias("worst"), dev("b").alias("best_std"), dev("w").alias("worst_std"))

    return of(values) if ordered else let(F.array_sort(values), of)


def _dot(ws: Column, weight: str) -> Column:
    return F.aggregate(ws, F.lit(0.0), lambda a, x: a + x["x"] * x[weight])


def draw_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n itself; empty for n of at most 1."""
    top = F.floor(F.log2(n.cast("double") - 0.5)).cast("int")
    powers = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), top)), lambda e: F.pow(F.lit(2.0), e).cast("int"))
    return F.when(n <= 1, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(F.filter(powers, lambda p: p < n), F.array(n.cast("int")))))


def validation_metrics(df: DataFrame, source: str, uid: str, values: str | list[str], vote: str | None = None, order: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(source, variable, metric, value, uids): metrics of each uid's finite values, averaged over the uids of a source.

    mean@N and std@N (population) with N the uid's number of values; best@n/mean, best@n/std, worst@n/mean and worst@n/std for n = 2, 4, ... and N,
    exact expectations over draws with replacement; with a vote column maj@n/mean and maj@n/std, of the first value of the draw's most
    frequent vote, by seeded draws (``order`` is the order in which values were given). The values of one uid are its few
    responses. A uid's values are sorted once.
    """
    values = [values] if isinstance(values, str) else values
    d = df.select(source, uid, *([F.col(vote).cast("string").alias("__vote")] if vote else []), *([F.col(order).alias("__order")] if order else []), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in values])).alias("__v"))
    d = d.filter("__v.x is not null and not isnan(__v.x) and abs(__v.x) < double('infinity')")
    stats = [F.array_sort(F.collect_list("__v.x")).alias("vs"), F.count("*").alias("n"), F.avg("__v.x").alias("mean"), F.stddev_pop("__v.x").alias("std")]
    if vote:
        stats.append(F.array_sort(F.collect_list(F.struct(*(["__order"] if order else []), F.col("__v.x").alias("x"), F.coalesce("__vote", F.lit("")).alias("vote")))).alias("votes"))
    g = d.groupBy(source, uid, F.col("__v.variable").alias("variable")).agg(*stats)
    name = lambda k, n, part="": F.concat(F.lit(f"{k}@"), n.cast("string"), F.lit(part))
    item = lambda metric, v: F.struct(metric.alias("metric"), v.alias("v"))
    none = F.array().cast("array<struct<metric:string,v:double>>")
    base = F.array(item(name("mean", F.col("n")), F.col("mean")))
    more = F.when(F.col("n") > 1, F.array(item(name("std", F.col("n")), F.col("std")))).otherwise(none)
    ends = lambda k: let(expected_extremes(F.col("vs"), k, ordered=True), lambda e: F.array(item(name("best", k, "/mean"), e["best"]), item(name("best", k, "/std"), e["best_std"]), item(name("worst", k, "/mean"), e["worst"]), item(name("worst", k, "/std"), e["worst_std"])))
    parts = [base, more, F.flatten(F.transform(draw_sizes(F.col("n")), ends))]
    if vote:
        got = majority_draws(draws, seed)(F.transform("votes", lambda v: v["x"]), F.transform("votes", lambda v: v["vote"]), draw_sizes(F.col("n")))
        parts.append(F.flatten(F.transform(got, lambda r: F.array(item(name("maj", r["n"], "/mean"), r["mean"]), item(name("maj", r["n"], "/std"), r["std"])))))
    m = g.select(source, "variable", F.explode(F.concat(*parts)).alias("x")).select(source, "variable", "x.metric", "x.v")
    return m.groupBy(source, "variable", "metric").agg(F.avg("v").alias("value"), F.count("*").alias("uids"))


def majority_of(values: np.ndarray, votes: np.ndarray, n: int, draws: int, seed: int) -> tuple[float, float]:
    """Mean and deviation, over seeded draws of n with replacement, of the first value of the most frequent vote; of equally frequent votes the one seen first."""
    rng = np.random.RandomState(seed)
    idx = rng.choice(len(values), size=(draws, n), replace=True)
    codes = np.unique(votes, return_inverse=True)[1][idx]
    hits = codes[:, :, None] == np.arange(codes.max() + 1)
    first = np.where(hits.any(axis=1), hits.argmax(axis=1), n)
    best = np.argmax(hits.sum(axis=1) * (n + 1) - first, axis=1)
    won = values[idx[np.arange(draws), first[np.arange(draws), best]]]
    return float(won.mean()), float(won.std())


def majority_draws(draws: int, seed: int):
    """Arrow UDF over a uid's values, votes and draw sizes: array of (n, mean, std) of ``majority_of``."""

    @F.pandas_udf("array<struct<n:int,mean:double,std:double>>")
    def run(values: pd.Series, votes: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("n", "mean", "std"), (int(n), *majority_of(np.asarray(x, float), np.asarray(v, str), int(n), draws, seed)))) for n in ns] for x, v, ns in zip(values, votes, sizes)])

    return run


def bootstrap(values: list[float], n: int, draws: int = 1000, seed: int = 42) -> dict[str, float]:
    """Means and deviations of the largest and smallest of n values drawn with replacement, with numpy's legacy generator."""
    rng = np.random.RandomState(seed)
    x = np.asarray(values, float)[rng.choice(len(values), size=(draws, n), replace=True)]
    hi, lo = x.max(axis=1), x.min(axis=1)
    return {"best_mean": float(hi.mean()), "best_std": float(hi.std()), "worst_mean": float(lo.mean()), "worst_std": float(lo.std())}


def bootstrap_by(df: DataFrame, group: str, value: str, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """``bootstrap`` of each group, an Arrow UDF over its few values."""
    kind = df.schema[group].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b = bootstrap(sorted(pdf["v"]), n, draws, seed)
        return pd.DataFrame([{"g": key[0], **b}])

    d = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).dropna()
    return d.groupBy("g").applyInPandas(run, f"g {kind}, best_mean double, best_std double, worst_mean double, worst_std double").withColumnRenamed("g", group)


def majority_value(df: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """group, vote, value: the most frequent vote (of equally frequent ones the first seen) and its first value."""
    g = df.groupBy(*group, vote).agg(F.count("*").alias("n"), F.min(order).alias("o"), F.min_by(value, order).alias("value"))
    best = g.groupBy(*group).agg(F.max(F.struct("n", (-F.col("o")).alias("o"), vote, "value")).alias("b"))
    return best.select(*group, F.col(f"b.{vote}").alias(vote), F.col("b.value").alias("value"))


def finite_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean, largest, smallest and population deviation of the finite values of each column."""
    out = []
    for c in cols:
        x = F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        out += [F.avg(x).alias(f"{c}_mean"), F.max(x).alias(f"{c}_max"), F.min(x).alias(f"{c}_min"), F.stddev_pop(x).alias(f"{c}_std")]
    return df.agg(*out)


def reduced(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: the largest of columns with "max" in their name, the smallest of those with "min", the mean of others."""
    return df.agg(*[(F.max if "max" in c else F.min if "min" in c else F.avg)(c).alias(c) for c in cols])


#: Reductions of typed metrics.
REDUCTIONS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def typed(df: DataFrame, name: str, kind: str, value: str) -> DataFrame:
    """(name, kind, value): values that say how they are reduced, one row per name. An unknown kind or two kinds of one name are an error."""
    checked = F.when(F.col(kind).isin(*REDUCTIONS), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown reduction "), F.coalesce(kind, F.lit("null")))).cast("string"))
    g = df.select(F.col(name), checked.alias("kind"), value).groupBy(name).agg(F.min("kind").alias("kind"), F.max("kind").alias("__k"), *[f(value).alias(f"__{k}") for k, f in REDUCTIONS.items()])
    out = F.raise_error(F.concat(F.lit("two reductions of "), F.col(name))).cast("double")
    for k in REDUCTIONS:
        out = F.when((F.col("kind") == k) & (F.col("__k") == k), F.col(f"__{k}").cast("double")).otherwise(out)
    return g.select(name, "kind", out.alias("value"))


#: Kinds of aggregation over steps.
KINDS = ("avg", "sum", "max", "min", "last", "weighted_avg", "time_sum")


def over_steps(df: DataFrame, rules: dict[str, str], weight: str, order: str) -> DataFrame:
    """One row: each metric over the steps by its rule; weighted_avg by the step's sample count."""
    out = []
    for c, kind in rules.items():
        if kind not in KINDS:
            raise ValueError(kind)
        x = F.col(c)
        f = {"avg": F.avg(x), "sum": F.sum(x), "time_sum": F.sum(x), "max": F.max(x), "min": F.min(x), "last": F.max_by(x, order), "weighted_avg": F.sum(x * F.col(weight)) / F.sum(F.when(x.isNotNull(), F.col(weight)))}[kind]
        out.append(f.alias(c))
    return df.agg(*out)


def assembly_stats(df: DataFrame, seconds: str, version: str, tokens: str) -> DataFrame:
    """One row: rows, tokens, 50th, 95th and 99th percentile of the processing time (linear between values), span and number of versions."""
    p = F.percentile(seconds, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    d = df.agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens"), p.alias("p"), (F.max(version) - F.min(version)).alias("version_span"), F.countDistinct(version).alias("versions"))
    return d.select("rows", "tokens", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "version_span", "versions")


def throughput(tokens: int, seconds: float, devices: int) -> dict[str, float]:
    return {"total_num_tokens": tokens, "time_per_step": seconds, "throughput": tokens / (seconds * devices)}


def timing(raw: dict[str, float], prompt_tokens: int, response_tokens: int) -> dict[str, float]:
    """Seconds of each phase and milliseconds a token: generation by response tokens, other phases by all tokens."""
    out = {f"timing_s/{k}": v for k, v in raw.items()}
    for k, v in raw.items():
        n = response_tokens if k == "gen" else prompt_tokens + response_tokens
        if k in ("gen", "ref", "values", "adv", "update_critic", "update_actor") and n:
            out[f"timing_per_token_ms/{k}"] = v * 1000 / n
    return out


def positive_samples(df: DataFrame, reward: str, key: list[str], order: str, most: int) -> DataFrame:
    """Up to ``most`` rows of positive reward, the first of each key, in order: a log of samples of a fixed length."""
    good = df.filter(F.col(reward) > 0)
    rest = [c for c in good.columns if c not in key]
    one = good.groupBy(*key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return one.orderBy(order).limit(most)


def by_variant(df: DataFrame, variant: str, rewards: list[str], path: str | None = None) -> DataFrame:
    """Per variant: rows, mean and population deviation of each reward, and the number of distinct (variant, path)."""
    stats = [f(c).alias(f"{c}_{n}") for c in rewards for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return df.groupBy(variant).agg(F.count("*").alias("rows"), *stats, *([F.countDistinct(path).alias("paths")] if path else []))


def variant_entropy(df: DataFrame, variant: str, entropy: str, mask: str = "mask") -> DataFrame:
    """Per variant: mean and population deviation of the rows' masked mean entropy (the mask counts 1 at least). Null variants are left out."""
    e = A.masked_sum(F.col(entropy), F.col(mask)) / F.greatest(A.total(F.col(mask)), F.lit(1.0))
    d = df.filter(F.col(variant).isNotNull()).select(variant, e.alias("e"))
    return d.groupBy(variant).agg(F.avg("e").alias("entropy_mean"), F.stddev_pop("e").alias("entropy_std"))


def clip_fractions(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """One row: shares of the masked tokens whose loss the clip decides, and, of negative advantages, the lower bound; mean of old less new log-probability."""
    d = F.zip_with("logp", "old_logp", lambda x, y: A.clamp(x - y, -20, 20))
    z = A.zipped(d=d, a=F.col("advantages"), m=F.col("mask"))

    def hit(t, lower):
        one, two, three = -t["a"] * F.exp(t["d"]), -t["a"] * A.clamp(F.exp(t["d"]), 1 - low, 1 + high), -t["a"] * dual
        return ((F.greatest(one, two) > three) & (t["a"] < 0) if lower else two > one).cast("double") * t["m"]

    s = df.select(A.total(F.col("mask")).alias("k"), A.total(F.transform(z, lambda t: hit(t, False))).alias("c"), A.total(F.transform(z, lambda t: hit(t, True))).alias("l"), A.total(F.transform(z, lambda t: -t["d"] * t["m"])).alias("kl"))
    n = F.sum("k") + A.EPS
    return s.agg((F.sum("c") / n).alias("clip_fraction"), (F.sum("l") / n).alias("clip_fraction_lower"), (F.sum("kl") / n).alias("ppo_kl"))


def category_means(df: DataFrame, category: str, columns: list[str], digits: int | None = None) -> DataFrame:
    """Per category: rows and the mean of each audit metric over its values that are neither null nor NaN."""
    mean = lambda c: F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
    return df.groupBy(category).agg(F.count("*").alias("rows"), *[(mean(c) if digits is None else F.bround(mean(c), digits)).alias(c) for c in columns])


def match_status(df: DataFrame, status: str) -> DataFrame:
    """(status, rows, fraction) of sampled rows; null and blank statuses are "unknown"."""
    s = F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("unknown"))
    g = df.groupBy(s.alias("status")).agg(F.count("*").alias("rows"))
    return g.join(F.broadcast(g.agg(F.sum("rows").alias("__n")))).select("status", "rows", (F.col("rows") / F.col("__n")).alias("fraction"))  # one row


def sampling_stats(df: DataFrame, status: str, prefix: str | None = None, mask: str = "mask") -> DataFrame:
    """One row: sampled, matched, missed and fallback rows with their shares; with a prefix mask also teacher rows and tokens with theirs."""
    s, n = F.coalesce(F.col(status), F.lit("unknown")), F.greatest(F.count("*"), F.lit(1))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    miss, back = count(s == "miss"), count(s == "fallback_random")
    out = [F.count("*").alias("sampled_rows"), count(~s.isin("miss", "unknown")).alias("matched_rows"), miss.alias("miss_rows"), back.alias("fallback_rows"), (miss / n).alias("miss_fraction"), (back / n).alias("fallback_fraction")]
    if prefix:
        taught = F.zip_with(prefix, mask, lambda p, m: ((p > 0) & (m > 0)).cast("double"))
        rows, tokens, all_ = count(F.exists(prefix, lambda p: p > 0)), F.sum(A.total(taught)), F.sum(A.total(F.col(mask)))
        out += [rows.alias("teacher_rows"), (rows / n).alias("teacher_row_fraction"), tokens.alias("teacher_tokens"), (tokens / F.greatest(all_, F.lit(1.0))).alias("teacher_token_fraction")]
    return df.agg(*out)


def eval_means(df: DataFrame, source: str, scores: str) -> DataFrame:
    """Mean over the rows of a source of each row's mean score (array)."""
    row = A.total(F.transform(scores, lambda x: x.cast("double"))) / F.size(scores)
    return df.select(source, row.alias("s")).groupBy(source).agg(F.avg("s").alias("score"), F.count("*").alias("rows"))


def core_or_aux(variable: Column, metric: Column, has_acc: bool, largest_n: Column) -> Column:
    """val-core for the core variable's mean, best and majority at the largest n, else val-aux."""
    core = (variable == ("acc" if has_acc else "reward")) & metric.rlike("^(mean|maj|best)@") & metric.contains(F.concat(F.lit("@"), largest_n.cast("string")))
    return F.when(core, "val-core").otherwise("val-aux")


def adaptive_coefficient(value: float, current: float, steps: int, target: float, horizon: float) -> float:
    """The next penalty coefficient: moved by the relative error, which is clipped to 0.2, times steps over horizon."""
    return value * (1 + min(max(current / target - 1, -0.2), 0.2) * steps / horizon)
