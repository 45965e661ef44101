"""Queries of sequence statistics: advantages, losses, corrections, metrics.

The sequences are orders with their line items as tokens: a stand-in for sampled responses with groups of about 40.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import grading
from ..operators import advantages as adv
from ..operators import losses, metrics
from ..storage import table
from . import query, r6

GROUPS = 400
TOK = """tok as (select l_orderkey as seq, l_orderkey % 400 as uid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag, l_quantity) - 1 as pos,
-(l_tax * 10 + 0.1) as lp, -(l_discount * 10 + 0.1) as old, case when l_returnflag <> 'R' then 1.0::double else 0.0::double end as m, l_quantity / 50 as r, l_tax * 5 as v, (l_quantity - 25.5) / 15 as a, 0.3 + l_discount as s2 from lineitem)"""
SEQ = "seq as (select seq, uid, sum(r) as score, sum(m) as len, count(*) as size from tok group by seq, uid)"
GRP = "grp as (select uid, count(*) as n, case when count(*) = 1 then 0 else avg(score) end as mu, case when count(*) = 1 then 1 else stddev_samp(score) end as sd from seq group by uid)"


def rollouts(spark, sf: str) -> DataFrame:
    """One row per order: seq, uid, and the arrays rewards, values, mask, logp, old_logp, advantages, sum_pi_squared."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    tok = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_quantity", (q / 50).alias("r"), (t * 5).alias("v"), F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0).alias("m"), (-(t * 10 + 0.1)).alias("lp"), (-(d * 10 + 0.1)).alias("old"), ((q - 25.5) / 15).alias("a"), (d + 0.3).alias("s2"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.array_sort(F.collect_list(tok)).alias("t"))
    names = {"rewards": "r", "values": "v", "mask": "m", "logp": "lp", "old_logp": "old", "advantages": "a", "sum_pi_squared": "s2"}
    return g.select("seq", (F.col("seq") % GROUPS).alias("uid"), *[F.transform("t", A.field(k)).alias(n) for n, k in names.items()])


def by_token(df: DataFrame, column: str = "advantages") -> DataFrame:
    """One row per token: seq, pos and the array's value there."""
    return df.select("seq", F.posexplode(column).alias("pos", "x")).select("seq", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"))


def _plain(value: str, more: str = "") -> str:
    return f"with {TOK}, {SEQ}, {GRP}{more} select tok.seq, pos, round(({value}) * m, 6) + 0.0 as value from tok join seq using (seq, uid) join grp using (uid)"


def _whitened(value: str, more: str = "") -> str:
    return f"""with {TOK}, {SEQ}, {GRP}{more}, x as (select seq, len, ({value}) as x from seq join grp using (uid)), w as (select sum(x * len) / (sum(len) + 1e-8) as mu, sum(len) as k from x),
z as (select sum((x - mu) * (x - mu) * len) / (max(k) + 1e-8) * max(k) / greatest(max(k) - 1, 1) as var from x, w) select tok.seq, pos, round((x - mu) / sqrt(var + 1e-8) * m, 6) + 0.0 as value from tok join x using (seq), w, z"""


@query(_plain("(score - mu) / (sd + 1e-6)"))
def grpo(spark, sf):
    return by_token(adv.grpo(rollouts(spark, sf)))


@query(_plain("score - mu"))
def grpo_unscaled(spark, sf):
    return by_token(adv.grpo(rollouts(spark, sf), by_std=False))


@query(_plain("(score - mu) / (case when n = 1 then 1 else sqrt(greatest(sd * sd, 1e-6)) end + 1e-6)"))
def grpo_vectorized(spark, sf):
    return by_token(adv.grpo(rollouts(spark, sf), floor=True))


@query(_whitened("(score - mu) / (sd + 1e-6) + 0.5 * (size - mu2) / (sd2 + 1e-6)", ", g2 as (select uid as uid2, case when count(*) = 1 then 0 else avg(size) end as mu2, case when count(*) = 1 then 1 else stddev_samp(size) end as sd2 from seq group by uid)").replace("from seq join grp using (uid))", "from seq join grp using (uid) join g2 on uid2 = uid)"))
def gdpo(spark, sf):
    d = rollouts(spark, sf).withColumn("reward", A.total(F.col("rewards"))).withColumn("length", F.size("rewards").cast("double"))
    return by_token(adv.gdpo(d, {"reward": 1.0, "length": 0.5}))


@query(f"""with {TOK}, {SEQ}, r as (select *, row_number() over (partition by uid order by score desc, seq) as k, lead(score) over (partition by uid order by score desc, seq) as nxt, stddev_samp(score) over (partition by uid) as sd from seq)
select tok.seq, pos, round(case when k = 1 then (score - nxt) / (sd + 1e-6) * m else 0 end, 6) + 0.0 as value from tok join r using (seq)""")
def pass_k(spark, sf):
    return by_token(adv.pass_k(rollouts(spark, sf), "seq"))


@query(_whitened("score - mu"))
def reinforce_baseline(spark, sf):
    return by_token(adv.baseline(rollouts(spark, sf)))


@query(_plain("case when n > 1 then (score - mu) * n / (n - 1) else score end"))
def rloo(spark, sf):
    return by_token(adv.rloo(rollouts(spark, sf)))


@query(_plain("case when n > 1 then (n * score - mu * n) / (n - 1) else 0 end"))
def rloo_vectorized(spark, sf):
    return by_token(adv.rloo_vectorized(rollouts(spark, sf)))


@query(_plain("score - base", ", g2 as (select uid as u2, case when count(*) = 1 then 0 else sum(len * score) / sum(len) end as base from seq group by uid)").replace("join grp using (uid)", "join grp using (uid) join g2 on u2 = uid"))
def opo(spark, sf):
    return by_token(adv.opo(rollouts(spark, sf)))


@query(_plain("alpha * (score - mu)", ", al as (select count(*) / greatest(sum((score <> 0)::int), 1)::double as alpha from seq)").replace("join grp using (uid)", "join grp using (uid) cross join al"))
def gpg(spark, sf):
    return by_token(adv.gpg(rollouts(spark, sf)))


@query(f"""with recursive {TOK}, n as (select seq, max(pos) as last from tok group by seq), g as (select t.seq, t.pos, t.m, t.r as g from tok t join n on n.seq = t.seq and n.last = t.pos
union all select t.seq, t.pos, t.m, t.r + 0.9 * g.g * g.m from g join tok t on t.seq = g.seq and t.pos = g.pos - 1), w as (select sum(g * m) / (sum(m) + 1e-8) as mu, sum(m) as k from g),
v as (select sum((g - mu) * (g - mu) * m) / (max(k) + 1e-8) * max(k) / (max(k) - 1) as var from g, w) select seq, pos, round((g - mu) / sqrt(var + 1e-8) * m, 6) + 0.0 as value from g, w, v""")
def reinforce(spark, sf):
    return by_token(adv.reinforce(rollouts(spark, sf), 0.9))


@query(f"with {TOK}, t as (select seq, pos, m, sum(r * m) over (partition by seq order by pos desc) as g from tok) select seq, pos, round(g - 0.5 * m, 6) + 0.0 as value from t")
def remax(spark, sf):
    return by_token(adv.remax(rollouts(spark, sf).withColumn("baseline", F.lit(0.5))))


@query(f"""with recursive {TOK}, n as (select seq, max(pos) as last from tok group by seq), g as (
select t.seq, t.pos, t.m, (t.r - t.v) * t.m as adv, t.v * t.m as nextv from tok t join n on n.seq = t.seq and n.last = t.pos
union all select t.seq, t.pos, t.m, (t.r + 0.99 * g.nextv - t.v + 0.99 * 0.95 * g.adv) * t.m + (1 - t.m) * g.adv, t.v * t.m + (1 - t.m) * g.nextv from g join tok t on t.seq = g.seq and t.pos = g.pos - 1),
w as (select sum(adv * m) / (sum(m) + 1e-8) as mu, sum(m) as k from g), v as (select sum((adv - mu) * (adv - mu) * m) / (max(k) + 1e-8) * max(k) / (max(k) - 1) as var from g, w)
select seq, pos, round((adv - mu) / sqrt(var + 1e-8), 6) + 0.0 as value from g, w, v""")
def gae(spark, sf):
    return by_token(adv.gae(rollouts(spark, sf), 0.99, 0.95))


@query(f"""with {TOK}, {SEQ}, t as (select tok.*, sum(r * m) over (partition by seq order by pos desc) as g, sum((1 - 2 * exp(old) + s2) * m) over (partition by seq order by pos) as w from tok),
b as (select uid, pos, sum(g * w * m) / (sum(w * m) + 1e-8) as b from t group by 1, 2), n as (select uid, count(*) as n, max(len) as l1 from seq group by 1),
l as (select seq.uid, sum((len = l1)::int) as top, max(case when len < l1 then len end) as l2 from seq join n on n.uid = seq.uid group by 1)
select t.seq, t.pos, round((t.g - case when n.n = 1 then 0 when seq.len = n.l1 and l.top = 1 and t.pos >= l.l2 then 0 else b.b end) * t.m, 6) + 0.0 as value
from t join seq on seq.seq = t.seq join b on b.uid = t.uid and b.pos = t.pos join n on n.uid = t.uid join l on l.uid = t.uid""")
def optimal_token_baseline(spark, sf):
    return by_token(adv.token_baseline(rollouts(spark, sf), "seq"))


@query(f"""with {TOK}, t as (select *, row_number() over (partition by seq order by pos) - 1 as q, sum(r) over (partition by seq order by pos desc) as g, sum(1 - 2 * exp(old) + s2) over (partition by seq order by pos) as w from tok where m > 0), n as (select uid, seq, count(*) as len from t group by 1, 2),
b as (select uid, q, sum(g * w) / (sum(w) + 1e-8) as b from t group by 1, 2), u as (select uid, count(*) as n, max(len) as l1 from n group by 1), l as (select n.uid, sum((len = l1)::int) as top, max(case when len < l1 then len end) as l2 from n join u on u.uid = n.uid group by 1),
a as (select t.seq, t.pos, t.g - case when u.n = 1 then 0 when n.len = u.l1 and l.top = 1 and t.q >= l.l2 then 0 else b.b end as x from t join n on n.seq = t.seq join b on b.uid = t.uid and b.q = t.q join u on u.uid = t.uid join l on l.uid = t.uid)
select s.seq, s.pos, round(coalesce(a.x, 0), 6) + 0.0 as value from tok s left join a on a.seq = s.seq and a.pos = s.pos""")
def multi_turn_token_baseline(spark, sf):
    return by_token(adv.token_baseline_turns(rollouts(spark, sf), "seq"))


@query(f"with {TOK} select seq, pos, round(r - 0.05 * (lp - old) * m, 6) + 0.0 as value, round(sum((lp - old) * m) over s / (sum(m) over s + 1e-8), 6) + 0.0 as kl from tok window s as (partition by seq)")
def penalised_rewards(spark, sf):
    d = losses.penalised_rewards(rollouts(spark, sf).withColumn("scores", F.col("rewards")), "scores", "old_logp", 0.05)
    return d.select("seq", "kl", F.posexplode("rewards").alias("pos", "x")).select("seq", F.col("pos").cast("long").alias("pos"), r6("x").alias("value"), r6("kl").alias("kl"))


@query("select event_type as variant, count(*) as rows, round(avg(value), 6) + 0.0 as value_mean, round(stddev_pop(value), 6) + 0.0 as value_std, count(distinct user_id) as paths from events group by 1")
def variant_stats(spark, sf):
    d = metrics.by_variant(table(spark, sf, "events").withColumnRenamed("event_type", "variant"), "variant", ["value"], "user_id")
    return d.select("variant", "rows", r6("value_mean").alias("value_mean"), r6("value_std").alias("value_std"), "paths")


@query("with p as (select user_id, event_type, min(event_id) as event_id from events where value > 0 group by 1, 2) select user_id, event_type, event_id from p order by event_id limit 100")
def positive_samples(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return metrics.positive_samples(d, "value", ["user_id", "event_type"], "event_id", 100).select("user_id", "event_type", "event_id")


# losses ---------------------------------------------------------------------------------------------------------------


def _token_mean(value: str) -> str:
    return f"with {TOK}, l as (select m, {value} as x from tok) select round(sum(x * m) / sum(m), 6) + 0.0 as value from l"


def _seq_mean(value: str, src: str = "tok") -> str:
    return f"with {TOK}, sr as (select seq, exp(least(sum((lp - old) * m) / greatest(sum(m), 1), 10)) as ratio from tok group by seq), l as (select tok.seq, m, {value} as x from tok join sr on sr.seq = tok.seq), s as (select seq, sum(x * m) / (sum(m) + 1e-8) as x from l group by seq having sum(m) > 0) select round(avg(x), 6) + 0.0 as value from s"


_R = "exp(greatest(least(lp - old, 20), -20))"
_CLIP = f"greatest(-a * {_R}, -a * greatest(least({_R}, 1.2), 0.8))"


def _loss(spark, sf, name: str, mode: str = "token-mean", **options) -> DataFrame:
    d = losses.aggregate(losses.token_loss(rollouts(spark, sf), name, **options), mode=mode)
    return d.select(r6("value").alias("value"))


@query(_token_mean(f"case when a < 0 then least(-a * 3.0, {_CLIP}) else {_CLIP} end"))
def loss_ppo_clip(spark, sf):
    return _loss(spark, sf, "vanilla")


@query(_token_mean(f"-a * least({_R}, 20) * lp * (case when a > 0 then exp(lp) - exp(old) <= 0.2 else exp(lp) - exp(old) >= -0.2 end)::int"))
def loss_dppo_tv(spark, sf):
    return _loss(spark, sf, "dppo_tv")


_BKL = "(exp(old) * (old - lp) + (1 - exp(old)) * ln((1 - exp(old) + 1e-8) / (1 - exp(lp) + 1e-8)))"


@query(_token_mean(f"-a * least({_R}, 20) * lp * (case when a > 0 then {_BKL} <= 0.2 or exp(lp) <= exp(old) else {_BKL} <= 0.2 or exp(lp) >= exp(old) end)::int"))
def loss_dppo_kl(spark, sf):
    return _loss(spark, sf, "dppo_kl")


@query(_seq_mean("greatest(-a * ratio, -a * greatest(least(ratio, 1.2), 0.8))"))
def loss_gspo(spark, sf):
    return _loss(spark, sf, "gspo", "seq-mean-token-mean")


_TAU = "(case when a > 0 then 1.0 else 1.05 end)"


@query(_seq_mean(f"-a * (4.0 / {_TAU}) / (1 + exp(-{_TAU} * ({_R} - 1)))"))
def loss_sapo(spark, sf):
    return _loss(spark, sf, "sapo", "seq-mean-token-mean")


@query(_token_mean("-lp * a"))
def loss_gpg(spark, sf):
    return _loss(spark, sf, "gpg")


@query(_token_mean(f"-greatest(least({_R}, 1.2), 0.8) * a * lp"))
def loss_cispo(spark, sf):
    return _loss(spark, sf, "cispo")


@query(_token_mean(f"-{_R} * a * lp"))
def loss_reinforce(spark, sf):
    return _loss(spark, sf, "reinforce")


@query(f"""with {TOK}, t as (select seq, m, a, sign(a) * least(sign(a) * (lp - old), sign(a) * greatest(least(lp - old, 0.4), -0.4)) as d from tok), s as (select seq, sum(a * m) / (sum(m) + 1e-8) as a, exp(sum(d * m) / (sum(m) + 1e-8)) as r from t group by seq) select round(avg(-a * r), 6) + 0.0 as value from s""")
def loss_gmpo(spark, sf):
    return losses.geometric_mean_loss(rollouts(spark, sf)).select(r6("value").alias("value"))


_COV = f"{TOK}, c as (select *, (a - avg(a) over ()) * (lp - avg(lp) over ()) as cov from tok where m > 0)"


@query(f"""with {_COV}, l as (select *, greatest(-a * exp(lp - old), -a * greatest(least(exp(lp - old), 1.2), 0.8)) as l, (-a * greatest(least(exp(lp - old), 1.2), 0.8) <= -a * exp(lp - old)) and cov > 0.05 and cov < 0.5 as free, count(*) over () as n, sha256('clip:' || seq::varchar || ':' || pos::varchar) as h from c),
k as (select *, free and row_number() over (partition by free order by h) <= greatest(floor(n * 0.01), 1) as hit from l) select round(sum(case when hit then 0 else l end) / count(*), 6) + 0.0 as value, sum(hit::int)::bigint as clipped from k""")
def loss_clip_cov(spark, sf):
    d = losses.covariance_clip(rollouts(spark, sf), "seq", share=0.01, lo=0.05, hi=0.5)
    return d.select(r6("value").alias("value"), "clipped")


@query(f"""with {_COV}, k as (select *, row_number() over (order by cov desc, seq, pos) as rk, count(*) over () as n from c) select round(sum(-a * exp(lp - old) + case when rk <= greatest(floor(n * 0.01), 1) then abs(lp - old) else 0 end) / count(*), 6) + 0.0 as value, sum((rk <= greatest(floor(n * 0.01), 1))::int)::bigint as penalised from k""")
def loss_kl_cov(spark, sf):
    d = losses.covariance_kl(rollouts(spark, sf), "seq", share=0.01)
    return d.select(r6("value").alias("value"), "penalised")


@query(_token_mean("0.5 * greatest(power(lp + 1 - r, 2), power(greatest(least(lp + 1, v + 0.1), v - 0.1) - r, 2))"))
def value_loss(spark, sf):
    d = rollouts(spark, sf).withColumn("pred", F.transform("logp", lambda x: x + 1.0))
    return losses.aggregate(losses.value_loss(d, "pred", "values", "rewards", 0.1)).select(r6("value").alias("value"))


@query(f"""with {TOK}, l as (select seq, sum(-lp * m) as s, sum(m) as k, count(*) as len from tok group by seq) select round(sum(s) / sum(k), 6) + 0.0 as token_mean, round(sum(case when k > 0 then s end) / sum((k > 0)::int), 6) + 0.0 as seq_sum,
round(sum(case when k > 0 then s end) / sum((k > 0)::int) / max(len), 6) + 0.0 as seq_sum_norm, round(sum(case when k > 0 then s / (k + 1e-8) end) / sum((k > 0)::int), 6) + 0.0 as seq_mean from l""")
def loss_modes(spark, sf):
    d = rollouts(spark, sf).withColumn("loss", F.transform("logp", lambda x: -x))
    out = None
    for mode, name in (("token-mean", "token_mean"), ("seq-mean-token-sum", "seq_sum"), ("seq-mean-token-sum-norm", "seq_sum_norm"), ("seq-mean-token-mean", "seq_mean")):
        one = losses.aggregate(d, mode=mode, out=name).select(r6(name).alias(name))
        out = one if out is None else out.join(one)  # one row each
    return out


@query(f"""with {TOK}, s as (select uid % 3 as kind, sum(-lp * m) * (1 + uid % 3) as s, sum(m) as k from tok group by seq, uid) select kind, sum(k)::double as tokens, round(sum(s), 4) + 0.0 as nll_sum, round(sum(s) / sum(k), 6) + 0.0 as nll from s group by kind""")
def weighted_nll(spark, sf):
    d = rollouts(spark, sf).withColumn("kind", F.col("uid") % 3)
    g = losses.nll(d, ["kind"], F.col("kind") + 1)
    return g.select("kind", "tokens", (F.round("nll_sum", 4) + F.lit(0.0)).alias("nll_sum"), r6("nll").alias("nll"))


@query(f"""with {TOK}, t as (select *, (uid % 2)::double as p from tok), s as (select sum({_CLIP} * m * (1 - p)) as on_, sum(-a * exp(lp) / (exp(lp) + 0.1) * m * p) as off_, sum(m * (1 - p)) as k0, sum(m * p) as k1 from t)
select round(on_ / k0, 6) + 0.0 as on_loss, round(off_ / k1, 6) + 0.0 as off_loss, round((on_ + off_) / (k0 + k1), 6) + 0.0 as value, round(k1 / (k0 + k1), 6) + 0.0 as off_share from s""")
def mixed_policy_loss(spark, sf):
    d = rollouts(spark, sf).withColumn("prefix", F.transform("mask", lambda m: (F.col("uid") % 2).cast("double")))
    return losses.mixed_policy(d, "prefix").select(*[r6(c).alias(c) for c in ("on_loss", "off_loss", "value", "off_share")])


# corrections and metrics ----------------------------------------------------------------------------------------------


@query(f"with {TOK}, t as (select seq, pos, m, least(exp(greatest(least(lp - old, 20), -20)) * m, 2.0) as w from tok), n as (select sum(w * m) / (sum(m) + 1e-8) as mu from t) select seq, pos, round(w / mu, 6) + 0.0 as value from t, n")
def importance_weights(spark, sf):
    return by_token(losses.importance_weights(rollouts(spark, sf), "token", 2.0, normalise=True), "weights")


@query(f"with {TOK}, s as (select seq, exp(greatest(least(sum((lp - old) * m), 20), -20)) as w from tok group by seq) select tok.seq, pos, round(least(w * m, 2.0), 6) + 0.0 as value from tok join s using (seq)")
def sequence_importance_weights(spark, sf):
    return by_token(losses.importance_weights(rollouts(spark, sf), "sequence", 2.0), "weights")


@query(f"""with {TOK}, s as (select seq, sum((exp(lp - old) - 1 - (lp - old)) * m) / (sum(m) + 1e-8) as k3 from tok group by seq),
k as (select tok.seq, pos, m, case when -(lp - old) >= ln(0.7) and -(lp - old) <= ln(1.4) and k3 <= 0.05 then m else 0 end as kept from tok join s on s.seq = tok.seq) select seq, pos, kept::double as value from k""")
def rejection_masks(spark, sf):
    d = losses.rejection_mask(rollouts(spark, sf), ["token_k1", "seq_mean_k3"], "0.7_1.4,0.05")
    return by_token(d, "kept")


@query(f"""with {TOK}, t as (select seq, m, lp - old as d, 0.5 * (lp - old) * (lp - old) as k2, exp(lp - old) - 1 - (lp - old) as k3 from tok), s as (select seq, sum(m) as k, sum(-d * m) as s1, coalesce(max(case when m > 0 then k3 end), 0) as m3 from t group by seq),
k as (select t.seq, t.m, case when k2 <= 0.05 and s1 >= ln(0.5) and s1 <= ln(2) and m3 <= 0.2 then m else 0 end as kept from t join s using (seq)), q as (select sum(m - kept) as lost, sum(m) as n, (sum(m - kept) > 0)::int as hit from k group by seq),
a as (select sum(lost) / (sum(n) + 1e-8) as masked_fraction, avg(hit) as seq_masked_fraction from q), b as (select avg(k2) as token_k2_mean, max(k2) as token_k2_max, min(k2) as token_k2_min, avg((k2 > 0.05)::int) as token_k2_out from t where m > 0),
c as (select avg(s1) as seq_sum_k1_mean, max(s1) as seq_sum_k1_max, min(s1) as seq_sum_k1_min, avg((s1 < ln(0.5) or s1 > ln(2))::int) as seq_sum_k1_out, avg(m3) as seq_max_k3_mean, max(m3) as seq_max_k3_max, min(m3) as seq_max_k3_min, avg((m3 > 0.2)::int) as seq_max_k3_out from s where k > 0)
select round(columns(*), 6) + 0.0 from a, b, c""")
def rejection_metrics(spark, sf):
    options, spec = ["token_k2", "seq_sum_k1", "seq_max_k3"], "0.05,0.5_2,0.2"
    d = metrics.rejection_metrics(losses.rejection_mask(rollouts(spark, sf), options, spec), options, spec)
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query(f"""with {TOK}, t as (select m, -(lp - old) * m as kl, (-a * greatest(least({_R}, 1.2), 0.8) > -a * {_R})::int * m as c, (a < 0 and {_CLIP} > -a * 3.0)::int * m as l from tok)
select round(sum(c) / (sum(m) + 1e-8), 6) + 0.0 as clip_fraction, round(sum(l) / (sum(m) + 1e-8), 6) + 0.0 as clip_fraction_lower, round(sum(kl) / (sum(m) + 1e-8), 6) + 0.0 as ppo_kl from t""")
def clip_fractions(spark, sf):
    d = metrics.clip_fractions(rollouts(spark, sf))
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query(f"""with {TOK}, k as (select *, case when -(lp - old) >= ln(0.7) and -(lp - old) <= ln(1.4) then m else 0 end as kept from tok), c as (select sum((case when a < 0 then least(-a * 3.0, {_CLIP}) else {_CLIP} end) * kept) / sum(kept) as clip from k), r as (select sum(-lp * a * least(exp(lp - old) * m, 2.0) * kept) / sum(kept) as reinforce from k)
select round(clip, 6) + 0.0 as ppo_clip, round(reinforce, 6) + 0.0 as reinforce from c, r""")
def bypass_losses(spark, sf):
    d = rollouts(spark, sf)
    a = losses.bypass(d, "ppo_clip", options=["token_k1"], spec="0.7_1.4").select(r6("value").alias("ppo_clip"))
    b = losses.bypass(d, "reinforce", "token", 2.0, options=["token_k1"], spec="0.7_1.4").select(r6("value").alias("reinforce"))
    return a.join(b)  # one row each


@query(f"""with {TOK}, e as (select seq, uid % 5 as variant, sum(s2 * m) / greatest(sum(m), 1) as e from tok group by 1, 2) select variant, round(avg(e), 6) + 0.0 as entropy_mean, round(stddev_pop(e), 6) + 0.0 as entropy_std from e group by 1""")
def variant_entropy(spark, sf):
    d = metrics.variant_entropy(rollouts(spark, sf).withColumn("variant", F.col("uid") % 5), "variant", "sum_pi_squared")
    return d.select("variant", r6("entropy_mean").alias("entropy_mean"), r6("entropy_std").alias("entropy_std"))


@query(f"""with {TOK}, r as (select seq, max((uid % 4 = 0)::int) as taught, sum((uid % 4 = 0)::int * m) as tt, sum(m) as k, case when max(uid) % 7 = 0 then 'miss' when max(uid) % 7 = 1 then 'fallback_random' else 'id' end as status from tok group by seq)
select count(*) as sampled_rows, count(*) filter (where status not in ('miss', 'unknown')) as matched_rows, count(*) filter (where status = 'miss') as miss_rows, count(*) filter (where status = 'fallback_random') as fallback_rows, round(count(*) filter (where status = 'miss') / count(*), 6) + 0.0 as miss_fraction,
round(count(*) filter (where status = 'fallback_random') / count(*), 6) + 0.0 as fallback_fraction, sum(taught)::bigint as teacher_rows, round(sum(taught) / count(*), 6) + 0.0 as teacher_row_fraction, sum(tt)::double as teacher_tokens, round(sum(tt) / sum(k), 6) + 0.0 as teacher_token_fraction from r""")
def sampling_stats(spark, sf):
    d = rollouts(spark, sf).withColumn("prefix", F.transform("mask", lambda m: (F.col("uid") % 4 == 0).cast("double")))
    d = d.withColumn("status", F.when(F.col("uid") % 7 == 0, "miss").when(F.col("uid") % 7 == 1, "fallback_random").otherwise("id"))
    s = metrics.sampling_stats(d, "status", "prefix")
    return s.select(*[r6(c).alias(c) if c.endswith("fraction") else F.col(c) for c in s.columns])


@query("select coalesce(nullif(trim(call_status), ''), 'unknown') as status, count(*) as rows, round(count(*) / (select count(*) from call_log)::double, 9) + 0.0 as fraction from call_log group by 1")
def match_status(spark, sf):
    d = metrics.match_status(table(spark, sf, "call_log"), "call_status")
    return d.select("status", "rows", (F.round("fraction", 9) + F.lit(0.0)).alias("fraction"))


@query("select category, count(*) as rows, round(avg(case when not isnan(judge_process_reward) then judge_process_reward end), 6) + 0.0 as judge_process_reward, round(avg(query_index), 6) + 0.0 as query_index from teacher_rows group by 1")
def category_means(spark, sf):
    d = metrics.category_means(table(spark, sf, "teacher_rows"), "category", ["judge_process_reward", "query_index"])
    return d.select("category", "rows", r6("judge_process_reward").alias("judge_process_reward"), r6("query_index").alias("query_index"))


@query(f"""with {TOK}, t as (select exp(greatest(least(lp - old, 20), -20)) as w from tok where m > 0), c as (select w, least(greatest(w, 0.5), 2.0) as c from t), n as (select *, count(*) over () + 1e-8 as k from c), s as (select sum(w) / max(k) as mean, max(w) as mx, min(w) as mn, avg((w > 2)::int) as hi, avg((w < 0.5)::int) as lo, sum(c) / max(k) as mc, sum(c * c) / max(k) as qc from n)
select round(mean, 6) + 0.0 as is_mean, round(mx, 6) + 0.0 as is_max, round(mn, 6) + 0.0 as is_min, round(hi, 6) + 0.0 as fraction_high, round(lo, 6) + 0.0 as fraction_low, round(sqrt(greatest(qc - mc * mc, 0)), 6) + 0.0 as is_std, round((mc + 1e-8) * (mc + 1e-8) / qc, 6) + 0.0 as eff_sample_size from s""")
def importance_metrics(spark, sf):
    d = metrics.importance_metrics(rollouts(spark, sf))
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query(f"""with {TOK}, s as (select seq, sum(m) as k, sum(old * m) / (sum(m) + 1e-8) as mt, sum(lp * m) / (sum(m) + 1e-8) as mr, sum((old - lp) * m) as sd, sum((exp(old - lp) - (old - lp) - 1) * m) as k3, sum(exp(2 * (old - lp)) * m) as r2 from tok group by seq)
select round(avg(exp(-mt)), 6) + 0.0 as training_ppl, round(avg(-mt), 6) + 0.0 as training_log_ppl, round(-sum(sd) / (sum(k) + 1e-8), 6) + 0.0 as kl, round(sum(k3) / (sum(k) + 1e-8), 6) + 0.0 as k3_kl, round(avg(exp(-mr)), 6) + 0.0 as rollout_ppl, round(avg(-mr), 6) + 0.0 as rollout_log_ppl,
round(avg(mr - mt), 6) + 0.0 as log_ppl_diff, round(avg(abs(mr - mt)), 6) + 0.0 as log_ppl_abs_diff, round(max(mr - mt), 6) + 0.0 as log_ppl_diff_max, round(min(mr - mt), 6) + 0.0 as log_ppl_diff_min, round(avg(exp(mr - mt)), 6) + 0.0 as ppl_ratio,
round(sum(r2) / (sum(k) + 1e-8) - 1, 6) + 0.0 as chi2_token, round(avg(exp(2 * sd)) - 1, 6) + 0.0 as chi2_seq from s""")
def off_policy_metrics(spark, sf):
    d = metrics.off_policy_metrics(rollouts(spark, sf))
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query(f"""with {TOK}, s as (select seq, sum(r) as score, sum(m) as len from tok group by seq), a as (select avg(case when len > 0 then score end) as score_mean, max(case when len > 0 then score end) as score_max, min(case when len > 0 then score end) as score_min, avg(len) as length_mean, max(len) as length_max, min(len) as length_min, avg((len = 4)::int) as length_clip_ratio, avg(case when len > 0 then len end) as live_length_mean, avg((len = 0)::int) as aborted_ratio from s),
t as (select avg(a) as advantages_mean, max(a) as advantages_max, min(a) as advantages_min, avg(r) as returns_mean, max(r) as returns_max, min(r) as returns_min, avg(v) as values_mean, max(v) as values_max, min(v) as values_min, 1 - var_samp(r - v) / (var_samp(r) + 1e-5) as explained_variance from tok where m > 0)
select round(columns(*), 6) + 0.0 from a, t""")
def data_metrics(spark, sf):
    d = metrics.data_metrics(rollouts(spark, sf).withColumn("returns", F.col("rewards")), 4)
    return d.select(*[r6(c).alias(c) for c in d.columns])


@query(f"""with {TOK}, s as (select seq, sum(a * m) / (sum(m) + 1e-8) as a, sum((1 - 2 * exp(old) + s2) * m) as w from tok group by seq), g as (select count(*) as n, avg(a * a * greatest(w, 0)) as tp, avg(a * a) as ea, avg(w) as ew from s)
select 0.25::double as signal_strength, round(tp, 6) + 0.0 as total_power, round(greatest(0, (tp - 0.25) / (n - 1)), 9) + 0.0 as pure_noise, round(ea, 6) + 0.0 as expected_a_squared, round(ew, 6) + 0.0 as expected_w from g""")
def variance_proxy(spark, sf):
    d = metrics.variance_proxy(rollouts(spark, sf), 0.5)
    return d.select("signal_strength", r6("total_power").alias("total_power"), (F.round("pure_noise", 9) + F.lit(0.0)).alias("pure_noise"), r6("expected_a_squared").alias("expected_a_squared"), r6("expected_w").alias("expected_w"))


@query(f"""with {TOK}, x as (select m, lp - old as k1, abs(lp - old) as ab, 0.5 * (lp - old) * (lp - old) as k2, greatest(least(exp(greatest(least(old - lp, 20), -20)) - greatest(least(old - lp, 20), -20) - 1, 10), -10) as k3 from tok)
select round(sum(k1 * m) / sum(m), 6) + 0.0 as k1, round(sum(ab * m) / sum(m), 6) + 0.0 as abs, round(sum(k2 * m) / sum(m), 6) + 0.0 as k2, round(sum(k3 * m) / sum(m), 6) + 0.0 as k3 from x""")
def kl_estimators(spark, sf):
    d = rollouts(spark, sf)
    sums = [A.masked_sum(F.zip_with("logp", "old_logp", A.kl_of(k)), F.col("mask")).alias(k) for k in ("k1", "abs", "k2", "k3")]
    return d.select(A.total(F.col("mask")).alias("n"), *sums).agg(*[r6(F.sum(k) / F.sum("n")).alias(k) for k in ("k1", "abs", "k2", "k3")])


@query("""with v as (select event_type as source, user_id as uid, variable, v from (select event_type, user_id, 'value' as variable, value as v from events union all select event_type, user_id, 'half', value / 2 from events where event_id % 2 = 0) where v is not null and not isnan(v) and abs(v) < 'infinity'::double),
e as (select *, row_number() over (partition by source, uid, variable order by v) as i, count(*) over (partition by source, uid, variable) as m from v),
g as (select source, uid, variable, max(m) as n, avg(v) as mean, stddev_pop(v) as sd from e group by 1, 2, 3), k as (select source, uid, variable, n, unnest(list_distinct(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda x: x < n), n))) as k from g where n > 1),
w as (select k.source, k.uid, k.variable, k.k, v, power(i / m::double, k) - power((i - 1) / m::double, k) as wb, power(1 - (i - 1) / m::double, k) - power(1 - i / m::double, k) as ww from k join e using (source, uid, variable)),
b as (select source, uid, variable, k, sum(v * wb) as best, sum(v * ww) as worst from w group by 1, 2, 3, 4), d as (select source, uid, variable, k, sqrt(sum((v - best) * (v - best) * wb)) as bs, sqrt(sum((v - worst) * (v - worst) * ww)) as ws from w join b using (source, uid, variable, k) group by 1, 2, 3, 4),
x as (select source, variable, 'mean@' || n as metric, mean as v from g union all select source, variable, 'std@' || n, sd from g where n > 1 union all select source, variable, 'best@' || k || '/mean', best from b union all select source, variable, 'worst@' || k || '/mean', worst from b
union all select source, variable, 'best@' || k || '/std', bs from d union all select source, variable, 'worst@' || k || '/std', ws from d)
select source, variable, metric, round(avg(v), 9) + 0.0 as value, count(*) as uids from x group by 1, 2, 3""")
def validation_metrics(spark, sf):
    d = table(spark, sf, "events").withColumn("half", F.when(F.col("event_id") % 2 == 0, F.col("value") / 2))
    m = metrics.validation_metrics(d, "event_type", "user_id", ["value", "half"])
    return m.select(F.col("event_type").alias("source"), "variable", "metric", (F.round("value", 9) + F.lit(0.0)).alias("value"), "uids")  # nine places: means of 16 values of two places end in a 5 at the seventh


@query()
def validation_votes(spark, sf):
    """maj@n besides the other metrics, with the props of an event as its vote."""
    return metrics.validation_metrics(table(spark, sf, "events"), "event_type", "user_id", "value", "props", "event_id", draws=200).filter("metric like 'maj@%'")


@query()
def bootstrap_extremes(spark, sf):
    return metrics.bootstrap_by(table(spark, sf, "events"), "user_id", "value", 4, draws=200)


@query("""with g as (select user_id, event_type, count(*) as n, min(event_id) as o, arg_min(value, event_id) as v from events group by 1, 2) select user_id, event_type, round(v, 6) + 0.0 as value from g qualify row_number() over (partition by user_id order by n desc, o) = 1""")
def majority_values(spark, sf):
    d = metrics.majority_value(table(spark, sf, "events"), ["user_id"], "event_type", "value", "event_id")
    return d.select("user_id", "event_type", r6("value").alias("value"))


@query("select round(avg(v), 6) + 0.0 as judge_process_reward_mean, max(v) as judge_process_reward_max, min(v) as judge_process_reward_min, round(stddev_pop(v), 6) + 0.0 as judge_process_reward_std from (select judge_process_reward as v from teacher_rows where judge_process_reward is not null and not isnan(judge_process_reward))")
def finite_rewards(spark, sf):
    d = metrics.finite_stats(table(spark, sf, "teacher_rows"), ["judge_process_reward"])
    return d.select(r6("judge_process_reward_mean").alias("judge_process_reward_mean"), "judge_process_reward_max", "judge_process_reward_min", r6("judge_process_reward_std").alias("judge_process_reward_std"))


@query("select max(l_quantity) as max_quantity, min(l_discount) as min_discount, round(avg(l_tax), 6) + 0.0 as tax from lineitem")
def name_reduced(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("max_quantity"), F.col("l_discount").alias("min_discount"), F.col("l_tax").alias("tax"))
    return metrics.reduced(d, ["max_quantity", "min_discount", "tax"]).select("max_quantity", "min_discount", r6("tax").alias("tax"))


@query("""with s as (select (event_id // 100)::bigint as step, count(*) as n, avg(value) as a, sum(value) as b, max(value) as c, min(value) as d, arg_max(value, event_id) as e, avg(value) as f from events where event_type <> 'view' group by 1)
select round(avg(a), 6) + 0.0 as a, round(sum(b), 4) + 0.0 as b, max(c) as c, min(d) as d, arg_max(e, step) as e, round(sum(f * n) / sum(n), 6) + 0.0 as f from s""")
def over_steps(spark, sf):
    s = table(spark, sf, "events").filter("event_type <> 'view'").groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.count("*").alias("n"), F.avg("value").alias("a"), F.sum("value").alias("b"), F.max("value").alias("c"), F.min("value").alias("d"), F.max_by("value", "event_id").alias("e"), F.avg("value").alias("f"))
    d = metrics.over_steps(s, {"a": "avg", "b": "sum", "c": "max", "d": "min", "e": "last", "f": "weighted_avg"}, "n", "step")
    return d.select(r6("a").alias("a"), (F.round("b", 4) + F.lit(0.0)).alias("b"), "c", "d", "e", r6("f").alias("f"))


@query("""select count(*) as rows, sum(token_usage.total_tokens)::bigint as tokens, round(quantile_cont(elapsed_seconds, 0.5), 6) + 0.0 as p50, round(quantile_cont(elapsed_seconds, 0.95), 6) + 0.0 as p95, round(quantile_cont(elapsed_seconds, 0.99), 6) + 0.0 as p99,
max(num_variants) - min(num_variants) as version_span, count(distinct num_variants) as versions from call_log""")
def assembly_stats(spark, sf):
    d = table(spark, sf, "call_log").withColumn("tokens", F.col("token_usage.total_tokens").cast("long"))
    return metrics.assembly_stats(d, "elapsed_seconds", "num_variants", "tokens").select("rows", "tokens", *[r6(c).alias(c) for c in ("p50", "p95", "p99")], "version_span", "versions")


@query("with r as (select l_orderkey, l_returnflag as f, avg(l_quantity) as s from lineitem group by 1, 2) select f as source, round(avg(s), 6) + 0.0 as score, count(*) as rows from r group by 1")
def eval_means(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("source")).agg(F.collect_list("l_quantity").alias("scores"))
    return metrics.eval_means(d, "source", "scores").select("source", r6("score").alias("score"), "rows")


@query("select doc_id, round(least(-(n_chars - 600) / 200.0::double * 1.0, 0), 6) + 0.0 as penalty from documents where n_chars is not null")
def overlong_penalty(spark, sf):
    d = table(spark, sf, "documents").filter("n_chars is not null")
    return d.select("doc_id", r6(grading.overlong_penalty(F.col("n_chars"), 800, 200, 1.0)).alias("penalty"))


@query("""select event_id, round(least(greatest(value / 53, 0), 1), 4) + 0.0 as existence, round(least(greatest(value / 79, 0), 1), 4) + 0.0 as process, round(least(greatest((value - 20) / 61, 0), 1), 4) + 0.0 as evaluation,
case when event_type = 'view' then 2.0 else 3.0 end::double as parts from events""")
def composed_rewards(spark, sf):
    v = F.col("value")
    r = grading.composed_reward(v / 53, v / 79, (v - 20) / 61, F.when(F.col("event_type") == "view", "no_op").otherwise("knowledge"), "all_components")
    return table(spark, sf, "events").select("event_id", *[(r[c] + F.lit(0.0)).alias(c) for c in ("existence", "process", "evaluation")], r["parts"].alias("parts"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding), 5) + 0.0 as mean from embeddings")
def embedding_means(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", (F.round(A.total(v) / F.size("embedding"), 5) + F.lit(0.0)).alias("mean"))
