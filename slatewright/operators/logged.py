"""Self-normalised inverse-propensity estimates and clustered bootstrap intervals."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import settle
from . import resampling

MIN_USERS = 3
#: Users times resamples that the driver draws.
MOST_UNITS = 8_000_000


def observations(interactions: DataFrame, as_of: int | None = None) -> DataFrame:
    """(user_id, reward, propensity) of events with a propensity; none is no evidence."""
    some = interactions.where(F.col("propensity").isNotNull())
    if as_of is not None:
        some = some.where(F.col("occurred_us") <= as_of)
    return some.select("user_id", F.when(F.col("kind").isin("click", "like"), 1.0).otherwise(0.0).alias("reward"), "propensity")


def summary(obs: DataFrame) -> DataFrame:
    """Estimate, effective sample size and largest weight share.  Weights are rescaled by
    the smallest propensity, which cancels."""
    least = obs.agg(F.min("propensity").alias("least"))
    w = obs.join(F.broadcast(least)).withColumn("w", F.col("least") / F.col("propensity"))
    total = F.sum("w")
    return w.agg(
        F.count("*").alias("observations"),
        F.count_distinct("user_id").alias("users"),
        F.coalesce(F.sum(F.col("reward") * F.col("w")) / total, F.lit(0.0)).alias("estimate"),
        F.coalesce(total * total / F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("effective_sample_size"),
        F.coalesce(F.max("w") / total, F.lit(0.0)).alias("largest_weight_share"),
    )


def user_totals(obs: DataFrame) -> DataFrame:
    """What a user adds to a resample: two sums, made once."""
    least = obs.agg(F.min("propensity").alias("least"))
    w = obs.join(F.broadcast(least)).withColumn("w", F.col("least") / F.col("propensity"))
    return w.groupBy("user_id").agg(F.sum(F.col("reward") * F.col("w")).alias("rewarded"), F.sum("w").alias("weight"))


def draws(n: int, samples: int, seed: int) -> list[list[int]]:
    """Positions drawn with replacement, sample by sample, from one seeded generator."""
    rng = random.Random(seed)
    return [[rng.randrange(n) for _ in range(n)] for _ in range(samples)]


def percentile(ordered: list[float], fraction: float) -> float:
    """Interpolated percentile of sorted values."""
    at = fraction * (len(ordered) - 1)
    low = int(at)
    high = min(low + (at > low), len(ordered) - 1)
    part = at - low
    return ordered[low] * (1.0 - part) + ordered[high] * part


def order_statistic_interval(ordered: list[float]) -> tuple[float, float]:
    """The 2.5 and 97.5 percent order statistics, outward, without interpolation."""
    n = len(ordered) - 1
    return ordered[int(0.025 * n)], ordered[-int(-(0.975 * n) // 1) if 0.975 * n % 1 else int(0.975 * n)]


def bootstrap_mean(values: list[float], samples: int = 1000, confidence: float = 0.95, seed: int = 17) -> tuple[float, float, float]:
    """(mean, lower, upper) by the percentile method."""
    import math

    if not values:
        return 0.0, 0.0, 0.0
    n = len(values)
    means = sorted(math.fsum(values[i] / n for i in one) for one in draws(n, samples, seed))
    tail = (1 - confidence) / 2
    return math.fsum(v / n for v in values), percentile(means, tail), percentile(means, 1 - tail)


def interval(spark: SparkSession, obs: DataFrame, *, confidence: float = 0.95, resamples: int = 1000, seed: int = 0) -> dict[str, object]:
    """Estimate with a user-clustered bootstrap interval; withheld, with a reason, below
    MIN_USERS users.  Users' totals (two numbers each) come to the driver, which makes the
    draws: exact parity needs one sequential generator.  Users times resamples over MOST_UNITS
    are an error."""
    facts = summary(obs).first().asDict()
    most = MOST_UNITS // max(resamples, 1)
    totals = [(r["rewarded"], r["weight"]) for r in user_totals(obs).orderBy("user_id").limit(most + 1).collect()]
    if len(totals) > most:
        raise ValueError(f"over {most} users by {resamples} resamples are more than the driver draws from; see resampled()")
    out = facts | {"lower": None, "upper": None, "confidence": confidence, "resamples": resamples}
    if not totals:
        return out | {"reason": "no logged event carried a propensity"}
    if len(totals) < MIN_USERS:
        return out | {"reason": f"{len(totals)} users are fewer than the {MIN_USERS} that a clustered bootstrap needs"}
    means = []
    for one in draws(len(totals), resamples, seed):
        rewarded, weight = sum(totals[i][0] for i in one), sum(totals[i][1] for i in one)
        means.append(rewarded / weight if weight > 0 else 0.0)
    means.sort()
    tail = (1 - confidence) / 2
    return out | {"lower": percentile(means, tail), "upper": percentile(means, 1 - tail), "reason": "clustered bootstrap over users"}


def resampled(spark: SparkSession, totals: DataFrame, samples: int, seed: int) -> DataFrame:
    """(draw, estimate) as a plan: multiplicities of a Poisson bootstrap by a hash of (draw, user),
    for user counts that a driver can't hold.  A different estimator from interval()'s."""
    u = (F.xxhash64("user_id", "draw", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")
    steps, p, acc = F.lit(0), 0.36787944117144233, 0.0
    for k in range(1, 9):
        acc += p
        p /= k
        steps = steps + F.when(F.col("u") >= acc, 1).otherwise(0)
    made = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("u", u).withColumn("times", steps)
    return made.groupBy("draw").agg((F.sum(F.col("rewarded") * F.col("times")) / F.sum(F.col("weight") * F.col("times"))).alias("estimate"))


def interval_plan(obs: DataFrame, *, confidence: float = 0.95, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """``interval`` as a plan, of one row, for any number of users: users, estimate, lower,
    upper, reason.  Its draws are multinomial like those of interval(), from another generator."""
    totals = settle(user_totals(obs))
    made = resampling.sums(totals, resamples, seed).select("draw", F.when(F.col("weight") > 0, F.col("rewarded") / F.col("weight")).otherwise(0.0).alias("estimate"))
    ends = resampling.interval(made, "estimate", confidence).agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    few = F.col("users") < MIN_USERS
    why = F.when(F.col("users") == 0, "no logged event carried a propensity").when(few, F.concat(F.col("users").cast("string"), F.lit(f" users are fewer than the {MIN_USERS} that a clustered bootstrap needs"))).otherwise("clustered bootstrap over users")
    one = summary(obs).select("users", "estimate").join(F.broadcast(ends))  # a row each
    return one.select("users", "estimate", *[F.when(~few, F.col(c)).alias(c) for c in ("lower", "upper")], why.alias("reason"))
