"""Exact best candidates without every user meeting every article.

The catalog becomes an index: articles of one class, that is of equal topics and source, have
the same interest for a user, so within a class they are in order of what doesn't depend on
the user (freshness, quality, popularity), their base, and that order is cut in levels of
growing size.  What a user's score adds to a base is bounded: interest is known for the class,
novelty and exploration are at most 1.

Users meet classes, not articles.  A user's n best of a class are not below the base of its
n-th unseen article by more than exploration can add, so deeper articles are not joined; for
the n best of all, classes whose best can't reach the user's n-th best class aren't either.
Where what is left of a class is larger than a level, levels are joined in rounds, and a pair
of a user and a class is closed when the n-th best so far is above the bound of what is left
(the threshold algorithm), after the logarithm of the largest class at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..functions.scalars import MICROS_PER_HOUR, exploration, exponential_decay, topic_interest
from ..tables import settle
from . import ranks, scoring

#: Articles of a class's first level, and how many times larger each level is than the one
#: before.
FIRST, GROWTH = 64, 4
#: More than the rounding of a score; scores this close to a bound are looked at.
MARGIN = 1e-9


def classes(catalog: DataFrame) -> DataFrame:
    """The catalog with ``kind``, one value for equal topics and source."""
    return catalog.withColumn("kind", F.xxhash64("topics", F.coalesce("source", F.lit("")), F.col("source").isNull()))


def index(catalog: DataFrame, config: FeedConfig, as_of: int) -> tuple[DataFrame, DataFrame]:
    """Articles published by then with (kind, place, level), and (kind, level, bound, topics, source):
    bound is the most that freshness, quality and popularity add in a level."""
    w = config.weights()
    age = (F.lit(as_of) - F.col("published_us")) / MICROS_PER_HOUR
    out = classes(catalog.where(F.col("published_us") <= as_of)).withColumn("freshness", exponential_decay(age, config.article_half_life_hours))
    out = out.withColumn("base", F.col("freshness") * w["freshness"] + F.col("quality") * w["quality"] + F.col("popularity") * w["popularity"])
    placed = ranks.numbered(out, ["kind"], [F.desc("base"), F.desc("id")])
    # Levels of FIRST, FIRST * GROWTH, ... articles.
    level = F.floor(F.log(float(GROWTH), F.floor(F.col("place") / FIRST) * (GROWTH - 1) + 1) + 1e-9).cast("int")
    placed = settle(placed.withColumn("level", level))
    return placed, settle(placed.groupBy("kind", "level").agg(F.max("base").alias("bound"), F.first("topics").alias("topics"), F.first("source").alias("source")))


def best(users: DataFrame, catalog: DataFrame, config: FeedConfig, as_of: int, n: int, *, by_class: bool, digits: int | None = None, counts: list[int] | None = None) -> DataFrame:
    """users(user_id, weights, seen, event_count) -> (user_id, id, total) of their n best candidates,
    or of their n best of each class; equal totals by falling id.  With ``digits`` totals are
    rounded before they are compared, and equal ones are by rising id.  ``counts`` gets how
    many rows each round has joined."""
    group = ["user_id", "kind"] if by_class else ["user_id"]
    w, total = config.weights(), sum(config.weights().values())
    margin = (MARGIN if digits is None else 10.0**-digits) * total
    placed, levels = index(catalog, config, as_of)
    last = levels.agg(F.max("level")).first()[0]
    spark = users.sparkSession
    if last is None:
        return spark.createDataFrame([], "user_id string, id string, total double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = max(scoring.BLOCKS, math.isqrt(4 * parts))
    block = F.pmod(F.xxhash64("user_id"), F.lit(deal)).cast("int").alias("block")

    # Bases of a class's best and n-th best article, where the user has seen none of it; where
    # some are seen the unseen ones lie no deeper than as many places further down.
    head = placed.where(F.col("place") < n).groupBy("kind").agg(F.max("base").alias("best"), F.when(F.count("*") >= n, F.min("base")).alias("nth"))
    tops = levels.where("level = 0").select("kind", F.col("kind").cast("string").alias("id"), "topics").join(head, "kind")
    seen = users.select("user_id", F.explode("seen").alias("id")).join(placed.select("id", "kind"), "id").groupBy("user_id", "kind").agg(F.collect_set("id").alias("seen"))
    at = lambda name: placed.select("kind", F.col("place").alias(f"p_{name}"), F.col("base").alias(name))
    seen = seen.withColumn("p_s_best", F.size("seen").cast("long")).withColumn("p_s_nth", F.size("seen").cast("long") + n - 1)
    seen = seen.join(at("s_best"), ["kind", "p_s_best"], "left").join(at("s_nth"), ["kind", "p_s_nth"], "left").select("user_id", "kind", "seen", "s_best", "s_nth")
    pairs = scoring.pair_up(users.select("user_id", "weights"), tops).select("user_id", "kind", "best", "nth", topic_interest(F.col("weights"), F.col("topics")).alias("interest"))
    pairs = pairs.join(seen, ["user_id", "kind"], "left")
    fresh, low = F.col("seen").isNull(), F.lit(-1.0)
    pairs = pairs.select(
        "user_id", "kind", "interest", F.coalesce("seen", F.expr("cast(array() as array<string>)")).alias("seen"), block, "best",
        # The least base that matters; and, of the best unseen article, the base, if there is one.
        (F.coalesce(F.when(fresh, F.col("nth")).otherwise(F.col("s_nth")), low) - w["exploration"] - margin).alias("floor"), F.when(fresh, F.col("best")).otherwise(F.col("s_best")).alias("sure"),
    )
    if not by_class:
        # n classes of which each has an unseen article that is at least this good.
        sure = pairs.where("sure is not null").select("user_id", (F.col("interest") * w["interest"] + F.col("sure")).alias("sure"))
        nth = sure.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("sure")))).where(F.col("r") == n).select("user_id", F.col("sure").alias("reach"))
        own = F.coalesce(F.col("reach"), low) - F.col("interest") * w["interest"] - w["exploration"] - margin
        pairs = pairs.join(nth, "user_id", "left").withColumn("floor", F.greatest("floor", own)).where("best >= floor")
    open_ = settle(pairs.select("user_id", "kind", "interest", "seen", "block", "floor"))

    def most(bound: Column) -> Column:
        return F.col("interest") * w["interest"] + bound + w["novelty"] + w["exploration"]

    order = [F.desc("total"), F.desc("id")] if digits is None else [F.desc("total"), F.col("id")]
    value = scoring.total(config) if digits is None else F.round(scoring.total(config), digits)
    kept = None
    for level in range(last + 1):
        shelf = placed.where(F.col("level") == level).select("kind", "id", "base", "freshness", "quality", "popularity", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("block"))
        met = open_.join(shelf.repartition(parts, "kind", "block"), ["kind", "block"]).where("base >= floor")
        if counts is not None:
            counts.append(met.count())
        if config.exclude_seen:
            met = met.where(~F.array_contains("seen", F.col("id")))
        met = met.withColumn("novelty", F.when(F.array_contains("seen", F.col("id")), 0.0).otherwise(1.0)).withColumn("exploration", exploration(F.col("user_id"), F.col("id")))
        rows = scoring.reached(met.withColumn("total", scoring.total(config)), config).withColumn("total", value).select("user_id", "kind", "id", "total")
        pool = rows if kept is None else kept.unionByName(rows)
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        pool = pool.withColumn("r", place).where(F.col("r") <= n).drop("r")
        if level == last:
            return pool.select("user_id", "id", "total")
        kept = settle(pool)
        worst = kept.groupBy(*group).agg(F.min("total").alias("worst"), F.count("*").alias("have")).where(F.col("have") >= n)
        left = open_.join(levels.where(F.col("level") == level + 1).select("kind", "bound"), "kind").where("bound >= floor").join(worst, group, "left")
        open_ = settle(left.where(F.col("worst").isNull() | (most(F.col("bound")) >= F.col("worst") * total - margin)).select(*open_.columns))
        if len(open_.take(1)) == 0:
            break
    return kept.select("user_id", "id", "total")


def contenders(users: DataFrame, catalog: DataFrame, config: FeedConfig, as_of: int, counts: list[int] | None = None) -> DataFrame:
    """(user_id, id, total, topics, source): all that a slate can use, the best few of each
    class for each user."""
    made = best(users, catalog, config, as_of, min(config.size, config.max_per_source), by_class=True, counts=counts)
    return made.join(catalog.select("id", "topics", "source"), "id")
