"""A synthetic catalog and log: seeded, made where it is needed, at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = 8


def _uniform(*keys: object) -> Column:
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def catalog(spark: SparkSession, n: int, as_of: int, seed: int = 17) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("article-"), i.cast("string")).alias("id"),
        F.array_distinct(F.array(F.concat(F.lit("topic"), (i % TOPICS).cast("string")), F.concat(F.lit("topic"), ((3 * i + 1) % TOPICS).cast("string")))).alias("topics"),
        F.concat(F.lit("source"), (i % 5).cast("string")).alias("source"),
        (F.lit(as_of - 45 * 86_400_000_000) + (i * 7 % 480) * 3_600_000_000).alias("published_us"),
        (0.35 + 0.6 * _uniform(i, seed, 1)).alias("quality"),
        (0.15 + 0.8 * _uniform(i, seed, 2)).alias("popularity"),
    )


def interactions(spark: SparkSession, items: int, users: int, each: int, as_of: int, seed: int = 17) -> DataFrame:
    """``each`` events a user; users like two topics, and click what they like."""
    n = F.col("id")
    e = spark.range(users * each).select((n / each).cast("long").alias("u"), (n % each).alias("k"), n.alias("event_id"))
    e = e.withColumn("a", (_uniform("u", "k", seed) * items).cast("long"))
    affinity = F.when((F.col("a") % TOPICS).isin([0]) | (F.col("a") % TOPICS == F.col("u") % TOPICS) | (F.col("a") % TOPICS == (F.col("u") + 3) % TOPICS), 1.0).otherwise(0.0)
    p = F.least(F.lit(0.92), 0.2 + 0.62 * affinity)
    draw = _uniform("event_id", seed, 3)
    kind = F.when(draw < 0.2 * p, "like").when(draw < p, "click").otherwise("view")
    at = F.lit(as_of - 20 * 86_400_000_000) + ((F.col("k") + 1) * (19 * 86_400_000_000 / (each + 1))).cast("long") - F.col("u") % 1440 * 60_000_000
    return e.select("event_id", F.concat(F.lit("user-"), F.col("u").cast("string")).alias("user_id"), F.concat(F.lit("article-"), F.col("a").cast("string")).alias("article_id"), kind.alias("kind"), at.alias("occurred_us"), F.greatest(F.lit(0.05), p).alias("propensity"), F.lit(1.0).alias("weight"))
