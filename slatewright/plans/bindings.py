"""The domain's views over the star-schema tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import instant_us

#: 2024-01-10T00:00:00Z in microseconds.
AS_OF = 1_704_844_800_000_000
_FIRST_PUBLISHED = 1_703_462_400_000_000  # 2023-12-25T00:00:00Z
#: Articles are published over this many hours, spread by a multiplier, so that the same
#: share of them (384 of 888 hours) is out at AS_OF whatever the size of the catalog.
_HOURS, _SPREAD = 888, 7919


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article_id(n) -> F.Column:
    return F.concat(F.lit("d"), F.lpad(n.cast("string"), 12, "0"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, topics, source, published_us, quality, popularity; texts stay in the file."""
    d, labels = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("doc_id")
    return d.join(labels, "doc_id", "left").select(
        article_id(n).alias("id"),
        F.array(F.coalesce("lang", F.lit("und")), F.concat(F.lit("t"), (n % 7).cast("string"))).alias("topics"),
        "source",
        (F.lit(_FIRST_PUBLISHED) + F.pmod(n * _SPREAD, F.lit(_HOURS)) * F.lit(3_600_000_000)).alias("published_us"),
        F.coalesce(0.25 + 0.5 * F.col("quality"), F.lit(0.5)).alias("quality"),
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("popularity"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, article_id, kind, occurred_us, propensity, weight."""
    e = read(spark, sf_dir, "events").where("event_type <> 'signup'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'hide' ELSE event_type END")
    return e.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        article_id(F.get_json_object("props", "$.k").cast("long")).alias("article_id"),
        kind.alias("kind"),
        instant_us(F.col("ts"), e.schema["ts"].dataType.typeName(), zone).alias("occurred_us"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("value") / 500.0)).alias("propensity"),
        F.lit(1.0).alias("weight"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate: impression_id, user_id, occurred_us, article_id, pos,
    clicked, score.  pos is the place in source order, from 1 (ties by article)."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.min("l_linenumber").alias("line"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("clicked"), F.max("l_discount").alias("score")
    )
    order = Window.partitionBy("l_orderkey").orderBy("line", "l_partkey")
    return lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").alias("impression_id"),
        F.col("o_custkey").alias("user_id"),
        instant_us(F.col("o_orderdate"), o.schema["o_orderdate"].dataType.typeName(), spark.conf.get("spark.sql.session.timeZone")).alias("occurred_us"),
        F.col("l_partkey").alias("article_id"),
        F.row_number().over(order).alias("pos"),
        "clicked",
        "score",
    )


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared cohort for each active user."""
    users = interactions(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", F.concat(F.lit("c"), (F.substring("user_id", 2, 20).cast("long") % 3).cast("string")).alias("cohort"))
