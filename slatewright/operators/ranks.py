"""Ranks, running sums and order statistics of groups of any size.

Rows are range-partitioned by (group, order), so a large group lies in many partitions.
What a partition adds up to for a group is carried to the partitions behind it: a row for
each group and partition, however many rows they stand for.  No task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import settle


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str | Column], totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name -> what is summed): the sum over the
    earlier rows of the row's group; 0 before the first; and for each of ``totals`` (name ->
    one of ``sums``) the whole group's sum.  Rows of equal order come one before
    the other, in no stated order, so an order should be total, or aggregated to distinct
    values first.  Null keys are a group; nulls add nothing."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc(o) if isinstance(o, str) else o for o in order]
    measured = df.withColumns({f"__{n}": F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for n, c in sums.items()})
    dealt = settle(measured.repartitionByRange(parts, *keys, *by).withColumn("__part", F.spark_partition_id()))
    own = dealt.groupBy(*keys, "__part").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    behind = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"),
        *[F.coalesce(F.sum(f"__{n}").over(behind), F.lit(0)).alias(f"__c{n}") for n in sums], *[F.sum(f"__{n}").over(Window.partitionBy(*keys)).alias(name) for name, n in (totals or {}).items()],
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    here = Window.partitionBy("__part", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(carried, same).select(*df.columns, *[(F.col(f"__c{n}") + F.coalesce(F.sum(f"__{n}").over(here), F.lit(0))).alias(n) for n in sums], *(totals or {}))


def running_max(df: DataFrame, keys: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with the greatest value of the earlier rows of the row's group; null before the
    first.  An order should be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc(o) if isinstance(o, str) else o for o in order]
    dealt = settle(df.repartitionByRange(parts, *keys, *by).withColumn("__part", F.spark_partition_id()))
    own = dealt.groupBy(*keys, "__part").agg(F.max(value).alias("__m"))
    behind = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.max("__m").over(behind).alias("__c"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    here = Window.partitionBy("__part", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(carried, same).select(*df.columns, F.greatest("__c", F.max(value).over(here)).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place in its group, from 0."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def at_positions(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(keys, name, fraction, position, low, high): for each fraction the values at the floor
    and the ceiling of fraction * (n - 1) in the order of ``value``; nulls are no values.

    Equal values are counted before anything is sorted, so one value of very many rows is one
    row; then running counts say which value a position falls on."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = running(counted, keys, ["value"], {"before": "n"}, {"all": "before"})
    within = lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n"))
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("fraction"), ((F.col("all") - 1) * float(p)).alias("position")) for n, p in fractions.items()])
    hit = F.filter(asked, lambda a: within(F.floor(a["position"])) | within(F.ceil(a["position"])))
    # Rows on which a position falls, at most two for each fraction.
    hit = placed.withColumn("hit", F.explode(hit)).select(*keys, "hit.*", "value", "before", "n")
    on = lambda p: F.max(F.when(within(p), F.col("value")))
    return hit.groupBy(*keys, "name", "fraction", "position").agg(on(F.floor("position")).alias("low"), on(F.ceil("position")).alias("high"))


def _wide(found: DataFrame, keys: list[str], names: list[str], value: Column) -> DataFrame:
    made = found.withColumn("__v", value)
    return made.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in names])


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(keys, a column for each fraction): percentiles interpolated at fraction * (n - 1)."""
    part = F.col("position") - F.floor("position")
    return _wide(at_positions(df, keys, value, fractions), keys, list(fractions), F.col("low") * (1 - part) + F.col("high") * part)


def outward(df: DataFrame, keys: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(keys, low, high): order statistics at the floor and the ceiling, not interpolated."""
    found = at_positions(df, keys, value, {"low": low, "high": high})
    return _wide(found, keys, ["low", "high"], F.when(F.col("name") == "low", F.col("low")).otherwise(F.col("high")))
