"""Metrics of logged candidate slates: a row of the input is a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import discount


def mixed(candidates: DataFrame) -> DataFrame:
    """Impressions with a clicked and an unclicked candidate."""
    good = candidates.groupBy("impression_id").agg(F.min("clicked").alias("lo"), F.max("clicked").alias("hi")).where("lo < hi")
    return candidates.join(good.select("impression_id"), "impression_id", "left_semi")


def label_counts(candidates: DataFrame) -> DataFrame:
    per = candidates.groupBy("impression_id").agg(F.min("clicked").alias("lo"), F.max("clicked").alias("hi"))
    return per.agg(F.count_if(F.expr("lo < hi")).alias("comparable"), F.count_if(F.expr("lo = 1")).alias("all_clicked"), F.count_if(F.expr("hi = 0")).alias("none_clicked"))


def ranks(candidates: DataFrame) -> DataFrame:
    """rank (score, then source order) and mid_rank (ties share, lowest score first)."""
    by = Window.partitionBy("impression_id")
    peers = F.count("*").over(Window.partitionBy("impression_id", "score"))
    return candidates.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "pos"))).withColumn("mid_rank", F.rank().over(by.orderBy("score")) + (peers - 1) / 2)


def metrics(candidates: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """A row for each impression: AUC as a rank sum (ties half), MRR over all clicked, nDCG
    at each cutoff.  A one-class impression is an error."""
    clicked = F.col("clicked") == 1
    n, p = F.count("*"), F.count_if(clicked)
    auc = (F.sum(F.when(clicked, F.col("mid_rank"))) - p * (p + 1) / 2) / (p * (n - p))
    out = [F.when((p == 0) | (p == n), F.raise_error(F.lit("an impression has one class"))).otherwise(auc).alias("auc"), (F.sum(F.when(clicked, 1.0 / F.col("rank")).otherwise(0.0)) / p).alias("mrr")]
    for k in cutoffs:
        gain = F.sum(F.when(clicked & (F.col("rank") <= k), discount(F.col("rank"))).otherwise(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(p, F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / F.log2(r + 1.0))
        out.append((gain / F.when(p > 0, ideal)).alias(f"ndcg_{k}"))
    return ranks(candidates).groupBy("impression_id").agg(n.alias("candidates"), p.alias("n_clicked"), *out)


def evaluate(candidates: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Macro averages over impressions."""
    per = metrics(candidates, cutoffs)
    return per.agg(F.count("*").alias("impressions"), F.sum("candidates").alias("candidates"), F.avg("auc").alias("auc"), F.avg("mrr").alias("mrr"), *[F.avg(f"ndcg_{k}").alias(f"ndcg_{k}") for k in cutoffs])


def coverage_gaps(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs that only one side has: missing (no score) and extra (no candidate)."""
    c, s = candidates.select("impression_id", "article_id", F.lit(1).alias("c")), scores.select("impression_id", "article_id", F.lit(1).alias("s"))
    both = c.join(s, ["impression_id", "article_id"], "full_outer")
    return both.agg(F.count_if(F.expr("s is null")).alias("missing"), F.count_if(F.expr("c is null")).alias("extra"))
