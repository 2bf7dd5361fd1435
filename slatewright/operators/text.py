"""Sparse text features in long form: (id, feature, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import folded, inverse_frequency, runs, term_weight


def counts(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, feature, n).  Runs are counted as they stand, and only then folded."""
    raw = docs.select(F.col(id_).alias("id"), F.explode(runs(F.col(text))).alias("run")).groupBy("id", "run").agg(F.count("*").alias("n"))
    return raw.withColumn("feature", F.explode(folded(F.col("run")))).groupBy("id", "feature").agg(F.sum("n").alias("n"))


def vocabulary(terms: DataFrame, n_docs: DataFrame, size: int, min_df: int = 1) -> DataFrame:
    """The ``size`` most frequent features (by documents, then name), with idf.  The limit
    is the parameter of the feature, not of the data."""
    df = terms.groupBy("feature").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    top = df.orderBy(F.desc("df"), "feature").limit(size)
    return top.join(F.broadcast(n_docs)).select("feature", "df", inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf"))


def vectors(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Unit tf-idf vectors; a document without known features has no rows."""
    w = terms.join(vocab, "feature").withColumn("w", term_weight(F.col("n")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "feature", (F.col("w") / norm).alias("weight"))


def history(events: DataFrame, vecs: DataFrame, signal: F.Column) -> DataFrame:
    """A user's signed sum of vectors; without time decay."""
    made = events.withColumn("s", signal * F.col("weight")).select("user_id", F.col("article_id").alias("id"), "s").join(vecs, "id")
    return made.groupBy("user_id", "feature").agg(F.sum(F.col("s") * F.col("weight")).alias("weight"))


def affinity(histories: DataFrame, vecs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(user_id, id) with the cosine of history and article in [-1, 1]; 0 if either
    is empty."""
    norm = histories.groupBy("user_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = pairs.join(vecs, "id").join(histories.withColumnRenamed("weight", "h"), ["user_id", "feature"]).groupBy("user_id", "id").agg(F.sum(F.col("weight") * F.col("h")).alias("dot"))
    made = pairs.join(dots, ["user_id", "id"], "left").join(norm, "user_id", "left")
    value = F.when(F.col("norm") > 0, F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0))).otherwise(0.0)
    return made.select("user_id", "id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)).alias("affinity"))
