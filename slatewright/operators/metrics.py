"""Ranking, diversity, coverage and exposure metrics over slates, and leave-last-out
evaluation of all users in one plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..functions.scalars import discount, jaccard
from ..tables import settle
from . import blocks, profiles, ranks, slates


def holdouts(interactions: DataFrame, catalog: DataFrame, as_of: int) -> DataFrame:
    """Each user's last click or like of a known article: (user_id, holdout_id,
    holdout_us); of equal times the greatest article id."""
    good = interactions.where(F.col("kind").isin("click", "like") & (F.col("occurred_us") <= as_of)).join(catalog.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    last = F.max(F.struct("occurred_us", "article_id")).alias("last")
    return good.groupBy("user_id").agg(last).select("user_id", F.col("last.article_id").alias("holdout_id"), F.col("last.occurred_us").alias("holdout_us"))


def distances(picks: Column) -> Column:
    """1 - Jaccard similarity of topics for each pair of places of a slate."""
    n = F.size(picks)
    return F.flatten(F.transform(picks, lambda a, i: F.transform(F.slice(picks, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: 1.0 - jaccard(a["topics"], b["topics"]))))


def mean(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def slate_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(user_id, holdout_id, picks: array of id, topics, source, reader) -> metrics at k.
    The slate was built at its own size and is cut here."""
    cut = F.slice("picks", 1, k)
    n = F.size("top")
    rank = F.array_position(F.transform("top", lambda p: p["id"]), F.col("holdout_id"))
    return (
        ranked.withColumn("top", cut)
        .withColumn("pairs", distances(F.col("top")))
        .withColumn("place", rank)
        .select(
            *[c for c in ranked.columns if c not in ("picks", "reader")],
            F.transform("top", lambda p: p["id"]).alias("ranked_ids"),
            F.when(F.col("place") > 0, discount(F.col("place"))).otherwise(0.0).alias("ndcg"),
            F.when(F.col("place") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
            F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0).alias("reciprocal_rank"),
            F.when(n < 2, 0.0).otherwise(mean("pairs")).alias("intra_list_diversity"),
            F.when(n == 0, 0.0).otherwise(F.size(F.array_distinct(F.transform("top", lambda p: p["source"]))) / n).alias("source_diversity"),
            slates.calibration(F.col("reader"), F.col("top")).alias("topic_calibration"),
        )
    )


def evaluate(interactions: DataFrame, catalog: DataFrame, configs: Mapping[str, FeedConfig], as_of: int, k: int | None = None) -> DataFrame:
    """A row for each policy and user with a holdout: what the engine would have shown just
    before it, with only strictly earlier history, the metrics of that slate, and its
    calibration to the history (null where there is no history or no slate).

    Holdouts come once; profiles and score components once for all policies that agree in what
    these depend on.  Pairs of users and articles stay inside tasks (blocks.build)."""
    held = holdouts(interactions, catalog, as_of)
    known = catalog.where(F.col("published_us") <= as_of)  # no holdout is later
    past = interactions.join(held.select("user_id", "holdout_us"), "user_id")
    alike: dict[tuple, dict[str, FeedConfig]] = {}
    for name, c in configs.items():
        alike.setdefault((c.profile_half_life_days, c.article_half_life_hours, c.exclude_seen, *c.signals().values()), {})[name] = c
    out = None
    for group in alike.values():
        one = next(iter(group.values()))
        made = profiles.profiles(profiles.visible(past, known, F.col("holdout_us"), strict=True), one, F.col("holdout_us"))
        users = held.join(made, "user_id", "left").select(
            "user_id", "holdout_us",
            F.coalesce("weights", F.expr("cast(map() as map<string,double>)")).alias("weights"),
            F.coalesce("seen", F.expr("cast(array() as array<string>)")).alias("seen"),
            F.coalesce("event_count", F.lit(0)).alias("event_count"),
        )
        built = blocks.build(users, known, group, F.col("holdout_us"))
        names = F.explode(F.array(*[F.lit(n) for n in group])).alias("policy")
        ranked = held.select(names, "*").join(built, ["user_id", "policy"], "left").select(
            "policy", "user_id", "holdout_id", "holdout_us",
            F.coalesce("picks", F.expr(f"cast(array() as array<{slates.PICK}>)")).alias("picks"),
            F.coalesce("reader", F.expr("cast(array() as array<struct<topic:string,share:double>>)")).alias("reader"),
        )
        size = k or one.size
        if k is None and len({c.size for c in group.values()}) > 1:
            raise ValueError("policies with slates of several sizes need k")
        part = slate_metrics(ranked, size)
        out = part if out is None else out.unionByName(part)
    return out


def leave_last_out(interactions: DataFrame, catalog: DataFrame, config: FeedConfig, as_of: int, k: int | None = None) -> DataFrame:
    """``evaluate`` for one configuration."""
    return evaluate(interactions, catalog, {"": config}, as_of, k).drop("policy")


MEANS = ("ndcg", "hit_rate", "reciprocal_rank", "intra_list_diversity", "source_diversity")


def macro(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("users"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEANS])


def exposures(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode("ranked_ids").alias("article_id")).groupBy("article_id").agg(F.count("*").alias("n"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """Gini of exposure over the exposed items; 0 without any.  Counts are grouped before
    they are ranked, and ranks run over distinct counts in several tasks."""
    grouped = counts.groupBy(F.col(n).alias("x")).agg(F.count("*").alias("c"))
    placed = ranks.running(grouped, [], ["x"], {"before": "c"})
    ranked = placed.withColumn("weighted", F.col("x") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    m, sum_ = F.sum("c"), F.sum(F.col("x") * F.col("c"))
    return ranked.agg(F.coalesce(2.0 * F.sum("weighted") / (m * sum_) - (m + 1) / m, F.lit(0.0)).alias("exposure_gini"))


def eligible_union(held: DataFrame, catalog: DataFrame) -> DataFrame:
    """(eligible): the union over users of what was published by their holdouts is what was
    published by the latest holdout."""
    last = held.agg(F.max("holdout_us").alias("last"))
    return catalog.join(F.broadcast(last), F.col("published_us") <= F.col("last")).agg(F.count("*").alias("eligible"))


def coverage(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct exposed items over the union of eligible ones."""
    samples = settle(samples.select("holdout_us", "ranked_ids"))  # read twice
    union = eligible_union(samples, catalog)
    shown = samples.select(F.explode("ranked_ids").alias("id")).agg(F.count_distinct("id").alias("exposed"))
    both = shown.join(F.broadcast(union))
    return both.select("exposed", "eligible", F.when(F.col("eligible") > 0, F.col("exposed") / F.col("eligible")).otherwise(0.0).alias("catalog_coverage"))
