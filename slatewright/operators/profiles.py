"""Decayed, signed interest profiles, of all users at once and at any point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..functions.scalars import MICROS_PER_DAY, exponential_decay
from ..tables import settle, split_join
from . import ranks


def signal(kind: Column, config: FeedConfig) -> Column:
    """Base signal of an interaction kind; another kind is an error."""
    out = F.raise_error(F.concat(F.lit("unknown kind: "), kind)).cast("double")
    for name, value in config.signals().items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def visible(interactions: DataFrame, catalog: DataFrame, as_of: Column | int, strict: bool = False) -> DataFrame:
    """Events at or before (strictly before) ``as_of``, of known articles that were
    published by then.  An event of an unknown article drops silently."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    seen = interactions.where(F.col("occurred_us") < as_of if strict else F.col("occurred_us") <= as_of)
    items = catalog.select(F.col("id").alias("article_id"), "topics", "published_us")
    return seen.join(items, "article_id").where(F.col("published_us") <= as_of)


def strengths(events: DataFrame, config: FeedConfig, as_of: Column | int) -> DataFrame:
    """(user_id, topic, share) of visible events: decayed strength, split over topics."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    age = (as_of - F.col("occurred_us")) / MICROS_PER_DAY
    strength = signal(F.col("kind"), config) * F.col("weight") * exponential_decay(age, config.profile_half_life_days)
    return events.select("user_id", (strength / F.size("topics")).alias("share"), F.explode("topics").alias("topic"))


def weights(events: DataFrame, config: FeedConfig, as_of: Column | int) -> DataFrame:
    """(user_id, topic, weight): totals over the greatest magnitude; zeros are dropped."""
    totals = strengths(events, config, as_of).groupBy("user_id", "topic").agg(F.sum("share").alias("total"))
    scale = F.max(F.abs("total")).over(Window.partitionBy("user_id"))
    return totals.withColumn("scale", scale).where("total <> 0").select("user_id", "topic", (F.col("total") / F.col("scale")).alias("weight"))


def profiles(events: DataFrame, config: FeedConfig, as_of: Column | int) -> DataFrame:
    """A row for each user with a visible event: weights (map), seen (array), event_count.
    The arrays are bounded by a user's articles and the topics there are."""
    maps = weights(events, config, as_of).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "weight")))).alias("weights"))
    facts = events.groupBy("user_id").agg(F.sort_array(F.collect_set("article_id")).alias("seen"), F.count("*").alias("event_count"))
    return facts.join(maps, "user_id", "left").withColumn("weights", F.coalesce("weights", F.expr("cast(map() as map<string,double>)")))


def history_interest(events: DataFrame, config: FeedConfig, *, frame: str = "range") -> DataFrame:
    """Each event with its article's interest under the user's history before it.

    ``range``: events strictly earlier in time; ``rows``: earlier by (time, event_id), so
    that events of the same time that came first do count.  Decay factorises over an anchor (the
    user's first event) and cancels in total / greatest magnitude, so one running sum for each
    (user, topic) takes the place of a self-join on time.  Sums run within segments of time and
    are carried from one to the next, so a user of very many events is spread over tasks.
    """
    topics = F.array_distinct(F.flatten(F.collect_set("topics"))).alias("own")  # as many as there are topics
    users = settle(events.groupBy("user_id").agg(F.min("occurred_us").alias("anchor"), topics, F.count("*").alias("events")))
    e = split_join(events.select("user_id", "event_id", "article_id", "occurred_us", "kind", "weight", "topics"), users, ["user_id"], "events")
    growth = F.exp(F.ln(F.lit(2.0)) * (F.col("occurred_us") - F.col("anchor")) / MICROS_PER_DAY / config.profile_half_life_days)
    e = e.withColumn("part", signal(F.col("kind"), config) * F.col("weight") * growth / F.size("topics"))
    rows = e.select("user_id", "event_id", "article_id", "occurred_us", F.size("topics").alias("n"), "topics", "part", F.explode("own").alias("topic"))
    rows = rows.withColumn("has", F.array_contains("topics", F.col("topic"))).withColumn("part", F.when(F.col("has"), F.col("part")).otherwise(0.0)).drop("topics")
    if frame == "range":
        times = rows.groupBy("user_id", "topic", "occurred_us").agg(F.sum("part").alias("part"))
        rows = rows.join(ranks.running(times, ["user_id", "topic"], ["occurred_us"], {"total": "part"}).drop("part"), ["user_id", "topic", "occurred_us"])
    else:
        rows = ranks.running(rows, ["user_id", "topic"], ["occurred_us", "event_id"], {"total": "part"})
    per = rows.groupBy("user_id", "event_id", "article_id", "occurred_us").agg(F.max(F.abs("total")).alias("scale"), F.sum(F.when(F.col("has"), F.col("total"))).alias("mine"), F.first("n").alias("n"))
    raw = F.when(F.col("scale") > 0, F.col("mine") / F.col("scale") / F.col("n")).otherwise(F.lit(0.0))
    return per.select("event_id", "user_id", "article_id", "occurred_us", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 1) / 2)).alias("interest"))


def counts_before(events: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """Events with, for each of ``counted`` (name -> condition), how many events of the user
    that meet it are strictly earlier."""
    times = events.groupBy("user_id", "occurred_us").agg(*[F.count_if(c).alias(f"__{n}") for n, c in counted.items()])
    sums = ranks.running(times, ["user_id"], ["occurred_us"], {n: f"__{n}" for n in counted}).select("user_id", "occurred_us", *counted)
    return events.join(sums, ["user_id", "occurred_us"])


def prior_clicks(events: DataFrame, limit: int) -> DataFrame:
    """(event_id, clicks, last): how many clicks the user has made strictly before, and the
    articles of the latest ``limit`` of them, the latest last (of one time by article).
    Clicks are numbered, so an event asks for numbers and no list is kept of a user."""
    is_click = F.col("kind") == "click"
    made = counts_before(events, {"clicks": is_click}).select("user_id", "event_id", "clicks")
    clicks = ranks.numbered(events.where(is_click).select("user_id", "occurred_us", "article_id", F.col("event_id").alias("by")), ["user_id"], ["occurred_us", "article_id", "by"], "number").select("user_id", "number", "article_id")
    first = F.greatest(F.lit(0), F.col("clicks") - limit)
    asked = made.where("clicks > 0").withColumn("number", F.explode(F.sequence(first, F.col("clicks") - 1)))
    lists = asked.join(clicks, ["user_id", "number"]).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("number", "article_id"))).alias("last"))
    return made.join(lists, "event_id", "left").select("event_id", "clicks", F.transform(F.coalesce("last", F.expr("cast(array() as array<struct<number:bigint,article_id:string>>)")), lambda x: x["article_id"]).alias("last"))
