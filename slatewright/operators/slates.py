"""Greedy slates.  Each pick depends on those before it, so a user's candidates become an
array and a step in Arrow batches picks from it, with candidates by topics as a matrix.

Within a class of candidates with the same topics and source, every objective here ranks
by relevance (then id), and the source cap takes at most ``max_per_source``; so only so
many of each class are kept before the array is made.  That changes no slate and bounds
the array by classes, whatever the size of the catalog.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FeedConfig

SMOOTHING = 0.01
PICK = "struct<id:string,total:double,topics:array<string>,source:string>"


def contenders(scored: DataFrame, configs: Mapping[str, FeedConfig], keys: tuple[str, ...]) -> DataFrame:
    """The best of each class that a slate can use."""
    kind = F.xxhash64("topics", "source")  # sorts quicker than what it stands for
    scored = scored.withColumn("__kind", kind)
    order = Window.partitionBy(*keys, "__kind", "source").orderBy(F.desc("total"), F.desc("id"))
    most = {name: min(c.size, c.max_per_source) for name, c in configs.items()}
    ranked = scored.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= max(most.values()))
    if len(set(most.values())) > 1:
        own = F.lit(0)
        for name, n in most.items():
            own = F.when(F.col("policy") == name, F.lit(n)).otherwise(own)
        ranked = ranked.where(F.col("__place") <= own)
    return ranked.drop("__place", "__kind")


def reader_distribution(weights: Column) -> Column:
    """Positive weights over their sum, as (topic, share) by topic; negatives take none."""
    good = F.array_sort(F.filter(F.map_entries(weights), lambda e: e["value"] > 0))
    sum_ = F.aggregate(good, F.lit(0.0), lambda a, e: a + e["value"])
    return F.transform(good, lambda e: F.struct(e["key"].alias("topic"), (e["value"] / sum_).alias("share")))


def divergence(reader: Column, shares: Column, smoothing: float = SMOOTHING) -> Column:
    """Smoothed Kullback-Leibler divergence of reader from shares (same order); >= 0."""
    terms = F.zip_with(reader, shares, lambda r, q: r["share"] * F.ln(r["share"] / ((1.0 - smoothing) * q + smoothing * r["share"])))
    return F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), F.lit(0.0))


def calibration(reader: Column, picks: Column) -> Column:
    """Divergence of a reader from the topics of a slate, each pick's split over its own;
    null without a reader or a slate."""
    share = F.transform(reader, lambda r: F.aggregate(picks, F.lit(0.0), lambda a, p: a + F.when(F.array_contains(p["topics"], r["topic"]), 1.0 / F.size(p["topics"])).otherwise(0.0)) / F.size(picks))
    return F.when((F.size(reader) > 0) & (F.size(picks) > 0), divergence(reader, share))


def greedy(total: np.ndarray, source: np.ndarray, has: np.ndarray, reader: list[tuple[int, float]], config: FeedConfig, smoothing: float = SMOOTHING) -> list[int]:
    """Places of the picks.  Candidates come by falling (total, id), so the first of equal
    values wins; ``has`` is candidates by topics, ``reader`` pairs of a topic's column (-1 if no
    candidate has it) and its share."""
    size = has.sum(axis=1)
    alive, taken, picks = np.ones(len(total), bool), {}, []
    redundancy, mass = np.zeros(len(total)), [0.0] * len(reader)
    shares = [has[:, c] / size if c >= 0 else np.zeros(len(total)) for c, _ in reader]
    while len(picks) < config.size and alive.any():
        if config.rerank_strategy == "calibrated":
            lost = np.zeros(len(total))
            for m, own, (_, share) in zip(mass, shares, reader, strict=True):
                lost += share * np.log(share / ((1.0 - smoothing) * ((m + own) / (len(picks) + 1)) + smoothing * share))
            value = (1.0 - config.calibration_weight) * total - config.calibration_weight * np.maximum(lost, 0.0)
        else:
            value = config.mmr_lambda * total - (1.0 - config.mmr_lambda) * redundancy
        best = int(np.where(alive, value, -np.inf).argmax())
        picks.append(best)
        alive[best] = False
        taken[source[best]] = taken.get(source[best], 0) + 1
        if taken[source[best]] >= config.max_per_source:
            alive[source == source[best]] = False
        both = has @ has[best]
        redundancy = np.maximum(redundancy, both / np.maximum(size + size[best] - both, 1))
        mass = [m + own[best] for m, own in zip(mass, shares, strict=True)]
    return picks


def _picker(configs: Mapping[str, FeedConfig], keys: int):
    """Rows (keys, policy, pool, reader) -> (keys, picks, reader)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            policy, pool, reader = batch.columns[keys:]
            items, bounds = pool.flatten(), np.asarray(pool.offsets) - pool.offsets[0].as_py()
            total, source, topics = (pc.struct_field(items, n) for n in ("total", "source", "topics"))
            total, source = total.to_numpy(), np.asarray(pc.fill_null(source, "").dictionary_encode().indices)
            words = topics.flatten().dictionary_encode()
            code, first = np.asarray(words.indices), np.asarray(topics.offsets) - topics.offsets[0].as_py()
            number = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
            chosen, ends = [], [0]
            for k, (name, tastes) in enumerate(zip(policy.to_pylist(), reader.to_pylist(), strict=True)):
                s, e = bounds[k], bounds[k + 1]
                own = code[first[s] : first[e]]
                known, column = np.unique(own, return_inverse=True)
                has = np.zeros((e - s, len(known)))
                has[np.repeat(np.arange(e - s), np.diff(first[s : e + 1])), column] = 1
                place = {int(c): i for i, c in enumerate(known)}
                tastes = [(place.get(number.get(r["topic"], -1), -1), r["share"]) for r in tastes]
                chosen += [s + i for i in greedy(total[s:e], source[s:e], has, tastes, configs[name])]
                ends.append(len(chosen))
            picks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items.take(pa.array(chosen, pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], picks, reader], names=[*batch.schema.names[:keys], "picks", "reader"])

    return run


def build(scored: DataFrame, config: FeedConfig | Mapping[str, FeedConfig], users: DataFrame | None = None, keys: tuple[str, ...] = ("user_id",), whole: bool = True) -> DataFrame:
    """(keys, picks, reader): picks is an array of id, total, topics, source in rank order.
    With several configs, by the column policy, which is then a key as well.  ``users`` are
    the profiles (user_id, weights) that were scored; with them weights need not go with
    every candidate.  Where ``scored`` are not whole candidates but contenders already
    (candidates.contenders), they are not looked for again."""
    many = not isinstance(config, FeedConfig)
    configs = dict(config) if many else {"": config}
    keys = (*keys, "policy") if many else keys
    item = F.struct("total", "id", "topics", "source")
    needed = scored.select(*keys, "total", "id", "topics", "source", *(["weights"] if users is None else []))
    pools = (contenders(needed, configs, keys) if whole else needed).groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias("pool"), *([F.first("weights").alias("weights")] if users is None else []))
    if users is not None:
        pools = pools.join(users.select("user_id", "weights"), "user_id")
    pool = F.transform("pool", lambda x: F.struct(x["id"].alias("id"), x["total"].alias("total"), x["topics"].alias("topics"), x["source"].alias("source")))
    rows = pools.select(*keys, (F.col("policy") if many else F.lit("")).alias("__policy"), pool.alias("pool"), reader_distribution(F.col("weights")).alias("reader"))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("picks", T._parse_datatype_string(f"array<{PICK}>")), rows.schema["reader"]])
    return rows.mapInArrow(_picker(configs, len(keys)), schema)


def feeds(scored: DataFrame, config: FeedConfig, users: DataFrame | None = None, keys: tuple[str, ...] = ("user_id",), whole: bool = True) -> DataFrame:
    """A row for each place of each slate: keys, rank, article_id, score, topics, source."""
    return places(build(scored, config, users, keys, whole), keys)


def places(made: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """``feeds`` of built slates."""
    return made.select(*keys, F.posexplode("picks").alias("pos", "p")).select(*keys, (F.col("pos") + 1).alias("rank"), F.col("p.id").alias("article_id"), F.col("p.total").alias("score"), F.col("p.topics").alias("topics"), F.col("p.source").alias("source"))
