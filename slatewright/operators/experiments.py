"""Declared comparisons of rankers on one validation set: training candidates, title
encoders and their ablations, and the two-split news workflow."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FeedConfig
from ..sources import readers
from . import impressions, logged, neural, rankers

METRICS = ("auc", "mrr", "ndcg_5", "ndcg_10")


@dataclass(frozen=True)
class Candidate:
    """One declared way to train; kind is pairwise or listwise."""

    name: str
    kind: str
    epochs: int = 20
    learning_rate: float = 0.05
    l2: float = 0.001
    seed: int = 17

    def ranker(self) -> rankers.Ranker:
        return rankers.Ranker(self.kind, self.epochs, self.learning_rate, self.l2, self.seed)


@dataclass(frozen=True)
class Plan:
    metric: str
    candidates: tuple[Candidate, ...]

    def __post_init__(self) -> None:
        names = [c.name for c in self.candidates]
        if self.metric not in METRICS or not names or len(set(names)) < len(names):
            raise ValueError("a plan has a known metric and candidates of different names")

    @classmethod
    def from_mapping(cls, value: Mapping[str, object]) -> Plan:
        if set(value) != {"metric", "candidates"}:
            raise ValueError("a plan has a metric and candidates")
        known = {f.name for f in fields(Candidate)}
        for c in value["candidates"]:
            if set(c) - known:
                raise ValueError(f"unknown parameters: {sorted(set(c) - known)}")
        return cls(str(value["metric"]), tuple(Candidate(**c) for c in value["candidates"]))


def with_scores(scored: DataFrame, shown: DataFrame) -> DataFrame:
    """Scores with source order, of impressions with both labels."""
    order = shown.select("impression_id", F.col("article_id").alias("id"), "pos")
    return impressions.mixed(scored.join(order, ["impression_id", "id"]).withColumnRenamed("id", "article_id"))


def training(spark: SparkSession, plan: Plan, catalog: DataFrame, train: DataFrame, validation: DataFrame, config: FeedConfig) -> dict[str, object]:
    """Metrics of each candidate and the selected one: the best metric, of equals the
    least name.  Both feature sets are made once."""
    rankers.check_disjoint(train, validation)
    fitted = rankers.slate_features(train, catalog, config).persist()
    held = rankers.slate_features(validation, catalog, config).persist()
    results = {}
    for c in plan.candidates:
        model, slates = c.ranker(), rankers.slates(fitted)
        if c.kind == "pairwise":
            model.fit_pairs([([v for v, y in s if y], [v for v, y in s if not y]) for s in slates])
        else:
            model.fit_lists([([v for v, _ in s], [y for _, y in s]) for s in slates])
        results[c.name] = impressions.evaluate(with_scores(model.score(held), validation)).first().asDict()
    best = neural.select({n: r[plan.metric] for n, r in results.items()})
    return {"metric": plan.metric, "candidates": results, "selected": best}


def _rows(shown: DataFrame) -> list[dict]:
    listed = F.array_sort(F.collect_list(F.struct("pos", "article_id", "clicked")))
    made = rankers._limit(shown, "impressions").groupBy("impression_id", "user_id", "occurred_us").agg(listed.alias("c")).orderBy("occurred_us", "impression_id")
    return [{"impression_id": r["impression_id"], "user_id": r["user_id"], "at": r["occurred_us"], "candidates": [(c["article_id"], bool(c["clicked"])) for c in r["c"]]} for r in made.collect()]


def title_encoder(spark: SparkSession, catalog: DataFrame, train: DataFrame, validation: DataFrame, config: neural.NeuralConfig | None = None) -> tuple[dict[str, object], dict[str, float]]:
    """Validation metrics of a title encoder, and each impression's nDCG at 10.  Titles and
    slates come to the driver; either with over rankers.MAX_ROWS rows is an error."""
    rankers.check_disjoint(train, validation)
    titles = {r["id"]: r["title"] for r in rankers._limit(catalog.select("id", "title"), "catalog").collect()}
    rows = _rows(train)
    model = neural.NeuralRanker(config).fit(titles, rows, max(r["at"] for r in rows))
    scores = model.score(titles, _rows(validation))
    made = spark.createDataFrame([(i, a, s) for i, own in scores.items() for a, s in own.items()], readers.SCORES)
    joined = impressions.mixed(validation.join(made, ["impression_id", "article_id"]))
    per = impressions.metrics(joined).persist()
    return impressions.evaluate(joined).first().asDict(), {r["impression_id"]: r["ndcg_10"] for r in per.collect()}


def encoder_selection(spark: SparkSession, variants: Mapping[str, neural.NeuralConfig], baseline: str, catalog: DataFrame, train: DataFrame, validation: DataFrame, *, metric: str = "ndcg_10", draws: int = 200, seed: int = 17) -> dict[str, object]:
    """Every variant on the same split; the selected one (of equals the baseline), and the
    interval of its paired gain over the baseline by order statistics."""
    made = {n: title_encoder(spark, catalog, train, validation, c) for n, c in variants.items()}
    best = neural.select({n: m[metric] for n, (m, _) in made.items()}, baseline)
    gains = {}
    for n, (_, per) in made.items():
        delta = [per[i] - made[baseline][1][i] for i in sorted(per)]
        means = sorted(sum(delta[k] for k in one) / len(delta) for one in logged.draws(len(delta), draws, seed))
        gains[n] = {"mean": sum(delta) / len(delta), "interval": logged.order_statistic_interval(means)}
    return {"metrics": {n: m for n, (m, _) in made.items()}, "gains": gains, "selected": best}


def archive(path: str, folder: str, members: tuple[str, ...] = ("train/news.tsv", "train/behaviors.tsv", "dev/news.tsv", "dev/behaviors.tsv"), digest: str | None = None, limit: int = 1 << 31) -> dict[str, str]:
    """Unpack exactly the four members of a news archive, after its digest and sizes are
    checked.  ``folder`` must be one that executors can read."""
    if digest is not None:
        with open(path, "rb") as f:
            if sha256(f.read()).hexdigest() != digest:
                raise ValueError("the archive has another digest")
    with zipfile.ZipFile(path) as z:
        if sorted(i.filename for i in z.infolist() if not i.is_dir()) != sorted(members):
            raise ValueError(f"an archive has exactly {', '.join(members)}")
        if sum(i.file_size for i in z.infolist()) > limit:
            raise ValueError("the archive is too large")
        return {m: z.extract(m, folder) for m in members}


def earliest(shown: DataFrame, n: int, prefix: str) -> DataFrame:
    """The n earliest impressions with both labels and at most 256 candidates, renamed: n is
    the experiment's declared size."""
    good = impressions.mixed(shown)
    per = good.groupBy("impression_id").agg(F.count("*").alias("m"), F.min("occurred_us").alias("t")).where("m <= 256")
    chosen = per.orderBy("t", "impression_id").limit(n).select("impression_id")
    return good.join(chosen, "impression_id", "left_semi").withColumn("impression_id", F.concat(F.lit(prefix), "impression_id"))


def merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Union of two catalogs; an article in both must be the same in both."""
    both = one.unionByName(two).distinct()
    clash = both.withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n > 1").orderBy("id").take(1)
    if clash:
        raise ValueError(f"two versions of article {clash[0]['id']}")
    return both


def news_workflow(spark: SparkSession, files: Mapping[str, str], published_us: int, n_train: int, n_validation: int, config: FeedConfig, **how) -> dict[str, object]:
    """Train a pairwise ranker on the earliest training slates and evaluate it on the
    earliest of the other split."""
    catalog = merged(*[readers.news_tsv(spark, files[f"{s}/news.tsv"], published_us) for s in ("train", "dev")])
    train = earliest(readers.behaviors_tsv(spark, files["train/behaviors.tsv"]), n_train, "train-")
    dev = earliest(readers.behaviors_tsv(spark, files["dev/behaviors.tsv"]), n_validation, "dev-")
    lost = train.unionByName(dev).join(catalog.select(F.col("id").alias("article_id")), "article_id", "left_anti").take(1)
    if lost:
        raise ValueError(f"unknown article {lost[0]['article_id']}")
    model = rankers.fit_pairwise(rankers.slate_features(train, catalog, config), **how)
    scored: Callable[[DataFrame], DataFrame] = lambda shown: with_scores(model.score(rankers.slate_features(shown, catalog, config)), shown)
    return {"pairs": model.examples, "weights": model.weights, "train": impressions.evaluate(scored(train)).first().asDict(), "validation": impressions.evaluate(scored(dev)).first().asDict()}
