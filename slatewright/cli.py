"""Commands over files: validate, recommend, evaluate, benchmark, audit-cohorts, compare-cohort-policies, simulate, import-mind, import-archive, evaluate-mind,
train and rank click models, stream ingestion.  An input error ends with status 2."""

from __future__ import annotations

import argparse
import sys
from contextlib import nullcontext

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FeedConfig
from .deadlines import deadline
from .operators import comparisons, impressions, logged, metrics, profiles, rankers, scoring, slates
from .serve import Snapshot, server
from .session import session
from .sources import archives, readers, sinks, synthetic
from .sources.ceilings import Ceilings, published
from .streaming.store import EventLog, parsed


def _config(a: argparse.Namespace, spark: SparkSession) -> FeedConfig:
    return FeedConfig.from_json(spark.read.text(a.config, wholetext=True).first()[0]) if getattr(a, "config", None) else FeedConfig()


def _tables(a: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    catalog = readers.articles(spark, a.articles)
    events = readers.events(spark, a.events).withColumn("event_id", F.monotonically_increasing_id())
    return catalog, events


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _scored(catalog: DataFrame, events: DataFrame, config: FeedConfig, as_of: int) -> DataFrame:
    return scoring.score(profiles.profiles(profiles.visible(events, catalog, as_of), config, as_of), catalog, config, as_of)


def validate(a, spark):
    catalog, events = _tables(a, spark)
    lost = events.join(catalog.select(F.col("id").alias("article_id")), "article_id", "left_anti").take(1)
    if lost:
        raise ValueError(f"event of unknown article {lost[0]['article_id']}")
    return {"articles": catalog.count(), "events": events.count(), "users": events.select("user_id").distinct().count()}


def recommend(a, spark):
    catalog, events = _tables(a, spark)
    config = _config(a, spark)
    as_of = readers.micros(a.as_of, "as_of")
    users = spark.createDataFrame([(a.user,)], "user_id string")
    made = users.join(profiles.profiles(profiles.visible(events.where(F.col("user_id") == a.user), catalog, as_of), config, as_of), "user_id", "left").select(
        "user_id", F.coalesce("weights", F.expr("cast(map() as map<string,double>)")).alias("weights"), F.coalesce("seen", F.expr("cast(array() as array<string>)")).alias("seen"), F.coalesce("event_count", F.lit(0)).alias("event_count")
    )
    rows = _rows(slates.feeds(scoring.score(made, catalog, config, as_of), config).orderBy("rank"))
    if a.html:
        sinks.write_all({a.html: sinks.feed_report(f"Feed of {a.user}", rows)})
    return {"user_id": a.user, "feed": rows}


def evaluate(a, spark):
    catalog, events = _tables(a, spark)
    as_of = readers.micros(a.as_of, "as_of")
    samples = metrics.leave_last_out(events, catalog, _config(a, spark), as_of, a.k).persist()
    out = _rows(metrics.macro(samples))[0] | _rows(metrics.coverage(samples, catalog))[0] | _rows(metrics.gini(metrics.exposures(samples)))[0]
    return out | {"logged": logged.interval(spark, logged.observations(events, as_of))}


def benchmark(a, spark):
    catalog, events = _tables(a, spark)
    samples = comparisons.benchmark(events, catalog, _config(a, spark), readers.micros(a.as_of, "as_of"), a.k or 10, catalog.count()).persist()
    rows = _rows(comparisons.by_policy(samples).orderBy("policy"))
    if a.html:
        sinks.write_all({a.html: sinks.benchmark_report("Policies", rows)})
    return {"policies": rows, "ndcg_intervals": comparisons.intervals(samples, "ndcg", draws=a.draws)}


def run_ablation(a, spark):
    catalog, events = _tables(a, spark)
    samples = comparisons.ablations(events, catalog, _config(a, spark), a.names.split(","), readers.micros(a.as_of, "as_of"), a.k or 10, catalog.count())
    record = {"policies": _rows(comparisons.by_policy(samples).orderBy("policy"))}
    return {"record": sinks.register(a.registry, record), **record}


def audit_cohorts(a, spark):
    catalog, events = _tables(a, spark)
    cohorts = readers.cohorts(spark, a.cohorts)
    as_of = readers.micros(a.as_of, "as_of")
    gaps = comparisons.check_cohorts(events.where(F.col("occurred_us") <= as_of), cohorts).first()
    if any(gaps):
        raise ValueError(f"cohorts differ from the active users: {gaps.asDict()}")
    audited = comparisons.audit(metrics.leave_last_out(events, catalog, _config(a, spark), as_of, a.k), cohorts).persist()
    return {"cohorts": _rows(audited.orderBy("cohort")), "gaps": _rows(comparisons.gaps(audited))[0]}


def compare_cohort_policies(a, spark):
    catalog, events = _tables(a, spark)
    cohorts = readers.cohorts(spark, a.cohorts)
    samples = comparisons.benchmark(events, catalog, _config(a, spark), readers.micros(a.as_of, "as_of"), a.k or 10, catalog.count())
    points = comparisons.objectives(comparisons.audit(samples, cohorts, ("policy",))).persist()
    return {"policies": _rows(points.orderBy("policy")), "frontier": sorted(r["policy"] for r in comparisons.frontier(points).collect())}


def simulate(a, spark):
    as_of = readers.micros(a.as_of, "as_of")
    synthetic.catalog(spark, a.items, as_of, a.seed).write.parquet(f"{a.out}/catalog")
    synthetic.interactions(spark, a.items, a.users, a.each, as_of, a.seed).write.parquet(f"{a.out}/interactions")
    return {"items": a.items, "events": a.users * a.each}


def import_mind(a, spark):
    news = readers.news_tsv(spark, a.news, readers.micros(a.published_at, "published_at"))
    shown = readers.behaviors_tsv(spark, a.behaviors, a.offset)
    sinks.json_lines(news, f"{a.out}/articles")
    sinks.json_lines(sinks.nested_impressions(shown), f"{a.out}/impressions")
    return {"articles": news.count(), "candidates": shown.count()}


def import_archive(a, spark):
    """All four members, or nothing where one is refused."""
    published_us, limit = readers.micros(a.published_at, "published_at"), Ceilings(rows=a.max_rows)
    options = {"max_candidates": a.max_candidates, "max_line_bytes": a.max_line_bytes, "max_bytes": a.max_bytes}
    lines, rows = archives.archive(spark, a.archive, **options), {}
    with published(spark, a.out) as staged:
        for part in ("train", "dev"):
            rows[f"{part}/articles"] = limit.write(archives.articles(spark, lines, f"{part}/news.tsv", published_us), f"{staged}/{part}/articles")["rows"]
            rows[f"{part}/impressions"] = limit.write(archives.impressions(spark, lines, f"{part}/behaviors.tsv", a.offset), f"{staged}/{part}/impressions")["rows"]
    return {"members": _rows(archives.summary(spark, a.archive, **options).orderBy("member")), "rows": rows}


def evaluate_mind(a, spark):
    shown, scores = readers.impressions(spark, a.impressions), readers.scores(spark, a.scores)
    gaps = impressions.coverage_gaps(shown, scores).first()
    if any(gaps):
        raise ValueError(f"scores and candidates differ: {gaps.asDict()}")
    return _rows(impressions.evaluate(shown.join(scores, ["impression_id", "article_id"])))[0]


def train_click_model(a, spark):
    catalog, events = _tables(a, spark)
    model = rankers.fit_pointwise(events, catalog, _config(a, spark), readers.micros(a.as_of, "as_of"))
    sinks.write_all({a.model: model.to_json()})
    return {"examples": model.examples, "weights": dict(zip(rankers.FEATURES, model.weights, strict=True))}


def _model(a) -> rankers.Ranker:
    with open(a.model, encoding="utf-8") as f:
        return rankers.Ranker.from_json(f.read())


def rank_click_model(a, spark):
    catalog, events = _tables(a, spark)
    model = _model(a)
    config = FeedConfig.from_mapping(model.config)
    featured = scoring.features(_scored(catalog, events.where(F.col("user_id") == a.user), config, readers.micros(a.as_of, "as_of")))
    return {"ranking": _rows(model.rank(featured, a.k or 10).select("rank", "id", "probability").orderBy("rank"))}


def serve_click_model(a, spark):
    catalog, events = _tables(a, spark)
    model = _model(a)
    featured = scoring.features(_scored(catalog, events, FeedConfig.from_mapping(model.config), readers.micros(a.as_of, "as_of")))
    made = server(Snapshot.collect(model.score(featured), a.k or 100, by="probability"), port=a.port, token=a.token)
    made.serve_forever()
    return {}


def _slates(a, spark):
    return rankers.slate_features(readers.impressions(spark, a.impressions), readers.articles(spark, a.articles), _config(a, spark))


def train_slates(a, spark):
    fit = rankers.fit_pairwise if a.command == "train-pairwise-model" else rankers.fit_listwise
    model = fit(_slates(a, spark))
    sinks.write_all({a.model: model.to_json()})
    return {"examples": model.examples, "weights": dict(zip(rankers.FEATURES, model.weights, strict=True))}


def rank_slates(a, spark):
    scored = _model(a).score(_slates(a, spark))
    if a.command.startswith("rank"):
        return {"scores": _rows(scored.select("impression_id", "id", "score").orderBy("impression_id", "id"))}
    from pyspark.sql import Window

    shown = readers.impressions(spark, a.impressions).select("impression_id", F.col("article_id").alias("id"), "pos")
    joined = scored.join(shown, ["impression_id", "id"])
    return _rows(impressions.evaluate(impressions.mixed(joined)))[0]


def stream_ingest(a, spark):
    log = EventLog(spark, a.log, lateness_us=a.lateness * 1_000_000, late=a.late)
    catalog = readers.articles(spark, a.articles) if a.articles else None
    return log.ingest(parsed(spark.read.text(a.events)), catalog)


def stream_checkpoint(a, spark):
    saved = EventLog(spark, a.log).checkpoint()
    sinks.write_all({a.out: sinks.dump(saved)})
    return saved


def stream_replay(a, spark):
    log = EventLog(spark, a.log)
    if a.checkpoint:
        from .sources.strict_json import load

        with open(a.checkpoint, encoding="utf-8") as f:
            log.restore(load(f.read()))
    rows = log.weights_at(readers.articles(spark, a.articles), _config(a, spark), readers.micros(a.as_of, "as_of"))
    return {"weights": _rows(rows.orderBy("user_id", "topic"))}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="slatewright")
    top.add_argument("--deadline", type=float, help="seconds after which the command's jobs are cancelled")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *needed, **optional):
        p = sub.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n.replace('_', '-')}", required=True)
        for n, default in optional.items():
            p.add_argument(f"--{n.replace('_', '-')}", default=default, type=type(default) if default is not None else (int if n == "k" else str))
        p.set_defaults(run=run)

    both = ("articles", "events")
    command("validate", validate, *both)
    command("recommend", recommend, *both, "user", "as_of", config=None, html=None)
    command("evaluate", evaluate, *both, "as_of", config=None, k=None)
    command("benchmark", benchmark, *both, "as_of", config=None, k=None, html=None, draws=1000)
    command("run-ablation", run_ablation, *both, "as_of", "names", "registry", config=None, k=None)
    command("audit-cohorts", audit_cohorts, *both, "cohorts", "as_of", config=None, k=None)
    command("compare-cohort-policies", compare_cohort_policies, *both, "cohorts", "as_of", config=None, k=None)
    command("simulate", simulate, "out", "as_of", items=100, users=20, each=15, seed=17)
    command("import-mind", import_mind, "news", "behaviors", "out", "published_at", offset="+00:00")
    command("import-archive", import_archive, "archive", "out", "published_at", offset="+00:00", max_rows=50_000_000, max_candidates=1000, max_line_bytes=1 << 20, max_bytes=1 << 40)
    command("evaluate-mind", evaluate_mind, "impressions", "scores")
    command("train-click-model", train_click_model, *both, "as_of", "model", config=None)
    command("rank-click-model", rank_click_model, *both, "user", "as_of", "model", k=None)
    command("serve-click-model", serve_click_model, *both, "as_of", "model", port=8080, token=None, k=None)
    for kind in ("pairwise", "listwise"):
        command(f"train-{kind}-model", train_slates, "articles", "impressions", "model", config=None)
        command(f"rank-{kind}-model", rank_slates, "articles", "impressions", "model", config=None)
        command(f"evaluate-{kind}-model", rank_slates, "articles", "impressions", "model", config=None)
    command("stream-ingest", stream_ingest, "events", "log", articles=None, lateness=0, late="reject")
    command("stream-checkpoint", stream_checkpoint, "log", "out")
    command("stream-replay", stream_replay, "log", "articles", "as_of", config=None, checkpoint=None)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = spark or session()
        with deadline(spark, a.deadline, a.command) if a.deadline is not None else nullcontext():
            found = a.run(a, spark)
        sys.stdout.write(sinks.dump(found))
    except (OSError, ValueError, PySparkException) as error:
        sys.stderr.write(f"{error}\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
