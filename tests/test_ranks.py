"""Ranks, running sums, order statistics, histories and best candidates: against plain
Python, with one group that holds half the rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from slatewright.config import FeedConfig
from slatewright.operators import candidates, profiles, ranks, scoring, slates
from slatewright.tables import settle, split_join


def spread_of(df, where):
    """Tasks that the rows of a group come from, and the share of the largest."""
    n = [r["count"] for r in df.where(where).groupBy(F.spark_partition_id()).count().collect()]
    return len(n), max(n) / sum(n)


def skewed(n, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, 1.5, rng.random(), rng.gauss(0, 9)])) for _ in range(n)]


def test_running_sums_of_a_group_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    got = ranks.running(spark.createDataFrame(rows, "g string, i int, x long"), ["g"], ["i"], {"before": "x", "place": F.lit(1)}, {"all": "before"})
    sums, places, want = {}, {}, {}
    for g, i, x in rows:
        want[i] = (sums.get(g, 0), places.get(g, 0))
        sums[g], places[g] = sums.get(g, 0) + (x or 0), places.get(g, 0) + 1
    settled = settle(got)
    assert {r["i"]: (r["before"], r["place"]) for r in settled.collect()} == want
    assert {(r["g"], r["all"]) for r in settled.collect()} == set(sums.items())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks, most = spread_of(ranks.running(spark.createDataFrame(rows, "g string, i int, x long"), ["g"], ["i"], {"before": "x"}), "g = 'hot'")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks >= 2 and most < 0.9


def test_order_statistics(spark):
    rows = skewed(2000) + [("one", 4.0), ("none", None), ("tied", 2.0), ("tied", 2.0), ("tied", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    fractions = {"p0": 0.0, "low": 0.025, "mid": 0.5, "p9": 0.9, "p1": 1.0}
    got = {r["g"]: r for r in ranks.percentiles(df, ["g"], "x", fractions).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs.sort()
        for name, p in fractions.items():
            at = p * (len(xs) - 1)
            low, part = int(at), at - int(at)
            assert got[g][name] == pytest.approx(xs[low] * (1 - part) + xs[min(low + 1, len(xs) - 1)] * part)
        assert got[g]["mid"] == pytest.approx(statistics.median(xs))
    ends = {r["g"]: (r["low"], r["high"]) for r in ranks.outward(df, ["g"], "x").collect()}
    assert ends == {g: (xs[int(0.025 * (len(xs) - 1))], xs[-int(-(0.975 * (len(xs) - 1)) // 1)]) for g, xs in groups.items()}


def test_order_statistics_of_nothing(spark):
    assert ranks.percentiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"mid": 0.5}).collect() == []
    whole = ranks.percentiles(spark.createDataFrame([(1.0,), (3.0,)], "x double"), [], "x", {"mid": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(2.0,)]


def test_split_join_of_a_hot_key(spark):
    left = spark.createDataFrame([("hot", i) for i in range(5000)] + [(None, -1), ("cold", -2)], "k string, i int")
    right = settle(spark.createDataFrame([("hot", 1, 5000), ("cold", 2, 1)], "k string, v int, n long"))
    got = split_join(left, right, ["k"], "n", "left")
    assert sorted((r["i"], r["v"]) for r in got.collect() if r["i"] < 3) == [(-2, 2), (-1, None), (0, 1), (1, 1), (2, 1)]
    assert got.count() == 5002


@pytest.fixture(scope="module")
def events(spark):
    """Half of all events are one user's; times are tied."""
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        user = "hot" if rng.random() < 0.5 else f"u{rng.randrange(30)}"
        topics = [f"t{k}" for k in sorted(rng.sample(range(5), rng.choice([1, 2])))]
        rows.append((i, user, f"d{rng.randrange(40):02d}", rng.choice(["view", "click", "like", "hide"]), rng.randrange(300) * 3_600_000_000, 1.0, topics))
    return rows, spark.createDataFrame(rows, "event_id long, user_id string, article_id string, kind string, occurred_us long, weight double, topics array<string>")


@pytest.mark.parametrize("frame", ["range", "rows"])
def test_history_interest(spark, events, frame):
    rows, df = events
    config = FeedConfig()
    signals = config.signals()
    got = {r["event_id"]: r["interest"] for r in profiles.history_interest(df, config, frame=frame).collect()}
    assert len(got) == len(rows)
    for i, user, _, _, at, _, topics in random.Random(5).sample(rows, 150):
        totals = {}
        for j, other, _, kind, t, w, own in rows:
            if other == user and (t < at or frame == "rows" and t == at and j < i):
                for topic in own:
                    totals[topic] = totals.get(topic, 0.0) + signals[kind] * w * 0.5 ** ((at - t) / 86_400_000_000 / 30) / len(own)
        scale = max(map(abs, totals.values()), default=0)
        raw = sum(totals.get(t, 0) for t in topics) / scale / len(topics) if scale else 0
        assert got[i] == pytest.approx(min(1, max(0, (raw + 1) / 2)), abs=1e-9)


def test_prior_clicks(events):
    rows, df = events
    got = {r["event_id"]: (r["clicks"], r["last"]) for r in profiles.prior_clicks(df, 3).collect()}
    for i, user, _, _, at, _, _ in rows:
        past = sorted((t, a, j) for j, other, a, kind, t, _, _ in rows if other == user and t < at and kind == "click")
        assert got[i] == (len(past), [a for _, a, _ in past[-3:]])


# ------------------------------------------------------------------ candidates


def feed(spark, n_users, n_articles, seed=6):
    rng = random.Random(seed)
    hours = 3_600_000_000
    articles = [(f"d{i:05d}", ["en" if rng.random() < 0.6 else "de", f"t{rng.randrange(3)}"], rng.choice(["s1", "s1", "s1", "s2", None]), rng.randrange(600) * hours, rng.choice([0.25, 0.5, 0.75]), rng.random()) for i in range(n_articles)]
    catalog = spark.createDataFrame(articles, "id string, topics array<string>, source string, published_us long, quality double, popularity double")
    users = [(f"u{k}", {t: rng.uniform(-1, 1) for t in rng.sample(["en", "de", "t0", "t1", "t2"], 3)} if k % 5 else {}, sorted(rng.sample([a[0] for a in articles], min(20, n_articles))), 20) for k in range(n_users)]
    return settle(spark.createDataFrame(users, "user_id string, weights map<string,double>, seen array<string>, event_count long")), settle(catalog), 500 * hours


@pytest.mark.parametrize("first", [3, 64])
@pytest.mark.parametrize("config", [FeedConfig(), FeedConfig(exclude_seen=False, max_per_source=3), FeedConfig(minimum_score=0.55), FeedConfig(exploration_weight=1.0), FeedConfig(rerank_strategy="calibrated", size=1)])
def test_contenders_give_the_slates_of_all_candidates(spark, monkeypatch, config, first):
    monkeypatch.setattr(candidates, "FIRST", first)
    users, catalog, as_of = feed(spark, 12, 700)
    want = slates.feeds(scoring.score(users, catalog, config, as_of), config, users)
    got = slates.feeds(candidates.contenders(users, catalog, config, as_of), config, users, whole=False)
    columns = ["user_id", "rank", "article_id", "score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


@pytest.mark.parametrize("first", [1, 64])
def test_best_of_all_classes(spark, monkeypatch, first):
    monkeypatch.setattr(candidates, "FIRST", first)
    users, catalog, as_of = feed(spark, 10, 500)
    config = FeedConfig()
    scored = [(r["user_id"], r["id"], round(r["total"], 6)) for r in scoring.score(users, catalog, config, as_of).collect()]
    want = {u: [(i, t) for _, i, t in sorted((x for x in scored if x[0] == u), key=lambda x: (-x[2], x[1]))[:7]] for u, _, _ in scored}
    got = {}
    for r in candidates.best(users, catalog, config, as_of, 7, by_class=False, digits=6).collect():
        got.setdefault(r["user_id"], []).append((r["id"], r["total"]))
    assert {u: sorted(v, key=lambda x: (-x[1], x[0])) for u, v in got.items()} == want


def test_rows_joined_grow_less_than_users_times_articles(spark):
    joined = {}
    for n in (500, 8000):
        users, catalog, as_of = feed(spark, 8, n)
        counts: list[int] = []
        candidates.contenders(users, catalog, FeedConfig(), as_of, counts).count()
        joined[n] = sum(counts)
        assert joined[n] < 0.5 * users.count() * catalog.where(F.col("published_us") <= as_of).count() or n == 500
    assert joined[8000] < 6 * joined[500]  # of 16 times the articles


def test_no_candidates(spark):
    users, catalog, _ = feed(spark, 3, 20)
    assert candidates.contenders(users, catalog, FeedConfig(), -1).collect() == []
    assert candidates.contenders(users.limit(0), catalog, FeedConfig(), 10**18).collect() == []
