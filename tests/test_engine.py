"""Operators against small brute-force versions and hand-made cases."""

import itertools
import json
import math
import random
import threading
import urllib.error
import urllib.request
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException

from slatewright.config import FeedConfig, ablation, policies
from slatewright.operators import comparisons, impressions, logged, metrics, neural, profiles, rankers, scoring, slates
from slatewright.sources import readers, sinks, strict_json, synthetic

DAY = 86_400_000_000
T0 = 1_700_000_000_000_000


def catalog_frame(spark, rows):
    return spark.createDataFrame(rows, "id string, topics array<string>, source string, published_us long, quality double, popularity double")


def events_frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id string, article_id string, kind string, occurred_us long, propensity double, weight double")


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    items = [(f"a{i:02d}", rng.sample(["x", "y", "z", "w"], rng.randint(1, 2)), f"s{rng.randint(0, 3)}", T0 - rng.randint(0, 20) * DAY, rng.random(), rng.random()) for i in range(30)]
    log = [(f"u{rng.randint(0, 4)}", f"a{rng.randint(0, 32):02d}", rng.choice(["view", "click", "like", "hide"]), T0 + rng.randint(0, 6) * DAY // 2, 0.5, 1.0) for _ in range(60)]
    return items, log, catalog_frame(spark, items), events_frame(spark, log)


def brute_profile(items, log, user, as_of, strict=False):
    by = {i[0]: i for i in items}
    totals, seen, n = {}, set(), 0
    for u, a, kind, at, _, w in log:
        if u != user or at > as_of or strict and at == as_of or a not in by or by[a][3] > as_of:
            continue
        s = FeedConfig().signals()[kind] * w * 0.5 ** ((as_of - at) / DAY / 30)
        for t in by[a][1]:
            totals[t] = totals.get(t, 0) + s / len(by[a][1])
        seen.add(a)
        n += 1
    top = max(map(abs, totals.values()), default=1)
    return {t: v / top for t, v in totals.items() if v}, seen, n


def test_profiles(world):
    items, log, c, e = world
    as_of = T0 + 2 * DAY
    got = {r["user_id"]: r for r in profiles.profiles(profiles.visible(e, c, as_of), FeedConfig(), as_of).collect()}
    for u in {r[0] for r in log}:
        w, seen, n = brute_profile(items, log, u, as_of)
        if n:
            assert got[u]["weights"] == pytest.approx(w) and set(got[u]["seen"]) == seen and got[u]["event_count"] == n
        else:
            assert u not in got


def test_future_and_tied_rows_change_nothing(spark, world):
    items, log, c, e = world
    config = FeedConfig()
    held = {r["user_id"]: r for r in metrics.holdouts(e, c, T0 + 9 * DAY).collect()}
    base = {r["user_id"]: r["ranked_ids"] for r in metrics.leave_last_out(e, c, config, T0 + 9 * DAY).collect()}
    tied = [(u, "a00", "hide", r["holdout_us"], None, 1.0) for u, r in held.items()]
    more = events_frame(spark, log + tied)
    again = {r["user_id"]: r["ranked_ids"] for r in metrics.leave_last_out(more, c, config, T0 + 9 * DAY).collect()}
    assert base == again


def test_history_frames_with_ties(world):
    items, log, c, e = world
    v = profiles.visible(e, c, T0 + 9 * DAY)
    by = {i[0]: i for i in items}
    for frame in ("range", "rows"):
        got = {r["event_id"]: r["interest"] for r in profiles.history_interest(v, FeedConfig(), frame=frame).collect()}
        for k, (u, a, _, at, _, _) in enumerate(log):
            if a not in by:
                continue
            past = [x for j, x in enumerate(log) if x[3] < at or frame == "rows" and x[3] == at and j < k]
            w, _, _ = brute_profile(items, past, u, at)
            want = max(0, min(1, (sum(w.get(t, 0) for t in by[a][1]) / len(by[a][1]) + 1) / 2))
            assert got[k] == pytest.approx(want, abs=1e-9)


def brute_slate(rows, config, reader=None):
    left, out, mass = {r["id"]: r for r in rows}, [], {}
    while left and len(out) < config.size:
        best = None
        for r in left.values():
            if sum(o["source"] == r["source"] for o in out) >= config.max_per_source:
                continue
            if config.rerank_strategy == "mmr":
                red = max((len(set(r["topics"]) & set(o["topics"])) / len(set(r["topics"]) | set(o["topics"])) for o in out), default=0.0)
                value = config.mmr_lambda * r["total"] - (1 - config.mmr_lambda) * red
            else:
                m = dict(mass)
                for t in r["topics"]:
                    m[t] = m.get(t, 0) + 1 / len(r["topics"])
                n = sum(m.values())
                kl = max(0.0, sum(p * math.log(p / (0.99 * m.get(t, 0) / n + 0.01 * p)) for t, p in reader.items()))
                value = (1 - config.calibration_weight) * r["total"] - config.calibration_weight * kl
            best = max(best or (value, r["total"], r["id"]), (value, r["total"], r["id"]))
        if best is None:
            break
        r = left.pop(best[2])
        out.append(r)
        for t in r["topics"]:
            mass[t] = mass.get(t, 0) + 1 / len(r["topics"])
    return [o["id"] for o in out]


@pytest.mark.parametrize("strategy", ["mmr", "calibrated"])
def test_slates(world, strategy):
    items, log, c, e = world
    as_of = T0 + 9 * DAY
    config = FeedConfig(rerank_strategy=strategy, size=6, exclude_seen=False)
    scored = scoring.score(profiles.profiles(profiles.visible(e, c, as_of), config, as_of), c, config, as_of).persist()
    rows = [r.asDict() for r in scored.collect()]
    got = {}
    for r in slates.feeds(scored, config).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["article_id"])
    for u, own in itertools.groupby(sorted(rows, key=lambda r: r["user_id"]), key=lambda r: r["user_id"]):
        own = list(own)
        good = {t: w for t, w in own[0]["weights"].items() if w > 0}
        reader = {t: w / sum(good.values()) for t, w in good.items()}
        assert got[u] == brute_slate(own, config, reader)


def test_short_slate_under_source_cap(spark):
    c = catalog_frame(spark, [(f"a{i}", ["x"], "one", T0, 0.5, 0.5) for i in range(5)])
    e = events_frame(spark, [("u", "zz", "click", T0, 0.5, 1.0), ("u", "a0", "view", T0, 0.5, 1.0)])
    config = FeedConfig(max_per_source=2)
    scored = scoring.score(profiles.profiles(profiles.visible(e, c, T0 + 1), config, T0 + 1), c, config, T0 + 1)
    assert slates.feeds(scored, config).count() == 2


def test_impression_goldens(spark):
    rows = [("i", "u", T0, f"a{k}", k, c, s) for k, (c, s) in enumerate(zip((1, 0, 1, 0), (0.9, 0.8, 0.7, 0.6), strict=True), 1)]
    df = spark.createDataFrame(rows, "impression_id string, user_id string, occurred_us long, article_id string, pos int, clicked int, score double")
    r = impressions.metrics(df, (2, 4)).first()
    assert r["auc"] == pytest.approx(3 / 4) and r["mrr"] == pytest.approx((1 + 1 / 3) / 2)
    assert r["ndcg_2"] == pytest.approx(1 / (1 + 1 / math.log2(3))) and r["ndcg_4"] == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))


def test_one_class_impression_is_an_error(spark):
    df = spark.createDataFrame([("i", "u", T0, "a", 1, 1, 0.5)], "impression_id string, user_id string, occurred_us long, article_id string, pos int, clicked int, score double")
    with pytest.raises(PySparkException):
        impressions.metrics(df).collect()


def test_random_slates_against_pair_counts(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        n = rng.randint(2, 12)
        labels = [1, 0] + [rng.randint(0, 1) for _ in range(n - 2)]
        scores = [rng.randint(0, 4) / 4 for _ in range(n)]
        rows += [(f"i{i}", "u", T0, f"a{k}", k, c, s) for k, (c, s) in enumerate(zip(labels, scores, strict=True), 1)]
        pairs = [(p, q) for p, a in zip(scores, labels, strict=True) if a for q, b in zip(scores, labels, strict=True) if not b]
        want[f"i{i}"] = sum(1 if p > q else 0.5 if p == q else 0 for p, q in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "impression_id string, user_id string, occurred_us long, article_id string, pos int, clicked int, score double")
    assert {r["impression_id"]: r["auc"] for r in impressions.metrics(df).collect()} == pytest.approx(want)


def test_logged_interval(spark):
    rng = random.Random(2)
    rows = [(f"u{i // 25}", "a", "click" if rng.random() < (0.9 if i // 25 % 2 else 0.1) else "view", T0, 0.5, 1.0) for i in range(500)]
    e = events_frame(spark, rows)
    r = logged.interval(spark, logged.observations(e), resamples=200)
    flat = [1.0 if x[2] == "click" else 0.0 for x in rows]
    _, lo, hi = logged.bootstrap_mean(flat, 200)
    assert r["lower"] < r["estimate"] < r["upper"] and r["upper"] - r["lower"] > 2 * (hi - lo)
    few = logged.interval(spark, logged.observations(events_frame(spark, rows[:30])))
    assert few["lower"] is None and "users" in few["reason"]
    with pytest.raises(ValueError, match="resampled"):
        logged.interval(spark, logged.observations(e), resamples=logged.MOST_UNITS)
    none = logged.interval(spark, logged.observations(events_frame(spark, [("u", "a", "click", T0, None, 1.0)])))
    assert none["estimate"] == 0.0 and none["lower"] is None


def test_percentiles():
    assert logged.percentile([1.0], 0.3) == 1.0 and logged.percentile([1.0, 2.0, 4.0], 0.75) == 3.0
    assert logged.order_statistic_interval([float(i) for i in range(101)]) == (2.0, 98.0)


POINTS = "policy string, ndcg double, worst_cohort_ndcg double, ndcg_gap double, topic_calibration double, topic_calibration_gap double"


def test_frontier(spark):
    """Gaps and calibration are better when lower; a missing value or a missed bound keeps a
    policy off; of equals the least name stands."""
    points = spark.createDataFrame([("b", 1.0, 1.0, 0.1, 0.1, 0.1), ("a", 1.0, 1.0, 0.1, 0.1, 0.1), ("c", 1.0, 1.0, 0.1, 0.2, 0.1), ("d", 2.0, 0.0, 0.9, 0.9, 0.9), ("e", 9.0, 9.0, 0.0, None, 0.0), ("f", 0.5, 1.0, 0.05, 0.1, 0.1)], POINTS)
    names = lambda df: {r["policy"] for r in df.collect()}
    assert names(comparisons.frontier(points)) == {"a", "d", "f"}
    assert names(comparisons.frontier(points, {"maximum_ndcg_gap": 0.5, "minimum_ndcg": 0.6})) == {"a"}
    missed = {r["policy"]: r["v"] for r in points.select("policy", comparisons.violations({"maximum_topic_calibration": 0.15, "minimum_worst_cohort_ndcg": 0.5}).alias("v")).collect()}
    assert missed == {"a": [], "b": [], "c": ["maximum_topic_calibration"], "d": ["minimum_worst_cohort_ndcg", "maximum_topic_calibration"], "e": ["maximum_topic_calibration"], "f": []}
    with pytest.raises(ValueError):
        comparisons.violations({"minimum_hits": 1.0})


SAMPLE = "user_id string, ndcg double, hit_rate double, reciprocal_rank double, intra_list_diversity double, source_diversity double, topic_calibration double"


def test_cohort_gaps_need_two(spark):
    s = spark.createDataFrame([("u1", 1.0, 1.0, 1.0, 0.2, 0.4, 0.5), ("u2", 0.0, 0.0, 0.0, 0.4, 0.4, None), ("u3", 0.5, 0.0, 0.0, 0.4, 0.4, 0.1)], SAMPLE)
    of = lambda *labels: spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(labels, 1)], "user_id string, cohort string")
    two, one, full = (comparisons.gaps(comparisons.audit(s, of(*x))).first() for x in (("x", "y", "x"), ("x", "x", "x"), ("x", "x", "y")))
    assert two["ndcg_gap"] == 0.75 and two["topic_calibration_gap"] is None
    assert one["ndcg_gap"] is None and one["topic_calibration_gap"] is None
    assert full["topic_calibration_gap"] == pytest.approx(0.4)
    point = comparisons.objectives(comparisons.audit(s.withColumn("policy", comparisons.F.lit("p")), of("x", "x", "y"), ("policy",))).first()
    assert (point["ndcg"], point["worst_cohort_ndcg"], point["ndcg_gap"], point["topic_calibration"]) == pytest.approx((0.5, 0.5, 0.0, 0.3))
    low = comparisons.audit(s, of("x", "x", "y"), minimum=2).orderBy("cohort").collect()
    assert [r["calibrated_users"] for r in low] == [1, 1] and all(r["topic_calibration"] is None for r in low)


def test_cohort_intervals_do_not_depend_on_other_cohorts(spark):
    rng = random.Random(2)
    rows = [(f"u{i}", rng.random(), 0.0, 0.0, 0.0, 0.0, None if i % 3 else rng.random()) for i in range(30)]
    s, label = spark.createDataFrame(rows, SAMPLE), lambda i: "x" if i < 12 else "y"
    of = spark.createDataFrame([(f"u{i}", label(i)) for i in range(30)], "user_id string, cohort string")
    both, alone = comparisons.cohort_intervals(s, of, "ndcg", draws=50), comparisons.cohort_intervals(s.limit(30), of.where("cohort = 'x'"), "ndcg", draws=50)
    assert both["x"] == alone["x"] and set(both) == {"x", "y"}
    values = [r[1] for r in sorted(rows) if label(int(r[0][1:])) == "x"]
    assert both["x"] == logged.bootstrap_mean(values, 50, 0.95, comparisons.cohort_seed(17, "x"))
    assert comparisons.cohort_intervals(s, of, "topic_calibration", draws=5, minimum=5)["x"] is None


def test_policies_share_what_they_agree_in(spark, world):
    """evaluate() of several policies equals each alone; calibration by brute force."""
    items, log, c, e = world
    config = FeedConfig(size=4)
    configs = policies(config, 4) | {"slow": config.with_(profile_half_life_days=300.0), "calibrated": config.with_(rerank_strategy="calibrated"), "strict": config.with_(minimum_score=0.55)}
    got = {(r["policy"], r["user_id"]): r for r in metrics.evaluate(e, c, configs, T0 + 9 * DAY, 4).collect()}
    for name, one in configs.items():
        for r in metrics.leave_last_out(e, c, one, T0 + 9 * DAY, 4).collect():
            other = got.pop((name, r["user_id"]))
            assert all(other[k] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v) for k, v in r.asDict().items())
            w, _, _ = brute_profile(items, log, r["user_id"], r["holdout_us"], strict=True)
            good = {t: v for t, v in w.items() if v > 0 and one.profile_half_life_days == 30}
            if good and r["ranked_ids"]:
                of, want = {i[0]: i[1] for i in items}, 0.0
                for t, v in good.items():
                    p = v / sum(good.values())
                    q = sum(1 / len(of[a]) for a in r["ranked_ids"] if t in of[a]) / len(r["ranked_ids"])
                    want += p * math.log(p / (0.99 * q + 0.01 * p))
                assert r["topic_calibration"] == pytest.approx(max(want, 0), abs=1e-9)
    assert not got


def test_resampled_policies(spark, world):
    """Coverage and Gini are made anew from each draw's users."""
    items, _, c, e = world
    configs = policies(FeedConfig(size=4), 4)
    samples = metrics.evaluate(e, c, configs, T0 + 9 * DAY, 4).persist()
    rows = {(r["policy"], r["draw"]): r for r in comparisons.resampled(spark, samples, c, draws=6, seed=3).collect()}
    by = {}
    for r in samples.collect():
        by.setdefault(r["policy"], {})[r["user_id"]] = r
    users = sorted(by["full"])
    for name in configs:
        for d, one in enumerate(logged.draws(len(users), 6, 3)):
            some = [by[name][users[i]] for i in one]
            assert rows[name, d]["ndcg"] == pytest.approx(sum(r["ndcg"] for r in some) / len(some))
            counts = {}
            for r in some:
                for a in r["ranked_ids"]:
                    counts[a] = counts.get(a, 0) + 1
            n, ordered = len(counts), sorted(counts.values())
            gini = 2 * sum(i * x for i, x in enumerate(ordered, 1)) / (n * sum(ordered)) - (n + 1) / n
            last = max(r["holdout_us"] for r in some)
            assert rows[name, d]["exposure_gini"] == pytest.approx(gini) and rows[name, d]["catalog_coverage"] == pytest.approx(n / sum(i[3] <= last for i in items))
    with pytest.raises(ValueError):
        comparisons.resampled(spark, samples, c, draws=comparisons.MOST_UNITS)
    samples.unpersist()


def test_text_functions_fold_as_python_does(spark):
    from slatewright.functions import scalars

    rng = random.Random(6)
    odd = [c for c in map(chr, range(0x110000)) if c.casefold() != c and not 0xD800 <= ord(c) <= 0xDFFF]
    texts = ["Straße\n", "STRASSE", "\tx", "ΣΊΣΥΦΟς", "İI", "ﬃ\u00a0", "", "  ", "\u2003A\u3000", "a_b-C3²Ⅷ", *("".join(rng.choice(odd) for _ in range(20)) for _ in range(150))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    col = scalars.F.col("t")
    for r in df.select("i", scalars.casefold(col).alias("fold"), scalars.strip(col).alias("strip"), scalars.normalize_topics(scalars.F.array(col, col)).alias("topics"), scalars.is_identifier(col).alias("ok")).collect():
        t = texts[r["i"]]
        assert r["fold"] == t.casefold() and r["strip"] == t.strip()
        assert r["topics"] == ([t.strip().casefold()] if t.strip() else [])
        if r["i"] < 10:  # newer letters are printable to the engine whose tables know them
            assert r["ok"] == (bool(t) and t == t.strip() and t.isprintable() and len(t) <= 256)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session(spark, zone):
    from slatewright.functions import scalars

    us = [0, -1, 1_710_054_000_123_456, 1_710_054_000_000_000, 1_699_164_000_000_000, 951_782_400_000_001]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(u, datetime.fromtimestamp(u // 1_000_000, UTC).strftime("%m/%d/%Y %I:%M:%S %p").lstrip("0")) for u in us], "u long, t string")
        ntz = scalars.F.expr("timestamp_ntz'2024-03-10 02:30:00.5'")
        rows = df.select("u", scalars.utc_text(scalars.F.timestamp_micros("u")).alias("text"), scalars.F.unix_micros(scalars.behavior_timestamp(scalars.F.col("t"), "-08:00")).alias("at"), scalars.instant_us(ntz, "timestamp_ntz", zone).alias("ntz")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for r in rows:
        at = datetime.fromtimestamp(r["u"] // 1_000_000, UTC).replace(microsecond=r["u"] % 1_000_000)
        assert r["text"] == at.isoformat() and r["at"] == r["u"] // 1_000_000 * 1_000_000 + 8 * 3_600_000_000 and r["ntz"] == 1_710_037_800_500_000


def test_fixed_offsets():
    from slatewright.functions.scalars import fixed_offset

    assert [fixed_offset(x) for x in ("-08:00", 5.5, -14, "+00:00:30")] == ["-08:00", "+05:30", "-14:00", "+00:00:30"]
    for bad in ("8", "+15:00", 14.5, float("nan"), True, 0.0001):
        with pytest.raises(ValueError):
            fixed_offset(bad)


def test_config():
    c = FeedConfig.from_json('{"size": 5, "mmr_lambda": 0.5}')
    assert c.size == 5 and set(policies(c, 8, 100)) == {"full", "relevance_only", "popularity", "recency"} and policies(c, 8, 100)["full"].size == 8
    assert ablation(c, "novelty", 10).novelty_weight == 0 and ablation(c, "slate_diversity", 10).mmr_lambda == 1
    for bad in ({"size": 0}, {"mmr_lambda": 2.0}, {"other": 1}, {"article_half_life_hours": 0.0}, {"interest_weight": float("nan")}):
        with pytest.raises(ValueError):
            FeedConfig.from_mapping(bad)


def test_strict_json():
    assert strict_json.load('{"a": [1, 2.5, "[{"]}') == {"a": [1, 2.5, "[{"]}
    for bad in ('{"a": 1, "a": 2}', "NaN", "[1e999]", "[" * 300 + "]" * 300, "{"):
        with pytest.raises(ValueError):
            strict_json.load(bad)


def test_readers(spark, tmp_path):
    a = {"id": "a", "title": "T", "topics": [" X ", "x", "Straße"], "source": "s", "published_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps([a]))
    row = readers.articles(spark, str(tmp_path / "a.json")).first()
    assert row["topics"] == ["x", "strasse"] and row["quality"] == 0.5 and row["published_us"] == 1_704_067_200_000_000
    e = {"user_id": "u", "article_id": "a", "kind": "click", "occurred_at": "2024-01-01T01:00:00+01:00"}
    (tmp_path / "e.jsonl").write_text(json.dumps(e) + "\n\n" + json.dumps(e | {"propensity": 0.5}) + "\n")
    assert [r["propensity"] for r in readers.events(spark, str(tmp_path / "e.jsonl")).collect()] == [None, 0.5]
    for bad in (e | {"kind": "buy"}, e | {"extra": 1}, e | {"occurred_at": "2024-01-01T00:00:00"}, e | {"weight": 0}):
        (tmp_path / "bad.jsonl").write_text(json.dumps(bad))
        with pytest.raises(PySparkException):
            readers.events(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "twice.json").write_text(json.dumps([a, a]))
    with pytest.raises(ValueError):
        readers.articles(spark, str(tmp_path / "twice.json"))


def test_tsv(spark, tmp_path):
    (tmp_path / "news.tsv").write_text("n1\tSports\tTennis\tA \"quoted\" title\tabs\turl\t[]\t[]\n\nn2\tnews\tnews\t\tabs\turl\t[]\t[]\r\n")
    news = {r["id"]: r for r in readers.news_tsv(spark, str(tmp_path / "news.tsv"), T0).collect()}
    assert news["n1"]["topics"] == ["sports", "tennis"] and news["n1"]["title"] == 'A "quoted" title' and news["n2"]["topics"] == ["news"] and news["n2"]["title_missing"]
    (tmp_path / "b.tsv").write_text("1\tu\t11/15/2019 8:55:22 AM\tn1\tn1-1 n2-0\n")
    rows = readers.behaviors_tsv(spark, str(tmp_path / "b.tsv"), "-08:00").orderBy("pos").collect()
    assert [(r["article_id"], r["clicked"]) for r in rows] == [("n1", 1), ("n2", 0)]
    assert rows[0]["occurred_us"] == int(datetime(2019, 11, 15, 16, 55, 22, tzinfo=UTC).timestamp() * 1e6)


def test_sinks(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("old")
    sinks.write_all({str(a): "1", str(b): "2"})
    assert a.read_text() == "1" and b.read_text() == "2" and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(OSError):
        sinks.write_all({str(a): "3", str(tmp_path / "none" / "c"): "4"})
    assert a.read_text() == "1"
    path = sinks.register(str(tmp_path / "r"), {"x": 1})
    assert sinks.register(str(tmp_path / "r"), {"x": 1}) == path and sinks.verify(path, {"x": 1}) == {"x": 1}
    with pytest.raises(ValueError):
        sinks.verify(path, {"x": 2})
    assert "&lt;b&gt;" in sinks.feed_report("<b>", [])


def test_rankers_learn_and_save():
    rng = random.Random(1)
    x = [[1.0] + [rng.random() for _ in range(6)] for _ in range(80)]
    y = [float(v[1] > 0.5) for v in x]
    m = rankers.Ranker("pointwise").fit_points(x, y)
    assert m.weights[1] > 0 and max(abs(w) for w in m.weights[2:]) < m.weights[1]
    assert rankers.Ranker.from_json(m.to_json()).weights == m.weights
    with pytest.raises(ValueError):
        rankers.Ranker.from_json(m.to_json().replace('"epochs": 20', '"epochs": 21'))
    pairs = rankers.Ranker("pairwise").fit_pairs([([x[i]], [x[j]]) for i in range(40) for j in range(40) if y[i] > y[j]][:60])
    lists = rankers.Ranker("listwise").fit_lists([([x[i], x[j]], [True, False]) for i in range(40) for j in range(40) if y[i] > y[j]][:60])
    assert pairs.weights[1] > 0 and lists.weights[1] > 0 and pairs.weights[0] == 0
    with pytest.raises(ValueError):
        rankers.Ranker("pointwise").fit_points(x[:1], [1.0])


def test_pointwise_fit_matches_a_plain_loop():
    rng = random.Random(9)
    x, y = [[1.0, rng.random(), rng.random()] for _ in range(12)], [float(i % 3 == 0) for i in range(12)]
    w, order, g = [0.0] * 3, list(range(12)), random.Random(17)
    for _ in range(20):
        g.shuffle(order)
        for i in order:
            err = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x[i], strict=True)))) - y[i]
            w = [a - 0.05 * (err * b + (0.001 * a if k else 0)) for k, (a, b) in enumerate(zip(w, x[i], strict=True))]
    assert rankers.Ranker("pointwise").fit_points(x, y).weights == pytest.approx(w)


def test_slate_features_see_nothing_of_the_same_time(spark):
    c = catalog_frame(spark, [("a", ["x"], "s", T0 - DAY, 0.5, 0.5), ("b", ["y"], "s", T0 - DAY, 0.5, 0.5)])
    rows = [("i1", "u", T0, 1, "a", 1), ("i1", "u", T0, 2, "b", 0), ("i2", "u", T0, 1, "a", 0), ("i2", "u", T0, 2, "b", 1), ("i3", "u", T0 + DAY, 1, "a", 1), ("i3", "u", T0 + DAY, 2, "b", 0)]
    shown = spark.createDataFrame(rows, readers.IMPRESSIONS)
    got = {(r["impression_id"], r["id"]): r["features"] for r in rankers.slate_features(shown, c, FeedConfig()).collect()}
    assert got["i1", "a"][1] == got["i2", "b"][1] == 0.5 and got["i1", "a"][4] == 1.0
    assert got["i3", "a"][1] == 1.0 and got["i3", "a"][4] == 0.0
    assert len(rankers.fit_listwise(rankers.slate_features(shown, c, FeedConfig())).weights) == 7


def test_neural_gradients_and_barrier():
    titles = {"a": "red fox", "b": "blue sky", "c": "red sky"}
    rows = [{"impression_id": "1", "user_id": "u", "at": 1, "candidates": [("a", True), ("b", False)]}, {"impression_id": "2", "user_id": "u", "at": 1, "candidates": [("c", True)]}, {"impression_id": "3", "user_id": "u", "at": 2, "candidates": [("b", True), ("c", False)]}]
    made, past = neural.contexts(rows, 10)
    assert [h for _, h in made] == [[], [], ["a", "c"]] and past["u"] == ["a", "c", "b"]
    m = neural.NeuralRanker(neural.NeuralConfig(dimension=3, epochs=1)).fit(titles, rows, 5)
    known = {a: m.ids(t) for a, t in titles.items()}

    def loss():
        u = m.bias + np.mean([m.vector(known[h]) for h in ("a", "c")], axis=0)
        return sum(math.log1p(math.exp(-(z if c else -z))) for a, c in rows[2]["candidates"] for z in [float(u @ m.vector(known[a]))])

    g, gb = m.gradients(rows[2], [known["a"], known["c"]], known)
    for i, j in itertools.product(range(1, len(m.embeddings)), range(3)):
        m.embeddings[i, j] += 1e-6
        up = loss()
        m.embeddings[i, j] -= 2e-6
        down = loss()
        m.embeddings[i, j] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[i, j], abs=1e-6)
    assert set(m.score(titles, [{"impression_id": "9", "user_id": "u", "at": 9, "candidates": [("a", False)]}])) == {"9"}
    with pytest.raises(ValueError):
        m.score(titles, [{"impression_id": "8", "user_id": "u", "at": 5, "candidates": [("a", False)]}])
    assert neural.select({"b": 1.0, "a": 1.0}) == "a" and neural.select({"b": 1.0, "a": 1.0}, "b") == "b"


def test_synthetic(spark):
    c, e = synthetic.catalog(spark, 40, T0), synthetic.interactions(spark, 40, 5, 6, T0)
    assert c.count() == 40 and e.count() == 30 and sorted(map(str, e.collect())) == sorted(map(str, synthetic.interactions(spark, 40, 5, 6, T0).collect()))


def test_server():
    from slatewright.serve import Snapshot, server

    s = server(Snapshot({"u": [("a", 0.9), ("b", 0.5)]}, {"k": 2}), token="t")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_address[1]}"

    def post(body, token="t"):
        r = urllib.request.Request(f"{url}/v1/rank", body.encode(), {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(r) as x:
                return x.status, json.loads(x.read())
        except urllib.error.HTTPError as x:
            return x.code, json.loads(x.read())

    assert json.loads(urllib.request.urlopen(f"{url}/health").read()) == {"status": "ok"}
    assert post('{"user_id": "u", "k": 1}') == (200, {"user_id": "u", "ranking": [{"rank": 1, "article_id": "a", "score": 0.9}]})
    assert post('{"user_id": "u", "candidate_ids": ["b"]}')[1]["ranking"][0]["article_id"] == "b"
    assert post("{}", "x")[0] == 401 and post('{"k": 1}')[0] == 400 and post('{"user_id": "u", "user_id": "v"}')[0] == 400
    s.shutdown()


@pytest.mark.parametrize("click", [0.7, -0.4, 0.0])
def test_slate_features_against_a_loop(spark, click):
    """Repeated candidates, ties in time, topics that stop being shown and articles without any."""
    rng, config = random.Random(8), FeedConfig(click_signal=click)
    items = [(f"a{k}", rng.sample(["x", "y", "z", "w"], k % 3), "s", T0 - 30 * DAY + k, 0.5, 0.5) for k in range(12)]
    shown = [(f"i{i}", f"u{i % 3}", T0 + (i // 6) * DAY, p, f"a{rng.randrange(12)}", rng.randrange(2)) for i in range(60) for p in range(3)]
    topics, want = {i[0]: i[1] for i in items}, []
    for i, u, t, _, a, clicked in shown:
        past, totals = [(x[4], x[2]) for x in shown if x[1] == u and x[5] and x[2] < t], {}
        for other, at in past:
            for w in topics[other]:
                totals[w] = totals.get(w, 0) + click * 0.5 ** ((t - at) / DAY / 30) / len(topics[other])
        scale = max(map(abs, totals.values()), default=0)
        own = [totals.get(w, 0) / scale if scale else 0 for w in topics[a]]
        want.append((i, a, clicked, round((sum(own) / len(own) + 1) / 2, 9) if own else 0.0, float(a not in [x for x, _ in past])))
    made = rankers.slate_features(spark.createDataFrame(shown, readers.IMPRESSIONS), catalog_frame(spark, items), config)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(user_id") == 1
    assert sorted((r["impression_id"], r["id"], r["clicked"], round(r["features"][1], 9), r["features"][4]) for r in made.collect()) == sorted(want)
