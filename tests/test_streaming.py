"""The event log: idempotent, atomic, late per user; live profiles equal batch ones."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from slatewright.config import FeedConfig
from slatewright.operators import profiles
from slatewright.streaming import records, store

T0 = "2026-01-01T00:00:00+00:00"


def line(event_id, day, user="u", item="a", kind="click", weight=1.0):
    return json.dumps({"schema_version": 1, "event_id": event_id, "user_id": user, "item_id": item, "timestamp": f"2026-01-{1 + day:02d}T00:00:00Z", "type": kind, "weight": weight})


def frame(spark, *lines):
    return store.parsed(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))


@pytest.fixture
def catalog(spark):
    start = 1_700_000_000_000_000
    return spark.createDataFrame([("a", ["x"], "s", start, 0.5, 0.5), ("b", ["y"], "s", start, 0.5, 0.5), ("c", ["x", "y"], "s", start, 0.5, 0.5)], "id string, topics array<string>, source string, published_us long, quality double, popularity double")


def test_records():
    r = records.parse(line("e", 2))
    assert r.order == (r.at, "e") and records.parse(r.canonical()).digest() == r.digest()
    good = json.loads(line("e", 2))
    for bad in (good | {"x": 1}, good | {"type": "buy"}, good | {"weight": 0}, good | {"weight": True}, good | {"timestamp": "2026-01-01T00:00:00"}, good | {"user_id": " u"}, good | {"schema_version": 2}):
        with pytest.raises(ValueError):
            records.parse(json.dumps(bad))
    assert records.chain(["a", "b"]) != records.chain(["b", "a"])


def test_ingest(spark, catalog, tmp_path):
    log = store.EventLog(spark, str(tmp_path / "log"))
    assert log.ingest(frame(spark, line("1", 1), line("2", 3), line("1", 1)), catalog)["accepted"] == 2
    assert log.ingest(frame(spark, line("1", 1)), catalog) == {"received": 1, "accepted": 0, "late": 0, "users": 0, "duplicates": 1}
    saved = log.checkpoint()
    for bad in (line("1", 2), line("3", 2), line("4", 5, item="zz")):
        with pytest.raises(store.StreamError):
            log.ingest(frame(spark, line("9", 9), bad), catalog)
    assert log.checkpoint() == saved and log.log().count() == 2
    assert log.ingest(frame(spark, line("5", 3)), catalog)["accepted"] == 1  # equal to the mark is in time
    with pytest.raises(store.StreamError):
        log.restore(saved)
    with pytest.raises(PySparkException):
        log.ingest(frame(spark, "{}"), catalog)


def test_rebuild_and_shuffled_replay(spark, catalog, tmp_path):
    rng = random.Random(7)
    lines = [line(f"e{i}", rng.randint(0, 20), f"u{i % 4}", rng.choice("abc"), rng.choice(records.TYPES)) for i in range(40)]
    config, at = FeedConfig(), 1_770_000_000_000_000
    results = []
    for k in range(2):
        log = store.EventLog(spark, str(tmp_path / str(k)), late="accept-rebuild")
        for i in range(0, 40, 20):
            log.ingest(frame(spark, *lines[i : i + 20]), catalog)
        results.append({(r["user_id"], r["topic"]): r["weight"] for r in log.weights_at(catalog, config, at).collect()})
        rng.shuffle(lines)
    assert results[0] == pytest.approx(results[1])


def test_stream_is_idempotent_and_live_profiles_match(spark, catalog, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rng = random.Random(8)
    for f in range(2):
        (src / f"{f}.jsonl").write_text("\n".join(line(f"e{f}-{i}", 3 * f + rng.randint(0, 2), f"u{i % 3}", rng.choice("abc"), rng.choice(records.TYPES)) for i in range(12)) + "\n")
    log = store.EventLog(spark, str(tmp_path / "log"), late="accept-rebuild")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
    for _ in range(2):
        store.start(lines, log, str(tmp_path / "cp"), catalog).awaitTermination(120)
    assert log.log().count() == 24
    config = FeedConfig()
    batch = profiles.weights(profiles.visible(log.events(), catalog, 1_800_000_000_000_000), config, 1_800_000_000_000_000)
    want = {(r["user_id"], r["topic"]): r["weight"] for r in batch.collect()}
    log.events().join(catalog.selectExpr("id as article_id", "topics"), "article_id").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    live = store.live_profiles(events.select("user_id", "event_id", "occurred_us", "kind", "weight", "topics"), config)
    q = live.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "lc")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user_id"], r["topic"]): r["weight"] for r in spark.sql("select * from live").collect()}
    assert got == pytest.approx(want)
