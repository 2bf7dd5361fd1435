"""Duplicates, conflicts and lateness: the stream's state gives what the batch plan gives."""

import json
import os
import random

import pytest

from slatewright.streaming import admission

DAY = 86_400_000_000
T0 = 20_000 * DAY


def plain(rows, lateness):
    """Verdicts and flags by arrival, row by row."""
    first, seen, verdicts, late = {}, {}, {}, {}
    for event, user, at, content, arrival in sorted(rows, key=lambda r: r[4]):
        verdicts[arrival] = "accepted" if event not in first else "duplicate" if first[event] == content else "conflict"
        first.setdefault(event, content)
        late[arrival] = user in seen and at < seen[user] - lateness
        seen[user] = max(seen.get(user, at), at)
    return verdicts, late


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = []
    for k in range(240):
        if made and rng.random() < 0.3:
            e, u, at, content, _ = rng.choice(made)
            made.append((e, u, at, content if rng.random() < 0.6 else content + "'", k))
        else:
            made.append((f"e{k}", "hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}", T0 + rng.randrange(20) * DAY, f"c{k}", k))
    return made


def streamed(spark, tmp_path, batches, of):
    source = tmp_path / "in"
    source.mkdir()
    for k, batch in enumerate(batches):
        (source / f"{k}.json").write_text("".join(json.dumps(dict(zip(admission.COLUMNS, r, strict=True))) + "\n" for r in batch))
        os.utime(source / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are read in order of their times
    records = spark.readStream.schema(admission.SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    query = of(records).writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(query.name).collect()


def test_batch_plans(spark, rows):
    df = spark.createDataFrame(rows, admission.SCHEMA).repartition(3)
    verdicts, late = plain(rows, 3 * DAY)
    assert {r["arrival"]: r["verdict"] for r in admission.once(df).collect()} == verdicts
    assert {r["arrival"]: r["late"] for r in admission.late(df, 3 * DAY).collect()} == late
    assert set(verdicts.values()) == {"accepted", "duplicate", "conflict"} and 0 < sum(late.values()) < len(rows)
    assert admission.once(df.limit(0)).collect() == [] and admission.late(df.limit(0), 0).collect() == []


def test_stream_equals_batch_under_shuffled_arrival(spark, rows, tmp_path):
    verdicts, late = plain(rows, 3 * DAY)
    batches = [rows[k : k + 60] for k in range(0, 240, 60)]
    for batch in batches:
        random.Random(1).shuffle(batch)  # within a micro-batch rows come in any order
    got = streamed(spark, tmp_path, batches, lambda r: admission.once_stream(r, 30 * DAY))
    assert {r["arrival"]: r["verdict"] for r in got} == verdicts and len(got) == len(rows)
    other = tmp_path / "late"
    other.mkdir()
    got = streamed(spark, other, batches, lambda r: admission.late_stream(r, 3 * DAY, 30 * DAY))
    assert {r["arrival"]: r["late"] for r in got} == late and len(got) == len(rows)


def test_a_key_is_forgotten_after_the_horizon(spark, tmp_path):
    batches = [[("a", "u", T0, "one", 0)], [("b", "u", T0 + 50 * DAY, "x", 1)], [("c", "u", T0 + 51 * DAY, "x", 2)], [("a", "u", T0 + 52 * DAY, "two", 3), ("b", "u", T0 + 50 * DAY, "x", 4)], [("d", "u", T0 + 1 * DAY, "x", 5)]]
    got = streamed(spark, tmp_path, batches, lambda r: admission.once_stream(r, 5 * DAY))
    # The first a is forgotten, b is not; d is older than the watermark and dropped.
    assert {r["arrival"]: r["verdict"] for r in got} == {0: "accepted", 1: "accepted", 2: "accepted", 3: "accepted", 4: "duplicate"}


def test_the_horizon_holds_the_lateness(spark):
    with pytest.raises(ValueError, match="horizon"):
        admission.late_stream(spark.createDataFrame([], admission.SCHEMA), 2, 1)


def test_records_of_one_arrival_are_not_before_each_other(spark):
    """Arrival repeats where numbers run out: the record of two days later makes none of its own arrival late."""
    rows = [(f"e{k}", user, at * DAY, "x", 7 if k < 40 else 8) for k, (user, at) in enumerate([("u", 9), ("u", 1), ("v", 1), ("v", 9)] * 10 + [("u", 1), ("v", 9)])]
    for order in (rows, rows[::-1]):
        got = {r["event_id"]: r["late"] for r in admission.late(spark.createDataFrame(order, admission.SCHEMA).repartition(3), 3 * DAY).collect()}
        assert {k for k, late in got.items() if late} == {"e40"} and len(got) == len(rows)
