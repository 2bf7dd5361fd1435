"""An append-only interaction log with idempotent ingestion and lateness per user.

The log is a table in batches; ingest() validates a whole batch (duplicates, conflicts, unknown
items, lateness in arrival order) before anything is written, so a bad batch leaves no
trace.  The same checks run in ``foreachBatch`` of a stream.  Profiles at any time are a
batch query over the log, or state kept incrementally by live_profiles().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import FeedConfig
from ..operators import profiles
from . import records


class StreamError(ValueError):
    """A batch that was refused whole."""


def parsed(lines: DataFrame) -> DataFrame:
    """lines(value) -> records; a line that is not canonical-parsable is an error.  Blank lines are
    skipped.  Strictness needs the Python parser, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in records.SCHEMA.split(", ")]
        for frame in frames:
            yield pd.DataFrame([records.parse(v).row() for v in frame["value"] if v.strip()], columns=names)

    return lines.select("value").mapInPandas(run, records.SCHEMA)


#: Names of a batch that are sent to every task; more are shuffled.
FEW = 1_000_000


def _named(known: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The part of the log whose key occurs in a batch."""
    names = rows.select(key).distinct()
    return known.join(F.broadcast(names) if rows.count() <= FEW else names, key, "left_semi")


class EventLog:
    """batches under ``path``: log/batch=N/*.parquet and manifest/N.json."""

    def __init__(self, spark: SparkSession, path: str, *, lateness_us: int = 0, late: str = "reject"):
        if late not in ("reject", "accept-rebuild"):
            raise ValueError("late is reject or accept-rebuild")
        self.spark, self.path, self.lateness_us, self.late = spark, path.rstrip("/"), lateness_us, late

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def committed(self) -> list[dict]:
        """Manifests in order; what a batch wrote counts once its manifest is there."""
        fs, path = self._fs()
        folder = path(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(self.spark.read.text(f"{self.path}/manifest/{n}", wholetext=True).first()[0]) for n in names]

    def log(self) -> DataFrame:
        found = self.committed()
        empty = self.spark.createDataFrame([], records.SCHEMA + ", arrival long, batch long")
        files = [m["folder"] for m in found if m["accepted"]]
        if not files:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/log/{f}" for f in files])

    def ingest(self, batch: DataFrame, catalog: DataFrame | None = None, batch_id: int | None = None) -> dict[str, int]:
        """Validate, append, then commit by a manifest; the report.  A batch_id that was committed
        before is skipped, so a replayed micro-batch changes nothing."""
        done = self.committed()
        number = len(done) if batch_id is None else batch_id
        if batch_id is not None and any(m["batch"] == batch_id for m in done):
            return next(m for m in done if m["batch"] == batch_id)["report"]
        known = self.log()
        rows = batch.withColumn("arrival", F.monotonically_increasing_id()).persist()
        try:
            report, fresh = self._plan(rows, known, catalog)
            folder = f"batch-{number:012d}-{uuid.uuid4().hex}"
            if report["accepted"]:
                fresh.withColumn("batch", F.lit(number).cast("long")).write.parquet(f"{self.path}/log/{folder}")
            self._commit({"batch": number, "folder": folder, "accepted": report["accepted"], "report": report})
            return report
        finally:
            rows.unpersist()

    def _commit(self, manifest: dict) -> None:
        """Written aside and renamed: it is there whole or not at all."""
        fs, path = self._fs()
        aside, final = path(f"{self.path}/manifest/.{uuid.uuid4().hex}"), path(f"{self.path}/manifest/{manifest['batch']:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not fs.rename(aside, final):
            raise StreamError("another writer committed this batch")

    def _plan(self, rows: DataFrame, known: DataFrame, catalog: DataFrame | None) -> tuple[dict[str, int], DataFrame]:
        # Of the log only what the batch names is looked at: it is read, not shuffled.
        twins = _named(known.select("event_id", "sha256"), rows, "event_id")
        clash = rows.select("event_id", "sha256").union(twins).groupBy("event_id").agg(F.count_distinct("sha256").alias("n")).where("n > 1").orderBy("event_id").take(1)
        if clash:
            raise StreamError(f"event {clash[0]['event_id']} is there with other content")
        first = Window.partitionBy("event_id").orderBy("arrival")
        fresh = rows.join(twins.select("event_id"), "event_id", "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        if catalog is not None:
            lost = fresh.join(catalog.select(F.col("id").alias("item_id")), "item_id", "left_anti").orderBy("item_id").take(1)
            if lost:
                raise StreamError(f"unknown item {lost[0]['item_id']}")
        before = _named(known.select("user_id", "occurred_us"), rows, "user_id").groupBy("user_id").agg(F.max("occurred_us").alias("seen"))
        upto = Window.partitionBy("user_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
        marked = fresh.join(before, "user_id", "left").withColumn("mark", F.greatest("seen", F.max("occurred_us").over(upto)) - self.lateness_us)
        late = marked.where("occurred_us < mark")
        if self.late == "reject" and (one := late.orderBy("arrival").take(1)):
            raise StreamError(f"event {one[0]['event_id']} is late")
        counts = marked.agg(F.count("*").alias("accepted"), F.count_if(F.col("occurred_us") < F.col("mark")).alias("late"), F.count_distinct("user_id").alias("users")).first()
        report = {"received": rows.count(), "accepted": counts["accepted"], "late": counts["late"], "users": counts["users"]}
        report["duplicates"] = report["received"] - report["accepted"]
        return report, fresh.select(*[f.split()[0] for f in records.SCHEMA.split(", ")], "arrival")

    def events(self) -> DataFrame:
        return self.log().select("event_id", "user_id", F.col("item_id").alias("article_id"), F.col("type").alias("kind"), "occurred_us", F.lit(None).cast("double").alias("propensity"), "weight")

    def weights_at(self, catalog: DataFrame, config: FeedConfig, as_of: int) -> DataFrame:
        """Profiles at any time, also before the latest event."""
        return profiles.weights(profiles.visible(self.events(), catalog, as_of), config, as_of)

    def checkpoint(self) -> dict[str, object]:
        """Digest of the log in order: rows hash one by one, sums are order-free."""
        log = self.log()
        row = log.agg(F.count("*").alias("events"), F.coalesce(F.sum(F.xxhash64("sha256").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.max("occurred_us").alias("through")).first()
        return {"batches": len(self.committed()), **row.asDict()}

    def restore(self, saved: dict[str, object]) -> None:
        """Compare with a saved checkpoint by computing it again."""
        if self.checkpoint() != saved:
            raise StreamError("the log differs from its checkpoint")


def start(lines: DataFrame, log: EventLog, checkpoint: str, catalog: DataFrame | None = None):
    """A streaming query that ingests each micro-batch under its id."""
    return lines.writeStream.foreachBatch(lambda df, n: log.ingest(parsed(df), catalog, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Live(StatefulProcessor):
    """Per user: decayed totals by topic, the time they stand at, and the event count."""

    def __init__(self, half_life_days: float, signals: dict[str, float]):
        self.half_life_us, self.signals = half_life_days * 86_400_000_000.0, signals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "topic string", "total double")
        self.facts = handle.getValueState("facts", "through long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["occurred_us", "event_id"])
        facts = self.facts.get() if self.facts.exists() else None
        through, n = (facts[0], facts[1]) if facts else (int(new["occurred_us"].iat[0]), 0)
        totals = {k[0]: v[0] for k, v in self.totals.iterator()}
        for e in new.itertuples():
            shift = max(0, e.occurred_us - through)
            decay = 0.5 ** (shift / self.half_life_us)
            totals = {k: v * decay for k, v in totals.items()}
            through = max(through, e.occurred_us)
            age = 0.5 ** ((through - e.occurred_us) / self.half_life_us)  # late events count as of their own time
            for t in e.topics:
                totals[t] = totals.get(t, 0.0) + self.signals[e.kind] * e.weight * age / len(e.topics)
            n += 1
        for k, v in totals.items():
            self.totals.updateValue((k,), (v,))
        self.facts.update((through, n))
        top = max((abs(v) for v in totals.values()), default=1.0) or 1.0
        good = {k: v / top for k, v in totals.items() if v}
        yield pd.DataFrame({"user_id": [key[0]] * len(good), "topic": list(good), "weight": list(good.values()), "event_count": n})

    def close(self) -> None:
        pass


def live_profiles(events: DataFrame, config: FeedConfig) -> DataFrame:
    """events(user_id, event_id, occurred_us, kind, weight, topics), a stream, -> updated
    profiles of the users of each micro-batch.  Needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(_Live(config.profile_half_life_days, config.signals()), "user_id string, topic string, weight double, event_count long", outputMode="Update", timeMode="None")
