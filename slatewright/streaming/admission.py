"""Which arriving records are new, repeated, in conflict or late: as a batch plan, and in the
state of a stream.

Records are (event_id, user_id, occurred_us, content, arrival): arrival is their order in the
source, content a digest of all that a record says.  Of one event_id the first to arrive is
accepted; later ones are duplicates if they say the same and conflicts if not.  A record is late
if it occurred more than the allowed lateness before the latest one of its user that arrived
before it; records of one arrival (in a stream: of one micro-batch) are not before each other.

In a stream both are state by key, with an event-time timer that forgets a key when the
watermark has passed its last record by the declared horizon.  A micro-batch touches the keys
it has, however long the log is, and state is bounded by the horizon.  Records older than
the watermark, which trails the stream by the horizon, are dropped and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ranks
from ..tables import settle, split_join

COLUMNS = ("event_id", "user_id", "occurred_us", "content", "arrival")
SCHEMA = "event_id string, user_id string, occurred_us long, content string, arrival long"


def once(records: DataFrame) -> DataFrame:
    """records with ``verdict``: accepted, duplicate or conflict."""
    first = settle(records.groupBy("event_id").agg(F.min(F.struct("arrival", "content")).alias("first"), F.count("*").alias("copies")))
    both = split_join(records.select(*COLUMNS), first, ["event_id"], "copies")
    verdict = F.when(F.col("arrival") == F.col("first.arrival"), "accepted").when(F.col("content").eqNullSafe(F.col("first.content")), "duplicate").otherwise("conflict")
    return both.withColumn("verdict", verdict).select(*COLUMNS, "verdict")


def late(records: DataFrame, lateness_us: int) -> DataFrame:
    """records with ``late``.  Of those of one arrival none is before the other."""
    each = records.groupBy("user_id", "arrival").agg(F.max("occurred_us").alias("latest"))
    seen = ranks.running_max(each, ["user_id"], ["arrival"], "latest", "seen").select("user_id", "arrival", "seen")
    made = records.select(*COLUMNS).join(seen, (records["user_id"].eqNullSafe(seen["user_id"])) & (records["arrival"] == seen["arrival"])).drop(seen["user_id"]).drop(seen["arrival"])
    return made.select(*COLUMNS, F.coalesce(F.col("occurred_us") < F.col("seen") - lateness_us, F.lit(False)).alias("late"))


class _Keyed(StatefulProcessor):
    """State of a key that is forgotten when the horizon has passed."""

    schema = ""

    def __init__(self, horizon_us: int):
        self.horizon_us = horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def remember(self, value: tuple, was: int | None, latest_us: int) -> None:
        """State with a timer in milliseconds as its last field; a later record moves it."""
        due = -(-(latest_us + self.horizon_us) // 1000)
        if was is None or due > was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(due)
            was = due
        self.state.update((*value, was))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class _Once(_Keyed):
    schema = "content string, due long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("arrival")
        held = self.state.get() if self.state.exists() else None
        content, was = (held[0], held[1]) if held else (None, None)
        verdicts = []
        for k, said in enumerate(new["content"]):
            if held is None and k == 0:
                content = said
                verdicts.append("accepted")
            else:
                verdicts.append("duplicate" if said == content else "conflict")
        self.remember((content,), was, int(new["occurred_us"].max()))
        yield new[list(COLUMNS)].assign(verdict=verdicts)


class _Mark(_Keyed):
    schema = "seen long, due long"

    def __init__(self, horizon_us: int, lateness_us: int):
        super().__init__(horizon_us)
        self.lateness_us = lateness_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("arrival")
        held = self.state.get() if self.state.exists() else None
        seen, was = (held[0], held[1]) if held else (None, None)
        flags = []
        for _, same in new.groupby("arrival", sort=False)["occurred_us"]:  # sorted already
            flags += [seen is not None and at < seen - self.lateness_us for at in same.tolist()]
            seen = int(same.max()) if seen is None else max(seen, int(same.max()))
        self.remember((seen,), was, seen)
        yield new[list(COLUMNS)].assign(late=flags)


def _keyed(records: DataFrame, key: str, processor: StatefulProcessor, horizon_us: int, extra: str) -> DataFrame:
    timed = records.select(*COLUMNS, F.timestamp_micros("occurred_us").alias("at")).withWatermark("at", f"{-(-horizon_us // 1000)} milliseconds")
    return timed.groupBy(key).transformWithStateInPandas(processor, f"{SCHEMA}, {extra}", outputMode="Append", timeMode="EventTime")


def once_stream(records: DataFrame, horizon_us: int) -> DataFrame:
    """``once`` over a stream."""
    return _keyed(records, "event_id", _Once(horizon_us), horizon_us, "verdict string")


def late_stream(records: DataFrame, lateness_us: int, horizon_us: int) -> DataFrame:
    """``late`` over a stream; the lateness lies within the horizon."""
    if lateness_us > horizon_us:
        raise ValueError("the horizon must hold the allowed lateness")
    return _keyed(records, "user_id", _Mark(horizon_us, lateness_us), horizon_us, "late boolean")
