"""A session with the settings that the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "slatewright", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; anything else is the cluster's business."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, v in conf.items():
        b = b.config(k, v)
    return (b.master(master) if master else b).getOrCreate()
