"""Resource ceilings that are checked in the pass that does the work.

Ceilings of a row stop the job at the first row over them.  Totals are metrics of the same
job (``observe``): the output is written beside its place and moved there only when every
total is within its bound, so what is refused leaves nothing, and nothing is counted twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class CeilingExceeded(ValueError):
    """A total over its bound: ``name``, ``value``, ``most``."""

    def __init__(self, name: str, value: int | float, most: int | float):
        super().__init__(f"{name} is {value}, over the limit of {most}")
        self.name, self.value, self.most = name, value, most


@dataclass(frozen=True)
class Ceilings:
    """``row``: what no row may pass; ``total``: what sums over the rows may not pass;
    ``rows``: how many rows there may be.  Nulls count as zero."""

    rows: int | None = None
    row: dict[str, tuple[Column, int | float]] = field(default_factory=dict)
    total: dict[str, tuple[Column, int | float]] = field(default_factory=dict)

    def __post_init__(self):
        if "rows" in self.total:
            raise ValueError("rows is a ceiling of its own")

    def guarded(self, df: DataFrame) -> DataFrame:
        """The rows; the job fails at a row over a ceiling."""
        bad = [F.when(value > most, F.concat(F.lit(f"{name} is "), value.cast("string"), F.lit(f", over the limit of {most}"))) for name, (value, most) in self.row.items()]
        return df.where(F.when(F.coalesce(*bad).isNull(), F.lit(True)).otherwise(F.raise_error(F.coalesce(*bad)).cast("boolean"))) if bad else df

    def metrics(self) -> list[Column]:
        return [F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, (value, _) in self.total.items()]]

    def check(self, found: dict) -> dict:
        bounds = {"rows": self.rows, **{name: most for name, (_, most) in self.total.items()}}
        for name, most in bounds.items():
            if most is not None and found[name] > most:
                raise CeilingExceeded(name, found[name], most)
        return found

    def write(self, df: DataFrame, path: str) -> dict:
        """Writes Parquet to a path that is not there yet, in one job, and returns the
        totals; raises and leaves nothing where a ceiling is passed."""
        seen = Observation()
        with published(df.sparkSession, path) as staged:
            self.guarded(df).observe(seen, *self.metrics()).write.parquet(staged)
            return self.check(dict(seen.get))

    def totals(self, df: DataFrame) -> DataFrame:
        """(name, value, most, ok) of the rows and each total, in one aggregation."""
        bounds = {"rows": self.rows, **{name: most for name, (_, most) in self.total.items()}}
        one = lambda name, most: F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("value"), F.lit(most).cast("double").alias("most"), F.coalesce(F.col(name) <= F.lit(most), F.lit(True)).alias("ok"))
        return df.agg(*self.metrics()).select(F.inline(F.array(*[one(name, most) for name, most in bounds.items()])))


@contextmanager
def published(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside a path that is not there yet, which becomes the path when the block
    ends well and goes when it does not."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    if files.exists(place):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    beside = jvm.org.apache.hadoop.fs.Path(staged)
    try:
        yield staged
        if not files.rename(beside, place):
            raise OSError(f"{path} could not be put in its place")
    finally:
        files.delete(beside, True)
