"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may meet; keys with more at most.
LEAST_HOT, MOST_HOT = 1000, 50_000


def settle(df: DataFrame) -> DataFrame:
    """The frame computed once and written by checkpoint() to spark.checkpoint.dir: lineage is
    cut and the rows survive a lost executor.  Where that is unset a temporary folder takes its
    place if executors are threads of this process; on a cluster it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder they share")
            found = tempfile.mkdtemp(prefix="slatewright-")
        sc.setCheckpointDir(found)
    return df.checkpoint()


def split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, a settled frame of one row a key whose ``weight`` is how
    many rows of ``left`` have it, so that no key's rows meet in one task.  Keys of much weight
    are broadcast: weights add up to the rows of ``left``, so at most MOST_HOT keys have more
    than a MOST_HOT-th of them.  The others are shuffled."""
    facts = right.agg(F.sum(weight), F.max(weight)).first()
    bound = max(LEAST_HOT, (facts[0] or 0) // MOST_HOT)
    if (facts[1] or 0) <= bound:
        return left.join(right.drop(weight), keys, how)
    hot = right.where(F.col(weight) > bound).drop(weight)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(right.where(F.col(weight) <= bound).drop(weight), keys, how))
