"""Full-batch fits of the click models as a plan, for any number of rows.

Each step reads the settled features once: a task adds up loss, gradient and Hessian of its
rows in Arrow batches and leaves one vector.  The driver adds these, one for each partition,
without rounding (so their order does not matter) and solves for a step of Newton's method,
halved while it does not lower the loss.  The objective is the mean loss plus half of l2 times
the squared weights: logistic over events (the bias is not penalised), logistic over pairs of a
clicked and an unclicked candidate, or softmax cross-entropy over the slate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle
from .rankers import Ranker

#: Units (events or slates) that a task works on at a time.
AT_ONCE = 4096


def _logistic(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def points(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Count, loss, gradient and Hessian of events."""
    z = x @ w
    p = _logistic(z)
    return len(y), float((_softplus(z) - y * z).sum()), x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def pairs(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Those of the pairs of one slate."""
    d = (x[y > 0][:, None] - x[y <= 0]).reshape(-1, x.shape[1])
    return points(w, d, np.ones(len(d)))


def lists(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Those of one slate against a uniform target over what was clicked."""
    target, z = (y > 0) / (y > 0).sum(), x @ w
    top = z.max()
    e = np.exp(z - top)
    p = e / e.sum()
    mean = p @ x
    return 1, float(top + math.log(e.sum()) - target @ z), mean - target @ x, (x * p[:, None]).T @ x - np.outer(mean, mean)


def _sums(rows: DataFrame, w: np.ndarray, kind: str) -> tuple[float, float, np.ndarray, np.ndarray]:
    k = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + k + k * k)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                if kind == "pointwise":
                    x = batch.column(0).flatten().to_numpy().reshape(-1, k)
                    parts = [points(w, x, batch.column(1).to_numpy())]
                else:
                    of = pairs if kind == "pairwise" else lists
                    parts = [of(w, np.array(f, float), np.array(c, float)) for f, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                for n, loss, g, h in parts:
                    total += np.concatenate([[n, loss], g, h.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = [r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()]  # one for each partition
    n, loss, *rest = [math.fsum(c) for c in zip(*found, strict=True)]
    return n, loss, np.array(rest[:k]), np.array(rest[k:]).reshape(k, k)


def fit(featured: DataFrame, kind: str, *, l2: float = 0.001, steps: int = 50, tolerance: float = 1e-9) -> Ranker:
    """A ranker from point_features() rows (pointwise) or slate_features() rows (the others;
    impressions with one label only say nothing).  A slate's candidates are one unit."""
    model = Ranker(kind, epochs=steps, l2=l2)
    if kind == "pointwise":
        rows = featured.select("features", F.col("label").cast("double").alias("y"))
        facts = rows.agg(F.min("y"), F.max("y")).first()
        if facts[0] is None or facts[0] == facts[1]:
            raise ValueError("training needs a positive and a negative event")
    else:
        item = F.sort_array(F.collect_list(F.struct("id", "features", F.col("clicked").cast("double").alias("y"))))
        slates = featured.groupBy("impression_id").agg(item.alias("s"), F.max("clicked").alias("most"), F.min("clicked").alias("least")).where("most > least")
        rows = slates.select(F.transform("s", lambda s: s["features"]).alias("x"), F.transform("s", lambda s: s["y"]).alias("y"))
    rows = settle(rows)
    one = rows.first()
    if one is None:
        raise ValueError("training needs an impression with both labels")
    w = np.zeros(len(one[0] if kind == "pointwise" else one[0][0]))
    penalty = np.full(len(w), l2)
    if kind == "pointwise":
        penalty[0] = 0
    held = None
    for _ in range(steps):
        n, loss, g, h = _sums(rows, w, kind)
        value = loss / n + (penalty * w * w).sum() / 2
        if held is not None and value > held[0] + 1e-12 * abs(held[0]):
            w = (w + held[1]) / 2
            continue
        g, h = g / n + penalty * w, h / n + np.diag(penalty)
        if np.abs(g).max() < tolerance:
            break
        held = (value, w)
        w = w - np.linalg.lstsq(h, g, rcond=1e-12)[0]
        if not np.isfinite(w).all():
            raise ValueError("training diverged")
    model.weights, model.examples = w.tolist(), int(n)
    return model
