"""Distributed fits against plain full-batch ones, and folding token by token."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewright.functions import scalars as S
from slatewright.operators import newton


def descend(loss_gradient, k, steps=60_000, rate=0.5):
    w = np.zeros(k)
    for _ in range(steps):
        g = loss_gradient(w)
        if np.abs(g).max() < 1e-10:
            break
        w = w - rate * g
    return w


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(600), rng.random((600, 3))])
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [-1, 2, -1, 0.5])))).astype(float)
    return x, y


def test_pointwise(spark, events):
    x, y = events
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "features array<double>, label double")
    penalty = np.array([0, 0.01, 0.01, 0.01])
    want = descend(lambda w: x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) + penalty * w, 4)
    model = newton.fit(df.repartition(5), "pointwise", l2=0.01)
    assert model.weights == pytest.approx(want, abs=1e-6) and model.examples == 600
    with pytest.raises(ValueError, match="positive and a negative"):
        newton.fit(df.where("label = 1"), "pointwise")
    with pytest.raises(ValueError):
        newton.fit(df.limit(0), "pointwise")


@pytest.mark.parametrize("kind", ["pairwise", "listwise"])
def test_slates(spark, events, kind):
    x, y = events
    rows = [(i // 6, f"d{i}", x[i].tolist(), int(y[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "impression_id int, id string, features array<double>, clicked int")
    slates = [(x[k : k + 6], y[k : k + 6]) for k in range(0, 600, 6) if 0 < y[k : k + 6].sum() < 6]
    if kind == "pairwise":
        d = np.concatenate([(a[b > 0][:, None] - a[b == 0]).reshape(-1, 4) for a, b in slates])
        want = descend(lambda w: -d.T @ (1 / (1 + np.exp(d @ w))) / len(d) + 0.01 * w, 4)
        n = len(d)
    else:
        def gradient(w):
            g = np.zeros(4)
            for a, b in slates:
                e = np.exp(a @ w)
                g += (e / e.sum() - b / b.sum()) @ a
            return g / len(slates) + 0.01 * w

        want, n = descend(gradient, 4, 4000), len(slates)
    model = newton.fit(df.repartition(3), kind, l2=0.01)
    assert model.weights == pytest.approx(want, abs=1e-5) and model.examples == n
    with pytest.raises(ValueError, match="both labels"):
        newton.fit(df.where("clicked = 1"), kind)


def test_folding_runs_equals_folding_texts(spark):
    """Whole texts folded by Python and cut, against runs cut and folded."""
    rng = random.Random(3)
    odd = [c for c in map(chr, range(0x110000)) if c.casefold() != c and not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(rng.choice([rng.choice(odd), rng.choice("aB9 _-ßẞ.́̌ͅ"), "Straße "]) for _ in range(60)) for _ in range(80)] + ["", "ͅ", "Α ͅΒ", "ǰaŉ ﬃ"]
    kinds = spark.createDataFrame([(chr(i),) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "c string").where(F.col("c").rlike(r"[\p{L}\p{N}]"))
    known = {r["c"] for r in kinds.collect()}
    cut = re.compile("[^ ]+")
    want = [cut.findall("".join(c if c in known else " " for c in t.casefold())) for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.tokens(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == want
