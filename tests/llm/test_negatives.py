"""Hard negatives against brute force over Python integers."""

import math
import random

import pytest

from slatewright.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives_=10):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, v, label) in enumerate(good):
        if i % every:
            continue
        scored = [(dot(v, w), j, other) for n, (j, w, other) in enumerate(good) if n != k]
        same = sorted((-s, j) for s, j, other in scored if other == label)[:positives]
        for ps, p in same:
            ps = -ps
            far = sorted((-s, j) for s, j, other in scored if other != label and 30 * ps <= 100 * s <= 90 * ps)[:negatives_]
            out += [(i, p, r + 1, j, ps, -s) for r, (s, j) in enumerate(far)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    found = negatives.report(spark, spark.createDataFrame(rows, schema))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def sample(n, dims, labels, seed, hot=0.0, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid)) if grid else (lambda: rng.uniform(-0.3, 0.6))
    return [(i * 10, [value() for _ in range(dims)], 3 if rng.random() < hot else rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_equal_to_brute_force_over_many_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "PANEL", 2)
    rows = sample(180, 70, 10, 1, hot)
    found = mined(spark, rows)
    assert found == brute(rows) and found


def test_ties_go_to_the_smaller_id(spark):
    rows = sample(120, 3, 4, 2, grid=[0.0, 0.25, 0.5])
    random.Random(1).shuffle(rows)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows_and_repeated_ids(spark):
    rows = sample(60, 5, 3, 3)
    rows += [(None, [0.5] * 5, 1), (100, None, 1), (200, [0.5, None, 0.5], 1), (300, [0.5, float("nan")], 1), (400, [float("inf")] * 5, 2), (500, [0.5] * 5, None)]
    rows += [(600, [], 1), (700, [0.5, 0.5], 1), (900, [0.4] * 200, 2), (0, [0.3] * 5, 0), (0, [0.3] * 5, 0), rows[5], rows[10], rows[10]]
    assert mined(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", row string, windows long")
    assert sorted(tuple(r) for r in negatives.report(spark, wide).collect()) == brute(rows)


def test_a_very_long_vector(spark):
    rng = random.Random(5)
    rows = [(i * 50, [rng.uniform(-0.2, 0.5) for _ in range(20_000 if i == 4 else 8)], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(100, [0.5], 1)], [(100, [0.5], 1), (200, [0.4], 1)], [(1, [0.5], 1), (2, [0.4], 2)]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows) == []


def test_products_beyond_doubles_are_exact():
    import numpy as np

    a = np.full((1, 64), (1 << 24) - 1, np.int32)
    b = np.arange(64, dtype=np.int32)[None] + (1 << 24) - 64
    assert negatives.product(a, b)[0, 0] == sum(((1 << 24) - 1) * int(x) for x in b[0])


def test_bounds_are_those_of_the_inequalities():
    for p in range(-50, 400):
        low, high = negatives.bounds(p)
        assert [s for s in range(-60, 400) if 30 * p <= 100 * s <= 90 * p] == list(range(max(low, -60), high + 1))
