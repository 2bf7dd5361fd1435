"""Experiments on a small split: selection, ties, the news workflow from an archive."""

import zipfile

import pytest

from slatewright.config import FeedConfig
from slatewright.operators import experiments, neural
from slatewright.sources import readers

T0 = 1_700_000_000_000_000
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def split(spark):
    catalog = spark.createDataFrame([(f"a{i}", f"title {'red' if i % 2 else 'blue'} {i}", ["x" if i % 2 else "y"], "s", T0 - DAY, 0.5, i / 10) for i in range(8)], "id string, title string, topics array<string>, source string, published_us long, quality double, popularity double")
    slate = lambda name, t: [(name, f"u{t % 3}", T0 + t * DAY, p, f"a{(t + p) % 8}", int((t + p) % 2)) for p in range(1, 5)]
    train = spark.createDataFrame([r for t in range(8) for r in slate(f"t{t}", t)], readers.IMPRESSIONS)
    held = spark.createDataFrame([r for t in range(9, 13) for r in slate(f"v{t}", t)], readers.IMPRESSIONS)
    return catalog, train, held


def test_training(spark, split):
    catalog, train, held = split
    plan = experiments.Plan.from_mapping({"metric": "auc", "candidates": [{"name": "p", "kind": "pairwise", "epochs": 3}, {"name": "l", "kind": "listwise", "epochs": 3}]})
    out = experiments.training(spark, plan, catalog, train, held, FeedConfig())
    assert set(out["candidates"]) == {"p", "l"} and out["selected"] in ("p", "l") and out["candidates"]["p"]["auc"] > 0.5
    with pytest.raises(ValueError):
        experiments.training(spark, plan, catalog, train, train, FeedConfig())
    with pytest.raises(ValueError):
        experiments.Plan.from_mapping({"metric": "auc", "candidates": [{"name": "p", "kind": "pairwise", "rate": 1}]})


def test_encoder_selection(spark, split):
    catalog, train, held = split
    variants = {"base": neural.NeuralConfig(dimension=2, epochs=1), "same": neural.NeuralConfig(dimension=2, epochs=1)}
    out = experiments.encoder_selection(spark, variants, "same", catalog, train, held, draws=20)
    assert out["selected"] == "same" and out["gains"]["base"] == {"mean": 0.0, "interval": (0.0, 0.0)}


def test_news_workflow(spark, tmp_path):
    news = "".join(f"n{i}\tsports\t{'a' if i % 2 else 'b'}\tTitle {i}\tabs\tu\t[]\t[]\n" for i in range(6))
    rows = lambda s: "".join(f"{k}\tu{k % 2}\t11/{10 + s + k}/2019 8:00:00 AM\tn1\tn{k % 6}-1 n{(k + 1) % 6}-0\n" for k in range(4))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, text in (("train/news.tsv", news), ("dev/news.tsv", news), ("train/behaviors.tsv", rows(0)), ("dev/behaviors.tsv", rows(8))):
            z.writestr(name, text)
    files = experiments.archive(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    out = experiments.news_workflow(spark, files, T0 - 2000 * DAY, 3, 2, FeedConfig(), epochs=2)
    assert out["pairs"] == 3 and out["validation"]["impressions"] == 2
    with pytest.raises(ValueError):
        experiments.archive(str(tmp_path / "z.zip"), str(tmp_path / "out"), digest="0" * 64)
