"""Commands end to end on small files."""

import json

import pytest

from slatewright.cli import main

AS_OF = "2024-03-01T00:00:00Z"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    topics = ["ai", "health", "energy"]
    articles = [{"id": f"a{i}", "title": f"Title {i}", "topics": [topics[i % 3]], "source": f"s{i % 4}", "published_at": f"2024-02-{i + 1:02d}T00:00:00Z", "quality": 0.5 + i / 40, "popularity": i / 20} for i in range(12)]
    kinds = ["click", "view", "like", "hide"]
    events = [{"user_id": f"u{i % 3}", "article_id": f"a{(5 * i) % 12}", "kind": kinds[i % 4], "occurred_at": f"2024-02-{15 + i // 2:02d}T{i:02d}:00:00Z", "propensity": 0.5} for i in range(20)]
    slates = [{"impression_id": f"i{k}", "user_id": f"u{k % 3}", "occurred_at": f"2024-02-{20 + k}T00:00:00Z", "candidates": [{"article_id": f"a{(k + j) % 12}", "clicked": j == k % 3} for j in range(3)]} for k in range(6)]
    scores = [{"impression_id": s["impression_id"], "article_id": c["article_id"], "score": 0.9 if c["clicked"] else 0.1} for s in slates for c in s["candidates"]]
    stream = [{"schema_version": 1, "event_id": f"e{i}", "user_id": e["user_id"], "item_id": e["article_id"], "timestamp": e["occurred_at"], "type": e["kind"], "weight": 1.0} for i, e in enumerate(events)]
    out = {}
    for name, value in {"articles": articles, "events": events, "impressions": slates, "scores": scores, "cohorts": {f"u{i}": f"c{i % 2}" for i in range(3)}, "config": {"size": 4}}.items():
        (d / f"{name}.json").write_text(json.dumps(value))
        out[name] = str(d / f"{name}.json")
    (d / "stream.jsonl").write_text("\n".join(map(json.dumps, stream)) + "\n")
    return out | {"stream": str(d / "stream.jsonl"), "dir": str(d)}


def run(spark, capsys, *argv):
    code = main([str(a) for a in argv], spark)
    text = capsys.readouterr()
    return code, json.loads(text.out) if text.out else text.err


def tables(f):
    return "--articles", f["articles"], "--events", f["events"]


def test_feeds(spark, capsys, files):
    assert run(spark, capsys, "validate", *tables(files))[1] == {"articles": 12, "events": 20, "users": 3}
    code, out = run(spark, capsys, "recommend", *tables(files), "--user", "u0", "--as-of", AS_OF, "--config", files["config"], "--html", f"{files['dir']}/feed.html")
    assert code == 0 and [r["rank"] for r in out["feed"]] == [1, 2, 3, 4] and "<table>" in open(f"{files['dir']}/feed.html").read()
    assert len(run(spark, capsys, "recommend", *tables(files), "--user", "nobody", "--as-of", AS_OF)[1]["feed"]) == 8
    assert run(spark, capsys, "evaluate", *tables(files), "--as-of", AS_OF)[1]["users"] == 3
    out = run(spark, capsys, "audit-cohorts", *tables(files), "--cohorts", files["cohorts"], "--as-of", AS_OF)[1]
    assert [c["cohort"] for c in out["cohorts"]] == ["c0", "c1"]


def test_errors_end_with_status_2(spark, capsys, files):
    code, text = run(spark, capsys, "recommend", *tables(files), "--user", "u0", "--as-of", "2024-03-01")
    assert code == 2 and "zone" in text
    assert run(spark, capsys, "validate", "--articles", files["events"], "--events", files["events"])[0] == 2


def test_models(spark, capsys, files):
    model = f"{files['dir']}/model.json"
    assert run(spark, capsys, "train-click-model", *tables(files), "--as-of", AS_OF, "--model", model)[1]["examples"] > 5
    out = run(spark, capsys, "rank-click-model", *tables(files), "--user", "u1", "--as-of", AS_OF, "--model", model, "--k", 3)[1]
    assert [r["rank"] for r in out["ranking"]] == [1, 2, 3] and out["ranking"][0]["probability"] >= out["ranking"][1]["probability"]
    for kind in ("pairwise", "listwise"):
        more = ("--articles", files["articles"], "--impressions", files["impressions"], "--model", f"{files['dir']}/{kind}.json")
        assert run(spark, capsys, f"train-{kind}-model", *more)[0] == 0
        assert len(run(spark, capsys, f"rank-{kind}-model", *more)[1]["scores"]) == 18
        assert run(spark, capsys, f"evaluate-{kind}-model", *more)[1]["impressions"] == 6
    assert run(spark, capsys, "evaluate-mind", "--impressions", files["impressions"], "--scores", files["scores"])[1]["auc"] == 1.0


def test_stream(spark, capsys, files):
    log = ("--log", f"{files['dir']}/log")
    assert run(spark, capsys, "stream-ingest", "--events", files["stream"], *log, "--articles", files["articles"], "--late", "accept-rebuild")[1]["accepted"] == 20
    assert run(spark, capsys, "stream-ingest", "--events", files["stream"], *log)[1]["duplicates"] == 20
    assert run(spark, capsys, "stream-checkpoint", *log, "--out", f"{files['dir']}/cp.json")[1]["events"] == 20
    assert run(spark, capsys, "stream-replay", *log, "--articles", files["articles"], "--as-of", AS_OF, "--checkpoint", f"{files['dir']}/cp.json")[1]["weights"]


def test_archives_and_deadlines(spark, capsys, files, tmp_path):
    from tests.test_archives import content, made

    path, out = made(tmp_path, "stored", content(20)), tmp_path / "out"
    code, said = run(spark, capsys, "--deadline", 600, "import-archive", "--archive", path, "--out", out, "--published-at", AS_OF)
    assert code == 0 and said["rows"] == {"train/articles": 20, "train/impressions": 40, "dev/articles": len(content(20)["dev/news.tsv"].splitlines()), "dev/impressions": 10}
    assert {m["member"]: m["ignored_history"] for m in said["members"]}["train/behaviors.tsv"] == sum(i % 5 for i in range(20))
    assert spark.read.parquet(str(out / "train/articles")).count() == 20
    code, said = run(spark, capsys, "import-archive", "--archive", path, "--out", tmp_path / "less", "--published-at", AS_OF, "--max-rows", 30)
    assert code == 2 and "over the limit of 30" in said and sorted(p.name for p in tmp_path.iterdir() if "less" in p.name) == []
    code, said = run(spark, capsys, "--deadline", 0.01, "validate", *tables(files))
    assert code == 2 and "validate was not done in 0.01 s" in said
