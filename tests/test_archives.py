"""Archives, ceilings and deadlines."""

import hashlib
import os
import time
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slatewright.deadlines import DeadlineExceeded, deadline
from slatewright.sources import archives
from slatewright.sources.ceilings import CeilingExceeded, Ceilings
from slatewright.sources.readers import behaviors_tsv, news_tsv

T0 = 1_700_000_000_000_000


def content(n=300):
    news = "".join(f"N{i}\tSports{i % 3}\tGolf\tTitle é {i}\tText {i}\tu\t[]\t[]\n" for i in range(n))
    shown = lambda k: "".join(f"{i}\tU{i % 7}\t11/13/2019 8:{i % 60:02d}:00 AM\t{' '.join(f'N{j}' for j in range(i % 5))}\tN{i}-1 N{(i + 1) % n}-0\r\n" + "\n" * (i % 4 == 0) for i in range(k))
    return {"train/news.tsv": news, "train/behaviors.tsv": shown(n), "dev/news.tsv": news[: len(news) // 2].rsplit("\n", 1)[0], "dev/behaviors.tsv": shown(5).rstrip("\n")}


@pytest.fixture(params=["folder", "stored", "deflated"])
def place(request, tmp_path):
    return request.param, lambda files: made(tmp_path, request.param, files)


def made(tmp_path, form, files):
    path = tmp_path / f"{form}-{len(os.listdir(tmp_path))}"
    if form == "folder":
        for name, text in files.items():
            (path / name).parent.mkdir(parents=True, exist_ok=True)
            (path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    else:
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if form == "stored" else zipfile.ZIP_DEFLATED) as z:
            for name, text in files.items():
                z.writestr(name, text)
    return str(path)


def brute(files):
    out = []
    for name, text in files.items():
        at = 0
        for line in text.encode().splitlines(keepends=True):
            body = line.decode().rstrip("\r\n")
            if body.strip():
                c = body.split("\t")
                out.append((name, at, body, *((len(c[3].split()), len(c[4].split())) if name.endswith("behaviors.tsv") else (None, None))))
            at += len(line)
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_lines(spark, place, split):
    form, put = place
    files = content(60)
    got = archives.archive(spark, put(files), split_bytes=split)
    assert sorted(map(tuple, got.collect()), key=str) == brute(files)
    n = got.select(F.spark_partition_id()).rdd.getNumPartitions()
    assert n == (4 if form == "deflated" or split > 97 else sum(-(-len(t.encode()) // 97) for t in files.values()))


def test_splits_at_every_byte(tmp_path):
    """No line is lost or read twice, wherever a range begins."""
    text = "a\n\nbcd\r\nlonger line\né\nlast"
    files = {"m": text}
    want = brute(files)
    for form in ("folder", "stored"):
        path = made(tmp_path, form, files)
        for size in range(1, len(text) + 3):
            got = [(at, line.rstrip(b"\r\n").decode()) for s in archives.plan(path, ("m",), size, 1000) for at, line in archives.lines(path, s, 100)]
            assert [g for g in sorted(got) if g[1].strip()] == sorted((r[1], r[2]) for r in want)


def test_summary_and_parsers(spark, place, tmp_path):
    _, put = place
    files = content()
    path = put(files)
    rows = {r["member"]: r for r in archives.summary(spark, path, split_bytes=1000).collect()}
    for name, text in files.items():
        mine = [r for r in brute(files) if r[0] == name]
        assert rows[name]["sha256"] == hashlib.sha256(text.encode()).hexdigest() and rows[name]["bytes"] == len(text.encode())
        assert (rows[name]["lines"], rows[name]["ignored_history"], rows[name]["candidates"]) == (len(mine), sum(r[3] or 0 for r in mine), sum(r[4] or 0 for r in mine))
    lines = archives.archive(spark, path, split_bytes=1000)
    for member, parse, read in (("train/news.tsv", archives.articles, lambda p: news_tsv(spark, p, T0)), ("train/behaviors.tsv", archives.impressions, lambda p: behaviors_tsv(spark, p, "-08:00"))):
        (tmp_path / "one.tsv").write_bytes(files[member].encode())
        got = parse(spark, lines, member, T0 if "news" in member else "-08:00")
        assert sorted(map(str, got.collect())) == sorted(map(str, read(str(tmp_path / "one.tsv")).collect()))


def test_refused(spark, place):
    form, put = place
    good = content(4)
    at = len("1\tU\t11/13/2019 8:00:00 AM\t\tN1-1\n")
    bad = {
        "over the limit of 2": good | {"train/behaviors.tsv": "1\tU\t11/13/2019 8:00:00 AM\t\tN1-1\n2\tU\t11/13/2019 8:00:00 AM\t\tN1-1 N2-0 N3-0\n"},
        "carriage return": good | {"dev/news.tsv": "a\rb\n"},
        "not UTF-8": good | {"dev/news.tsv": b"ab\xff\n"},
        "a line of over 400": good | {"dev/news.tsv": "x" * 401 + "\n"},
        "missing: dev/news.tsv": {k: v for k, v in good.items() if k != "dev/news.tsv"},
        "not of the archive: more": good | {"more": "x"},
        "over the limit of 5000": good | {"dev/news.tsv": ("x" * 300 + "\n") * 20},
    }
    for said, files in bad.items():
        with pytest.raises(PySparkException, match=said) as error:
            archives.archive(spark, put(files), max_candidates=2, max_line_bytes=400, max_bytes=5000).collect()
        if "limit of 2" in said:
            assert f"train/behaviors.tsv, byte {at}: 3 candidates" in str(error.value)
    assert archives.archive(spark, put(good | {"dev/news.tsv": "x" * 400})).where("member = 'dev/news.tsv'").count() == 1
    assert archives.archive(spark, put(dict.fromkeys(archives.MEMBERS, ""))).count() == 0
    if form != "folder":
        with pytest.raises(PySparkException, match="occur twice"), pytest.warns(UserWarning):
            archives.archive(spark, twice(put(good))).collect()


def twice(path):
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("dev/news.tsv", "x")
    return path


def test_ceilings(spark, tmp_path):
    df = spark.range(1000, numPartitions=7).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("ceilings"))
    spark.sparkContext.setJobGroup("ceilings", "")
    total = sum(range(0, 1000, 2))
    good = Ceilings(rows=1000, row={"id": (F.col("id"), 999)}, total={"v": (F.col("v"), total)})
    assert good.write(df, str(tmp_path / "a")) == {"rows": 1000, "v": total} and jobs() == 1
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1000
    before = set(os.listdir(tmp_path))
    for bad, name in ((Ceilings(rows=999), "rows"), (Ceilings(total={"v": (F.col("v"), total - 1)}), "v")):
        with pytest.raises(CeilingExceeded) as error:
            bad.write(df, str(tmp_path / "b"))
        assert error.value.name == name
    with pytest.raises(PySparkException, match="id is 999, over the limit of 998"):
        Ceilings(row={"id": (F.col("id"), 998)}).write(df, str(tmp_path / "b"))
    with pytest.raises(FileExistsError):
        good.write(df, str(tmp_path / "a"))
    assert set(os.listdir(tmp_path)) == before
    assert good.write(df.where("id < 0"), str(tmp_path / "c")) == {"rows": 0, "v": 0}
    assert good.write(spark.createDataFrame([], df.schema), str(tmp_path / "d")) == {"rows": 0, "v": 0}


def slow(spark, seconds):
    def wait(frames):
        for f in frames:
            time.sleep(seconds)
            yield f

    return spark.range(4, numPartitions=2).mapInPandas(wait, "id long")


def test_deadlines(spark):
    gone, began = [], time.monotonic()
    with pytest.raises(DeadlineExceeded, match="feeds was not done in 1 s"), deadline(spark, 1, "feeds", release=lambda: gone.append(1)):
        slow(spark, 30).collect()
    assert gone == [1] and time.monotonic() - began < 20
    with deadline(spark, 60) as left:
        assert spark.range(5).count() == 5 and 0 < left() <= 60
    # Jobs that start late end too, and driver code can ask.
    with pytest.raises(DeadlineExceeded), deadline(spark, 0.2):
        time.sleep(0.6)
        slow(spark, 30).collect()
    with pytest.raises(DeadlineExceeded), deadline(spark, 0.1) as left:
        time.sleep(0.2)
        left()
    # Errors of its own stay; what comes after is not cancelled.
    with pytest.raises(ZeroDivisionError), deadline(spark, 60, release=lambda: gone.append(2)):
        1 / 0  # noqa: B018
    with pytest.raises(DeadlineExceeded, match="inner"), deadline(spark, 60, "outer"), deadline(spark, 0.5, "inner"):
        slow(spark, 30).collect()
    with pytest.raises(DeadlineExceeded, match="outer"), deadline(spark, 0.5, "outer"), deadline(spark, 60, "inner"):
        slow(spark, 30).collect()
    assert gone == [1] and spark.range(7).count() == 7
    for wrong in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError), deadline(spark, wrong):
            pass
