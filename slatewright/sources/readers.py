"""Readers of the domain's files.  Spark's JSON reader keeps the last of two duplicate keys and drops
unknown ones, so records are checked by the strict parser, a line or a file at a time in
Arrow batches; the rows that come out have a fixed schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import behavior_timestamp, casefold, split_candidate, strip
from .strict_json import load

CATALOG = "id string, title string, summary string, topics array<string>, source string, published_us long, quality double, popularity double, title_missing boolean, category_missing boolean, subcategory_missing boolean, mind_category string, mind_subcategory string"
EVENTS = "user_id string, article_id string, kind string, occurred_us long, propensity double, weight double"
IMPRESSIONS = "impression_id string, user_id string, occurred_us long, pos int, article_id string, clicked int"
SCORES = "impression_id string, article_id string, score double"
KINDS = ("view", "click", "like", "hide")


def micros(text: object, name: str) -> int:
    """ISO-8601 with a zone -> microseconds."""
    if not isinstance(text, str) or not re.search(r"(Z|[+-]\d\d:\d\d)$", text):
        raise ValueError(f"{name} needs a zone")
    return (datetime.fromisoformat(text) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def identifier(value: object, name: str) -> str:
    if not isinstance(value, str) or not value or value.strip() != value:
        raise ValueError(f"{name} must be a trimmed, non-empty string")
    return value


def unit(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
        raise ValueError(f"{name} must lie in [0, 1]")
    return float(value)


def keys(value: object, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    if not isinstance(value, dict):
        raise ValueError("a record is a JSON object")
    missing, extra = set(needed) - set(value), set(value) - set(needed) - set(optional)
    if missing or extra:
        raise ValueError(f"missing keys {sorted(missing)}, unknown keys {sorted(extra)}")
    return value


def topics(values: object) -> list[str]:
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise ValueError("topics is a list of strings")
    out = list(dict.fromkeys(t for v in values if (t := v.strip().casefold())))
    if not out:
        raise ValueError("an article needs a topic")
    return out


def article(value: object) -> tuple:
    v = keys(value, ("id", "title", "topics", "source", "published_at"), ("summary", "quality", "popularity", "title_missing", "category_missing", "subcategory_missing", "mind_category", "mind_subcategory"))
    flags = [v.get(n, False) for n in ("title_missing", "category_missing", "subcategory_missing")]
    if not all(isinstance(f, bool) for f in flags):
        raise ValueError("missing flags are true or false")
    pair = v.get("mind_category"), v.get("mind_subcategory")
    if (pair[0] is None) != (pair[1] is None):
        raise ValueError("category and subcategory come together")
    return identifier(v["id"], "id"), identifier(v["title"], "title"), v.get("summary", ""), topics(v["topics"]), identifier(v["source"], "source"), micros(v["published_at"], "published_at"), unit(v.get("quality", 0.5), "quality"), unit(v.get("popularity", 0.0), "popularity"), *flags, *pair


def event(value: object) -> tuple:
    v = keys(value, ("user_id", "article_id", "kind", "occurred_at"), ("propensity", "weight"))
    if v["kind"] not in KINDS:
        raise ValueError(f"unknown kind: {v['kind']}")
    p, w = v.get("propensity"), v.get("weight", 1.0)
    if p is not None and not 0 < unit(p, "propensity"):
        raise ValueError("propensity must lie in (0, 1]")
    if isinstance(w, bool) or not isinstance(w, int | float) or not 0 < w < float("inf"):
        raise ValueError("weight must be positive")
    return identifier(v["user_id"], "user_id"), identifier(v["article_id"], "article_id"), v["kind"], micros(v["occurred_at"], "occurred_at"), None if p is None else float(p), float(w)


def impression(value: object) -> list[tuple]:
    v = keys(value, ("impression_id", "user_id", "occurred_at", "candidates"))
    if not isinstance(v["candidates"], list) or not v["candidates"]:
        raise ValueError("an impression needs candidates")
    out = []
    for i, c in enumerate(v["candidates"], 1):
        keys(c, ("article_id", "clicked"))
        if not isinstance(c["clicked"], bool):
            raise ValueError("clicked is true or false")
        out.append((identifier(v["impression_id"], "impression_id"), identifier(v["user_id"], "user_id"), micros(v["occurred_at"], "occurred_at"), i, identifier(c["article_id"], "article_id"), int(c["clicked"])))
    if len({r[4] for r in out}) < len(out):
        raise ValueError("a candidate occurs twice")
    return out


def score(value: object) -> tuple:
    v = keys(value, ("impression_id", "article_id", "score"))
    if isinstance(v["score"], bool) or not isinstance(v["score"], int | float):
        raise ValueError("score is a number")
    return identifier(v["impression_id"], "impression_id"), identifier(v["article_id"], "article_id"), float(v["score"]) + 0.0


def records(spark: SparkSession, path: str, one: Callable[[object], object], schema: str) -> DataFrame:
    """A ``.jsonl`` path has an object on each non-blank line; any other is an array."""
    lines = path.endswith(".jsonl")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for text in frame["value"]:
                if lines:
                    values = [load(text)] if text.strip() else []
                else:
                    values = load(text)
                    if not isinstance(values, list):
                        raise ValueError("the file is not a JSON array")
                for v in values:
                    made = one(v)
                    rows += made if isinstance(made, list) else [made]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.text(path, wholetext=not lines).mapInPandas(run, schema)


def unique(df: DataFrame, *by: str) -> DataFrame:
    """The frame, after a check that ``by`` is a key."""
    twice = df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").orderBy(*by).take(1)
    if twice:
        raise ValueError(f"duplicate {', '.join(by)}: {', '.join(str(twice[0][c]) for c in by)}")
    return df


def articles(spark: SparkSession, path: str) -> DataFrame:
    return unique(records(spark, path, article, CATALOG), "id")


def events(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, event, EVENTS)


def impressions(spark: SparkSession, path: str) -> DataFrame:
    return unique(records(spark, path, impression, IMPRESSIONS), "impression_id", "pos")


def scores(spark: SparkSession, path: str) -> DataFrame:
    return unique(records(spark, path, score, SCORES), "impression_id", "article_id")


def cohorts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of user to label."""
    text = spark.read.text(path, wholetext=True).first()[0]
    value = load(text)
    if not isinstance(value, dict) or not all(isinstance(v, str) and v.strip() == v and v for v in value.values()):
        raise ValueError("cohorts is an object of user to label")
    return spark.createDataFrame(sorted(value.items()), "user_id string, cohort string")


def news_tsv(spark: SparkSession, path: str | DataFrame, published_us: int) -> DataFrame:
    """Eight tab-separated columns without quoting, of a file or of lines (column value)."""
    names = ["id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities"]
    rows = _tsv(spark, path, names)
    topic = lambda c: casefold(strip(c))
    return unique(
        rows.select(
            "id", F.when(F.trim("title") == "", F.col("id")).otherwise(F.col("title")).alias("title"), F.col("abstract").alias("summary"),
            F.array_distinct(F.filter(F.array(topic(F.col("category")), topic(F.col("subcategory"))), lambda t: t != "")).alias("topics"),
            F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("unknown")).alias("source"), F.lit(published_us).cast("long").alias("published_us"), F.lit(0.5).alias("quality"), F.lit(0.0).alias("popularity"),
            (F.trim("title") == "").alias("title_missing"), (F.trim("category") == "").alias("category_missing"), (F.trim("subcategory") == "").alias("subcategory_missing"),
            F.col("category").alias("mind_category"), F.col("subcategory").alias("mind_subcategory"),
        ),
        "id",
    )


def behaviors_tsv(spark: SparkSession, path: str | DataFrame, offset: str = "+00:00") -> DataFrame:
    """Five columns -> a row for each candidate, with pos in source order."""
    rows = _tsv(spark, path, ["impression_id", "user_id", "time", "history", "impressions"])
    tokens = rows.select("impression_id", "user_id", F.unix_micros(behavior_timestamp(F.col("time"), offset)).alias("occurred_us"), F.posexplode(F.split(F.trim("impressions"), " +")).alias("pos", "token"))
    item, clicked = split_candidate(F.col("token"))
    checked = F.when(item == "", F.raise_error(F.concat(F.lit("bad candidate: "), F.col("token"))).cast("string")).otherwise(item)
    return tokens.select("impression_id", "user_id", "occurred_us", (F.col("pos") + 1).alias("pos"), checked.alias("article_id"), clicked.cast("int").alias("clicked"))


def _tsv(spark: SparkSession, path: str | DataFrame, names: list[str]) -> DataFrame:
    lines = (path if isinstance(path, DataFrame) else spark.read.text(path)).select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")
    cells = lines.select(F.split("value", "\t", -1).alias("c"))
    good = F.when(F.size("c") != len(names), F.raise_error(F.concat(F.lit(f"a line does not have {len(names)} columns: "), F.size("c").cast("string"))).cast("string"))
    return cells.select(*[F.coalesce(good, F.element_at("c", i + 1)).alias(n) for i, n in enumerate(names)])


def preflight(df: DataFrame, **limits: int) -> dict[str, int]:
    """Rows and longest text of each string column against ceilings, in one aggregate."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    row = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in text]).first().asDict()
    for name, most in limits.items():
        if row.get(name, 0) > most:
            raise ValueError(f"{name} is {row[name]}, over the limit of {most}")
    return row
