"""The pipeline, stage by stage, on a small corpus with planted cases."""

import os
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from slatewright.llm import common, packing, queries, tokens
from slatewright.llm.common import arrow_map, components, need, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    parts = {"en": ["tion", "the", "ing", "wh", "er"], "de": ["sch", "ung", "ein", "ge", "ö"]}
    words = lambda lang, n: ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    rows = [(i, " ".join(words("de" if i % 3 == 0 else "en", 120)), "de" if i % 3 == 0 else "en", "s") for i in range(80)]
    shared = words("en", 60)
    rows += [(100, rows[4][1], "en", "s"), (101, rows[5][1].replace(" ", "  ", 1), "en", "s"), (102, None, "en", "s"), (103, "12 34 !!", None, "s")]
    rows += [(104 + i, " ".join(words("en", 40) + shared + words("en", 40)), None, "s") for i in range(2)]
    rows += [(110, " ".join([*words("en", 50), "token = 'abcdef0123456789abcdef0123456789'", *words("en", 50)]), "en", "s")]
    return [(*r, len(r[1] or "")) for r in rows], " ".join(shared)


def test_stages(spark, corpus, tmp_path):
    rows, shared = corpus
    docs, seen = spark.createDataFrame(rows, SCHEMA), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            seen.append({r["doc_id"]: r for r in docs.collect()})
    all_ids = {r[0] for r in rows}
    assert set(seen[0]) == all_ids - {102, 103} and seen[0][104]["lang"] == "en"
    assert set(seen[1]) == all_ids - {100, 101, 102, 103}
    assert set(seen[2]) == set(seen[1]) and all(shared not in seen[2][i]["text"] and len(seen[2][i]["text"].split()) == 80 for i in (104, 105))
    clean = [i for i in seen[2] if i < 80]
    assert all(seen[2][i]["text"] == seen[0][i]["text"] == seen[3][i]["text"] for i in clean)
    assert "abcdef0123456789" not in seen[3][110]["text"] and "[assign]" in seen[3][110]["text"]
    assert {r["doc_id"] for r in docs.collect()} == set(seen[3])
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3].values())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_language_without_labels(spark, corpus):
    """Nothing to learn from: texts with a letter stay, their lang null."""
    docs = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in corpus[0]], SCHEMA)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {r[0]: None for r in corpus[0] if r[0] not in (102, 103)}


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="text"):
        need(spark.range(1), "id", "text")


def test_workers_keep_nothing_of_other_stages(spark, corpus):
    """Spark gives a Python worker tasks of all stages: words and vocabularies that packing
    keeps there are gone in a task of another module, and so is unused memory of Arrow."""
    docs = spark.createDataFrame(corpus[0], SCHEMA).repartition(8)

    def at_packing(batch):
        packing.encode_texts(batch.column(1))
        return pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(packing._caches) + tokens.from_json.cache_info().currsize])], names=["pid", "kept"])

    def later(batch):
        return pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(packing._caches) + tokens.from_json.cache_info().currsize])], names=["pid", "kept"])

    at_packing.__module__, later.__module__ = packing.__name__, "slatewright.llm.language"
    source = need(docs, "doc_id", "text")
    seen = {r["pid"]: r["kept"] for r in arrow_map(source, at_packing, "pid long, kept long").collect()}
    after = {r["pid"]: r["kept"] for r in arrow_map(source, later, "pid long, kept long").collect()}
    assert set(seen.values()) == {2} and set(seen) & set(after)
    assert set(after.values()) == {0}


def test_grown_heap_is_collected(spark, monkeypatch):
    """The driver's heap, where it has grown, is collected in full when a table is written."""
    monkeypatch.setattr(common, "_left", [0], raising=False)
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    held = [jvm.java.util.ArrayList() for _ in range(20)]
    try:
        for x in held:
            x.ensureCapacity(int(0.03 * heap.maxMemory() / 4))
        assert heap.totalMemory() > 0.5 * heap.maxMemory()
        before = full()
        assert table(spark, spark.range(10), "small").count() == 10
        assert full() > before
    finally:
        for x in held:
            x.trimToSize()


def test_stars_settle_in_one_round(spark, monkeypatch):
    """What is connected already costs the driver the queries of one round."""
    written, write = [], common.table
    monkeypatch.setattr(common, "table", lambda spark, df, name: written.append(name) or write(spark, df, name))
    edges = [(i, i % 7) for i in range(7, 200)]
    got = {r["node"]: r["root"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i % 7 for i in range(200)} and written.count("stars") == 1
