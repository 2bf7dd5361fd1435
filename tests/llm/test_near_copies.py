"""Near copies that fingerprints of repeats, or the size of a bucket, would hide."""

import random

import numpy as np
import pytest

from slatewright.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, texts, **options):
    return {r["doc_id"] for r in simhash.kept(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), **options).collect()}


def words(rng, n, name="w"):
    return [f"{name}{rng.randint(0, 10**6)}" for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_repeated_lines_do_not_hide_copies(spark):
    """Equal sets of shingles, whatever their counts: similarity 1.0."""
    rng, texts = random.Random(1), []
    for times in (20, 100, 1000):
        for _ in range(15):
            body, line = words(rng, 400), words(rng, 7, "line")
            texts += [" ".join([*body, *line * 2]), " ".join([*body, *line * times])]
    assert kept(spark, texts) == {i for i in range(0, 90, 2)}


def test_repeats_and_changes_together(spark):
    rng, texts = random.Random(2), []
    for times in (1, 30, 300):
        for _ in range(10):
            body, line = words(rng, 400), words(rng, 7, "line")
            changed = [*body[:380], *words(rng, 20)]
            texts += [" ".join([*body, *line * 2]), " ".join([*changed, *line * (times + 1)])]
    assert all(len(shingles(texts[i]) & shingles(texts[i + 1])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[i + 1])) for i in range(0, 60, 2))
    assert kept(spark, texts) == {i for i in range(0, 60, 2)}


def family(n, seed=3):
    """Twins at about 0.83 whose other relations are at about 0.63; all share a core."""
    rng = random.Random(seed)
    core, texts = words(rng, 634), []
    for _ in range(n):
        both = words(rng, 109)
        texts += [" ".join([*core, *both, *words(rng, 76)]) for _ in range(2)]
    return texts


def test_twins_in_a_large_family(spark):
    texts = family(100)
    share = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert 0.8 < share(texts[0], texts[1]) < 0.85 and 0.6 < share(texts[0], texts[2]) < 0.66
    assert kept(spark, texts) == {i for i in range(0, 200, 2)}


def test_tiles_of_a_large_bucket_connect_the_same(spark):
    """What is connected within each key, by one task and by grids of tiles."""
    rng = random.Random(4)
    sets = []
    for k in range(240):
        near = sets[k - 1] if k % 3 else set(rng.sample(range(10**6), 40))
        sets.append({*list(near)[1 if k % 3 == 2 else 9 :], *rng.sample(range(10**6), 1 if k % 3 == 2 else 5)})
    rows = [(key, i, i % 50, np.sort(np.array(list(sets[i]), np.uint64)).tobytes()) for i in range(240) for key in {0, i % 7 + 1}]

    def groups(links):
        root = {i: ("root", i % 50) for i in range(240)}  # what shares a root is connected
        for a, b in links:
            x, y = root[a], root[b]
            root = {i: y if r == x else r for i, r in root.items()}
        return sorted(sorted(i for i in root if root[i] == r) for r in set(root.values()))

    want = groups([(i, j) for i in range(240) for j in range(i) if i % 50 != j % 50 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    df = spark.createDataFrame(rows, "key long, node long, root long, set binary")
    for how in ({}, {"bucket": 30}, {"held_bytes": 6000}):
        links = [(r["a"], r["b"]) for r in simhash.across(spark, df, 0.8, **how).collect()]
        assert groups(links) == want and len(want) < 50 and all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
    assert len(simhash.across(spark, df, 0.8).collect()) < len(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_equal_to_all_pairs(spark, seed):
    """Against the components of all pairs at 0.8 or more."""
    rng, texts = random.Random(seed), []
    for _ in range(12):
        base = words(rng, rng.choice([6, 40, 200]))
        for _ in range(rng.randint(1, 12)):
            made = list(base)
            for at in rng.sample(range(len(made)), rng.randint(0, len(made) // 40)):
                made[at] = words(rng, 1)[0]
            texts.append(" ".join(made))
    texts += ["", " ", "one two", "one two", "one  two"]
    sets = [frozenset(shingles(t)) or t.strip() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            alike = len(a & b) >= 0.8 * len(a | b) if isinstance(a, frozenset) and isinstance(b, frozenset) else texts[i].split() == texts[j].split()
            if alike and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert kept(spark, texts) == {find(i) for i in range(len(texts))}
