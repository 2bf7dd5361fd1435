"""Operator 5: SimHash near-duplicates by the generalised pigeonhole.

Fingerprints are 64 bits, each the majority over the hashes of a text's word shingles.
Two link when at most DISTANCE bits differ.  The search is exact: bits are cut in m groups
and group i gets a threshold t_i of at least -1 with sum(t_i) = DISTANCE - m + 1.  If two
fingerprints differed in more than t_i bits in every group, they would differ in more than
DISTANCE bits; so each linked pair agrees up to t_i bits in some group i.  Correlated
bits share a group (their joint values are the least selective, and such a group can be
given a threshold of -1, that is, no lookups).  m and the thresholds come from dynamic
programming over groups on estimated costs: lookups, and candidates for this number of
fingerprints.

Equal fingerprints are one node, so copies cost nothing, and what is found for a fingerprint
goes back to its copies by a join that splits frequent ones.  A bucket is joined inside its
task and leaves the edges of a spanning forest, never all its pairs: the task holds the
index rows and lets the lookups stream by.  The index rows of a large bucket are dealt to
parts, its lookups too, and every part of one meets every part of the other in a task of
its own.

A bit set in exactly half the hashes is 0.  Null and empty texts have fingerprint zero and link like any other.  Rows without doc_id
get a fingerprint and their component's smallest doc_id, but name no component (it is
null where no row has one).  Repeated rows link with each other.  An empty table gives an
empty table; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, arrow_map, components, free, is_empty, mark, need, pick_rows, release, split_join, table, utf8

BITS, DISTANCE = 64, 3
#: Words of a shingle of the contract's query; near-duplicate operators elsewhere take 5.
WORDS = 3
SEED = 42
#: Members of a bucket that one task joins; a larger bucket is split.
BUCKET = 4096
#: Similarity of near copies; bytes of sets that a task holds to compare others with.
SIMILAR, HELD_BYTES = 0.8, 16 << 20
#: Keys of a set of shingles, and smallest hashes that a key stands for.
KEYS, HASHES = 16, 4

_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def hashes(text: bytes, words: int = WORDS) -> list[int]:
    """Hash of every shingle.  A-Z in lower case; words are runs without the six ASCII
    blanks, which is how bytes.split() cuts."""
    parts = text.lower().split()
    if not parts:
        return []
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [h(b" ".join(parts), SEED)]
    if words == 3:
        return [h(b"%b %b %b" % x, SEED) for x in zip(parts, parts[1:], parts[2:], strict=False)]
    joined = b" ".join(parts)
    starts = np.cumsum([0] + [len(p) + 1 for p in parts]).tolist()
    return [h(joined[s : e - 1], SEED) for s, e in zip(starts, starts[words:], strict=False)]


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Unsigned fingerprints."""
    return majority([hashes(t, words) for t in texts])


def majority(each: list) -> np.ndarray:
    """Unsigned fingerprints of lists of hashes."""
    counts = np.array([len(x) for x in each], np.int64)
    flat = np.concatenate([np.asarray(x, np.uint64) for x in each]) if len(each) else np.zeros(0, np.uint64)
    ones = np.zeros((len(each), BITS), np.int64)
    doc = np.repeat(np.arange(len(each)), counts)
    lanes = flat.view(np.uint8).reshape(-1, 8)
    step = 256  # documents at a time, which bounds the histograms
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i in range(0, len(each), step):
        j = min(len(each), i + step)
        part = slice(bounds[i], bounds[j])
        base = (doc[part] - i) * 256
        for lane in range(8):
            hist = np.bincount(base + lanes[part, lane], minlength=(j - i) * 256).reshape(j - i, 256)
            ones[i:j, lane * 8 : lane * 8 + 8] = hist @ _BYTE_BITS
    bits = (2 * ones > counts[:, None]).astype(np.uint64)
    return (bits << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprint(df: DataFrame, *, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the fingerprint's bits as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints(utf8(batch.column(batch.num_columns - 1)), words).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*keep, "fp"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(need(df, *keep, "text").withColumnRenamed("text", "__text"), work, f"{fields}, fp long", "__text")


# ---------------------------------------------------------------- plan of the search


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = (x[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
            total += bits.T @ bits
            n += len(x)
        if n:
            at = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at any size
    found = {r["cell"]: r["n"] for r in rows}
    both = np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    return int(found.get(BITS * BITS, 0)), both


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def grouped(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size: each starts with the free bit that is most correlated
    with the other free bits and takes in turn the bit most correlated with the group."""
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        rest = sorted(free)
        first = max(rest, key=lambda i: (corr[i, rest].sum(), -i))
        group = [first]
        free.discard(first)
        while len(group) < size:
            nxt = max(sorted(free), key=lambda i: (corr[i, group].sum(), -i))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def agreement(p: np.ndarray, both: np.ndarray, n: int, group: list[int], distance: int = DISTANCE) -> np.ndarray:
    """Estimated share of pairs within 0, 1, .. distance bits on the group.  The number of
    differing bits gets the mean and the variance that the bits' marginals and
    correlations imply, as a beta-binomial."""
    q = 2 * p[group] * (1 - p[group])
    cov = (both / max(n, 1) - np.outer(p, p))[np.ix_(group, group)]
    mean = q.sum()
    pair = 2 * cov**2 + 2 * cov * np.outer(1 - 2 * p[group], 1 - 2 * p[group]) * 0.5
    var = (q * (1 - q)).sum() + (pair - np.diag(np.diag(pair))).sum()
    w = len(group)
    rate = min(max(mean / w, 1e-9), 1 - 1e-9)
    rho = min(max((var / (w * rate * (1 - rate)) - 1) / max(w - 1, 1), 1e-6), 0.9)
    a, b = rate * (1 - rho) / rho, (1 - rate) * (1 - rho) / rho
    from math import comb, exp, lgamma

    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return np.cumsum([d <= w and comb(w, d) * exp(beta(d + a, w - d + b) - beta(a, b)) for d in range(distance + 1)])


def lookups(w: int, t: int) -> int:
    from math import comb

    return sum(comb(w, d) for d in range(t + 1))


def allocate(costs: list[list[float]], total: int, distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Thresholds, costs[i][t + 1] for t from -1, that sum to ``total`` at least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                value = (cost + own[t + 1], [*chosen, t])
                if spent + t not in step or value < step[spent + t]:
                    step[spent + t] = value
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE, lookup_cost: float = 8.0) -> list[tuple[list[int], int]]:
    """(group, threshold) of the groups to look up.  A candidate costs one unit and a row
    that is moved for a lookup ``lookup_cost``."""
    p, corr = np.diag(both) / max(n, 1), correlation(n, both)
    options = []
    for m in range(1, distance + 2):
        groups = grouped(corr, m)
        costs = []
        for g in groups:
            share = agreement(p, both, n, g, distance)
            costs.append([0.0] + [n * n * share[t] + lookup_cost * n * (1 + lookups(len(g), t)) for t in range(distance + 1)])
        cost, chosen = allocate(costs, distance - m + 1, distance)
        options.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


# ---------------------------------------------------------------- probing and verifying


def _key(x: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(group):
        out |= (x >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _rows(search: list[tuple[list[int], int]], index: bool):
    """For each node (node, fp, check) its key in each group (index), or every key within
    the group's threshold but its own (probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                own = [c.to_numpy(zero_copy_only=False) for c in whole.slice(at, 4096).columns]
                x = own[1].view(np.uint64)
                for k, (group, t) in enumerate(search):
                    key = _key(x, group)
                    masks = [0] if index else [sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(range(len(group)), d)]
                    for some in range(0, len(masks), 64):
                        part = np.array(masks[some : some + 64], np.uint64)
                        keys = (key[:, None] ^ part).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), *[pa.array(np.repeat(c, len(part))) for c in own]], names=["g", "key", "node", "fp", "check"])

    return run


class Bucket:
    """Rows of a bucket.  Index rows are held; lookups stream by.  At each level (a distance
    of the second fingerprint) labels tell which index rows are connected, and only pairs
    that connect two labels become edges; where there are few index rows and ``every``
    allows it, all pairs do."""

    def __init__(self, distance: int, levels: list[int], every: int):
        self.distance, self.levels, self.every = distance, levels, every
        self.parts: list[np.ndarray] = []
        self.labels: list[np.ndarray] | None = None

    def add(self, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """Rows (node, fp, check, probe), index rows first -> edges and their distance by
        the second fingerprint."""
        n = int(np.count_nonzero(rows[:, 3] == 0))
        if n:
            self.parts.append(rows[:n])
        return self.match(rows[n:]) if n < len(rows) else []

    def open(self) -> list[tuple[int, int, int]]:
        """After the last index row: edges among these."""
        index = np.concatenate(self.parts) if self.parts else np.zeros((0, 4), np.int64)
        self.node, self.fp, self.check = index[:, 0], index[:, 1].copy().view(np.uint64), index[:, 2].copy().view(np.uint64)
        self.labels = [np.arange(len(index)) for _ in self.levels]
        return self._match(index, True)

    def match(self, rows: np.ndarray) -> list[tuple[int, int, int]]:
        return (self.open() if self.labels is None else []) + self._match(rows, False)

    def close(self) -> list[tuple[int, int, int]]:
        return self.open() if self.labels is None else []

    def _match(self, rows: np.ndarray, own: bool) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        if not len(self.node):
            return out
        step = max(1, (1 << 20) // len(self.node))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            near = np.bitwise_count(part[:, 1].copy().view(np.uint64)[:, None] ^ self.fp) <= self.distance
            near &= part[:, 0][:, None] != self.node
            if not near.any():
                continue
            apart = np.bitwise_count(part[:, 2].copy().view(np.uint64)[:, None] ^ self.check)
            if len(self.node) <= self.every:
                r, c = np.nonzero(near & (apart <= self.levels[-1]))
                out += zip(part[r, 0].tolist(), self.node[c].tolist(), apart[r, c].tolist(), strict=True)
                continue
            for level, label in zip(self.levels, self.labels, strict=True):
                hit = near & (apart <= level)
                for r in np.flatnonzero(hit.any(axis=1)).tolist():
                    cols = np.flatnonzero(hit[r])
                    labels, first = np.unique(label[cols], return_index=True)
                    mine = label[at + r] if own else -1
                    if len(labels) > 1 or labels[0] != mine:
                        out += [(int(part[r, 0]), int(self.node[c]), int(apart[r, c])) for c, l in zip(cols[first], labels, strict=True) if l != mine]
                        all_ = np.append(labels, mine) if own else labels
                        if len(all_) > 1:
                            label[np.isin(label, all_)] = labels[0]
        return out


def _join(distance: int, levels: list[int], every: int):
    """Rows (g, key, tile, node, fp, check, probe) in order of (g, key, tile, probe); a
    bucket ends where one of the first three changes."""

    def emit(rows: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if rows:
            made = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(made[:, 2].astype(np.int32))], names=["a", "b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            bounds = np.concatenate([[0], np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(axis=1)) + 1, [len(block)]])
            out: list[tuple[int, int, int]] = []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                key = tuple(block[i, :3].tolist())
                if key != now:
                    if bucket is not None:
                        out += bucket.close()
                    # A bucket of one row, whole in this batch, has no pair.
                    alone = j - i == 1 and j < len(block)
                    now, bucket = key, None if alone else Bucket(distance, levels, every)
                if bucket is not None:
                    out += bucket.add(block[i:j, 3:])
            yield from emit(out)
        if bucket is not None:
            yield from emit(bucket.close())

    return run


def links(spark: SparkSession, nodes: DataFrame, *, distance: int = DISTANCE, check_distance: int = BITS, bucket: int = BUCKET, step: int = BITS, every: int = 0, more: DataFrame | None = None, within: int | None = None) -> DataFrame:
    """Edges (a, b, apart) over ``nodes(node, fp, check)`` whose components are those of all
    links; apart is the distance of the second fingerprints.  Where a second fingerprint, check, is given, links must agree on it too; with
    ``step`` there are edges of spanning forests at that many levels of agreement, and with
    ``every`` all pairs of small buckets, for a check of edges that follows.
    ``more`` are further buckets (g, key, node, fp, check); rows that meet in a bucket
    link at ``within`` bits, if given, instead of ``distance``."""
    n, both = bit_counts(nodes)
    if n < 2:
        return spark.createDataFrame([], "a long, b long, apart int")
    search = plan(n, both, distance)
    own = nodes.select("node", "fp", "check")
    index = own.mapInArrow(_rows(search, True), "g int, key long, node long, fp long, check long")
    if more is not None:
        index = index.union(more.select("g", "key", "node", "fp", "check"))
    probes = own.mapInArrow(_rows(search, False), "g int, key long, node long, fp long, check long")
    # Large buckets only; their number is at most the index rows over the bucket size.
    hot = index.groupBy("g", "key").count().where(F.col("count") > bucket).select("g", "key", F.ceil(F.col("count") / bucket).cast("int").alias("salts"))
    hot = table(spark, hot, "hot")
    zero, one = F.lit(0), F.lit(1)
    cols = ["node", "fp", "check"]
    if many := hot.count():
        # One of a bucket's worth of rows at most, so few; sent to the rows, whose keys are hot.
        named = F.broadcast(hot) if many <= FEW else hot
        lone = lambda df: df.join(named, ["g", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        dealt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
        every_salt = F.sequence(zero, F.col("salts") - 1)
        # Tile i * salts + p: index rows of part i, lookups of part p.
        rows = lone(index).withColumn("part", dealt).select("g", "key", F.explode(F.transform(every_salt, lambda p: F.col("part") * F.col("salts") + p)).alias("tile"), *cols, "salts")
        lookups_ = lone(probes)
        # A split bucket's members look each other up across its parts.
        across = lone(index).where("salts > 1")
        lookups_ = lookups_.union(across.select(*lookups_.columns)).withColumn("part", dealt).select("g", "key", F.explode(F.transform(every_salt, lambda i: i * F.col("salts") + F.col("part"))).alias("tile"), *cols)
        rows = rows.select("g", "key", "tile", *cols, zero.alias("probe")).union(lookups_.select("g", "key", "tile", *cols, one.alias("probe")))
    else:
        rows = index.select("g", "key", zero.alias("tile"), *cols, zero.alias("probe")).union(probes.select("g", "key", zero.alias("tile"), *cols, one.alias("probe")))
    levels = [*range(0, check_distance, step), check_distance]
    # In one order on every run: which pairs connect a large bucket depends on it.
    ordered = ["fp", "check", "node"]
    return rows.repartition("g", "key", "tile").sortWithinPartitions("g", "key", "tile", "probe", *ordered).mapInArrow(_join(distance if within is None else within, levels, every), "a long, b long, apart int")


def groups(spark: SparkSession, prints: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """A table (fp, component_id, copies) of the fingerprints of ``prints(doc_id, fp)``."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = table(spark, nodes.withColumns({"node": F.col("fp"), "check": F.lit(0).cast("long")}), "fingerprints")
    found = components(spark, links(spark, nodes, bucket=bucket))
    roots = table(spark, nodes.join(found, "node", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "roots")
    ids = table(spark, roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "ids")
    return table(spark, split_join(roots, ids, ["root"], "members").select("fp", "component_id", "copies"), "groups")


def components_of(spark: SparkSession, df: DataFrame, *, words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    prints = table(spark, fingerprint(df, words=words), "prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return split_join(prints, groups(spark, prints, bucket=bucket), ["fp"], "copies").select("doc_id", hexed, "component_id")


class Held:
    """Sets of hashes that others are compared with: rows of (node, root, set).  Labels are
    roots until a link joins two."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.node = np.array([r[0] for r in rows], np.int64)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.words, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.words), np.int32)
        self.number: dict[int, int] = {}
        self.root = np.array([self.number.setdefault(r[1], len(self.number)) for r in rows], np.int64)
        self.label = list(range(len(self.number)))

    def links(self, node: int, root: int, held: bytes, least: float) -> list[tuple[int, int]]:
        """One link to each group that this row is not in yet; it then is."""
        if root not in self.number:
            self.number[root] = len(self.label)
            self.label.append(len(self.label))
        label = np.array(self.label, np.int64)
        mine, own = label[self.number[root]], label[self.root]
        others = np.flatnonzero(own != mine)
        if not len(others):
            return []
        x = np.frombuffer(held, np.uint64)
        places = np.minimum(np.searchsorted(self.words, x), len(self.words) - 1)
        places = places[self.words[places] == x]
        self.mark[places] = 1
        if 8 * len(others) < len(own):
            shared = np.array([self.mark[self.at[self.start[r] : self.start[r + 1]]].sum() for r in others.tolist()], np.int64)
        else:
            shared = np.add.reduceat(self.mark[self.at], self.start[:-1])[others]
        self.mark[places] = 0
        close = shared >= least * (self.size[others] + len(x) - shared) - 1e-9
        if not close.any():
            return []
        hit = others[close]
        found, first = np.unique(own[hit], return_index=True)
        gone = set(found.tolist())
        self.label = [int(mine) if v in gone else v for v in self.label]
        return [(node, int(self.node[k])) for k in hit[first].tolist()]


def across(spark: SparkSession, rows: DataFrame, least: float, *, bucket: int = BUCKET, held_bytes: int = HELD_BYTES) -> DataFrame:
    """rows(key, node, root, set), sets as binary -> links (a, b) of a similarity of ``least`` or
    more between rows of one key and different roots, as many as connect what all such links
    do.  Every row is compared with every one of its key that it is not connected with, inside
    a task, which leaves links and never pairs.  A key of many rows, or of much text, is a grid
    of tiles, each of a bounded part of its rows by another."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("set")).alias("bytes"))
    salts = F.greatest(F.ceil(F.col("n") / bucket), F.ceil(F.col("bytes") / held_bytes)).cast("int").alias("salts")
    met = split_join(rows, table(spark, sizes.select("key", salts, "n"), "bucket-sizes"), ["key"], "n").withColumn("part", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    side = lambda k, first, last, tile: met.select("key", F.explode(F.transform(F.sequence(first, last), tile)).alias("tile"), F.lit(k).alias("side"), "node", "root", "set")
    # Tile i * salts + p: held rows of part i, rows of part p from i on stream by.
    held = side(0, F.col("part"), F.col("salts") - 1, lambda p: F.col("part") * F.col("salts") + p)
    by = side(1, F.lit(0), F.col("part"), lambda i: i * F.col("salts") + F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, known = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, tile, side_, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, tile) != now:
                    now, waiting, known = (key, tile), [], None
                if side_ == 0:
                    waiting.append(row)
                elif waiting or known is not None:
                    if known is None:
                        known, waiting = Held(waiting), []
                    out += known.links(*row, least)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    dealt = held.unionByName(by).repartition("key", "tile").sortWithinPartitions("key", "tile", "side", "node")
    return dealt.mapInArrow(run, "a long, b long")


def similar(spark: SparkSession, edges: DataFrame, keys: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Edges that connect what all pairs do whose ``texts(row, text)`` have a Jaccard similarity
    of at least ``least`` on the sets of their shingles; pairs are those of ``edges(a, b, apart)``
    and all that share one of ``keys(key, node)``.

    Each row's closest edge is measured first, which connects most groups, and then edges
    between groups.  Keys whose rows are in one group by then are done with; the rows of the
    others are compared, whatever number they are (``across``)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(np.array(hashes(t, words), np.uint64)).tobytes() for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "set"])

    def sets_of(some: DataFrame, name: str) -> DataFrame:
        some = table(spark, some.select(F.col("row").cast("long")).distinct(), "measured-rows")
        return table(spark, arrow_map(pick_rows(texts, some, "row", "left_semi").select("row", "text"), work, "row long, set binary"), name)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= least * (len(x) + len(y) - shared) - 1e-9:
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(count, "a long, b long")

    def rooted(pairs: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        return pairs

    # What is connected so far, as stars: they settle in one round, the edges took several.
    stars = lambda roots: roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    edges = table(spark, edges.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.min("apart").alias("apart")), "candidates")
    sets = sets_of(edges.select(F.col("a").alias("row")).union(edges.select("b")), "sets")
    closest = edges.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    found = table(spark, measured(closest), "measured")
    roots = table(spark, components(spark, found), "roots")
    between = rooted(edges.join(closest, ["a", "b"], "left_anti"), "a", "b").where("root_a <> root_b").select("a", "b")
    found = table(spark, stars(roots).union(measured(between)), "measured")
    roots = table(spark, components(spark, found), "roots")
    own = rooted(keys, "node").withColumnRenamed("root_node", "root")
    open_ = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    open_ = table(spark, open_.select("key", "n"), "open-keys")
    if is_empty(open_):
        return stars(roots)
    apart = table(spark, split_join(own, open_, ["key"], "n"), "apart")
    rows = apart.join(sets_of(apart.select(F.col("node").alias("row")), "more-sets").withColumnRenamed("row", "node"), "node")
    return stars(roots).union(across(spark, rows, least))


def shared_keys(sets: list[np.ndarray], keys: int = KEYS, of: int = HASHES) -> np.ndarray:
    """Keys of sets of hashes, a row each: a key stands for ``of`` smallest values, each
    under a multiplier of its own, so two sets share one with the probability that
    their similarity to the power of ``of`` gives; of sixteen keys of four hashes, sets
    of similarity 0.8 share at least one in 9,997 cases of 10,000.  No set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])[:-1]
    out = np.zeros((len(sets), keys), np.uint64)
    odd = np.random.default_rng(SEED).integers(1 << 62, size=keys * of, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
    for k in range(keys):
        name = np.full(len(sets), k, np.uint64)
        for m in odd[k * of : (k + 1) * of]:
            name = (name ^ (name >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(flat * m, starts)
        out[:, k] = name
    return out


def kept(spark: SparkSession, df: DataFrame, *, words: int = 5, distance: int = DISTANCE, within: int = 24, least: float = SIMILAR) -> DataFrame:
    """The rows but for near copies: of each group the row of the smallest doc_id stays (a
    row without one only if no other of its group has one).

    Near copies have a Jaccard similarity of ``least`` or more on the sets of their shingles
    of ``words`` words, which is measured exactly for every candidate.  Candidates meet in
    a bucket of the pigeonhole search at ``distance`` bits, or share one of KEYS keys
    (``shared_keys``).  Fingerprints are those of the sets, so repeats inside a text move no
    bit.  The search gives the closest pairs that connect its buckets, within ``within`` bits;
    rows of one key that these leave apart are compared all with all, whatever their bits and
    their number (``similar``).
    Rows with equal sets of shingles are one group whatever their doc_id and however often
    a shingle occurs: null and empty texts are one, repeated rows are one; of tied doc_ids the
    first row stays.  An empty table stays empty; columns of any name are kept; texts are read
    whole."""
    names = df.columns
    row = free(df, "row")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(2))
        short, sets = ([np.unique(np.array(hashes(t, w), np.uint64)) for t in texts] for w in (WORDS, words))
        made = [pa.array(majority(x).view(np.int64)) for x in (short, sets)]
        same = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
        some = [i for i, x in enumerate(sets) if len(x)]
        keys = shared_keys([sets[i] for i in some]).view(np.int64) if some else np.zeros((0, KEYS), np.int64)
        counts = np.zeros(len(sets) + 1, np.int32)
        counts[np.array(some, np.int64) + 1] = KEYS
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *made, pa.array(same.view(np.int64)), lists], names=["row", "doc_id", "fp", "check", "same", "keys"])

    tagged = table(spark, df.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = tagged.select(F.col(row).alias("row"), "text")
    prints = table(spark, arrow_map(tagged.select(F.col(row).alias("row"), "doc_id", "text"), work, f"row long, doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long, check long, same long, keys array<long>"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "fp", "check")).alias("first")
    nodes = prints.groupBy("same").agg(first, F.first("keys").alias("keys")).select("first", "keys", "first.fp", "first.check", F.col("first.row").alias("node"))
    nodes = table(spark, nodes, "fingerprints")
    shared = nodes.select(F.lit(-1).alias("g"), F.explode("keys").alias("key"), "node", "fp", "check")
    since = mark()
    found = links(spark, nodes, distance=distance, check_distance=within, step=4, more=shared, within=within)
    found = table(spark, components(spark, similar(spark, found, shared.select("key", "node"), texts, words, least)), "near-groups")
    release(spark, since, found)
    best = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    # The rows that go are fewer than those that stay.
    gone = table(spark, prints.select(F.col("row").alias(row)).join(best.select(F.col("first.row").alias(row)), row, "left_anti"), "gone")
    return pick_rows(tagged, gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in names])
