"""Operator 4: embedding near-duplicates by an epsilon grid order join.

Unit vectors within cosine c are within eps = sqrt(2 - 2c) of each other.  Vectors are
projected on their leading principal directions (fitted on a bounded sample; any
directions are correct, better ones only skip more), put on a grid of cells of side eps
there, and sorted by cell: the epsilon grid order.  The sequence is cut in blocks, whose
bounding boxes have the projections and, as one more coordinate, the length of what the
projection leaves out; distances of boxes are then no greater than those of vectors.  A
recursion over intervals of the sequence finds, for each tile of blocks, the tiles it can
reach: an interval whose box is further than eps away is skipped whole.  A task has a pair
of tiles; it holds the blocks of one and lets those of the other stream by, so a block is
sent once for each tile it meets, not for each block.  Pairs of blocks are halved in the
same way down to leaves, whose vectors are compared by matrix products; what single
precision cannot decide is computed again in double.

Equal vectors are one node with a count, and what is found for one goes back by a join that
splits frequent ones.  A pair of blocks leaves each node's number of links and the edges of
a spanning forest, never all its pairs.

Null or empty vectors, zero vectors and those with null or non-finite components link
with nothing.  Vectors of different lengths never link.  A row without vec_id is compared
and counted like any other but names no component.  Repeated rows link with each other;
a cosine of exactly the threshold links.  Very long vectors make smaller tiles.
An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, need, split_join, table

COSINE = 0.9
#: Vectors the directions are fitted on, directions, those of them that the order is by,
#: vectors of a block and of a leaf, and bytes of the blocks that a task holds.
SAMPLE, DIRECTIONS, ORDER, BLOCK, LEAF, TILE_BYTES = 4096, 16, 6, 4096, 256, 64 << 20
#: More than the rounding error of a product in single precision.
SLACK = 1e-4


def nodes(df: DataFrame) -> DataFrame:
    """vec_id and raw: the vector as doubles (binary), null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                out = []
                for v in batch.column(1):
                    x = np.array([], float) if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(float)
                    norm = np.sqrt((x / m) @ (x / m)) if len(x) and np.isfinite(x).all() and (m := np.abs(x).max()) > 0 else 0
                    out.append(x.tobytes() if norm > 0 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    return need(df, "vec_id", "embedding").mapInArrow(run, f"vec_id {df.schema['vec_id'].dataType.simpleString()}, raw binary")


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), float).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(sample: np.ndarray, k: int = DIRECTIONS) -> np.ndarray:
    if not len(sample):
        return np.zeros((0, 0))
    _, vectors = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], sample.shape[1]) if len(sample) > 1 else np.eye(sample.shape[1]))
    return vectors[:, ::-1][:, :k].copy()


def place(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projections of unit vectors, and the length of the rest: distances here are no
    greater than those of the vectors."""
    p = x @ basis
    return np.concatenate([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1, keepdims=True)))], axis=1)


def gap(a_low, a_high, b_low, b_high) -> np.ndarray:
    """Distance of boxes."""
    d = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high))
    return np.sqrt((d * d).sum(axis=-1))


class Intervals:
    """Boxes of all intervals of a halving of the sequence of blocks."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = [low], [high]
        while len(self.low[-1]) > 1:
            a, b = self.low[-1], self.high[-1]
            if len(a) % 2:
                a, b = np.concatenate([a, a[-1:]]), np.concatenate([b, b[-1:]])
            self.low.append(np.minimum(a[::2], a[1::2]))
            self.high.append(np.maximum(b[::2], b[1::2]))

    def reach(self, i: int, eps: float, before: bool = False) -> list[int]:
        """Blocks from i on that block i can hold links with; or those before i."""
        found, n = [], i if before else len(self.low[0])
        stack = [(len(self.low) - 1, 0)]
        while stack:
            level, k = stack.pop()
            if k >= len(self.low[level]) or (k << level >= i if before else (k + 1) << level <= i) or gap(self.low[0][i], self.high[0][i], self.low[level][k], self.high[level][k]) > eps:
                continue
            if level:
                stack += [(level - 1, 2 * k), (level - 1, 2 * k + 1)]
            elif k < n and (before or i <= k):
                found.append(k)
        return found


class Pair:
    """Links of two blocks: counts, and a spanning forest kept by labels."""

    def __init__(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, basis: np.ndarray, cosine: float, same: bool):
        self.a, self.b, self.wa, self.wb, self.cosine, self.same = a, b, wa, wb, cosine, same
        self.a32, self.b32 = a.astype(np.float32), b.astype(np.float32)
        self.pa, self.pb = place(a, basis), place(b, basis)
        self.leaves = self.skipped = 0
        self.eps = (2 - 2 * cosine) ** 0.5 + 1e-6  # more than the rounding of a rest's length
        self.na, self.nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.label = np.arange(len(a) + (0 if same else len(b)))
        self.shift = 0 if same else len(a)
        self.edges: list[tuple[int, int]] = []

    def run(self, i: slice, j: slice) -> None:
        if self.same and j.stop <= i.start:
            return  # the mirror image is joined
        if gap(self.pa[i].min(axis=0), self.pa[i].max(axis=0), self.pb[j].min(axis=0), self.pb[j].max(axis=0)) > self.eps:
            self.skipped += -(-(i.stop - i.start) // LEAF) * -(-(j.stop - j.start) // LEAF)
            return
        if i.stop - i.start <= LEAF and j.stop - j.start <= LEAF:
            self.leaves += 1
            self.leaf(i, j)
            return
        halves = lambda s: [s] if s.stop - s.start <= LEAF else [slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop)]
        for x in halves(i):
            for y in halves(j):
                self.run(x, y)

    def leaf(self, i: slice, j: slice) -> None:
        near = self.a32[i] @ self.b32[j].T >= self.cosine - SLACK
        if self.same:
            near &= np.arange(j.start, j.stop) > np.arange(i.start, i.stop)[:, None]
        x, y = np.nonzero(near)
        for s in range(0, len(x), 1 << 18):
            e = slice(s, s + (1 << 18))
            near[x[e], y[e]] = np.einsum("ij,ij->i", self.a[i][x[e]], self.b[j][y[e]]) >= self.cosine
        if not near.any():
            return
        self.na[i] += near @ self.wb[j]
        self.nb[j] += self.wa[i] @ near
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            cols = np.flatnonzero(near[r]) + j.start + self.shift
            labels, first = np.unique(self.label[cols], return_index=True)
            own = self.label[i.start + r]
            if len(labels) > 1 or labels[0] != own:
                self.edges += [(i.start + r, int(c)) for c, l in zip(cols[first], labels, strict=True) if l != own]
                self.label[np.isin(self.label, np.append(labels, own))] = min(int(labels[0]), int(own))


def _pack(basis: np.ndarray):
    """A partition of nodes in grid order -> its blocks, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["part", "sub", "nodes", "counts", "raws", "low", "high"]

        def block(rows: list[tuple], sub: int) -> pa.RecordBatch:
            p = place(units([r[3] for r in rows]), basis)
            cols = [[rows[0][0]], [sub], [np.array([r[1] for r in rows], np.int64).tobytes()], [np.array([r[2] for r in rows], np.int64).tobytes()], [b"".join(r[3] for r in rows)], [p.min(axis=0).tolist()], [p.max(axis=0).tolist()]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        sub = 0
        for batch in batches:
            held += list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK], sub)
                held, sub = held[BLOCK:], sub + 1
        if held:
            yield block(held, sub)

    return run


def _links(pair: Pair, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    both = na if pair.same else np.concatenate([na, nb])
    counts = pair.na + pair.nb if pair.same else np.concatenate([pair.na, pair.nb])
    some = np.flatnonzero(counts)
    ends = np.array(pair.edges, np.int64).reshape(-1, 2)
    cols = [np.concatenate([both[some], both[ends[:, 0]], [-1]]), [None] * len(some) + both[ends[:, 1]].tolist() + [pair.skipped], np.concatenate([counts[some], np.zeros(len(ends), np.int64), [pair.leaves]])]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])


def _compare(basis: np.ndarray, cosine: float):
    """Rows (i, j, side, block, nodes, counts, raws) in order of (i, j, side, block): the
    blocks of tile i, side 0, are held, and those of tile j meet them one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, side, block, nodes_, counts, raws = [c[k].as_py() for c in batch.columns]
                n, w = np.frombuffer(nodes_, np.int64), np.frombuffer(counts, np.int64)
                x = units([raws[s : s + len(raws) // len(n)] for s in range(0, len(raws), len(raws) // len(n))])
                if (i, j) != now:
                    now, held = (i, j), []
                if side == 0:
                    held.append((block, n, w, x))
                for other, m, v, y in held if side or i == j else ():
                    # In one tile a block meets itself and those before it.
                    pair = Pair(y, x, v, w, basis, cosine, other == block)
                    pair.run(slice(0, len(y)), slice(0, len(x)))
                    yield _links(pair, m, n)

    return run


def found_links(spark: SparkSession, of: DataFrame, size: int, cosine: float) -> DataFrame:
    """of(node, count, raw), vectors of one length -> (a, null, n): links of node a, to be
    summed; (a, b, 0): edges of a spanning forest; (-1, skipped, compared): how many pairs of
    leaves were skipped and compared."""
    sample = of.select("raw").orderBy(F.xxhash64("raw")).limit(SAMPLE).collect()  # bounded: SAMPLE vectors
    basis = directions(units([bytes(r["raw"]) for r in sample]))
    k, side = basis.shape[1], (2 - 2 * cosine) ** 0.5
    cells = [f"c{i}" for i in range(min(ORDER, k))]

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.floor(units(batch.column(2).to_pylist()) @ basis[:, : len(cells)] / side).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c[:, i]) for i in range(len(cells))]], names=["node", "count", "raw", *cells])

    n = of.count()
    placed = table(spark, of.mapInArrow(cell, "node long, count long, raw binary, " + ", ".join(f"{c} long" for c in cells)), "placed")
    dealt = placed.repartitionByRange(max(1, -(-n // BLOCK)), *cells, "node").sortWithinPartitions(*cells, "node")
    blocks = dealt.select(F.spark_partition_id().alias("part"), "node", "count", "raw").mapInArrow(_pack(basis), "part int, sub int, nodes binary, counts binary, raws binary, low array<double>, high array<double>")
    blocks = table(spark, blocks, "blocks")
    # A box for every BLOCK vectors: a few hundred bytes, some 100 MB for a billion vectors.
    boxes = blocks.select("part", "sub", "low", "high").orderBy("part", "sub").collect()
    # Blocks of a tile: as many as a task can hold, but tiles enough to keep all cores busy.
    tiles = max(1, int((2 * spark.sparkContext.defaultParallelism) ** 0.5))
    width = max(1, min(TILE_BYTES // (BLOCK * size), -(-len(boxes) // tiles)))
    low, high = (np.array([r[c] for r in boxes]) for c in ("low", "high"))
    cuts = np.arange(0, len(boxes), width)
    tree = Intervals(np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0))
    shared = spark.sparkContext.broadcast((tree, {(r["part"], r["sub"]): i for i, r in enumerate(boxes)}))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                block = number[batch.column(0)[k].as_py(), batch.column(1)[k].as_py()]
                own = block // width
                met = [(own, j, 0) for j in tree.reach(own, side + 1e-6)] + [(i, own, 1) for i in tree.reach(own, side + 1e-6, before=True)]
                for i, j, at in met:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (i, j, at, block)] + [batch.column(c).slice(k, 1) for c in (2, 3, 4)], names=["i", "j", "side", "block", "nodes", "counts", "raws"])

    rows = blocks.select("part", "sub", "nodes", "counts", "raws").mapInArrow(spread, "i int, j int, side int, block int, nodes binary, counts binary, raws binary")
    return rows.repartition("i", "j").sortWithinPartitions("i", "j", "side", "block").mapInArrow(_compare(basis, cosine), "a long, b long, n long")


def near(spark: SparkSession, df: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows, known = _known(spark, df, cosine)
    kind = df.schema["vec_id"].dataType.simpleString()
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if known is not None:
        made = split_join(rows.where("raw is not null"), known, ["raw"], "count").select("vec_id", "n_links", F.col("least").cast(kind).alias("component_id"))
        alone = made.unionByName(alone)
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def skipped(spark: SparkSession, df: DataFrame, *, cosine: float = COSINE) -> tuple[int, int]:
    """Pairs of leaves of the tiles that meet which were skipped by their boxes, and which
    were compared."""
    rows = table(spark, nodes(df), "vectors")
    out = np.zeros(2, np.int64)
    for size, distinct in _by_length(spark, rows):
        r = found_links(spark, distinct.select("node", "count", "raw"), size, cosine).where("a = -1").agg(F.sum("b"), F.sum("n")).first()
        out += [r[0] or 0, r[1] or 0]
    return int(out[0]), int(out[1])


def _by_length(spark: SparkSession, rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """Distinct vectors as (node, count, least, raw), by their length in bytes."""
    distinct = rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("count"), F.min("vec_id").alias("least"))
    distinct = table(spark, distinct.select(F.monotonically_increasing_id().alias("node"), "count", "least", "raw", F.length("raw").alias("size")), "nodes")
    lengths = [r["size"] for r in distinct.select("size").distinct().collect()]  # one, as a rule
    return [(n, distinct.where(F.col("size") == n).select("node", "count", "least", "raw")) for n in lengths]


def _known(spark: SparkSession, df: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame | None]:
    """The rows, and a table of (raw, count, n_links, least) of each distinct vector, least
    the smallest vec_id of its component."""
    rows = table(spark, nodes(df), "vectors")
    found = distinct = None
    for size, some in _by_length(spark, rows):
        links = found_links(spark, some.select("node", "count", "raw"), size, cosine)
        found = links if found is None else found.union(links)
        distinct = some if distinct is None else distinct.union(some)
    if found is None:
        return rows, None
    found = table(spark, found.where("a >= 0"), "links")
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    roots = components(spark, found.where("b is not null").select("a", "b"))
    joined = distinct.join(links, "node", "left").join(roots, "node", "left")
    joined = table(spark, joined.select("raw", "count", "least", (F.col("count") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "joined")
    least = table(spark, joined.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("members")), "least")
    return rows, table(spark, split_join(joined.drop("least"), least, ["root"], "members").select("raw", "count", "n_links", "least"), "known")
