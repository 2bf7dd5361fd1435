"""Operator 11: hard negatives by a two-dimensional block matrix multiply.

Scores are integer inner products of all anchors with all rows.  Rows are sorted by label
and cut in blocks; blocks are cut again in chunks of dimensions.  A cell (panel of anchor
blocks, panel of row blocks, chunk) is a task's work: it holds its anchor blocks, lets its
row blocks stream by and multiplies them, as in SUMMA, to partial int64 score tiles.  The
partial tiles of a pair of blocks are shuffled to one place and added.  A whole tile is
reduced where it is: to the first rows of each anchor, or of each window of an anchor and a
positive, and these lists are merged over a panel of rows before they leave.

This is done twice.  The first round takes only cells whose label ranges meet and finds the
positives; a window is known when they are.  The second finds the negatives and leaves out
tiles that hold one label only.  As rows are sorted by label, only tiles at the border of
two labels are made in both.

Rows with a null vec_id, label or vector, or with any null or non-finite component, take
no part, nor do rows with a component of 65,536 or more in magnitude, whose scores would not
be exact in 64 bits.  A vector that is shorter than another one counts as zero beyond its
end, an empty one as zero.  Rows of one vec_id are rows of their own: each is an anchor,
each can be a positive of another.  Of tied scores the smaller vec_id comes first.  Very
long vectors make fewer rows a block.  An empty table gives an empty table; extra columns
are ignored.  A label of very many rows is many blocks; no task holds more than a panel of
anchors, a block of rows and a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, parts, table

#: Every so many ids an anchor; positives of an anchor; negatives of a positive; the window
#: of negative scores in hundredths of the positive's.
EVERY, POSITIVES, NEGATIVES, WINDOW = 100, 5, 10, (30, 90)
#: Rows of a block (anchors, rows), blocks of a panel, chunks of dimensions at most and
#: dimensions of a chunk at least, bytes of a block of long vectors.
ANCHORS, ROWS, PANEL, CHUNKS, WIDTH, BLOCK_BYTES = 256, 1024, 64, 8, 32, 16 << 20
SCALE, LARGEST = 256, 1 << 24
#: Below every score.
NONE = np.iinfo(np.int64).min


def whole(df: DataFrame) -> DataFrame:
    """Rows that take part: row (a number), vec_id, label, x (int32 components), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, xs, sizes = [], [], []
            for k, v in enumerate(batch.column(2)):
                x = np.zeros(0) if not len(v.values) else v.values.to_numpy(zero_copy_only=False).astype(float)
                x = np.floor(SCALE * x)
                if np.isfinite(x).all() and (np.abs(x) <= LARGEST).all():
                    keep.append(k)
                    xs.append(x.astype("<i4").tobytes())
                    sizes.append(len(x))
            some = batch.select(["vec_id", "label"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(xs, pa.binary()), pa.array(sizes, pa.int32())], names=["vec_id", "label", "x", "size"])

    rows = need(df, "vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    made = rows.mapInArrow(run, "vec_id long, label long, x binary, size int")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def blocks(spark: SparkSession, rows: DataFrame, most: int, per_panel: int, width: int, name: str) -> DataFrame:
    """Rows sorted by label in blocks, by chunk: panel, block, chunk, low, high (labels), n,
    x (int32, n by width) and, with chunk 0, what reduction needs: rows, ids, labels and
    windows.  Places come from a range partitioning and offsets of its partitions."""
    order = ["label", "vec_id", "row"]
    dealt = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    placed = table(spark, dealt.select("*", F.monotonically_increasing_id().alias("place")), f"{name}-sorted")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("at", at).withColumn("block", F.floor(F.col("at") / most))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def close() -> Iterator[pa.RecordBatch]:
            n = len(held)
            longest = max(1, max(len(h[3]) // 4 for h in held))
            chunks = -(-longest // width)
            x = np.zeros((n, chunks * width), "<i4")
            for i, h in enumerate(held):
                x[i, : len(h[3]) // 4] = np.frombuffer(h[3], "<i4")
            labels = np.array([h[2] for h in held], np.int64)
            facts = [np.array([h[i] for h in held], np.int64).tobytes() for i in (0, 1)]
            windows = [h[4] for h in held]
            for c in range(chunks):
                first = c == 0
                cols = [now // per_panel, now, c, int(labels.min()), int(labels.max()), n, np.ascontiguousarray(x[:, c * width : (c + 1) * width]).tobytes(), facts[0] if first else None, facts[1] if first else None, labels.tobytes() if first else None, windows if first else None]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

        for batch in batches:
            for block, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != now:
                    if held:
                        yield from close()
                    held, now = [], block
                held.append(row)
        if held:
            yield from close()

    windows = F.col("windows") if "windows" in rows.columns else F.lit(None).cast("binary")
    cut = numbered.select("block", "row", "vec_id", "label", "x", windows.alias("windows"), "at").repartition("block").sortWithinPartitions("block", "at").drop("at")
    return table(spark, cut.mapInArrow(pack, "panel long, block long, chunk int, low long, high long, n int, x binary, rows binary, ids binary, labels binary, windows array<binary>"), name)


_NAMES = ["panel", "block", "chunk", "low", "high", "n", "x", "rows", "ids", "labels", "windows"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int32 matrices in int64: by doubles where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _multiply(same: bool):
    """Rows of one cell after another, anchor blocks (side 0) first -> partial tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["p"], r["q"], r["chunk"]) != cell:
                    cell, held = (r["p"], r["q"], r["chunk"]), []
                r["m"] = np.frombuffer(r["x"], "<i4").reshape(r["n"], -1)
                if r["side"] == 0:
                    held.append(r)
                    continue
                for a in held:
                    if same and (a["high"] < r["low"] or r["high"] < a["low"]) or not same and a["low"] == a["high"] == r["low"] == r["high"]:
                        continue
                    tile = product(a["m"], r["m"])
                    cols = [a["block"], r["panel"], r["block"], r["chunk"], a["n"], r["n"], tile.tobytes(), *[a[k] for k in _FACTS], *[r[k] for k in _FACTS[:3]]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cols, _TILE_KINDS, strict=True)], names=_TILE_NAMES)

    return run


_FACTS = ["rows", "ids", "labels", "windows"]
_TILE_NAMES = ["i", "q", "j", "chunk", "n", "m", "tile", *[f"a_{k}" for k in _FACTS], *[f"r_{k}" for k in _FACTS[:3]]]
_TILE_KINDS = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.list_(pa.binary())] + [pa.binary()] * 3
_TILES = "i long, q long, j long, chunk int, n int, m int, tile binary, a_rows binary, a_ids binary, a_labels binary, a_windows array<binary>, r_rows binary, r_ids binary, r_labels binary"


class Lists:
    """First entries for each key (an anchor, or an anchor's place of a positive): scores
    falling, then ids; kept over the tiles of a panel."""

    def __init__(self, keys: int, size: int):
        self.score, self.id, self.row = (np.full((keys, size), v, np.int64) for v in (NONE, np.iinfo(np.int64).max, -1))

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        size = self.score.shape[1]
        s, d, r = np.concatenate([self.score, score], axis=1), np.concatenate([self.id, ids], axis=1), np.concatenate([self.row, rows], axis=1)
        # Scores of -2**63 are none, so their complement is a key that sorts them last.
        order = np.lexsort((r, d, ~s), axis=1)[:, :size]
        self.score, self.id, self.row = (np.take_along_axis(v, order, axis=1) for v in (s, d, r))


def bounds(score: int, window: tuple[int, int] = WINDOW) -> tuple[int, int]:
    """Least and greatest negative score for a positive's: window[0] * score <= 100 * s <= window[1] * score."""
    return -((-window[0] * score) // 100), window[1] * score // 100


def _reduce(same: bool, positives: int, negatives: int):
    """Partial tiles in order of (i, q, j, chunk) -> first entries of each key of i in q."""

    def first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """The first n of each line; columns are sorted by id, so a stable sort breaks ties."""
        order = np.argsort(~score, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(score, order, axis=1), ids[order], rows[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lists, anchors, windows = None, None, None, None
        tile, facts, at = None, None, None

        def finish_tile() -> None:
            a_rows, a_labels, r_rows, r_ids, r_labels = facts
            by_id = np.lexsort((r_rows, r_ids))
            score, r_rows, r_ids, r_labels = tile[:, by_id], r_rows[by_id], r_ids[by_id], r_labels[by_id]
            alike = a_labels[:, None] == r_labels
            if same:
                score = np.where(alike & (a_rows[:, None] != r_rows), score, NONE)
                lists.add(*first(score, r_ids, r_rows, positives))
                return
            order = np.argsort(~np.where(alike, NONE, score), axis=1, kind="stable")
            ranked = np.take_along_axis(np.where(alike, NONE, score), order, axis=1)
            low, high = windows[:, :, 0], windows[:, :, 1]
            start = np.stack([(ranked > high[:, [k]]).sum(axis=1) for k in range(positives)], axis=1).reshape(-1)
            line = np.repeat(np.arange(len(a_rows)), positives)
            take = start[:, None] + np.arange(negatives)
            inside = take < ranked.shape[1]
            take = np.minimum(take, ranked.shape[1] - 1)
            s, c = ranked[line[:, None], take], order[line[:, None], take]
            good = inside & (s >= low.reshape(-1)[:, None])
            lists.add(np.where(good, s, NONE), r_ids[c], r_rows[c])

        def finish_group() -> Iterator[pa.RecordBatch]:
            size = 1 if same else positives
            key, place = np.nonzero(lists.score != NONE)
            cols = [anchors[0][key // size], anchors[1][key // size], (key % size).astype(np.int64), lists.row[key, place], lists.id[key, place], lists.score[key, place]]
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a_row", "a_id", "slot", "row", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                ints = lambda k: np.frombuffer(r[k], np.int64)  # noqa: B023, E731
                if (r["i"], r["q"], r["j"]) != at:
                    if tile is not None:
                        finish_tile()
                    tile, at = np.zeros((r["n"], r["m"]), np.int64), (r["i"], r["q"], r["j"])
                if (r["i"], r["q"]) != group:
                    if lists is not None:
                        yield from finish_group()
                    group, anchors = (r["i"], r["q"]), (ints("a_rows"), ints("a_ids"))
                    lists = Lists(r["n"] * (1 if same else positives), positives if same else negatives)
                    if not same:
                        windows = np.array([np.frombuffer(w, np.int64).reshape(-1, 2) for w in r["a_windows"]])
                if r["chunk"] == 0:
                    facts = [ints(k) for k in ("a_rows", "a_labels", "r_rows", "r_ids", "r_labels")]
                tile += np.frombuffer(r["tile"], np.int64).reshape(r["n"], r["m"])
        if tile is not None:
            finish_tile()
            yield from finish_group()

    return run


def tops(spark: SparkSession, anchors: DataFrame, rows: DataFrame, *, same: bool, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Blocks of anchors and of rows -> (a_row, a_id, slot, row, vec_id, score), a list for
    each panel of rows."""
    # Label ranges of panels: one for 16,384 anchors or 65,536 rows.
    ranges = {side: sorted((r["panel"], r["low"], r["high"]) for r in b.groupBy("panel").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()) for side, b in (("p", anchors), ("q", rows))}

    def meeting(side: str, panel: str):
        """Panels of the other side that a panel meets."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
                pairs = [(k, other) for k in range(batch.num_rows) for other, a, b in ranges[side] if not same or a <= high[k] and low[k] <= b]
                for s in range(0, len(pairs), 16):
                    some = batch.take(pa.array([k for k, _ in pairs[s : s + 16]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([o for _, o in pairs[s : s + 16]], pa.int64())], names=[*some.schema.names, side])

        return run

    schema = "panel long, block long, chunk int, low long, high long, n int, x binary, rows binary, ids binary, labels binary, windows array<binary>"
    left = anchors.mapInArrow(meeting("q", "p"), f"{schema}, q long").withColumn("p", F.col("panel")).withColumn("side", F.lit(0))
    right = rows.mapInArrow(meeting("p", "q"), f"{schema}, p long").withColumn("q", F.col("panel")).withColumn("side", F.lit(1))
    cells = left.unionByName(right).repartition("p", "q", "chunk").sortWithinPartitions("p", "q", "chunk", "side", "block")
    tiles = cells.mapInArrow(_multiply(same), _TILES)
    dealt = tiles.repartition("i", "q").sortWithinPartitions("i", "q", "j", "chunk")
    return dealt.mapInArrow(_reduce(same, positives, negatives), "a_row long, a_id long, slot long, row long, vec_id long, score long")


def mine(spark: SparkSession, df: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = table(spark, whole(df), "rows")
    longest = rows.agg(F.max("size")).first()[0] or 0
    width = max(WIDTH, -(-longest // CHUNKS))
    fit = max(16, BLOCK_BYTES // (4 * max(1, longest)))
    wide = blocks(spark, rows, min(ROWS, fit), PANEL, width, "row-blocks")
    chosen = rows.where(F.col("vec_id") % every == 0)
    narrow = blocks(spark, chosen, min(ANCHORS, fit), PANEL, width, "anchor-blocks")
    found = tops(spark, narrow, wide, same=True, positives=positives)
    order = Window.partitionBy("a_row").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < positives)
    known = table(spark, found.select("a_row", F.col("slot").cast("long"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for scores in batch.column(1).to_pylist():
                w = np.tile(np.array([np.iinfo(np.int64).max, NONE], np.int64), (positives, 1))  # empty
                for s in scores:
                    low, high = bounds(s["positive_score"], window)
                    if low <= high:
                        w[s["slot"]] = low, high
                out.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "windows"])

    windows = known.groupBy(F.col("a_row").alias("row")).agg(F.collect_list(F.struct("slot", "positive_score")).alias("scores"))  # at most `positives`
    asked = blocks(spark, chosen.join(windows.mapInArrow(limits, "row long, windows binary"), "row"), min(ANCHORS, fit), PANEL, width, "asked-blocks")
    hard = tops(spark, asked, wide, same=False, positives=positives, negatives=negatives)
    order = Window.partitionBy("a_row", "slot").orderBy(F.desc("score"), "vec_id", "row")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.join(known, ["a_row", "slot"]).select(F.col("a_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``mine`` over labels of which those of ids divisible by 7 are moved on by one."""
    moved = need(df, "vec_id", "label", "embedding")
    return mine(spark, moved.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
