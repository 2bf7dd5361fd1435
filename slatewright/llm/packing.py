"""Operator 9: best-fit packing by a grouping genetic algorithm.

A document is its token ids and an end id; only documents longer than a sequence are
cut.  Full pieces are sequences of their own.  The rest is dealt evenly, by a hash, to
shards of a bounded number of pieces; in each shard several islands (a Spark task each)
evolve packings.  An individual is the bin of each piece; those an island begins with
best-fit the pieces in random orders.  Crossover injects well-filled bins of one parent whole into
the other, removes from it the bins that now hold duplicates and best-fits the displaced
pieces; mutation dissolves the emptiest bins and some others.  Fewer bins are fitter, then
fuller ones.  Between rounds each island's elite migrates to the next island of its shard.
An island makes LEAST children a round at least, and goes on while it is above the lower
bound (of lengths, and of pieces that cannot share) until CHILDREN.  At the end the best
island of each shard wins, and the emptiest eighth of the bins of all shards is dissolved
and packed together once more in the same way, so that shards cost next to nothing.

Null and empty texts are one piece that holds the end id alone.  Repeated rows, rows without
doc_id among them, are packed as often as they occur.  Of equally full bins and pieces of
equal length the order is by a seed, so results are the same from run to run.  An empty
table gives an empty table.  Extra columns are ignored.  Texts of any length are encoded
whole.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, keeps, need, table

FILE = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces of a shard (mean), islands of a shard, rounds with migration after each,
#: individuals of an island, and children per round at least and at most.
SHARD, ISLANDS, ROUNDS, POPULATION, LEAST, CHILDREN = 4096, 3, 3, 6, 4, 60
#: Of the bins of a shard one in this many, the emptiest, is packed again with others.
AGAIN = 8

_caches: dict[str, tokens.Chunks] = {}
keeps(__name__, _caches.clear)


def encode_texts(texts: pa.Array, path: str | None = None, end_id: int = END_ID) -> list[bytes]:
    """Ids of each text and the end id, little-endian unsigned 32-bit."""
    path = path or tokens.vocabulary(FILE)
    if path not in _caches:
        _caches[path] = tokens.Chunks(tokens.from_json(path), drops_blanks=True)
    ids, at = tokens.encode_words(texts, _caches[path])
    end = np.asarray([end_id], "<u4").tobytes()
    return [ids[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def pieces(df: DataFrame, *, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = batch.column(0)
        at, rows = [], []
        for i, ids in enumerate(encode_texts(batch.column(1), path, end_id)):
            step = 4 * capacity
            for k, start in enumerate(range(0, len(ids), step)):
                part = ids[start : start + step]
                at.append(i)
                rows.append((k, start // 4, len(part) // 4, zlib.crc32(part), part))
        cols = list(zip(*rows, strict=True))
        made = [docs.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
        return pa.RecordBatch.from_arrays(made + [pa.array(cols[4], pa.binary())] * with_ids, names=names)

    return arrow_map(need(df, "doc_id", "text"), work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


#: The bin of each piece, and how much each bin holds.
Packing = tuple[np.ndarray, np.ndarray]


def fitted(order: np.ndarray, lengths: np.ndarray, capacity: int, start: Packing | None = None) -> Packing:
    """Each piece into the tightest bin that takes it, after the bins there are; bins come
    out fullest first.  Bins are kept by fill, with a sorted list of the fills that occur:
    the tightest is found by bisection.  Bins that take none of the pieces are left out."""
    labels, fills = start or (np.zeros(len(lengths), np.int64), np.zeros(0, np.int64))
    wanted, old = lengths[order], len(fills)
    most = capacity - int(wanted.min()) if len(order) else -1
    usable = np.flatnonzero(fills <= most)
    by_fill: dict[int, list[int]] = defaultdict(list)
    for b, fill in zip(usable.tolist(), fills[usable].tolist(), strict=True):
        by_fill[fill].append(b)
    occur, top, into = sorted(by_fill), old, []
    for length in wanted.tolist():
        at = bisect_right(occur, capacity - length)
        if at:
            fill = occur[at - 1]
            bins = by_fill[fill]
            b = bins.pop()
            if not bins:
                del occur[at - 1]
            fill += length
        else:
            b, fill = top, length
            top += 1
        into.append(b)
        if fill <= most:
            bins = by_fill[fill]
            if not bins:
                insort(occur, fill)
            bins.append(b)
    placed = np.array(into, np.int64)
    held = np.bincount(placed, wanted, top).astype(np.int64)
    held[:old] += fills
    # Of equally full bins the one that was touched last comes last.
    touched = np.arange(top)
    touched[placed] = old + np.arange(len(placed))
    ranks = np.lexsort((touched, -held))
    rank = np.empty(top, np.int64)
    rank[ranks] = np.arange(top)
    labels = labels.copy()
    labels[order] = placed
    return rank[labels], held[ranks]


def best_fit(order: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    return _grouped(fitted(np.asarray(order, np.int64), np.asarray(lengths, np.int64), capacity)[0])


def falling(lengths: np.ndarray) -> np.ndarray:
    return np.argsort(-lengths, kind="stable")


def rated(fills: np.ndarray) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (sum of squares); greater is better."""
    return -len(fills), int((fills * fills).sum())


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    return rated(_packing(bins, np.asarray(lengths, np.int64))[1])


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs.  For each size k up to half a bin: pieces over half
    have a bin each; those of k to a half can only use the room that is left there by the
    ones that are not over capacity - k, and bins of their own."""
    x = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    if not len(x):
        return 0
    half = np.searchsorted(x, capacity // 2, "right")
    k = np.unique(np.concatenate([[0], x[:half]]))
    low, high = np.searchsorted(x, k, "left"), np.searchsorted(x, capacity - k, "right")
    room = (high - half) * capacity - (total[high] - total[half])
    own = np.maximum(0, -((room - (total[half] - total[low])) // capacity))
    return int((len(x) - half + own).max())


def crossover(giver: Packing, taker: Packing, lengths: np.ndarray, falling: np.ndarray, capacity: int, rng: random.Random) -> Packing:
    """Whole bins of ``giver``, as full as its mean at least, go into ``taker``."""
    (of_giver, fills), (of_taker, others) = giver, taker
    share = rng.uniform(0.3, 0.9)
    given = fills >= int(fills.sum()) / max(1, len(fills))
    given[given] = _draws(rng, int(given.sum())) < share
    inside = given[of_giver]
    broken = np.zeros(len(others), bool)
    broken[of_taker[inside]] = True
    displaced = broken[of_taker] & ~inside
    labels = np.where(inside, (np.cumsum(given) - 1)[of_giver], (int(given.sum()) + np.cumsum(~broken) - 1)[of_taker])
    return fitted(falling[displaced[falling]], lengths, capacity, (labels, np.concatenate([fills[given], others[~broken]])))


def mutate(packing: Packing, lengths: np.ndarray, falling: np.ndarray, capacity: int, rng: random.Random) -> Packing:
    """Dissolve the emptiest bins and a few others, and best-fit their pieces."""
    labels, fills = packing
    order = np.argsort(fills, kind="stable")
    rest = order[max(1, len(order) // 10) :]
    kept = rest[_draws(rng, len(rest)) >= 0.05]
    moved = np.full(len(fills), -1)
    moved[kept] = np.arange(len(kept))
    labels = moved[labels]
    return fitted(falling[(labels < 0)[falling]], lengths, capacity, (labels, fills[kept]))


def bred(lengths: np.ndarray, capacity: int, seed: int, elites: list[Packing], population: int, children: int, least: int = LEAST) -> tuple[list[Packing], int]:
    """One round of an island: its individuals, best first, and how many children were
    made.  It ends early, after ``least`` of them, at a bound that no packing can beat."""
    rng = random.Random(seed)
    bound = lower_bound(lengths, capacity)
    order = falling(lengths)
    people = list(elites)
    everything = list(range(len(lengths)))
    while len(people) < population:
        rng.shuffle(everything)
        people.append(fitted(np.array(everything, np.int64), lengths, capacity))
    ranked = sorted(((rated(p[1]), -k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
    born = 0
    while born < children and (born < least or -ranked[0][0][0] > bound):
        # Two parents, the better of two each, that need not be the best.
        one, two = (min(rng.randrange(len(ranked)), rng.randrange(len(ranked))) for _ in range(2))
        two += one == two
        child = crossover(ranked[one][2], ranked[two % len(ranked)][2], lengths, order, capacity, rng)
        child = mutate(child, lengths, order, capacity, rng)
        born += 1
        ranked.append((rated(child[1]), -population - born, child))
        ranked.sort(key=lambda x: x[:2], reverse=True)
        del ranked[population:]
    return [p for *_, p in ranked], born


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[list[int]]], population: int, children: int, least: int = LEAST) -> tuple[list[list[list[int]]], int]:
    """``bred`` on packings that are lists of bins."""
    sizes = np.asarray(lengths, np.int64)
    people, born = bred(sizes, capacity, seed, [_packing(e, sizes) for e in elites if e], population, children, least)
    return [_grouped(labels) for labels, _ in people], born


def _draws(rng: random.Random, n: int) -> np.ndarray:
    return np.array([rng.random() for _ in range(n)], float)


def _packing(bins: list[list[int]], lengths: np.ndarray) -> Packing:
    labels = np.empty(len(lengths), np.int64)
    for k, b in enumerate(bins):
        labels[b] = k
    return labels, _fills(labels, lengths)


def _fills(labels: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(labels, lengths).astype(np.int64)


def _grouped(labels: np.ndarray) -> list[list[int]]:
    """The pieces of each bin, in order of the bins, none of which is empty."""
    ends = np.cumsum(np.bincount(labels))[:-1] if len(labels) else []
    return [x.tolist() for x in np.split(np.argsort(labels, kind="stable"), ends)] if len(labels) else []


def _islands(spark: SparkSession, items: DataFrame, capacity: int, islands: int, rounds: int, population: int, children: int) -> DataFrame:
    """items(shard, key, length) -> items with bin, of each shard's best packing, and born,
    the children that the shard's islands made for it."""

    def step(final: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["key", "origin"], kind="stable")
            shard, island, last = int(pdf["shard"].iat[0]), int(pdf["island"].iat[0]), int(pdf["round"].iat[0])
            elites = [g for _, g in pdf.groupby("origin")]
            own = elites[0]
            lengths = own["length"].to_numpy(np.int64)
            people = [(labels, _fills(labels, lengths)) for g in elites if (labels := g["bin"].to_numpy(np.int64))[0] >= 0]
            # An island knows its own count; the last step has every island's.
            born = sum(int(g["born"].iat[0]) for g in elites) if final else sum(int(g["born"].iat[0]) for g in elites if int(g["origin"].iat[0]) == island)
            if final:
                best = max(people, key=lambda p: rated(p[1]))
            else:
                made, more = bred(lengths, capacity, (shard * 8191 + island) * 127 + last, people, population, children)
                best, born = made[0], born + more
            return pd.DataFrame({"shard": own["shard"].to_numpy(), "island": island, "round": last + 1, "origin": island, "key": own["key"].to_numpy(), "length": own["length"].to_numpy(), "bin": best[0].astype(np.int32), "born": born})

        return run

    schema = "shard long, island int, round int, origin int, key long, length long, bin int, born int"
    state = items.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("round"), F.lit(0).alias("origin"), "key", "length", F.lit(-1).alias("bin"), F.lit(0).alias("born"))
    for _ in range(rounds):
        made = state.groupBy("shard", "island").applyInPandas(step(False), schema)
        state = made.withColumn("island", F.explode(F.array(F.col("origin"), (F.col("origin") + 1) % islands)) if islands > 1 else F.col("origin"))
    last = state.where("island = origin").withColumn("island", F.lit(0))
    return last.groupBy("shard", "island").applyInPandas(step(True), schema).select("shard", "key", "length", "bin", "born")


def place(spark: SparkSession, made: DataFrame, *, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """pieces() rows, in a written table, plus sequence_id, offset and children, how many
    packings the islands bred for the shard that the piece's sequence comes from."""
    full = made.where(F.col("length") >= capacity)
    small = table(spark, made.where(F.col("length") < capacity).select(F.monotonically_increasing_id().alias("key"), *made.columns), "pieces")
    n = small.count()
    shards = max(1, -(-n // shard))
    first = _islands(spark, small.select((F.pmod(F.xxhash64("key"), F.lit(shards))).alias("shard"), "key", "length"), capacity, islands, rounds, population, children)
    first = table(spark, first, "packed")
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    # The emptiest bins of each shard, two at least, are packed together again.
    emptiest = Window.partitionBy("shard").orderBy("fill", "bin")
    fills = fills.withColumns({"rank": F.row_number().over(emptiest), "bins": F.count("*").over(Window.partitionBy("shard"))})
    ends = fills.where(F.col("rank") <= F.greatest(F.lit(2), F.col("bins") / AGAIN)).select("shard", "bin", F.lit(True).alias("loose"))
    marked = first.join(ends, ["shard", "bin"], "left")
    loose_shards = max(1, shards // 64)
    again = _islands(spark, marked.where("loose").select((F.pmod(F.xxhash64("key", F.lit(7)), F.lit(loose_shards))).alias("shard"), "key", "length"), capacity, islands, rounds, population, children)
    kept = marked.where("loose is null").select("key", (F.col("shard") * (1 << 24) + F.col("bin")).alias("sequence_id"), "born")
    redone = again.select("key", ((F.col("shard") + shards) * (1 << 24) + F.col("bin")).alias("sequence_id"), "born")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key")
    inside = small.join(kept.union(redone), "key").withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "born": F.lit(0)})
    out = [*made.columns, "sequence_id", "offset", F.col("born").alias("children")]
    return inside.select(*out).unionByName(alone.select(*out))


def pack(spark: SparkSession, df: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, **how) -> DataFrame:
    made = table(spark, pieces(df, path=path, end_id=end_id, capacity=capacity, with_ids=with_ids), "ids")
    return place(spark, made, capacity=capacity, **how)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences of a frame made with ``with_ids``; each is
    at most the capacity, so its group is bounded."""
    parts_ = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts_, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
