"""Operator 8: substring dedup by recompression.

A document's words are rewritten in rounds.  In each, maximal runs of one symbol become a
symbol, and then adjacent pairs (left class, right class) do, classes being a bit of the
symbol's name.  Names are 64-bit functions of what they stand for, so they are global: the
same in every document, task and round without an exchange, which is why all rounds of a
text run in one pass over it.  Rounds are length-restricted: a pair longer
than LONGEST words stays apart.  With each symbol goes the interval of words that its
being there depends on; where that interval lies inside a window of WINDOW words, every
equal window holds the same symbol at the same place.

So a window's anchor is, of the symbols of the highest round that has any whose interval lies
inside it, the one with the least name (named with its interval).  Equal windows have equal
anchors.  Spark counts anchors over all documents: only windows whose anchor occurs twice are
looked at further, and those without one (inside long runs) always are.  These are verified
by 128-bit names of their words.  What repeats is exactly what has an equal elsewhere, the
same document included.

Skew: equal texts are one text with a count (a repeated text of a window or more repeats
in all its windows), and what is found for it goes back by a join that splits frequent
texts; an anchor is sent once per text; windows that repeat within a stretch of text
are known at once and one of them is sent.  So a passage that very many documents
share meets in a task once per stretch, not per document.

Null and empty texts have no words.  Repeated rows are copies of each other.  Rows
without doc_id are handled like any other.  Of tied windows none is the original: all go.
An empty table gives an empty table; extra columns are ignored by ``report`` and kept by
``trim``, whatever their names.  Texts are read whole; a long one is worked on a stretch of
words at a time, stretches sharing all but one word of a window, so memory does not grow
with it but for the text and a few numbers for each of its anchors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, enter, free, keeps, need, slices, split_join, table, utf8

WINDOW = 35
#: Bytes of text worked on at a time; arrays of a few hundred bytes a word go with it.
CHUNK_BYTES = 1 << 20
ROUNDS = 4
LONGEST = 16

_U = np.uint64
#: Odd multipliers of the two word polynomials; any odd 64-bit numbers do.
_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_names = _Names()
keeps(__name__, _names.clear)


def powers(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r and its inverse modulo 2**64 to the powers 0 to n."""
    made = []
    for base in (r, pow(r, -1, 1 << 64)):
        out = np.full(n + 1, _U(base))
        out[0] = 1
        made.append(np.cumprod(out))
    return made[0], made[1]


_BLANK = re.compile(rb"[\t-\r ]")


def stretches(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """Texts as lists of words, about CHUNK_BYTES of text at a time: (numbers of texts, number
    of the first word of each list, words).  A long text is cut after a word; each part
    begins with the last ``window`` - 1 words of the part before, so every window lies in one."""
    which, first, lists, size = [], [], [], 0
    for k, text in enumerate(texts):
        at, number, carry = 0, 0, []
        while True:
            end = at + CHUNK_BYTES
            cut = _BLANK.search(text, end) if end < len(text) else None
            end = cut.start() if cut else len(text)
            words = carry + text[at:end].split()
            if which and size + end - at > CHUNK_BYTES:
                yield which, first, lists
                which, first, lists, size = [], [], [], 0
            which.append(k)
            first.append(number)
            lists.append(words)
            size += end - at
            if not cut:
                break
            carry = words[-(window - 1) :] if window > 1 else []
            at, number = end, number + len(words) - len(carry)
    if which:
        yield which, first, lists


class Batch:
    """Lists of words as one sequence of word names, a sentinel before, between and after."""

    def __init__(self, lists: list[list[bytes]]):
        self.count = np.array([len(w) for w in lists], np.int64)
        self.begin = np.cumsum(np.concatenate([[1], self.count[:-1] + 1])) if len(lists) else np.zeros(0, np.int64)
        total = int(self.count.sum()) + len(lists) + 1
        self.names = np.zeros(total, _U)
        self.sentinel = np.ones(total, bool)
        for b, w in zip(self.begin.tolist(), lists, strict=True):
            self.names[b : b + len(w)] = np.fromiter(map(_names.__getitem__, w), _U, len(w))
            self.sentinel[b : b + len(w)] = False
        self.start = np.concatenate([np.arange(b, b + n - WINDOW + 1) for b, n in zip(self.begin.tolist(), self.count.tolist(), strict=True) if n >= WINDOW] or [np.zeros(0, np.int64)])
        self.doc = np.repeat(np.arange(len(lists)), np.maximum(self.count - WINDOW + 1, 0))
        self._sums: dict[int, tuple] = {}

    def content(self, r: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A name of the words from low to high, wherever they stand."""
        if r not in self._sums:
            up, down = powers(r, len(self.names))
            self._sums[r] = np.concatenate([[_U(0)], np.cumsum((self.names if r == _R1 else mix(self.names + _U(1))) * up[:-1])]), down
        sums, down = self._sums[r]
        return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(_U))

    def recompress(self, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
        """(low, high) for each round: the intervals of its symbols, both in rising order."""
        sym, wall = self.names.copy(), self.sentinel
        low = np.arange(len(sym))
        high = low + 1
        size = np.ones(len(sym), np.int64)
        out = []
        for k in range(rounds):
            if len(sym) > 1:
                first = np.concatenate([[True], (sym[1:] != sym[:-1]) | wall[1:] | wall[:-1]])
                at = np.flatnonzero(first)
                last = np.append(at[1:], len(sym)) - 1
                run = last - at + 1
                sym = np.where(run > 1, mix(sym[at] + run.astype(_U) * _U(_R2)), sym[at])
                # That a run is no longer depends on the symbols beside it.
                low, high = low[np.maximum(at - 1, 0)], high[np.minimum(last + 1, len(first) - 1)]
                size, wall = np.add.reduceat(size, at), wall[at]
            side = mix(sym + _U(k + 1)) >> _U(63) == 1
            left, right = side & ~wall, ~side & ~wall
            pair = np.flatnonzero(left[:-1] & right[1:] & (size[:-1] + size[1:] <= LONGEST))
            # What a symbol depends on: a left one on its right neighbour, a right one on
            # its left; a pair on both halves.
            below = np.concatenate([low[:1], np.where(right[1:], low[:-1], low[1:])])
            above = np.concatenate([np.where(left[:-1], high[1:], high[:-1]), high[-1:]])
            below[pair] = low[pair]
            above[pair] = high[pair + 1]
            sym[pair] = mix(sym[pair] * _U(_R1) + mix(sym[pair + 1] + _U(3)))
            size[pair] += size[pair + 1]
            keep = np.ones(len(sym), bool)
            keep[pair + 1] = False
            sym, wall, size, low, high = sym[keep], wall[keep], size[keep], below[keep], above[keep]
            out.append((low, high))
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window the number of its anchor, -1 if it has none; for each symbol of
        all rounds its name and where its interval begins."""
        best, names, lows, before = np.full(len(self.start), -1, np.int64), [], [], 0
        for low, high in reversed(self.recompress()):
            open_ = np.flatnonzero(best < 0)
            if not len(open_):
                break
            start = self.start[open_]
            name = self.content(_R1, low, high)
            first = np.searchsorted(low, start, "left")
            end = np.searchsorted(high, start + WINDOW, "right")
            own = np.where(end > first, first, -1)
            for d in range(1, int((end - first).max(initial=0))):
                some = np.flatnonzero(first + d < end)
                other = first[some] + d
                better = name[other] < name[own[some]]
                own[some[better]] = other[better]
            best[open_] = np.where(own >= 0, own + before, -1)
            names.append(name)
            lows.append(low)
            before += len(name)
        return best, np.concatenate(names) if names else np.zeros(0, _U), np.concatenate(lows) if lows else np.zeros(0, np.int64)


def measure(df: DataFrame) -> DataFrame:
    """doc_id, text keys, n_words, whole_sha256 of the words, the names of the text's
    anchors (once each), those that occur in it twice, and whether it has windows without
    an anchor."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        count, loose, sha = np.zeros(n, np.int64), np.zeros(n, bool), [hashlib.sha256() for _ in range(n)]
        found = []
        for which, first, lists in stretches(utf8(batch.column(3))):
            made = Batch(lists)
            best, name, low = made.anchors()
            some = best >= 0
            used, where = np.unique(best[some], return_index=True)
            doc, part = np.array(which)[made.doc], made.doc[some][where]
            found.append((np.array(which)[part], name[used], low[used] - made.begin[part] + np.array(first)[part]))
            loose[np.unique(doc[~some])] = True
            for k, at, words in zip(which, first, lists, strict=True):
                new = words[int(count[k]) - at :] if at else words
                if new:
                    sha[k].update((b" " if count[k] else b"") + b" ".join(new))
                count[k] += len(new)
        doc, name, low = [np.concatenate(x) for x in zip(*found, strict=True)] if found else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))
        order = np.lexsort((low, name, doc))
        doc, name, low = doc[order], name[order], low[order]
        # An anchor that two stretches share stands at one place.
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (name[1:] == name[:-1]) & (low[1:] == low[:-1])]) if len(doc) else np.zeros(0, bool)
        doc, name = doc[~same], name[~same]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])]) if len(doc) else np.zeros(0, bool)
        cut = lambda d, x: pa.LargeListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int64()), pa.array(x.view(np.int64))).cast(pa.list_(pa.int64()))
        twice = np.zeros(0, np.int64) if not len(doc) else np.unique(np.cumsum(new)[~new])
        firsts = np.flatnonzero(new)[twice - 1] if len(twice) else twice
        cols = [*batch.columns[:3], pa.array(count), pa.array([h.hexdigest() for h in sha]), cut(doc[new], name[new]), cut(doc[firsts], name[firsts]), pa.array(loose)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "t1", "t2", "n_words", "whole_sha256", "anchors", "twice", "loose"])

    return arrow_map(df.select("doc_id", "t1", "t2", "text"), work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, n_words long, whole_sha256 string, anchors array<long>, twice array<long>, loose boolean", most=2 * CHUNK_BYTES)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, shared) -> windows to compare: (k1, k2, rid, pos, known), known if an
    equal one is in the same stretch; and (null, null, rid, pos, true) for the others that
    are known."""
    enter(__name__)
    for batch in slices(batches, "text", 2 * CHUNK_BYTES):
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        shared = batch.column(2)
        lengths = np.diff(shared.offsets.to_numpy())
        keys = shared.values.to_numpy(zero_copy_only=False)[shared.offsets[0].as_py() : shared.offsets[-1].as_py()].view(_U)
        # One sorted list of (document, name) for the batch; names are mixed with the document.
        tag = lambda d, x: mix(x + d.astype(_U) * _U(_R2))
        known = np.sort(tag(np.repeat(np.arange(batch.num_rows), lengths), keys))
        for which, first, lists in stretches(utf8(batch.column(1))):
            made = Batch(lists)
            best, name, _ = made.anchors()
            keep = best < 0
            some = np.flatnonzero(~keep)
            if len(known) and len(some):
                own = tag(np.array(which)[made.doc[some]], name[best[some]])
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                keep[some[known[at] == own]] = True
            start, part = made.start[keep], made.doc[keep]
            if not len(start):
                continue
            k1, k2 = made.content(_R1, start, start + WINDOW), made.content(_R2, start, start + WINDOW)
            order = np.lexsort((k2, k1))
            k1, k2, pos, part = k1[order], k2[order], (start - made.begin[part] + np.array(first)[part])[order], part[order]
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            mask = ~new
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64), mask=mask), pa.array(k2.view(np.int64), mask=mask), pa.array(rids[np.array(which)[part]]), pa.array(pos.astype(np.int32)), pa.array(many)], names=["k1", "k2", "rid", "pos", "known"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by key -> (rid, pos) of those that another one equals.  Only the row
    before is kept from batch to batch."""
    enter(__name__)
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, rid, pos = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        known = batch.column(4).to_numpy(zero_copy_only=False)
        if held is not None:
            k1, k2, rid, pos, known = [np.concatenate([[h], x]) for h, x in zip(held[:5], (k1, k2, rid, pos, known), strict=True)]
        same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        hit = np.concatenate([same, [False]]) | np.concatenate([[held[5] if held is not None else False], same]) | known.astype(bool)
        out = np.flatnonzero(hit[:-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(rid[out]), pa.array(pos[out].astype(np.int32))], names=["rid", "pos"])
        held = (k1[-1], k2[-1], rid[-1], pos[-1], known[-1], bool(hit[-1]))
    if held is not None and held[5]:
        yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int32())], names=["rid", "pos"])


def without(text: bytes, starts: np.ndarray) -> tuple[int, str, bytes]:
    """How many words the windows at ``starts`` cover, the digest of the others joined by
    blanks, and the text without them: blanks and lines beside the words that stay are as
    they were."""
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | (raw >= 9) & (raw <= 13)
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    step = np.zeros(len(begin) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = np.flatnonzero(np.diff(gone, prepend=True, append=True)).reshape(-1, 2)
    digest, out = hashlib.sha256(), []
    for k, (i, j) in enumerate(runs.tolist()):
        low, high = int(begin[i]), int(end[j - 1])
        digest.update((b" " if k else b"") + b" ".join(text[low:high].split()))
        before = 0 if i == 0 else int(end[i - 1]) if k else low
        out.append(text[before : len(text) if j == len(begin) else high])
    return int(gone.sum()), digest.hexdigest(), b"".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, positions) -> what is left of the text."""
    enter(__name__)
    for batch in slices(batches, "text", CHUNK_BYTES):
        rows = [without(text, starts.values.to_numpy(zero_copy_only=False)) for text, starts in zip(utf8(batch.column(1)), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2].decode() for r in rows], pa.string())], names=["rid", "n_removed", "kept_sha256", "kept"])


def keys_of(text: str) -> dict[str, Column]:
    """Two 64-bit keys of a text, together its name."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return {"t1": F.xxhash64(whole), "t2": F.xxhash64(F.lit(1), whole)}


def shrunk(spark: SparkSession, df: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """measure() of every row (gone if ``with_text``), and a table of (t1, t2, copies, n_removed, kept_sha256 and, if
    asked for, kept) of every text; the last three are null where no word goes."""
    docs = need(df, "doc_id", "text").withColumns(keys_of("text")).withColumn("text", F.coalesce("text", F.lit("")))
    facts = table(spark, measure(docs), "facts")
    texts = facts.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"), F.first("twice").alias("twice"), F.first("loose").alias("loose"))
    texts = table(spark, texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    if with_text:
        discard(spark, facts)
    pairs = texts.select("rid", F.explode("anchors").alias("anchor"))
    again = texts.select(F.explode("twice").alias("anchor"), F.lit(2).alias("n"))
    shared = table(spark, pairs.select("anchor", F.lit(1).alias("n")).union(again).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    lists = split_join(pairs, shared, ["anchor"], "n").groupBy("rid").agg(F.collect_list("anchor").alias("shared"))
    found = texts.select("rid", "t1", "t2", "one", "copies", "loose").join(lists, "rid", "left").where("loose or shared is not null")
    found = table(spark, found.select("rid", F.col("t1").alias("f1"), F.col("t2").alias("f2"), "one", "copies", F.coalesce("shared", F.array().cast("array<long>")).alias("shared")), "shared")
    discard(spark, shared)
    # By doc_id too, so that the copies of a text don't meet in one task.
    mine = docs.join(found, (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")) & F.col("doc_id").eqNullSafe(F.col("one")))
    mine = table(spark, mine.select("rid", "text", "shared", "copies"), "candidates")
    discard(spark, found)
    windows = table(spark, mine.select("rid", "text", "shared").mapInArrow(_candidates, "k1 long, k2 long, rid long, pos int, known boolean"), "windows")
    open_ = windows.where("k1 is not null").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    hits = open_.mapInArrow(_repeats, "rid long, pos int").union(windows.where("k1 is null").select("rid", "pos"))
    starts = hits.groupBy("rid").agg(F.collect_list("pos").alias("positions"))
    once = mine.where("copies = 1").select("rid", "text").join(starts, "rid")
    left = once.select("rid", "text", "positions").mapInArrow(_cut, "rid long, n_removed long, kept_sha256 string, kept string")
    left = left if with_text else left.drop("kept")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    more = {"n_removed": F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")), "kept_sha256": F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256"))}
    if with_text:
        more["kept"] = F.when(whole, F.lit("")).otherwise(F.col("kept"))
    done = texts.select("t1", "t2", "copies", "n_words", "rid").join(left, "rid", "left").withColumns(more).drop("rid", "n_words")
    done = table(spark, done, "left")
    discard(spark, texts, mine, windows)
    return facts, done


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    facts, done = shrunk(spark, df, False)
    joined = split_join(facts.select("doc_id", "t1", "t2", "n_words", "whole_sha256"), done, ["t1", "t2"], "copies")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def trim(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows with repeated words taken out of ``text``; the blanks and lines beside other
    words stay, and texts that lose no word stay as they are."""
    _, done = shrunk(spark, df, True)
    names = {n: free(df, n) for n in ("t1", "t2", "kept")}
    cut = done.where("kept is not null").select(*[F.col(k).alias(v) for k, v in names.items()], "copies")
    joined = split_join(df.withColumns({names[k]: c for k, c in keys_of("text").items()}), cut.withColumnRenamed("copies", free(df, "copies")), [names["t1"], names["t2"]], free(df, "copies"), "left")
    return joined.select(*[F.coalesce(names["kept"], "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in df.columns])
