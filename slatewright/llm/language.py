"""Operator 10: language identification by string kernels.

A text's letters, in lower case with one blank between words, give the set of its
n-grams of one to ORDERS letters (a blended spectrum; presence, not counts).  The kernel
of two texts is the mean over n of the cosine of their n-gram sets.  A bounded sample of
labelled rows is drawn by a hash; LANDMARKS of its texts span a Nyström feature space, in
which one-versus-rest kernel ridge regression is solved.  As the kernel is a sum of inner
products, landmarks and coefficients fold into one matrix per order, with a row for each
n-gram of a landmark; scoring is a batched product of n-gram presence with these matrices.
That is the kernel itself: an n-gram that no landmark has adds nothing to an inner product,
and norms count all n-grams of a text.  A softmax whose temperature is fitted on sample
rows kept apart turns values into a score.

Only rows with a language, a doc_id and crc32(doc_id) mod 3 other than 1 are ever learned
from: of each of the LANGUAGES most frequent languages (ties by name) at most SAMPLE ids, one
row an id, whose texts have LONGEST characters at most, and TOTAL rows in all.

A null text or one without a letter is ``und`` with score 0, as is every text when
there is nothing to learn from.  Very long texts are read whole.  Ties go to the alphabetically
first language.  Repeated rows give equal rows; an empty table gives an empty table; extra
columns are ignored by ``report`` and kept by ``identify``, which replaces columns that have
the names of its own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, need

ORDERS = 4
#: Rows learned from for each language and in all, languages, characters of a text that is
#: learned from, landmarks in all.
SAMPLE, TOTAL, LANGUAGES, LONGEST, LANDMARKS = 400, 20_000, 256, 50_000, 240
RIDGE = 1e-2
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer("".join("1" if chr(i).isalpha() else "0" for i in range(0x110000)).encode(), np.uint8) == 49


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters, lower case, a blank (0) around each word."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = _letters()[points]
    if not good.any():
        return np.zeros(0, np.uint32)
    out = np.where(good, points, np.uint32(0))
    keep = good | np.concatenate([[False], good[:-1]])
    out = out[keep]
    return np.concatenate([[np.uint32(0)], out, np.zeros(int(out[-1] != 0), np.uint32)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each n-gram in turn."""
    if len(points) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
    return _mix(out + np.uint64(n))


def gram_set(points: np.ndarray, n: int, step: int = 1 << 20) -> np.ndarray:
    """The distinct n-grams of a text, a stretch at a time."""
    parts = [np.unique(grams(points[i : i + step + n - 1], n)) for i in range(0, max(1, len(points) - n + 1), step)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def sets(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram sets of texts one after another, and the size of each."""
    made = [gram_set(p, n) for p in texts]
    return np.concatenate(made) if made else np.zeros(0, np.uint64), np.array([len(x) for x in made], np.int64)


class Numbers:
    """Numbers of known names, exactly: a table by the upper bits of a name, one by its lower
    bits for those whose place is taken, and a sorted list for what is left."""

    def __init__(self, names: np.ndarray):
        bits = max(10, int(len(names)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.tables = []
        left = np.arange(len(names))
        for k in range(2):
            at = self._place(names[left], k)
            places, first = np.unique(at, return_index=True)
            number = np.full(1 << bits, -1, np.int64)
            number[places] = left[first]
            name = np.zeros(1 << bits, np.uint64)
            name[places] = names[left[first]]
            self.tables.append((name, number))
            left = np.delete(left, first)
        order = left[np.argsort(names[left])]
        self.rest, self.rest_number = names[order], order

    def _place(self, names: np.ndarray, k: int) -> np.ndarray:
        return (names & self.mask if k else names >> self.shift).astype(np.int64)

    def of(self, names: np.ndarray) -> np.ndarray:
        """A number for each name, -1 for the unknown."""
        out = np.full(len(names), -1, np.int64)
        for k, (name, number) in enumerate(self.tables):
            at = self._place(names, k)
            hit = (name[at] == names) & (number[at] >= 0)
            out[hit] = number[at[hit]]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, names), len(self.rest) - 1)
            hit = self.rest[at] == names
            out[hit] = self.rest_number[at[hit]]
        return out


class Model:
    """Landmarks, their coefficients, and both folded into a matrix for each order."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.known: list[Numbers] = []
        self.folded: list[np.ndarray] = []
        self.landmarks: list[np.ndarray] = []
        self.coefficients = np.zeros((0, len(labels)))
        self.temperature = 1.0

    def fold(self, landmarks: list[np.ndarray], coefficients: np.ndarray) -> None:
        """A row of a matrix is what its n-gram adds: the coefficients of the landmarks that
        have it, each over that landmark's norm."""
        self.landmarks, self.coefficients = landmarks, coefficients
        for n in range(1, ORDERS + 1):
            names, sizes = sets(landmarks, n)
            distinct, at = np.unique(names, return_inverse=True)
            part = (coefficients / np.sqrt(np.maximum(sizes, 1))[:, None])[np.repeat(np.arange(len(sizes)), sizes)]
            out = np.zeros((len(distinct), len(self.labels)))
            np.add.at(out, at, part)
            self.known.append(Numbers(distinct))
            self.folded.append((out / ORDERS).astype(np.float32))

    def values(self, texts: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest values, a row for each text: presence of the known n-grams that
        the texts have, times the rows of these."""
        out = np.zeros((len(texts), len(self.labels)))
        for n in range(1, ORDERS + 1):
            names, sizes = sets(texts, n)
            number = self.known[n - 1].of(names)
            row = np.repeat(np.arange(len(texts)), sizes)[number >= 0]
            used, column = np.unique(number[number >= 0], return_inverse=True)
            presence = np.zeros((len(texts), len(used)), np.float32)
            presence[row, column] = 1
            out += presence @ self.folded[n - 1][used] / np.sqrt(np.maximum(sizes, 1))[:, None]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        z = values / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return names, scores
        for i in range(0, len(texts), 64):
            made = [(k, p) for k, p in enumerate(map(letters, texts[i : i + 64]), i) if len(p)]
            if made:
                p = self.probabilities(self.values([x for _, x in made]))
                for (k, _), row in zip(made, p, strict=True):
                    best = int(row.argmax())
                    names[k], scores[k] = self.labels[best], float(row[best])
        return names, scores


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The blended-spectrum presence kernel of two lists of texts."""
    out = np.zeros((len(a), len(b)))
    for n in range(1, ORDERS + 1):
        (xa, na), (xb, nb) = sets(a, n), sets(b, n)
        distinct, at = np.unique(xb, return_inverse=True)
        two = np.zeros((len(b), len(distinct)), np.float32)
        two[np.repeat(np.arange(len(b)), nb), at] = 1
        known, ends = Numbers(distinct), np.cumsum(na)
        for i in range(0, len(a), 64):  # a batch of rows bounds the presence matrix
            lo, hi = ends[i] - na[i], ends[min(i + 64, len(a)) - 1]
            number = known.of(xa[lo:hi])
            row = np.repeat(np.arange(len(na[i : i + 64])), na[i : i + 64])
            one = np.zeros((len(na[i : i + 64]), len(distinct)), np.float32)
            one[row[number >= 0], number[number >= 0]] = 1
            out[i : i + 64] += one @ two.T / np.sqrt(np.maximum(na[i : i + 64, None] * nb, 1))
    return out / ORDERS


def train(texts: list[str], langs: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    points = [letters(t) for t in texts]
    rows = [i for i, p in enumerate(points) if len(p)]
    model = Model(sorted({langs[i] for i in rows}))
    if not rows:
        return model
    points, y = [points[i] for i in rows], np.array([model.labels.index(langs[i]) for i in rows])
    held = np.arange(len(points)) % 5 == 4 if len(points) >= 50 else np.zeros(len(points), bool)
    fit = np.flatnonzero(~held)
    # Landmarks: each language's rows in turn, so that rare ones are spanned too.
    place = np.zeros(len(fit), np.int64)
    for c in range(len(model.labels)):
        of = np.flatnonzero(y[fit] == c)
        place[of] = np.arange(len(of))
    marks = [points[i] for i in fit[np.lexsort((y[fit], place))][:landmarks]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel([points[i] for i in fit], marks) @ root
    target = np.where(y[fit][:, None] == np.arange(len(model.labels)), 1.0, -1.0)
    weight = np.linalg.solve(phi.T @ phi + ridge * len(fit) * np.eye(phi.shape[1]) / 100, phi.T @ target)
    model.fold(marks, root @ weight)
    if held.any():
        v = np.concatenate([model.values([points[i] for i in part]) for part in np.array_split(np.flatnonzero(held), -(-held.sum() // 64))])
        t = y[held]
        loss = {}
        for temperature in 2.0 ** np.arange(-5, 3, 0.25):
            model.temperature = float(temperature)
            loss[temperature] = -np.log(np.maximum(model.probabilities(v)[np.arange(len(t)), t], 1e-9)).mean()
        model.temperature = float(min(loss, key=loss.get))
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learn(spark: SparkSession, df: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from the ids of each language that come first by a hash of doc_id, one row of
    each (of rows that share an id and a lang the least text).  Counts of ids cut the hash's
    range, so that few more rows than are learned from are ever sorted or sent."""
    open_ = need(df, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= LONGEST) & (remainder(F.col("doc_id")) != 1))
    open_ = open_.withColumn("place", F.xxhash64(F.col("doc_id").cast("string")) / float(1 << 64) + 0.5)
    found = open_.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).orderBy(F.desc("ids"), "lang").limit(LANGUAGES).collect()  # LANGUAGES rows
    if not found:
        return Model([])
    each = min(sample, TOTAL // len(found))
    # Twice the share that is wanted, and a few: fewer than wanted come once in an age.
    cut = spark.createDataFrame([(r["lang"], min(1.0, (2 * each + 40) / max(r["ids"], 1))) for r in found], "lang string, cut double")
    few = open_.join(F.broadcast(cut), "lang").where("place <= cut").groupBy("doc_id", "lang", "place").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    rows = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("doc_id", "lang", "text").collect()  # TOTAL rows of LONGEST characters
    rows.sort(key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def lettered(text: str) -> Column:
    """Whether a text holds a letter, by the same rule as ``letters``."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(spark: SparkSession, df: DataFrame, *, model: Model | None = None) -> DataFrame:
    """The rows with lang_pred and lang_score; columns of these names are replaced."""
    shared = spark.sparkContext.broadcast(model or learn(spark, df))
    df = df.drop("lang_pred", "lang_score")
    names = df.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = shared.value.predict(batch.column(names.index("text")).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64())], names=[*names, "lang_pred", "lang_score"])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return arrow_map(df, work, schema)


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    source = need(df, "doc_id", "text", "lang")
    made = identify(spark, source.select("doc_id", "text"), model=learn(spark, source))
    return made.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
