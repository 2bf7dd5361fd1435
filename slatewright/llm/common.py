"""Helpers shared by the training-data operators: Arrow batches, working tables,
document columns and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at a time, whatever the Arrow batch.
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def need(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns.  Extra columns of the input never reach an operator,
    so their names cannot clash with those it makes."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named string column has about ``most`` bytes in each
    piece; one longer text is a piece of its own and is never cut."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        size = col.nbytes
        if size <= most or batch.num_rows == 1:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


#: How modules give up what they keep in a Python worker from task to task.
_keeping: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def keeps(module: str, forget: Callable[[], None]) -> None:
    """``forget`` empties what ``module`` keeps; see ``enter``."""
    _keeping[module] = forget


def enter(module: str) -> None:
    """At the start of a task of an operator's module, in a Python worker.  Spark gives a worker
    tasks of one stage after another, so where the last task was another module's, what others
    keep (words, vocabularies, templates) goes, and its memory goes back to the system."""
    if _last == [module]:
        return
    _last[:] = [module]
    for other, forget in _keeping.items():
        if other != module:
            forget()
    gc.collect()
    give_back()


def give_back() -> None:
    """Memory that nothing uses goes from Arrow's pool and the C library to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over pieces bounded by bytes of ``column``."""
    module = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(module)
        for piece in slices(batches, column, most):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out
        out = piece = None  # the last ones go too
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's default of 64: rows of text
    pass through buffers of the JVM and of Python, several at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") in ("67108864", "64m"):
        spark.conf.set(name, "8m")


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.  Where it is
    unset a temporary folder takes its place if executors are threads of this process
    (tests, a laptop); on a cluster, whose machines share no such folder, it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.slatewright.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder they share")
        found = tempfile.mkdtemp(prefix="slatewright-")
        spark.conf.set("spark.slatewright.scratch", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting that removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables that are there, in order of writing.
_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the rows
    survive the loss of any executor, and each is computed once.  Removed by ``discard``
    or ``release``, at exit at the latest.  Shuffle files of the write go with its end,
    since nothing reads them again."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/slatewright/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    if not _written:
        atexit.register(release, spark, 0)
    _written.append(path)
    shrink(spark)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables that no later plan reads."""
    for df in frames:
        path = _paths.pop(df)
        _written.remove(path)
        _remove(spark, path)


def mark() -> int:
    """How many tables there are; see ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, *but: DataFrame) -> None:
    """Remove the tables written since a mark, but for those named.  Spark frees the shuffle
    files of ended queries when the driver's JVM has collected their plans; it does so now."""
    kept = {_paths[df] for df in but}
    for path in _written[since:]:
        if path not in kept:
            _written.remove(path)
            _remove(spark, path)
    if spark.sparkContext._jsc is not None:
        _collect(spark)


#: Share of its limit beyond which the driver's heap is collected, and by how much it must
#: have grown since that was done last.
HEAP, GROWN = 0.4, 1.1
_left = [0]


def shrink(spark: SparkSession) -> None:
    """Plans, metrics and task results of ended queries make the driver's heap grow to its limit,
    beside all that the JVM and Python hold outside of it, though little of it is in use.
    Where it has grown, a full collection gives what is free back to the system."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > max(HEAP * heap.maxMemory(), GROWN * _left[0]):
        _collect(spark)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    _left[0] = jvm.java.lang.Runtime.getRuntime().totalMemory()
    give_back()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before this process: nothing to remove it with
        return


#: Rows of ids that are sent to every task instead of shuffling what they are looked up in.
FEW = 1_000_000


def pick_rows(left: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``left`` rows that are (left_semi) or are not (left_anti) among ``ids``, a written
    table: broadcast up to FEW ids, which is counted first, and shuffled beyond that."""
    return left.join(F.broadcast(ids) if ids.count() <= FEW else ids, key, how)


#: Rows of one key that a task may meet; keys with more at most.
LEAST_HOT, MOST_HOT = 1000, 50_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, a written table whose ``weight`` is how many rows of
    ``left`` have its key, so that no key's rows meet in one task.  Keys of much weight are
    broadcast: weights add up to a known total, so at most MOST_HOT keys exceed the total
    over MOST_HOT.  The others are shuffled as ever."""
    facts = right.agg(F.sum(weight), F.max(weight)).first()
    bound = max(LEAST_HOT, (facts[0] or 0) // MOST_HOT)
    if (facts[1] or 0) <= bound:
        return left.join(right.drop(weight), keys, how)
    hot = right.where(F.col(weight) > bound).drop(weight)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(right.where(F.col(weight) <= bound).drop(weight), keys, how))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) by alternating large-star and
    small-star.  Returns (node, root) for every node of an edge, root the smallest
    node of its component.

    Each step is two hash exchanges whose sums are combined before the shuffle; a node
    with very many edges is only ever a join key, never a list, and its edges don't meet in
    one task (``split_join``).  Every round is written to the shared folder, which cuts the
    lineage; the round before is removed."""
    now = table(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if is_empty(now):
        return spark.createDataFrame([], "node long, root long")
    before = _state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = split_join(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(spark, large, "large")
        # After the large star a node has edges to smaller nodes only, and no hub is a key.
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        made = table(spark, small.union(own.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(spark, now, least, large)
        now = made
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def hex_lower(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
