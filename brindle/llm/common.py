"""Shared parts of the training-data operators: stored tables, word hashing over Arrow buffers.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``
(shared by the driver and all executors), so a lost executor loses nothing that was cut.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS_CLASS = r"[\x20\x09-\x0D]"
_made: list[tuple[SparkSession, Workspace]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session. A local one of our own only where none is set and driver and tasks are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not one_process(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="brindle-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def one_process(spark: SparkSession) -> bool:
    """Whether the driver runs the tasks itself."""
    return bool(re.match(r"local(\[|$)", spark.sparkContext.master))


@contextmanager
def conf(spark: SparkSession, **values):
    """Session settings for the time of one action."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files of a finished write are of no more use: the table is the cut in the lineage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Whole texts go to Python in batches of bounded bytes, however long they are: Spark's own 64 MB would stand beside the heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_batch_before: dict[int, tuple[SparkSession, str]] = {}


#: The driver's heap may take this share of its limit before garbage is collected; seconds between looks, and after a collection.
HEAP_SHARE, HEAP_LOOK, HEAP_REST = 0.45, 1.0, 10.0
_watches: dict[str, HeapWatch] = {}


class HeapWatch(threading.Thread):
    """Collects the garbage of the driver's JVM whenever its heap has grown beyond a share of the limit.

    Plans, events of tasks, broadcasts and shuffles of tables that are written are garbage. Left alone the heap grows to its limit
    over a long call before most of it is collected, and the threads, buffers and code of the JVM take as much again beside
    it. A full collection gives the free heap back to the system, and lets Spark's cleaner remove what is out of use."""

    def __init__(self, spark: SparkSession):
        super().__init__(name="heap-watch", daemon=True)
        self.spark, self.ended = spark, threading.Event()

    def run(self) -> None:
        try:
            system, heap = self.spark._jvm.java.lang.System, self.spark._jvm.java.lang.Runtime.getRuntime()
            while not self.ended.wait(HEAP_LOOK):
                if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
                    system.gc()
                    self.ended.wait(HEAP_REST)
        except Exception:  # the session is gone
            pass


def watch_heap(spark: SparkSession) -> None:
    """One watch a session, until ``clean``. None where tasks share the driver's heap."""
    key = spark.sparkContext.applicationId
    if not one_process(spark) and not (key in _watches and _watches[key].is_alive()):
        _watches[key] = HeapWatch(spark)
        _watches[key].start()


class Workspace:
    """Tables of one operator call in the shared folder. ``drop`` removes those that a later one replaces."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.id = f"{label}_{uuid.uuid4().hex[:12]}"
        self.path = f"{checkpoint_root(spark)}/{self.id}"
        # Results are read after the call, so the setting holds until ``clean``.
        if id(spark) not in _batch_before:
            _batch_before[id(spark)] = (spark, spark.conf.get(BATCH))
            spark.conf.set(BATCH, BATCH_BYTES)
        watch_heap(spark)
        self.tables: list[str] = []
        _made.append((spark, self))

    def put(self, df: DataFrame, name: str, bucket: tuple[int, str] | None = None, partition: str | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            writer = df.write.option("compression", "zstd")
            if partition:
                writer = writer.partitionBy(partition)
            if bucket:
                table = f"{self.id}_{name}"
                self.tables.append(table)
                writer.bucketBy(bucket[0], bucket[1]).option("path", path).saveAsTable(table)
                return self.spark.table(table)
            writer.parquet(path)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.id}_{name}")
            remove(self.spark, f"{self.path}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clean() -> None:
    """Removes the tables of all operator calls so far (results that were not written yet are lost), also from the catalog, and
    restores the session's settings. Runs at exit."""
    for watch in _watches.values():
        watch.ended.set()
    _watches.clear()
    done, _made[:] = list(_made), []
    for spark, ws in done:
        try:
            for table in ws.tables:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, ws.path)
        except Exception:  # the session may be gone: a local folder goes anyway, a shared one with the cluster's own clean-up
            if ws.path.startswith("file:"):
                shutil.rmtree(ws.path.removeprefix("file://"), ignore_errors=True)
    for spark, before in _batch_before.values():
        try:
            spark.conf.set(BATCH, before)
        except Exception:  # as above
            pass
    _batch_before.clear()


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: classes with more than this share of all rows are at most so many, so they may be broadcast
HEAVY = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left join classes (one row a key, with its number of rows n). The rows of a class that holds more than a
    thousandth of all ``total`` rows stay where they are: there are under a thousand such classes, which are broadcast."""
    most = max(total // HEAVY, 1)
    heavy, light = classes.where(F.col(n) > most), classes.where(F.col(n) <= most)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return rows.join(F.broadcast(heavy), key).unionByName(others.select(*rows.columns, *(c for c in classes.columns if c != key)))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id (long) and text (null: empty); rows without an id can't be named in a result and are left out."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return d.where(F.col("doc_id").isNotNull())


def volume(texts: DataFrame) -> int:
    """About how many bytes of text there are, for the number of partitions: twice what the optimiser knows of the files, as
    these are compressed; where it knows nothing, a small aggregate."""
    known = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 52:
        return 2 * known
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def n_partitions(spark: SparkSession, n_bytes: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each), 1)


def levels(total: int, each: int, fan_out: int) -> list[int]:
    """Bits of the ranges after each level of an exchange: fan_out more each time, in the end at most ``each`` rows a range."""
    last = max(0, (-(-total // each) - 1).bit_length())
    return [*range(fan_out, last, fan_out), last] if last else [0]


def salted(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", n: int = 16) -> DataFrame:
    """A join whose left side may hold a key very often: its rows are dealt by ``by`` over n copies of the right side's row."""
    salt = fresh("salt", left, right)
    parts = left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    return parts.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), [*keys, salt], how).drop(salt)


# ------------------------------------------------------------------ word hashing
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C13 | 3
_INV = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xC2B2AE3D27D4EB4F


def _table() -> np.ndarray:
    return np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


T_EXACT = _table()
T_LOWER = T_EXACT.copy()
T_LOWER[65:91] = T_EXACT[97:123]
_pows: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base & _M, dtype=np.uint64)
        steps[0] = 1
        have = _pows[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


IS_WS = np.zeros(256, dtype=bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = T_EXACT, breaks: np.ndarray = IS_WS):
    """Words of documents that stand one after another in ``data`` (UTF-8), document d in bounds[d]:bounds[d+1].

    Returns (hash, start, end, first): hash of each word, its bytes, and for each document the number of words before it.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), z, z, np.zeros(len(bounds), dtype=np.int64)
    inside = ~breaks[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = np.zeros(n, dtype=bool)
    end[:-1] = inside[:-1] & (~inside[1:] | edge[1:n])
    end[-1] = inside[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * powers(_BASE, n), out=sums[1:])
    h = mix((sums[e] - sums[s]) * powers(_INV, n)[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, bounds)


def word_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of words of each document, by the same rule as ``words``."""
    inside = ~IS_WS[data]
    start = inside.copy()
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    start[1:] &= ~inside[:-1] | edge[1 : len(data)]
    before = np.concatenate([[0], np.cumsum(start)])
    return np.diff(before[bounds])


def ngrams(h: np.ndarray, first: np.ndarray, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows within a document, and the word number at which each starts."""
    count = np.diff(first) - n + 1
    if len(h) < n or not (count > 0).any():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    ok = np.maximum(count, 0)
    at = np.repeat(first[:-1], ok) + ranges(ok)
    base = _BASE2 if second else _BASE
    if n <= 8:
        g = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            g *= np.uint64(base)
            g += h[at + k]
        return mix(g), at
    sums = np.empty(len(h) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((mix(h ^ np.uint64(0x5851F42D4C957F2D)) if second else h) * powers(base, len(h)), out=sums[1:])
    return mix((sums[at + n] - sums[at]) * powers(pow(base, -1, 1 << 64), len(h))[at]), at


def spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal numbers, none under 0."""
    cut = np.flatnonzero(np.diff(keys, prepend=-1))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(keys)][: len(cut)], strict=True))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string or binary array without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def slices(bounds: np.ndarray, most: int):
    """Runs of documents (i, j) whose bytes stay under ``most``, one document at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def binary_array(parts: list[np.ndarray | bytes]):
    import pyarrow as pa

    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], type=pa.binary())
