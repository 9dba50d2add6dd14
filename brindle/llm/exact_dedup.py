"""Exact dedup by a log-structured merge index over text digests.

Memtables (one per task, bounded in rows) flush sorted digest runs, each cut into ranges of the digest and with a Bloom
filter for each. Compaction goes by levels of a fixed fan-out: a level merges the pieces of a bounded number of runs
within one range and cuts the merged run into finer ranges for the next, until a range's runs are all in one place. So
pieces grow with the rows, not with runs times ranges. Two runs are merged pairwise: keys that the larger one's filter
rules out are passed on without a search, found ones are folded into one entry with the smallest identifier. The
members of every class with more than one row (the hits) are then compared with the row that stays, byte by byte.

Defined cases: null text counts as empty; rows without an id are left out; rows that repeat an id with equal text
are members of the class like any others (the class size counts them) and, as the smallest id, stay together;
an empty table gives an empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, conf, id_text, join_classes, levels, spans

MEMTABLE_ROWS = 200_000
BLOOM_BITS = 10
CHUNK = 256
#: log2 of the ranges into which a run is cut, at most
FAN_OUT = 6
RUN = "range long, run long, keys binary, ids binary, counts binary, bloom binary"


def normalised(text):
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


# ------------------------------------------------------------------ runs
def bloom(keys: np.ndarray) -> np.ndarray:
    """Bits of a filter over 16-byte keys: three probes, a power of two of bits."""
    n = 1 << max(6, (len(keys) * BLOOM_BITS - 1).bit_length())
    bits = np.zeros(n, dtype=bool)
    for p in _probes(keys, n):
        bits[p] = True
    return bits


def _probes(keys: np.ndarray, n: int):
    half = keys.reshape(-1).view(">u8").reshape(-1, 2).astype(np.uint64)
    a, b = half[:, 0] ^ (half[:, 1] >> np.uint64(7)), half[:, 1] | np.uint64(1)
    return [((a + np.uint64(k) * b) & np.uint64(n - 1)).astype(np.int64) for k in range(3)]


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for p in _probes(keys, len(bits)):
        out &= bits[p]
    return out


def fold(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """A sorted run with one entry for each key: smallest id, sum of counts."""
    flat = keys.reshape(-1).view(">u8").reshape(-1, 2)
    order = np.lexsort((ids, flat[:, 1], flat[:, 0]))
    keys, ids, counts, flat = keys[order], ids[order], counts[order], flat[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return keys[at], ids[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def merge(a, b):
    """Two sorted runs into one. The larger one's filter tells which keys of the other can be common at all."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    maybe = may_hold(a[3], b[0])
    sure = ~maybe
    both = fold(*(np.concatenate([x, y[maybe]]) for x, y in zip(a[:3], b[:3], strict=True)))
    run = [np.concatenate([x, y[sure]]) for x, y in zip(both, b[:3], strict=True)]
    order = np.lexsort(tuple(run[0].reshape(-1).view(">u8").reshape(-1, 2).T[::-1]))
    run = [x[order] for x in run]
    return (*run, bloom(run[0]))


def _lead(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of each key."""
    lead = keys[:, :8].reshape(-1).view(">u8").astype(np.uint64)
    return (lead >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _cut(run, bits: int, number: int):
    """A sorted run's pieces by ranges of the first bits, as rows."""
    import pyarrow as pa

    keys, ids, counts = run[:3]
    of = _lead(keys, bits)
    rows = [(int(of[i]), number, keys[i:j].tobytes(), ids[i:j].tobytes(), counts[i:j].tobytes(), np.packbits(bloom(keys[i:j])).tobytes()) for i, j in spans(of)]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["range", "run", "keys", "ids", "counts", "bloom"])


def _flush(bits: int, memtable_rows: int):
    def run(batches):
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            keys = np.frombuffer(b"".join(k for b in held for k in b.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 16)
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
            return _cut(fold(keys, ids, np.ones(len(ids), dtype=np.int64)), bits, number)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= memtable_rows:
                yield flush()
                number, held, rows = number + 1, [], 0
        if rows:
            yield flush()

    return run


def _merged(table):
    level = []
    for keys, ids, counts, bits in zip(*(table.column(c).to_pylist() for c in ("keys", "ids", "counts", "bloom")), strict=True):
        level.append((np.frombuffer(keys, dtype=np.uint8).reshape(-1, 16), np.frombuffer(ids, dtype=np.int64), np.frombuffer(counts, dtype=np.int64), np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)))
    level.sort(key=lambda r: len(r[0]))
    while len(level) > 1:
        level = [merge(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _compact(bits: int):
    def run(key, table):
        import pyarrow as pa

        return pa.Table.from_batches([_cut(_merged(table), bits, key[1].as_py())])

    return run


def _settle(key, table):
    import pyarrow as pa

    keys, ids, counts, _ = _merged(table)
    hit = counts > 1
    return pa.table({"key": pa.array([k.tobytes() for k in keys[hit]], pa.binary()), "keep_id": pa.array(ids[hit], pa.int64()), "n": pa.array(counts[hit], pa.int64())})


def index_runs(digests: DataFrame, ws: Workspace, total: int, memtable_rows: int = MEMTABLE_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """(key, keep_id, n) of all keys that occur more than once. digests: doc_id, key."""
    bits = levels(total, memtable_rows, fan_out)
    runs = digests.select("doc_id", "key").mapInArrow(_flush(bits[0], memtable_rows), RUN)
    for k, (now, then) in enumerate(zip(bits, bits[1:], strict=False)):
        # Runs of one range that meet: so many that a merged run again has about a memtable's rows.
        batch = F.pmod(F.xxhash64("run"), F.lit(1 << (bits[-1] - now)))
        runs = ws.put(runs.groupBy("range", batch.alias("batch")).applyInArrow(_compact(then), RUN), f"level{k}")
    return ws.put(runs.groupBy("range").applyInArrow(_settle, "key binary, keep_id long, n long"), "hits")


# ------------------------------------------------------------------ the operator
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 128, memtable_rows: int = MEMTABLE_ROWS, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    digest_bits: of the index's keys; fewer only make collisions likelier, which byte verification then parts.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    texts = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    sha = F.sha2("norm", 256)
    key = F.unhex(F.rpad(F.substring("sha", 1, digest_bits // 4), 32, "0"))
    digests = ws.put(texts.select("doc_id", sha.alias("sha")), "digests").select("doc_id", "sha", key.alias("key"))
    total = digests.count()
    hits = index_runs(digests, ws, total, memtable_rows, fan_out)
    classes = join_classes(digests, hits, "key", "n", total)
    members = classes.where("n > 1").select("doc_id", "sha", "key", "keep_id", "n")
    with conf(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0b"):
        wanted = members.select("doc_id", "sha", "key", "keep_id", "n").dropDuplicates(["doc_id", "sha"])
        found = ws.put(texts.withColumn("sha", sha).join(wanted, ["doc_id", "sha"]), "members")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = found.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int"))
    stay = found.where("doc_id = keep_id").dropDuplicates(["key"]).select("key", F.col("norm").alias("norm_kept"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    same = F.col("norm") == F.col("norm_kept")
    verified = ws.put(rows.join(stay, ["key", "chunk"]).where(~same).select("doc_id", "sha", "key", "norm"), "unequal")
    ws.drop("members")
    out = classes.select("doc_id", "sha", "key", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))
    if verified.head(1):
        own = verified.groupBy("key", "sha", "norm").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_n")).drop("norm")
        lost = verified.groupBy("key").agg(F.count(F.lit(1)).alias("lost"))
        out = out.join(own, ["key", "sha"], "left").join(lost, "key", "left").select("doc_id", "sha", F.coalesce("own_id", "keep_id").alias("keep_id"), F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
