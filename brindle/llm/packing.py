"""Best-fit packing with bound-certified repacking.

Each partition packs its pieces best-fit decreasing and computes a lower bound on its number of sequences from
dual-feasible functions (the volume, the family u^(k), and the threshold family of Martello and Toth). A partition whose
number meets its bound is certified: none of its pieces moves again. Of a partition with a gap the full sequences stay,
and the pieces of the others are exchanged: dealt anew to fewer partitions, with those of other partitions, and packed
again. Rounds end when all partitions are certified, when one partition holds all that is left, or when a round saves
no sequence; a round that needs more sequences than its pieces had before is undone.

Defined cases: null or empty text is a document of the end id alone; rows without an id are left out; rows that
repeat an id are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, id_text
from .tokens import batches_of, default_path, encoder

PIECES_IN_PARTITION = 60_000
PIECES = "uid long, doc_id long, piece int, start long, length long, {last}"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int, crc32: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in batches_of(texts):
                ids, bounds = encoder(path).encode(texts[i:j])
                rows = []
                for doc, x, y in zip(docs[i:j], bounds, bounds[1:], strict=False):
                    own = np.append(ids[x:y], end_id).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        raw = own[s : s + n].tobytes()
                        rows.append((uid, doc, k, s, n, zlib.crc32(raw) if crc32 else raw))
                        uid += 1
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if crc32 else pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32" if crc32 else "ids"])

    return run


# ------------------------------------------------------------------ bounds and packing
def lower_bound(histogram: np.ndarray) -> int:
    """No packing of histogram[s] pieces of size s into sequences of len(histogram) - 1 needs fewer."""
    c = len(histogram) - 1
    h, s = histogram.astype(np.int64), np.arange(c + 1, dtype=np.int64)
    n = int(h.sum())
    if not n:
        return 0
    best = -(-int((h * s).sum()) // c)
    for k in range(1, 101):  # u^(k): x if (k + 1) x is whole, else floor((k + 1) x) / k
        a = (k + 1) * s
        u = np.where(a % c == 0, s * k, (a // c) * c)
        best = max(best, -(-int((h * u).sum()) // (c * k)))
    count, volume = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * s)])
    for t in range(c // 2 + 1):  # over c - t: alone; up to c / 2 and at least t: they fill what the middle ones leave
        large, middle = count[c + 1] - count[c - t + 1], count[c - t + 1] - count[c // 2 + 1]
        left = middle * c - (volume[c - t + 1] - volume[c // 2 + 1])
        small = volume[c // 2 + 1] - volume[t]
        best = max(best, int(large + middle + max(0, -(-(small - left) // c))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the load of each bin. Fullest bin with room first; found by one bit a load."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    loads: list[int] = []
    open_: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with room r is open
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = at, loads[at]
        loads[at] += size
        room -= size
        if room:
            open_.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins, offsets, np.array(loads, dtype=np.int64)


def _pack(capacity: int, round_: int):
    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("uid")
        sizes = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, loads = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1))
        base = (round_ << 52) | (key[0].as_py() << 26)
        same = lambda x: pa.array(np.full(len(sizes), x, dtype=np.int64))
        for name, column in (("sequence_id", pa.array(base + bins)), ("offset", pa.array(offsets)), ("load", pa.array(loads[bins])), ("bins", same(len(loads))), ("bound", same(bound))):
            table = table.append_column(name, column)
        return table.drop_columns(["grp"])

    return run


def pack(pieces: DataFrame, capacity: int, per_partition: int = PIECES_IN_PARTITION) -> DataFrame:
    """Adds sequence_id, offset, and of the partition that packed it last: bins, bound (bins = bound: certified)."""
    spark = pieces.sparkSession
    ws = Workspace(spark, "pack")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, load long, bins long, bound long"
    pool, left, before, done, last, k = pieces, pieces.count(), None, [], None, 0
    open_ = (F.col("load") < capacity) & (F.col("bins") > F.col("bound"))
    while True:
        groups = max(1, -(-left // per_partition))
        deal = F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(groups)).cast("long")
        packed = ws.put(pool.withColumn("grp", deal).groupBy("grp").applyInArrow(_pack(capacity, k), schema), f"round{k}")
        n = packed.select(F.count_distinct("sequence_id").alias("bins"), F.count(F.when(open_, 1)).alias("open"), F.count_distinct(F.when(open_, F.col("sequence_id"))).alias("open_bins")).first()
        if before is not None and n["bins"] > before:
            done.append(last)
            break
        if groups == 1 or not n["open"] or n["bins"] == before:
            done.append(packed)
            break
        done.append(packed.where(~open_))
        last, before, left, k = packed.where(open_), n["open_bins"], n["open"], k + 1
        pool = last.select(*pieces.columns)
    return reduce(DataFrame.unionByName, done).drop("load")


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", crc32: bool = False, per_partition: int = PIECES_IN_PARTITION) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (or ids_crc32), sequence_id, offset, bins, bound."""
    ws = Workspace(docs.sparkSession, "pieces")
    last = "ids_crc32 long" if crc32 else "ids binary"
    pieces = ws.put(id_text(docs, id_col, text_col).mapInArrow(_pieces(tokenizer or default_path(), capacity, end_id, crc32), PIECES.format(last=last)), "pieces")
    return pack(pieces, capacity, per_partition).drop("uid")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc32=True)
