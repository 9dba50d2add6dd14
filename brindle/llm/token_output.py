"""Token-id output in a Simple-8b file format, and its reader.

A 64-bit word has a 4-bit selector and 60 bits that hold n values of 60/n bits each (14 pairs); selector 15 is an
escape, the next word then is one value of up to 64 bits. Ids are cut into blocks that start at a word, and a segment
keeps the word offset of each block, so any block can be decoded by itself and all blocks of a segment at once.

File: a Parquet table of segments (part, seq, n_ids, doc_ids, doc_sizes, segment), in ascending doc_id order of (part, seq).
Segment bytes: magic "BRS8", uint32 block size, uint64 ids, uint64 words, uint32 block offsets, uint64 words (little-endian).

Defined cases: null text is empty (one end id); rows without an id are left out; rows that repeat an id stand next to
each other in the order of their texts' hashes; an empty table writes no segment; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, id_text, n_partitions, ranges, volume
from .tokens import batches_of, default_path, encoder

#: fixed: values in a word, by selector
PER_WORD = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTH = 60 // PER_WORD
ESCAPE = 15
BLOCK = 256
SEGMENT_IDS = 1 << 20
CUTS = 1000
MAGIC = b"BRS8"
SCHEMA = "part int, seq int, n_ids long, doc_ids binary, doc_sizes binary, segment binary"


_BITS = np.maximum(np.frexp(np.arange(1 << 16))[1], 1).astype(np.uint8)


def _fit(ids: np.ndarray, block: int) -> np.ndarray:
    """For each position the selector with most values that fit there and end within the block."""
    n = len(ids)
    need = np.full(-(-n // block) * block, 255, dtype=np.uint8)
    need[:n] = _BITS[ids.astype(np.int64)] if int(ids.max(initial=0)) < len(_BITS) else np.maximum(np.frexp(ids.astype(np.float64))[1], 1)
    need = need.reshape(-1, block)

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        """The larger of each place and the one ``by`` further on in its block; none there: too large."""
        out = np.full_like(x, 255)
        if by < block:
            np.maximum(x[:, :-by], x[:, by:], out=out[:, :-by])
        return out

    most = {1: need}
    for size in (1, 2, 4):
        most[2 * size] = ahead(most[size], size)
    sel = np.full(need.shape, ESCAPE, dtype=np.uint8)
    least = int(most[8].min(initial=255))  # words of eight and more values are rare in texts: most need no look
    for s in range(len(PER_WORD) - 1, -1, -1):
        k, w = int(PER_WORD[s]), int(WIDTH[s])
        if k >= 8 and least > w:
            break
        p = 1 << (k.bit_length() - 1)
        while p not in most:
            size = max(most)
            most[2 * size] = ahead(most[size], size)
        np.copyto(sel, np.uint8(s), where=(most[p] if k == p else ahead(most[p], k - p)) <= w)
    return sel.reshape(-1)[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    n_blocks = -(-n // block)
    sel = _fit(ids, block)
    step = np.append(np.append(PER_WORD, [1, 1])[sel], 0)
    at = np.arange(n_blocks, dtype=np.int64) * block
    end = np.minimum(at + block, n)
    chosen = np.zeros(n + 1, dtype=bool)
    while (at < end).any():  # all blocks at once; one that ends early walks on into the next, whose words are the same
        for _ in range(16):
            chosen[at] = True
            at += step[at]
    pos = np.flatnonzero(chosen[:n])
    s = sel[pos].astype(np.int64)
    escaped = s == ESCAPE
    out_at = np.arange(len(pos)) + np.cumsum(escaped) - escaped
    acc = s.astype(np.uint64)
    for k in np.unique(s[~escaped]).tolist():
        at = np.flatnonzero(s == k)
        p, word = pos[at], np.full(len(at), k, dtype=np.uint64)
        for lane in range(int(PER_WORD[k])):
            word |= ids[p] << np.uint64(4 + lane * int(WIDTH[k]))
            p += 1
        acc[at] = word
    words = np.zeros(len(pos) + int(escaped.sum()), dtype=np.uint64)
    words[out_at] = acc
    words[out_at[escaped] + 1] = ids[pos[escaped]]
    offsets = out_at[np.searchsorted(pos, np.arange(n_blocks) * block)].astype(np.uint32)
    return MAGIC + struct.pack("<IQQ", block, n, len(words)) + offsets.tobytes() + words.tobytes()


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    s = (words & np.uint64(15)).astype(np.int64)
    if (s == ESCAPE).any():  # the word after an escape is no selector; runs of such words alternate
        raw = np.zeros(len(s), dtype=bool)
        for i in np.flatnonzero(s == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
        values = words[np.flatnonzero(raw)]
        head = np.flatnonzero(~raw)
    else:
        values, head = None, np.arange(len(s))
    s, w = s[head], words[head]
    count = np.append(PER_WORD, [1, 1])[s]
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for k in np.unique(s).tolist():
        own = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[at[own]] = values
            continue
        lanes = np.arange(PER_WORD[k])
        got = w[own][:, None] >> (4 + lanes * WIDTH[k]).astype(np.uint64)
        got &= np.uint64((1 << int(WIDTH[k])) - 1)
        out[at[own][:, None] + lanes] = got
    return out[:n]


def decode(segment: bytes) -> np.ndarray:
    """All ids of a segment."""
    block, n, n_words = struct.unpack_from("<IQQ", segment, 4)
    return _unpack(np.frombuffer(segment, dtype=np.uint64, count=n_words, offset=24 + 4 * -(-n // block)), n)


def decode_block(segment: bytes, i: int) -> np.ndarray:
    """The ids of block i alone."""
    block, n, n_words = struct.unpack_from("<IQQ", segment, 4)
    n_blocks = -(-n // block)
    cuts = [*np.frombuffer(segment, dtype=np.uint32, count=n_blocks, offset=24).tolist(), n_words]
    words = np.frombuffer(segment, dtype=np.uint64, count=cuts[i + 1] - cuts[i], offset=24 + 4 * n_blocks + 8 * cuts[i])
    return _unpack(words, min(block, n - i * block))


def _write(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_sizes, held = [], [], [], 0

        def flush():
            ids = np.concatenate(held_ids)
            row = (part, seq, len(ids), np.concatenate(held_docs).tobytes(), np.concatenate(held_sizes).tobytes(), encode(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "seq", "n_ids", "doc_ids", "doc_sizes", "segment"])

        for b in batches:
            docs, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_pylist()
            for i, j in batches_of(texts):
                ids, bounds = encoder(path).encode(texts[i:j])
                held_ids.append(np.insert(ids, bounds[1:], end_id))
                held_docs.append(docs[i:j])
                held_sizes.append(np.diff(bounds) + 1)
                held += len(held_ids[-1])
                if held >= SEGMENT_IDS:
                    yield flush()
                    seq, held, held_ids, held_docs, held_sizes = seq + 1, 0, [], [], []
        if held:
            yield flush()

    return run


def _by_range(texts: DataFrame, n: int) -> DataFrame:
    """Ranges of ids, the first in partition 0. Cuts come from the id column alone; Spark's own ranges would read all texts
    once more for their sample, but take over where there are very many."""
    if n > CUTS:
        return texts.repartitionByRange(n, "doc_id")
    cuts = texts.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * CUTS)).first()[0] or [0]
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("doc_id")))
    return texts.repartitionById(n, part)


def write_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all texts, an end id after each, in ascending doc_id order. Returns the path."""
    texts = id_text(docs, id_col, text_col)
    n = n_partitions(docs.sparkSession, volume(texts), 16 << 20)
    ordered = _by_range(texts, n).sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = ordered.mapInArrow(_write(tokenizer or default_path(), end_id), SCHEMA)
    ws = Workspace(docs.sparkSession, "ids")
    if path is None:
        ws.put(segments, "segments")
        return f"{ws.path}/segments"
    segments.write.parquet(path)
    return path


def _read(derive: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for base, docs, sizes, segment in zip(*(b.column(c).to_pylist() for c in ("base", "doc_ids", "doc_sizes", "segment")), strict=True):
                ids, docs, sizes = decode(segment).astype("<u4"), np.frombuffer(docs, dtype=np.int64), np.frombuffer(sizes, dtype=np.int64)
                ends = np.cumsum(sizes)
                parts = np.split(ids, ends[:-1])
                last = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()) if derive else pa.array([p.tobytes() for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(base + ends - sizes), pa.array(sizes), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if derive else "ids"])

    return run


def read_ids(spark: SparkSession, path: str, crc32: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32 bytes), or their crc32. Only one number a part is gathered."""
    from pyspark.sql import Window

    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r.n for r in parts])]).tolist()
    bases = spark.createDataFrame([(r.part, s) for r, s in zip(parts, before, strict=False)], "part int, part_base long")
    within = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = within.join(bases, "part").select("part", "seq", (F.col("before") + F.col("part_base")).alias("base"))
    rows = files.select("part", "seq", "doc_ids", "doc_sizes", "segment").join(F.broadcast(placed) if len(parts) < 100_000 else placed, ["part", "seq"])
    return rows.select("base", "doc_ids", "doc_sizes", "segment").mapInArrow(_read(crc32), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if crc32 else 'ids binary'}")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    return read_ids(spark, write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")), crc32=True)
