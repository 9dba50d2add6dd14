"""Substring dedup: a Count-min prefilter over word windows, then exact grouping of the windows it can't rule out.

Texts are dealt once into blocks by id and kept as a bucketed table, so the three passes over them move no text.

1. Each block is a partition sketch: two Count-min rows of 8 to 16 cells a window of the whole corpus, with counts that
   saturate at two, as this is all that is asked. Sketches are sparse (gaps of the sorted cells that are not zero) and
   are merged by ranges of cells. A merged count is never under a window's true count. Back to each block comes one bit
   for each cell it sent: two or more. A window's estimate is the smaller of its cells in both rows.
2. Blocks send only windows with an estimate of two or more, with 64 further bits of a second hash; ranges group them
   exactly. One bit for each comes back: this window starts at two or more places.
3. Blocks mark the words of repeated windows and emit what is left.

Merging goes by levels of a fixed fan-out: a level merges the sketches of a bounded number of senders within one range of
cells and cuts the outcome into finer ranges for the next; the bits go back the same way. So what is sent grows with the
words, not with blocks times ranges. Nothing is broadcast and nothing gathered on the driver. A window that occurs in a
third of all rows is one entry for each block and then for each merged sketch, so no range grows with it.

Defined cases: null or wordless text has no windows and is kept empty; rows without an id are left out; rows that
repeat an id count as documents of their own (their equal windows repeat); texts under ``window`` words stay whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_bytes, id_text, levels, mix, n_partitions, ngrams, slices, spans, volume, word_counts, words

WINDOW = 35
#: text in a bucket; it holds a few blocks, one after another
BUCKET_BYTES = 24 << 20
BLOCKS_A_BUCKET = 4
#: rows of the sketch, log2 of its cells a window, windows whose cells meet in one range, log2 of the ranges a sketch is cut into
ROWS, EXTRA_BITS, RANGE_WINDOWS, FAN_OUT = 2, 3, 2 << 20, 6
EXACT, OWN = ROWS, ROWS + 1
TEXT_SLICE = 1 << 20
#: row: a row of the sketch, windows to be grouped (EXACT), or what a block keeps for itself (OWN)
SKETCH = "row int, prefix long, sender long, cells binary, more binary, many binary"
BITS = "row int, prefix long, sender long, bits binary"


# ------------------------------------------------------------------ coding
def pack_sorted(x: np.ndarray) -> bytes:
    """Gaps of ascending numbers as uint16, large ones apart."""
    gaps = np.diff(x, prepend=np.uint64(0)).astype(np.uint64)
    far = gaps >= 0xFFFF
    small = np.where(far, 0xFFFF, gaps).astype("<u2")
    return np.uint32(len(x)).tobytes() + small.tobytes() + gaps[far].astype("<u8").tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    gaps = np.frombuffer(raw, dtype="<u2", count=n, offset=4).astype(np.uint64)
    far = gaps == 0xFFFF
    gaps[far] = np.frombuffer(raw, dtype="<u8", offset=4 + 2 * n)
    return np.cumsum(gaps, dtype=np.uint64)


def _distinct(*keys: np.ndarray):
    """Of sorted keys: (places of distinct ones, number of each key's distinct one, more than one?)."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.cumsum(new) - 1, np.diff(at, append=len(new)) > 1


def _pieces(row: int, sender: int, cells: np.ndarray, many: np.ndarray, shift: int, more: np.ndarray | None = None) -> list[tuple]:
    """Rows of a sketch with ascending cells, one for each range of cells."""
    prefix = (cells >> np.uint64(shift)).astype(np.int64)
    return [(row, int(prefix[i]), sender, pack_sorted(cells[i:j]), None if more is None else more[i:j].tobytes(), np.packbits(many[i:j]).tobytes()) for i, j in spans(prefix)]


def _table(rows: list[tuple]):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [[]] * 6
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "prefix", "sender", "cells", "more", "many"])


# ------------------------------------------------------------------ merging
class Merged:
    """Sketches of one range, merged: their distinct entries, and where each sender's entries went."""

    def __init__(self, table):
        table = table.sort_by("sender")
        self.row = table.column("row")[0].as_py()
        self.senders, self.prefix = table.column("sender").to_pylist(), table.column("prefix")[0].as_py()
        cells = [unpack_sorted(x) for x in table.column("cells").to_pylist()]
        self.ends = np.cumsum([len(c) for c in cells])
        many = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(c)) for x, c in zip(table.column("many").to_pylist(), cells, strict=True)]).astype(bool)
        cell, self.more = np.concatenate(cells), None
        if self.row == EXACT:
            more = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("more").to_pylist()])
            order = np.lexsort((more, cell))
            at, entry, self.many = _distinct(cell[order], more[order])
            self.more = more[order][at]
        else:
            order = np.argsort(cell, kind="stable")
            at, entry, self.many = _distinct(cell[order])
        self.cells = cell[order][at]
        self.many |= np.logical_or.reduceat(many[order], at)
        self.entry = np.empty(len(cell), dtype=np.int64)
        self.entry[order] = entry

    def answer(self, flags: np.ndarray):
        """One bit for each entry of each sender."""
        import pyarrow as pa

        bits = [np.packbits(x).tobytes() for x in np.split(flags[self.entry], self.ends[:-1])]
        n = len(bits)
        return pa.table({"row": pa.array([self.row] * n, pa.int32()), "prefix": pa.array([self.prefix] * n, pa.int64()), "sender": pa.array(self.senders, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _up(shift: int):
    def run(key, table):
        m = Merged(table)
        return _table(_pieces(m.row, key[2].as_py(), m.cells, m.many, shift, m.more))

    return run


def _settle(key, table):
    m = Merged(table)
    return m.answer(m.many)


def _down(shift: int):
    def run(key, table, answers):
        m = Merged(table)
        return m.answer(_flags(answers, m.row, m.cells, shift))

    return run


def _flags(answers, row: int, cells: np.ndarray, shift: int) -> np.ndarray:
    """The bits that came back, for the ascending cells that were sent in pieces by range."""
    found = {p: x for r, p, x in zip(*(answers.column(c).to_pylist() for c in ("row", "prefix", "bits")), strict=True) if r == row}
    prefix = (cells >> np.uint64(shift)).astype(np.int64)
    out = [np.unpackbits(np.frombuffer(found[int(prefix[i])], dtype=np.uint8), count=j - i) for i, j in spans(prefix)]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, dtype=bool)


def count(sent: DataFrame, bits: int, steps: list[int], ws: Workspace, name: str, n: int) -> DataFrame:
    """For each sketch that was sent, one bit for each entry: two or more in all."""
    tables = [sent if len(steps) == 1 else ws.put(sent, f"{name}_0")]
    batch = [F.pmod(F.xxhash64("sender"), F.lit(1 << (steps[-1] - now))) for now in steps]
    for k, then in enumerate(steps[1:]):
        dealt = tables[k].withColumn("batch", batch[k]).repartition(n, "row", "prefix", "batch")
        tables.append(ws.put(dealt.groupBy("row", "prefix", "batch").applyInArrow(_up(bits - then), SKETCH), f"{name}_{k + 1}"))
    back = ws.put(tables[-1].repartition(n, "row", "prefix").groupBy("row", "prefix").applyInArrow(_settle, BITS), f"{name}_answers")
    for k in range(len(steps) - 2, -1, -1):
        now, then = steps[k], steps[k + 1]
        children = tables[k].withColumn("batch", batch[k]).repartition(n, "row", "prefix", "batch").groupBy("row", "prefix", "batch")
        answers = back.withColumn("up", F.shiftright("prefix", then - now)).repartition(n, "row", "up", "sender").groupBy("row", "up", "sender")
        back = ws.put(children.cogroup(answers).applyInArrow(_down(bits - then), BITS), f"{name}_answers{k}")
    return back


# ------------------------------------------------------------------ a block
class Block:
    """Windows of a block's documents, in the order of their first hash; cells in each row of the sketch."""

    def __init__(self, table, window: int, bits: int, second: bool = True):
        table = table.sort_by([("doc_id", "ascending"), ("tkey", "ascending")])
        data, bounds = arrow_bytes(table.column("text"))
        h1, h2, at, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for i, j in slices(bounds, TEXT_SLICE):
            h, _, _, first = words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            g, a = ngrams(h, first, window)
            h1.append(g)
            at.append(a + seen)
            if second:
                h2.append(ngrams(h, first, window, second=True)[0])
            seen += len(h)
        h1, shift = np.concatenate(h1), np.uint64(64 - bits)
        if second:
            order = np.argsort(h1)
            self.h1, self.h2, self.at = h1[order], np.concatenate(h2)[order], np.concatenate(at)[order]
            h1 = self.h1
        else:
            h1 = np.sort(h1)
        self.rows = []
        for r in range(ROWS):
            cell = (mix(h1 ^ np.uint64(0x6A09E667F3BCC909 * r & (1 << 64) - 1)) if r else h1) >> shift
            order = np.argsort(cell, kind="stable") if r else None
            cell = cell[order] if r else cell
            first, entry, many = _distinct(cell)
            if r:
                entry, own = np.empty_like(entry), entry
                entry[order] = own
            self.rows.append((cell[first], entry, many))


def _sketch(window: int, bits: int, shift: int):
    def run(key, table):
        block, number = Block(table, window, bits, second=False), key[0].as_py()
        return _table([p for r, (cells, _, many) in enumerate(block.rows) for p in _pieces(r, number, cells, many, shift)])

    return run


def _send(window: int, bits: int, shift: int):
    def run(key, table, answers):
        if not table.num_rows:
            return _table([])
        block, number = Block(table, window, bits), key[0].as_py()
        suspect = np.logical_and.reduce([_flags(answers, r, cells, shift)[entry] for r, (cells, entry, _) in enumerate(block.rows)])
        h1, h2, at = block.h1[suspect], block.h2[suspect], block.at[suspect]
        cell = h1 >> np.uint64(64 - bits)
        order = np.lexsort((h2, cell))
        cell, h2, at = cell[order], h2[order], at[order]
        first, entry, many = _distinct(cell, h2)
        rows = _pieces(EXACT, number, cell[first], many, shift, h2[first])
        by = np.argsort(at)
        own = (OWN, 0, number, pack_sorted(at[by].astype(np.uint64)), entry[by].astype("<u4").tobytes(), pack_sorted(cell[first]))
        return _table([*rows, own])

    return run


def _remove(window: int, shift: int, digest: bool):
    def run(key, table, answers):
        import pyarrow as pa

        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        table = table.sort_by([("doc_id", "ascending"), ("tkey", "ascending")])
        data, bounds = arrow_bytes(table.column("text"))
        n_words = np.concatenate([word_counts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in slices(bounds, TEXT_SLICE)])
        first = np.concatenate([[0], np.cumsum(n_words)])
        kinds = answers.column("row").to_pylist()
        own = answers.slice(kinds.index(OWN), 1)
        starts, entry, cells = unpack_sorted(own.column("cells")[0].as_py()).astype(np.int64), np.frombuffer(own.column("more")[0].as_py(), dtype="<u4"), unpack_sorted(own.column("many")[0].as_py())
        starts = starts[_flags(answers, EXACT, cells, shift)[entry]] if len(cells) else starts
        cover = np.zeros(int(first[-1]) + 1, dtype=np.int32)
        cover[starts] += 1
        cover[starts + window] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        n_lost = lost[first[1:]] - lost[first[:-1]]
        raw, kept = data.tobytes(), []
        for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
            w = raw[i:j].split()
            text = b" ".join(compress(w, (~gone[first[k] : first[k + 1]]).tolist()) if n_lost[k] else w)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
        return pa.table({"doc_id": table.column("doc_id").combine_chunks(), "n_words": pa.array(n_words), "n_removed": pa.array(n_lost.astype(np.int64)), "kept": pa.array(kept, pa.string())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False, bucket_bytes: int = BUCKET_BYTES, range_windows: int = RANGE_WINDOWS, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and text (or kept_sha256): the words that stay, one space between."""
    spark = docs.sparkSession
    ws = Workspace(spark, "substring")
    texts = id_text(docs, id_col, text_col)
    n_bytes = volume(texts)
    n_buckets = n_partitions(spark, n_bytes, bucket_bytes)
    about = max(n_bytes // 6, 1)
    steps = levels(about, range_windows, fan_out)
    bits = min(max(about.bit_length() + EXTRA_BITS, steps[-1]), 60)
    shift, n = bits - steps[0], max(1 << steps[-1], int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.select("doc_id", "text", F.xxhash64("text").alias("tkey"), F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS_A_BUCKET * n_buckets)).alias("block"))
    dealt = ws.put(dealt.repartition(n_buckets, "block"), "blocks", bucket=(n_buckets, "block"))
    heavy = count(dealt.groupBy("block").applyInArrow(_sketch(window, bits, shift), SKETCH), bits, steps, ws, "sketch", n)
    sent = ws.put(dealt.groupBy("block").cogroup(heavy.groupBy("sender")).applyInArrow(_send(window, bits, shift), SKETCH), "sent")
    repeated = count(sent.where(F.col("row") == EXACT), bits, steps, ws, "exact", n)
    none = F.lit(None).cast("binary")
    own = sent.where(F.col("row") == OWN).withColumn("bits", none)
    answers = repeated.select("row", "prefix", "sender", *(none.alias(c) for c in ("cells", "more", "many")), "bits").unionByName(own)
    out = dealt.groupBy("block").cogroup(answers.groupBy("sender")).applyInArrow(_remove(window, shift, digest), "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "kept_sha256" if digest else "text")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT p.doc_id, p.i, md5(array_to_string(w[p.i:p.i + 34], ' ')) AS g FROM p JOIN d USING (doc_id)),
r AS (SELECT g FROM h GROUP BY g HAVING count(*) > 1),
c AS (SELECT h.doc_id, list_distinct(flatten(list(range(h.i, h.i + 35)))) AS gone FROM h JOIN r USING (g) GROUP BY h.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
sha256(array_to_string(list_filter(w, lambda x, k: gone IS NULL OR NOT list_contains(gone, k)), ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
