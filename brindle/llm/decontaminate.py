"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of a test item is a seed, however many documents hold it: a frequent one may be the item itself, leaked
often. A passage of a document that shares a seed with an item is aligned with the whole item; words are compared
without case and punctuation, edits, insertions and losses cost. The score is the alignment's share of a perfect one,
so copies that were edited or paraphrased in part still score high and chance matches of common words don't.

Test items are handled in slices of bounded size, each sent to all tasks; a larger benchmark makes more slices, not
larger ones. Documents are never shuffled.

Defined cases: null text is empty and holds nothing; rows without an id (either side) are left out; items of fewer
than ``n`` words can't be told from chance and match nothing; rows that repeat an id give one row for each item at
most (the best); equal items match alike, each under its id; an empty table on either side gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import T_EXACT, arrow_bytes, id_text, ngrams, ranges, slices, words

N = 4
THRESHOLD = 0.5
SLICE_BYTES = 8 << 20
MATCH, MISS, GAP = 2, -1, -1
TEXT_SLICE = 1 << 20
#: hits (of several documents) and cells of alignments that are held at a time
HITS, CELLS = 1 << 20, 1 << 20
_PREFILTER = 20

#: all ASCII but letters and digits parts words, as do blanks
BREAKS = np.array([c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])


class Items:
    """The words and seeds of a slice of test items."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        raw = [t.encode() for t in texts]
        bounds = np.cumsum([0] + [len(r) for r in raw])
        self.ids = np.array(ids, dtype=np.int64)
        self.h, _, _, self.first = words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, T_EXACT, BREAKS)
        self.n = n
        g, at = ngrams(self.h, self.first, n)
        # Seeds by hash: their item and place in it.
        order = np.argsort(g, kind="stable")
        self.g, self.at = g[order], at[order]
        self.item = np.searchsorted(self.first, self.at, side="right") - 1
        self.keys, self.start = np.unique(self.g, return_index=True)
        self.count = np.diff(self.start, append=len(self.g))
        self.bits = np.zeros(1 << _PREFILTER, dtype=bool)
        self.bits[(self.keys >> np.uint64(64 - _PREFILTER)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g, number of the seed's hash) of those that are seeds."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[(g >> np.uint64(64 - _PREFILTER)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, g[maybe]), len(self.keys) - 1)
        hit = self.keys[k] == g[maybe]
        return maybe[hit], k[hit]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair: (score, word of the passage at which it ends). All pairs side by side, row by row."""
    m, w = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), m), dtype=np.uint64)
    b = np.ones((len(items), w), dtype=np.uint64)
    inside = np.zeros((len(items), w), dtype=bool)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], b[k, : len(y)], inside[k, : len(y)] = x, y, True
    lengths = np.array([len(x) for x in items])
    row = np.zeros((len(items), w + 1), dtype=np.int32)
    best, end = np.zeros(len(items), dtype=np.int32), np.zeros(len(items), dtype=np.int64)
    slope = -GAP * np.arange(w + 1, dtype=np.int32)
    for i in range(m):
        new = np.zeros_like(row)
        step = np.where((a[:, i : i + 1] == b) & inside, MATCH, MISS)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.where((lengths > i)[:, None], new, row)
        at = row.argmax(axis=1)
        top = row[np.arange(len(items)), at]
        better = top > best
        best[better], end[better] = top[better], at[better] - 1
    return best, end


def _matches(items, threshold: float):
    def run(batches):
        import pyarrow as pa

        it = items.value
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            data, bounds = arrow_bytes(b.column(1))
            rows: list[tuple] = []
            for i, j in slices(bounds, TEXT_SLICE):
                h, _, _, first = words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], T_EXACT, BREAKS)
                g, at = ngrams(h, first, it.n)
                p, k = it.find(g)
                if not len(p):
                    continue
                of = np.searchsorted(first, at[p], side="right") - 1
                hits = np.concatenate([[0], np.cumsum(np.bincount(of, it.count[k], j - i).astype(np.int64))])
                for u, v in slices(hits, HITS):
                    some = slice(*np.searchsorted(of, [u, v]))
                    if some.start < some.stop:
                        rows += _passages(it, h, first, docs[i:j], at[p[some]], k[some], threshold)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

    return run


def _passages(it, h, first, ids, at, k, threshold):
    """at, k: the places of hits and the numbers of their seeds."""
    size = np.diff(it.first)
    # A hit for each place of the seed in the items; hits on near diagonals are one passage.
    word = np.repeat(at, it.count[k])
    seed = np.repeat(it.start[k], it.count[k]) + ranges(it.count[k])
    item = it.item[seed]
    doc = np.searchsorted(first, word, side="right") - 1
    diagonal = word - (it.at[seed] - it.first[item])
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > size[item[1:]] // 2 + 2)
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(doc)) - 1
    doc, item, n_seeds = doc[s], item[s], e - s + 1
    slack = size[item] // 2 + 2
    lo = np.maximum(diagonal[s] - slack, first[doc])
    hi = np.minimum(diagonal[e] + size[item] + slack, first[doc + 1])
    return _aligned(it, h, first, ids, doc, item, lo, hi, n_seeds, threshold)


def _aligned(it, h, first, ids, doc, item, lo, hi, n_seeds, threshold):
    order = np.argsort(hi - lo, kind="stable")
    out, c = [], 0
    while c < len(order):
        part = order[c : c + 128]
        part = part[: max(1, np.searchsorted((hi - lo)[part] * np.arange(1, len(part) + 1), CELLS, side="right"))]
        c += len(part)
        mine = [it.h[it.first[item[k]] : it.first[item[k] + 1]] for k in part]
        text = [h[lo[k] : hi[k]] for k in part]
        score, end = align(mine, text)
        share = score / (MATCH * np.array([len(x) for x in mine]))
        good = np.flatnonzero(share >= threshold)
        if len(good):
            back_score, back = align([mine[g][::-1] for g in good], [text[g][: end[g] + 1][::-1] for g in good])
            for g, r in zip(good, back, strict=True):
                k = part[g]
                start = lo[k] - first[doc[k]]
                out.append((int(ids[doc[k]]), int(it.ids[item[k]]), float(share[g]), int(start + end[g] - r), int(start + end[g]), int(n_seeds[k])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, first_word, last_word, n_seeds."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col).select("doc_id", F.lower("text").alias("text"))
    tests = id_text(benchmark, item_id, item_text).select(F.col("doc_id").alias("item_id"), F.lower("text").alias("text")).distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // slice_bytes))
    out = None
    for k in range(parts):
        own = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        rows = own.orderBy("item_id", "text").collect()  # about slice_bytes
        items = Items([r.item_id for r in rows], [r.text for r in rows], n)
        found = texts.mapInArrow(_matches(spark.sparkContext.broadcast(items), threshold), "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long")
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("score", "first_word", "last_word", "n_seeds"), F.struct("score", -F.col("first_word"))).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", "x.first_word", "x.last_word", "x.n_seeds")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
