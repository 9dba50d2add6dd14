"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training uses at most ``max_examples`` labelled rows (those with the smallest hash of their id, as far as their texts
hold at most ``max_bytes``), the documented bound. Terms are all words of these texts. A term's weight is
(1 + ln tf) * ln(N / df) * association, where association is a power of the term's chi-square with the label, and no
less than a small floor, so that every word counts; vectors are scaled to length 1. Without that factor most neighbours
share nothing but some rare word (see the README).

Examples are ordered so that alike ones share a block of the index. Its postings are read in two ways. Those of rare
words are short and are summed for all examples. Of frequent words the index keeps the largest weight in each block; a
block's best sum so far and these maxima bound its cosines. Blocks are scored in full, best bounds first, until no bound
reaches the k-th best cosine, so no neighbour is lost. Votes weighted by closeness are calibrated by a logistic curve
fitted to leave-one-out votes of the examples. What is sent to the tasks is bounded by the words of the examples' texts.

Defined cases: null text is empty; a text without any word of the examples gets the smoothed share of toxic rows among
examples without any; ``toxicity`` leaves out rows without an id, ``reject_toxic`` judges them like any other; rows that
repeat an id are judged one by one; no usable label or one class only: every score is the smoothed share of label 1;
labels that disagree about an id count as 1 if one does; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import T_LOWER, Workspace, arrow_bytes, id_text, ranges, slices, words
from .decontaminate import BREAKS

MAX_EXAMPLES = 4096
MAX_BYTES = 64 << 20
FLOOR, POWER = 0.05, 0.75
K = 15
BLOCK = 64
#: words of more than this share of the examples are frequent
FREQUENT = 1 / 16
#: best blocks that are scored before the others' bounds are looked at
FIRST = 4
#: queries at a time
QUERIES = 64
TEXT_SLICE = 1 << 20


def term_counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences), by document and term."""
    h, _, _, first = words(data, bounds, T_LOWER, BREAKS)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(at, append=len(h))


def _counts(batches):
    """Words and their counts of each example."""
    import pyarrow as pa

    for b in batches:
        data, bounds = arrow_bytes(b.column("text"))
        for i, j in slices(bounds, TEXT_SLICE):
            doc, term, tf = term_counts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            own = [(term[x:y].tobytes(), tf[x:y].astype(np.int32).tobytes()) for x, y in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("y").slice(i, j - i), *(pa.array(x, pa.binary()) for x in zip(*own, strict=True))], names=["doc_id", "y", "term", "tf"])


def association(n: np.ndarray, n1: np.ndarray, total: int, total1: int) -> np.ndarray:
    """Chi-square, to the power POWER, of a term that n of all examples hold, n1 of them with label 1."""
    expected = n * (total1 / total)
    spread = expected * (1 - total1 / total) * np.maximum(total - n, 1) / max(total - 1, 1)
    return np.maximum(((n1 - expected) ** 2 / np.maximum(spread, 1e-12)) ** POWER, FLOOR)


class Index:
    """Block-max inverted index of the examples.

    terms (sorted hashes) and weight of each; the postings (example, weight) of term t are own[t]:own[t + 1]; column of a
    frequent term (else -1) in ``dense`` (its weight by example) and ``most`` (its largest weight by block).
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, labels: np.ndarray, ids: np.ndarray, weigh: bool = True):
        """doc, term, tf: the examples' words by example."""
        self.slope, self.shift = 1.0, 0.0
        some = np.bincount(doc, minlength=len(labels)) > 0
        self.empty = (1 + labels[~some].sum()) / (10 + (~some).sum())
        self.terms, t = np.unique(term, return_inverse=True)
        n, df = len(labels), np.bincount(t, minlength=len(self.terms))
        # A word of all examples has ln 1 = 0: it says nothing, but a text of such words only still has neighbours.
        self.weight = np.log((n + 0.5) / df).astype(np.float32)
        if weigh and 0 < labels.sum() < n:
            self.weight *= association(df, np.bincount(t, labels[doc], len(self.terms)), n, int(labels.sum())).astype(np.float32)
        w = (1 + np.log(tf)).astype(np.float32) * self.weight[t]
        w /= np.sqrt(np.bincount(doc, w.astype(np.float64) ** 2, n)).astype(np.float32)[doc]
        # Examples by their three heaviest words, those without words left out.
        by = np.lexsort((t, -w, doc))
        place = ranges(np.bincount(doc, minlength=n))
        heavy = np.full((n, 3), len(self.terms))
        heavy[doc[by[place < 3]], place[place < 3]] = t[by[place < 3]]
        order = np.lexsort(heavy.T[::-1])
        order = order[some[order]]
        new = np.full(n, -1)
        new[order] = np.arange(len(order))
        self.y, self.ids = labels[order].astype(np.float64), ids[order]
        doc = new[doc]
        by = np.lexsort((doc, t))
        self.doc, self.value = doc[by].astype(np.int32), w[by]
        self.own = np.searchsorted(t[by], np.arange(len(self.terms) + 1))
        self.n_blocks = -(-len(self.y) // BLOCK)
        frequent = df > max(FREQUENT * len(self.y), 1)
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        self._dense = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    @property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Made by each worker from the postings: (blocks x frequent terms x examples of a block, frequent terms x blocks)."""
        if self._dense is None:
            t = np.flatnonzero(self.column >= 0)
            size = self.own[t + 1] - self.own[t]
            at = np.repeat(self.own[t], size) + ranges(size)
            x = np.zeros((len(t), self.n_blocks * BLOCK), dtype=np.float32)
            x[np.repeat(np.arange(len(t)), size), self.doc[at]] = self.value[at]
            x = x.reshape(len(t), self.n_blocks, BLOCK)
            self._dense = np.ascontiguousarray(x.transpose(1, 0, 2)), x.max(axis=2)
        return self._dense

    def __len__(self) -> int:
        return len(self.y)

    def queries(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text, scaled to length 1; words that no example has can't change an order."""
        doc, h, tf = term_counts(data, bounds)
        return self.vectors(doc, h, tf, len(bounds) - 1)

    def vectors(self, doc: np.ndarray, h: np.ndarray, tf: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * n
        t = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[t] == h
        doc, t = doc[hit], t[hit]
        w = (1 + np.log(tf[hit])).astype(np.float32) * self.weight[t]
        w /= np.sqrt(np.bincount(doc, w.astype(np.float64) ** 2, n)).astype(np.float32)[doc]
        cut = np.searchsorted(doc, np.arange(n + 1))
        return [(t[x:y], w[x:y]) for x, y in zip(cut, cut[1:], strict=False)]

    def nearest(self, q: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, examples) of the k nearest of each query, exactly, best first; ties: the earlier example. skip: an example to leave out."""
        n, width = len(q), self.n_blocks * BLOCK
        if not width:
            return [(np.zeros(0), np.zeros(0, dtype=np.int64))] * n
        dense, most = self.dense
        row = np.repeat(np.arange(n), [len(t) for t, _ in q])
        t, w = (np.concatenate(x) for x in zip(*q, strict=True))
        column = self.column[t]
        rare = column < 0
        first = self.own[t[rare]]
        size = self.own[t[rare] + 1] - first
        at = np.repeat(first, size) + ranges(size)
        part = np.bincount(np.repeat(row[rare] * width, size) + self.doc[at], self.value[at] * np.repeat(w[rare], size), n * width).reshape(n, width)
        g = np.zeros((n, len(most)), dtype=np.float32)
        g[row[~rare], column[~rare]] = w[~rare]
        if skip is not None:
            part[np.arange(n), skip] = -2
        bound = part.reshape(n, self.n_blocks, BLOCK).max(axis=2) + g @ most
        cos = np.full((n, width), -1.0)

        def add(todo):
            for b in np.flatnonzero(todo.any(axis=0)).tolist():
                rows, own = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                cos[rows, own] = part[rows, own] + g[rows] @ dense[b]

        todo = bound > 0
        if self.n_blocks > FIRST:
            best = np.argpartition(-bound, FIRST, axis=1)[:, :FIRST]
            early = np.zeros_like(todo)
            early[np.arange(n)[:, None], best] = True
            add(early)
            seen = cos.reshape(n, self.n_blocks, BLOCK)[np.arange(n)[:, None], best].reshape(n, -1)
            least = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.full(n, -1.0)
            todo &= ~early & (bound + 1e-5 >= least[:, None])
        add(todo)
        least = np.partition(cos, -k, axis=1)[:, -k] if width > k else np.zeros(n)
        out = []
        for c, x in zip(cos, np.maximum(least, 1e-12), strict=True):
            found = np.flatnonzero(c >= x)
            found = found[np.lexsort((found, -c[found]))[:k]]
            out.append((c[found], found))
        return out

    def vote(self, cos: np.ndarray, who: np.ndarray) -> float:
        weight = cos * cos / (1.05 - np.clip(cos, 0, 1))
        return float(((weight * self.y[who]).sum() + 0.1) / (weight.sum() + 1))

    def calibrate(self, votes: np.ndarray, y: np.ndarray) -> None:
        """A logistic curve of the log-odds of leave-one-out votes, by Newton's method with a weak prior."""
        x, w = np.stack([_logit(votes), np.ones(len(votes))], axis=1), np.array([1.0, 0.0])
        for _ in range(30 if len(votes) else 0):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * (w - [1.0, 0.0]))
            w = w - np.clip(step, -2, 2)
        self.slope, self.shift = float(w[0]), float(w[1])

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list]:
        """Scores and evidence (ids of the nearest three examples) of texts; equal texts are scored once."""
        n = len(bounds) - 1
        out, evidence, number = np.full(n, self.empty), [[] for _ in range(n)], {}
        q = self.queries(data, bounds)
        of = [number.setdefault((t.tobytes(), w.tobytes()), r) if len(t) else -1 for r, (t, w) in enumerate(q)]
        once = list(number.values())
        for i in range(0, len(once), QUERIES):
            own = once[i : i + QUERIES]
            near = self.nearest([q[r] for r in own], K)
            votes = _logit(np.array([self.vote(*x) for x in near]))
            out[own] = 1 / (1 + np.exp(-(self.slope * votes + self.shift)))
            for r, (_, who) in zip(own, near, strict=True):
                evidence[r] = self.ids[who[:3]].tolist()
        for r, first in enumerate(of):
            if first >= 0:
                out[r], evidence[r] = out[first], evidence[first]
        return out, evidence


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _leave_one_out(sent):
    def run(batches):
        import pyarrow as pa

        index = sent.value
        place = {i: k for k, i in enumerate(index.ids.tolist())}
        for b in batches:
            ids, term, tf = (b.column(c).to_pylist() for c in ("doc_id", "term", "tf"))
            h, f = [np.frombuffer(x, dtype=np.uint64) for x in term], [np.frombuffer(x, dtype=np.int32) for x in tf]
            q = index.vectors(np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate(h), np.concatenate(f), len(h)) if h else []
            some, out = [k for k, (t, _) in enumerate(q) if len(t)], [None] * len(q)
            for i in range(0, len(some), QUERIES):
                own = some[i : i + QUERIES]
                for k, x in zip(own, index.nearest([q[k] for k in own], K, np.array([place[ids[k]] for k in own])), strict=True):
                    out[k] = index.vote(*x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.float64())], names=["doc_id", "y", "vote"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable, max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> Index:
    """docs: doc_id and text; labels: doc_id and y; usable: which ids may be learnt from."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = ws.put(docs.join(F.broadcast(rows), "doc_id"), "examples")  # at most max_examples ids
    examples = examples.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # rows that repeat an id are one example
    sizes = examples.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most max_examples
    chosen = [r.doc_id for r, size in zip(sizes, np.cumsum([r.n for r in sizes]).tolist(), strict=True) if size <= max_bytes]
    if len(chosen) < len(sizes):
        examples = examples.join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id")
    counted = ws.put(examples.repartition(spark.sparkContext.defaultParallelism, "doc_id").mapInArrow(_counts, "doc_id long, y int, term binary, tf binary"), "counts")
    got = counted.orderBy("doc_id").collect()  # the words of max_bytes of text at most
    n_terms = [len(r.term) // 8 for r in got]
    y = np.array([r.y for r in got], dtype=np.int64)
    term, tf = np.frombuffer(b"".join(r.term for r in got), dtype=np.uint64), np.frombuffer(b"".join(r.tf for r in got), dtype=np.int32)
    both = 0 < y.sum() < len(y)
    if not both:  # one class or none: the same score for all
        index = Index(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), y, np.zeros(len(y), np.int64))
    else:
        index = Index(np.repeat(np.arange(len(got)), n_terms), term, tf, y, np.array([r.doc_id for r in got], dtype=np.int64))
    del got, term, tf
    if both:
        sent = spark.sparkContext.broadcast(index)
        votes = counted.mapInArrow(_leave_one_out(sent), "doc_id long, y int, vote double").where("vote is not null").orderBy("doc_id").collect()  # at most max_examples
        sent.unpersist()
        index.calibrate(np.array([r.vote for r in votes]), np.array([r.y for r in votes], dtype=np.float64))
    return index


def _score(sent):
    def run(batches):
        import pyarrow as pa

        index = sent.value
        for b in batches:
            data, bounds = arrow_bytes(b.column("text"))
            for i, j in slices(bounds, TEXT_SLICE):
                s, evidence = index.score(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(s), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    texts = id_text(docs, id_col, text_col)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    sent = docs.sparkSession.sparkContext.broadcast(train(texts, known, ~held_out, max_examples, max_bytes))
    scored = texts.mapInArrow(_score(sent), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def _reject(sent, text_at: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        index = sent.value
        for b in batches:
            data, bounds = arrow_bytes(b.column(text_at).fill_null(""))
            score = [index.score(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0] for i, j in slices(bounds, TEXT_SLICE)]
            yield b.filter(pa.array(np.concatenate(score) < threshold)) if score else b

    return run


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns; no shuffle of texts."""
    texts = id_text(docs, id_col, text_col)
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    sent = docs.sparkSession.sparkContext.broadcast(train(texts, known, F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return docs.mapInArrow(_reject(sent, docs.columns.index(text_col), threshold), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
