"""Line dedup: range-partitioned line hashes, a secondary sort by document and position, keep bitmaps.

Each task first folds its own lines: of a key it passes on one document's occurrences only, as later ones are settled
by it, so a very common line reaches the shuffle once for each fold. The rest is dealt by ranges of a 128-bit hash,
sorted by (hash, document, position) and streamed: the first document of a key keeps it, later ones lose it. The
outcome is one compressed bitmap for each document that loses lines (bit i: line i stays; lines behind the last bit
stay), kept as a table. Only these documents' texts are cut in Python; texts and bitmaps meet by hash, without a sort.

Defined cases: null or empty text is one empty line; rows without an id are left out; keys under ``min_chars`` code
points always stay; lines repeated within the document that keeps them stay; rows that repeat an id are the same
document (its lines stay in each of them); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, id_text, n_partitions

MIN_CHARS = 10
FOLD_ROWS = 200_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINES = "h1 long, h2 long, doc_id long, tkey long, pos int, settled boolean"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _fold(batches):
    """Lines of a task's later documents are settled by its first document with the key."""
    import pyarrow as pa

    held, rows = [], 0

    def flush():
        h1, h2, doc, tkey, pos = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(5))
        order = np.lexsort((pos, doc, h2, h1))
        h1, h2, doc, tkey, pos = (x[order] for x in (h1, h2, doc, tkey, pos))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        settled = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, doc, tkey, pos.astype(np.int32), settled)], names=["h1", "h2", "doc_id", "tkey", "pos", "settled"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= FOLD_ROWS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _stream(batches):
    """Sorted rows of a range: those of a key's later documents."""
    import pyarrow as pa

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, tkey, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        first = doc[at]
        if last and last[:2] == (h1[0], h2[0]):
            first[0] = last[2]
        group = np.cumsum(new) - 1
        last = (h1[-1], h2[-1], first[-1])
        out = doc != first[group]
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(tkey[out]), pa.array(pos[out])], names=["doc_id", "tkey", "pos"])


def _bitmaps(batches):
    import pyarrow as pa

    for b in batches:
        keep, n = [], []
        for gone in b.column("gone").to_pylist():
            bits = np.ones((max(gone) // 8 + 1) * 8, dtype=bool)
            bits[gone] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            n.append(len(gone))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(n, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "tkey", "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per distinct (doc_id, text) that loses lines: doc_id, tkey (xxhash64 of the text), n_dropped, keep (zlib of packed bits)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    texts = id_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    lines = texts.select("doc_id", "tkey", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    hashed = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "tkey", "pos")
    folded = ws.put(hashed.mapInArrow(_fold, _LINES), "lines")
    n = n_partitions(spark, folded.count() * 40, 32 << 20)
    open_ = folded.where("not settled").drop("settled").repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    gone = open_.mapInArrow(_stream, "doc_id long, tkey long, pos int").unionByName(folded.where("settled").select("doc_id", "tkey", "pos"))
    # Tables between the steps: a task then has one Python worker at a time.
    gone = ws.put(gone, "gone").groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("gone"))
    maps = ws.put(gone.mapInArrow(_bitmaps, "doc_id long, tkey long, n_dropped long, keep binary"), "bitmaps")
    ws.drop("lines", "gone")
    return maps


def kept_lines(text: str, keep: bytes) -> str:
    lines = text.split("\n")
    bits = np.ones(len(lines), dtype=bool)
    some = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)]
    bits[: len(some)] = some
    return "\n".join(x for x, stays in zip(lines, bits, strict=True) if stays)


def _apply(digest: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for whole, text, keep in zip(*(b.column(c).to_pylist() for c in ("whole", "cut", "keep")), strict=True):
                if keep is not None:
                    whole = kept_lines(text, keep)
                    whole = hashlib.sha256(whole.encode()).hexdigest() if digest else whole
                out.append(whole)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "out"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and text (or kept_sha256) of the lines that stay."""
    texts = id_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    joined = texts.join(line_bitmaps(docs, id_col, text_col, min_chars).hint("shuffle_hash"), ["doc_id", "tkey"], "left")
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    whole = F.when(F.col("keep").isNull(), F.sha2("text", 256) if digest else F.col("text"))
    joined = joined.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), whole.alias("whole"), F.when(F.col("keep").isNotNull(), F.col("text")).alias("cut"), "keep")
    return joined.mapInArrow(_apply(digest), "doc_id long, n_lines long, n_dropped long, out string").withColumnRenamed("out", "kept_sha256" if digest else "text")


def _replace(text_at: int, n_columns: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            columns = b.columns[:n_columns]
            text = [t if k is None else kept_lines(t, k) for t, k in zip(columns[text_at].to_pylist(), b.column(n_columns).to_pylist(), strict=True)]
            columns[text_at] = pa.array(text, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:n_columns])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all their columns, whatever their names, texts without the lines that an earlier document holds. Rows without
    an id stay as they are."""
    own_id, own_key, keep = (fresh(x, docs) for x in ("own_id", "own_key", "keep_bits"))
    maps = line_bitmaps(docs, id_col, text_col, min_chars).select(F.col("doc_id").alias(own_id), F.col("tkey").alias(own_key), F.col("keep").alias(keep))
    own = [F.col(f"`{id_col}`").cast("long") == F.col(own_id), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col(own_key)]
    joined = docs.join(maps.hint("shuffle_hash"), own, "left").select(*(docs[f"`{c}`"] for c in docs.columns), keep)
    return joined.mapInArrow(_replace(docs.columns.index(text_col), len(docs.columns)), docs.schema)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.line, k.pos, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
