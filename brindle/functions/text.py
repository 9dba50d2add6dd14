"""Words, BM25 ranking and vector similarity."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: fixed: ranges of CJK letters, which are split to overlapping pairs
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words; runs of CJK letters as overlapping pairs."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(rf"(?U)([{CJK}]+|[\w&&[^{CJK}]]+)"), 1)
    pairs = lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.char_length(r) > 1), F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.when(text.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, pairs))).otherwise(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), 1))


def query_tokens(text: str) -> list[str]:
    out = []
    for r in re.findall(rf"[{CJK}]+|[^\W{CJK}]+", text.lower()):
        out += [r[i : i + 2] for i in range(len(r) - 1)] if re.match(f"[{CJK}]", r) and len(r) > 1 else [r]
    return list(dict.fromkeys(out))


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, top: int | None = 10) -> DataFrame:
    """(id, score) by BM25. Only the query's terms are counted, inside each row: nothing is exploded, and the one shuffle
    is a row of sums a task."""
    terms = query_tokens(query)
    if not terms:
        return docs.select(id_col).limit(0).withColumn("score", F.lit(0.0))
    texts = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("t"))
    holds = reduce(lambda a, b: a | b, (F.contains(F.lower("t"), F.lit(t)) for t in terms))

    def count(df: DataFrame) -> DataFrame:
        words = df.select(id_col, holds.alias("h"), tokens(F.col("t")).alias("w"))
        return words.select(id_col, F.size("w").alias("len"), *(F.when(F.col("h"), _occurrences(F.col("w"), t)).otherwise(0).alias(f"t{i}") for i, t in enumerate(terms)))

    # All texts are read once for their lengths; only those that hold a term are split again for their scores.
    counted, hits = count(texts), count(texts.where(holds))
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (facts["n"] - facts[f"d{i}"] + 0.5) / (facts[f"d{i}"] + 0.5)))
        tf = F.col(f"t{i}").cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(facts["avg"] or 1.0)))
    out = hits.select(id_col, score.alias("score")).where("score > 0")
    return out if top is None else out.orderBy(F.desc("score"), id_col).limit(top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def nearest(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, top: int = 10) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(top)


def hash_embedding(text: str, size: int = 128) -> list[float]:
    """An offline embedding for tests and defaults: hashed words and letter triples, no model."""
    import numpy as np

    out = np.zeros(size)
    for w in query_tokens(text):
        for part in {w, *(f"{w} "[i : i + 3] for i in range(len(w) - 1))}:
            h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
            out[h % size] += 1 if h >> 63 else -1
    n = float(np.linalg.norm(out))
    return (out / n if n else out).tolist()
