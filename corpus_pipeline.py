"""From raw documents to packed training sequences, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import Workspace, fresh
from brindle.llm.decontaminate import contaminated
from brindle.llm.line_dedup import drop_repeated_lines
from brindle.llm.near_dedup import near_dedup
from brindle.llm.packing import pack_documents
from brindle.llm.toxicity import reject_toxic


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids: all rows of a repeated one; rows without an id stay."""
    gone_id = fresh("gone_id", docs)
    gone = ids.select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay, n_chars follows the text."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more) stays."""
    return _without(docs, near_dedup(docs, percent=80).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their places in sequences of 1024 tokens."""
    return pack_documents(docs, crc32=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express nearest neighbours with calibrated votes, alignment and packing; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.put(docs, name)
            if k:
                ws.drop(STAGES[k - 1][0])
    return docs
