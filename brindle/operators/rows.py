"""Row retrieval: filter, project, sort, page; and samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, invalid_column
from .predicates import col, need, where

MAX_ROWS = 500
AUTO_COLUMNS = 30
ROW_ID = "_row_id"


def order(df: DataFrame, order_by: str | None, direction: str = "asc", ties=()) -> list[Column]:
    """Nulls are the smallest value in both directions. Ties are broken, so pages don't overlap."""
    keys = []
    if order_by is not None:
        if order_by not in df.columns:
            raise invalid_column(order_by)
        keys.append(col(order_by).desc_nulls_last() if str(direction).lower() == "desc" else col(order_by).asc_nulls_first())
    return keys + [col(t).asc() for t in ties if t in df.columns and t != order_by]


def project(df: DataFrame, columns=None, cap: int | None = AUTO_COLUMNS) -> DataFrame:
    """Named columns, or the first ``cap`` of a wide table. Only these are read from columnar files."""
    names = need(df, columns) if columns else [c for c in df.columns if c != ROW_ID][:cap]
    return df.select(*map(col, names))


def get_rows(df: DataFrame, filters=None, columns=None, order_by: str | None = None, order_dir: str = "asc", limit: int = 50, offset: int = 0, cap: int | None = AUTO_COLUMNS) -> DataFrame:
    if limit > MAX_ROWS:
        raise QueryError("ROW_LIMIT_EXCEEDED", f"limit {limit} is over {MAX_ROWS}")
    out = where(df, filters)
    names = need(df, columns) if columns else [c for c in df.columns if c != ROW_ID][:cap]
    by = order(df, order_by, order_dir, (ROW_ID, *(c for c in df.columns if c != ROW_ID)) if order_by else (ROW_ID,))
    keep = ([ROW_ID] if ROW_ID in df.columns else []) + names
    page = out.orderBy(*by) if by else out
    page = page.offset(offset) if offset else page
    return page.limit(limit).select(*map(col, keep))


def sample_rows(df: DataFrame, n: int = 5, method: str = "head", seed: int | None = None, columns=None, row_id: str = ROW_ID) -> DataFrame:
    """head, tail (last first), random; a seed makes random the same each time, by a hash of the row's number."""
    n = max(1, min(int(n), 100))
    keep = [row_id] * (row_id in df.columns) + (need(df, columns) if columns else [c for c in df.columns if c != row_id])
    if method == "head":
        out = df.orderBy(col(row_id)) if row_id in df.columns else df
    elif method == "tail":
        out = df.orderBy(col(row_id).desc())
    elif method == "random":
        out = df.orderBy(F.rand()) if seed is None else df.orderBy(F.xxhash64(col(row_id), F.lit(int(seed))), col(row_id))
    else:
        raise QueryError("INVALID_METHOD", f"{method!r}: head, tail or random")
    return out.limit(n).select(*map(col, keep))


def with_row_ids(df: DataFrame) -> DataFrame:
    """1-based numbers in file order: by path, then place in the file. Tables that come from no file are counted by partition."""
    if ROW_ID in df.columns:
        return df
    spark, none = df.sparkSession, F.lit("")
    try:  # Spark packs files into tasks by size, so the task's number says nothing about the files' order
        base = df.select("*", F.col("_metadata.file_path").alias("_file_"), F.col("_metadata.file_block_start").alias("_start_"))
        base.schema  # noqa: B018  resolves the hidden column
    except AnalysisException:
        base = df.select("*", none.alias("_file_"), F.spark_partition_id().cast("long").alias("_start_"))
    base = base.withColumn("_place_", F.monotonically_increasing_id())
    sizes = base.groupBy("_file_", "_start_").agg(F.count(F.lit(1)).alias("n"), F.min("_place_").alias("low")).orderBy("_file_", "_start_").collect()
    if not sizes:
        return df.select(F.lit(1).cast("long").alias(ROW_ID), *map(col, df.columns))
    before, rows = 0, []
    for r in sizes:
        rows.append((r["_file_"], r["_start_"], before - r["low"] + 1))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(rows, "_file_ string, _start_ long, _shift_ long"))  # one row a split of a file
    return base.join(shift, ["_file_", "_start_"]).withColumn(ROW_ID, F.col("_place_") + F.col("_shift_")).select(ROW_ID, *map(col, df.columns))
