"""Equality joins of two tables with renaming of what clashes; Catalyst picks the physical join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from . import predicates as P
from .rows import AUTO_COLUMNS, ROW_ID

KINDS = {"inner": "inner", "left": "left", "right": "right", "cross": "cross"}
SUFFIX = "__b"


def _side(df: DataFrame, key: str | None, columns) -> list[str]:
    names = P.need(df, columns) if columns else [c for c in df.columns if c != ROW_ID][:AUTO_COLUMNS]
    return names if key is None or key in names else [key, *names]


def join(a: DataFrame, b: DataFrame, key_a: str | None = None, key_b: str | None = None, how: str = "inner", columns_a=None, columns_b=None, filters_a=None, filters_b=None, filter_mode: str = "where", order_by: str | None = None, order_dir: str = "asc", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """filter_mode "where": filters apply to the joined rows; "pre": to each table before. B's clashing names get ``__b``."""
    if how not in KINDS:
        raise QueryError("INVALID_JOIN", f"{how!r}: inner, left, right or cross")
    if how != "cross":
        P.need(a, [key_a])
        P.need(b, [key_b])
    P.check(filters_a or [], a.columns)
    P.check(filters_b or [], b.columns)
    if filter_mode == "pre":
        a, b = P.where(a, filters_a), P.where(b, filters_b)
    names_a = _side(a, None if how == "cross" else key_a, columns_a)
    names_b = _side(b, None if how == "cross" else key_b, columns_b)
    # Everything gets a name of its own first, so self-joins and equal names need no care below.
    left = a.select(*(P.col(c).alias(f"a_{i}") for i, c in enumerate(a.columns)))
    right = b.select(*(P.col(c).alias(f"b_{i}") for i, c in enumerate(b.columns)))
    at_a, at_b = {c: f"a_{i}" for i, c in enumerate(a.columns)}, {c: f"b_{i}" for i, c in enumerate(b.columns)}
    joined = left.crossJoin(right) if how == "cross" else left.join(right, F.col(at_a[key_a]) == F.col(at_b[key_b]), KINDS[how])
    if filter_mode != "pre":
        for df, at, filters in ((a, at_a, filters_a), (b, at_b, filters_b)):
            kinds = {f.name: f.dataType for f in df.schema}
            for f in filters or []:
                joined = joined.where(P.one(F.col(at[f["column"]]), kinds[f["column"]], f["op"], f.get("value")))
    out = {c: at_a[c] for c in names_a} | {(c + SUFFIX if c in names_a else c): at_b[c] for c in names_b}
    if order_by in out:
        c = F.col(out[order_by])
        ties = [F.col(x).asc_nulls_first() for n, x in out.items() if n != order_by]
        joined = joined.orderBy(c.desc_nulls_last() if str(order_dir).lower() == "desc" else c.asc_nulls_first(), *ties)
    if offset:
        joined = joined.offset(offset)
    if limit is not None:
        joined = joined.limit(min(limit, 500))
    return joined.select(*(F.col(x).alias(n) for n, x in out.items()))


def suggest_joins(source: DataFrame, column: str, targets: dict[str, tuple[DataFrame, str]], sample: int | None = 500, least: float = 0.95) -> DataFrame:
    """How many distinct values of a column occur in each target's key: target, target_column, n_values, n_found, containment."""
    values = source.where(P.col(column).isNotNull()).select(P.col(column).cast("string").alias("v")).distinct()
    if sample:
        values = values.orderBy(F.xxhash64("v"), "v").limit(sample)  # by hash: no part of the order is favoured
    out = None
    for name, (df, key) in targets.items():
        keys = df.select(P.col(key).cast("string").alias("v")).distinct().withColumn("hit", F.lit(1))
        one = values.join(keys, "v", "left").agg(F.lit(name).alias("target"), F.lit(key).alias("target_column"), F.count(F.lit(1)).alias("n_values"), F.count("hit").alias("n_found"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("containment", F.round(F.try_divide(F.col("n_found").cast("double"), F.col("n_values").cast("double")), 4)).where(F.col("containment") >= least)
