"""Column profiles: one wide aggregate for all scalar facts, one long (column, value) count for what needs values.

The wide pass reads each row once and shuffles one row a task. The long pass is only over columns whose estimated
number of distinct values is small; columns that look unique get an exact distinct count of their own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import infer as I
from ..functions.semantic import detect
from .predicates import col
from .rows import ROW_ID

QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
VALUES, INDEX, TOP, SAMPLES, RSD = 5000, 1000, 50, 10, 0.023
#: how far from a quantile its bracket's ends are looked up: twice the sketch's error, then more; the last one holds all values
BRACKETS = (0.0002, 0.01, 1.0)


def frequencies(text: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n, first_row) of non-null values of text columns; first_row by ``_row_id`` where there is one."""
    names = [c for c in (columns or text.columns) if c != ROW_ID]
    row = col(ROW_ID) if ROW_ID in text.columns else F.lit(0).cast("long")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), I.stripped(col(c)).alias("value")) for c in names))).alias("x")
    long = text.select(row.alias("row"), cells).select("row", "x.column", "x.value").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


def top_values(text: DataFrame, k: int = TOP, columns: list[str] | None = None) -> DataFrame:
    """The k most frequent values of each column: column, value, n, place. Ties by value."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return frequencies(text, columns).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("column", "value", "n", "place")


def exact_quantiles(df: DataFrame, columns: list[str], at: dict[str, float] = QUANTILES) -> DataFrame:
    """name and one exact quantile a key of ``at``, interpolated as by ``percentile``; null where a column has no values.

    ``percentile`` keeps all distinct values of a column in one task's heap. Here a sketch brackets each quantile, an exact count
    checks the brackets (wider ones are tried until all hold theirs), and only values within brackets are counted one by one."""
    spark, schema = df.sparkSession, ", ".join(["name string", *(f"{k} double" for k in at)])
    cells = df.select(*(col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    value = [F.col(f"v{k}") for k in range(len(columns))]
    for margin in BRACKETS:
        ends = [min(1.0, max(0.0, q + d)) for q in at.values() for d in (-margin, margin)]
        wide = cells.agg(*(e for k, v in enumerate(value) for e in (F.count(v).alias(f"n{k}"), F.percentile_approx(v, ends, 10_000).alias(f"e{k}")))).first()
        # (column, quantile, low end, high end, place among the sorted values, from 0)
        spans = [(k, i, wide[f"e{k}"][2 * i], wide[f"e{k}"][2 * i + 1], (wide[f"n{k}"] - 1) * q) for k in range(len(columns)) if wide[f"n{k}"] for i, q in enumerate(at.values())]
        if not spans:
            return spark.createDataFrame([(c, *(None for _ in at)) for c in columns], schema)
        sides = cells.agg(*(e for j, (k, _, low, high, _) in enumerate(spans) for e in (F.count_if(value[k] < low).alias(f"b{j}"), F.count_if(value[k] <= high).alias(f"u{j}")))).first()
        if all(sides[f"b{j}"] <= math.floor(s[4]) and math.ceil(s[4]) < sides[f"u{j}"] for j, s in enumerate(spans)):
            break
    within = [value[k].between(low, high) for k, _, low, high, _ in spans]
    found = [F.when(w, F.struct(F.lit(j).alias("j"), value[s[0]].alias("value"))) for j, (w, s) in enumerate(zip(within, spans, strict=True))]
    counted = cells.where(reduce(lambda a, b: a | b, within)).select(F.explode(F.array_compact(F.array(*found))).alias("x")).groupBy("x.j", "x.value").agg(F.count(F.lit(1)).alias("n"))
    before = F.element_at(F.array(*(F.lit(sides[f"b{j}"]).cast("long") for j in range(len(spans)))), F.col("j") + 1)
    upto = before + F.sum("n").over(Window.partitionBy("j").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    place = F.element_at(F.array(*(F.lit(float(s[4])) for s in spans)), F.col("j") + 1)
    ranked = counted.select("j", "value", upto.alias("upto"), place.alias("place"))
    ends = ranked.groupBy("j").agg(*(F.min(F.when(F.col("upto") > f("place"), F.col("value"))).alias(n) for n, f in (("low", F.floor), ("high", F.ceil))))
    got: dict[tuple[int, int], float] = {}
    for r in ends.collect():  # one row a column and quantile
        k, i, _, _, p = spans[r["j"]]
        got[k, i] = r["low"] if r["low"] == r["high"] else (math.ceil(p) - p) * r["low"] + (p - math.floor(p)) * r["high"]
    return spark.createDataFrame([(c, *(got.get((k, i)) for i in range(len(at)))) for k, c in enumerate(columns)], schema)


def _cells(f: T.StructField, k: int) -> list:
    """What the wide aggregate needs of a column's values, computed once a row; typed columns need no patterns."""
    c = col(f.name)
    t = I.stripped(I.canonical(c, f.dataType))
    none = F.lit(None)
    if isinstance(f.dataType, T.StringType):
        solid = F.when(~I.is_placeholder(t), t)
        r, v, when = I.rank(solid), I.number(solid), I.datetime_of(solid)
        label = I.datetime_label(solid)
    else:
        solid, v, when, label = t, none.cast("double"), none.cast("timestamp"), none.cast("string")
        if isinstance(f.dataType, T.IntegralType):
            r, v = F.when(c.isNotNull(), 0), c.cast("double")
        elif isinstance(f.dataType, T.NumericType):
            v = c.cast("double")
            v = F.when(~F.isnan(v), v)
            r = F.when(v.isNull(), None).when((F.floor(v) == v) & (F.abs(v) < 1e16), 0).otherwise(1)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            r, when = F.when(c.isNotNull(), 2), c.cast("timestamp")
            label = F.when(F.length(t) == 10, "%Y-%m-%d").otherwise("%Y-%m-%dT%H:%M:%S")
        else:
            r = F.when(t.isNotNull(), 3)
    return [t.alias(f"t{k}"), solid.alias(f"s{k}"), r.cast("int").alias(f"r{k}"), v.alias(f"v{k}"), when.alias(f"w{k}"), label.alias(f"l{k}")]


def _wide(f: T.StructField, k: int) -> list:
    t, solid, r, v, when, label = (F.col(f"{x}{k}") for x in "tsrvwl")
    out = [F.count(t).alias(f"filled{k}"), *(F.count_if(r == i).alias(f"rank{i}_{k}") for i in range(4)), F.approx_count_distinct(t, RSD).alias(f"about{k}"), F.min(t).alias(f"tmin{k}"), F.max(t).alias(f"tmax{k}")]
    text = isinstance(f.dataType, T.StringType)
    held = F.count_if(t.isNotNull() & solid.isNull()) if text else F.lit(0)
    numbers = text or isinstance(f.dataType, T.NumericType)
    moments = [F.min(v), F.max(v), F.avg(v), F.var_samp(v), F.stddev_samp(v), F.percentile_approx(v, list(QUANTILES.values()), 10_000)] if numbers else [F.lit(None)] * 6
    dates = text or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    span = [F.min_by(solid, when), F.max_by(solid, when), F.min_by(label, when)] if dates else [F.lit(None)] * 3
    names = ("held", "min", "max", "mean", "var", "std", "q", "first", "last", "fmt")
    return out + [e.alias(f"{n}{k}") for n, e in zip(names, [held, *moments, *span], strict=True)]


def profile(df: DataFrame, types: dict[str, str] | None = None) -> list[dict]:
    """One dict per column (a table of a few rows, whatever the input's size)."""
    text = I.canonical_frame(df) if ROW_ID not in df.columns else df.select(col(ROW_ID), *(I.canonical(col(f.name), f.dataType).alias(f.name) for f in df.schema if f.name != ROW_ID))
    names = [c for c in df.columns if c != ROW_ID]
    native = {f.name: I.logical(f.dataType) for f in df.schema if not isinstance(f.dataType, T.StringType)}
    fields = [f for f in df.schema if f.name != ROW_ID]
    cells = df.select(*(e for k, f in enumerate(fields) for e in _cells(f, k)))
    wide = cells.agg(F.count(F.lit(1)).alias("rows"), *(e for k, f in enumerate(fields) for e in _wide(f, k))).first()
    out = []
    for k, c in enumerate(names):
        ranks = [wide[f"rank{i}_{k}"] for i in range(4)]
        top = max((i for i in range(4) if ranks[i]), default=3)
        kind = (types or {}).get(c) or native.get(c) or I.TYPES[top]
        at = I.TYPES.index(kind)
        solid = sum(ranks)
        count = wide[f"filled{k}"] - (wide[f"held{k}"] if kind != "string" else 0)
        nulls = wide["rows"] - count
        fit = solid if kind == "string" else ranks[at]
        p = {"name": c, "position": k, "type": kind, "count": count, "null_count": nulls, "null_pct": round(100 * nulls / wide["rows"], 1) if wide["rows"] else 0.0,
             "cardinality_approx": wide[f"about{k}"], "type_confidence": round(fit / solid, 4) if solid else 1.0, "type_violation_count": solid - fit}
        if kind in ("integer", "float"):
            q = wide[f"q{k}"]
            p |= {"min": wide[f"min{k}"], "max": wide[f"max{k}"], "mean": wide[f"mean{k}"], "median": q[2] if q else None, "std_dev": _r(wide[f"std{k}"]), "variance": _r(wide[f"var{k}"]), "quantiles": dict(zip(QUANTILES, q, strict=True)) if q else None}
        elif kind == "datetime":
            p |= {"min": wide[f"first{k}"], "max": wide[f"last{k}"], "datetime_min": wide[f"first{k}"], "datetime_max": wide[f"last{k}"], "datetime_format": wide[f"fmt{k}"]}
        else:
            p |= {"min": wide[f"tmin{k}"], "max": wide[f"tmax{k}"]}
        out.append(p)
    few = [p["name"] for p in out if p["cardinality_approx"] <= VALUES * 1.1]
    _add_values(text, out, few)
    many = [p for p in out if p["name"] not in few]
    close = [p["name"] for p in many if p["cardinality_approx"] >= 0.9 * p["count"]]
    exact = text.agg(*(F.count_distinct(I.stripped(col(c))).alias(f"d{k}") for k, c in enumerate(close))).first() if close else ()
    exact = dict(zip(close, exact, strict=True))
    for p in many:
        known = p["name"] in exact
        p |= {"cardinality": exact.get(p["name"], p["cardinality_approx"]), "cardinality_is_exact": known, "cardinality_estimated": not known, "value_index": None, "top_values": []}
    for p in out:
        p["is_unique"] = p["count"] > 0 and p["cardinality_is_exact"] and p["cardinality"] == p["count"]
        p["is_primary_key_candidate"] = p["is_unique"] and p["null_count"] == 0 and p["type"] in ("integer", "string")
        samples = p.get("sample_values") or []
        p["semantic_type"], p["semantic_confidence"] = detect(p["type"], samples, p["name"])
    told: dict[str, dict[str, int]] = {}
    for r in null_token_counts(df).collect():  # at most the fixed tokens a column
        told.setdefault(r["column"], {})[r["token"]] = r["n"]
    for p in out:
        p["null_tokens"] = {t: n for t, n in sorted(told.get(p["name"], {}).items()) if p["type"] != "string" or t not in I.PLACEHOLDERS}
        text_column = isinstance(df.schema[p["name"]].dataType, T.StringType)
        p["type_violation_samples"] = violations(df, p["name"], p["type"]) if p["type_violation_count"] and text_column else []
    if many:  # values in file order, without counting them all; the most frequent ones of columns that repeat any
        head = text.select(*(I.stripped(col(p["name"])).alias(f"v{k}") for k, p in enumerate(many))).limit(400).collect()
        repeating = [p["name"] for p in many if not p["is_unique"]]
        top: dict[str, list] = {}
        for r in (top_values(text, TOP, repeating).collect() if repeating else ()):  # at most TOP a column
            top.setdefault(r["column"], []).append(r)
        for k, p in enumerate(many):
            seen = list(dict.fromkeys(r[f"v{k}"] for r in head if r[f"v{k}"] is not None))[:SAMPLES]
            if len(seen) < SAMPLES:  # mostly empty at the start: its first values, wherever they stand
                some = text.where(I.stripped(col(p["name"])).isNotNull())
                some = some.orderBy(ROW_ID) if ROW_ID in text.columns else some
                seen = list(dict.fromkeys(r.v for r in some.select(I.stripped(col(p["name"])).alias("v")).limit(400).collect()))[:SAMPLES]
            p["sample_values"] = seen
            p["semantic_type"], p["semantic_confidence"] = detect(p["type"], seen, p["name"])
            p["top_values"] = [{"value": r["value"], "count": r["n"]} for r in sorted(top.get(p["name"], ()), key=lambda r: r["place"])]
    return out


def _add_values(text: DataFrame, out: list[dict], few: list[str]) -> None:
    if not few:
        return
    f = frequencies(text, few)
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    by_row = Window.partitionBy("column").orderBy("first_row", "value")
    ranked = f.withColumn("c", F.row_number().over(by_count)).withColumn("r", F.row_number().over(by_row)).withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("column")))
    got: dict[str, list] = {}
    for r in ranked.where(f"c <= {INDEX} or r <= {SAMPLES}").collect():  # at most INDEX + SAMPLES values a column
        got.setdefault(r["column"], []).append(r)
    for p in out:
        if p["name"] in few:
            held = set(I.PLACEHOLDERS) if p["type"] != "string" else set()
            rows = [r for r in got.get(p["name"], ()) if r["value"] not in held]
            distinct = (rows[0]["d"] if rows else 0) - sum(r["value"] in held for r in got.get(p["name"], ()))
            top = sorted((r for r in rows if r["c"] <= INDEX), key=lambda r: r["c"])
            p |= {"cardinality": max(distinct, 0), "cardinality_is_exact": True, "cardinality_estimated": False,
                  "value_index": {r["value"]: r["n"] for r in top} if distinct <= INDEX else None,
                  "top_values": [{"value": r["value"], "count": r["n"]} for r in top[:TOP]],
                  "sample_values": [r["value"] for r in sorted(rows, key=lambda r: r["r"]) if r["r"] <= SAMPLES + len(held)][:SAMPLES]}


def null_token_counts(df: DataFrame) -> DataFrame:
    """(column, token, n) of the tokens, other than nothing at all, that count as null in text columns; placeholders too."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, token string, n long")
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(col(c)).alias("token")) for c in names))).alias("x")).select("x.*")
    return cells.where(F.col("token").isin([t for t in I.HARD_NULLS if t] + I.PLACEHOLDERS)).groupBy("column", "token").agg(F.count(F.lit(1)).alias("n"))


def violations(df: DataFrame, column: str, kind: str, n: int = 5) -> list[str]:
    """Some values that aren't of the column's type, in file order where rows are numbered."""
    t = I.stripped(col(column))
    odd = df.where(t.isNotNull() & ~I.is_placeholder(t) & (I.rank(t) != I.TYPES.index(kind)))
    odd = odd.orderBy(ROW_ID) if ROW_ID in df.columns else odd
    return list(dict.fromkeys(r.v for r in odd.select(t.alias("v")).limit(10 * n).collect()))[:n]


def learned_null_tokens(profiles: list[dict]) -> list[dict]:
    """Sentinel-looking values that recur in several columns, from the profiles' value counts."""
    import re

    from ..functions.semantic import SENTINEL_COLUMNS, SENTINEL_LENGTH, SENTINEL_SHARE, SENTINEL_TOP, SENTINEL_WORDS, SENTINELS

    found: dict[str, dict] = {}
    for p in profiles:
        for value, n in (p.get("value_index") or {}).items():
            if len(value) <= SENTINEL_LENGTH and (re.match(SENTINELS, value) or value.lower() in SENTINEL_WORDS) and n >= SENTINEL_SHARE * p["count"]:
                one = found.setdefault(value, {"token": value, "columns": [], "n": 0})
                one["columns"].append(p["name"])
                one["n"] += n
    several = [f for f in found.values() if len(f["columns"]) >= SENTINEL_COLUMNS]
    return sorted(several, key=lambda f: (-len(f["columns"]), -f["n"], f["token"]))[:SENTINEL_TOP]


def _r(x):
    return None if x is None else round(x, 6)


PROFILE_SCHEMA = "name string, position int, type string, count long, null_count long, null_pct double, cardinality long, cardinality_approx long, is_unique boolean, is_primary_key_candidate boolean, type_confidence double, type_violation_count long, mean double, std_dev double, variance double, semantic_type string, semantic_confidence double, min string, max string"


def profile_frame(spark, profiles: list[dict]) -> DataFrame:
    """The profile as a table."""
    keys = [f.split()[0] for f in PROFILE_SCHEMA.split(", ")]
    floats = {"null_pct", "type_confidence", "mean", "std_dev", "variance", "semantic_confidence"}
    rows = [tuple(None if p.get(k) is None else float(p[k]) if k in floats else str(p[k]) if k in ("min", "max") else p[k] for k in keys) for p in profiles]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
