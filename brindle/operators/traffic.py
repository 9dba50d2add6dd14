"""Query-log traffic: which table and column each logged query touches, summed by fingerprint; use in a window."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import fingerprint, scrub_sql

_NAME = r"(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][A-Za-z0-9_]*)"
_PATH = rf"(?:{_NAME}\.)?{_NAME}"
TABLES = rf"(?i)\b(?:from|join|update|insert\s+into|delete\s+from|merge\s+into)\s+({_PATH})"
SELECTED = r"(?is)\bselect\b(.+?)\bfrom\b"
CLAUSES = r"(?is)\b(?:where|on|group\s+by|order\s+by|having)\b(.*?)(?=\b(?:where|on|group\s+by|order\s+by|having|limit|offset|join|left|right|inner|cross|full|union)\b|;|\z)"
#: fixed: words of SQL that are no columns
WORDS = "select from where and or not in is null like ilike between as on group by order having limit offset asc desc case when then else end exists any all true false join left right inner outer full cross natural using union intersect except distinct with recursive insert into update delete merge set values count sum avg min max coalesce cast nullif lower upper over partition rows range preceding following current row unbounded interval date timestamp".split()
ROW = "fingerprint string, table_name string, column_name string, calls long, total_time double, mean_time double, last_seen timestamp"


def _last(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, rf"^.*\.(?={_NAME}$)", ""), r"[\"`\[\]]", ""))


def tables_of(query: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(query, F.lit(TABLES), 1), _last), lambda t: ~t.isin(WORDS)))


def columns_of(query: Column) -> Column:
    parts = F.concat(F.regexp_extract_all(query, F.lit(SELECTED), 1), F.regexp_extract_all(query, F.lit(CLAUSES), 1))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"'(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_]*\s*\(|(?i)\bas\s+[A-Za-z_][A-Za-z0-9_]*", " "))
    names = F.flatten(F.transform(bare, lambda p: F.regexp_extract_all(p, F.lit(f"({_PATH})"), 1)))
    return F.array_distinct(F.filter(F.transform(names, _last), lambda c: ~c.isin(WORDS)))


def rollup(log: DataFrame, now=None) -> DataFrame:
    """log: query, calls, total_time. One row per fingerprint, table and column, and one with column '' for each table."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    q = log.select(scrub_sql(F.col("query")).alias("text"), F.col("query").alias("raw"), F.coalesce("calls", F.lit(1)).cast("long").alias("calls"), F.coalesce("total_time", F.lit(0.0)).cast("double").alias("total_time"))
    q = q.where("raw is not null").select(fingerprint(F.col("text")).alias("fingerprint"), F.explode(tables_of(F.col("raw"))).alias("table_name"), F.concat(F.array(F.lit("")), columns_of(F.col("raw"))).alias("columns"), "calls", "total_time")
    q = q.select("fingerprint", "table_name", F.explode("columns").alias("column_name"), "calls", "total_time")
    return merge(q.withColumn("mean_time", F.try_divide(F.col("total_time"), F.col("calls"))).withColumn("last_seen", now))


def merge(*rolls: DataFrame) -> DataFrame:
    """Sums of rollups: the same keys add up, the latest mean time and moment stay."""
    out = rolls[0]
    for r in rolls[1:]:
        out = out.unionByName(r)
    return out.groupBy("fingerprint", "table_name", "column_name").agg(F.sum("calls").alias("calls"), F.sum("total_time").alias("total_time"), F.max_by("mean_time", F.when(F.col("mean_time").isNotNull(), F.col("last_seen"))).alias("mean_time"), F.max("last_seen").alias("last_seen"))


def windowed(traffic: DataFrame, cutoff) -> DataFrame:
    """Per table and column: calls since the cutoff, all calls, last seen."""
    recent = F.when(F.col("last_seen") >= F.lit(cutoff).cast("timestamp"), F.col("calls"))
    return traffic.groupBy("table_name", "column_name").agg(F.coalesce(F.sum(recent), F.lit(0)).alias("recent_calls"), F.sum("calls").alias("all_calls"), F.max("last_seen").alias("last_seen"))


#: fixed: names of columns that machines fill
AUDIT = r"(?i)^(?:(?:created|updated|deleted|modified|inserted)_at|_(?:created|updated|deleted|modified)_(?:at|by)|etl_.*|_dbt_.*|dbt_(?:loaded|updated|inserted)_at)$"


def unused_columns(profile: DataFrame, traffic: DataFrame, table: str, cutoff, min_calls: int = 0, skip_keys: bool = True, skip_audit: bool = True) -> DataFrame:
    """column, reason (zero_hits, stale, below_min_calls), recent_calls."""
    use = windowed(traffic, cutoff).where((F.col("table_name") == table.lower()) & (F.col("column_name") != ""))
    out = profile.join(use, F.lower("name") == F.col("column_name"), "left")
    recent = F.coalesce("recent_calls", F.lit(0))
    reason = F.when(F.col("all_calls").isNull(), "zero_hits").when(recent == 0, "stale").when(recent < min_calls, "below_min_calls")
    if skip_keys:
        out = out.where(~F.col("is_primary_key_candidate"))
    if skip_audit:
        out = out.where(~F.col("name").rlike(AUDIT))
    return out.select(F.col("name").alias("column"), reason.alias("reason"), recent.cast("long").alias("recent_calls")).where("reason is not null")


def call_loops(calls: DataFrame, key, seconds: int = 120, most: int = 10) -> DataFrame:
    """Rows whose key had more than ``most`` calls within the seconds up to them: the key, ts, calls."""
    w = Window.partitionBy(*key).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return calls.withColumn("calls", F.count(F.lit(1)).over(w)).where(F.col("calls") > most)


def pagination_loops(calls: DataFrame, key=("tool", "dataset"), seconds: int = 120, least: int = 5) -> DataFrame:
    """Keys that page on and on: ``least`` calls within the seconds with growing offsets in at most two step sizes."""
    w = Window.partitionBy(*key).orderBy("ts")
    step = calls.withColumn("step", F.col("offset") - F.lag("offset").over(w))
    recent = Window.partitionBy(*key).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    seen = step.withColumn("n", F.count(F.lit(1)).over(recent)).withColumn("steps", F.collect_set("step").over(recent)).withColumn("low", F.min("step").over(recent))
    return seen.where((F.col("n") >= least) & (F.col("low") > 0) & (F.size("steps") <= 2)).select(*key).distinct()


def latency(samples: DataFrame, key: str = "tool") -> DataFrame:
    """n, p50, p95, max of ms by key."""
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"), F.max("ms").alias("max_ms")).orderBy(F.desc("p95"), key)


def owner_of(column: str, datasets: dict[str, list[dict]], own: str) -> list[dict]:
    """Keys of other datasets that a column seems to point to: the same name, or x_id to x.id or xs.id."""
    name = column.lower()
    stem = name[:-3] if name.endswith("_id") else None
    out = []
    for other, profiles in datasets.items():
        for p in profiles if other != own else ():
            if p["is_primary_key_candidate"] and (p["name"].lower() == name or stem and p["name"].lower() == "id" and other.lower() in (stem, stem + "s")):
                out.append({"dataset": other, "column": p["name"], "type": p["type"]})
    return out


def pointers_to(column: str, datasets: dict[str, list[dict]], own: str) -> list[dict]:
    """Columns of other datasets that seem to point to this key."""
    name = column.lower()
    names = {name}
    if name == "id":
        low = own.lower()
        names |= {f"{low}_id", f"{low.removesuffix('s')}_id"}
    return [{"dataset": other, "column": p["name"], "type": p["type"]} for other, profiles in datasets.items() if other != own for p in profiles if p["name"].lower() in names and not p["is_primary_key_candidate"]]


def same_name(column: str, datasets: dict[str, list[dict]], own: str) -> list[dict]:
    return [{"dataset": other, "column": p["name"], "type": p["type"]} for other, profiles in datasets.items() if other != own for p in profiles if p["name"].lower() == column.lower()]


def drop_check(own: str, column: dict, datasets: dict[str, list[dict]], recent_calls: int | None) -> dict:
    """Five channels and the verdict of the strongest."""
    source, target = owner_of(column["name"], datasets, own), pointers_to(column["name"], datasets, own) if column["is_primary_key_candidate"] else []
    names = same_name(column["name"], datasets, own)
    verdict = "pk_blocking" if column["is_primary_key_candidate"] else "fk_blocking" if source or target else "runtime_observed" if recent_calls else "cross_dataset_blocking" if names else "safe_to_drop"
    return {"verdict": verdict, "safe": verdict == "safe_to_drop", "primary_key": column["is_primary_key_candidate"], "fk_source": source, "fk_target": target, "runtime_calls": recent_calls, "cross_dataset": names}


def impact(own: str, column: dict, datasets: dict[str, list[dict]], recent_calls: int | None, max_depth: int = 3) -> dict:
    """Who feels a change of the column: direct edges, what is behind them up to max_depth, and a score from 0 to 1."""
    links = pointers_to(column["name"], datasets, own) + owner_of(column["name"], datasets, own)
    names = same_name(column["name"], datasets, own)
    direct = {x["dataset"] for x in links + names}
    seen, level, transitive = {own} | direct, sorted(direct), []
    for depth in range(2, max_depth + 1):
        nxt = set()
        for d in level:
            for p in datasets[d]:
                if p["is_primary_key_candidate"]:
                    nxt |= {x["dataset"] for x in pointers_to(p["name"], datasets, d)}
        level = sorted(nxt - seen)
        seen |= set(level)
        transitive += [{"dataset": d, "depth": depth} for d in level]
    n = len(datasets)
    score = min(1.0, (2 * len(links) + len(names) + 0.5 * len(transitive) + 0.5 * bool(recent_calls)) / max(1.0, 0.3 * n + 1))
    return {"direct": links, "name_matches": names, "transitive": transitive, "runtime_calls": recent_calls, "blast_score": round(score, 4)}
