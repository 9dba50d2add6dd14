"""The engine: one method per tool, dicts in and out: {"result": ..., "_meta": ...} or {"error": ...}."""

from __future__ import annotations

import functools
import json
import os
import time
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, invalid_column
from ..functions import infer as I
from ..functions import redact as R
from ..functions.text import hash_embedding
from ..operators import aggregate as A
from ..operators import join as J
from ..operators import predicates as P
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import rows as RW
from ..operators import search as S
from ..operators import sql as SQL
from ..operators import statistics as ST
from ..operators import traffic as TR
from ..sources import directory, readers, sqllog
from . import summaries as SU
from .catalog import RULES, Catalog, file_hash

MAX_ROWS, SHALLOW_ROWS = 5_000_000, 100_000
CANARIES = ["name", "customer id", "order date", "total price", "city", "country code", "e-mail address", "phone number", "latitude", "status", "category", "created at", "quantity", "description", "url", "score"]


def tool(f):
    """Errors become answers; each call's time is kept for analyze_perf."""

    @functools.wraps(f)
    def run(self, *args, **kwargs):
        began = time.perf_counter()
        try:
            out = {"result": f(self, *args, **kwargs)}
        except QueryError as e:
            out = {"error": str(e)}
        ms = round(1000 * (time.perf_counter() - began), 1)
        self.calls.append({"tool": f.__name__, "ms": ms, "ok": "error" not in out, "at": time.time(), "bytes": len(json.dumps(out, default=str))})
        return SU.trim_to_budget(out | {"_meta": {"timing_ms": ms}}, self.budget)

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, budget: int = SU.BUDGET, embed=hash_embedding, model: str = "hash-128"):
        self.spark, self.catalog, self.budget, self.embed, self.model = spark, Catalog(spark, root), budget, embed, model
        self.calls: deque = deque(maxlen=500)
        self.cache: dict = {}

    # helpers ----------------------------------------------------------
    def _rows(self, df: DataFrame, fmt: str = "arrays") -> dict | list:
        rows = df.collect()
        return {"fields": df.columns, "rows": [list(r) for r in rows]} if fmt == "arrays" else [r.asDict() for r in rows]

    def _masked(self, rows, redact: bool, patterns=None) -> dict:
        """What was masked in the rows of an answer, and the numbers of patterns that can't be used."""
        if not redact:
            return {}
        bad = R.valid_custom(patterns)[1]
        lists = rows["rows"] if isinstance(rows, dict) else [r.values() if isinstance(r, dict) else r for r in rows]
        return {"redactions": R.masked(lists)} | ({"invalid_redact_patterns": bad} if bad else {})

    def _redacted(self, df: DataFrame, redact: bool, patterns=None, skip=None) -> DataFrame:
        return R.redact(df, skip or (), None, patterns) if redact else df

    def _profile(self, dataset: str, column: str) -> dict:
        for p in self.catalog.profiles(dataset):
            if p["name"] == column:
                return p
        raise invalid_column(column)

    def _all(self) -> dict[str, list[dict]]:
        return {d: self.catalog.profiles(d) for d in self.catalog.names()}

    def _cached(self, key: tuple, dataset: str, make):
        key = (*key, self.catalog.manifest(dataset)["fingerprint"], self.catalog.manifest(dataset)["rows"])
        key = json.dumps(key, sort_keys=True, default=str)
        if key not in self.cache:
            self.cache[key] = make()
        return self.cache[key]

    # ingest and catalog -------------------------------------------------
    @tool
    def index_local(self, path: str, name: str | None = None, incremental: bool = True, encoding=None, delimiter=None, header_row: int = 0, sheet=None, depth: str = "standard", max_rows: int = MAX_ROWS):
        name = name or os.path.splitext(os.path.basename(path.rstrip("/")))[0].lower().replace(" ", "-")
        digest = file_hash(path)
        if incremental and name in self.catalog.names():
            m = self.catalog.manifest(name)
            if m.get("source_sha256") == digest is not None and m.get("rules") == RULES:
                return {"dataset": name, "skipped": True, "row_count": m["row_count"]}
        df, facts = readers.read(self.spark, path, encoding, delimiter, header_row, sheet)
        numbered = RW.with_row_ids(df)
        cap = min(max_rows, SHALLOW_ROWS) if depth == "shallow" else max_rows
        total = numbered.count()
        if total > cap:
            numbered = numbered.where(P.col(RW.ROW_ID) <= cap)
        columns = PR.profile(numbered)
        for p in columns:
            p["summary"] = SU.column_summary(p)
        text = all(k == "string" for _, k in df.dtypes)
        stored = I.typed(numbered, {p["name"]: p["type"] for p in columns}, keep=(RW.ROW_ID,)) if text else numbered
        m = self.catalog.save(name, stored, columns, source=path, source_sha256=digest, malformed_rows=facts["malformed_rows"], walk="truncated" if total > cap else "full", summary=SU.dataset_summary(name, min(total, cap), columns), learned_null_tokens=PR.learned_null_tokens(columns))
        if depth == "deep":
            self.get_correlations(name)
        return {"dataset": name, "row_count": m["row_count"], "column_count": m["column_count"], "coverage": {"walk": m["walk"], "rows_indexed": m["row_count"], "rows_total": total, "skip_counts": {"malformed_rows": facts["malformed_rows"]}}, "summary": m["summary"]}

    @tool
    def index_repo(self, path: str, owner: str = "local", repo: str | None = None, incremental: bool = True):
        """A checked-out tree of files; fetching it over the network is left to the caller."""
        files, skipped = directory.discover(path)
        repo = repo or os.path.basename(path.rstrip("/"))
        done = [self.index_local(f, directory.dataset_id(owner, repo, f), incremental) for f in files]
        out = {"repo": f"{owner}/{repo}", "datasets": [d["result"]["dataset"] for d in done if "result" in d], "errors": [d["error"] for d in done if "error" in d], "skipped": skipped}
        self.catalog.write_text(f"{self.catalog.root}/_repos/{owner}--{repo}.json", json.dumps(out))
        return out

    @tool
    def list_datasets(self):
        return {"datasets": [{k: m.get(k) for k in ("dataset", "row_count", "column_count", "indexed_at", "summary")} for m in map(self.catalog.manifest, self.catalog.names())]}

    @tool
    def list_repos(self):
        names = sorted({"/".join(d.split("--")[:2]) for d in self.catalog.names() if d.count("--") >= 2})
        return {"repos": [{"repo": r, "datasets": [d for d in self.catalog.names() if d.startswith(r.replace("/", "--") + "--")]} for r in names]}

    @tool
    def delete_dataset(self, dataset: str):
        return {"dataset": dataset, "deleted": self.catalog.delete(dataset)}

    @tool
    def validate_index(self, dataset: str):
        return {"dataset": dataset} | self.catalog.validate(dataset)

    @tool
    def get_dataset_history(self, dataset: str, n: int = 10):
        return {"dataset": dataset, "history": self.catalog.history(dataset, n)}

    @tool
    def summarize_dataset(self, dataset: str):
        m = self.catalog.manifest(dataset)
        return {"dataset": dataset, "summary": SU.dataset_summary(dataset, m["row_count"], m["columns"]), "columns": {p["name"]: SU.column_summary(p) for p in m["columns"]}}

    # profile --------------------------------------------------------------
    @tool
    def describe_dataset(self, dataset: str, columns=None, columns_offset: int = 0, detail: str = "compact"):
        m = self.catalog.manifest(dataset)
        chosen = [p for p in m["columns"] if not columns or p["name"] in columns]
        missing = sorted(set(columns or ()) - {p["name"] for p in m["columns"]})
        if missing:
            raise invalid_column(missing[0])
        page = chosen[columns_offset : columns_offset + 60]
        keys = ("name", "type", "null_pct", "cardinality", "is_primary_key_candidate", "semantic_type", "min", "max", "summary")
        return {"dataset": dataset, "row_count": m["row_count"], "column_count": m["column_count"], "columns": page if detail == "full" else [{k: p.get(k) for k in keys if p.get(k) is not None} for p in page], "next_offset": columns_offset + 60 if columns_offset + 60 < len(chosen) else None, "summary": m.get("summary"), "learned_null_tokens": m.get("learned_null_tokens") or []}

    @tool
    def describe_column(self, dataset: str, column: str, top_n: int | None = None, histogram_bins: int = 10, redact: bool = True, redact_patterns=None, verify_source: bool = False, detail: str = "compact"):
        p = dict(self._profile(dataset, column))
        df = self.catalog.rows(dataset)
        out = p if detail == "full" else {k: p.get(k) for k in ("name", "type", "count", "null_count", "null_pct", "cardinality", "min", "max", "mean", "median", "std_dev", "quantiles", "semantic_type", "summary", "null_tokens", "type_violation_samples") if p.get(k) not in (None, {}, [])}
        top = (p.get("top_values") or [])[: min(top_n or 20, 200)]
        out["column_id"] = f"{dataset}::{column}#column"
        out["value_distribution"] = [t | {"pct": round(100 * t["count"] / p["count"], 2)} for t in top] if p["count"] else []
        if p["type"] in ("integer", "float"):
            out["histogram"] = [r.asDict() for r in ST.histogram(df, column, min(histogram_bins, 50)).orderBy("bin").collect()]
        if redact and p["type"] == "string":
            for key in ("value_distribution",):
                if out[key]:
                    masked = R.redact(self.spark.createDataFrame([(t["value"],) for t in out[key]], "value string"), (), None, redact_patterns).collect()
                    out[key] = [t | {"value": r.value} for t, r in zip(out[key], masked, strict=True)]
        if verify_source:
            m = self.catalog.manifest(dataset)
            now = file_hash(m.get("source") or "")
            out["source"] = "missing" if now is None else "fresh" if now == m.get("source_sha256") else "changed"
        return out

    @tool
    def get_distribution(self, dataset: str, column: str, bins: int = 20):
        kind = self._profile(dataset, column)["type"]
        df = ST.distribution(self.catalog.rows(dataset), column, bins, kind)
        df = df.orderBy("bin") if "bin" in df.columns else df
        return {"dataset": dataset, "column": column, "type": kind, "buckets": self._rows(df, "objects")}

    @tool
    def get_correlations(self, dataset: str, min_abs_correlation: float = 0.3, columns=None, top_n: int = 20, method: str = "pearson"):
        df = self.catalog.rows(dataset)
        make = lambda: self._rows(ST.correlations(df.drop(RW.ROW_ID) if method == "pearson" else df, columns or [c for c, t in df.dtypes if c != RW.ROW_ID], method, min_abs_correlation, top_n, () if method == "pearson" else (RW.ROW_ID,)), "objects")
        return {"dataset": dataset, "method": method, "correlations": self._cached(("correlations", min_abs_correlation, columns, top_n, method), dataset, make)}

    @tool
    def sample_rows(self, dataset: str, n: int = 5, method: str = "head", seed: int | None = None, columns=None, redact: bool = True, redact_patterns=None, redact_skip_columns=None):
        df = RW.sample_rows(self.catalog.rows(dataset), n, method, seed, columns)
        rows = self._rows(self._redacted(df, redact, redact_patterns, redact_skip_columns))
        return {"dataset": dataset, "method": method} | rows | self._masked(rows, redact, redact_patterns)

    # query ------------------------------------------------------------------
    @tool
    def get_rows(self, dataset: str, filters=None, columns=None, order_by=None, order_dir="asc", limit=50, offset=0, redact=True, redact_patterns=None, redact_skip_columns=None, row_format="arrays"):
        df = self.catalog.rows(dataset)
        page = RW.get_rows(df, filters, columns, order_by, order_dir, limit, offset)
        rows = self._rows(self._redacted(page, redact, redact_patterns, redact_skip_columns), row_format)
        total = P.where(df, filters).count()
        omitted = [] if columns else [c for c in df.columns if c != RW.ROW_ID][RW.AUTO_COLUMNS :]
        return {"dataset": dataset, "total_matching": total, "omitted_columns": omitted} | (rows if row_format == "arrays" else {"rows": rows}) | self._masked(rows, redact, redact_patterns)

    @tool
    def aggregate(self, dataset: str, aggregations, group_by=None, filters=None, having=None, order_by=None, order_dir="desc", limit=50, approximate=False, redact=True, redact_patterns=None, redact_skip_columns=None):
        df = self.catalog.rows(dataset)
        if approximate:
            if group_by or having or order_by:
                raise QueryError("INVALID_FILTER", "approximate mode is for the whole table")
            return {"dataset": dataset, "approximate": self._rows(A.approximate(df, aggregations, filters), "objects")}

        def make():
            out = A.aggregate(df, aggregations, group_by, filters, having, order_by, order_dir, limit)
            total = A.total_groups(df, aggregations, group_by, filters, having).first()[0]
            groups = self._rows(self._redacted(out, redact, redact_patterns, redact_skip_columns), "objects")
            return {"total_groups": total, "groups": groups} | self._masked(groups, redact, redact_patterns)

        return {"dataset": dataset} | self._cached(("aggregate", aggregations, group_by, filters, having, order_by, order_dir, limit, redact, redact_patterns, redact_skip_columns), dataset, make)

    @tool
    def join_datasets(self, dataset_a: str, dataset_b: str, join_column_a: str | None = None, join_column_b: str | None = None, join_type: str = "inner", columns_a=None, columns_b=None, filters_a=None, filters_b=None, limit=50, offset=0, order_by=None, order_dir="asc", filter_mode="where", redact=True):
        joined = lambda by: J.join(self.catalog.rows(dataset_a).drop(RW.ROW_ID), self.catalog.rows(dataset_b).drop(RW.ROW_ID), join_column_a, join_column_b, join_type, columns_a, columns_b, filters_a, filters_b, filter_mode, by, order_dir, None)
        df, total = joined(order_by), joined(None).count()  # counted without the order
        rows = self._rows(self._redacted((df.offset(offset) if offset else df).limit(min(limit, 500)), redact))
        return {"total": total} | rows | self._masked(rows, redact)

    @tool
    def run_sql(self, sql: str, datasets, limit: int = 500, redact: bool = True, redact_patterns=None, redact_skip_columns=None):
        tables = {d: self.catalog.rows(d) for d in datasets}
        df = SQL.run_sql(self.spark, sql, tables, limit)
        df = self._redacted(df, redact, redact_patterns, redact_skip_columns)
        rows = {"fields": df.columns, "rows": [list(r) for r in SQL.collect_within(df)]}
        return rows | self._masked(rows, redact, redact_patterns)

    @tool
    def plan_query(self, dataset: str, intent: str = "summarize"):
        kind = SU.intent_of(intent)
        plan = SU.steps_for(kind, dataset, {p["type"] for p in self.catalog.profiles(dataset)}, intent)
        return {"dataset": dataset, "intent": intent, "resolved_intent": kind, "step_count": len(plan), "plan": plan}

    @tool
    def search_data(self, dataset: str, query: str, search_scope: str = "all", max_results: int = 10, semantic: bool = False, semantic_weight: float | None = None, semantic_only: bool = False):
        profiles, vectors = self.catalog.profiles(dataset), None
        if semantic or semantic_only:
            t = self.catalog.table(dataset, "embeddings")
            vectors = {r.column: list(r.vector) for r in t.collect()} if t is not None else {p["name"]: self.embed(p["name"].replace("_", " ")) for p in profiles}
        hits = S.search(profiles, query, search_scope, max_results, S.effective(self._tuning().get("*"), self._tuning().get(dataset)), vectors, semantic_weight, semantic_only, self.embed)
        return {"dataset": dataset, "query": query, "results": hits, "verdict": "ok" if hits else "absent", "near_misses": [] if hits else S.near_misses(profiles, query)}

    def _tuning(self) -> dict:
        return json.loads(self.catalog.read_text(f"{self.catalog.root}/_tuning.json") or "{}")

    @tool
    def tune_weights(self, action: str = "inspect", dataset: str | None = None, weights: dict | None = None):
        tuned, key = self._tuning(), dataset or "*"
        if action == "set":
            try:
                tuned[key] = tuned.get(key, {}) | S.clamp(weights or {})
            except KeyError as e:
                raise QueryError("INVALID_WEIGHT", str(e)) from e
        elif action == "reset":
            tuned.pop(key, None)
        if action in ("set", "reset"):
            self.catalog.write_text(f"{self.catalog.root}/_tuning.json", json.dumps(tuned))
        return {"weights": S.effective(tuned.get("*"), tuned.get(dataset) if dataset else None), "overrides": tuned}

    # quality -------------------------------------------------------------------
    def _drifted(self, dataset: str) -> bool:
        h = self.catalog.history(dataset, 2)
        kinds = [{c: x["type"] for c, x in s["columns"].items()} for s in h]
        return len(kinds) > 1 and kinds[-1] != kinds[-2]

    @tool
    def get_dataset_health(self, dataset: str):
        return {"dataset": dataset} | Q.dataset_health(self.catalog.profiles(dataset), self._drifted(dataset))

    @tool
    def data_health_radar(self, dataset: str, include_runtime: bool = True, window_days: int = 30):
        kinds = [{c: x["type"] for c, x in s["columns"].items()} for s in self.catalog.history(dataset, 2)]
        profiles, share = self.catalog.profiles(dataset), None
        calls = self._calls(dataset, window_days) if include_runtime else None
        if calls is not None:
            share = sum(p["name"].lower() in calls for p in profiles) / max(len(profiles), 1)
        return {"dataset": dataset} | Q.radar(profiles, kinds, share)

    @tool
    def diff_data_health_radar(self, baseline: dict, current: dict):
        return Q.radar_diff(baseline.get("result", baseline), current.get("result", current))

    @tool
    def get_data_hotspots(self, dataset: str, top_n: int = 10, include_runtime: bool = True, window_days: int = 30):
        calls = self._calls(dataset, window_days) if include_runtime else None
        named = {p["name"]: calls.get(p["name"].lower(), 0) for p in self.catalog.profiles(dataset)} if calls else None
        return {"dataset": dataset, "hotspots": Q.hotspots(self.catalog.profiles(dataset), top_n, named)}

    @tool
    def get_schema_drift(self, dataset_a: str, dataset_b: str):
        return Q.schema_drift(self.catalog.profiles(dataset_a), self.catalog.profiles(dataset_b))

    @tool
    def suggest_keys(self, dataset: str):
        return {"dataset": dataset, "keys": Q.suggest_keys(self.catalog.profiles(dataset))}

    @tool
    def suggest_joins(self, dataset: str):
        out, others = [], [(d, p) for d, ps in self._all().items() if d != dataset for p in ps if p["is_primary_key_candidate"]][:20]
        for p in self.catalog.profiles(dataset):
            if p["type"] in ("integer", "string") and p["null_pct"] <= 50 and (p["cardinality"] or 0) >= 5:
                targets = {d: (self.catalog.rows(d), k["name"]) for d, k in others if k["type"] == p["type"]}
                if targets:
                    out += [{"column": p["name"]} | r.asDict() for r in J.suggest_joins(self.catalog.rows(dataset), p["name"], targets).collect()]
        return {"dataset": dataset, "joins": sorted(out, key=lambda r: (-r["containment"], r["column"], r["target"]))}

    @tool
    def find_similar_columns(self, datasets=None, min_score: float = 0.5, top_n: int = 50, same_type_only: bool = False):
        columns = [p | {"dataset": d} for d in datasets or self.catalog.names() for p in self.catalog.profiles(d)]
        pairs = Q.similar_columns(columns, min_score, top_n, same_type_only)
        return {"pairs": pairs, "clusters": Q.clusters(pairs)}

    # traffic ----------------------------------------------------------------------
    def _cutoff(self, days: int):
        return self.spark.range(1).select((F.current_timestamp() - F.make_dt_interval(F.lit(int(days)))).alias("t")).first().t

    def _calls(self, dataset: str, days: int) -> dict[str, int] | None:
        t = self.catalog.table(dataset, "traffic")
        if t is None:
            return None
        return {r.column_name: r.recent_calls for r in TR.windowed(t, self._cutoff(days)).where("column_name <> ''").groupBy("column_name").agg(F.sum("recent_calls").alias("recent_calls")).collect() if r.recent_calls}

    @tool
    def ingest_sql_log(self, file_path: str, source: str = "auto", redact: bool = True, max_rows: int = sqllog.MAX_ROWS):
        if not os.path.exists(file_path):
            raise QueryError("FILE_NOT_FOUND", file_path)
        log = sqllog.read_log(self.spark, file_path, source, max_rows)
        rolled = TR.rollup(log).persist()
        known = {d.lower(): d for d in self.catalog.names()}
        tables = {r.table_name for r in rolled.select("table_name").distinct().collect()}
        for t in tables & set(known):
            d = known[t]
            new, old = rolled.where(F.col("table_name") == t), self.catalog.table(d, "traffic")
            self.catalog.put_table(d, "traffic", TR.merge(old, new) if old is not None else new)
            hits = R.redaction_counts(log.select("query")).withColumn("seen_at", F.current_timestamp()).withColumn("source", F.lit("sql_log"))
            before = self.catalog.table(d, "redactions")
            self.catalog.put_table(d, "redactions", before.unionByName(hits) if before is not None else hits)
        out = {"queries": log.count(), "tables": sorted(tables), "matched": sorted(known[t] for t in tables & set(known)), "unresolved": sorted(tables - set(known))}
        rolled.unpersist()
        return out

    @tool
    def get_redaction_log(self, dataset_id: str, source: str | None = None, since_days: int = 30):
        self.catalog.manifest(dataset_id)
        t = self.catalog.table(dataset_id, "redactions")
        if t is None:
            return {"dataset": dataset_id, "patterns": []}
        t = t.where(F.col("seen_at") >= F.lit(self._cutoff(since_days)))
        t = t.where(F.col("source") == source) if source else t
        return {"dataset": dataset_id, "patterns": self._rows(t.groupBy("kind").agg(F.sum("hits").alias("hits"), F.max("seen_at").cast("string").alias("last_seen")).orderBy(F.desc("hits"), "kind"), "objects")}

    @tool
    def find_unused_columns(self, dataset_id: str, window_days: int = 30, min_calls: int = 0, exclude_pk: bool = True, exclude_audit: bool = True):
        profiles, t = self.catalog.profiles(dataset_id), self.catalog.table(dataset_id, "traffic")
        if t is None:
            raise QueryError("NO_RUNTIME_DATA", "ingest a query log first")
        frame = PR.profile_frame(self.spark, profiles)
        return {"dataset": dataset_id, "unused": self._rows(TR.unused_columns(frame, t, dataset_id, self._cutoff(window_days), min_calls, exclude_pk, exclude_audit).orderBy("column"), "objects")}

    @tool
    def check_column_drop_safe(self, dataset_id: str, column: str, window_days: int = 30):
        calls = self._calls(dataset_id, window_days)
        return {"dataset": dataset_id, "column": column} | TR.drop_check(dataset_id, self._profile(dataset_id, column), self._all(), None if calls is None else calls.get(column.lower(), 0))

    @tool
    def get_schema_impact(self, dataset_id: str, column: str, kind: str = "drop_column", new_name: str | None = None, new_type: str | None = None, max_depth: int = 3, window_days: int = 30):
        if kind not in ("drop_column", "rename_column", "change_type"):
            raise QueryError("INVALID_KIND", kind)
        if kind == "rename_column" and not new_name or kind == "change_type" and not new_type:
            raise QueryError("INVALID_KIND", f"{kind} needs a new name or type")
        calls = self._calls(dataset_id, window_days)
        return {"dataset": dataset_id, "column": column, "kind": kind} | TR.impact(dataset_id, self._profile(dataset_id, column), self._all(), None if calls is None else calls.get(column.lower(), 0), max_depth)

    # embeddings ----------------------------------------------------------------------
    @tool
    def embed_dataset(self, dataset: str, force: bool = False):
        old = self.catalog.table(dataset, "embeddings")
        have = {r.column for r in old.where(F.col("model") == self.model).collect()} if old is not None and not force else set()
        profiles = self.catalog.profiles(dataset)
        if {p["name"] for p in profiles} == have:
            return {"dataset": dataset, "embedded": 0, "kept": len(have)}
        rows = [(p["name"], self.model, [float(x) for x in self.embed(f"{p['name'].replace('_', ' ')} {p.get('semantic_type') or p['type']} {p.get('summary') or ''}")]) for p in profiles]
        self.catalog.put_table(dataset, "embeddings", self.spark.createDataFrame(rows, "column string, model string, vector array<float>"))
        return {"dataset": dataset, "embedded": len(rows), "kept": 0}

    @tool
    def check_embedding_drift(self, force: bool = False, threshold: float = 0.05):
        path = f"{self.catalog.root}/_canaries.json"
        now = {c: [float(x) for x in self.embed(c)] for c in CANARIES}
        old = json.loads(self.catalog.read_text(path) or "null")
        if old is None or force:
            self.catalog.write_text(path, json.dumps(now))
            return {"status": "baseline", "canaries": len(now)}
        cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1.0)
        far = max(1 - cos(old[c], now[c]) for c in CANARIES if c in old)
        return {"status": "drift" if far > threshold else "ok", "max_distance": round(far, 6)}

    # session ------------------------------------------------------------------------
    @tool
    def get_session_stats(self):
        return {"calls": len(self.calls), "errors": sum(not c["ok"] for c in self.calls), "response_bytes": sum(c["bytes"] for c in self.calls), "by_tool": {t: sum(c["tool"] == t for c in self.calls) for t in sorted({c["tool"] for c in self.calls})}}

    @tool
    def analyze_perf(self, window: str = "session", top: int = 20, tool: str | None = None):
        span = {"session": None, "1h": 3600, "24h": 86400, "7d": 604800, "all": None}
        if window not in span:
            raise QueryError("INVALID_WINDOW", f"{window!r}: {', '.join(span)}")
        since = time.time() - span[window] if span[window] else 0
        rows = [(c["tool"], float(c["ms"])) for c in self.calls if c["at"] >= since and tool in (None, c["tool"])]
        return {"window": window, "tools": self._rows(TR.latency(self.spark.createDataFrame(rows, "tool string, ms double")).limit(top), "objects") if rows else []}

    @tool
    def finalize_handoff(self, dataset: str, task: str, sections: dict, evidence_refs=(), **_):
        m = self.catalog.manifest(dataset)
        return {"dataset": dataset, "task": task, "fingerprint": m["fingerprint"], "sections": sections, "evidence_refs": list(evidence_refs)}

    @tool
    def guide(self):
        return {"tools": {n: (getattr(Engine, n).__doc__ or n.replace("_", " ")) for n in dir(Engine) if not n.startswith("_") and callable(getattr(Engine, n))}}
