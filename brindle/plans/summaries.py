"""Sentences about columns and tables, plans for an intent, answers cut to a budget."""

from __future__ import annotations

import json

#: fixed: words that tell an intent
INTENTS = {
    "summarize": ["summarize", "summary", "describe", "overview", "shape", "what is"],
    "anomalies": ["anomaly", "anomalies", "outlier", "outliers", "weird", "suspicious", "issue", "issues"],
    "compare": ["compare", "diff", "drift", "changed", "between"],
    "join": ["join", "merge", "link", "combine", "relate"],
    "filter": ["filter", "where", "find rows", "matching", "subset"],
    "trend": ["trend", "over time", "by month", "by year", "timeseries", "time series"],
    "correlate": ["correlate", "correlation", "relationship", "predicts"],
}
#: fixed: words of column names that tell a table's subject
DOMAINS = {
    "geographic": {"lat", "lon", "latitude", "longitude", "city", "state", "country", "zip", "address", "region"},
    "financial": {"price", "amount", "cost", "revenue", "total", "balance", "currency", "tax", "discount"},
    "log": {"level", "message", "host", "ip", "status", "request", "user_agent"},
    "event": {"event", "event_type", "session", "action", "user_id"},
}
BYTES_PER_TOKEN, BUDGET, BUDGET_TOP = 4, 8000, 16000


def column_summary(p: dict) -> str:
    kind = p.get("semantic_type") or p["type"]
    parts = [f"{p['name']}: {kind}"]
    if p["null_count"]:
        parts.append(f"{p['null_pct']:g} % null")
    if p["is_primary_key_candidate"]:
        parts.append("unique, may be the key")
    elif p.get("cardinality") is not None:
        parts.append(f"{'' if p.get('cardinality_is_exact') else 'about '}{p['cardinality']} distinct")
    if p["type"] in ("integer", "float", "datetime") and p.get("min") is not None:
        parts.append(f"from {p['min']:g} to {p['max']:g}" if p["type"] != "datetime" else f"from {p['min']} to {p['max']}")
    elif p.get("top_values"):
        parts.append("mostly " + ", ".join(t["value"][:40] for t in p["top_values"][:3]))
    return "; ".join(parts)


def dataset_summary(name: str, rows: int, profiles: list[dict]) -> str:
    kinds = {}
    for p in profiles:
        kinds[p["type"]] = kinds.get(p["type"], 0) + 1
    words = {w for p in profiles for w in [p["name"].lower(), *p["name"].lower().split("_")]}
    domain = max(DOMAINS, key=lambda d: len(DOMAINS[d] & words))
    if not DOMAINS[domain] & words:
        domain = "temporal" if "datetime" in kinds else ""
    told = ", ".join(f"{n} {k}" for k, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0])))
    return f"{name}: {rows} rows, {len(profiles)} columns ({told})" + (f"; looks {domain}" if domain else "")


def intent_of(text: str) -> str:
    low = (text or "").lower()
    hits = {k: sum(w in low for w in words) for k, words in INTENTS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] else "summarize"


def steps_for(intent: str, dataset: str, types: set[str], text: str = "") -> list[dict]:
    d = {"dataset": dataset}
    step = lambda tool, why, **args: {"tool": tool, "args": d | args, "why": why}
    describe = lambda why: [step("describe_dataset", why)]
    if intent == "trend" and "datetime" not in types:
        return describe("No column holds dates, a trend needs one.")
    if intent == "correlate" and not types & {"integer", "float"}:
        return describe("No column holds numbers.")
    plans = {
        "summarize": [step("describe_dataset", "Schema and profile first."), step("get_dataset_health", "One grade for quality."), step("sample_rows", "See what rows look like.", n=5)],
        "anomalies": [step("get_data_hotspots", "Which columns are at risk.", top_n=10), step("describe_column", "Look closely at the first.", column="<top hotspot>")],
        "compare": [{"tool": "get_schema_drift", "args": {"dataset_a": dataset, "dataset_b": "<other>"}, "why": "Columns that came, went or changed."}, step("get_dataset_history", "How it changed over time.", n=10)],
        "join": [step("suggest_keys", "Find the key."), step("suggest_joins", "Find columns that hold other tables' keys."), {"tool": "join_datasets", "args": {"dataset_a": dataset, "dataset_b": "<target>", "join_column_a": "<src>", "join_column_b": "<target_pk>"}, "why": "Join them."}],
        "filter": [step("search_data", "Which columns and values are meant.", query=text or intent), step("get_rows", "Fetch the rows.", filters=[])],
        "trend": [step("get_distribution", "Counts over time.", column="<datetime col>"), step("aggregate", "Counts by period.", aggregations=[{"column": "*", "function": "count", "alias": "n"}], group_by=["<datetime col>"])],
        "correlate": [step("get_correlations", "Linear relations.", method="pearson"), step("get_correlations", "Monotonic relations.", method="spearman")],
    }
    return plans[intent]


def trim_to_budget(answer: dict, tokens: int = BUDGET) -> dict:
    """The answer with its longest list cut so that it fits, and a note of how much was left out."""
    tokens = min(tokens, BUDGET_TOP)
    size = lambda a: len(json.dumps(a, default=str)) / BYTES_PER_TOKEN
    if size(answer) <= tokens:
        return answer
    result = answer.get("result")
    lists = {k: v for k, v in result.items() if isinstance(v, list)} if isinstance(result, dict) else {}
    if not lists:
        return answer
    key = max(lists, key=lambda k: len(json.dumps(lists[k], default=str)))
    lo, hi = 0, len(lists[key])
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if size(answer | {"result": result | {key: lists[key][:mid]}}) <= tokens - 20 else (lo, mid - 1)
    meta = dict(answer.get("_meta", {})) | {"truncated": {key: {"shown": lo, "total": len(lists[key])}}}
    return answer | {"result": result | {key: lists[key][:lo]}, "_meta": meta}
