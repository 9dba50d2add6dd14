"""Scores over column profiles: health, radar, hotspots, keys, drift, similar columns. A profile has one row a column."""

from __future__ import annotations

import re
from itertools import combinations


def _mean(xs, default=0.0):
    xs = list(xs)
    return sum(xs) / len(xs) if xs else default


def _constant(p: dict) -> bool:
    return (p.get("cardinality") or 0) <= 1


def grade(score: float) -> str:
    return next((g for g, least in (("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6)) if score >= least), "F")


def dataset_health(profiles: list[dict], drifted: bool = False) -> dict:
    n = len(profiles) or 1
    parts = {
        "completeness": (0.30, _mean(1 - p["null_pct"] / 100 for p in profiles)),
        "type_confidence": (0.30, _mean(p["type_confidence"] for p in profiles)),
        "variety": (0.10, 1 - sum(map(_constant, profiles)) / n),
        "primary_key": (0.10, 1.0 if any(p["is_primary_key_candidate"] for p in profiles) else 0.5),
        "semantic": (0.10, sum(bool(p.get("semantic_type")) for p in profiles) / n),
        "stability": (0.10, 0.5 if drifted else 1.0),
    }
    score = sum(w * v for w, v in parts.values())
    return {"score": round(score, 4), "grade": grade(score), "components": {k: round(v, 4) for k, (_, v) in parts.items()}}


def radar(profiles: list[dict], history: list | None = None, traffic_share: float | None = None) -> dict:
    """Axes from 0 to 100; stability needs two snapshots, coverage needs traffic."""
    n = len(profiles) or 1
    axes = {
        "null_health": 100 - _mean(p["null_pct"] for p in profiles),
        "type_confidence": 100 * _mean(p["type_confidence"] for p in profiles),
        "cardinality": max(0.0, 100 - 500 * sum(map(_constant, profiles)) / n),
        "pk": 100.0 if any(p["is_primary_key_candidate"] for p in profiles) else 50.0,
        "semantic": 100 * sum(bool(p.get("semantic_type")) for p in profiles) / n,
    }
    omitted = []
    if history and len(history) >= 2:
        axes["schema_stability"] = 50.0 if history[-1] != history[-2] else 100.0
    else:
        omitted.append("schema_stability")
    if traffic_share is None:
        omitted.append("runtime_coverage")
    else:
        axes["runtime_coverage"] = 100 * traffic_share
    axes = {k: round(v, 2) for k, v in axes.items()}
    score = round(_mean(axes.values()), 2)
    return {"axes": axes, "composite": score, "grade": grade(score / 100), "omitted_axes": omitted}


def radar_diff(before: dict, after: dict, step: float = 3.0) -> dict:
    """before and after: radars or their axes."""
    a, b = before.get("axes", before), after.get("axes", after)
    deltas = {k: round(b[k] - a[k], 2) for k in a if k in b}
    worse, better = sorted(k for k, d in deltas.items() if d <= -step), sorted(k for k, d in deltas.items() if d >= step)
    verdict = "mixed" if worse and better else "regressed" if worse else "improved" if better else "stable"
    return {"deltas": deltas, "regressions": worse, "improvements": better, "added_axes": sorted(set(b) - set(a)), "removed_axes": sorted(set(a) - set(b)), "verdict": verdict}


def _risks(p: dict) -> tuple[float, float, float]:
    null, n, d = p["null_pct"] / 100, p["count"], p.get("cardinality") or 0
    ratio = d / n if n else 0.0
    if p["type"] in ("string", "integer") and d <= 1:
        card = 0.8
    elif p["type"] == "string" and ratio > 0.95:
        card = 0.5
    else:
        card = 0.2 * ratio
    out = 0.0
    if p["type"] in ("integer", "float") and p.get("mean") not in (None, 0) and p.get("min") is not None:
        out = min((p["max"] - p["min"]) / abs(p["mean"]) / 5, 1.0)
    return null, card, out


def hotspots(profiles: list[dict], top: int = 10, calls: dict[str, float] | None = None) -> list[dict]:
    most = max(calls.values(), default=0) if calls else 0
    rows = []
    for p in profiles:
        null, card, out = _risks(p)
        if most:
            use = calls.get(p["name"], 0) / most
            score = 0.3 * null + 0.2 * card + 0.2 * out + 0.3 * use
        else:
            use, score = None, 0.4 * null + 0.3 * card + 0.3 * out
        rows.append({"column": p["name"], "score": round(score, 4), "null_risk": round(null, 4), "cardinality_risk": round(card, 4), "outlier_risk": round(out, 4), "traffic": use, "level": "high" if score >= 0.6 else "medium" if score >= 0.3 else "low"})
    return sorted(rows, key=lambda r: (-r["score"], r["column"]))[:top]


def suggest_keys(profiles: list[dict]) -> list[dict]:
    out = []
    for p in profiles:
        if p["is_unique"]:
            s = 0.6 + 0.15 * (p["type"] == "integer") + 0.2 * (p.get("semantic_type") == "uuid") + 0.1 * (p["null_count"] == 0) + 0.05 * bool(p["cardinality_is_exact"])
            out.append({"column": p["name"], "confidence": round(min(s, 1.0), 4), "type": p["type"], "null_count": p["null_count"]})
    return sorted(out, key=lambda r: (-r["confidence"], r["column"]))


def schema_drift(a: list[dict], b: list[dict], least: float = 1.0) -> dict:
    x, y = {p["name"]: p for p in a}, {p["name"]: p for p in b}
    both = [c for c in x if c in y]
    types = [{"column": c, "from": x[c]["type"], "to": y[c]["type"]} for c in both if x[c]["type"] != y[c]["type"]]
    nulls = [{"column": c, "from": x[c]["null_pct"], "to": y[c]["null_pct"], "shift": round(y[c]["null_pct"] - x[c]["null_pct"], 1)} for c in both if abs(y[c]["null_pct"] - x[c]["null_pct"]) >= least]
    added, removed = [c for c in y if c not in x], [c for c in x if c not in y]
    verdict = "breaking" if removed or types else "additive" if added or nulls else "identical"
    return {"added": added, "removed": removed, "type_changes": types, "null_shifts": nulls, "assessment": verdict}


def name_tokens(name: str) -> set[str]:
    return {w.lower() for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)) if w}


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def similar_columns(columns: list[dict], least: float = 0.5, top: int = 50, same_type: bool = False, cosine=None) -> list[dict]:
    """Pairs of columns (each with dataset, name, type, cardinality, value_index) of different datasets, best first."""
    out = []
    for a, b in combinations(columns, 2):
        if a["dataset"] == b["dataset"] or same_type and a["type"] != b["type"]:
            continue
        name = _jaccard(name_tokens(a["name"]), name_tokens(b["name"]))
        kind = 1.0 if a["type"] == b["type"] else 0.5 if {a["type"], b["type"]} == {"integer", "float"} else 0.0
        value = _jaccard(set(a["value_index"]), set(b["value_index"])) if a.get("value_index") and b.get("value_index") else 0.0
        hi = max(a["cardinality"] or 0, b["cardinality"] or 0)
        card = min(a["cardinality"] or 0, b["cardinality"] or 0) / hi if hi else 1.0
        if cosine:
            near = cosine(a, b)
            score = 0.5 * near + 0.2 * name + 0.15 * value + 0.1 * kind + 0.05 * card
        else:
            score = 0.45 * name + 0.3 * value + 0.15 * kind + 0.1 * card
        if score >= least:
            same = a["type"] == b["type"]
            verdict = "near_duplicate" if score >= 0.85 and same else "naming_drift" if score >= 0.7 and name < 0.5 else "parallel_definition" if score >= 0.7 else "overlapping_topic"
            out.append({"a": f"{a['dataset']}.{a['name']}", "b": f"{b['dataset']}.{b['name']}", "score": round(score, 4), "name_score": round(name, 4), "value_score": round(value, 4), "type_score": kind, "cardinality_score": round(card, 4), "verdict": verdict})
    return sorted(out, key=lambda r: (-r["score"], r["a"], r["b"]))[:top]


def clusters(pairs: list[dict]) -> list[list[str]]:
    """Groups of columns that pairs connect."""
    root: dict[str, str] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for p in pairs:
        root[find(p["a"])] = find(p["b"])
    groups: dict[str, list[str]] = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    return sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g))
