"""What a column's values mean (e-mail, URL, ...), from a few of its values and its name; advisory null tokens."""

from __future__ import annotations

import ipaddress
import re

#: fixed: value patterns
PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "url": r"^[hH][tT][tT][pP][sS]?://[^\s/$.?#][^\s]*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "phone_e164": r"^\+[1-9]\d{6,14}$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)$",
    "ipv6": r"^[0-9a-fA-F:]+$",
    "iso_country": r"^[A-Z]{2}$",
    "iso_currency": r"^[A-Z]{3}$",
    "zip_us": r"^\d{5}(?:-\d{4})?$",
    "percentage": r"^-?\d+(?:\.\d+)?\s*%$",
    "boolean_text": r"^(?:true|false|t|f|yes|no|y|n|0|1)$",
}
#: fixed: words of a column's name that these types need
NAMES = {
    "iso_country": {"country", "country_code", "iso_country", "nationality"},
    "iso_currency": {"currency", "ccy", "iso_currency", "currency_code"},
    "zip_us": {"zip", "zipcode", "postal", "postal_code", "postcode"},
    "lat": {"lat", "latitude", "y_coord"},
    "lon": {"lon", "lng", "long", "longitude", "x_coord"},
}
LEAST_SAMPLES, LEAST_SHARE = 3, 0.85
#: fixed: sentinel-like values
SENTINELS = r"^(?:9{2,}|0{2,}|-{2,}|\.{2,}|\?+|[xX]+|_+)$"
SENTINEL_WORDS = {"tbd", "unknown", "missing", "pending", "void", "noinfo", "no_info", "none", "blank", "empty", "redacted", "anonymous"}
SENTINEL_LENGTH, SENTINEL_COLUMNS, SENTINEL_SHARE, SENTINEL_TOP = 12, 2, 0.005, 10


def name_words(name: str) -> set[str]:
    return {w for w in re.split(r"[ \-./_]+", name.lower()) if w}


def _matches(kind: str, value: str) -> bool:
    if kind == "ipv6":
        try:
            return ":" in value and ipaddress.ip_address(value).version == 6
        except ValueError:
            return False
    if kind in ("lat", "lon"):
        try:
            return abs(float(value)) <= (90 if kind == "lat" else 180)
        except ValueError:
            return False
    return re.match(PATTERNS[kind], value.lower() if kind == "boolean_text" else value) is not None


def detect(logical: str, samples: list[str], name: str) -> tuple[str | None, float]:
    """(type, share of samples that match); the best share wins, at a tie the type named first above."""
    if len(samples) < LEAST_SAMPLES:
        return None, 0.0
    kinds = list(PATTERNS) if logical == "string" else ["lat", "lon", "zip_us"] if logical in ("integer", "float") else []
    words, best = name_words(name), (None, 0.0)
    for kind in kinds:
        if kind in NAMES and not words & NAMES[kind]:
            continue
        share = sum(_matches(kind, v) for v in samples) / len(samples)
        if share >= LEAST_SHARE and share > best[1]:
            best = (kind, round(share, 3))
            if logical != "string":
                break
    return best


def null_tokens(frequencies) -> "DataFrame":
    """Sentinel-looking values that recur in several columns, of (column, value, n, total): token, n_columns, n."""
    from pyspark.sql import functions as F

    v = F.trim("value")
    odd = (v.rlike(SENTINELS) | F.lower(v).isin(sorted(SENTINEL_WORDS))) & (F.length(v) <= SENTINEL_LENGTH)
    some = frequencies.where(odd & (F.col("n") >= F.col("total") * SENTINEL_SHARE))
    found = some.groupBy(v.alias("token")).agg(F.count_distinct("column").alias("n_columns"), F.sum("n").alias("n"), F.array_sort(F.collect_set("column")).alias("columns"))
    return found.where(F.col("n_columns") >= SENTINEL_COLUMNS).orderBy(F.desc("n_columns"), F.desc("n"), "token").limit(SENTINEL_TOP)
