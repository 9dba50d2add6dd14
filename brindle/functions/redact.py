"""Masking of secrets and personal data in text columns, as expressions; SQL text scrubbing and fingerprints."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import col

#: fixed: (kind, pattern), longer and more specific ones first
PATTERNS = [
    ("private_key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----[\s\S]*?-----END[^-]*?PRIVATE KEY-----"),
    ("aws_access_key", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASCA)[0-9A-Z]{16}\b"),
    ("github_pat", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
    ("api_key_prefixed", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("api_key_openai", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("ssn", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"),
    ("credit_card", r"\b(?:\d[ -]?){12,18}\d\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"),
]
KINDS = [k for k, _ in PATTERNS]
#: what a text must hold for the pattern to match at all; a search for it costs far less
HINTS = {"private_key": "-----BEGIN ", "github_pat": "gh", "slack_token": "xox", "jwt": "eyJ", "api_key_openai": "sk-", "ssn": "-", "email": "@"}
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b"
SQL_STRING, SQL_NUMBER = r"'(?:[^'\\]|\\.|'')*'", r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b"


def mask(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def _cards(text: Column) -> Column:
    """Runs of digits that look like card numbers and pass the Luhn check."""
    return F.filter(F.regexp_extract_all(text, F.lit("(" + dict(PATTERNS)["credit_card"] + ")"), 1), lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")))


def _apply(text: Column, kind: str, pattern: str) -> Column:
    if kind == "credit_card":
        return F.when(text.rlike(pattern), F.aggregate(_cards(text), text, lambda t, m: F.replace(t, m, F.lit(mask(kind))))).otherwise(text)
    return F.regexp_replace(text, pattern, mask(kind).replace("$", r"\$"))


def _count(text: Column, kind: str, pattern: str) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(_cards(text)) if kind == "credit_card" else F.regexp_count(text, F.lit(pattern)))


def chosen(kinds=None, custom=None) -> list[tuple[str, str]]:
    out = [(k, p) for k, p in PATTERNS if kinds is None or k in kinds]
    return out + [(f"custom_{i}", p) for i, p in valid_custom(custom)[0]]


def valid_custom(custom) -> tuple[list[tuple[int, str]], list[int]]:
    """(numbered valid patterns, numbers of invalid ones)."""
    good, bad = [], []
    spark = SparkSession.getActiveSession()
    for i, p in enumerate(custom or []):
        try:
            if not isinstance(p, str):
                raise TypeError
            if spark is None:
                re.compile(p)
            else:  # the expressions that will run it are Java's
                spark._jvm.java.util.regex.Pattern.compile(p)
            good.append((i, p))
        except (re.error, TypeError, Py4JError, PySparkException):
            bad.append(i)
    return good, bad


def masked(rows) -> dict[str, int]:
    """How often each kind was masked in rows that are already redacted."""
    found: dict[str, int] = {}
    for row in rows:
        for value in row:
            for kind in re.findall(r"\[REDACTED:(\w+)\]", value) if isinstance(value, str) else ():
                found[kind] = found.get(kind, 0) + 1
    return dict(sorted(found.items()))


def redact_text(text: Column, kinds=None, custom=None) -> Column:
    for kind, pattern in chosen(kinds, custom):
        text = _apply(text, kind, pattern)
    return text


def _step(c: Column, kind: str, pattern: str, else_: Column, then) -> Column:
    hint = HINTS.get(kind)
    return F.when(F.contains(c, F.lit(hint)), then).otherwise(else_) if hint else then


def redact(df: DataFrame, skip=(), kinds=None, custom=None) -> DataFrame:
    """Text columns masked, arrays of text too; other types and skipped columns as they are. One projection a kind, so each
    step reads the one before once."""
    texts = [i for i, f in enumerate(df.schema) if f.name not in skip and isinstance(f.dataType, T.StringType)]
    lists = [i for i, f in enumerate(df.schema) if f.name not in skip and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]
    names, out = df.columns, df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    for kind, pattern in chosen(kinds, custom):
        if texts:
            out = out.withColumns({f"c{i}": _step(F.col(f"c{i}"), kind, pattern, F.col(f"c{i}"), _apply(F.col(f"c{i}"), kind, pattern)) for i in texts})
    if lists:
        out = out.withColumns({f"c{i}": F.transform(f"c{i}", lambda x: redact_text(x, kinds, custom)) for i in lists})
    return out.toDF(*names)


def redaction_counts(df: DataFrame, skip=(), kinds=None, custom=None) -> DataFrame:
    """kind, hits, cells over all text columns, in one pass. A cell is counted for what earlier kinds left of it."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    patterns = chosen(kinds, custom)
    out = df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(texts)))
    for k, (kind, pattern) in enumerate(patterns):
        new = {}
        for i in range(len(texts)):
            c = F.col(f"c{i}")
            new[f"n{k}_{i}"] = _step(c, kind, pattern, F.lit(0), _count(c, kind, pattern))
            new[f"c{i}"] = _step(c, kind, pattern, c, _apply(c, kind, pattern))
        out = out.withColumns(new) if new else out
    exprs = []
    for k in range(len(patterns)):
        each = [F.coalesce(F.col(f"n{k}_{i}"), F.lit(0)) for i in range(len(texts))]
        exprs += [F.coalesce(F.sum(sum(each, F.lit(0))), F.lit(0)).cast("long").alias(f"h{k}"), F.coalesce(F.sum(sum(((n > 0).cast("int") for n in each), F.lit(0))), F.lit(0)).cast("long").alias(f"x{k}")]
    one = out.agg(*exprs) if exprs else df.agg(F.count(F.lit(1)))
    rows = [F.struct(F.lit(kind).alias("kind"), F.col(f"h{k}").alias("hits"), F.col(f"x{k}").alias("cells")) for k, (kind, _) in enumerate(patterns)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("hits > 0")


def scrub_sql(text: Column) -> Column:
    """A query without its literals and secrets."""
    text = F.regexp_replace(text, SQL_STRING, "'?'")
    text = F.regexp_replace(text, SQL_NUMBER, "?")
    return redact_text(text, [k for k in KINDS if k != "credit_card"])


def scrub_message(text: Column) -> Column:
    return F.regexp_replace(redact_text(text), IPV4, mask("ipv4"))


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 32))
