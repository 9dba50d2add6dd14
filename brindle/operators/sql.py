"""Read-only SQL over named tables: the first is ``rows``, others ``<name>.rows``."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError

MAX_ROWS, MAX_TABLES, TIMEOUT_S = 500, 10, 10.0
_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|replace\s+into|grant|revoke|set|use|cache|uncache|refresh|load|call|copy|vacuum|attach|detach|pragma)\b", re.I)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


def guard(text: str) -> str:
    """One SELECT (or WITH ... SELECT). Words inside literals, names and comments don't count."""
    bare = _QUOTED.sub(lambda m: " '' " if m[0][0] == "'" else " q ", text).strip()
    bare = bare.rstrip("; \n\t")
    if not re.match(r"(select|with)\b", bare, re.I):
        raise QueryError("INVALID_SQL", "only SELECT or WITH ... SELECT")
    if ";" in bare:
        raise QueryError("INVALID_SQL", "one statement only")
    if m := _WRITES.search(bare):
        raise QueryError("INVALID_SQL", f"{m[1].upper()} is not allowed")
    return text.strip().rstrip("; \n\t")


def schema_name(dataset: str) -> str:
    name = re.sub(r"[^A-Za-z0-9]", "_", dataset)
    return name if re.match(r"[A-Za-z_]", name) else f"ds_{name}"


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|([A-Za-z_]\w*)\s*\(|[(),]", re.S)
_DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def _many(of: str):
    """max and min of several arguments: null if one is null; of one argument the aggregate."""
    return lambda name, args: f"{name}({args[0]})" if len(args) < 2 else f"CASE WHEN {' OR '.join(f'({a}) IS NULL' for a in args)} THEN NULL ELSE {of}({', '.join(args)}) END"


def _joined(name: str, args: list[str]) -> str:
    distinct = re.match(r"\s*distinct\b", args[0], re.I)
    value = args[0][distinct.end() :] if distinct else args[0]
    return f"listagg({'DISTINCT ' if distinct else ''}CAST({value} AS STRING), {args[1] if len(args) > 1 else repr(',')})"


def _formatted(name: str, args: list[str]) -> str:
    pattern = re.fullmatch(r"\s*'([^']*)'\s*", args[0])
    if len(args) != 2 or not pattern or re.search("%[^YmdHMSj]", pattern[1]):
        raise QueryError("INVALID_SQL", "strftime takes a format of %Y %m %d %H %M %S %j and one date")
    parts = re.split("(%.)", pattern[1])
    return f"date_format({args[1]}, '{''.join(_DATE_PARTS.get(p) or (chr(39) * 2 + p + chr(39) * 2 if p else '') for p in parts)}')"


#: functions that Spark lacks or reads otherwise
COMPATIBLE = {
    "iif": lambda name, args: f"if({', '.join(args)})",
    "total": lambda name, args: f"coalesce(CAST(sum({args[0]}) AS DOUBLE), 0.0D)",
    "group_concat": _joined,
    "json_extract": lambda name, args: f"get_json_object({', '.join(args)})",
    "unicode": lambda name, args: f"ascii({args[0]})",
    "julianday": lambda name, args: f"(unix_micros(CAST({args[0]} AS TIMESTAMP)) / 86400000000D + 2440587.5D)",
    "strftime": _formatted,
    "max": _many("greatest"),
    "min": _many("least"),
}


def compatible(text: str) -> str:
    """The query with the calls of COMPATIBLE written for Spark; literals, names and comments stay."""

    def read(at: int, name: str | None) -> tuple[str, list[str], int]:
        """Up to the closing bracket: (text, arguments, end)."""
        args, part, last = [], "", at
        while m := _TOKEN.search(text, last):
            part += text[last : m.start()]
            last = m.end()
            if m[1] or m[0] == "(":
                inner, own, last = read(last, m[1] or "")
                change = COMPATIBLE.get((m[1] or "").lower())
                part += change(m[1], own) if change and own[0].strip() else f"{m[0]}{inner})"
            elif m[0] == ")" and name is not None:
                return ",".join([*args, part]), [a.strip() for a in [*args, part]], last
            elif m[0] == "," and name is not None:
                args.append(part)
                part = ""
            else:
                part += m[0]
        part += text[last:]
        if name is not None:
            raise QueryError("INVALID_SQL", "a bracket is not closed")
        return part, [], len(text)

    def whole() -> str:
        return read(0, None)[0]

    return whole()


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int | None = MAX_ROWS) -> DataFrame:
    """The query's rows. Views are named apart for each call, so calls don't disturb each other, and go with it. Errors of
    arithmetic and casts give null, as in the engine that users of such queries know."""
    text = compatible(guard(text))
    if len(tables) > MAX_TABLES:
        raise QueryError("INVALID_SQL", f"more than {MAX_TABLES} datasets")
    key = uuid.uuid4().hex[:8]
    parts, last = [], 0
    views = {}
    for k, (name, df) in enumerate(tables.items()):
        view = f"v{key}_{k}"
        df.createOrReplaceTempView(view)
        views["rows" if k == 0 else f"{schema_name(name)}.rows"] = view
        views.setdefault(f"{schema_name(name)}.rows", view)
    # A table name only stands outside literals and comments.
    names = re.compile("|".join(sorted((rf"(?<![\w.]){re.escape(n)}\b(?!\s*\()" for n in views), key=len, reverse=True)), re.I)
    low = {n.lower(): v for n, v in views.items()}
    frame = re.compile(r"\brows\s+(?:between|unbounded|current|\d)", re.I)

    def swap(s: str) -> str:
        at = {m.start() for m in frame.finditer(s)}
        return names.sub(lambda m: m[0] if m.start() in at else low[m[0].lower()], s)

    for m in _QUOTED.finditer(text):
        quoted = "`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`" if m[0][0] == '"' else m[0]
        parts += [swap(text[last : m.start()]), quoted]
        last = m.end()
    parts.append(swap(text[last:]))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        out = spark.sql("".join(parts))
    except Exception as e:
        raise QueryError("SQL_ERROR", str(e).splitlines()[0][:300]) from e
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
        for view in set(views.values()):  # the plan no longer needs them
            spark.catalog.dropTempView(view)
    return out if limit is None else out.limit(min(limit, MAX_ROWS))


def collect_within(df: DataFrame, seconds: float = TIMEOUT_S) -> list:
    """The rows, or QUERY_TIMEOUT: the job is cancelled by its tag."""
    sc, tag, late = df.sparkSession.sparkContext, f"sql-{uuid.uuid4().hex[:8]}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise QueryError("QUERY_TIMEOUT", f"over {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
