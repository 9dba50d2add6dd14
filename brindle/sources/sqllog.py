"""Query logs: CSV with a header or JSON Lines, gzip or not, under any of the usual column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed: names of a log's columns
ALIASES = {
    "query": ["query", "sql", "statement", "query_text", "sql_text"],
    "calls": ["calls", "count", "executions", "n_calls"],
    "total_time": ["total_time", "total_exec_time", "total_ms", "duration", "duration_ms", "total_time_ms"],
}
MAX_ROWS = 100_000


def read_log(spark: SparkSession, path: str, source: str = "auto", max_rows: int = MAX_ROWS) -> DataFrame:
    """query, calls, total_time. Rows without a query are left out."""
    plain = path.lower().removesuffix(".gz")
    kind = source if source != "auto" else "csv" if plain.endswith(".csv") else "json"
    if kind in ("csv", "pg_stat_statements"):
        df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        start = spark.read.text(path).where(F.trim("value") != "").first()
        df = spark.read.option("multiLine", bool(start) and start.value.lstrip().startswith("[")).option("mode", "DROPMALFORMED").json(path)
    low = {c.lower(): c for c in df.columns}

    def pick(name, kind):
        have = [F.col(f"`{low[a]}`").try_cast(kind) for a in ALIASES[name] if a in low]
        return F.coalesce(*have) if have else F.lit(None).cast(kind)

    out = df.select(pick("query", "string").alias("query"), F.coalesce(pick("calls", "double").cast("long"), F.lit(1)).alias("calls"), F.coalesce(pick("total_time", "double"), F.lit(0.0)).alias("total_time"))
    return out.where(F.trim("query") != "").limit(max_rows)
