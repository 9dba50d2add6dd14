"""Grouped aggregates with HAVING, and approximate global ones with intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, invalid_filter
from . import predicates as P

FUNCTIONS = ("count", "count_distinct", "sum", "avg", "min", "max", "median")
MAX_GROUPS = 1000
SAMPLE_ROWS = 50_000


def _double(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.NumericType) else c.try_cast("double")


def expression(function: str, column: str, kinds: dict[str, T.DataType]) -> Column:
    if function not in FUNCTIONS:
        raise invalid_filter(f"unknown function {function!r}")
    if column == "*":
        if function != "count":
            raise invalid_filter(f"{function} needs a column")
        return F.count(F.lit(1))
    if column not in kinds:
        raise QueryError("INVALID_COLUMN", f"no column {column!r}")
    c, kind = P.col(column), kinds[column]
    if function == "count":
        return F.count(c)
    if function == "count_distinct":
        return F.count_distinct(c)
    if function in ("min", "max"):
        return getattr(F, function)(c)
    number = _double(c, kind)
    return F.percentile(number, F.lit(0.5)) if function == "median" else getattr(F, function)(number)


def default_alias(function: str, column: str) -> str:
    return f"{function}_{'all' if column == '*' else column}".replace(" ", "_")


def having_condition(having, aliases: dict[str, tuple[str, T.DataType]]) -> Column:
    """Conditions on aliases; each stands for its aggregate even where a column has the same name."""
    P.check(having, list(aliases), lambda m: QueryError("INVALID_HAVING", m))
    return reduce(lambda a, b: a & b, (P.one(F.col(aliases[h["column"]][0]), aliases[h["column"]][1], h["op"], h.get("value")) for h in having))


def aggregate(df: DataFrame, aggregations, group_by=None, filters=None, having=None, order_by: str | None = None, order_dir: str = "desc", limit: int | None = 50) -> DataFrame:
    if not aggregations:
        raise invalid_filter("no aggregations")
    kinds = {f.name: f.dataType for f in df.schema}
    keys = P.need(df, group_by or [])
    out, inner = [], {}
    for k, a in enumerate(aggregations):
        function, column = a.get("function"), a.get("column", "*")
        alias = a.get("alias") or default_alias(function, column)
        if alias in inner or alias in keys:
            raise invalid_filter(f"two results named {alias!r}")
        inner[alias] = f"_a{k}_"
        out.append(expression(function, column, kinds).alias(f"_a{k}_"))
    key_names = [f"_k{i}_" for i in range(len(keys))]
    grouped = P.where(df, filters).groupBy(*(P.col(c).alias(n) for c, n in zip(keys, key_names, strict=True))).agg(*out)
    types = {f.name: f.dataType for f in grouped.schema}
    if having:
        for h in having:
            if isinstance(h, dict) and "alias" in h:
                h.setdefault("column", h["alias"])
        grouped = grouped.where(having_condition(having, {a: (n, types[n]) for a, n in inner.items()}))
    names = dict(zip(keys, key_names, strict=True)) | inner
    if order_by is not None and order_by not in names:
        raise QueryError("INVALID_COLUMN", f"can't order by {order_by!r}")
    if limit is not None:
        by = []
        if order_by is not None:
            c = F.col(names[order_by])
            by.append(c.desc_nulls_last() if str(order_dir).lower() == "desc" else c.asc_nulls_first())
        by += [F.col(n).asc_nulls_first() for n in key_names if n != names.get(order_by)]
        grouped = (grouped.orderBy(*by) if by else grouped).limit(min(max(int(limit), 1), MAX_GROUPS))
    return grouped.select(*(F.col(n).alias(a) for a, n in names.items()))


def total_groups(df: DataFrame, aggregations, group_by=None, filters=None, having=None) -> DataFrame:
    """One row: the number of groups after HAVING."""
    return aggregate(df, aggregations, group_by, filters, having, limit=None).agg(F.count(F.lit(1)).alias("total_groups"))


def approximate(df: DataFrame, aggregations, filters=None, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """One row per aggregate: alias, value, method, low, high, ci95. Sketches for distinct counts and medians; sums and
    means from a sample with a 95 % interval (exact where the table isn't larger); counts and extremes exact."""
    base = P.where(df, filters)
    kinds = {f.name: f.dataType for f in df.schema}
    exact, sampled = [F.count(F.lit(1)).alias("n")], {}
    plan = []
    for k, a in enumerate(aggregations):
        function, column = a.get("function"), a.get("column", "*")
        alias = a.get("alias") or default_alias(function, column)
        if column == "*" and function != "count":
            raise invalid_filter(f"{function} needs a column")
        if function == "count_distinct":
            e, method = F.approx_count_distinct(P.col(column), 0.023), "hll_2pct"
        elif function == "median":
            e, method = F.percentile_approx(_double(P.col(column), kinds[column]), 0.5, 10_000), "quantile_sketch"
        elif function in ("sum", "avg"):
            e, method = F.count(_double(P.col(column), kinds[column])), "sample_95ci"
            sampled[k] = (function, column)
        else:
            e, method = expression(function, column, kinds), "exact"
        exact.append(e.cast("double" if isinstance(kinds.get(column), T.NumericType) or column == "*" or function in ("count", "count_distinct") else "string").alias(f"e{k}"))
        plan.append((k, alias, method))
    whole = base.agg(*exact).first()
    means = {}
    if sampled:
        part = base if whole.n <= sample_rows else base.sample(False, min(1.0, sample_rows / whole.n), seed)
        stats = part.agg(*(f(_double(P.col(c), kinds[c])).alias(f"{n}{k}") for k, (_, c) in sampled.items() for n, f in (("m", F.avg), ("s", F.stddev_samp), ("c", F.count)))).first()
        for k, (function, _) in sampled.items():
            m, s, c = stats[f"m{k}"], stats[f"s{k}"] or 0.0, stats[f"c{k}"]
            if m is None:
                means[k] = (None, None)
                continue
            half = 0.0 if whole.n <= sample_rows or not c else 1.96 * s / c**0.5
            scale = float(whole[f"e{k}"]) if function == "sum" else 1.0  # by values, not by rows: nulls add nothing
            means[k] = (m * scale, half * scale)
    rows = []
    for k, alias, method in plan:
        value, half = means.get(k, (whole[f"e{k}"], None))
        number = None if value is None or isinstance(value, str) else float(value)
        rows.append((alias, number, value if isinstance(value, str) else None, "exact" if k in sampled and whole.n <= sample_rows else method, half, None if half is None else number - half, None if half is None else number + half))
    return df.sparkSession.createDataFrame(rows, "alias string, value double, text_value string, method string, ci95 double, low double, high double")
