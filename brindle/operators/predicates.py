"""Structured filters: a list of {"column", "op", "value"} joined by AND, as one Column that Catalyst can push down."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid_column, invalid_filter

COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,  # a null is neither equal nor unequal, its row goes
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
OPS = (*COMPARE, "contains", "in", "is_null", "between")


def col(name: str) -> Column:
    """A column by its whole name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value, kind: T.DataType) -> Column:
    """A literal of the column's type; the column itself is never cast, so filters still reach the scan."""
    if value is None:
        return F.lit(None)
    if isinstance(kind, T.BooleanType):
        return F.lit(value if isinstance(value, bool) else str(value).lower() in ("true", "1"))
    if isinstance(kind, T.IntegralType):
        try:  # whole numbers never pass through floats: they would be rounded beyond 2^53
            number = int(value) if isinstance(value, (str, int)) else float(value)
        except (TypeError, ValueError):
            try:
                number = float(value)
            except (TypeError, ValueError):
                raise invalid_filter(f"{value!r} is no number") from None
        number = int(number) if isinstance(number, float) and number.is_integer() else number
        return F.lit(number) if isinstance(number, float) or -(1 << 63) <= number < 1 << 63 else F.lit(str(number)).cast("decimal(38, 0)")
    if isinstance(kind, T.NumericType):
        try:
            return F.lit(float(value))
        except (TypeError, ValueError):
            raise invalid_filter(f"{value!r} is no number") from None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value if isinstance(value, (dt.date, dt.datetime)) else str(value)).cast(kind)
    return F.lit(str(value))


def check(filters, columns: list[str], code=invalid_filter) -> None:
    if not isinstance(filters, (list, tuple)):
        raise code("filters must be a list")
    for f in filters:
        if not isinstance(f, dict) or f.get("op") not in OPS:
            raise code(f"unknown op in {f!r}; one of {', '.join(OPS)}")
        if f.get("column") not in columns:
            raise code(f"no column {f.get('column')!r}")
        value = f.get("value")
        if value is None and f["op"] != "is_null":
            raise code(f"{f['op']} needs a value")
        if f["op"] == "in" and (not isinstance(value, (list, tuple)) or not value):
            raise code("in needs a list that isn't empty")
        if f["op"] == "between" and (not isinstance(value, (list, tuple)) or len(value) != 2):
            raise code("between needs two values")


def one(c: Column, kind: T.DataType, op: str, value) -> Column:
    if op in COMPARE:
        return COMPARE[op](c, literal(value, kind))
    if op == "contains":
        return F.contains(F.lower(c.cast("string")), F.lit(str(value).lower()))
    if op == "in":
        return c.isin([literal(v, kind) for v in value])
    if op == "between":
        return c.between(literal(value[0], kind), literal(value[1], kind))
    return c.isNull() if value or value is None else c.isNotNull()


def predicate(df: DataFrame, filters) -> Column:
    check(filters or [], df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    parts = [one(col(f["column"]), kinds[f["column"]], f["op"], f.get("value")) for f in filters or []]
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def where(df: DataFrame, filters) -> DataFrame:
    return df.where(predicate(df, filters)) if filters else df


def need(df: DataFrame, names) -> list[str]:
    for n in names:
        if n not in df.columns:
            raise invalid_column(n)
    return list(names)
