"""Logical types of text values: integer < float < datetime < string, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed: tokens that are null in any column
HARD_NULLS = ["", "null", "NULL", "None", "N/A", "n/a", "NA", "NaN", "nan", "#N/A", "#NA", "#NULL!"]
#: fixed: tokens that are null in columns that aren't text
PLACEHOLDERS = ["-", ".", "none", "na", "n.a.", "N.A."]
TYPES = ["integer", "float", "datetime", "string"]

INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT = r"^[+-]?(([0-9]+(_[0-9]+)*)?\.?[0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.)([eE][+-]?[0-9]+(_[0-9]+)*)?$|^[+-]?(inf|infinity)$"
#: fixed: (pattern, label, how Spark parses the matched part); the first that matches counts
DATETIMES = [
    (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d", "yyyy-MM-dd", r"^(.*)$"),
    (r"^\d{2}/\d{2}/\d{4}$", "%m/%d/%Y", "MM/dd/yyyy", r"^(.*)$"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "%m/%d/%Y %I:%M:%S %p", "M/d/yyyy h:mm:ss a", r"^(.*)$"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}", "%m/%d/%Y %H:%M:%S", "MM/dd/yyyy HH:mm:ss", r"^(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})"),
]


def canonical(c: Column, kind: T.DataType) -> Column:
    """One text form for values of any source, so the same data profiles the same from text and typed files."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (F.floor(d) == d) & (F.abs(d) < 1e16)
        return F.when(F.isnan(d) | d.isNull(), F.lit(None)).when(whole, d.cast("decimal(17,0)").cast("string")).otherwise(d.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(F.date_trunc("day", c) == c, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    if isinstance(kind, T.DecimalType):
        return F.rtrim(c.cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    return c.cast("string")


def canonical_frame(df: DataFrame) -> DataFrame:
    from ..operators.predicates import col

    return df.select(*(canonical(col(f.name), f.dataType).alias(f.name) for f in df.schema))


def stripped(c: Column) -> Column:
    """The text without blanks around it; null where it says so."""
    t = F.trim(c)
    return F.when(~t.isin(HARD_NULLS), t)


def is_placeholder(t: Column) -> Column:
    return t.isin(PLACEHOLDERS)


def datetime_of(t: Column) -> Column:
    """The moment a recognised text names; null if none."""
    out = F.lit(None).cast("timestamp")
    for pattern, _, fmt, part in reversed(DATETIMES):
        out = F.when(t.rlike(pattern), F.try_to_timestamp(F.regexp_extract(t, part, 1), F.lit(fmt.split("[")[0]))).otherwise(out)
    return out


def datetime_label(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label, _, _ in reversed(DATETIMES):
        out = F.when(t.rlike(pattern), label).otherwise(out)
    return out


def rank(t: Column) -> Column:
    """0 integer, 1 float, 2 datetime, 3 string; null for null. The patterns decide, not what a cast would accept."""
    date = None
    for pattern, *_ in DATETIMES:
        date = t.rlike(pattern) if date is None else date | t.rlike(pattern)
    return F.when(t.isNull(), None).when(t.rlike(INTEGER), 0).when(F.lower(t).rlike(FLOAT), 1).when(date, 2).otherwise(3)


def number(t: Column) -> Column:
    """The value of an integer or float text."""
    plain = F.replace(t, F.lit("_"), F.lit(""))
    return F.when(t.rlike(INTEGER) | F.lower(t).rlike(FLOAT), plain.try_cast("double"))


def infer_types(text: DataFrame) -> dict[str, str]:
    """Logical type of each text column, from all rows in one pass."""
    from ..operators.predicates import col

    exprs = []
    for k, c in enumerate(text.columns):
        t = stripped(col(c))
        exprs.append(F.max(rank(F.when(~is_placeholder(t), t))).alias(f"r{k}"))
    if not exprs:
        return {}
    row = text.agg(*exprs).first()
    return {c: TYPES[row[k]] if row[k] is not None else "string" for k, c in enumerate(text.columns)}


def typed(text: DataFrame, types: dict[str, str], keep=()) -> DataFrame:
    """Text columns cast once to their logical types; datetimes stay as text (their moment comes from datetime_of)."""
    from ..operators.predicates import col

    out = [col(k) for k in keep]
    for c in text.columns:
        if c in keep:
            continue
        t = stripped(col(c))
        if types[c] != "string":
            t = F.when(~is_placeholder(t), t)
        if types[c] == "integer":
            t = F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint")
        elif types[c] == "float":
            t = number(t)
        out.append(t.alias(c))
    return text.select(*out)


def logical(kind: T.DataType) -> str:
    """Logical type of a typed column."""
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"
