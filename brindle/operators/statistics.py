"""Distributions and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import infer as I
from . import predicates as P

OTHER = "<other>"
LEAST_PAIRS, MOST_COLUMNS = 10, 50


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins in one pass over the values (bounds come from a first aggregate): bin, low, high, n. The last bin is
    closed; empty bins stay; a constant column has one bin."""
    P.need(df, [column])
    c = P.col(column).cast("double")
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    bins = max(1, min(int(bins), 100))
    if lo == hi:
        return df.where(c.isNotNull()).agg(F.lit(0).alias("bin"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    which = F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where(c.isNotNull()).groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counted, "bin", "left")
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"), F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def by_month(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts by month, the earliest ``bins`` months. Text is parsed, so every recognised format falls in the right one."""
    c = P.col(column)
    when = I.datetime_of(I.stripped(c)) if isinstance(df.schema[column].dataType, T.StringType) else c
    return df.where(when.isNotNull()).groupBy(F.date_format(when, "yyyy-MM").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").limit(bins)


def categories(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """The most frequent values and what is left as ``<other>``: value, n."""
    c = P.col(column).cast("string")
    counted = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = counted.orderBy(F.desc("n"), "value").limit(top)
    rest = counted.join(best.select(F.col("value").alias("b")), F.col("value") == F.col("b"), "left_anti").agg(F.lit(OTHER).alias("value"), F.sum("n").alias("n")).where(F.col("n") > 0)
    return best.unionByName(rest)


def distribution(df: DataFrame, column: str, bins: int = 20, kind: str | None = None) -> DataFrame:
    kind = kind or I.logical(df.schema[P.need(df, [column])[0]].dataType)
    return histogram(df, column, bins) if kind in ("integer", "float") else by_month(df, column, bins) if kind == "datetime" else categories(df, column, bins)


def strength(r):
    a = F.abs(r)
    return F.when(a >= 0.9, "very strong").when(a >= 0.7, "strong").when(a >= 0.5, "moderate").when(a >= 0.3, "weak").otherwise("negligible")


def _below(cuts: list[float], value):
    """How many cuts lie below a value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))


def rank_columns(df: DataFrame, columns: list[str], ties, average: bool) -> DataFrame:
    """Replaces the columns, which hold no nulls, by their ranks over the whole table. Rows are dealt by fixed ranges of a
    column's value (approximate quantiles), so equal values share a range; ranks within it move up by the sizes of those before,
    and no task sorts everything. Ranges and their sizes are found for all columns in two passes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(*(F.percentile_approx(v, [i / n for i in range(1, n)] or [0.5], 10_000).alias(f"c{k}") for k, v in enumerate(columns))).first()
    if cuts[0] is None:
        return df
    part = {v: _below(sorted(set(cuts[k])), F.col(v)) for k, v in enumerate(columns)}
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), part[v].alias("p")) for k, v in enumerate(columns)))).alias("x"))
    shift: dict[int, list] = {k: [] for k in range(len(columns))}
    before = dict.fromkeys(shift, 0)
    for r in cells.groupBy("x.k", "x.p").agg(F.count(F.lit(1)).alias("n")).orderBy("k", "p").collect():  # one row a range
        shift[r["k"]].append((r["p"], before[r["k"]]))
        before[r["k"]] += r["n"]
    out, ranked = df, {v: f"_r{k}" for k, v in enumerate(columns)}
    for k, v in enumerate(columns):
        within = F.row_number().over(Window.partitionBy("_p").orderBy(v, *ties)).cast("double")
        if average:
            alike = F.count(F.lit(1)).over(Window.partitionBy("_p", v))
            within = F.rank().over(Window.partitionBy("_p").orderBy(v)) + (alike - 1) / 2
        first = F.broadcast(df.sparkSession.createDataFrame(shift[k], "_p int, _s long"))
        out = out.withColumn("_p", part[v]).join(first, "_p").withColumn(ranked[v], within + F.col("_s")).drop("_p", "_s")
    return out.select(*(F.col(ranked[c]).alias(c) if c in ranked else F.col(c) for c in df.columns))


def _r(n, sx, sy, sxx, syy, sxy):
    top, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    r = F.when((vx > 0) & (vy > 0), top / F.nullif(F.sqrt(F.greatest(vx * vy, F.lit(0.0))), F.lit(0.0)))
    return F.when((n >= LEAST_PAIRS) & r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def _sums(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Sums over each pair's complete rows in one pass; about the columns' means, which keeps them small."""
    names = sorted({c for p in pairs for c in p})
    mean = df.agg(*(F.avg(P.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names))).first()
    at = {c: P.col(c).cast("double") - F.lit(mean[f"m{i}"] or 0.0) for i, c in enumerate(names)}
    exprs = []
    for k, (a, b) in enumerate(pairs):
        both = at[a].isNotNull() & at[b].isNotNull()
        x, y = F.when(both, at[a]), F.when(both, at[b])
        exprs.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")).alias(f"p{k}"))
    return df.agg(*exprs).select(F.explode(F.array(*(f"p{k}" for k in range(len(pairs))))).alias("p")).select("p.*")


def _rank_sums(df: DataFrame, names: list[str], pairs: list[tuple[str, str]], ties, average: bool) -> DataFrame:
    """The same of ranks. Columns without nulls are ranked once for all pairs; other pairs over their own complete rows."""
    as_named = {c: f"x{i}" for i, c in enumerate(names)}
    back = {x: c for c, x in as_named.items()}
    numbers = df.select(*(P.col(c).cast("double").alias(x) for c, x in as_named.items()), *(P.col(t).alias(f"t{i}") for i, t in enumerate(ties)))
    filled = numbers.agg(F.count(F.lit(1)).alias("rows"), *(F.count(x).alias(x) for x in back)).first()
    whole = [x for x in back if filled[x] == filled["rows"]]
    groups: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for a, b in ((as_named[a], as_named[b]) for a, b in pairs):
        groups.setdefault(tuple(whole) if a in whole and b in whole else (a, b), []).append((a, b))
    out = None
    for columns, own in groups.items():
        rows = numbers.select(*columns, *(f"t{i}" for i in range(len(ties)))).dropna(subset=list(columns))
        one = _sums(rank_columns(rows, list(columns), [f"t{i}" for i in range(len(ties))], average), own)
        out = one if out is None else out.unionByName(one)
    real = F.create_map(*(F.lit(v) for pair in back.items() for v in pair))
    return out.withColumns({c: real[F.col(c)] for c in ("column_a", "column_b")})


def correlations(df: DataFrame, columns=None, method: str = "pearson", least: float = 0.3, top: int | None = 20, ties=()) -> DataFrame:
    """column_a, column_b, r, n, strength, direction of pairs with |r| >= least. Pearson: all pairs in one pass."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    names = [c for c in (columns or numeric) if c in numeric][:MOST_COLUMNS]
    pairs = list(combinations(names, 2))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "column_a string, column_b string, r double, n long, strength string, direction string")
    sums = _sums(df, pairs) if method == "pearson" else _rank_sums(df, names, pairs, ties, method == "spearman_avg")
    out = sums.withColumn("r", F.round(_r(F.col("n").cast("double"), *map(F.col, ("sx", "sy", "sxx", "syy", "sxy"))), 4)).where(F.abs("r") >= least)
    out = out.select("column_a", "column_b", "r", "n", strength(F.col("r")).alias("strength"), F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none").alias("direction"))
    return out if top is None else out.orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(min(top, 200))
