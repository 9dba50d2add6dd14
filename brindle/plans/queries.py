"""The engine's operators as named queries over the test tables, each with SQL for DuckDB where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import infer as I
from ..functions import redact as R
from ..functions import text as TX
from ..functions.semantic import PATTERNS as SEMANTIC
from ..operators import aggregate as A
from ..operators import join as J
from ..operators import predicates as P
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import rows as RW
from ..operators import sql as SQL
from ..operators import statistics as ST
from ..operators import traffic as TR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None, *tables: str):
    """Registers a function of the named tables."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            ORACLE[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- scans, filters, pages
query("scan_parquet_project", "SELECT c_custkey, c_acctbal FROM customer", "customer")(lambda c: RW.project(c, ["c_custkey", "c_acctbal"]))
query("auto_project_cap", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem", "lineitem")(lambda t: RW.project(t, None, 3))

FILTERS = {
    "filter_eq": ("orders", [("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'"),
    "filter_eq_number_text": ("orders", [("o_custkey", "eq", "7")], "o_custkey = 7"),
    "filter_neq": ("orders", [("o_orderstatus", "neq", "F")], "o_orderstatus <> 'F'"),
    "filter_gt": ("part", [("p_size", "gt", 40)], "p_size > 40"),
    "filter_gte": ("part", [("p_size", "gte", 40)], "p_size >= 40"),
    "filter_lt": ("part", [("p_retailprice", "lt", 1000)], "p_retailprice < 1000"),
    "filter_lte": ("orders", [("o_orderdate", "lte", "1995-06-30")], "o_orderdate <= TIMESTAMP '1995-06-30'"),
    "filter_in": ("events", [("event_type", "in", ["click", "view", "purchase"])], "event_type IN ('click', 'view', 'purchase')"),
    "filter_between": ("part", [("p_size", "between", [10, 20])], "p_size BETWEEN 10 AND 20"),
    "filter_contains": ("part", [("p_name", "contains", "E")], "contains(lower(p_name), 'e')"),
    "filter_contains_number": ("part", [("p_size", "contains", "4")], "contains(CAST(p_size AS VARCHAR), '4')"),
    "filter_is_not_null": ("events", [("props", "is_null", False)], "props IS NOT NULL"),
    "filter_and": ("orders", [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", "gte", 100000), ("o_orderpriority", "contains", "urgent")], "o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 AND contains(lower(o_orderpriority), 'urgent')"),
}
for _name, (_table, _filters, _sql) in FILTERS.items():
    query(_name, f"SELECT * FROM {_table} WHERE {_sql}", _table)(lambda t, f=_filters: P.where(t, [{"column": c, "op": o, "value": v} for c, o, v in f]))

query("rows_sorted_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 20", "orders")(
    lambda o: RW.get_rows(o, [{"column": "o_orderstatus", "op": "eq", "value": "O"}], ["o_orderkey", "o_totalprice"], "o_totalprice", "desc", 40, 20)
)
query("rows_sorted_asc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 25", "customer")(lambda c: RW.get_rows(c, None, ["c_custkey", "c_acctbal"], "c_acctbal", "asc", 25))
query("rows_total", "SELECT count(*) AS total FROM orders WHERE o_totalprice > 150000", "orders")(lambda o: P.where(o, [{"column": "o_totalprice", "op": "gt", "value": 150000}]).agg(F.count(F.lit(1)).alias("total")))
query("sample_head", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5", "nation")(lambda n: RW.sample_rows(n, 5, "head", columns=["n_name"], row_id="n_nationkey"))
query("sample_tail", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey DESC LIMIT 7", "supplier")(lambda s: RW.sample_rows(s, 7, "tail", columns=["s_name"], row_id="s_suppkey"))
query("sample_seeded", None, "supplier")(lambda s: RW.sample_rows(s, 10, "random", 42, row_id="s_suppkey"))
query("row_ids", "SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_regionkey) AS _row_id FROM region", "region")(lambda r: RW.with_row_ids(r))

# ---------------------------------------------------------------- aggregates
query("agg_global", "SELECT count(*) AS n, sum(l_quantity) AS qty, avg(l_extendedprice) AS price, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem", "lineitem")(
    lambda t: A.aggregate(t, [{"function": "count", "alias": "n"}, {"function": "sum", "column": "l_quantity", "alias": "qty"}, {"function": "avg", "column": "l_extendedprice", "alias": "price"}, {"function": "min", "column": "l_discount", "alias": "lo"}, {"function": "max", "column": "l_discount", "alias": "hi"}])
)
FLAGSHIP = [{"function": "count", "alias": "n"}, {"function": "sum", "column": "l_quantity", "alias": "sum_qty"}, {"function": "avg", "column": "l_extendedprice", "alias": "avg_price"}, {"function": "median", "column": "l_quantity", "alias": "median_qty"}]


def flagship(lineitem: DataFrame) -> DataFrame:
    """Filter, group, aggregate with an exact median, having, order, limit."""
    return A.aggregate(lineitem, FLAGSHIP, ["l_returnflag", "l_linestatus"], [{"column": "l_discount", "op": "between", "value": [0.05, 0.07]}], [{"column": "n", "op": "gt", "value": 5}], "sum_qty", "desc", 50)


query("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, quantile_cont(l_quantity, 0.5) AS median_qty FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 GROUP BY ALL HAVING count(*) > 5", "lineitem")(flagship)
query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL", "orders")(lambda o: A.aggregate(o, [{"function": "count_distinct", "column": "o_custkey", "alias": "customers"}], ["o_orderstatus"]))
query("agg_median", "SELECT event_type, quantile_cont(value, 0.5) AS median_value FROM events GROUP BY ALL", "events")(lambda e: A.aggregate(e, [{"function": "median", "column": "value"}], ["event_type"]))
query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 18", "orders")(lambda o: A.aggregate(o, [{"function": "count", "alias": "n"}], ["o_custkey"], having=[{"column": "n", "op": "gte", "value": 18}], order_by="n", limit=None))
query("agg_having_in_between", "SELECT l_suppkey, count(*) AS n, max(l_tax) AS tax FROM lineitem GROUP BY ALL HAVING count(*) BETWEEN 500 AND 620 AND max(l_tax) IN (0.08)", "lineitem")(
    lambda t: A.aggregate(t, [{"function": "count", "alias": "n"}, {"function": "max", "column": "l_tax", "alias": "tax"}], ["l_suppkey"], having=[{"column": "n", "op": "between", "value": [500, 620]}, {"column": "tax", "op": "in", "value": [0.08]}], limit=None)
)
query("agg_topk", "SELECT l_partkey, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY ALL ORDER BY revenue DESC NULLS LAST, l_partkey LIMIT 10", "lineitem")(lambda t: A.aggregate(t, [{"function": "sum", "column": "l_extendedprice", "alias": "revenue"}], ["l_partkey"], order_by="revenue", limit=10))
query("agg_total_groups", "SELECT count(*) AS total_groups FROM (SELECT o_custkey FROM orders GROUP BY ALL HAVING count(*) > 12)", "orders")(lambda o: A.total_groups(o, [{"function": "count", "alias": "n"}], ["o_custkey"], None, [{"column": "n", "op": "gt", "value": 12}]))
query("agg_text_extremes", "SELECT c_mktsegment, min(c_name) AS min_c_name, max(c_name) AS max_c_name FROM customer GROUP BY ALL", "customer")(lambda c: A.aggregate(c, [{"function": "min", "column": "c_name"}, {"function": "max", "column": "c_name"}], ["c_mktsegment"]))
query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")(lambda t: t.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
query("agg_approx_distinct", None, "lineitem")(lambda t: A.approximate(t, [{"function": "count_distinct", "column": "l_orderkey"}]))
query("agg_approx_median", None, "lineitem")(lambda t: A.approximate(t, [{"function": "median", "column": "l_extendedprice"}]))
query("agg_approx_avg_ci", None, "lineitem")(lambda t: A.approximate(t, [{"function": "avg", "column": "l_extendedprice"}, {"function": "sum", "column": "l_quantity"}, {"function": "count"}]))

# ---------------------------------------------------------------- joins
_ORDERS, _CUST = ["o_orderkey", "o_custkey", "o_totalprice"], ["c_custkey", "c_name"]
for _how in ("inner", "left", "right"):
    query(f"join_{_how}", f"SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name FROM orders {_how.upper()} JOIN customer ON o_custkey = c_custkey", "orders", "customer")(lambda o, c, h=_how: J.join(o, c, "o_custkey", "c_custkey", h, _ORDERS, _CUST, limit=None))
query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region")(lambda n, r: J.join(n, r, how="cross", columns_a=["n_name"], columns_b=["r_name"], limit=None))
query("join_self", "SELECT a.n_nationkey, a.n_regionkey, b.n_nationkey AS n_nationkey__b, b.n_regionkey AS n_regionkey__b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "nation", "nation")(
    lambda a, b: J.join(a, b, "n_regionkey", "n_regionkey", columns_a=["n_nationkey", "n_regionkey"], columns_b=["n_nationkey", "n_regionkey"], limit=None)
)
query("join_collision_suffix", "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS r_regionkey__b, b.r_name AS r_name__b FROM region a JOIN region b USING (r_regionkey)", "region", "region")(lambda a, b: J.join(a, b, "r_regionkey", "r_regionkey", limit=None))
_BIG = [{"column": "c_acctbal", "op": "gt", "value": 5000}]
query("join_filters_where", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000", "orders", "customer")(lambda o, c: J.join(o, c, "o_custkey", "c_custkey", "left", ["o_orderkey", "o_custkey"], _CUST, filters_b=_BIG, limit=None))
query("join_filters_pre", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey", "orders", "customer")(lambda o, c: J.join(o, c, "o_custkey", "c_custkey", "left", ["o_orderkey", "o_custkey"], _CUST, filters_b=_BIG, filter_mode="pre", limit=None))
query("filter_is_null", "SELECT o_orderkey, o_custkey, c_custkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey WHERE c_custkey IS NULL", "orders", "customer")(
    lambda o, c: P.where(J.join(o, c, "o_custkey", "c_custkey", "left", ["o_orderkey", "o_custkey"], ["c_custkey"], filters_b=_BIG, filter_mode="pre", limit=None), [{"column": "c_custkey", "op": "is_null", "value": True}])
)
query("join_page", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 30 OFFSET 10", "orders", "customer")(lambda o, c: J.join(o, c, "o_custkey", "c_custkey", "inner", ["o_orderkey", "o_custkey"], _CUST, order_by="o_orderkey", limit=30, offset=10))
query("containment_joins", "SELECT 'customer' AS target, 'c_custkey' AS target_column, count(*) AS n_values, count(c_custkey) AS n_found, round(count(c_custkey) / count(*), 4) AS containment FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders) LEFT JOIN customer ON v = CAST(c_custkey AS VARCHAR)", "orders", "customer")(
    lambda o, c: J.suggest_joins(o, "o_custkey", {"customer": (c, "c_custkey")}, sample=None)
)

# ---------------------------------------------------------------- SQL text
SQL_TEXTS = {
    "sql_cte": (("orders",), "WITH big AS (SELECT o_custkey, o_totalprice FROM rows WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM big GROUP BY o_custkey"),
    "sql_recursive": (("region",), "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t"),
    "sql_window_rank": (("supplier",), "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rk, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS drk, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS q, percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS pr, cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS cd FROM rows"),
    "sql_window_frame": (("events",), "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM rows"),
    "sql_setops": (("customer", "supplier"), "SELECT c_nationkey AS k FROM rows INTERSECT SELECT s_nationkey AS k FROM supplier.rows UNION SELECT 99 AS k EXCEPT SELECT 3 AS k"),
    "sql_exists_semi": (("customer", "orders"), "SELECT c_custkey FROM rows c WHERE EXISTS (SELECT 1 FROM orders.rows o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)"),
    "sql_anti": (("customer", "orders"), "SELECT c_custkey FROM rows c WHERE NOT EXISTS (SELECT 1 FROM orders.rows o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)"),
    "sql_scalar_subquery": (("part",), "SELECT p_partkey, p_retailprice FROM rows WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.05 FROM rows)"),
    "sql_multi_dataset": (("nation", "region", "customer"), "SELECT r.r_name, count(*) AS n, avg(c.c_acctbal) AS bal FROM rows n JOIN region.rows r ON n.n_regionkey = r.r_regionkey JOIN customer.rows c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name"),
    "sql_full_join": (("customer", "supplier"), "SELECT a.k AS ka, b.k AS kb FROM (SELECT DISTINCT c_nationkey AS k FROM rows WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier.rows WHERE s_acctbal > 9000) b ON a.k = b.k"),
    "sql_filter_clause": (("lineitem",), "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS taxed FROM rows GROUP BY l_returnflag"),
    "sql_scalar_functions": (("part",), "SELECT p_partkey, upper(p_brand) AS b, length(p_name) AS n, substr(p_name, 1, 3) AS s, coalesce(nullif(p_size, 10), -1) AS z, abs(p_size - 25) AS d, p_brand || '-' || p_type AS bt FROM rows"),
    "sql_quoted_names": (("nation",), 'SELECT "n_name", count(*) AS "how many" FROM rows GROUP BY "n_name"'),
}
for _name, (_tables, _text) in SQL_TEXTS.items():
    _oracle = _text
    for _t in _tables[1:]:
        _oracle = _oracle.replace(f"{_t}.rows", _t)
    _oracle = _oracle.replace("FROM rows", f"FROM {_tables[0]}")
    QUERIES[_name] = lambda spark, d, ts=_tables, x=_text: SQL.run_sql(spark, x, {t: table(spark, d, t) for t in ts}, None)
    ORACLE[_name] = _oracle.replace("sum(CASE", "CAST(sum(CASE").replace("END) AS taxed", "END) AS BIGINT) AS taxed")

#: what Spark lacks, with the same said for DuckDB
for _name, _table, _text, _oracle in (
    ("sql_iif_total", "orders", "SELECT o_orderstatus, iif(count(*) > 100, 'many', 'few') AS size, total(o_custkey) AS t FROM rows GROUP BY o_orderstatus", "SELECT o_orderstatus, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size, CAST(sum(o_custkey) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus"),
    ("sql_group_concat", "nation", "SELECT n_regionkey, length(group_concat(n_name)) AS a, length(group_concat(DISTINCT n_name, '; ')) AS b FROM rows GROUP BY n_regionkey", "SELECT n_regionkey, length(string_agg(n_name, ',')) AS a, length(string_agg(DISTINCT n_name, '; ')) AS b FROM nation GROUP BY n_regionkey"),
    ("sql_lax_arithmetic", "part", "SELECT p_partkey, p_size / (p_size - p_size) AS q, CAST(p_name AS INT) AS c, max(p_size, 10, 3) AS m, min(p_size, NULL) AS n FROM rows", "SELECT p_partkey, CAST(NULL AS DOUBLE) AS q, TRY_CAST(p_name AS INT) AS c, greatest(p_size, 10, 3) AS m, CAST(NULL AS INT) AS n FROM part"),
    ("sql_strftime", "orders", "SELECT strftime('%Y-%m', o_orderdate) AS month, count(*) AS n FROM rows GROUP BY 1", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1"),
    ("sql_json_extract", "nation", """SELECT n_nationkey, json_extract(concat('{"k": {"v": ', n_regionkey, '}}'), '$.k.v') AS v FROM rows""", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS v FROM nation"),
):
    QUERIES[_name] = lambda spark, d, t=_table, x=_text: SQL.run_sql(spark, x, {t: table(spark, d, t)}, None)
    ORACLE[_name] = _oracle

# ---------------------------------------------------------------- profiles
_PROFILED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "events": ["event_id", "user_id", "event_type", "value", "props"]}


def _profiles(*names: str):
    def f(customer, orders, events):
        spark, out = customer.sparkSession, None
        for t, df in zip(_PROFILED, (customer, orders, events), strict=True):
            one = PR.profile_frame(spark, PR.profile(df.select(*_PROFILED[t]))).select(F.lit(t).alias("source"), F.col("name"), *names)
            out = one if out is None else out.unionByName(one)
        return out

    return f


def _per_column(expr: Callable[[str], str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS source, '{c}' AS name, {expr(c)} FROM {t}" for t, cs in _PROFILED.items() for c in cs)


_ALL = ("customer", "orders", "events")
query("profile_counts", _per_column(lambda c: f"count({c}) AS count, count(*) - count({c}) AS null_count"), *_ALL)(_profiles("count", "null_count"))
query("profile_null_pct", _per_column(lambda c: f"round_even(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct"), *_ALL)(_profiles("null_pct"))
query("value_frequencies", _per_column(lambda c: f"count(DISTINCT {c}) AS cardinality"), "customer", "orders", "events")(lambda c, o, e: _exact_distinct({"customer": c, "orders": o, "events": e}))
query("profile_unique_pk", _per_column(lambda c: f"count({c}) > 0 AND count({c}) = count(DISTINCT {c}) AS is_unique"), *_ALL)(_profiles("is_unique"))


def _exact_distinct(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct counts through the (column, value) frequencies."""
    out = None
    for t, df in tables.items():
        one = PR.frequencies(I.canonical_frame(df.select(*_PROFILED[t]))).groupBy("column").agg(F.count(F.lit(1)).alias("cardinality")).select(F.lit(t).alias("source"), F.col("column").alias("name"), "cardinality")
        out = one if out is None else out.unionByName(one)
    return out


_NUMERIC = [("customer", "c_acctbal"), ("orders", "o_totalprice"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice")]


def _profiled(*facts: str, places: dict[str, int] | None = None):
    """Facts of number columns out of their profiles."""

    def f(customer, orders, lineitem):
        at, rows = {"customer": customer, "orders": orders, "lineitem": lineitem}, []
        for t in at:
            for p in PR.profile(at[t].select(*(c for x, c in _NUMERIC if x == t))):
                rows.append((p["name"], *(float(p[k]) for k in facts)))
        out = customer.sparkSession.createDataFrame(rows, ["name", *facts])
        return out.select("name", *(F.round(k, places[k]).alias(k) if places else F.col(k) for k in facts))

    return f


def _quantiles(customer, orders, lineitem):
    """Exact quantiles of number columns, all of a table at once."""
    at, out = {"customer": customer, "orders": orders, "lineitem": lineitem}, None
    for t in at:
        one = PR.exact_quantiles(at[t], [c for x, c in _NUMERIC if x == t])
        out = one if out is None else out.unionByName(one)
    return out.select("name", *(F.round(k, 4).alias(k) for k in PR.QUANTILES))


_union = lambda body: " UNION ALL ".join(f"SELECT '{c}' AS name, {body.format(c=c)} FROM {t}" for t, c in _NUMERIC)
query("profile_minmax", _union("min({c})::DOUBLE AS min, max({c})::DOUBLE AS max"), "customer", "orders", "lineitem")(_profiled("min", "max"))
query("profile_moments", _union("round(avg({c}), 6) AS mean, round(var_samp({c}), 3) AS variance, round(stddev_samp({c}), 4) AS std_dev"), "customer", "orders", "lineitem")(_profiled("mean", "variance", "std_dev", places={"mean": 6, "variance": 3, "std_dev": 4}))
query("profile_quantiles_exact", _union(", ".join(f"round(quantile_cont({{c}}, {q}), 4) AS {k}" for k, q in PR.QUANTILES.items())), "customer", "orders", "lineitem")(_quantiles)
query("profile_quantiles_sketch", None, "lineitem")(lambda t: t.agg(*(F.percentile_approx("l_extendedprice", q, 10_000).alias(k) for k, q in PR.QUANTILES.items())))
query("profile_topvalues", 'SELECT "column", value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM (SELECT \'event_type\' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT \'user_id\', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)) WHERE place <= 5', "events")(lambda e: PR.top_values(I.canonical_frame(e.select("event_type", "user_id")), 5))


def _ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    types = I.infer_types(I.canonical_frame(df.select(*columns)))
    return df.sparkSession.createDataFrame(list(types.items()), "name string, type string")


query("profile_type_rank", "SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_totalprice', 'float'), ('o_orderdate', 'datetime'), ('o_orderstatus', 'string')) t(name, type)", "orders")(lambda o: _ranks(o, ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"]))
query("profile_semantic_types", r"SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^\s/$.?#][^\s]*$')) AS urls FROM pages", "pages")(lambda p: p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").rlike(SEMANTIC["url"])).alias("urls")))
query("profile_full", None, "orders")(lambda o: PR.profile_frame(o.sparkSession, PR.profile(o)))

# ---------------------------------------------------------------- distributions, correlations
query("hist_numeric", "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) LEFT JOIN c ON c.bin = range", "lineitem")(lambda t: ST.histogram(t, "l_extendedprice", 20).select("bin", "n"))
query("hist_datetime_month", "SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24", "orders")(lambda o: ST.by_month(o, "o_orderdate", 24))
query("hist_categorical_other", "WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 5) SELECT * FROM t UNION ALL SELECT '<other>', CAST(sum(n) AS BIGINT) FROM c WHERE value NOT IN (SELECT value FROM t) HAVING sum(n) > 0", "part")(lambda p: ST.categories(p, "p_brand", 5))
_R = "round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 4)"
_LABEL = "CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'negligible' END"
_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]
query("corr_pearson", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS), "lineitem")(lambda t: ST.correlations(t, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "pearson", 0.0, None).select("column_a", "column_b", "r", "n"))
query("corr_labels", f"SELECT column_a, column_b, {_LABEL} AS strength, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction FROM ({' UNION ALL '.join(f'''SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS r FROM lineitem''' for a, b in _PAIRS)})", "lineitem")(lambda t: ST.correlations(t, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "pearson", 0.0, None).select("column_a", "column_b", "strength", "direction"))
query("corr_spearman", "WITH x AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders) SELECT 'o_totalprice' AS column_a, 'o_custkey' AS column_b, round(corr(a, b), 4) AS r, count(*) AS n FROM x", "orders")(lambda o: ST.correlations(o, ["o_totalprice", "o_custkey"], "spearman", 0.0, None, ("o_orderkey",)).select("column_a", "column_b", "r", "n"))
query("corr_spearman_average", "WITH x AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b, round(corr(a, b), 4) AS r, count(*) AS n FROM x", "lineitem")(lambda t: ST.correlations(t, ["l_quantity", "l_discount"], "spearman_avg", 0.0, None).select("column_a", "column_b", "r", "n"))

# ---------------------------------------------------------------- quality
_HEALTH = {"c_custkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"}
query("hotspots", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(0.4 * (round_even(100.0 * (count(*) - count({c})) / count(*), 1) / 100) + 0.3 * {'0.2 * (count(DISTINCT ' + c + ') / count(' + c + '))' if k != 'string' else 'CASE WHEN count(DISTINCT ' + c + ') <= 1 THEN 0.8 WHEN count(DISTINCT ' + c + ') / count(' + c + ') > 0.95 THEN 0.5 ELSE 0.2 * (count(DISTINCT ' + c + ') / count(' + c + ')) END'} + 0.3 * {'0' if k == 'string' else 'least((max(' + c + ') - min(' + c + ')) / abs(avg(' + c + ')) / 5, 1)'}, 4) AS score FROM customer" for c, k in _HEALTH.items()) + ")", "customer")(lambda c: c.sparkSession.createDataFrame([(h["column"], h["score"]) for h in Q.hotspots(PR.profile(c.select(*_HEALTH)))], "column string, score double"))


def _health(c: DataFrame) -> DataFrame:
    h = Q.dataset_health(PR.profile(c))
    return c.sparkSession.createDataFrame([(h["score"], h["grade"])], "score double, grade string")


query("health_score", "SELECT score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM (SELECT round(0.6 + 0.3 * (4 + round(1.0 - count(*) FILTER (WHERE c_acctbal = floor(c_acctbal)) / count(*), 4)) / 5, 4) AS score FROM customer)", "customer")(_health)
query("radar_axes", None, "orders")(lambda o: o.sparkSession.createDataFrame([(k, float(v)) for k, v in Q.radar(PR.profile(o))["axes"].items()], "axis string, value double"))


def _drift(a: DataFrame, b: DataFrame) -> DataFrame:
    found = Q.schema_drift(PR.profile(a), PR.profile(b))
    return a.sparkSession.createDataFrame([(c, change) for change in ("added", "removed") for c in found[change]], "column string, change string")


def _keys(o: DataFrame) -> DataFrame:
    rows = [(k["column"], k["confidence"]) for k in Q.suggest_keys(PR.profile(o.select("o_orderkey", "o_custkey", "o_orderstatus")))]
    return o.sparkSession.createDataFrame(rows, "column string, confidence double")


query("keys_ranked", "SELECT 'o_orderkey' AS \"column\", 0.9::DOUBLE AS confidence FROM orders HAVING count(*) = count(DISTINCT o_orderkey)", "orders")(_keys)
query("drift_added_removed", "SELECT coalesce(a.column_name, b.column_name) AS \"column\", CASE WHEN b.column_name IS NULL THEN 'removed' ELSE 'added' END AS change FROM (DESCRIBE region) a FULL JOIN (DESCRIBE nation) b ON a.column_name = b.column_name WHERE a.column_name IS NULL OR b.column_name IS NULL", "region", "nation")(_drift)


def _similar(c: DataFrame, s: DataFrame) -> DataFrame:
    columns = [p | {"dataset": d} for d, df in (("customer", c), ("supplier", s)) for p in PR.profile(df)]
    rows = [(p["a"], p["b"], p["score"], p["verdict"]) for p in Q.similar_columns(columns, 0.3)]
    return c.sparkSession.createDataFrame(rows, "a string, b string, score double, verdict string")


query("similar_columns", None, "customer", "supplier")(_similar)

# ---------------------------------------------------------------- redaction, traffic
#: texts made of order numbers: what looks like a number of a kind is one for some rows only
_SSN = "concat('ssn ', lpad(CAST(o_orderkey % 1000 AS {s}), 3, '0'), '-', lpad(CAST(o_custkey % 100 AS {s}), 2, '0'), '-', lpad(CAST(o_orderkey % 7 AS {s}), 4, '0'), '.')"
_CARD = "concat('4', lpad(CAST((o_orderkey * 104729) % 1000000007 AS {s}), 15, '0'))"
query("redact_ssn", f"SELECT o_orderkey, CASE WHEN o_orderkey % 1000 NOT IN (0, 666) AND o_orderkey % 1000 < 900 AND o_custkey % 100 > 0 AND o_orderkey % 7 > 0 THEN 'ssn [REDACTED:ssn].' ELSE {_SSN.format(s='VARCHAR')} END AS text FROM orders", "orders")(
    lambda o: R.redact(o.select("o_orderkey", F.expr(_SSN.format(s="STRING")).alias("text")), kinds=["ssn"])
)
query("redact_card_luhn", f"SELECT o_orderkey, CASE WHEN list_sum([CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(c, i, 1) AS INT)) % 10 + (2 * CAST(substr(c, i, 1) AS INT)) // 10 ELSE CAST(substr(c, i, 1) AS INT) END FOR i IN range(1, 17)]) % 10 = 0 THEN 'card [REDACTED:credit_card] end' ELSE concat('card ', c, ' end') END AS text FROM (SELECT o_orderkey, {_CARD.format(s='VARCHAR')} AS c FROM orders)", "orders")(
    lambda o: R.redact(o.select("o_orderkey", F.expr(f"concat('card ', {_CARD.format(s='STRING')}, ' end')").alias("text")), kinds=["credit_card"])
)
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"
query("redact_email", rf"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[REDACTED:email]', 'g') AS text FROM documents", "documents")(lambda d: R.redact(d.select("doc_id", "text"), kinds=["email"]))
query("redact_counts_email", rf"SELECT 'email' AS kind, CAST(sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS BIGINT) AS hits, count(*) FILTER (WHERE regexp_matches(text, '{_EMAIL}')) AS cells FROM documents HAVING hits > 0", "documents")(lambda d: R.redaction_counts(d.select("text"), kinds=["email"]))
query("redact_all", None, "conversations")(lambda c: R.redact(c.select("conv_id", "turn", "text")))
query("redact_counts", None, "documents")(lambda d: R.redaction_counts(d.select("text")))
_LOG = "concat('SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey = ', CAST(o_orderkey AS {s}), ' AND o_orderstatus = ''', o_orderstatus, '''')"
query("sqllog_scrub", f"SELECT o_orderkey, concat('sha256:', substr(sha256(q), 1, 32)) AS fingerprint, q AS scrubbed FROM (SELECT o_orderkey, regexp_replace(regexp_replace({_LOG.format(s='VARCHAR')}, '''(?:[^''\\\\]|\\\\.|'''')*''', '''?''', 'g'), '\\b\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?\\b', '?', 'g') AS q FROM orders)", "orders")(
    lambda o: o.select("o_orderkey", R.scrub_sql(F.expr(_LOG.format(s="STRING").replace("''''", "\"'\"").replace("= '''", "= \\''"))).alias("scrubbed")).select("o_orderkey", R.fingerprint(F.col("scrubbed")).alias("fingerprint"), "scrubbed")
)


def _log(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("SELECT user_id FROM events WHERE event_type = '"), F.col("event_type"), F.lit("' AND value > 3")).alias("query"), F.lit(1).alias("calls"), F.lit(0.5).alias("total_time"))


query("sqllog_rollup", "SELECT 'events' AS table_name, c AS column_name, n AS calls, n * 0.5 AS total_time FROM (SELECT count(*) AS n FROM events), (VALUES (''), ('user_id'), ('event_type'), ('value')) t(c)", "events")(lambda e: TR.rollup(_log(e), "2024-01-01").select("table_name", "column_name", "calls", "total_time"))
query("traffic_windowed", "SELECT 'events' AS table_name, event_type AS column_name, coalesce(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15'), 0) AS recent_calls, count(*) AS all_calls FROM events GROUP BY event_type", "events")(
    lambda e: TR.windowed(e.select(F.lit("events").alias("table_name"), F.col("event_type").alias("column_name"), F.lit(1).alias("calls"), F.col("ts").alias("last_seen")), "2024-01-15").select("table_name", "column_name", "recent_calls", "all_calls")
)
query("unused_columns", "SELECT * FROM (VALUES ('ts', 'zero_hits', 0::BIGINT), ('props', 'zero_hits', 0::BIGINT)) t(\"column\", reason, recent_calls)", "events")(lambda e: TR.unused_columns(PR.profile_frame(e.sparkSession, PR.profile(e)), TR.rollup(_log(e)), "events", "2000-01-01"))
query("loop_window_calls", "SELECT user_id, event_type, epoch_us(ts) AS us, calls FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS calls FROM events) WHERE calls > 2", "events")(lambda e: TR.call_loops(e, ("user_id", "event_type"), 86400, 2).select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "calls"))
query("latency_percentiles", "SELECT event_type AS tool, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max_ms FROM events GROUP BY 1", "events")(lambda e: TR.latency(e.select(F.col("event_type").alias("tool"), F.col("value").alias("ms"))))



def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily calls by type through Structured Streaming: all that is there, then the state as a table."""
    import uuid

    from ..streaming.traffic import windowed_calls

    kind = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"calls_{uuid.uuid4().hex[:8]}"
    counted = windowed_calls(events, "event_type", window="1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "calls")
    counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


QUERIES["stream_windowed_calls"] = _stream
ORACLE["stream_windowed_calls"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS calls FROM events GROUP BY ALL"

# ---------------------------------------------------------------- search
_BM25 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS t FROM documents),
f AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'license')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(l) AS v, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * l / v)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * l / v)) AS score FROM f, s) WHERE score > 0
"""
query("bm25_documents", _BM25, "documents")(lambda d: TX.bm25(d, "idiot license", "doc_id", "text", None).select("doc_id", F.round("score", 6).alias("score")))


def _vectors(v: DataFrame) -> DataFrame:
    first = v.orderBy("vec_id").first()
    return TX.nearest(v, list(first.embedding), "vec_id", "embedding", 20)


query("vector_cosine_topk", "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 20", "embeddings")(_vectors)
