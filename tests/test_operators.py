import pytest
from pyspark.sql import functions as F

from brindle.errors import QueryError
from brindle.functions import infer as I
from brindle.functions import redact as R
from brindle.functions.semantic import detect, null_tokens
from brindle.functions.text import bm25, cosine, tokens
from brindle.operators import aggregate as A
from brindle.operators import join as J
from brindle.operators import predicates as P
from brindle.operators import profile as PR
from brindle.operators import quality as Q
from brindle.operators import rows as RW
from brindle.operators import sql as SQL
from brindle.operators import statistics as ST
from brindle.operators import traffic as TR


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Ann", 34, 9.5), (2, "Bob", None, 7.25), (3, "a_b%", 45, None)], "id int, name string, age int, score double")


def f(column, op, value=None):
    return [{"column": column, "op": op, "value": value}]


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        (f("age", "eq", "34"), [1]), (f("age", "neq", 34), [3]), (f("age", "gt", 34), [3]), (f("age", "gte", 34), [1, 3]), (f("score", "lt", "9"), [2]), (f("score", "lte", 9.5), [1, 2]),
        (f("name", "contains", "AN"), [1]), (f("name", "contains", "%"), [3]), (f("name", "contains", "_"), [3]), (f("age", "contains", "4"), [1, 3]), (f("id", "in", [1, "3"]), [1, 3]),
        (f("age", "is_null", True), [2]), (f("age", "is_null", False), [1, 3]), (f("age", "between", [40, 50]), [3]), (f("age", "gte", 34) + f("score", "gt", 1), [1]), ([], [1, 2, 3]),
    ],
)
def test_filters(people, filters, ids):
    assert [r.id for r in P.where(people, filters).orderBy("id").collect()] == ids


@pytest.mark.parametrize("bad", [f("nope", "eq", 1), f("age", "like", 1), f("age", "eq"), f("age", "in", []), f("age", "between", [1]), f("age", "gt", "x")])
def test_bad_filters(people, bad):
    with pytest.raises(QueryError):
        P.where(people, bad)


def test_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "a b", "a`b"])
    assert rows(RW.get_rows(df, f("a.b", "eq", 1) + f("a`b", "eq", 3), ["a b"])) == [(2,)]


def test_rows_pages_and_limits(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"))
    one, two = rows(RW.get_rows(df, order_by="k", limit=10)), rows(RW.get_rows(df, order_by="k", limit=10, offset=10))
    assert not set(one) & set(two)
    with pytest.raises(QueryError, match="ROW_LIMIT_EXCEEDED"):
        RW.get_rows(df, limit=501)


def test_row_ids_and_samples(spark):
    df = RW.with_row_ids(spark.range(50, numPartitions=4).select(F.col("id").alias("v")))
    assert [(r._row_id, r.v) for r in df.orderBy("_row_id").collect()] == [(i + 1, i) for i in range(50)]
    assert [r.v for r in RW.sample_rows(df, 3, "tail").collect()] == [49, 48, 47]
    a, b, c = (rows(RW.sample_rows(df, 10, "random", s)) for s in (1, 1, 2))
    assert a == b != c
    assert len(set(a)) == 10


def test_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 30.0), ("b", None), ("b", 5.0)], "g string, v double")
    out = A.aggregate(df, [{"function": "median", "column": "v"}, {"function": "count", "column": "v", "alias": "n"}, {"function": "count"}], ["g"], order_by="n")
    assert rows(out) == [("a", 2.0, 3, 3), ("b", 5.0, 1, 2)]
    assert out.columns == ["g", "median_v", "n", "count_all"]
    # an alias that is also a column's name means the aggregate
    assert rows(A.aggregate(df, [{"function": "sum", "column": "v", "alias": "v"}], ["g"], having=f("v", "gt", 6))) == [("a", 33.0)]
    for bad in ({"function": "count_distinct", "column": "*"}, {"function": "mode", "column": "v"}, {"function": "sum", "column": "x"}):
        with pytest.raises(QueryError):
            A.aggregate(df, [bad])
    with pytest.raises(QueryError):
        A.aggregate(df, [{"function": "count"}], order_by="zzz")


def test_approximate(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("v"))
    got = {r.alias: r for r in A.approximate(df, [{"function": g, "column": "v"} for g in ("count_distinct", "median", "avg", "sum")]).collect()}
    assert 190 <= got["count_distinct_v"].value <= 210
    assert abs(got["median_v"].value - 99.5) <= 2
    assert got["avg_v"].value == 99.5
    assert got["avg_v"].method == "exact"
    nulls = spark.range(60_000).select(F.when(F.col("id") % 10 >= 3, 1.0).alias("v"))
    total = A.approximate(nulls, [{"function": "sum", "column": "v"}], sample_rows=5000).first()
    assert abs(total.value - 42_000) < 1e-6


def test_joins(spark):
    o = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (3, 5, 30.0), (4, None, 1.0)], "order_id int, customer_id int, amount double")
    c = spark.createDataFrame([(1, "x"), (2, "y")], "customer_id int, name string")
    assert J.join(o, c, "customer_id", "customer_id").columns == ["order_id", "customer_id", "amount", "customer_id__b", "name"]
    assert [J.join(o, c, "customer_id", "customer_id", h).count() for h in ("inner", "left", "right", "cross")] == [2, 4, 3, 8]
    big = f("name", "eq", "x")
    assert J.join(o, c, "customer_id", "customer_id", "left", filters_b=big).count() == 2
    assert J.join(o, c, "customer_id", "customer_id", "left", filters_b=big, filter_mode="pre").count() == 4
    assert J.join(o, o, "customer_id", "customer_id").count() == 5
    assert rows(J.suggest_joins(o, "customer_id", {"c": (c, "customer_id")}, least=0.0))[0][2:] == (2, 1, 0.5)


@pytest.mark.parametrize("bad", ["DELETE FROM rows", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO rows SELECT * FROM a", "DROP TABLE rows", ""])
def test_sql_guard(bad):
    with pytest.raises(QueryError):
        SQL.guard(bad)


def test_sql(spark):
    a, b = spark.createDataFrame([(1, "x;y")], "id int, t string"), spark.createDataFrame([(1, "drop table")], "id int, t string")
    got = SQL.run_sql(spark, "SELECT replace(r.t, ';', '-') AS t, \"o\".t AS u, 'from rows; drop' AS s FROM rows r JOIN my_b.rows \"o\" ON r.id = \"o\".id -- drop", {"a": a, "my-b": b})
    assert rows(got) == [("x-y", "drop table", "from rows; drop")]
    assert rows(SQL.run_sql(spark, "SELECT id, sum(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM rows", {"a": a})) == [(1, 1)]
    with pytest.raises(QueryError, match="SQL_ERROR"):
        SQL.run_sql(spark, "SELECT nope FROM rows", {"a": a})


@pytest.mark.parametrize(
    ("text", "rank"),
    [("+5", 0), ("1_000", 0), ("1e5", 1), ("inf", 1), ("-Infinity", 1), ("1.", 1), (".5", 1), ("1d", 3), ("0x10", 3), (" 7 ", 0), ("2024-01-02", 2), ("01/02/2024", 2), ("1/2/2024 1:02:03 PM", 2), ("2024-01-02T03:04:05Z", 2), ("x", 3), ("NaN", None), ("N/A", None), ("", None)],
)
def test_ranks(spark, text, rank):
    t = I.stripped(F.lit(text))
    assert spark.range(1).select(I.rank(t).alias("r")).first().r == rank


def test_late_types_and_placeholders(spark):
    df = spark.createDataFrame([(str(i), "-" if i % 3 else "2024-01-05", "-") for i in range(300)] + [("x", None, "a")], "late string, d string, s string")
    p = {x["name"]: x for x in PR.profile(df)}
    assert [p[c]["type"] for c in ("late", "d", "s")] == ["string", "datetime", "string"]
    assert (p["d"]["count"], p["d"]["null_count"]) == (100, 201)
    assert p["s"]["count"] == 301


def test_profile(spark):
    df = RW.with_row_ids(spark.createDataFrame([(i, i % 7, f"u{i}@x.org", "12/30/2024" if i == 3 else "12/31/2023", float(i) if i % 2 else None) for i in range(50)], "id long, k int, mail string, d string, f double"))
    p = {x["name"]: x for x in PR.profile(df)}
    assert p["id"]["is_primary_key_candidate"]
    assert not p["k"]["is_unique"]
    assert p["k"]["value_index"] == {str(j): (8 if j == 0 else 7) for j in range(7)}
    assert (p["mail"]["semantic_type"], p["mail"]["sample_values"][0]) == ("email", "u0@x.org")
    assert (p["d"]["datetime_min"], p["d"]["datetime_max"], p["d"]["datetime_format"]) == ("12/31/2023", "12/30/2024", "%m/%d/%Y")
    assert (p["f"]["null_pct"], p["f"]["mean"], p["id"]["mean"]) == (50.0, 25.0, 24.5)
    assert p["id"]["variance"] == pytest.approx(212.5)


def test_null_tokens_and_violations(spark):
    df = spark.createDataFrame([("1", "TBD"), ("2.5", "x"), ("N/A", "TBD"), ("-", "TBD"), ("zz", "y"), ("", "NULL")], "a string, b string")
    p = {x["name"]: x for x in PR.profile(df)}
    assert (p["a"]["type"], p["a"]["null_tokens"], p["b"]["null_tokens"]) == ("string", {"N/A": 1}, {"NULL": 1})
    nums = spark.createDataFrame([("1",), ("2024-01-01",), ("2024-01-02",), ("-",)], "d string")
    q = PR.profile(nums)[0]
    assert (q["type"], q["type_violation_samples"], q["null_tokens"]) == ("datetime", ["1"], {"-": 1})
    two = [{"name": c, "count": 100, "value_index": {"TBD": 5, "ok": 95}} for c in "xy"]
    assert [t["token"] for t in PR.learned_null_tokens(two)] == ["TBD"]


def test_uniqueness_past_the_cap(spark):
    df = spark.createDataFrame([(min(i, 5999),) for i in range(6001)], "k int")
    assert not PR.profile(df)[0]["is_unique"]
    assert PR.profile(spark.range(7000))[0]["is_unique"]


def test_same_profile_from_text_and_types(spark):
    typed = spark.sql("SELECT 5.0D AS a, TRUE AS b, DATE'2024-02-03' AS c, TIMESTAMP'2024-02-03 04:05:06' AS d UNION ALL SELECT 2.5D, FALSE, DATE'2024-02-04', TIMESTAMP'2024-02-04 00:00:00'")
    assert set(rows(I.canonical_frame(typed))) == {("5", "True", "2024-02-03", "2024-02-03T04:05:06"), ("2.5", "False", "2024-02-04", "2024-02-04")}


def test_semantic():
    assert detect("string", ["USD", "EUR", "GBP"], "currency") == ("iso_currency", 1.0)
    assert detect("string", ["USD", "EUR", "GBP"], "x") == (None, 0.0)
    assert detect("float", ["50.1", "-89", "12"], "lat") == ("lat", 1.0)
    assert detect("string", ["::1", "fe80::1", "10:2"], "a")[0] is None


def test_null_tokens(spark):
    f = spark.createDataFrame([("x", "TBD", 20, 100), ("y", "tbd", 1, 100), ("y", "TBD", 14, 100), ("x", "ok", 50, 100)], '"column" string, value string, n long, total long'.replace('"', "`"))
    assert [(r.token, r.n_columns) for r in null_tokens(f).collect()] == [("TBD", 2)]


def test_histogram(spark):
    df = spark.range(100).select(F.col("id").alias("v"))
    got = ST.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r.n for r in got] == [10] * 10
    assert got[-1].high == 99
    assert sum(r.n for r in ST.histogram(df.union(spark.range(1000, 1001)), "v", 7).collect()) == 101
    assert ST.histogram(df.where("v = 3"), "v").count() == 1


def test_categories_and_months(spark):
    df = spark.createDataFrame([("a", "12/31/2023")] * 3 + [("b", "01/05/2024")] * 2 + [("c", "2024-01-09")], "k string, d string")
    assert rows(ST.categories(df, "k", 1)) == [("a", 3), ("<other>", 3)]
    assert rows(ST.by_month(df, "d")) == [("2023-12", 3), ("2024-01", 3)]


def test_correlations(spark):
    df = spark.createDataFrame([(i, 2 * i, -i, 7, i**3) for i in range(1, 51)], "a int, b int, c int, k int, q int")
    got = {(r.column_a, r.column_b): r for r in ST.correlations(df, least=0.0).collect()}
    assert (got["a", "b"].r, got["a", "c"].r, got["a", "b"].strength, got["a", "c"].direction) == (1.0, -1.0, "very strong", "negative")
    assert ("a", "k") not in got
    assert ST.correlations(df, ["a", "q"], "spearman").first().r == 1.0
    assert ST.correlations(df.limit(9), least=0.0).count() == 0


def test_redaction(spark):
    texts = ["mail a.b@c.org now", "ssn 123-45-6789 and 000-12-3456", "card 4111 1111 1111 1111", "card 4111 1111 1111 1112", "eyJhbGciOi.eyJzdWIi.abc-_1", "sk_live_" + "a" * 20, "AKIA" + "A" * 16, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in R.redact(df).collect()]
    assert got[0] == "mail [REDACTED:email] now"
    assert got[1] == "ssn [REDACTED:ssn] and 000-12-3456"
    assert got[2] == "card [REDACTED:credit_card]"
    assert got[3] == texts[3]
    assert got[4:7] == ["[REDACTED:jwt]", "[REDACTED:api_key_prefixed]", "[REDACTED:aws_access_key]"]
    assert got[7] is None
    assert rows(R.redact(R.redact(df))) == rows(R.redact(df))
    assert {r.kind: r.hits for r in R.redaction_counts(df).collect()} == {"email": 1, "ssn": 1, "credit_card": 1, "jwt": 1, "api_key_prefixed": 1, "aws_access_key": 1}
    assert R.valid_custom(["a+", "("])[1] == [1]
    assert rows(R.redact(df.limit(1), custom=["now"])) == [("mail [REDACTED:email] [REDACTED:custom_0]",)]


def test_scrub_sql(spark):
    got = spark.range(1).select(R.scrub_sql(F.lit("SELECT a FROM t WHERE b = 'it''s' AND c_1 = 12.5e3")).alias("q")).first().q
    assert got == "SELECT a FROM t WHERE b = '?' AND c_1 = ?"


def test_traffic(spark):
    log = spark.createDataFrame([("SELECT u.name, email FROM app.users u WHERE id = 3", 4, 2.0), ("SELECT u.name, email FROM app.users u WHERE id = 9", 1, 1.0)], "query string, calls long, total_time double")
    roll = TR.rollup(log, "2024-01-01")
    got = {r.column_name: r.calls for r in roll.where("table_name = 'users'").collect()}
    assert {k: got[k] for k in ("", "name", "email", "id")} == {"": 5, "name": 5, "email": 5, "id": 5}
    assert TR.merge(roll, roll).where("column_name = ''").first().calls == 10


def test_loops(spark):
    calls = spark.createDataFrame([("get_rows", "d", f"2024-01-01 00:00:{i:02d}", 50 * i) for i in range(12)], "tool string, dataset string, ts string, offset int").withColumn("ts", F.to_timestamp("ts"))
    assert TR.call_loops(calls, ("tool", "dataset")).count() == 2
    assert TR.pagination_loops(calls).count() == 1


def test_quality():
    base = {"null_pct": 0.0, "type_confidence": 1.0, "is_primary_key_candidate": True, "semantic_type": None, "cardinality": 20, "count": 20, "type": "integer", "mean": 10.0, "min": 1.0, "max": 20.0, "is_unique": True, "null_count": 0, "cardinality_is_exact": True}
    good, bad = base | {"name": "id"}, base | {"name": "n", "null_pct": 75.0, "type": "string", "cardinality": 1, "is_unique": False, "is_primary_key_candidate": False}
    assert Q.dataset_health([good])["grade"] == "A"
    assert Q.hotspots([good, bad])[0]["column"] == "n"
    assert Q.suggest_keys([good, bad]) == [{"column": "id", "confidence": 0.9, "type": "integer", "null_count": 0}]
    assert Q.schema_drift([good], [good, bad])["assessment"] == "additive"
    assert Q.schema_drift([good, bad], [good])["assessment"] == "breaking"
    assert Q.schema_drift([good], [good])["assessment"] == "identical"
    assert Q.radar_diff(Q.radar([good]), Q.radar([good, bad]))["verdict"] == "regressed"


def test_similar_columns():
    c = {"type": "string", "cardinality": 3, "value_index": {"a": 1, "b": 1, "c": 1}}
    pairs = Q.similar_columns([c | {"dataset": "x", "name": "userEmail"}, c | {"dataset": "y", "name": "user_email"}, c | {"dataset": "y", "name": "zip", "type": "integer", "value_index": None}])
    assert [(p["score"], p["verdict"]) for p in pairs] == [(1.0, "near_duplicate")]
    assert Q.clusters(pairs) == [["x.userEmail", "y.user_email"]]


def test_impact():
    key = {"name": "id", "type": "integer", "is_primary_key_candidate": True}
    ref = {"name": "user_id", "type": "integer", "is_primary_key_candidate": False}
    sets = {"users": [key], "orders": [key, ref]}
    assert TR.drop_check("users", key, sets, 0)["verdict"] == "pk_blocking"
    assert TR.drop_check("orders", ref, sets, 0)["verdict"] == "fk_blocking"
    assert {"dataset": "orders", "column": "user_id", "type": "integer"} in TR.impact("users", key, sets, 5)["direct"]
    lone = {"name": "memo", "type": "string", "is_primary_key_candidate": False}
    assert TR.drop_check("users", lone, sets | {"users": [key, lone]}, 3)["verdict"] == "runtime_observed"
    assert TR.drop_check("users", lone, sets, None)["safe"]


def test_text(spark):
    df = spark.createDataFrame([(1, "Zürich ist groß 東京都"), (2, "zürich zürich"), (3, None)], "id int, t string")
    assert df.select(tokens(F.col("t")).alias("w")).first().w == ["zürich", "ist", "groß", "東京", "京都"]
    assert [r.id for r in bm25(df, "Zürich", "id", "t").collect()] == [2, 1]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert v.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("a"), F.col("a")).alias("y")).first() == (0.0, 1.0)


def test_row_numbers_follow_files_not_tasks(spark, tmp_path):
    from brindle.operators.rows import ROW_ID, with_row_ids

    at = 0
    for name, n in (("a", 10), ("b", 5000), ("c", 100)):
        spark.range(at, at + n, 1, 1).write.parquet(f"{tmp_path}/{name}.parquet")
        at += n
    df = with_row_ids(spark.read.parquet(*(f"{tmp_path}/{x}.parquet" for x in "cba")))
    assert df.where(f"{ROW_ID} <> id + 1").count() == 0
    assert with_row_ids(spark.range(50).repartition(3)).agg({ROW_ID: "max"}).first()[0] == 50


def test_large_whole_numbers_in_filters(spark):
    from brindle.operators.predicates import where

    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "id long")
    for v in ("9007199254740993", 9007199254740993):
        assert [r.id for r in where(df, [{"column": "id", "op": "eq", "value": v}]).collect()] == [9007199254740993]
    assert where(df, [{"column": "id", "op": "lt", "value": "99999999999999999999"}]).count() == 2


def test_sql_leaves_no_views_and_is_lax(spark):
    from brindle.operators.sql import run_sql

    df = spark.createDataFrame([(1, "a,b", None), (2, "x (iif) 'q'", 5)], "id int, t string, n int")
    before = len(spark.catalog.listTables())
    out = run_sql(spark, """SELECT id, iif(id = 1, 'iif(', t) AS "a b", 1 / 0 AS z, max(id, n) AS m, unicode('A') AS u, julianday('2000-01-01') AS j FROM rows ORDER BY id""", {"t": df}).collect()
    assert [tuple(r) for r in out] == [(1, "iif(", None, None, 65, 2451544.5), (2, "x (iif) 'q'", None, 5, 65, 2451544.5)]
    assert len(spark.catalog.listTables()) == before
    assert run_sql(spark, "SELECT max(n) AS m, total(n) AS t FROM rows WHERE id = 1", {"t": df}).first() == (None, 0.0)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_samples_of_a_column_that_starts_empty(spark):
    from pyspark.sql import functions as F

    from brindle.operators.profile import profile

    df = spark.range(12_000).select(F.col("id"), F.when(F.col("id") >= 2000, F.concat(F.lit("user"), "id", F.lit("@mail.org"))).alias("mail"))
    p = profile(df)[1]
    assert len(p["sample_values"]) == 10
    assert p["semantic_type"] == "email"


def test_rank_correlations_of_many_columns(spark):
    """Columns without nulls are ranked once, the others by pair; both as pandas ranks them."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    p = pd.DataFrame({"a b": rng.integers(0, 9, 400), "b": rng.normal(size=400), "c": rng.integers(0, 50, 400) * 0.5, "x0": rng.normal(size=400)})
    p["d"] = p.b.where(p.c > 5) + 0.2 * p["a b"]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in p.to_numpy().tolist()], ", ".join(f"`{c}` double" for c in p.columns))
    got = {(r.column_a, r.column_b): (r.r, r.n) for r in ST.correlations(df, None, "spearman_avg", 0.0, None).collect()}
    assert len(got) == 10
    for (a, b), (r, n) in got.items():
        both = p[[a, b]].dropna()
        assert n == len(both)
        assert r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=6e-5)


def test_one_scan_more_for_each_ranked_column(spark):
    """The plan deals the table once a column, not once a pair."""
    df = spark.range(200).select(*((F.col("id") * k % 17).cast("double").alias(f"c{k}") for k in range(1, 6)))
    plan = ST.correlations(df, None, "spearman", 0.0, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 5


def test_exact_quantiles_are_percentiles(spark, monkeypatch):
    """Also where the first brackets miss, of nulls, signs, ties, NaN and columns without values."""
    df = spark.range(5000).selectExpr(
        "double(hash(id)) / 7 AS many", "int(id % 3) AS few", "if(id % 2 = 0, null, -id / 100) AS half", "double(null) AS none",
        "if(id < 100, double('nan'), if(id < 200, double('infinity'), double(id))) AS odd", "if(id = 7, 1.5, null) AS one", "if(id in (7, 8), id, null) AS two",
    )
    qs = list(PR.QUANTILES.values())
    want = [(c, *(df.selectExpr(f"percentile({c}, array({', '.join(map(str, qs))})) AS q").first().q or [None] * len(qs))) for c in df.columns]
    for brackets in (PR.BRACKETS, (0.0, 0.0, 1.0)):
        monkeypatch.setattr(PR, "BRACKETS", brackets)
        assert list(map(str, rows(PR.exact_quantiles(df, df.columns)))) == list(map(str, want))
    assert rows(PR.exact_quantiles(df.limit(0), ["many"])) == [("many", *[None] * 6)]


def test_exact_quantiles_keep_no_map_of_all_values(spark):
    """The registered query doesn't aggregate by ``percentile``, which holds every distinct value in one task's heap."""
    from brindle.plans import queries as QS

    planned = []
    aggregate = PR.exact_quantiles

    def seen(df, columns):
        planned.append(columns)
        return aggregate(df, columns)

    PR.exact_quantiles = seen
    try:
        out = QS.QUERIES["profile_quantiles_exact"](spark, "/root/testdata/sf0.001")
    finally:
        PR.exact_quantiles = aggregate
    assert planned == [["c_acctbal"], ["o_totalprice"], ["l_quantity", "l_extendedprice"]]
    assert "percentile(" not in str(out._jdf.queryExecution().optimizedPlan())
