"""What the optimiser makes of the operators: filters and columns reach the scan, aggregates are partial first."""

import re

import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregate as A
from brindle.operators import join as J
from brindle.operators import predicates as P
from brindle.operators import rows as RW
from brindle.operators import statistics as ST
from brindle.plans import summaries as SU


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t.parquet")
    spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("g"), (F.col("id") * 1.5).alias("v"), F.concat(F.lit("n"), F.col("id")).alias("s"), F.lit("x").alias("wide")).write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("op", "value", "pushed"), [("eq", "3", "EqualTo(g,3)"), ("gt", 3, "GreaterThan(g,3)"), ("in", [1, "2"], "In(g, [1,2])"), ("between", [2, 4], "GreaterThanOrEqual(g,2)"), ("is_null", True, "IsNull(g)")])
def test_filters_reach_the_scan(stored, op, value, pushed):
    p = plan(RW.project(P.where(stored, [{"column": "g", "op": op, "value": value}]), ["v"]))
    assert pushed in p
    assert "ReadSchema: struct<g:int,v:double>" in p


def test_aggregates_are_partial_and_read_two_columns(stored):
    p = plan(A.aggregate(stored, [{"function": "sum", "column": "v"}], ["g"], order_by="sum_v", limit=3))
    assert "partial_sum" in p
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema: struct<g:int,v:double>" in p


def test_join_filters_move_below_the_join(stored):
    p = plan(J.join(stored, stored, "k", "k", columns_a=["k"], columns_b=["v"], filters_a=[{"column": "g", "op": "eq", "value": 1}], limit=None))
    assert "EqualTo(g,1)" in p


def test_all_pairs_in_one_pass(stored):
    p = plan(ST.correlations(stored, ["k", "g", "v"], least=0.0, top=None))
    assert len(re.findall(r"FileScan|Scan parquet", p)) == 1


def test_intents():
    assert [SU.intent_of(x) for x in ("over time by month", "merge them", "", "what predicts price")] == ["trend", "join", "summarize", "correlate"]
    assert SU.steps_for("trend", "d", {"string"})[0]["tool"] == "describe_dataset"


def test_bins_cover_all_values(spark):
    for n, bins in ((1, 1), (13, 5), (100, 100)):
        df = spark.range(n).select(F.sqrt(F.col("id")).alias("v"))
        assert sum(r.n for r in ST.histogram(df, "v", bins).collect()) == n


def test_having_gives_all_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from brindle.plans.queries import QUERIES

    g = spark.range(1200).select(F.col("id").alias("g"))
    g.join(spark.range(18)).select(F.col("g").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    g.join(spark.range(500)).select(F.col("g").alias("l_suppkey"), F.lit(0.08).alias("l_tax")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, n in (("agg_having", 18), ("agg_having_in_between", 500)):
        rows = QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == 1200
        assert {r.n for r in rows} == {n}
