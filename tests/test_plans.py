"""Physical plans: what reaches the reader, which operators run, and that nothing leaves the JVM."""

import re

import pytest

from tessera.plans import catalogue, engine_queries  # noqa: F401
from tessera.cli import main, statements
from tessera.client import Client
from tessera.streaming.rows import feed, pull

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_reader(spark):
    p = plan(spark, "scan_pk_range")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderkey,100\), LessThanOrEqual\(o_orderkey,200\)", p)
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    assert "EqualTo(o_orderkey,42)" in plan(spark, "scan_pk_point")
    assert "StringStartsWith(c_name,Customer#0000000)" in plan(spark, "like_prefix")
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan(spark, "scan_project_prune") or "struct<l_returnflag:string,l_tax:double>" in plan(spark, "scan_project_prune")
    assert "GreaterThan(o_totalprice,100000.0)" in plan(spark, "join_pred_pushdown") and "LessThan(c_acctbal,0.0)" in plan(spark, "join_pred_pushdown")


@pytest.mark.parametrize(
    "name,operator",
    [("topn_offset", "TakeOrderedAndProject"), ("agg_group_by", "HashAggregate"), ("subq_in", "LeftSemi"), ("subq_not_in", "LeftAnti"), ("join_left_outer", "LeftOuter"), ("join_cross", "CartesianProduct|NestedLoopJoin"),
     ("setop_union_all", "Union"), ("setop_intersect", "LeftSemi"), ("distinct_rows", "HashAggregate"), ("sort_multi_key", "Sort"), ("fts_indexed", r"PushedFilters: \[.*In\(token"), ("subq_scalar_where", "Subquery"), ("sql_topn", "TakeOrderedAndProject")],
)
def test_operator(spark, name, operator):
    assert re.search(operator, plan(spark, name))


def test_no_python_on_executors(spark):
    for name in catalogue.QUERIES:
        if not name.startswith(("dml_", "alter_", "auto_", "fts_index_ddl", "tx", "analyze", "explain", "column_groups", "index_scan", "match_trigram", "stream_")):
            assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan(spark, name)), name


def test_pull_and_feed(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/db")
    c.create_db("d")
    s = c.session("d")
    s.execute("create table t (id int primary key, v float)")
    spark.range(50).selectExpr("id", "id * 0.5D as v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, v double").parquet(f"{tmp_path}/in")
    for _ in range(2):
        feed(s, "t", stream, f"{tmp_path}/check", availableNow=True).awaitTermination()
    assert s.sql("select count(*), sum(v) from t").first()[:] == (50, 612.5)
    rows = pull(s, "select id from t order by id")
    assert [next(rows).id, next(rows).id] == [0, 1]
    rows.close()
    assert len(list(pull(s, "select id from t where id < @n", {"n": 7}))) == 7


def test_shell(spark, tmp_path):
    out = []
    assert list(statements(["select ';' ;\n", "select 2"])) == ["select ';'", "select 2"]
    main(f"file://{tmp_path}", "d", ["create table t (id int primary key); insert into t values (1), (2);", "select count(*) as n from t; nonsense;"], out.append)
    assert out[:4] == ["Table t created", "2 rows", "n", "2"] and out[4].startswith("Error")
