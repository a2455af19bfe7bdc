"""Queries of the SQL front-end, DML, DDL and utility statements, registered beside the operator queries.

DML queries run statements against a throw-away database whose tables are filled from the Parquet tables, and return the
state that the statements leave; the oracle is the equivalent SELECT.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog.database import Database
from tessera.client import Session
from tessera.plans.catalogue import ORACLES, QUERIES
from tessera.sources.tables import shared_dir, table


def session(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session that reads the named tables."""
    out = Session(spark)
    for name in names:
        out.register(name, table(spark, sf_dir, name))
    return out


def database(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """The same with a database of its own to write to."""
    out = session(spark, sf_dir, *names)
    out.db = Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")
    out.db.create()
    return out


def text(name: str, sql: str, oracle: str | None, *names: str, params: dict | None = None) -> None:
    """A query that goes through parser and binder."""
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir, *names).sql(sql, params)
    if oracle:
        ORACLES[name] = oracle


SAME = {
    "sql_pricing": (
        "select l_returnflag, l_linestatus, round(sum(l_quantity)) as qty, count(*) as cnt, min(l_tax) as lo, max(l_discount) as hi from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
        "lineitem",
    ),
    "sql_join_chain": (
        "select r_name, n_name, count(*) as cnt from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey where c.c_acctbal > 0 group by r_name, n_name having count(*) > 1",
        "customer", "nation", "region",
    ),
    "sql_left_join": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey where c_acctbal < 1000", "customer", "orders"),
    "sql_subqueries": (
        "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders) and o_custkey in (select c_custkey from customer where c_acctbal > 5000) and exists (select r_name from region where r_regionkey = 1)",
        "orders", "customer", "region",
    ),
    "sql_cte": (
        "with a as (select o_custkey as k, count(*) as n from orders group by o_custkey), b as (select n, count(*) as customers from a group by n) select n, customers from b where n > 2",
        "orders",
    ),
    "sql_setop": ("select c_nationkey as k from customer where c_acctbal < 0 except all select s_nationkey from supplier", "customer", "supplier"),
    "sql_case_like": (
        "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as band, coalesce(p_brand, 'none') as brand from part where p_name like '%wid%' or p_type not like 'S%'",
        "part",
    ),
    "sql_topn": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 3", "orders"),
}
for _name, (_sql, *_tables) in SAME.items():
    text(_name, _sql, _sql, *_tables)

text("params", "select o_orderkey from orders where o_custkey between @low and @high and o_orderstatus <> @s", "select o_orderkey from orders where o_custkey between 10 and 60 and o_orderstatus <> 'F'", "orders", params={"low": 10, "high": 60, "s": "F"})
text("int_division", "select o_orderkey, o_orderkey / 7 as k7, o_totalprice / 2 as half from orders", "select o_orderkey, o_orderkey // 7 as k7, o_totalprice / 2 as half from orders", "orders")
text("sql_match", "select doc_id from documents where match(text) against('(the or der) and of')", ORACLES["fts_bool"], "documents")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prepared statement, executed with three bindings."""
    run = session(spark, sf_dir, "lineitem").prepare("select @f as flag, count(*) as n from lineitem where l_returnflag = @f")
    parts = [run({"f": f}).df for f in ("A", "N", "R")]
    return parts[0].union(parts[1]).union(parts[2])


QUERIES["prepared"] = prepared
ORACLES["prepared"] = "select f as flag, (select count(*) from lineitem where l_returnflag = f) as n from (values ('A'), ('N'), ('R')) v(f)"


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of EXPLAIN that do not depend on Spark's own plans: what is read how, and the operators of the text."""
    sql = "explain with big as (select o_custkey as k, count(*) as n from orders where o_totalprice > 10.0 and o_orderkey > 5 group by o_custkey) select c_name, n from customer left join big on k = c_custkey order by n desc limit 3"
    plan = session(spark, sf_dir, "orders", "customer").execute(sql).rows()[0][0]
    own, theirs = plan.split("== Parsed Logical Plan ==")
    assert "== Physical Plan ==" in theirs
    return spark.createDataFrame([(i, line) for i, line in enumerate(own.strip().split("\n"))], "n int, line string")


QUERIES["explain"] = explain
ORACLES["explain"] = """select * from (values (0, '== Access =='), (1, 'SeqScan customer'), (2, 'SeqScan orders'), (3, '== Logical =='), (4, 'With big'), (5, '  Aggregate 1'), (6, '  Filter 2'), (7, '    Table orders'),
  (8, 'Limit'), (9, 'Sort 1'), (10, 'Project 2'), (11, '  Join left'), (12, '    Table customer'), (13, '    Table big')) v(n, line)"""

NATION = "create table n (id int primary key, name string not null, region int)"
SUPPLIER = "create table s (id int primary key, name string, nation int, bal float)"


def dml(name: str, create: str, fill: str, statements: list[str], result: str, oracle: str, *names: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = database(spark, sf_dir, *names)
        for sql in (create, fill, *statements):
            s.execute(sql)
        return s.sql(result)

    QUERIES[name], ORACLES[name] = run, oracle


ALL_N, ALL_S = "insert into n select n_nationkey, n_name, n_regionkey from nation", "insert into s select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"
dml("dml_insert", NATION, ALL_N, ["insert into n values (100, 'Atlantis', 9), (101, concat('At', 'las'), 3 + 4)", "insert into n (id, name) values (102, 'Nowhere')"], "select * from n",
    "select cast(n_nationkey as bigint) as id, n_name as name, cast(n_regionkey as bigint) as region from nation union all select 100, 'Atlantis', 9 union all select 101, 'Atlas', 7 union all select 102, 'Nowhere', null", "nation")
dml("dml_insert_select", SUPPLIER, ALL_S, ["insert into s select id + 100000, upper(name), nation, bal * 2 from s where bal > 5000.0"], "select * from s",
    "select s_suppkey as id, s_name as name, cast(s_nationkey as bigint) as nation, s_acctbal as bal from supplier union all select s_suppkey + 100000, upper(s_name), s_nationkey, s_acctbal * 2 from supplier where s_acctbal > 5000", "supplier")
dml("dml_update", SUPPLIER, ALL_S, ["update s set bal = bal + 1.0, name = concat(name, '!') where nation < 10"], "select * from s",
    "select s_suppkey as id, case when s_nationkey < 10 then s_name || '!' else s_name end as name, cast(s_nationkey as bigint) as nation, case when s_nationkey < 10 then s_acctbal + 1 else s_acctbal end as bal from supplier", "supplier")
dml("dml_delete", SUPPLIER, ALL_S, ["delete from s where bal < 3000.0 or name is null"], "select * from s",
    "select s_suppkey as id, s_name as name, cast(s_nationkey as bigint) as nation, s_acctbal as bal from supplier where not coalesce(s_acctbal < 3000, false)", "supplier")
dml("dml_subquery", SUPPLIER, ALL_S, ["delete from s where nation in (select n_nationkey from nation where n_regionkey = 1)", "update s set bal = (select max(c_acctbal) from customer) where id <= 20"], "select * from s",
    "select s_suppkey as id, s_name as name, cast(s_nationkey as bigint) as nation, case when s_suppkey <= 20 then (select max(c_acctbal) from customer) else s_acctbal end as bal from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)",
    "supplier", "nation", "customer")
dml("alter_add", NATION, ALL_N, ["alter table n add column note string default 'none'", "insert into n values (200, 'New', 1, 'x')"], "select * from n",
    "select cast(n_nationkey as bigint) as id, n_name as name, cast(n_regionkey as bigint) as region, 'none' as note from nation union all select 200, 'New', 1, 'x'", "nation")
dml("alter_rename", NATION, ALL_N, ["alter table n rename column name to title", "update n set title = lower(title) where id > 5"], "select * from n",
    "select cast(n_nationkey as bigint) as id, case when n_nationkey > 5 then lower(n_name) else n_name end as title, cast(n_regionkey as bigint) as region from nation", "nation")
dml("alter_drop", NATION, ALL_N, ["alter table n drop column region"], "select * from n", "select cast(n_nationkey as bigint) as id, n_name as name from nation", "nation")
dml("auto_increment", "create table a (id serial primary key, name string)", "insert into a (name) values ('a'), ('b')", ["insert into a values (10, 'ten')", "insert into a (name) values ('next')"], "select * from a",
    "select * from (values (1::bigint, 'a'), (2, 'b'), (10, 'ten'), (11, 'next')) v(id, name)")
dml("fts_index_ddl", "create table docs (id int primary key, body string)", "insert into docs select doc_id, text from documents",
    ["create fulltext index ft on docs (body)", "analyze docs", "delete from docs where id < 10"], "select id from docs where match(body) against('token or secret or passed')",
    "select doc_id as id from documents where doc_id >= 10 and len(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t in ('token', 'secret', 'passed'))) > 0", "documents")


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of an indexed column."""
    s = database(spark, sf_dir, "supplier")
    for sql in (SUPPLIER, ALL_S, "create index by_nation on s (nation)", "analyze s"):
        s.execute(sql)
    stats = s.db.table("s")["statistics"]
    return spark.createDataFrame([(stats["rows"], i["entries"], i["distinct"]) for i in stats["indexes"].values()], "n_rows bigint, entries bigint, n_distinct bigint")


QUERIES["analyze"] = analyze
ORACLES["analyze"] = "select count(*) as n_rows, count(s_nationkey) as entries, count(distinct s_nationkey) as n_distinct from supplier"


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction that reads its own writes, and one that rolls back."""
    s = database(spark, sf_dir, "nation")
    s.execute(NATION)
    s.execute(ALL_N)
    one = s.db.begin()
    s.execute("update n set region = region + 10 where id < 5", tx=one)
    s.execute("insert into n select id + 500, name, region from n where region >= 10", tx=one)
    one.commit()
    two = s.db.begin("repeatable read")
    s.execute("delete from n", tx=two)
    two.rollback()
    return s.sql("select * from n")


QUERIES["tx"] = tx
ORACLES["tx"] = "with u as (select cast(n_nationkey as bigint) as id, n_name as name, cast(case when n_nationkey < 5 then n_regionkey + 10 else n_regionkey end as bigint) as region from nation) select * from u union all select id + 500, name, region from u where region >= 10"
