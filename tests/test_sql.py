"""The SQL front-end: dialect rules, rejected texts, and the catalogue's queries through it."""

import datetime
import decimal
import math

import pytest

from tessera.client import Session
from tessera.functions import text as fts
from tessera.sql.errors import SqlError
from tessera.sql.parser import parse
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    out = Session(spark)
    out.register("crews", spark.createDataFrame([(11, "North", 310.0), (12, "North", 290.0), (13, "South", 700.0), (14, "South", 900.0), (15, "West", 120.0)], "id bigint, team string, pay double"))
    out.register("gems", spark.createDataFrame([(1, "Opal", 10, 1.5, "Stone"), (2, "Jet", None, 2.5, None), (3, "Amber", 30, -3.2, "Resin")], "id bigint, name string, val bigint, factor double, kind string"))
    out.register("l", spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, None, "e")], "id bigint, k bigint, name string"))
    out.register("r", spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "z"), (4, 4, "w")], "id bigint, k bigint, tag string"))
    out.register("t", spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "a", 20), (4, "b", 30), (5, "b", 30), (6, "b", 30), (7, "c", None), (8, "c", 5)], "id bigint, k string, v bigint"))
    out.register("odd", spark.createDataFrame([(1, math.nan), (2, math.nan), (3, 6.5)], "id bigint, val double"))
    out.register("notes", spark.createDataFrame([(1, "Slow rivers carry sand to the flat delta"), (2, "A c++ delta of two files"), (3, "slow cooking needs sand timers"), (4, "The flat delta floods in spring"), (5, None)], "id bigint, body string"))
    out.register("flags", spark.createDataFrame([(1, True, decimal.Decimal("7.25")), (2, False, decimal.Decimal("9.50"))], "id bigint, live boolean, amount decimal(38,10)"))
    return out


def q(s, sql, params=None):
    return [tuple(r) for r in s.sql(sql, params).collect()]


CASES = [
    ("select 7 / 2, -7 / 2, 7 / 2.0, 1 + 2 * 3, -(-3)", [(3, -3, 3.5, 7, 3)]),
    ("select team, count(*) as n, avg(pay) from crews group by team having count(*) > 1 order by team desc", [("South", 2, 800.0), ("North", 2, 300.0)]),
    ("select count(distinct v), sum(distinct v), avg(distinct v), min(distinct v) from t", [(4, 65, 16.25, 5)]),
    ("select sum(v) / count(v) as m from t where k = 'a'", [(13,)]),
    ("select count(*), sum(v), min(v), avg(v) from t where id < 0", [(0, None, None, None)]),
    ("select upper(name), lower(kind), concat(name, '/', kind), abs(factor), round(factor) from gems where id = 3", [("AMBER", "resin", "Amber/Resin", 3.2, -3.0)]),
    ("select substr('meander', 0, 4), substr('meander', 5), substring('meander' from 3 for 2), substr('mud', -4, 2), substr('meander', -4, 3), length('ñ🌊')", [("mea", "der", "an", "m", "nde", 2)]),
    ("select id from gems where not (val = 10)", [(3,)]),
    ("select id from gems where kind not like 'R%' order by id", [(1,)]),
    ("select id from gems where kind is null", [(2,)]),
    ("select id from gems where val between 5 and 15", [(1,)]),
    ("select id from gems where val in (10, 'x', null)", [(1,)]),
    ("select id from gems where val not in (10, 'x') order by id", [(3,)]),
    ("select id from gems where val in ('x')", []),
    ("select id from gems where val order by id", [(1,), (3,)]),
    ("select case kind when null then 'no kind' when 'Resin' then 'soft' else 'hard' end from gems order by id", [("hard",), ("no kind",), ("soft",)]),
    ("select case when val > 20 then 1 when val > 5 then 2.5 end from gems order by id", [(2.5,), (None,), (1.0,)]),
    ("select coalesce(val, 0) from gems order by id", [(10,), (0,), (30,)]),
    ("select id from flags where live = 1", [(1,)]),
    ("select concat('x', 3.0, true, 2.50), cast(amount as text) from flags where id = 2", [("x3true2.5", "9.5")]),
    ("select cast(2.9 as int), cast(-2.9 as int), cast(' 42 ' as int), cast(true as int), cast(1e30 as int), cast(5 as bool), cast('1.5' as float)", [(2, -2, 42, 1, 2**63 - 1, True, 1.5)]),
    ("select date '1997-11-30', timestamp '1997-11-30 23:01:07', cast(date '1997-11-30' as timestamp), cast(timestamp '1997-11-30 23:01:07' as date)",
     [(datetime.date(1997, 11, 30), datetime.datetime(1997, 11, 30, 23, 1, 7), datetime.datetime(1997, 11, 30), datetime.date(1997, 11, 30))]),
    ("select decimal '1.10' + 1", [(decimal.Decimal("2.10"),)]),
    ('select "text" as a', [("text",)]),
    (r"select 'a\b' like 'a\_', 'a_b' like 'a_b', 'a' like 'A'", [(True, True, False)]),
    ("select l.name, r.tag from l join r on l.k = r.k order by l.id, r.id", [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z")]),
    ("select l.name, r.tag from l left join r on l.k = r.k where l.id > 2 order by l.id", [("c", "z"), ("d", None), ("e", None)]),
    ("select count(*) from l, r", [(20,)]),
    ("select count(*) from l cross join r", [(20,)]),
    ("select count(*) from odd a join odd b on a.val = b.val", [(5,)]),
    ("select count(*) from (select distinct val from odd) as d", [(2,)]),
    ("select a.k from l a join l b on a.k = b.k where a.id < b.id", [(1,)]),
    ("select k from l union select k from r order by k", [(None,), (1,), (2,), (3,), (4,)]),
    ("select k from l intersect all select k from r order by k", [(1,), (1,), (2,)]),
    ("select k from l except all select k from r order by k", [(None,), (3,)]),
    ("(select k from l where k = 1) union all (select k from r where k = 1 limit 1)", [(1,), (1,), (1,)]),
    ("select id from t order by v desc, id limit 2 offset 1", [(5,), (6,)]),
    ("select id from t order by id limit 1, 2", [(2,), (3,)]),
    ("select v from t where k = 'c' order by v", [(None,), (5,)]),
    ("with a(x) as (select id from l where id < 3), c as (select x + 10 as y from a) select y from c order by y", [(11,), (12,)]),
    ("select d.n from (select count(*) from l) as d(n)", [(5,)]),
    ("select id from l where k = (select max(k) from r where k < 3)", [(3,)]),
    ("select (select k from r where id < 0)", [(None,)]),
    ("select id from l where k in (select k from r) order by id", [(1,), (2,), (3,)]),
    ("select id from l where k not in (select k from r where k is not null) order by id", [(4,)]),
    ("select count(*) from l where exists (select id from r where tag = 'w')", [(5,)]),
    ("select id from notes where match(body) against('slow OR c++') order by id", [(1,), (2,), (3,)]),
    ("select id from notes where match(body) against('(slow OR c++) AND delta') order by id", [(1,), (2,)]),
    ("select id from notes where match(body) against('slow delta')", [(1,)]),
    ("select id from notes where match(body) against('\"flat delta\"') order by id", [(1,), (4,)]),
    ("select id from notes where not match(body) against('delta') order by id", [(3,), (5,)]),
    ("select crews.team, pay from crews order by pay desc limit 1", [("South", 900.0)]),
    ("select * from l where id = 1", [(1, 1, "a")]),
    ("select r.*, l.id from l join r on l.id = r.id where l.id = 1", [(1, 1, "x", 1)]),
]


@pytest.mark.parametrize("sql,want", CASES, ids=[c[0][:60] for c in CASES])
def test_query(s, sql, want):
    assert q(s, sql) == want


REJECTED = [
    "", "select 1; select 2", "select foo(1)", "select 1 % 2", "select 'a' || 'b'", "select count(distinct *) from t", "select count() from t", "select sum(v) over (partition by k) from t",
    "select id from t order by all", "select distinct on (k) k from t", "select k from t group by rollup (k)", "select nope from t", "select t.id, l.id, k from t join l on t.id = l.id",
    "select 'a' + 1", "select 'a' < 1", "select id from t union select k from t", "select id, k from t union select id from t", "with recursive a as (select 1) select * from a",
    "with a as (select 1), a as (select 2) select * from a", "select (select id, k from t)", "select sum(k) from t", "select * from (select 1)", "select * from lateral (select 1) as x",
    "select cast(1 as json)", "select id from t limit -1", "select match(id, k) against('x') from t", "select id from t where match(k) against('\"open')", "select * from missing",
    "select id from t natural join l", "select id from l join r using (id)", "select case when 1 then 2 else 'x' end", "copy t from 'x'", "select id from t where count(*) > 1", "select 99999999999999999999",
]


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected(s, sql):
    with pytest.raises((SqlError, ValueError)):
        s.sql(sql)


def test_errors_at_run_time(s):
    for sql in ("select 1 / (id - id) from t", "select 9223372036854775807 + id from t", "select (select id from t)", "select substr('abc', 1, id - 5) from t where id = 1", "select cast('x' as int)"):
        with pytest.raises(Exception):
            s.sql(sql).collect()


def test_strict_rejects_what_the_dialect_lacks(spark, s):
    strict = Session(spark, strict=True)
    strict.frames = s.frames
    for sql in ("select 1 from l right join r on l.id = r.id", "select 1 from l join r on l.id < r.id", "select id from l where exists (select 1 from r where r.id = l.id)"):
        s.sql(sql)
        with pytest.raises(SqlError):
            strict.sql(sql)


def test_parameters(s):
    assert q(s, "select id from t where k = @k and v >= :low order by id limit @n", {"k": "a", "low": 10, "n": 2}) == [(1,), (2,)]
    assert q(s, "select id from t where k = ? and v = ?", {"p1": "a", "p2": 20}) == [(3,)]
    assert q(s, "select @d, @x, @b", {"d": datetime.date(2001, 5, 6), "x": "it's \\ ok", "b": None}) == [(datetime.date(2001, 5, 6), "it's \\ ok", None)]
    with pytest.raises(SqlError):
        s.sql("select @missing")
    run = s.prepare("select count(*) from t where v = @v")
    assert [run({"v": v}).rows()[0][0] for v in (10, 30, None)] == [2, 3, 0]


def test_views_do_not_stay(spark, s):
    s.sql("select count(*) from t join l on t.id = l.id where t.id in (select id from r)").collect()
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("t_")]


def test_explain(s):
    plan = s.sql("explain select k, count(*) from t where v > 5 group by k").first()[0]
    assert "Physical Plan" in plan and "Aggregate" in plan


def test_python_tokenizer(spark, s):
    fts.register_python_tokenizer(spark, "comma", lambda t: [w for w in t.split(",") if w])
    assert "tessera_tokens_comma" in fts.match_sql("c", "oak", "comma")
    df = spark.createDataFrame([(1, "oak,elm"), (2, "red pine,fir"), (3, None)], "id int, list string")
    assert [r.id for r in df.where(fts.match(df["list"], "oak OR fir", "comma")).collect()] == [1, 2]


def test_parser_keeps_precedence():
    e = parse("select 1 from t where a = 1 or b = 2 and not c = 3").query.body.where
    assert (e.op, e.right.op, e.right.right.kind) == ("OR", "AND", "not")


SAME = {
    "q_scan": "select r_regionkey, r_name from region",
    "q_agg": "select l_returnflag, l_linestatus, count(*) as cnt, min(l_quantity) as lo, max(l_tax) as hi from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "q_join": "select r_name, count(*) as cnt from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "q_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey",
    "q_topn": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5",
    "q_sub": "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders) and o_custkey in (select c_custkey from customer where c_acctbal > 0)",
    "q_cte": "with a as (select o_custkey as k, count(*) as n from orders group by o_custkey) select n, count(*) as c from a where n > 1 group by n",
    "q_set": "select c_nationkey as k from customer except all select s_nationkey from supplier",
}


@pytest.mark.parametrize("name", sorted(SAME))
def test_text_valid_in_both_engines(spark, name):
    def run(spark, sf):
        out = Session(spark)
        for t in TABLES:
            out.register(t, spark.read.parquet(f"{sf}/{t}.parquet"))
        return out.sql(SAME[name])

    assert compare(spark, run, SAME[name], SF) > 0
