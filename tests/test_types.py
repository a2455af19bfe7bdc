"""Temporal, decimal and binary columns, overflow of sums, bound queries."""

import datetime
import decimal

import pytest

from tessera.client import Client, Query, Session
from tessera.sql.errors import SqlError

D, T, TS = datetime.date, datetime.time, datetime.datetime


@pytest.fixture(scope="module")
def c(spark, tmp_path_factory):
    out = Client(spark, f"file://{tmp_path_factory.mktemp('types')}")
    out.create_db("d")
    return out


def rows(c, sql, params=None):
    return [tuple(r) for r in c.execute_query("d", sql, params).rows()]


def test_temporal_and_decimal_columns(c):
    run = lambda sql, params=None: c.execute_query("d", sql, params).count
    run("create table v (id int primary key, d date default date '1999-02-03', t time, ts timestamp, dec decimal, raw bytea)")
    run("insert into v values (1, date '1997-11-30', time '23:01:07', timestamp '1997-11-30 23:01:07', decimal '80.125', cast('ab' as bytea))")
    run("insert into v (id, t, ts, dec) values (2, @t, @ts, @dec)", {"t": T(4, 5), "ts": TS(1998, 1, 2, 4, 5), "dec": decimal.Decimal("410.5")})
    assert rows(c, "select d, t, ts, dec, raw from v order by id") == [
        (D(1997, 11, 30), T(23, 1, 7), TS(1997, 11, 30, 23, 1, 7), decimal.Decimal("80.125"), b"ab"),
        (D(1999, 2, 3), T(4, 5), TS(1998, 1, 2, 4, 5), decimal.Decimal("410.5"), None),
    ]
    assert rows(c, "select sum(dec), min(d), max(ts), avg(dec) from v") == [(decimal.Decimal("490.625"), D(1997, 11, 30), TS(1998, 1, 2, 4, 5), decimal.Decimal("245.3125"))]
    assert rows(c, "select id from v where ts between timestamp '1998-01-01T00:00:00' and @hi", {"hi": TS(1998, 7, 1)}) == [(2,)]
    assert rows(c, "select id from v where dec > 200 and t < time '06:00:00'") == [(2,)]
    assert run("update v set dec = dec + decimal '0.10' where d = date '1997-11-30'") == 1
    assert rows(c, "select concat('', dec) from v where id = 1") == [("80.225",)]
    for bad in ("insert into v (id, d) values (9, '2026-01-01')", "insert into v (id, dec) values (9, 1)", "select id from v where d = 5", "select d + 1 from v"):
        with pytest.raises(SqlError):
            run(bad)


def test_temporal_keys(c):
    c.execute_query("d", "create table k (d date, dec decimal, v int, primary key (d, dec))")
    c.execute_query("d", "insert into k values (date '1999-02-03', decimal '1.5', 1), (date '1999-02-04', decimal '1.5', 2)")
    assert rows(c, "select v from k where d = @d and dec = @x", {"d": D(1999, 2, 4), "x": decimal.Decimal("1.50")}) == [(2,)]
    with pytest.raises(SqlError):
        c.execute_query("d", "insert into k values (date '1999-02-03', decimal '1.50', 3)")
    with c.transaction("d") as tx:
        tx("select v from k where d >= @d", {"d": D(1999, 2, 4)}).rows()
        c.execute_query("d", "insert into k values (date '1990-01-01', decimal '1', 9)")
        tx("delete from k where v = @v and d > date '1999-02-03'", {"v": 2})
    assert rows(c, "select count(*) from k") == [(2,)]


def test_sum_of_integers(spark):
    s = Session(spark)
    s.register("n", spark.createDataFrame([(1, 10), (2, 20), (3, 2**63 - 1), (4, 5)], "id bigint, n bigint"))
    assert s.execute("select sum(n) from n where id < 3").rows()[0][0] == 30
    big = s.execute("select sum(n) as a, count(*) as b from n").rows()[0]
    assert isinstance(big.a, float) and big.a == float(2**63 - 1 + 35) and big.b == 4
    with pytest.raises(Exception):
        s.execute("select n + 1 from n where id = 3").rows()


def test_bound_queries(spark):
    q = Query("select @a as a, ':x' as b, @b as c").bind("a", 5).bind("b", "it's")
    assert Session(spark).execute(q).rows()[0][:] == (5, ":x", "it's")
    assert q.interpolate() == "select 5L as a, ':x' as b, 'it\\'s' as c"
