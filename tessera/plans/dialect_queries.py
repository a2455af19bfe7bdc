"""Queries for the parts of the dialect and of the engine around it: types, rejections, definitions, plans, transactions, streams.

Where a part gives messages or errors and not a table, the query lists what happened, one row for each step, and the oracle
states what has to happen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cli
from tessera.client import Client, Query, Session
from tessera.plans.catalogue import ORACLES, QUERIES
from tessera.plans.engine_queries import ALL_N, ALL_S, NATION, SUPPLIER, database, session, text
from tessera.sources.tables import shared_dir, table
from tessera.sql.errors import ConflictError, SqlError
from tessera.streaming.rows import feed, pull

# types
text(
    "sql_casts",
    """select c_custkey, concat('', cast(c_custkey as decimal)) as dec, cast(c_custkey as bool) as flag, cast(cast(c_name as bytea) as string) as raw,
    concat('', cast(timestamp '2024-03-04 05:06:07' as date)) as d, concat('', cast('05:06:07' as time)) as t, cast(cast('2024-03-04' as date) as timestamp) = timestamp '2024-03-04 00:00:00' as ts,
    cast(c_acctbal as int) as whole, cast('17' as int) + cast(' 4 ' as int) as n, cast('2.5' as float) as f from customer""",
    """select c_custkey, cast(c_custkey as varchar) as dec, c_custkey <> 0 as flag, c_name as raw, '2024-03-04' as d, '05:06:07' as t, true as ts,
    cast(trunc(c_acctbal) as bigint) as whole, 21::bigint as n, 2.5::double as f from customer""",
    "customer",
)
text(
    "typed_literals",
    "select o_orderkey from orders where cast(o_orderdate as date) between date '1995-01-01' and date '1996-06-30' and cast(o_orderkey as decimal) > decimal '25.5' and time '10:00:00' < time '11:30:00' and o_orderdate < timestamp '1996-01-01 12:00:00'",
    "select o_orderkey from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01 12:00:00' and o_orderkey > 25.5",
    "orders",
)
text(
    "decimal_arithmetic",
    "select p_partkey, concat('', cast(p_size as decimal) + decimal '0.25') as a, concat('', cast(p_size as decimal) * decimal '2.00') as b from part where cast(p_size as decimal) >= decimal '10.50'",
    "select p_partkey, p_size || '.25' as a, cast(p_size * 2 as varchar) as b from part where p_size >= 10.5",
    "part",
)

# joins and subqueries
text("join_comma", "select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey and c_acctbal > 9000.0", "select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey and c_acctbal > 9000", "customer", "nation")
text("subq_not_exists", "select c_custkey from customer c where not exists (select o_orderkey from orders where o_custkey = c.c_custkey and o_totalprice > 300000.0)", "select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c.c_custkey and o_totalprice > 300000)", "customer", "orders")
text(
    "subq_in_case",
    "select r_name, case when exists (select n_nationkey from nation where n_regionkey = 99) then 'some' else 'none' end as e, (select max(n_name) from nation) as top from region",
    "select r_name, 'none' as e, (select max(n_name) from nation) as top from region",
    "region", "nation",
)
text("sql_having_alias_order", "select o_orderstatus as s, count(*) as n from orders group by o_orderstatus having count(*) > 2 order by n desc, s limit 2", "select o_orderstatus as s, count(*) as n from orders group by o_orderstatus having count(*) > 2 order by n desc, s limit 2", "orders")
text("sql_derived_columns", "select d.a, d.b from (select n_regionkey, count(*) from nation group by n_regionkey) as d(a, b) where d.b > 1", "select n_regionkey as a, count(*) as b from nation group by n_regionkey having count(*) > 1", "nation")


def steps(name: str, oracle: list[tuple[str, str]]):
    """Register a function that returns what happened, step by step; `oracle` is what has to happen."""

    def wrap(fn: Callable[[SparkSession, str], list[tuple[str, str]]]):
        QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(fn(spark, sf_dir), "step string, outcome string")
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        ORACLES[name] = f"select * from (values {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in oracle)}) v(step, outcome)"
        return fn

    return wrap


def outcomes(run: Callable[[str], object], statements: list[str]) -> list[tuple[str, str]]:
    """Each statement with its message or number of rows, or the kind of its error."""
    out = []
    for sql in statements:
        try:
            result = run(sql)
            out.append((sql, result.message if result.df is None else f"{len(result.rows())} rows"))
        except (SqlError, ValueError) as e:
            out.append((sql, "conflict" if isinstance(e, ConflictError) else "rejected"))
    return out


REFUSED = [
    "select sum(n_nationkey) over (partition by n_regionkey) from nation", "select sum(n_nationkey) filter (where n_regionkey = 1) from nation", "select 1; select 2", "select n_name || 'x' from nation", "select n_name + 1 from nation",
    "select nope from nation", "select * from nowhere", "select n_name from nation union select n_nationkey from nation", "select n_name from nation natural join region", "select cast(n_name as json) from nation", "select n_name from nation limit -1",
]
LIMITED = ["select r_name from region right join nation on n_regionkey = r_regionkey", "select r_name from region join nation on n_regionkey < r_regionkey", "select r_name from region where exists (select n_name from nation where n_regionkey = r_regionkey)"]


@steps("rejections", [*((q, "rejected") for q in REFUSED), ("select n_name from nation where n_nationkey = 3", "1 rows")])
def rejections(spark, sf_dir):
    s = session(spark, sf_dir, "nation", "region")
    return outcomes(s.execute, [*REFUSED, "select n_name from nation where n_nationkey = 3"])


@steps("strict_rejections", [(q, "rejected") for q in LIMITED])
def strict_rejections(spark, sf_dir):
    s = Session(spark, strict=True)
    for name in ("nation", "region"):
        s.register(name, table(spark, sf_dir, name))
    return outcomes(s.execute, LIMITED)


def sum_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer sums that pass 64 bits become doubles."""
    s = Session(spark)
    s.register("big", table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey") + F.lit(9223372036854770000)).alias("v")))
    rows = s.execute("select k, sum(v) as total, count(*) as n from big group by k").rows()
    return spark.createDataFrame([tuple(r) for r in rows], "k bigint, total double, n bigint")


QUERIES["sum_promotion"] = sum_promotion
ORACLES["sum_promotion"] = "select n_regionkey as k, cast(sum(n_nationkey::hugeint + 9223372036854770000) as double) as total, count(*) as n from nation group by n_regionkey"

# definitions
DEFINED = [
    ("create table n (id int primary key, name string not null, region int)", "Table n created"), ("create table n (id int primary key)", "rejected"), ("create table if not exists n (id int primary key)", "Table n created"),
    (ALL_N, "25 rows"), ("create index by_region on n (region)", "Index by_region created"), ("create index by_region on n (name)", "rejected"), ("analyze n", "Table n analyzed"), ("drop index by_region", "Index by_region dropped"),
    ("drop index by_region", "rejected"), ("insert into n values (3, 'again', 1)", "rejected"), ("insert into n values (77, null, 1)", "rejected"), ("alter table n add column note string default 'x'", "Column added"),
    ("alter table n drop column id", "rejected"), ("alter table n rename column note to remark", "Column renamed"), ("alter table n drop column remark", "Column dropped"), ("update n set region = 7 where id >= 20", "5 rows"),
    ("delete from n where id < 5", "5 rows"), ("select id from n", "20 rows"), ("drop table n", "Table n dropped"), ("drop table n", "rejected"), ("drop table if exists n", "Table n dropped"), ("select id from n", "rejected"),
]


@steps("ddl_messages", DEFINED)
def ddl_messages(spark, sf_dir):
    return outcomes(database(spark, sf_dir, "nation").execute, [q for q, _ in DEFINED])


def grouped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with column groups: accepted; Parquet keeps columns apart by itself."""
    s = database(spark, sf_dir, "supplier")
    s.execute("create table g (id int primary key, name string, nation int, bal float) with (locality_groups = 'a:name;b:nation,bal')")
    s.execute("insert into g select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
    return s.sql("select name from g where id <= 50")


QUERIES["column_groups"] = grouped_columns
ORACLES["column_groups"] = "select s_name as name from supplier where s_suppkey <= 50"


# indexes and plans
def orders_table(spark: SparkSession, sf_dir: str) -> Session:
    s = database(spark, sf_dir, "orders")
    s.execute("create table o (id int primary key, cust int, status string, price float)")
    for part in range(3):
        s.execute(f"insert into o select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_custkey >= {part * 50} and o_custkey < {part * 50 + 50}")
    s.execute("create index by_cust on o (cust)")
    return s


BY_CUST = "select id, price from o where cust between 20 and 24 and status <> 'F'"


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of an indexed column, after changes: entries of files that are gone are skipped."""
    s = orders_table(spark, sf_dir)
    for sql in ("analyze o", "update o set price = price + 1.0 where cust = 22", "delete from o where cust = 23"):
        s.execute(sql)
    out = s.sql(BY_CUST)
    assert s.access and s.access[0].startswith("IndexScan o using by_cust"), s.access
    return out


QUERIES["index_scan"] = index_scan
ORACLES["index_scan"] = "select o_orderkey as id, o_totalprice + case when o_custkey = 22 then 1 else 0 end as price from orders where o_custkey in (20, 21, 22, 24) and o_orderstatus <> 'F'"

_EXPLAINED = ["Project 2", "Filter 2", "  Table o"]


@steps(
    "explain_access",
    [("before statistics 0", "SeqScan o"), ("with statistics 0", "IndexScan o using by_cust (cust between 20 and 24): 1 files"), ("dropped 0", "SeqScan o"), *((f"{when} {i + 1}", line) for when in ("before statistics", "with statistics", "dropped") for i, line in enumerate(_EXPLAINED))],
)
def explain_access(spark, sf_dir):
    """How a statement reads its table and what it does, as EXPLAIN says, before and after ANALYZE and without the index."""
    s, out = orders_table(spark, sf_dir), []
    for when, sql in (("before statistics", None), ("with statistics", "analyze o"), ("dropped", "drop index by_cust")):
        if sql:
            s.execute(sql)
        lines = s.execute(f"explain {BY_CUST}").rows()[0][0].split("\n")
        assert any("Physical Plan" in line for line in lines)
        out += [(f"{when} {i}", line) for i, line in enumerate([lines[1], *lines[3:6]])]
    return out


def match_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH takes the tokenizer of the column's index: with trigrams it finds parts of words."""
    s = database(spark, sf_dir, "part")
    for sql in ("create table p (id int primary key, name string)", "insert into p select p_partkey, p_name from part", "create fulltext index tri on p (name) using trigram", "analyze p"):
        s.execute(sql)
    return s.sql("select id from p where match(name) against('dget OR orn')")


QUERIES["match_trigram"] = match_trigram
ORACLES["match_trigram"] = "select p_partkey as id from part where (contains(lower(p_name), 'dge') and contains(lower(p_name), 'get')) or contains(lower(p_name), 'orn')"


# transactions
def race(spark: SparkSession, sf_dir: str, level: str, mine: list[str], theirs: str) -> str:
    s = database(spark, sf_dir, "nation")
    s.execute(NATION)
    s.execute(ALL_N)
    tx = s.db.begin(level)
    for sql in mine:
        s.execute(sql, tx=tx).rows()
    s.execute(theirs)
    try:
        tx.commit()
    except ConflictError:
        return "conflict"
    return "committed"


RACES = {
    "same key": (["update n set region = 9 where id = 3"], "update n set region = 8 where id = 3", {"read uncommitted": True, "read committed": True, "repeatable read": True, "snapshot": True}),
    "other key": (["update n set region = 9 where id = 3"], "update n set region = 8 where id = 4", {"read committed": False, "snapshot": False}),
    "read key": (["select region from n where id = 4", "update n set region = 9 where id = 3"], "update n set region = 8 where id = 4", {"read committed": False, "repeatable read": True, "snapshot": True}),
    "new key in a read range": (["select count(*) from n where id between 20 and 200", "update n set region = 9 where id = 3"], "insert into n values (150, 'New', 1)", {"repeatable read": False, "snapshot": True}),
}


@steps("isolation", [(f"{name}, {level}", "conflict" if clash else "committed") for name, (_, _, levels) in RACES.items() for level, clash in levels.items()])
def isolation(spark, sf_dir):
    return [(f"{name}, {level}", race(spark, sf_dir, level, mine, theirs)) for name, (mine, theirs, levels) in RACES.items() for level in levels]


@steps("client_transactions", [("databases", "created, again rejected, flushed, dropped, gone"), ("in a block", "3 rows"), ("after an error", "3 rows"), ("function", "4 rows"), ("definition inside", "rejected"), ("bound", "1 rows")])
def client_transactions(spark, sf_dir):
    c, out = Client(spark, f"{shared_dir(spark)}/client-{uuid.uuid4().hex}"), []
    done = []
    for label, call in (("created", lambda: c.create_db("x")), ("again rejected", lambda: c.create_db("x")), ("flushed", lambda: c.flush_db("x")), ("dropped", lambda: c.drop_db("x")), ("gone", lambda: c.session("x"))):
        try:
            call()
            done.append(label if label not in ("again rejected", "gone") else "!")
        except SqlError:
            done.append(label if label in ("again rejected", "gone") else "!")
    out.append(("databases", ", ".join(done)))
    c.create_db("d")
    c.execute_query("d", "create table t (id int primary key, v string)")
    rows = lambda q="select id from t": f"{len(c.execute_query('d', q).rows())} rows"
    with c.transaction("d") as run:
        run("insert into t values (1, 'a'), (2, 'b'), (3, 'c')")
    out.append(("in a block", rows()))
    try:
        with c.transaction("d", "repeatable read") as run:
            run("delete from t")
            raise KeyError
    except KeyError:
        out.append(("after an error", rows()))
    c.run_in_transaction("d", lambda run: run("insert into t values (4, 'd')"))
    out.append(("function", rows()))
    with c.transaction("d") as run:
        try:
            run("drop table t")
        except SqlError:
            out.append(("definition inside", "rejected"))
    out.append(("bound", rows(Query("select id from t where v = @v").bind("v", "b"))))
    return out


@steps("shell", [("1", "Table t created"), ("2", "2 rows"), ("3", "id\tname"), ("4", "1\ta;b"), ("5", "2\tNULL"), ("6", "Error")])
def shell(spark, sf_dir):
    out: list[str] = []
    cli.main(f"{shared_dir(spark)}/shell-{uuid.uuid4().hex}", "d", ["create table t (id int primary key, name string);", "insert into t values (1, 'a;b'), (2, null); select id, name", " from t order by id; select nope from t;"], out.append)
    return [(str(i + 1), line.split(":")[0]) for i, line in enumerate(out)]


# streams
def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table fed by a stream, twice from one checkpoint: every row once."""
    s = database(spark, sf_dir)
    s.execute(SUPPLIER)
    at = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_acctbal").alias("bal"))
    rows.write.parquet(f"{at}/in")
    for _ in range(2):
        feed(s, "s", spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/checkpoint", availableNow=True).awaitTermination()
    return s.sql("select * from s")


QUERIES["stream_feed"] = stream_feed
ORACLES["stream_feed"] = "select cast(s_suppkey as bigint) as id, s_name as name, cast(s_nationkey as bigint) as nation, s_acctbal as bal from supplier"


def stream_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken one by one from a query over a table, in a transaction of their own."""
    s = database(spark, sf_dir, "supplier")
    s.execute(SUPPLIER)
    s.execute(ALL_S)
    return spark.createDataFrame([(r.id, r.name) for r in pull(s, "select id, name from s where id < @n order by id", {"n": 9})], "id bigint, name string")


QUERIES["stream_pull"] = stream_pull
ORACLES["stream_pull"] = "select cast(s_suppkey as bigint) as id, s_name as name from supplier where s_suppkey < 9"
