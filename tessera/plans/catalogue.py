"""The registered queries: one per operator, each with the same query as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar, text
from tessera.operators import relational as rel
from tessera.sources.tables import scan_range, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None, *names: str):
    """Register fn(**tables) under `name`; `names` are the tables it takes, in order."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[table(spark, sf_dir, t) for t in names])
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def ts(value: str):
    return F.lit(value).cast("timestamp_ntz")


# scans
query("scan_full", "select * from region", "region")(lambda r: r)
query("scan_pk_point", "select * from orders where o_orderkey = 42", "orders")(lambda o: o.where(c("o_orderkey") == 42))
query("scan_pk_range", "select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 200", "orders")(
    lambda o: scan_range(o, "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")
)
query("scan_project_prune", "select l_returnflag, l_tax from lineitem", "lineitem")(lambda li: li.select("l_returnflag", "l_tax"))
query(
    "index_range",
    "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate between timestamp '1995-01-01 00:00:00' and timestamp '1995-12-31 00:00:00'",
    "lineitem",
)(lambda li: li.where(c("l_shipdate").between(ts("1995-01-01 00:00:00"), ts("1995-12-31 00:00:00"))).select("l_orderkey", "l_linenumber", "l_shipdate"))


# filters and projections
query(
    "filter_and_or_not",
    "select l_orderkey, l_linenumber from lineitem where (l_quantity > 40 or l_discount < 0.02::double) and not (l_returnflag = 'R')",
    "lineitem",
)(lambda li: li.where(((c("l_quantity") > 40) | (c("l_discount") < 0.02)) & ~(c("l_returnflag") == "R")).select("l_orderkey", "l_linenumber"))
query(
    "project_arith",
    "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as revenue, l_orderkey // 7 as k7, -l_quantity as neg from lineitem",
    "lineitem",
)(
    lambda li: li.select(
        "l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"),
        scalar.int_divide(c("l_orderkey"), F.lit(7).cast("bigint")).alias("k7"), (-c("l_quantity")).alias("neg"),
    )
)
query("between_in", "select p_partkey from part where p_size between 5 and 15 and p_brand in ('Brand#11','Brand#12','Brand#23')", "part")(
    lambda p: p.where(c("p_size").between(5, 15) & c("p_brand").isin("Brand#11", "Brand#12", "Brand#23")).select("p_partkey")
)
query("not_in_list", "select n_name from nation where n_regionkey not in (1, 3)", "nation")(lambda n: n.where(~c("n_regionkey").isin(1, 3)).select("n_name"))
query("like_prefix", "select c_custkey, c_name from customer where c_name like 'Customer#0000000%'", "customer")(
    lambda cu: cu.where(scalar.like(c("c_name"), "Customer#0000000%")).select("c_custkey", "c_name")
)
query("like_infix", "select doc_id from documents where text like '%the%'", "documents")(lambda d: d.where(scalar.like(c("text"), "%the%")).select("doc_id"))
query("not_like", "select n_name from nation where n_name not like '%1%'", "nation")(lambda n: n.where(~scalar.like(c("n_name"), "%1%")).select("n_name"))
query(
    "null_3vl",
    "select d.doc_id, (quality = 1 and toxic = 0) as a, (quality = 1 or toxic = 0) as o, not (quality = 1) as n from documents d left join labels l on d.doc_id = l.doc_id",
    "documents", "labels",
)(
    lambda d, lb: d.select("doc_id").join(lb, "doc_id", "left").select(
        "doc_id", ((c("quality") == 1) & (c("toxic") == 0)).alias("a"), ((c("quality") == 1) | (c("toxic") == 0)).alias("o"), (~(c("quality") == 1)).alias("n")
    )
)
query("is_null", "select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id where l.doc_id is null", "documents", "labels")(
    lambda d, lb: d.select("doc_id").join(lb.select(c("doc_id").alias("k")), c("doc_id") == c("k"), "left").where(c("k").isNull()).select("doc_id")
)


# joins
def _oc(o, cu):
    return o.join(cu, c("o_custkey") == c("c_custkey"))


query("join_inner_equi", "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey", "orders", "customer")(
    lambda o, cu: _oc(o, cu).select("o_orderkey", "c_name", "o_totalprice")
)
query(
    "join_pred_pushdown",
    "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 100000 and c_acctbal < 0",
    "orders", "customer",
)(lambda o, cu: _oc(o, cu).where((c("o_totalprice") > 100000) & (c("c_acctbal") < 0)).select("o_orderkey", "c_name"))
query("join_left_outer", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey", "customer", "orders")(
    lambda cu, o: cu.join(o, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")
)
query("join_left_filtered", "select n_name, s_name from nation left join supplier on n_nationkey = s_nationkey where n_regionkey = 2", "nation", "supplier")(
    lambda n, s: n.where(c("n_regionkey") == 2).join(s, c("n_nationkey") == c("s_nationkey"), "left").select("n_name", "s_name")
)
query("join_cross", "select r_name, n_name from region cross join nation", "region", "nation")(lambda r, n: r.crossJoin(n).select("r_name", "n_name"))
query(
    "join_self_alias",
    "select a.n_name as a_name, b.n_name as b_name from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey",
    "nation",
)(
    lambda n: n.alias("a").join(n.alias("b"), c("a.n_regionkey") == c("b.n_regionkey")).where(c("a.n_nationkey") < c("b.n_nationkey"))
    .select(c("a.n_name").alias("a_name"), c("b.n_name").alias("b_name"))
)
query(
    "join_multiway",
    "select r_name, count(*) as cnt, sum(c_acctbal) as bal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "customer", "nation", "region",
)(
    lambda cu, n, r: cu.join(n, c("c_nationkey") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey"))
    .groupBy("r_name").agg(F.count("*").alias("cnt"), F.sum("c_acctbal").alias("bal"))
)


# aggregation
def q1_like(li: DataFrame) -> DataFrame:
    return (
        li.where(c("l_shipdate") <= ts("1998-09-02 00:00:00")).groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"),
            F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("cnt"),
        ).orderBy("l_returnflag", "l_linestatus")
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on the order of addition in the last bits."""
    return df.withColumns({n: F.round(n, 4) for n in names})


query(
    "tpch_q1_like",
    "select l_returnflag, l_linestatus, round(sum(l_quantity),4) as sum_qty, round(sum(l_extendedprice),4) as sum_base, round(sum(l_extendedprice * (1 - l_discount)),4) as sum_disc, round(avg(l_quantity),4) as avg_qty, count(*) as cnt from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "lineitem",
)(lambda li: rounded(q1_like(li), "sum_qty", "sum_base", "sum_disc", "avg_qty"))
query(
    "agg_global",
    "select count(*) as n, cast(sum(l_linenumber) as bigint) as s, round(sum(l_extendedprice),2) as total, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_quantity),4) as mean from lineitem",
    "lineitem",
)(
    lambda li: li.agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.round(F.avg("l_quantity"), 4).alias("mean"),
    )
)
query("agg_group_by", "select l_returnflag, l_linestatus, count(*) as cnt, round(sum(l_quantity),4) as qty from lineitem group by 1, 2", "lineitem")(
    lambda li: li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("cnt"), F.round(F.sum("l_quantity"), 4).alias("qty"))
)
query(
    "agg_empty_input",
    "select count(*) as n, sum(l_quantity) as s, min(l_quantity) as lo, avg(l_quantity) as mean from lineitem where l_orderkey < 0",
    "lineitem",
)(lambda li: li.where(c("l_orderkey") < 0).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.min("l_quantity").alias("lo"), F.avg("l_quantity").alias("mean")))
query(
    "agg_having",
    "select o_custkey, count(*) as n, max(o_totalprice) as hi from orders group by o_custkey having count(*) > 5 and max(o_totalprice) >= 1000",
    "orders",
)(lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("hi")).where((c("n") > 5) & (c("hi") >= 1000)))
query("agg_group_expr", "select substring(o_orderpriority,1,1) as p, count(*) as n from orders group by substring(o_orderpriority,1,1)", "orders")(
    lambda o: o.groupBy(F.substring("o_orderpriority", 1, 1).alias("p")).agg(F.count("*").alias("n"))
)
query(
    "agg_distinct",
    "select count(distinct l_suppkey) as n, cast(sum(distinct l_linenumber) as bigint) as s, avg(distinct l_linenumber) as m from lineitem",
    "lineitem",
)(lambda li: li.agg(F.count_distinct("l_suppkey").alias("n"), F.sum_distinct("l_linenumber").alias("s"), F.expr("avg(distinct l_linenumber)").alias("m")))
query("agg_minmax_ts", "select event_type, min(ts) as first_ts, max(ts) as last_ts from events group by event_type", "events")(
    lambda e: e.groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
)
query(
    "agg_expr",
    "select o_custkey, round(sum(o_totalprice) / count(*), 4) as m, round(max(o_totalprice) - min(o_totalprice), 4) as rng from orders group by o_custkey",
    "orders",
)(
    lambda o: o.groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice") / F.count("*"), 4).alias("m"), F.round(F.max("o_totalprice") - F.min("o_totalprice"), 4).alias("rng")
    )
)


# sort, limit, distinct
query("sort_multi_key", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority desc, o_totalprice, o_orderkey", "orders")(
    lambda o: o.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(c("o_orderpriority").desc(), "o_totalprice", "o_orderkey")
)
query("topn_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5", "orders")(
    lambda o: rel.top_n(o.select("o_orderkey", "o_totalprice"), c("o_totalprice").desc(), c("o_orderkey"), limit=10, offset=5)
)
query("limit_zero", "select o_orderkey from orders limit 0", "orders")(lambda o: o.select("o_orderkey").limit(0))
query("distinct_rows", "select distinct l_returnflag, l_linestatus from lineitem", "lineitem")(lambda li: li.select("l_returnflag", "l_linestatus").distinct())

# set operations
for _op in ("union", "intersect", "except"):
    for _all in (False, True):
        query(
            f"setop_{_op}{'_all' * _all}", f"select c_nationkey as k from customer {_op}{' all' * _all} select s_nationkey from supplier", "customer", "supplier"
        )(lambda cu, s, op=_op, every=_all: rel.set_op(cu.select(c("c_nationkey").alias("k")), s.select("s_nationkey"), op, every))


# subqueries, common table expressions
query(
    "cte_chain",
    "with a(k, total) as (select o_custkey, sum(o_totalprice) from orders group by o_custkey), b as (select k, total from a where total > 100000) select count(*) as n, round(max(total), 4) as hi from b",
    "orders",
)(
    lambda o: o.groupBy(c("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("total")).where(c("total") > 100000)
    .agg(F.count("*").alias("n"), F.round(F.max("total"), 4).alias("hi"))
)
query("derived_table", "select d.k, d.n from (select c_nationkey, count(*) from customer group by c_nationkey) as d(k, n) where d.n > 3", "customer")(
    lambda cu: cu.groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("n")).where(c("n") > 3)
)
query("subq_scalar_where", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)", "orders")(
    lambda o: o.where(c("o_totalprice") > o.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey")
)
query("subq_scalar_empty", "select r_name, (select n_name from nation where n_nationkey < 0) as x from region", "region", "nation")(
    lambda r, n: r.select("r_name", n.where(c("n_nationkey") < 0).select("n_name").scalar().alias("x"))
)
query("subq_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)", "customer", "orders")(
    lambda cu, o: cu.join(o.where(c("o_totalprice") > 200000), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")
)
query("subq_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)", "customer", "orders")(
    lambda cu, o: cu.join(o, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")
)
query("subq_exists", "select r_name from region where exists (select 1 from nation where n_nationkey > 20)", "region", "nation")(
    lambda r, n: r.where(n.where(c("n_nationkey") > 20).exists()).select("r_name")
)
query(
    "case_searched",
    "select o_orderkey, case when o_totalprice < 50000 then 'low' when o_totalprice < 150000 then 'mid' else 'high' end as band from orders",
    "orders",
)(lambda o: o.select("o_orderkey", F.when(c("o_totalprice") < 50000, "low").when(c("o_totalprice") < 150000, "mid").otherwise("high").alias("band")))
query(
    "case_simple",
    "select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'returned' when 'A' then 'accepted' end as what from lineitem",
    "lineitem",
)(
    lambda li: li.select(
        "l_orderkey", "l_linenumber",
        scalar.simple_case(c("l_returnflag"), [(F.lit("R"), F.lit("returned")), (F.lit("A"), F.lit("accepted"))]).alias("what"),
    )
)


# functions
query(
    "fn_string",
    "select p_partkey, upper(p_name) as u, lower(p_brand) as l, cast(length(p_name) as bigint) as n, p_brand || '-' || p_type as j, substring(p_name, -3, 2) as s, left(p_name, 2) as z from part",
    "part",
)(
    lambda p: p.select(
        "p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), scalar.length(c("p_name")).alias("n"),
        F.concat("p_brand", F.lit("-"), "p_type").alias("j"), scalar.substr(c("p_name"), -3, 2).alias("s"), scalar.substr(c("p_name"), 0, 3).alias("z"),
    )
)
query("fn_numeric", "select c_custkey, abs(c_acctbal) as a, round(c_acctbal) as r from customer", "customer")(
    lambda cu: cu.select("c_custkey", F.abs("c_acctbal").alias("a"), scalar.round_half_away(c("c_acctbal")).alias("r"))
)
query("fn_coalesce", "select d.doc_id, coalesce(l.quality, -1) as q from documents d left join labels l on d.doc_id = l.doc_id", "documents", "labels")(
    lambda d, lb: d.select("doc_id").join(lb, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("q"))
)
query(
    "cast_suite",
    "select o_orderkey, cast(trunc(o_totalprice) as bigint) as i, cast(o_orderkey as varchar) as s, cast(o_orderdate as date) as d, cast(o_orderkey as double) as f from orders",
    "orders",
)(
    lambda o: o.select(
        "o_orderkey", c("o_totalprice").cast("bigint").alias("i"), c("o_orderkey").cast("string").alias("s"),
        c("o_orderdate").cast("date").alias("d"), c("o_orderkey").cast("double").alias("f"),
    )
)

# full-text search
TOKS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '')"
PARTS = "(select p_partkey, unnest(list_distinct([substr(lower(p_name), i, 3) for i in range(1, length(p_name) - 1)])) as token from part where length(p_name) >= 3)"
query("fts_token", f"select doc_id from documents where list_contains({TOKS}, 'the')", "documents")(lambda d: d.where(text.match(c("text"), "the")).select("doc_id"))
query(
    "fts_bool",
    f"select doc_id from documents where (list_contains({TOKS}, 'the') or list_contains({TOKS}, 'der')) and list_contains({TOKS}, 'of')",
    "documents",
)(lambda d: d.where(text.match(c("text"), "(the OR der) AND of")).select("doc_id"))
query("fts_phrase", f"select doc_id from documents where contains(' ' || array_to_string({TOKS}, ' ') || ' ', ' of the ')", "documents")(
    lambda d: d.where(text.match(c("text"), '"of the"')).select("doc_id")
)
def inverted_index(d: DataFrame) -> DataFrame:
    """Documents and occurrences of each token: both counts are summed before the shuffle, which carries the vocabulary only."""
    tokens = d.select(text.simple_tokens(c("text")).alias("ts"))
    one = lambda df, tf: lambda t: F.struct(t.alias("token"), F.lit(df).alias("df"), F.lit(tf).alias("tf"))
    rows = tokens.select(F.inline(F.concat(F.transform("ts", one(0, 1)), F.transform(F.array_distinct("ts"), one(1, 0)))))
    return rows.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


query(
    "fts_inverted_index",
    f"select token, count(distinct doc_id) as df, count(*) as tf from (select doc_id, unnest({TOKS}) as token from documents) group by token",
    "documents",
)(inverted_index)
query("trigram_df", f"select token, count(*) as df from {PARTS} group by token", "part")(
    lambda p: p.select("p_partkey", F.explode(F.array_distinct(text.trigrams(c("p_name")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
)
#: Indexes that this session has written, by input; they go with the session.
_INDEXES: dict[tuple[str, str], str] = {}


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms looked up in a full-text index, which is written once and then read by token."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _INDEXES:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        text.write_postings(table(spark, sf_dir, "documents"), "doc_id", "text", path)
        _INDEXES[at] = path
    return text.resolve(spark.read.parquet(_INDEXES[at]), text.parse_query("the of"), "doc_id")


QUERIES["fts_indexed"] = indexed
ORACLES["fts_indexed"] = f"select doc_id from documents where list_contains({TOKS}, 'the') and list_contains({TOKS}, 'of')"
query("like_trigram", "select p_partkey, p_name from part where p_name like '%widg%'", "part")(
    lambda p: text.like_by_trigrams(p.select("p_partkey", "p_name"), "p_partkey", "p_name", "%widg%")
)


def _by_dash(words):
    return F.filter(F.split(F.lower(words), "[^a-z0-9]+"), lambda t: t != "")


text.register_tokenizer("alnum", _by_dash, lambda s: [w for w in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in s.lower()).split() if w])
query(
    "fts_custom_tokenizer",
    "select event_id from events where list_contains(string_split_regex(lower(props), '[^a-z0-9]+'), 'k')",
    "events",
)(lambda e: e.where(text.match(c("props"), "k", "alnum")).select("event_id"))
