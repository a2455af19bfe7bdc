"""In-process client: databases by name, statements, prepared statements and transactions."""

from __future__ import annotations

import datetime
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.database import Database, Table, Transaction, phys
from tessera.functions import text as fts
from tessera.sql.binder import SPARK, Binder, Scope, Source, has_aggregate, kind_of, tick
from tessera.sql.errors import ConstraintError, SqlError
from tessera.sql.lexer import _SPEC
from tessera.sql.parser import Node, parse

#: Above this share of a table's rows a token is too common for its postings to help.
COMMON_SHARE = 0.3
#: Up to this share of a table's entries, by the statistics, an index of values is looked up.
INDEX_SHARE = 0.2
cached_parse = functools.lru_cache(1024)(parse)


@dataclass
class Result:
    """What a statement gave: rows (lazy) for queries, a count for changes, a message for definitions."""

    df: DataFrame | None = None
    count: int | None = None
    message: str = ""
    #: The same query with integer sums as doubles, for sums that pass 64 bits.
    promoted: Callable[[], DataFrame] | None = None

    def rows(self) -> list[Row]:
        if self.df is None:
            return []
        try:
            return self.df.collect()
        except Exception as e:
            return self.wider(e).collect()

    def __iter__(self) -> Iterator[Row]:
        """Rows one by one, a partition at a time on the driver."""
        taken = 0
        try:
            for row in self.df.toLocalIterator() if self.df is not None else ():
                yield row
                taken += 1
        except Exception as e:
            if taken:
                raise
            yield from self.wider(e).toLocalIterator()

    def wider(self, error: Exception) -> DataFrame:
        """The frame with integer sums as doubles, if the error is a number beyond 64 bits and the query sums integers."""
        condition = getattr(error, "getCondition", lambda: "")() or str(error)
        if self.promoted is None or "ARITHMETIC_OVERFLOW" not in condition:
            raise error
        return self.promoted()


class Query:
    """A statement's text with its parameters, bound one by one: Query("… @id …").bind("id", 7)."""

    def __init__(self, sql: str, params: dict | None = None):
        self.sql, self.params = sql, dict(params or {})

    def bind(self, name: str, value) -> Query:
        return Query(self.sql, self.params | {name: value})

    def interpolate(self) -> str:
        """The text with literals in place of parameters, for logs; statements themselves bind typed values."""
        binder, out, at = Binder(lambda n: None, self.params), [], 0
        for m in _SPEC.finditer(self.sql):
            if m.lastgroup == "param" and m[0] != "?":
                out += [self.sql[at : m.start()], binder.x_param(Node("param", {"name": m[0][1:]}), Scope(), False)[0]]
                at = m.end()
        return "".join([*out, self.sql[at:]])


class Session:
    """Statements against one database, or (without one) against registered frames only."""

    def __init__(self, spark: SparkSession, db: Database | None = None, strict: bool = False):
        self.spark, self.db, self.strict = spark, db, strict
        # the dialect has a TIME type, which Spark keeps behind a setting
        spark.conf.set("spark.sql.timeType.enabled", "true")
        self.frames: dict[str, DataFrame] = {}
        self.made: list[str] = []
        #: how the statement at hand reads its tables, for EXPLAIN
        self.access: list[str] = []

    def view(self, df: DataFrame) -> str:
        """A view for the statement at hand; plans hold what it names, so it goes when the statement is planned."""
        name = f"t_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self.made.append(name)
        return name

    def register(self, name: str, df: DataFrame) -> None:
        """Make a frame readable under a name."""
        self.frames[name] = df

    # entry points
    def execute(self, sql: str | Query, params: dict | None = None, tx: Transaction | None = None) -> Result:
        if isinstance(sql, Query):
            sql, params = sql.sql, sql.params | (params or {})
        return self.run(cached_parse(sql), params or {}, tx)

    def sql(self, sql: str, params: dict | None = None) -> DataFrame:
        return self.execute(sql, params).df

    def prepare(self, sql: str) -> Callable[..., Result]:
        """Parsed once; each call binds, and so sees the catalog as it is then."""
        tree = cached_parse(sql)
        return lambda params=None, tx=None: self.run(tree, params or {}, tx)

    def run(self, s: Node, params: dict, tx: Transaction | None) -> Result:
        try:
            return self.run_one(s, params, tx)
        finally:
            self.drop_views()

    def drop_views(self) -> None:
        while self.made:
            self.spark.catalog.dropTempView(self.made.pop())

    def planned(self, q: Node, params: dict, tx: Transaction | None) -> DataFrame:
        try:
            return self.spark.sql(self.bind(q, params, tx, promote=True)[0])
        finally:
            self.drop_views()

    def run_one(self, s: Node, params: dict, tx: Transaction | None) -> Result:
        if s.kind in ("select", "explain"):
            text, _, sums = self.bind(s.query, params, tx)
            if s.kind == "select":
                return Result(self.spark.sql(text), promoted=(lambda: self.planned(s.query, params, tx)) if sums else None)
            rest = [f"SeqScan {name}" for name in sorted(self.scanned) if not any(a.split()[:2] in (["IndexScan", name], ["FullTextScan", name]) for a in self.access)]
            lines = ["== Access ==", *self.access, *rest, "== Logical ==", *outline(s.query)]
            # Spark gives its own four plans by the statement of the same name
            plan = self.spark.sql(f"EXPLAIN EXTENDED {text}").first()[0]
            return Result(self.spark.createDataFrame([("\n".join([*lines, plan]),)], "`Query Plan` string"))
        if self.db is None:
            raise SqlError("This session has no database")
        if s.kind in ("insert", "update", "delete"):
            own = tx or self.db.begin()
            try:
                count = getattr(self, s.kind)(s, params, own)
                if tx is None:
                    own.commit()
            except BaseException:
                if tx is None:
                    own.rollback()
                raise
            return Result(count=count, message=f"{count} rows")
        if tx is not None:
            raise SqlError("A transaction takes no definitions")
        return getattr(self, s.kind)(s)

    # reading
    def views(self, tx: Transaction | None):
        seen: dict[str, tuple[str, dict[str, str]]] = {}

        def view(name: str) -> tuple[str, dict[str, str]]:
            if name not in seen:
                state = (tx.state() if tx is not None else self.db.state()) if self.db is not None else {"tables": {}}
                if name in state["tables"]:
                    own = tx or self.db.begin()
                    df, types = own.frame(name), Table(state["tables"][name]).types()
                elif name in self.frames:
                    df = self.frames[name]
                    types = {c: kind_of(t) for c, t in df.dtypes}
                else:
                    raise SqlError(f"There is no table {name}")
                seen[name] = (tick(self.view(df)), types)
            return seen[name]

        return view

    def binder(self, params: dict, tx: Transaction | None) -> Binder:
        def tokenizer_of(table: str, column: str) -> str | None:
            t = self.base_table(table, tx)
            if t is not None:
                for index in t["indexes"].values():
                    if index["fulltext"] and index["columns"] == [t.column(column)["id"]]:
                        return index["tokenizer"]
            return None

        out = Binder(self.views(tx), params, tokenizer_of, self.strict)
        out.narrow = lambda source, where: self.narrow(source, where, out, tx)

        def statistics(table: str) -> tuple[int, str | None] | None:
            t = self.base_table(table, tx)
            return (t["statistics"]["rows"], t.key[0]["name"] if len(t.key) == 1 else None) if t is not None and t["statistics"] else None

        out.statistics, out.note = statistics, self.access.append
        return out

    def base_table(self, name: str, tx: Transaction | None) -> Table | None:
        state = (tx.state() if tx is not None else self.db.state()) if self.db is not None else {"tables": {}}
        return Table(state["tables"][name]) if name in state["tables"] else None

    def bind(self, q: Node, params: dict, tx: Transaction | None, promote: bool = False):
        """(Spark SQL text, columns with types, whether it has an integer SUM)."""
        self.access = []
        binder = self.binder(params, tx)
        binder.promote = promote
        out = binder.query(q)
        self.scanned = binder.used
        if tx is not None:
            simple = q.body.kind == "core" and q.body.source is not None and q.body.source.kind == "table"
            for name in binder.used:
                if self.db is not None and name in tx.state()["tables"]:
                    key = tx.table(name).key[0]["name"]
                    tx.note_read(name, *(bounds(q.body.where, key, params) if simple and len(binder.used) == 1 else (None, None)))
        return *out, binder.sums

    def narrow(self, source: Source, where: Node, binder: Binder, tx: Transaction | None) -> tuple[str | None, str | None]:
        """What an index gives for the source of a statement: a condition on the key, or a view of fewer files.

        Full-text postings serve MATCH, and LIKE with a trigram index; an index of values serves comparisons, BETWEEN and IN of
        its first column with constants. Both need statistics that promise few rows, and a table without pending changes.
        """
        t = self.base_table(source.table, tx) if source.table and (tx is None or source.table not in tx.pending) else None
        if t is None or t["statistics"] is None:
            return None, None
        for e in conjuncts(where):
            if hits := self.by_postings(e, t, source, binder):
                return hits, None
        best = None
        for label, index in t["indexes"].items():
            if not index["fulltext"] and label in t["statistics"]["indexes"]:
                first = next(c for c in t.columns if c["id"] == index["columns"][0])
                found = [f for e in conjuncts(where) if (f := self.on_values(e, first, t["statistics"]["indexes"][label], binder))]
                if found:
                    share = min(x for _, x, _ in found)
                    if share <= INDEX_SHARE and (best is None or share < best[0]):
                        best = share, label, index, found
        if best is None:
            return None, None
        _, label, index, found = best
        chosen = self.db.lookup(t, index, " AND ".join(f"({text})" for text, _, _ in found))
        self.access.append(f"IndexScan {source.table} using {label} ({' and '.join(shown for _, _, shown in found)}): {sum(map(len, (f['files'] for f in chosen)))} files")
        return None, tick(self.view((tx or self.db.begin()).frame(source.table, chosen)))

    def by_postings(self, e: Node, t: Table, source: Source, binder: Binder) -> str | None:
        if e.kind not in ("match", "like") or (e.kind == "like" and e.negated):
            return None
        column = e.column if e.kind == "match" else e.arg
        given = e.query if e.kind == "match" else e.pattern
        if column.kind != "column" or column.name not in source.columns or given.kind not in ("literal", "param"):
            return None
        value = given.value if given.kind == "literal" else binder.value(given.name)
        for label, index in t["indexes"].items():
            if not index["fulltext"] or index["columns"] != [t.column(column.name)["id"]] or not isinstance(value, str):
                continue
            plan = fts.tokenizer(index["tokenizer"])[1]
            if e.kind == "match":
                tree = fts.parse_query(value, plan)
            elif index["tokenizer"] == "trigram":
                grams = sorted({g for run in value.replace("_", "%").split("%") for g in plan(run)})
                if not grams:
                    continue
                tree = functools.reduce(lambda a, b: ("and", a, b), [("token", g) for g in grams])
            else:
                continue
            stats = t["statistics"]["indexes"].get(label)
            posts = self.db.postings(t, index)
            if stats is None or posts is None or not selective(tree, stats["common"], t["statistics"]["rows"]):
                continue
            if len(t.key) > 1:
                posts = posts.withColumn("__key", F.struct(*[phys(c) for c in t.key]))
                hits = fts.resolve(posts, tree, "__key").select("__key.*")
            else:
                hits = fts.resolve(posts, tree, phys(t.key[0]))
            self.access.append(f"FullTextScan {source.table} using {label} ({value})")
            keys = ", ".join(f"{tick(source.alias)}.{tick(c['name'])}" for c in t.key)
            return f"({keys}) IN (SELECT {', '.join(phys(c) for c in t.key)} FROM {self.view(hits)})"
        return None

    def on_values(self, e: Node, column: dict, stats: dict, binder: Binder) -> tuple[str, float, str] | None:
        """(condition on an index's rows, share of the table's entries that it leaves by the statistics, short text)."""
        at = f"c{column['id']}"

        def own(node: Node):
            """Spark text and Python value of a constant that compares with the column."""
            if constant(node, binder.params) is None:
                return None
            text, kind = binder.expr(node, Scope())
            return (text, constant(node, binder.params)) if kind == column["type"] or {kind, column["type"]} <= {"int", "float"} else None

        def between(low, high) -> float:
            a, b = stats["low"], stats["high"]
            if a is None or isinstance(low, str) or isinstance(high, str):
                return 1 / 3
            a, b = float(a), float(b)
            low, high = max(a, a if low is None else float(low)), min(b, b if high is None else float(high))
            return max(0.0, high - low) / (b - a) if b > a else float(low <= high)

        def equal(value) -> float:
            entries, common = max(stats["entries"], 1), stats["common"]
            if str(value) in common:
                return common[str(value)] / entries
            rest = stats["distinct"] - len(common)
            return max(entries - sum(common.values()), 0) / rest / entries if rest > 0 else 0.0

        mine = lambda n: n.kind == "column" and n.name == column["name"]
        if e.kind == "compare" and e.op in ("=", "<", "<=", ">", ">="):
            a, b, op = e.left, e.right, e.op
            if mine(b):
                a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            if not mine(a) or (c := own(b)) is None:
                return None
            share = equal(c[1]) if op == "=" else between(c[1], None) if op[0] == ">" else between(None, c[1])
            return f"{at} {op} {c[0]}", share, f"{column['name']} {op} {c[1]}"
        if e.kind == "between" and not e.negated and mine(e.arg):
            low, high = own(e.low), own(e.high)
            if low and high:
                return f"{at} BETWEEN {low[0]} AND {high[0]}", between(low[1], high[1]), f"{column['name']} between {low[1]} and {high[1]}"
        if e.kind == "in_list" and not e.negated and mine(e.arg):
            items = [own(x) for x in e.items]
            if items and all(items):
                return f"{at} IN ({', '.join(x[0] for x in items)})", sum(equal(x[1]) for x in items), f"{column['name']} in ({', '.join(str(x[1]) for x in items)})"
        return None

    # changing
    def insert(self, s: Node, params: dict, tx: Transaction) -> int:
        t = tx.table(s.table)
        names = s.columns or [c["name"] for c in t.columns]
        targets = [t.column(n) for n in names]
        if len(set(names)) < len(names):
            raise SqlError("A column is named twice")
        if s.rows is not None:
            rows, binder = [], self.binder(params, tx)
            for values in s.rows:
                if len(values) != len(names):
                    raise SqlError(f"{len(names)} columns, {len(values)} values")
                rows.append([self.fits(*binder.expr(v, Scope()), c) for v, c in zip(values, targets)])
            cols = ", ".join(tick(n) for n in names)
            numbered = ", ".join(f"({i}, {', '.join(r)})" for i, r in enumerate(rows))
            # in the order of the text, which gives sequences their numbers
            text = f"SELECT {cols} FROM VALUES {numbered} AS v(`__at`, {cols}) ORDER BY `__at`"
        else:
            text, cols, _ = self.bind(s.query, params, tx)
            if len(cols) != len(names):
                raise SqlError(f"{len(names)} columns, {len(cols)} values")
            for (_, kind), c in zip(cols, targets):
                self.fits("", kind, c)
            text = f"SELECT * FROM ({text}) AS v({', '.join(tick(n) for n in names)})"
        df = self.spark.sql(text)
        for c in t.columns:
            if c["name"] not in names:
                df = df.withColumn(c["name"], F.lit(c["default"]).cast(SPARK[c["type"]]))
        df = df.select(*[F.col(tick(c["name"])).cast(SPARK[c["type"]]).alias(c["name"]) for c in t.columns])
        for c in t.columns:
            if c["auto"]:
                df = self.number(df, c, s.table, tx, s.rows is not None)
        return tx.insert(s.table, df)

    @staticmethod
    def fits(text: str, kind: str, column: dict) -> str:
        """Types must agree exactly; NULL fits where the column allows it."""
        if kind not in (column["type"], "null"):
            raise ConstraintError(f"{column['name']} takes {column['type']}, not {kind}")
        return text

    def number(self, df: DataFrame, column: dict, table: str, tx: Transaction, ordered: bool) -> DataFrame:
        """Consecutive numbers for nulls, without a global sort: counts by partition, then offsets."""
        name = column["name"]
        path = tx.db.write(df.coalesce(1) if ordered else df, table)
        df = tx.folder(path).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
        highest = df.agg(F.max(name)).first()[0]
        start = tx.next_numbers(table, column, highest)
        empty = df.where(F.col(name).isNull()).groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first")).orderBy("__part").collect()
        if empty:
            from pyspark.sql import Window as W

            at, offsets = start, []
            for r in empty:
                offsets.append((r["__part"], at))
                at += r["n"]
            tx.next_numbers(table, column, at - 1)
            rank = F.row_number().over(W.partitionBy("__part", F.col(name).isNull()).orderBy("__row"))
            df = df.withColumn("__rank", rank).join(F.broadcast(self.spark.createDataFrame(offsets, "__part int, __at bigint")), "__part", "left")
            df = df.withColumn(name, F.when(F.col(name).isNull(), F.col("__at") + F.col("__rank") - 1).otherwise(F.col(name)))
        return df.drop("__part", "__row", "__rank", "__at")

    def matching(self, s: Node, params: dict, tx: Transaction) -> tuple[Binder, Scope]:
        t = tx.table(s.table)
        tx.note_read(s.table, *bounds(s.where, t.key[0]["name"], params))
        return self.binder(params, tx), Scope([Source(s.table, t.types(), s.table)])

    def update(self, s: Node, params: dict, tx: Transaction) -> int:
        binder, scope = self.matching(s, params, tx)
        t = tx.table(s.table)
        sets = {}
        for name, e in s.sets:
            if name in sets:
                raise SqlError(f"SET names {name} twice")
            sets[name] = self.fits(*binder.expr(e, scope), t.column(name))
        where = binder.condition(s.where, scope) if s.where is not None else None
        return tx.update(s.table, sets, where)

    def delete(self, s: Node, params: dict, tx: Transaction) -> int:
        binder, scope = self.matching(s, params, tx)
        return tx.delete(s.table, binder.condition(s.where, scope) if s.where is not None else None)

    # definitions
    def column_of(self, c: Node) -> dict:
        default = None
        if c.default is not None:
            text, kind = Binder(lambda n: None).expr(c.default, Scope())
            if kind not in (c.type, "null"):
                raise SqlError(f"DEFAULT of {c.name} is {kind}, the column {c.type}")
            default = self.spark.sql(f"SELECT CAST({text} AS {'STRING' if c.type not in ('int', 'float', 'bool') else SPARK[c.type]})").first()[0]
        return {"name": c.name, "type": c.type, "null": c.null and not c.auto, "default": default, "auto": c.auto}

    def create_table(self, s: Node) -> Result:
        self.db.create_table(s.table, [self.column_of(c) for c in s.columns], s.key, s.options, s.quiet)
        return Result(message=f"Table {s.table} created")

    def drop_table(self, s: Node) -> Result:
        self.db.drop_table(s.table, s.quiet)
        return Result(message=f"Table {s.table} dropped")

    def create_index(self, s: Node) -> Result:
        self.db.create_index(s.name, s.table, s.columns, s.fulltext, s.tokenizer)
        return Result(message=f"Index {s.name} created")

    def drop_index(self, s: Node) -> Result:
        self.db.drop_index(s.name)
        return Result(message=f"Index {s.name} dropped")

    def alter_add(self, s: Node) -> Result:
        if s.column.key:
            raise SqlError("A column cannot be added to the primary key")
        self.db.add_column(s.table, self.column_of(s.column))
        return Result(message="Column added")

    def alter_rename(self, s: Node) -> Result:
        self.db.rename_column(s.table, s.old, s.new)
        return Result(message="Column renamed")

    def alter_drop(self, s: Node) -> Result:
        self.db.drop_column(s.table, s.name)
        return Result(message="Column dropped")

    def analyze(self, s: Node) -> Result:
        self.db.analyze(s.table)
        return Result(message=f"Table {s.table} analyzed")


def outline(q: Node, depth: int = 0) -> list[str]:
    """The operators of a query as the text has them, the last one first, inputs indented below."""
    pad = "  " * depth
    out = [f"{pad}Limit"] if q.limit is not None or q.offset is not None else []
    out += [f"{pad}Sort {len(q.order)}"] if q.order else []

    def body(b: Node, depth: int) -> list[str]:
        pad = "  " * depth
        if b.kind == "nested":
            return outline(b.query, depth)
        if b.kind != "core":
            return [f"{pad}{b.op.capitalize()}{' all' * b.all}", *body(b.left, depth + 1), *body(b.right, depth + 1)]
        lines = [f"{pad}Distinct"] if b.distinct else []
        lines += [f"{pad}Having"] if b.having is not None else []
        grouped = b.group or b.having is not None or any(has_aggregate(e) for e, _ in b.items)
        lines.append(f"{pad}Aggregate {len(b.group)}" if grouped else f"{pad}Project {len(b.items)}")
        lines += [f"{pad}Filter {len(conjuncts(b.where))}"] if b.where is not None else []
        return lines + (source(b.source, depth + 1) if b.source is not None else [])

    def source(f: Node, depth: int) -> list[str]:
        pad = "  " * depth
        if f.kind == "join":
            return [f"{pad}Join {f.type.lower()}", *source(f.left, depth + 1), *source(f.right, depth + 1)]
        if f.kind == "derived":
            return [f"{pad}Derived {f.alias}", *outline(f.query, depth + 1)]
        return [f"{pad}Table {f.name}"]

    return [*(line for name, _, c in q.ctes for line in [f"{pad}With {name}", *outline(c, depth + 1)]), *out, *body(q.body, depth)]


def conjuncts(e: Node | None) -> list[Node]:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if e.kind == "logic" and e.op == "AND" else [e]


def bounds(where: Node | None, key: str, params: dict) -> tuple:
    """Bounds of the first key column that a conjunction implies."""
    low = high = None
    for e in conjuncts(where):
        parts = [("=", e.left, e.right)] if e.kind == "compare" and e.op == "=" else [(e.op, e.left, e.right)] if e.kind == "compare" else []
        if e.kind == "between" and not e.negated:
            parts = [(">=", e.arg, e.low), ("<=", e.arg, e.high)]
        for op, a, b in parts:
            if b.kind == "column" and a.kind != "column":
                a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            if a.kind != "column" or a.name != key:
                continue
            v = constant(b, params)
            if v is None:
                continue
            if op in ("=", ">", ">="):
                low = v if low is None else max(low, v)
            if op in ("=", "<", "<="):
                high = v if high is None else min(high, v)
    return low, high


def constant(e: Node, params: dict):
    """The value of a literal, a parameter or a typed date or timestamp literal; None if it is something else."""
    if e.kind == "literal":
        return e.value
    if e.kind == "param":
        return params.get(e.name)
    if e.kind == "cast" and e.arg.kind == "literal" and e.arg.type == "string" and e.type in ("date", "timestamp"):
        try:
            return (datetime.date if e.type == "date" else datetime.datetime).fromisoformat(e.arg.value)
        except ValueError:
            return None
    return None


def selective(tree, common: dict[str, int], rows: int) -> bool:
    """Whether postings can be expected to leave few rows: some token of every conjunction is rare."""
    if tree[0] == "token":
        return common.get(tree[1], 0) <= COMMON_SHARE * max(rows, 1)
    if tree[0] == "phrase":
        return any(selective(("token", t), common, rows) for t in tree[1])
    left, right = selective(tree[1], common, rows), selective(tree[2], common, rows)
    return (left or right) if tree[0] == "and" else (left and right)


class Client:
    """Databases below one root."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = False):
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict
        self.dbs: dict[str, Session] = {}

    def create_db(self, name: str) -> None:
        db = Database(self.spark, f"{self.root}/{name}")
        if db.version():
            raise SqlError(f"There is a database {name} already")
        db.create()

    def drop_db(self, name: str) -> None:
        self.session(name)
        Database(self.spark, f"{self.root}/{name}").store.delete("")
        self.dbs.pop(name)

    def flush_db(self, name: str) -> None:
        """Every commit is durable when it returns; nothing to do."""
        self.session(name)

    def session(self, name: str) -> Session:
        if name not in self.dbs:
            db = Database(self.spark, f"{self.root}/{name}")
            if not db.version():
                raise SqlError(f"There is no database {name}")
            self.dbs[name] = Session(self.spark, db, self.strict)
        return self.dbs[name]

    def execute_query(self, db: str, sql: str, params: dict | None = None) -> Result:
        return self.session(db).execute(sql, params)

    @contextmanager
    def transaction(self, db: str, level: str = "snapshot"):
        """A callable that runs statements; commits at the end of the block, rolls back on an exception."""
        session = self.session(db)
        tx = session.db.begin(level)
        try:
            yield lambda sql, params=None: session.execute(sql, params, tx)
            tx.commit()
        finally:
            if tx.open:
                tx.rollback()

    def run_in_transaction(self, db: str, work: Callable, level: str = "snapshot"):
        with self.transaction(db, level) as run:
            return work(run)
