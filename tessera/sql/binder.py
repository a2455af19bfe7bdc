"""Typed rewriting of a parsed query to Spark SQL text.

Names are resolved and types inferred here, so that the dialect's own rules can be spelled out in plain Spark SQL; the
whole query, subqueries included, is then planned by Catalyst. Rules: two integers divide to an integer; literals are
64-bit or double; booleans compare with integers; incomparable IN items and CASE branches never match; simple CASE matches
NULL with NULL; integers are truthy in conditions; LIKE has no escape character; SUBSTR counts from a virtual place
before the first character; CONCAT and text casts show doubles without a trailing .0; set operations need equal types.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from dataclasses import dataclass, field

from tessera.functions import text as fts
from tessera.sql import joins
from tessera.sql.errors import SqlError
from tessera.sql.parser import Node

SPARK = {"int": "BIGINT", "float": "DOUBLE", "string": "STRING", "bytes": "BINARY", "bool": "BOOLEAN", "date": "DATE", "time": "TIME(6)", "timestamp": "TIMESTAMP_NTZ", "decimal": "DECIMAL(38,10)"}
NUMERIC = ("int", "float", "decimal")


def kind_of(spark_type: str) -> str:
    """The dialect's type of a Spark type, by its simple string."""
    t = spark_type.lower()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if t in ("float", "double"):
        return "float"
    for name in ("decimal", "string", "varchar", "char", "time(", "timestamp", "date", "binary", "boolean", "void"):
        if t.startswith(name):
            return {"varchar": "string", "char": "string", "time(": "time", "binary": "bytes", "boolean": "bool", "void": "null"}.get(name, name)
    return "other"


def kind_of_value(v) -> str:
    for types, kind in ((type(None), "null"), (bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (bytes, "bytes"), (decimal.Decimal, "decimal"), (datetime.datetime, "timestamp"), (datetime.date, "date"), (datetime.time, "time")):
        if isinstance(v, types):
            return kind
    raise SqlError(f"A parameter cannot be a {type(v).__name__}")


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Source:
    """One FROM item: alias, and its columns with types."""

    alias: str
    columns: dict[str, str]
    table: str | None = None


@dataclass
class Scope:
    sources: list[Source] = field(default_factory=list)
    outer: Scope | None = None

    def find(self, table: str | None, name: str) -> tuple[Source, str]:
        hits = [s for s in self.sources if (table is None or s.alias == table) and name in s.columns]
        if len(hits) > 1:
            raise SqlError(f"{name} may be the column of any of {', '.join(s.alias for s in hits)}")
        if hits:
            return hits[0], hits[0].columns[name]
        if self.outer is not None:
            return self.outer.find(table, name)
        raise SqlError(f"There is no column {f'{table}.' if table else ''}{name}")


class Binder:
    """tables: name -> (view, columns with types). tokenizer_of: (table, column) -> tokenizer name of a full-text index."""

    def __init__(self, tables: Callable[[str], tuple[str, dict[str, str]]], params: dict | None = None, tokenizer_of=None, strict: bool = False, narrow=None, promote: bool = False):
        self.tables, self.params, self.strict = tables, params or {}, strict
        self.tokenizer_of = tokenizer_of or (lambda table, column: None)
        self.narrow = narrow or (lambda source, where: (None, None))
        # integer sums as doubles where they pass 64 bits; `sums` tells whether there is one
        self.promote, self.sums = promote, False
        self.used: set[str] = set()
        #: table -> (rows, key column) by statistics, or None; and where notes about the plan go
        self.statistics = lambda table: None
        self.note = lambda line: None
        self.links: dict[int, joins.Link | None] = {}
        self.leaves: dict[str, str] = {}
        self.ctes: list[dict[str, tuple[str, dict[str, str]]]] = []
        self.n = 0

    # queries: each returns (text, columns as (name, type) pairs)
    def query(self, q: Node, outer: Scope | None = None) -> tuple[str, list[tuple[str, str]]]:
        texts, scope = [], {}
        self.ctes.append(scope)
        try:
            for name, columns, body in q.ctes:
                text, cols = self.query(body)
                cols = self.renamed(cols, columns, name)
                self.n += 1
                unique = f"cte_{self.n}_{name}"
                texts.append(f"{tick(unique)} ({', '.join(tick(c) for c, _ in cols)}) AS ({text})")
                scope[name] = (tick(unique), dict(cols))
            core = q.body.kind == "core"
            text, cols, inner = self.core(q.body, outer) if core else (*self.set_expr(q.body, outer), None)
            if q.order:
                keys = [(self.order_key(k, cols, inner, q.body if core else None, outer), asc) for k, asc in q.order]
                text += " ORDER BY " + ", ".join(f"{k} {'ASC NULLS FIRST' if asc else 'DESC NULLS LAST'}" for k, asc in keys)
            if q.limit is not None:
                text += f" LIMIT {self.count(q.limit)}"
            if q.offset is not None:
                text += f" OFFSET {self.count(q.offset)}"
        finally:
            self.ctes.pop()
        return ("WITH " + ", ".join(texts) + " " if texts else "") + text, cols

    @staticmethod
    def renamed(cols, names, what):
        if names is None:
            return cols
        if len(names) != len(cols):
            raise SqlError(f"{what} has {len(cols)} columns, {len(names)} names were given")
        return [(n, t) for n, (_, t) in zip(names, cols)]

    def count(self, e: Node) -> str:
        if e.kind == "param":
            value = self.value(e.name)
        elif e.kind == "literal":
            value = e.value
        elif e.kind == "arith":
            left, right = int(self.count(e.left)), int(self.count(e.right))
            value = {"+": left + right, "-": left - right, "*": left * right}.get(e.op, left // max(right, 1))
        else:
            raise SqlError("LIMIT and OFFSET must be constant")
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise SqlError("LIMIT and OFFSET must be non-negative integers")
        return str(value)

    def order_key(self, k: Node, cols, inner, core, outer) -> str:
        if k.kind == "column" and k.table is None and k.name in [c for c, _ in cols]:
            return tick(k.name)
        if k.kind == "literal" and k.type == "int":
            if not 1 <= k.value <= len(cols):
                raise SqlError(f"ORDER BY position {k.value} is not in the select list")
            return str(k.value)
        if inner is None:
            raise SqlError("ORDER BY of a set operation takes output columns")
        return self.expr(k, inner, aggregates=True)[0]

    def set_expr(self, s: Node, outer=None) -> tuple[str, list[tuple[str, str]]]:
        if s.kind == "core":
            return self.core(s, outer)[:2]
        if s.kind == "nested":
            text, cols = self.query(s.query, outer)
            return f"(SELECT * FROM ({text}))", cols
        (a, left), (b, right) = self.set_expr(s.left, outer), self.set_expr(s.right, outer)
        if len(left) != len(right):
            raise SqlError(f"{s.op}: inputs have {len(left)} and {len(right)} columns")
        for (n, t), (_, u) in zip(left, right):
            if t != u and "null" not in (t, u):
                raise SqlError(f"{s.op}: types of column {n} differ: {t} and {u}")
        cols = [(n, u if t == "null" else t) for (n, t), (_, u) in zip(left, right)]
        return f"(SELECT * FROM ({a})) {s.op}{' ALL' * s.all} (SELECT * FROM ({b}))", cols

    def core(self, c: Node, outer=None) -> tuple[str, list[tuple[str, str]], Scope]:
        scope = Scope([], outer)
        source = self.ordered(c.source, self.source(c.source, scope), scope) if c.source is not None else None
        where = self.condition(c.where, scope) if c.where is not None else None
        items, cols = [], []
        grouped = bool(c.group) or c.having is not None or any(has_aggregate(e) for e, _ in c.items)
        for e, alias in c.items:
            if e.kind == "star":
                some = [s for s in scope.sources if e.table in (None, s.alias)]
                if not some:
                    raise SqlError(f"Unknown table in {e.table or ''}.*")
                for s in some:
                    for name, kind in s.columns.items():
                        items.append(f"{tick(s.alias)}.{tick(name)}")
                        cols.append((name, kind))
                continue
            text, kind = self.expr(e, scope, aggregates=grouped)
            name = alias or (e.name if e.kind == "column" else label(e))
            items.append(f"{text} AS {tick(name)}")
            cols.append((name, kind))
        text = f"SELECT {'DISTINCT ' * c.distinct}{', '.join(items)}"
        if source:
            text += f" FROM {source}"
        more = [where] if where else []
        if where and len(scope.sources) == 1 and c.source.kind == "table":
            # an index may give a further condition, or a view of fewer files
            extra, view = self.narrow(scope.sources[0], c.where)
            more += [extra] if extra else []
            if view:
                text = text.replace(f" FROM {source}", f" FROM {view} AS {tick(scope.sources[0].alias)}")
        if more:
            text += " WHERE " + " AND ".join(f"({x})" for x in more)
        if c.group:
            if any(has_aggregate(g) for g in c.group):
                raise SqlError("GROUP BY must not hold aggregates")
            text += " GROUP BY " + ", ".join(self.group_key(g, c.items, scope) for g in c.group)
        if c.having is not None:
            text += f" HAVING {self.condition(c.having, scope, aggregates=True)}"
        return text, cols, scope

    def group_key(self, g: Node, items, scope: Scope) -> str:
        if g.kind == "literal" and g.type == "int":
            if not 1 <= g.value <= len(items):
                raise SqlError(f"GROUP BY position {g.value} is not in the select list")
            return str(g.value)
        return self.expr(g, scope)[0]

    def ordered(self, f: Node, text: str, scope: Scope) -> str:
        """The FROM text with inner joins in the order that the statistics ask for; columns stay in the order of the text."""
        chain = joins.inner_chain(f)
        tables = {s.alias: s.table for s in scope.sources}
        if not chain or len(chain[0]) < 3 or any(tables.get(t.alias) is None for t in chain[0]):
            return text
        known, links = [self.statistics(tables[t.alias]) for t in chain[0]], [self.links[id(j)] for j in chain[1]]
        if None in known or None in links:
            return text
        leaves = [joins.Leaf(t.alias, self.leaves[t.alias], *k) for t, k in zip(chain[0], known)]
        order = joins.best_order(leaves, links)
        if order is None:
            return text
        self.note(f"JoinOrder {', '.join(x.alias for x in order)}")
        return joins.from_text(order, links)

    @staticmethod
    def link(e: Node, text: str, scope: Scope) -> joins.Link | None:
        if joins.has_query(e):
            return None
        found = [(scope.find(c.table, c.name)[0].alias, c.name) for c in joins.columns(e)]
        pair = e.kind == "compare" and e.op == "=" and e.left.kind == e.right.kind == "column"
        return joins.Link(text, frozenset(a for a, _ in found), tuple(found) if pair else None)

    def source(self, f: Node, scope: Scope) -> str:
        if f.kind == "join":
            left, right = self.source(f.left, scope), self.source(f.right, scope)
            if f.type == "CROSS":
                return f"{left} CROSS JOIN {right}"
            if self.strict and (f.on.kind != "compare" or f.on.op != "=" or f.type in ("RIGHT", "FULL")):
                raise SqlError("Strict sessions join on one equality" if f.type in ("INNER", "LEFT") else f"Strict sessions know no {f.type} join")
            on = self.condition(f.on, scope)
            self.links[id(f)] = self.link(f.on, on, scope)
            return f"{left} {f.type} JOIN {right} ON {on}"
        if f.kind == "derived":
            text, cols = self.query(f.query, None if self.strict else scope.outer)
            cols = self.renamed(cols, f.columns, f.alias)
            text = f"({text}) AS {tick(f.alias)} ({', '.join(tick(c) for c, _ in cols)})"
            found = Source(f.alias, dict(cols))
        else:
            view = next((level[f.name] for level in reversed(self.ctes) if f.name in level), None)
            if view is None:
                view = self.tables(f.name)
                self.used.add(f.name)
                found = Source(f.alias, dict(view[1]), f.name)
            else:
                found = Source(f.alias, dict(view[1]))
            text = f"{view[0]} AS {tick(f.alias)}"
            self.leaves[f.alias] = text
        if any(s.alias == found.alias for s in scope.sources):
            raise SqlError(f"Two tables are called {found.alias}")
        scope.sources.append(found)
        return text

    # expressions: each returns (text, type)
    def value(self, name: str):
        if name not in self.params:
            raise SqlError(f"No value is bound to {name}")
        return self.params[name]

    def condition(self, e: Node, scope: Scope, aggregates=False) -> str:
        text, kind = self.expr(e, scope, aggregates)
        return self.truth(text, kind)

    @staticmethod
    def truth(text: str, kind: str) -> str:
        if kind == "int":
            return f"({text} <> 0)"
        if kind not in ("bool", "null"):
            raise SqlError(f"A condition must be boolean, not {kind}")
        return text

    def expr(self, e: Node, scope: Scope, aggregates=False) -> tuple[str, str]:
        method = getattr(self, "x_" + e.kind, None)
        if method is None:
            raise SqlError(f"{e.kind} cannot stand here")
        return method(e, scope, aggregates)

    def x_star(self, e, scope, agg):
        raise SqlError("* is only allowed in the select list")

    def x_column(self, e, scope, agg):
        source, kind = scope.find(e.table, e.name)
        return f"{tick(source.alias)}.{tick(e.name)}", kind

    def x_literal(self, e, scope, agg):
        v = e.value
        if e.type == "int":
            if not -(2**63) <= v < 2**63:
                raise SqlError(f"{v} does not fit 64 bits")
            return (f"{v}L" if v >= 0 else f"({v}L)" if v > -(2**63) else "(-9223372036854775807L - 1L)"), "int"
        if e.type == "float":
            return (f"{v!r}D" if v >= 0 else f"({v!r}D)"), "float"
        if e.type == "string":
            return quote(v), "string"
        return ("NULL" if v is None else str(v).upper()), e.type

    def x_param(self, e, scope, agg):
        v = self.value(e.name)
        kind = kind_of_value(v)
        if kind in ("int", "float", "string", "null", "bool") and not (kind == "float" and (v != v or v in (float("inf"), float("-inf")))):
            return self.x_literal(Node("literal", {"type": kind, "value": v}), scope, agg)
        if kind == "bytes":
            return f"X'{v.hex()}'", kind
        if kind == "decimal":
            return f"CAST('{v:f}' AS DECIMAL(38,{max(0, -v.as_tuple().exponent)}))", kind
        return f"CAST({quote(str(v))} AS {SPARK[kind]})", kind

    def x_negate(self, e, scope, agg):
        text, kind = self.expr(e.arg, scope, agg)
        if kind not in (*NUMERIC, "null"):
            raise SqlError(f"Only numbers can be negated, not {kind}")
        return f"(-{text})", kind

    def x_arith(self, e, scope, agg):
        (a, s), (b, t) = self.expr(e.left, scope, agg), self.expr(e.right, scope, agg)
        if s not in (*NUMERIC, "null") or t not in (*NUMERIC, "null"):
            raise SqlError(f"Arithmetic needs numbers, not {s} {e.op} {t}")
        if "null" in (s, t):
            return "NULL", s if t == "null" else t
        if s == t == "int" and e.op == "/":
            return f"({a} DIV {b})", "int"
        kind = "int" if s == t == "int" else "decimal" if {s, t} <= {"int", "decimal"} else "float"
        return f"({a} {e.op} {b})", kind

    def x_logic(self, e, scope, agg):
        return f"({self.condition(e.left, scope, agg)} {e.op} {self.condition(e.right, scope, agg)})", "bool"

    def x_not(self, e, scope, agg):
        return f"(NOT {self.condition(e.arg, scope, agg)})", "bool"

    @staticmethod
    def comparable(s: str, t: str) -> bool:
        return s == t or "null" in (s, t) or {s, t} <= set(NUMERIC) or {s, t} == {"bool", "int"} or {s, t} == {"date", "timestamp"}

    def pair(self, a, s, b, t):
        """Both sides, made comparable; None if they are not."""
        if not self.comparable(s, t):
            return None
        if {s, t} == {"bool", "int"}:
            a, b = (f"CAST({x} AS BIGINT)" if k == "bool" else x for x, k in ((a, s), (b, t)))
        return a, b

    def x_compare(self, e, scope, agg):
        (a, s), (b, t) = self.expr(e.left, scope, agg), self.expr(e.right, scope, agg)
        both = self.pair(a, s, b, t)
        if both is None:
            raise SqlError(f"{s} and {t} do not compare")
        return f"({both[0]} {e.op} {both[1]})", "bool"

    def x_is_null(self, e, scope, agg):
        return f"({self.expr(e.arg, scope, agg)[0]} IS {'NOT ' * e.negated}NULL)", "bool"

    def x_like(self, e, scope, agg):
        (a, s), (b, t) = self.expr(e.arg, scope, agg), self.expr(e.pattern, scope, agg)
        if s not in ("string", "null") or t not in ("string", "null"):
            raise SqlError("LIKE needs strings")
        return f"({a} {'NOT ' * e.negated}LIKE {b} ESCAPE '\\u0001')", "bool"

    def x_between(self, e, scope, agg):
        low = self.x_compare(Node("compare", {"op": ">=", "left": e.arg, "right": e.low}), scope, agg)[0]
        high = self.x_compare(Node("compare", {"op": "<=", "left": e.arg, "right": e.high}), scope, agg)[0]
        return f"({'NOT ' * e.negated}({low} AND {high}))", "bool"

    def x_in_list(self, e, scope, agg):
        a, s = self.expr(e.arg, scope, agg)
        tests = []
        for item in e.items:
            b, t = self.expr(item, scope, agg)
            both = self.pair(a, s, b, t)
            if both is not None:
                tests.append(f"({both[0]} = {both[1]})")
        text = " OR ".join(tests) or f"CASE WHEN {a} IS NOT NULL THEN FALSE END"
        return f"({'NOT ' * e.negated}({text}))", "bool"

    def x_case(self, e, scope, agg):
        parts, kinds = [], []
        subject = self.expr(e.subject, scope, agg) if e.subject is not None else None
        for cond, result in e.whens:
            if subject is None:
                test = self.condition(cond, scope, agg)
            else:
                b, t = self.expr(cond, scope, agg)
                both = self.pair(*subject, b, t)
                test = f"{both[0]} <=> {both[1]}" if both else None
            text, kind = self.expr(result, scope, agg)
            kinds.append(kind)
            if test is not None:
                parts.append((test, text, kind))
        default, kind = self.expr(e.default, scope, agg) if e.default is not None else ("NULL", "null")
        out = self.common([*kinds, kind], "CASE")
        whens = " ".join(f"WHEN {test} THEN {self.widen(text, k, out)}" for test, text, k in parts)
        default = self.widen(default, kind, out)
        return (f"(CASE {whens} ELSE {default} END)" if whens else f"({default})"), out

    @staticmethod
    def common(kinds: list[str], what: str) -> str:
        some = {k for k in kinds if k != "null"}
        if len(some) <= 1:
            return next(iter(some), "null")
        if some <= set(NUMERIC):
            return "float" if "float" in some else "decimal"
        raise SqlError(f"{what} mixes types: {', '.join(sorted(some))}")

    @staticmethod
    def widen(text: str, kind: str, to: str) -> str:
        return f"CAST({text} AS {SPARK[to]})" if kind != to and to in ("float", "decimal") else text

    @staticmethod
    def as_text(text: str, kind: str) -> str:
        if kind == "string":
            return text
        if kind == "float":
            return f"(CASE WHEN {text} = floor({text}) AND abs({text}) < 1e15D THEN CAST(CAST({text} AS BIGINT) AS STRING) ELSE CAST({text} AS STRING) END)"
        if kind == "decimal":
            return f"regexp_replace(regexp_replace(CAST({text} AS STRING), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
        return f"CAST({text} AS STRING)"

    def x_cast(self, e, scope, agg):
        text, kind = self.expr(e.arg, scope, agg)
        to = e.type
        allowed = {
            "int": ("int", "float", "decimal", "bool", "string"), "float": ("int", "float", "decimal", "bool", "string"), "decimal": ("int", "float", "decimal", "string"),
            "bytes": ("bytes", "string"), "bool": ("bool", "int"), "date": ("date", "timestamp", "string"), "time": ("time", "string"), "timestamp": ("timestamp", "date", "string"),
        }
        if kind == "null":
            return f"CAST(NULL AS {SPARK[to]})", to
        if to == "string":
            return self.as_text(text, kind), to
        if kind not in allowed[to]:
            raise SqlError(f"{kind} does not become {to}")
        if to == "int" and kind == "float":  # truncates, and saturates at the ends of 64 bits
            return f"(CASE WHEN isnan({text}) THEN 0L WHEN {text} >= 9223372036854775807D THEN 9223372036854775807L WHEN {text} <= -9223372036854775808D THEN (-9223372036854775807L - 1L) ELSE CAST({text} AS BIGINT) END)", to
        if to == "decimal" and e.arg.kind == "literal" and kind == "string":
            try:
                scale = max(0, -decimal.Decimal(e.arg.value.strip()).as_tuple().exponent)
            except decimal.InvalidOperation:
                raise SqlError(f"Not a decimal: {e.arg.value}") from None
            return f"CAST({text} AS DECIMAL(38,{scale}))", to
        return f"CAST({text} AS {SPARK[to]})", to

    def x_function(self, e, scope, agg):
        args = [self.expr(a, scope, agg) for a in e.args_]
        name, n = e.name, len(args)
        want = {"LENGTH": (1, 1), "UPPER": (1, 1), "LOWER": (1, 1), "ABS": (1, 1), "ROUND": (1, 1), "SUBSTR": (2, 3), "COALESCE": (1, 99), "CONCAT": (1, 999)}[name]
        if not want[0] <= n <= want[1]:
            raise SqlError(f"{name} does not take {n} arguments")
        if name == "LENGTH":
            return f"CAST(char_length({self.as_text(*args[0])}) AS BIGINT)", "int"
        if name in ("UPPER", "LOWER"):
            return f"{name.lower()}({self.as_text(*args[0])})", "string"
        if name == "CONCAT":
            return f"concat({', '.join(self.as_text(*a) for a in args)})", "string"
        if name == "COALESCE":
            kind = self.common([k for _, k in args], name)
            return f"coalesce({', '.join(self.widen(t, k, kind) for t, k in args)})", kind
        if name in ("ABS", "ROUND"):
            text, kind = args[0]
            if kind not in (*NUMERIC, "null"):
                raise SqlError(f"{name} needs a number, not {kind}")
            return (text if name == "ROUND" and kind == "int" else f"{name.lower()}({text})"), kind
        if any(k not in ("int", "null") for _, k in args[1:]):
            raise SqlError("SUBSTR needs integers")
        s = self.as_text(*args[0])
        clamp = lambda t: f"CAST(greatest(least({t}, 2147483647L), -2147483647L) AS INT)"
        start = args[1][0]
        first = f"if({start} = 0L, 1, {clamp(start)})"
        if n == 2:
            return f"substring({s}, {first})", "string"
        size = args[2][0]
        checked = f"if({size} < 0L, raise_error('SUBSTR length must not be negative'), {size})"
        return f"substring({s}, {first}, {clamp(f'if({start} = 0L, greatest({checked} - 1L, 0L), {checked})')})", "string"

    def x_aggregate(self, e, scope, agg):
        if not agg:
            raise SqlError(f"{e.name} is not allowed here")
        if e.arg is None:
            return "count(*)", "int"
        text, kind = self.expr(e.arg, scope)
        if e.name in ("SUM", "AVG") and kind not in (*NUMERIC, "null"):
            raise SqlError(f"{e.name} needs numbers, not {kind}")
        distinct = "DISTINCT " * (e.distinct and e.name not in ("MIN", "MAX"))
        if e.name == "SUM" and kind == "int":
            self.sums = True
            if self.promote:
                return f"coalesce(CAST(try_sum({distinct}{text}) AS DOUBLE), sum({distinct}CAST({text} AS DOUBLE)))", "float"
        out = {"COUNT": "int", "AVG": "decimal" if kind == "decimal" else "float"}.get(e.name, kind)
        return f"{e.name.lower()}({distinct}{text})", out

    def x_match(self, e, scope, agg):
        source, kind = scope.find(e.column.table, e.column.name)
        query = self.value(e.query.name) if e.query.kind == "param" else e.query.value
        if not isinstance(query, str):
            raise SqlError("AGAINST needs a string")
        if kind != "string":
            return "FALSE", "bool"
        name = (source.table and self.tokenizer_of(source.table, e.column.name)) or "simple"
        return fts.match_sql(f"{tick(source.alias)}.{tick(e.column.name)}", query, name), "bool"

    def subquery(self, q: Node, scope: Scope) -> tuple[str, list[tuple[str, str]]]:
        return self.query(q, None if self.strict else scope)

    def x_scalar(self, e, scope, agg):
        text, cols = self.subquery(e.query, scope)
        if len(cols) != 1:
            raise SqlError("A scalar subquery must have one column")
        return f"({text})", cols[0][1]

    def x_exists(self, e, scope, agg):
        return f"EXISTS ({self.subquery(e.query, scope)[0]})", "bool"

    def x_in_query(self, e, scope, agg):
        a, s = self.expr(e.arg, scope, agg)
        text, cols = self.subquery(e.query, scope)
        if len(cols) != 1:
            raise SqlError("IN needs a subquery of one column")
        if not self.comparable(s, cols[0][1]):
            return f"({'NOT ' * e.negated}(CASE WHEN {a} IS NOT NULL THEN FALSE END))", "bool"
        return f"({a} {'NOT ' * e.negated}IN ({text}))", "bool"


def has_aggregate(e) -> bool:
    if isinstance(e, Node):
        return e.kind == "aggregate" or (e.kind not in ("scalar", "exists", "query") and any(has_aggregate(v) for k, v in e.args.items() if not (e.kind == "in_query" and k == "query")))
    return isinstance(e, (list, tuple)) and any(has_aggregate(v) for v in e)


def label(e: Node) -> str:
    """Output name of an expression without an alias."""
    if e.kind == "aggregate":
        return f"{e.name}({'DISTINCT ' * e.distinct}{'*' if e.arg is None else label(e.arg)})"
    if e.kind == "function":
        return f"{e.name}({', '.join(map(label, e.args_))})"
    if e.kind == "column":
        return e.name
    if e.kind == "literal":
        return str(e.value)
    return e.kind
