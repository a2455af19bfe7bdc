"""Recursive-descent parser: one statement of text to a tree of nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.sql.errors import SqlError
from tessera.sql.lexer import Token, tokenize


@dataclass
class Node:
    """kind and its parts; see the parser's methods for what each kind holds."""

    kind: str
    args: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None


def node(kind: str, **args) -> Node:
    return Node(kind, args)


FUNCTIONS = {"LENGTH", "SUBSTR", "SUBSTRING", "COALESCE", "UPPER", "LOWER", "CONCAT", "ABS", "ROUND"}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG"}
TYPES = {
    **dict.fromkeys("INT INTEGER BIGINT SERIAL BIGSERIAL".split(), "int"), **dict.fromkeys("FLOAT DOUBLE REAL".split(), "float"),
    **dict.fromkeys("TEXT VARCHAR CHAR STRING".split(), "string"), **dict.fromkeys("BYTEA BLOB".split(), "bytes"), **dict.fromkeys("BOOLEAN BOOL".split(), "bool"),
    "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp", **dict.fromkeys("DECIMAL DEC NUMERIC".split(), "decimal"),
}
#: Words that end an expression or an alias.
RESERVED = set(
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT MINUS ALL DISTINCT AS ON JOIN INNER LEFT RIGHT FULL OUTER CROSS NATURAL USING AND OR NOT "
    "IN IS NULL LIKE BETWEEN CASE WHEN THEN ELSE END EXISTS CAST WITH SET VALUES INTO LATERAL WINDOW".split()
)


class Parser:
    def __init__(self, sql: str):
        self.tokens = tokenize(sql)
        self.at = 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def is_(self, *words: str) -> bool:
        return all(t.kind in ("word", "op") and not t.text.startswith("`") and t.text.upper() == w for t, w in zip((self.peek(i) for i in range(len(words))), words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"Expected {' '.join(words)}, found {self.now.text or 'end of statement'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind != "word" or (t.text.upper() in RESERVED and not t.text.startswith("`")):
            raise SqlError(f"Expected a name, found {t.text or 'end of statement'!r}")
        self.at += 1
        return t.value

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    # statements
    def statement(self) -> Node:
        if self.now.kind == "end":
            raise SqlError("There is no statement")
        out = self.one_statement()
        self.take(";")
        if self.now.kind != "end":
            raise SqlError(f"A statement ends before {self.now.text!r}: only one is taken at a time")
        return out

    def one_statement(self) -> Node:
        if self.is_("SELECT") or self.is_("WITH") or self.is_("("):
            return node("select", query=self.query())
        if self.take("EXPLAIN"):
            return node("explain", query=self.query())
        if self.take("CREATE", "TABLE"):
            return self.create_table()
        if self.take("CREATE", "INDEX"):
            return self.create_index(False)
        if self.take("CREATE", "FULLTEXT", "INDEX"):
            return self.create_index(True)
        if self.take("DROP", "TABLE"):
            quiet = self.take("IF", "EXISTS")
            return node("drop_table", table=self.name(), quiet=quiet)
        if self.take("DROP", "INDEX"):
            return node("drop_index", name=self.name())
        if self.take("ALTER", "TABLE"):
            return self.alter()
        if self.take("INSERT", "INTO"):
            return self.insert()
        if self.take("UPDATE"):
            return self.update()
        if self.take("DELETE", "FROM"):
            return node("delete", table=self.name(), where=self.expr() if self.take("WHERE") else None)
        if self.take("ANALYZE"):
            self.take("TABLE")
            return node("analyze", table=self.name())
        raise SqlError(f"No statement begins with {self.now.text}")

    def type_(self) -> tuple[str, bool]:
        word = self.name().upper()
        if word not in TYPES:
            raise SqlError(f"There is no type {word}")
        self.take("PRECISION")
        if self.take("("):
            while not self.take(")"):
                self.at += 1
                if self.now.kind == "end":
                    raise SqlError("Expected )")
        return TYPES[word], word in ("SERIAL", "BIGSERIAL")

    def column(self) -> Node:
        name = self.name()
        kind, auto = self.type_()
        null, key, default = True, False, None
        while True:
            if self.take("PRIMARY", "KEY"):
                key = True
            elif self.take("NOT", "NULL"):
                null = False
            elif self.take("NULL"):
                pass
            elif self.take("DEFAULT"):
                default = self.unary()
            elif self.take("AUTO_INCREMENT") or self.take("AUTOINCREMENT"):
                auto = True
            else:
                return node("column", name=name, type=kind, null=null and not key, key=key, default=default, auto=auto)

    def create_table(self) -> Node:
        quiet = self.take("IF", "NOT", "EXISTS")
        table, columns, key, options = self.name(), [], None, {}
        self.need("(")
        while True:
            if self.take("PRIMARY", "KEY"):
                key = self.names()
            else:
                columns.append(self.column())
            if not self.take(","):
                break
        self.need(")")
        if self.take("WITH"):
            self.need("(")
            while not self.take(")"):
                k = self.name()
                self.need("=")
                options[k] = self.now.value
                self.at += 1
                self.take(",")
        return node("create_table", table=table, columns=columns, key=key or [c.name for c in columns if c.key], options=options, quiet=quiet)

    def create_index(self, fulltext: bool) -> Node:
        name = self.name()
        self.need("ON")
        table, columns = self.name(), self.names()
        using = self.name() if fulltext and self.take("USING") else "simple"
        return node("create_index", name=name, table=table, columns=columns, fulltext=fulltext, tokenizer=using)

    def alter(self) -> Node:
        table = self.name()
        if self.take("ADD"):
            self.take("COLUMN")
            return node("alter_add", table=table, column=self.column())
        if self.take("RENAME"):
            self.take("COLUMN")
            old = self.name()
            self.need("TO")
            return node("alter_rename", table=table, old=old, new=self.name())
        self.need("DROP")
        self.take("COLUMN")
        return node("alter_drop", table=table, name=self.name())

    def insert(self) -> Node:
        table = self.name()
        columns = self.names() if self.is_("(") and not self.peek().text.upper() in ("SELECT", "WITH") else None
        if self.take("VALUES"):
            rows = []
            while True:
                self.need("(")
                rows.append([self.expr()])
                while self.take(","):
                    rows[-1].append(self.expr())
                self.need(")")
                if not self.take(","):
                    return node("insert", table=table, columns=columns, rows=rows, query=None)
        return node("insert", table=table, columns=columns, rows=None, query=self.query())

    def update(self) -> Node:
        table = self.name()
        self.need("SET")
        sets = []
        while True:
            column = self.name()
            self.need("=")
            sets.append((column, self.expr()))
            if not self.take(","):
                break
        return node("update", table=table, sets=sets, where=self.expr() if self.take("WHERE") else None)

    # queries
    def query(self) -> Node:
        ctes = []
        if self.take("WITH"):
            if self.take("RECURSIVE"):
                raise SqlError("WITH takes no RECURSIVE")
            while True:
                name = self.name()
                columns = self.names() if self.is_("(") else None
                self.need("AS")
                self.need("(")
                if name in [c[0] for c in ctes]:
                    raise SqlError(f"WITH names {name} twice")
                ctes.append((name, columns, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body = self.set_expr()
        order, limit, offset = [], None, None
        if self.take("ORDER", "BY"):
            if self.is_("ALL"):
                raise SqlError("ORDER BY takes expressions, not ALL")
            while True:
                key = self.expr()
                asc = not self.take("DESC")
                if asc:
                    self.take("ASC")
                if self.take("NULLS", "FIRST") or self.take("NULLS", "LAST"):
                    raise SqlError("The place of nulls is fixed: they sort lowest")
                order.append((key, asc))
                if not self.take(","):
                    break
        while True:
            if self.take("LIMIT"):
                limit = self.expr()
                if self.take(","):
                    limit, offset = self.expr(), limit
            elif self.take("OFFSET"):
                offset = self.expr()
                self.take("ROWS") or self.take("ROW")
            else:
                break
        return node("query", ctes=ctes, body=body, order=order, limit=limit, offset=offset)

    def set_expr(self) -> Node:
        left = self.set_term()
        while self.is_("UNION") or self.is_("EXCEPT") or self.is_("MINUS"):
            op = self.now.text.upper().replace("MINUS", "EXCEPT")
            self.at += 1
            left = node("setop", op=op, all=self.set_all(), left=left, right=self.set_term())
        return left

    def set_all(self) -> bool:
        every = self.take("ALL")
        self.take("DISTINCT")
        return every

    def set_term(self) -> Node:
        left = self.set_atom()
        while self.take("INTERSECT"):
            left = node("setop", op="INTERSECT", all=self.set_all(), left=left, right=self.set_atom())
        return left

    def set_atom(self) -> Node:
        if self.take("("):
            inner = self.query()
            self.need(")")
            return node("nested", query=inner)
        return self.select()

    def select(self) -> Node:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        if distinct and self.is_("ON"):
            raise SqlError("DISTINCT takes no ON")
        if not distinct:
            self.take("ALL")
        items = []
        while True:
            if self.take("*"):
                items.append((node("star", table=None), None))
            elif self.now.kind == "word" and self.peek().text == "." and self.peek(2).text == "*":
                items.append((node("star", table=self.name()), None))
                self.at += 2
            else:
                e = self.expr()
                items.append((e, self.alias()))
            if not self.take(","):
                break
        source = self.from_() if self.take("FROM") else None
        where = self.expr() if self.take("WHERE") else None
        group = []
        if self.take("GROUP", "BY"):
            if any(self.is_(w) for w in ("ALL", "ROLLUP", "CUBE")) or self.is_("GROUPING", "SETS"):
                raise SqlError("GROUP BY takes expressions, no sets of groups")
            group.append(self.expr())
            while self.take(","):
                group.append(self.expr())
        having = self.expr() if self.take("HAVING") else None
        return node("core", distinct=distinct, items=items, source=source, where=where, group=group, having=having)

    def alias(self) -> str | None:
        if self.take("AS"):
            if self.now.kind == "string":
                self.at += 1
                return self.tokens[self.at - 1].value
            return self.name()
        return self.name() if self.now.kind == "word" and (self.now.text.startswith("`") or self.now.text.upper() not in RESERVED) else None

    def from_(self) -> Node:
        left = self.joined()
        while self.take(","):
            left = node("join", type="CROSS", left=left, right=self.joined(), on=None)
        return left

    def joined(self) -> Node:
        left = self.table()
        while True:
            if self.is_("NATURAL"):
                raise SqlError("A join says its condition: NATURAL is not taken")
            if self.take("CROSS", "JOIN"):
                left = node("join", type="CROSS", left=left, right=self.table(), on=None)
                continue
            kind = None
            for word in ("LEFT", "RIGHT", "FULL"):
                if self.take(word):
                    self.take("OUTER")
                    kind = word
            if kind is None and self.take("INNER"):
                kind = "INNER"
            if kind is None and not self.is_("JOIN"):
                return left
            self.need("JOIN")
            right = self.table()
            if self.is_("USING"):
                raise SqlError("A join says its condition by ON, not by USING")
            on = self.expr() if self.take("ON") else None
            if on is None and kind in ("LEFT", "RIGHT", "FULL"):
                raise SqlError(f"{kind} JOIN needs ON")
            left = node("join", type=kind or ("INNER" if on else "CROSS"), left=left, right=right, on=on)

    def table(self) -> Node:
        if self.take("LATERAL"):
            raise SqlError("A derived table does not see its neighbours: LATERAL is not taken")
        if self.take("("):
            inner = self.query()
            self.need(")")
            alias = self.alias()
            if alias is None:
                raise SqlError("A derived table needs an alias")
            return node("derived", query=inner, alias=alias, columns=self.names() if self.is_("(") else None)
        name = self.name()
        return node("table", name=name, alias=self.alias() or name)

    # expressions
    def expr(self) -> Node:
        left = self.and_()
        while self.take("OR"):
            left = node("logic", op="OR", left=left, right=self.and_())
        return left

    def and_(self) -> Node:
        left = self.not_()
        while self.take("AND"):
            left = node("logic", op="AND", left=left, right=self.not_())
        return left

    def not_(self) -> Node:
        return node("not", arg=self.not_()) if self.take("NOT") else self.predicate()

    def predicate(self) -> Node:
        left = self.additive()
        while True:
            if self.now.kind == "op" and self.now.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.now.text.replace("!=", "<>")
                self.at += 1
                left = node("compare", op=op, left=left, right=self.additive())
                continue
            if self.take("IS"):
                negated = self.take("NOT")
                self.need("NULL")
                left = node("is_null", arg=left, negated=negated)
                continue
            negated = self.is_("NOT") and self.peek().text.upper() in ("LIKE", "BETWEEN", "IN")
            if negated:
                self.at += 1
            if self.take("LIKE"):
                left = node("like", arg=left, pattern=self.additive(), negated=negated)
                if self.is_("ESCAPE"):
                    raise SqlError("LIKE has no escape character")
            elif self.take("BETWEEN"):
                low = self.additive()
                self.need("AND")
                left = node("between", arg=left, low=low, high=self.additive(), negated=negated)
            elif self.take("IN"):
                self.need("(")
                if self.is_("SELECT") or self.is_("WITH"):
                    left = node("in_query", arg=left, query=self.query(), negated=negated)
                else:
                    items = [self.expr()]
                    while self.take(","):
                        items.append(self.expr())
                    left = node("in_list", arg=left, items=items, negated=negated)
                self.need(")")
            else:
                return left

    def additive(self) -> Node:
        left = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            op = self.now.text
            if op == "||":
                raise SqlError("Strings are joined by CONCAT, not by ||")
            self.at += 1
            left = node("arith", op=op, left=left, right=self.product())
        return left

    def product(self) -> Node:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.now.text
            if op == "%":
                raise SqlError("There is no operator %")
            self.at += 1
            left = node("arith", op=op, left=left, right=self.unary())
        return left

    def unary(self) -> Node:
        if self.take("-"):
            arg = self.unary()
            return node("literal", type=arg.type, value=-arg.value) if arg.kind == "literal" and arg.type in ("int", "float") else node("negate", arg=arg)
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> Node:
        t = self.now
        if t.kind == "number":
            self.at += 1
            return node("literal", type="int" if isinstance(t.value, int) else "float", value=t.value)
        if t.kind == "string":
            self.at += 1
            return node("literal", type="string", value=t.value)
        if t.kind == "param":
            self.at += 1
            return node("param", name=t.value)
        if self.take("("):
            if self.is_("SELECT") or self.is_("WITH"):
                out = node("scalar", query=self.query())
            else:
                out = self.expr()
            self.need(")")
            return out
        word = t.text.upper() if t.kind == "word" else ""
        if word in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return node("literal", type="null" if word == "NULL" else "bool", value=None if word == "NULL" else word == "TRUE")
        if word == "CASE":
            return self.case()
        if word == "EXISTS":
            self.at += 1
            self.need("(")
            out = node("exists", query=self.query())
            self.need(")")
            return out
        if word == "CAST":
            self.at += 1
            self.need("(")
            arg = self.expr()
            self.need("AS")
            kind, _ = self.type_()
            self.need(")")
            return node("cast", arg=arg, type=kind)
        if word in ("DATE", "TIME", "TIMESTAMP", "DECIMAL") and self.peek().kind == "string":
            self.at += 2
            return node("cast", arg=node("literal", type="string", value=self.tokens[self.at - 1].value), type=TYPES[word])
        if word == "MATCH" and self.peek().text == "(":
            return self.match()
        if t.kind == "word" and self.peek().text == "(":
            return self.call()
        first = self.name()
        if self.take("."):
            return node("column", table=first, name=self.name())
        return node("column", table=None, name=first)

    def case(self) -> Node:
        self.need("CASE")
        subject = None if self.is_("WHEN") else self.expr()
        whens, default = [], None
        while self.take("WHEN"):
            cond = self.expr()
            self.need("THEN")
            whens.append((cond, self.expr()))
        if self.take("ELSE"):
            default = self.expr()
        self.need("END")
        if not whens:
            raise SqlError("CASE needs WHEN")
        return node("case", subject=subject, whens=whens, default=default)

    def match(self) -> Node:
        self.need("MATCH", "(")
        column = self.expr()
        if self.is_(","):
            raise SqlError("MATCH takes exactly one column")
        self.need(")")
        self.need("AGAINST", "(")
        query = self.expr()
        self.need(")")
        if column.kind != "column" or query.kind not in ("literal", "param"):
            raise SqlError("MATCH needs a column, AGAINST a string")
        return node("match", column=column, query=query)

    def call(self) -> Node:
        name = self.name().upper()
        self.need("(")
        if name in AGGREGATES:
            distinct = self.take("DISTINCT")
            if self.take("*"):
                if name != "COUNT" or distinct:
                    raise SqlError(f"{name} takes no {'DISTINCT ' * distinct}*")
                arg = None
            elif self.is_(")"):
                raise SqlError(f"{name} needs one argument")
            else:
                arg = self.expr()
            self.need(")")
            out = node("aggregate", name=name, arg=arg, distinct=distinct)
        elif name in FUNCTIONS:
            args = []
            if not self.is_(")"):
                args.append(self.expr())
                if name in ("SUBSTR", "SUBSTRING") and self.take("FROM"):
                    args.append(self.expr())
                    if self.take("FOR"):
                        args.append(self.expr())
                while self.take(","):
                    args.append(self.expr())
            self.need(")")
            out = node("function", name="SUBSTR" if name == "SUBSTRING" else name, args_=args)
        else:
            raise SqlError(f"There is no function {name}")
        for clause in ("OVER", "FILTER"):
            if self.is_(clause) and self.peek().text == "(":
                raise SqlError(f"A function takes no {clause}")
        return out


def parse(sql: str) -> Node:
    return Parser(sql).statement()
