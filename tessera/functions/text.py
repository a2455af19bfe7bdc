"""Tokenizers, full-text query grammar and posting tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def simple_tokens(c: Column) -> Column:
    """Split on Unicode white space, lower-case, drop empties; punctuation stays."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: t != "")


def trigrams(c: Column) -> Column:
    """Lower-case overlapping 3-grams; none below three characters."""
    low = F.lower(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, grams).otherwise(F.array().cast("array<string>"))


_REGISTRY: dict[str, tuple[Tokenizer, Callable[[str], list[str]]]] = {}
#: SQL text of a tokenizer, with {c} for the column; without it, the SQL front-end cannot use the tokenizer.
_SQL: dict[str, str] = {}
#: Tokenizers whose tokens are parts of the lower-cased text.
_INSIDE = {"simple", "trigram"}


def register_tokenizer(name: str, tokenize: Tokenizer, plan: Callable[[str], list[str]], sql: str | None = None) -> None:
    """Add a tokenizer: one function over a column for rows, one over a string for query terms."""
    _REGISTRY[name] = (tokenize, plan)
    if sql:
        _SQL[name] = sql


def register_python_tokenizer(spark, name: str, tokenize: Callable[[str], list[str]]) -> None:
    """Add a tokenizer in plain Python; rows go through it in Arrow batches."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: tokenize(t) if t is not None else None), "array<string>", F.PandasUDFType.SCALAR)
    spark.udf.register(f"tessera_tokens_{name}", udf)
    register_tokenizer(name, lambda c: udf(c), tokenize, f"tessera_tokens_{name}({{c}})")


def tokenizer(name: str) -> tuple[Tokenizer, Callable[[str], list[str]]]:
    if name not in _REGISTRY:
        raise KeyError(f"Unknown tokenizer: {name}")
    return _REGISTRY[name]


register_tokenizer("simple", simple_tokens, lambda s: s.lower().split(), r"filter(split(lower({c}), '(?U)\\s+'), t -> t <> '')")
register_tokenizer(
    "trigram", trigrams, lambda s: [s.lower()[i : i + 3] for i in range(len(s) - 2)],
    "if(char_length({c}) >= 3, transform(sequence(1, char_length({c}) - 2), i -> substring(lower({c}), i, 3)), array())",
)


def parse_query(query: str, plan: Callable[[str], list[str]] = tokenizer("simple")[1]):
    """Boolean grammar: terms, "phrases", AND (also by adjacency), OR, parentheses. AND binds tighter.

    Gives nested tuples ("and"|"or", left, right), ("token", t), ("phrase", [t…]) or None where all terms vanish.
    """
    items: list[tuple[str, str]] = []
    i = 0
    while i < len(query):
        ch = query[i]
        if ch.isspace():
            i += 1
        elif ch in "()":
            items.append((ch, ch))
            i += 1
        elif ch == '"':
            end = query.find('"', i + 1)
            if end < 0:
                raise ValueError("Unterminated phrase")
            if not plan(query[i + 1 : end]):
                raise ValueError("Empty phrase")
            items.append(("phrase", query[i + 1 : end]))
            i = end + 1
        else:
            end = i
            while end < len(query) and not query[end].isspace() and query[end] not in '()"':
                end += 1
            word = query[i:end]
            items.append((word.upper(), word) if word.upper() in ("AND", "OR") else ("term", word))
            i = end
    if not items:
        raise ValueError("Empty full-text query")
    at = 0

    def both(kind, left, right):
        return right if left is None else left if right is None else (kind, left, right)

    def any_of():
        nonlocal at
        left = all_of()
        while at < len(items) and items[at][0] == "OR":
            at += 1
            left = both("or", left, all_of())
        return left

    def all_of():
        nonlocal at
        left = one()
        while at < len(items) and items[at][0] not in ("OR", ")"):
            if items[at][0] == "AND":
                at += 1
            left = both("and", left, one())
        return left

    def one():
        nonlocal at
        if at >= len(items):
            raise ValueError("Unexpected end of full-text query")
        kind, word = items[at]
        at += 1
        if kind == "(":
            inner = any_of()
            if at >= len(items) or items[at][0] != ")":
                raise ValueError("Unbalanced parentheses")
            at += 1
            return inner
        if kind == "phrase":
            return ("phrase", plan(word))
        if kind != "term":
            raise ValueError(f"Unexpected {word!r} in full-text query")
        out = None
        for t in plan(word):
            out = both("and", out, ("token", t))
        return out

    tree = any_of()
    if at < len(items):
        raise ValueError("Unbalanced parentheses")
    if tree is None:
        raise ValueError("Full-text query has no tokens")
    return tree


def match_tree(tokens: Column, tree) -> Column:
    """The predicate of a parsed query over a row's token array; null text matches nothing."""
    if tree[0] == "token":
        return F.coalesce(F.array_contains(tokens, tree[1]), F.lit(False))
    if tree[0] == "phrase":
        words = tree[1]
        if not any(any(ch.isspace() for ch in w) for w in words):
            row = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
            return F.coalesce(F.contains(row, F.lit(" " + " ".join(words) + " ")), F.lit(False))
        want = F.array(*[F.lit(w) for w in words])
        starts = F.sequence(F.lit(1), F.size(tokens) - len(words) + 1)
        hit = F.exists(starts, lambda i: F.slice(tokens, i, F.lit(len(words))) == want)
        return F.coalesce(F.when(F.size(tokens) >= len(words), hit), F.lit(False))
    left, right = match_tree(tokens, tree[1]), match_tree(tokens, tree[2])
    return (left & right) if tree[0] == "and" else (left | right)


def tokens_of(tree) -> list[str]:
    """The tokens that a parsed query names, sorted."""
    own = {tree[1]} if tree[0] == "token" else set(tree[1]) if tree[0] == "phrase" else {*tokens_of(tree[1]), *tokens_of(tree[2])}
    return sorted(own)


def holds(tree, test: Callable[[str], str | Column], both, either):
    """A condition that every match meets: of a phrase each token, by `test`."""
    if tree[0] in ("token", "phrase"):
        out = None
        for t in [tree[1]] if tree[0] == "token" else tree[1]:
            out = test(t) if out is None else both(out, test(t))
        return out
    left, right = (holds(x, test, both, either) for x in tree[1:])
    return both(left, right) if tree[0] == "and" else either(left, right)


def match_sql(c: str, query: str, name: str = "simple") -> str:
    """The predicate of MATCH as Spark SQL text.

    Most rows are settled by looking for the tokens in the lower-cased text; the others are cut into tokens, once each.
    """
    if name not in _SQL:
        raise KeyError(f"Tokenizer {name} has no SQL form")
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def text(tree) -> str:
        if tree[0] == "token":
            return f"coalesce(array_contains(ts, {quoted(tree[1])}), false)"
        if tree[0] == "phrase":
            words = f"array({', '.join(map(quoted, tree[1]))})"
            n = len(tree[1])
            return f"coalesce(size(ts) >= {n} AND exists(sequence(1, greatest(size(ts) - {n - 1}, 1)), i -> slice(ts, i, {n}) = {words}), false)"
        return f"({text(tree[1])} {tree[0].upper()} {text(tree[2])})"

    tree = parse_query(query, tokenizer(name)[1])
    exact = f"exists(array({_SQL[name].format(c=c)}), ts -> {text(tree)})"
    if name not in _INSIDE:
        return exact
    first = holds(tree, lambda t: f"contains(low, {quoted(t)})", lambda a, b: f"({a} AND {b})", lambda a, b: f"({a} OR {b})")
    return f"(coalesce(exists(array(lower({c})), low -> {first}), false) AND {exact})"


def match(c: Column, query: str, name: str = "simple") -> Column:
    """MATCH(c) AGAINST(query): evaluated inside the scan's projection, no Python at run time."""
    tokenize, plan = tokenizer(name)
    tree = parse_query(query, plan)
    # as a lambda's variable the tokens of a row are made once, however many terms look at them
    exact = F.exists(F.array(tokenize(c)), lambda ts: match_tree(ts, tree))
    if name not in _INSIDE:
        return exact
    first = F.exists(F.array(F.lower(c)), lambda low: holds(tree, lambda t: F.contains(low, F.lit(t)), lambda a, b: a & b, lambda a, b: a | b))
    return F.coalesce(first, F.lit(False)) & exact


def postings(df: DataFrame, key: str, text: str, name: str = "simple") -> DataFrame:
    """Inverted index: one row (key, pos, token) for each token of a text. Nothing is shuffled."""
    return df.select(F.col(key), F.posexplode(tokenizer(name)[0](F.col(text))).alias("pos", "token"))


def write_postings(df: DataFrame, key: str, text: str, path: str, name: str = "simple") -> None:
    """The inverted index as files sorted by token, so that a lookup reads the row groups of its tokens alone. No shuffle."""
    postings(df, key, text, name).sortWithinPartitions("token", key).write.parquet(path)


def _back(i: int) -> Callable[[Column], Column]:
    return lambda p: p - i


def resolve(index: DataFrame, tree, key: str) -> DataFrame:
    """Keys that satisfy a parsed query, from postings alone: one scan of the query's tokens, one aggregate by key.

    Positions are only read if the query has a phrase.
    """
    tokens, phrases = tokens_of(tree), "phrase" in str(tree).split("'")
    hits = index.where(F.col("token").isin(tokens))
    if tree[0] == "token":
        return hits.select(key).distinct()
    mine = [F.col("token") == t for t in tokens]
    found = [(F.collect_list(F.when(m, F.col("pos"))) if phrases else F.max(m)).alias(f"t{i}") for i, m in enumerate(mine)]
    at = {t: F.col(f"t{i}") for i, t in enumerate(tokens)}

    def true(tree) -> Column:
        if tree[0] == "token":
            return F.size(at[tree[1]]) > 0 if phrases else at[tree[1]]
        if tree[0] == "phrase":
            common = at[tree[1][0]]
            for i, word in enumerate(tree[1][1:], 1):
                common = F.array_intersect(common, F.transform(at[word], _back(i)))
            return F.size(common) > 0
        left, right = true(tree[1]), true(tree[2])
        return (left & right) if tree[0] == "and" else (left | right)

    return hits.groupBy(key).agg(*found).where(true(tree)).select(key)


def like_by_trigrams(df: DataFrame, key: str, text: str, pattern: str, index: DataFrame | None = None) -> DataFrame:
    """LIKE '%…%' through trigram postings: candidates have every trigram of the literal runs, LIKE is rechecked."""
    from tessera.functions.scalar import like

    runs = [r for r in pattern.replace("_", "%").split("%") if len(r) >= 3]
    need = sorted({g for r in runs for g in tokenizer("trigram")[1](r)})
    if not need:
        return df.where(like(F.col(text), pattern))
    index = postings(df, key, text, "trigram") if index is None else index
    hits = resolve(index, functools.reduce(lambda a, b: ("and", a, b), [("token", g) for g in need]), key)
    return df.join(hits.select(key), key, "left_semi").where(like(F.col(text), pattern))
