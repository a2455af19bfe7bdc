"""Order of inner joins by the tables' own statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import permutations

from tessera.sql.parser import Node

#: Chains of more tables are left as they are written.
MOST = 7


@dataclass
class Leaf:
    """A table of the chain: rows by ANALYZE, and its key if that is one column."""

    alias: str
    text: str
    rows: int
    key: str | None


@dataclass
class Link:
    """A join condition: Spark text, the aliases in it, and ((alias, column), (alias, column)) if it equates two columns."""

    text: str
    aliases: frozenset[str]
    equal: tuple | None


def inner_chain(f: Node) -> tuple[list[Node], list[Node]] | None:
    """Tables and joins of a tree of inner joins over base tables; None for any other tree."""
    if f.kind == "table":
        return [f], []
    if f.kind != "join" or f.type != "INNER":
        return None
    left, right = inner_chain(f.left), inner_chain(f.right)
    return (left[0] + right[0], left[1] + right[1] + [f]) if left and right else None


def columns(e) -> Iterable[Node]:
    if isinstance(e, Node):
        if e.kind == "column":
            yield e
        for v in e.args.values():
            yield from columns(v)
    elif isinstance(e, (list, tuple)):
        for v in e:
            yield from columns(v)


def has_query(e) -> bool:
    return e.kind in ("scalar", "exists", "in_query", "query") or any(has_query(v) for v in e.args.values() if isinstance(v, Node)) if isinstance(e, Node) else False


def sizes(order: tuple[Leaf, ...], links: list[Link]) -> float | None:
    """Sum of the estimated rows after each join; None if some join would have no condition."""
    seen, rows, total = {order[0].alias}, float(order[0].rows), 0.0
    by_alias = {leaf.alias: leaf for leaf in order}
    for leaf in order[1:]:
        own = [x for x in links if leaf.alias in x.aliases and x.aliases <= seen | {leaf.alias}]
        if not own:
            return None
        guesses = []
        for x in own:
            guess = max(rows, float(leaf.rows))
            if x.equal:
                (a, p), (b, q) = x.equal if x.equal[1][0] == leaf.alias else x.equal[::-1]
                if by_alias[leaf.alias].key == q:
                    guess = rows
                elif by_alias[a].key == p:
                    guess = leaf.rows * min(1.0, rows / max(by_alias[a].rows, 1))
            guesses.append(guess)
        rows, seen = min(guesses), seen | {leaf.alias}
        total += rows
    return total


def best_order(leaves: list[Leaf], links: list[Link]) -> list[Leaf] | None:
    """The order with the fewest rows between joins, the smaller table first; None if the written one is as good."""
    if not 2 < len(leaves) <= MOST:
        return None
    written = sizes(tuple(leaves), links)
    known = [(cost, [x.rows for x in order], order) for order in permutations(leaves) if (cost := sizes(order, links)) is not None]
    if not known:
        return None
    cost, _, order = min(known, key=lambda x: x[:2])
    return list(order) if written is None or cost < 0.9 * written else None


def from_text(order: list[Leaf], links: list[Link]) -> str:
    out, seen, left = order[0].text, {order[0].alias}, list(links)
    for leaf in order[1:]:
        seen.add(leaf.alias)
        now = [x for x in left if x.aliases <= seen]
        left = [x for x in left if x not in now]
        out += f" INNER JOIN {leaf.text} ON {' AND '.join(f'({x.text})' for x in now)}"
    return out
