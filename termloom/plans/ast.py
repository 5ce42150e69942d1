"""Boolean query trees and the rewrites that need no data.

A tree is made of ``Term``, ``And``, ``Or`` and ``Not`` nodes and the constant
``FALSE``. Trees are values: equal trees are equal, and rewrites return new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column


class Node:
    """Base of all nodes."""

    def __and__(self, other: Node) -> Node:
        return And((self, other))

    def __or__(self, other: Node) -> Node:
        return Or((self, other))

    def __invert__(self) -> Node:
        return Not(self)


@dataclass(frozen=True)
class Term(Node):
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]

    def __str__(self) -> str:
        return " & ".join(f"({c})" if isinstance(c, Or) else str(c) for c in self.children)


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]

    def __str__(self) -> str:
        return " | ".join(map(str, self.children))


@dataclass(frozen=True)
class Not(Node):
    child: Node

    def __str__(self) -> str:
        return f"!{self.child}" if isinstance(self.child, Term) else f"!({self.child})"


@dataclass(frozen=True)
class _False(Node):
    def __str__(self) -> str:
        return "FALSE"


FALSE = _False()


def children_of(node: Node) -> tuple[Node, ...]:
    if isinstance(node, And | Or):
        return node.children
    return (node.child,) if isinstance(node, Not) else ()


def walk(node: Node) -> Iterator[Node]:
    """The node and everything below it, without recursion, so that long chains do not overflow the stack."""
    waiting = [node]
    while waiting:
        yield (current := waiting.pop())
        waiting.extend(reversed(children_of(current)))


def terms_of(node: Node) -> list[str]:
    """Distinct terms, sorted."""
    return sorted({n.text for n in walk(node) if isinstance(n, Term)})


def leaf_count(node: Node) -> int:
    return sum(isinstance(n, Term) for n in walk(node))


def node_count(node: Node) -> int:
    return sum(1 for _ in walk(node))


def rebuild(node: Node, make: Callable[[Node, tuple[Node, ...]], Node]) -> Node:
    """Bottom-up rewrite: ``make`` gets every node and its rewritten children."""
    done: list[Node] = []
    waiting: list[tuple[Node, bool]] = [(node, False)]
    while waiting:
        current, opened = waiting.pop()
        below = children_of(current)
        if not opened and below:
            waiting.append((current, True))
            waiting.extend((c, False) for c in reversed(below))
            continue
        at = len(done) - len(below)
        ready = tuple(done[at:])
        del done[at:]
        done.append(make(current, ready))
    return done[0]


def _same(node: Node, children: tuple[Node, ...]) -> Node:
    if isinstance(node, And | Or):
        return type(node)(children)
    return Not(children[0]) if isinstance(node, Not) else node


def flatten(node: Node) -> Node:
    """Nested nodes of one kind become one n-ary node; nodes with one child become the child."""

    def make(current: Node, children: tuple[Node, ...]) -> Node:
        if not isinstance(current, And | Or):
            return _same(current, children)
        kind = type(current)
        flat: list[Node] = []
        for child in children:
            flat.extend(child.children if isinstance(child, kind) else (child,))
        return flat[0] if len(flat) == 1 else kind(tuple(flat))

    return rebuild(node, make)


def _simple(current: Node, children: tuple[Node, ...]) -> Node:
    if not isinstance(current, And | Or):
        if isinstance(current, Not) and isinstance(children[0], Not):
            return children[0].child
        return _same(current, children)
    kind, other = type(current), Or if isinstance(current, And) else And
    unique = list(dict.fromkeys(children))
    if kind is And and FALSE in unique:
        return FALSE
    unique = [c for c in unique if c != FALSE]
    if not unique:
        return FALSE
    # Absorption: a child of the other kind that contains a sibling adds nothing.
    present = set(unique)
    unique = [c for c in unique if not (isinstance(c, other) and present.intersection(c.children))]
    if len(unique) == 1:
        return unique[0]
    return _factored(kind, other, unique)


def _factored(kind: type, other: type, children: list[Node]) -> Node:
    """What all children share is taken out: (a & b) | (a & c) becomes a & (b | c), and the other way round."""
    parts = [list(c.children) if isinstance(c, other) else [c] for c in children]
    common = [p for p in parts[0] if all(p in rest for rest in parts[1:])]
    if not common:
        return kind(tuple(children))
    rests = [[p for p in part if p not in common] for part in parts]
    if not all(rests):
        # One child is just what all share, and absorbs the others.
        return common[0] if len(common) == 1 else other(tuple(common))
    inner = kind(tuple(r[0] if len(r) == 1 else other(tuple(r)) for r in rests))
    return other((*common, inner))


def simplify(node: Node, missing: Iterable[str] = ()) -> Node:
    """Flatten, fold terms known to be missing, drop duplicates, absorb and factor, until nothing changes.

    A missing term makes its conjunction ``FALSE`` and vanishes from a disjunction.
    """
    gone = frozenset(missing)
    if gone:
        node = rebuild(node, lambda n, c: FALSE if isinstance(n, Term) and n.text in gone else _same(n, c))
    while (after := flatten(rebuild(flatten(node), _simple))) != node:
        node = after
    return node


def to_binary(node: Node) -> Node:
    """N-ary nodes as left-deep pairs."""

    def make(current: Node, children: tuple[Node, ...]) -> Node:
        if not isinstance(current, And | Or):
            return _same(current, children)
        return reduce(lambda a, b: type(current)((a, b)), children)

    return rebuild(node, make)


def matches_nothing_at_all(node: Node) -> bool:
    """Whether a document without any of the query's terms matches (only through ``Not``)."""
    return holds(node, frozenset())


def possible(node: Node) -> Node | None:
    """What a group of documents must hold between them for one of them to match: every ``Not`` taken as true.

    None if that asks for nothing.
    """

    def make(current: Node, children: tuple) -> Node | None:
        if isinstance(current, Not):
            return None
        if isinstance(current, And):
            kept = tuple(c for c in children if c is not None)
            return And(kept) if len(kept) > 1 else kept[0] if kept else None
        if isinstance(current, Or):
            return None if None in children else Or(children)
        return current

    return rebuild(node, make)


def holds(node: Node, present: frozenset[str] | set[str]) -> bool:
    """Whether a document with just these of the query's terms matches."""

    def make(current: Node, children: tuple) -> Node:
        if isinstance(current, Term):
            return current.text in present
        if isinstance(current, And):
            return all(children)
        if isinstance(current, Or):
            return any(children)
        return not children[0] if isinstance(current, Not) else False

    return rebuild(node, make)


def to_column(node: Node, leaves: Mapping[str, Column], false: Column) -> Column:
    """The tree as a column expression over one boolean column per term."""

    def make(current: Node, children: tuple) -> Column:
        if isinstance(current, Term):
            return leaves[current.text]
        if isinstance(current, And):
            return reduce(lambda a, b: a & b, children)
        if isinstance(current, Or):
            return reduce(lambda a, b: a | b, children)
        return ~children[0] if isinstance(current, Not) else false

    return rebuild(node, make)


def to_clauses(node: Node, limit: int = 64) -> list[frozenset[str]] | None:
    """Disjunctive normal form as sets of terms; None for trees with ``Not`` or more than ``limit`` clauses."""

    def make(current: Node, children: tuple) -> list[frozenset[str]] | None:
        if isinstance(current, Term):
            return [frozenset([current.text])]
        if isinstance(current, Not) or any(c is None for c in children):
            return None
        if isinstance(current, Or):
            made = {clause for c in children for clause in c}
        elif isinstance(current, And):
            made = {frozenset()}
            for c in children:
                made = {a | b for a in made for b in c}
                if len(made) > limit * 4:
                    return None
        else:
            return []
        least = [c for c in made if not any(other < c for other in made)]
        return sorted(least, key=sorted) if len(least) <= limit else None

    return rebuild(node, make)
