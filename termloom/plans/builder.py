"""Queries built in Python. Terms are taken as they are, without the analyzer."""

from __future__ import annotations

from collections.abc import Iterable

from termloom.errors import BuilderError
from termloom.plans.ast import And, Node, Not, Or, Term


def _combined(kind: type, terms: Iterable[str]) -> Node:
    nodes = [Term(t) for t in terms]
    if len(nodes) < 2:
        raise BuilderError("a clause takes at least two terms")
    node: Node = nodes[0]
    for term in nodes[1:]:
        node = kind((node, term))
    return node


class BooleanPredicateBuilder:
    """``must([...])`` or ``should([...])``, extended by ``with_must``, ``with_should`` and ``must_not``."""

    def __init__(self, node: Node | None = None):
        self._node = node

    @staticmethod
    def must(terms: Iterable[str]) -> BooleanPredicateBuilder:
        return BooleanPredicateBuilder(_combined(And, terms))

    @staticmethod
    def should(terms: Iterable[str]) -> BooleanPredicateBuilder:
        return BooleanPredicateBuilder(_combined(Or, terms))

    def _with(self, kind: type, other: BooleanPredicateBuilder | Node | str) -> BooleanPredicateBuilder:
        node = other.build() if isinstance(other, BooleanPredicateBuilder) else Term(other) if isinstance(other, str) else other
        return BooleanPredicateBuilder(node if self._node is None else kind((self._node, node)))

    def with_must(self, other: BooleanPredicateBuilder | Node | str) -> BooleanPredicateBuilder:
        return self._with(And, other)

    def with_should(self, other: BooleanPredicateBuilder | Node | str) -> BooleanPredicateBuilder:
        return self._with(Or, other)

    def must_not(self, terms: Iterable[str]) -> BooleanPredicateBuilder:
        """Documents with none of the terms."""
        builder = self
        for term in terms:
            builder = builder._with(And, Not(Term(term)))
        return builder

    def build(self) -> Node:
        if self._node is None:
            raise BuilderError("nothing to build")
        return self._node
