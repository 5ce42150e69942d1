import random

import pytest

from termloom.errors import BuilderError, EmptyTermError, QuerySyntaxError
from termloom.functions.analysis import query_tokens
from termloom.plans.ast import FALSE, And, Not, Or, Term, flatten, holds, leaf_count, node_count, simplify, terms_of, to_binary, to_clauses
from termloom.plans.builder import BooleanPredicateBuilder
from termloom.plans.parser import parse_infix, parse_prefix, parse_query, query_of_line
from termloom.plans.planner import TermStats, estimate, plan

a, b, c, d = (Term(t) for t in "abcd")


# Texts and trees whose results are part of the query languages' contract.
@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("ast AND ast", "ast & ast"),
        ("ast OR ast", "ast | ast"),
        ("ast AND ast AND (ast OR ast OR (ast AND ast))", "ast & ast & (ast | ast | ast & ast)"),
        ("lord AND of AND the AND ring", "lord & of & the & ring"),
        ("10.251.43.147", "10 & 251 & 43 & 147"),
    ],
)
def test_infix_shown(text, shown):
    assert str(parse_infix(text)) == shown


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a OR b AND c", And((Or((a, b)), c))),
        ("a AND b OR c", Or((And((a, b)), c))),
        ("a AND (b OR c)", And((a, Or((b, c))))),
        ("(a OR b)AND(c)", And((Or((a, b)), c))),
        ("a ANDb", And((a, b))),
        ("a\tOR \tb", Or((a, b))),
        ("AND AND OR", And((Term("and"), Term("or")))),
        ("((a))", a),
        ("A", a),
    ],
)
def test_infix_trees(text, tree):
    assert parse_infix(text) == tree


@pytest.mark.parametrize("text", ["", " a", "a ", "( a AND b )", "a AND", "AND a b", "a b", "(a", "a)", "a AND (b OR c", "a and b", "+a", "é AND a"])
def test_infix_rejects(text):
    with pytest.raises(QuerySyntaxError):
        parse_infix(text)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("+a +b +c", And((a, And((b, c))))),
        ("a b c", Or((a, Or((b, c))))),
        ("+a b", And((a, b))),
        ("a +b", Or((a, b))),
        ("+c +(a b)", And((c, Or((a, b))))),
        ("+c (a b)", And((c, Or((a, b))))),
        ("(+a b)", And((a, b))),
        ("+a", a),
        ("a+b", Or((a, b))),
    ],
)
def test_prefix_trees(text, tree):
    assert parse_prefix(text) == tree


@pytest.mark.parametrize("text", ["", "(a b) +c", "a ", "+ a", "a-b", "(a b", "a)", "()"])
def test_prefix_rejects(text):
    with pytest.raises(QuerySyntaxError):
        parse_prefix(text)


def test_fallback_and_empty_words():
    assert parse_query("a b") == Or((a, b))
    assert parse_query("a AND b") == And((a, b))
    with pytest.raises(EmptyTermError):
        parse_query("___ AND a")


def test_long_chains_do_not_overflow():
    assert leaf_count(flatten(parse_query(" AND ".join(["a", "b"] * 5000)))) == 10000
    assert leaf_count(parse_query(" ".join(["+a"] * 5000))) == 5000


def test_query_analyzer_limit():
    assert query_tokens("x" * 59) == ["x" * 59]
    assert query_tokens("x" * 60) == []
    assert query_tokens("Foo_bar-7") == ["foo", "bar", "7"]


def test_log_lines():
    assert query_of_line("COUNT\ta AND b") == "a AND b"
    assert query_of_line("a AND b") is None
    assert query_of_line(None) is None


def test_builder():
    assert BooleanPredicateBuilder.must(["a", "b", "c"]).build() == And((And((a, b)), c))
    assert BooleanPredicateBuilder.should(["a", "b"]).with_must("c").build() == And((Or((a, b)), c))
    assert BooleanPredicateBuilder.must(["a", "b"]).with_should(BooleanPredicateBuilder.must(["c", "d"])).build() == Or((And((a, b)), And((c, d))))
    assert BooleanPredicateBuilder().must_not(["a"]).build() == Not(a)
    for wrong in (lambda: BooleanPredicateBuilder.must(["a"]), lambda: BooleanPredicateBuilder.should([]), lambda: BooleanPredicateBuilder().build()):
        with pytest.raises(BuilderError):
            wrong()


def test_rewrites():
    assert flatten(And((And((a, b)), And((c, d))))) == And((a, b, c, d))
    assert simplify(And((a, a))) == a
    assert simplify(And((a, Or((a, b))))) == a
    assert simplify(Or((And((a, b)), And((a, c))))) == And((a, Or((b, c))))
    assert simplify(Or((And((a, b)), And((a, b, c))))) == And((a, b))
    assert simplify(And((Or((a, b)), Or((c, b, a))))) == Or((a, b))
    assert simplify(And((a, b)), ["b"]) == FALSE
    assert simplify(Or((a, b)), ["b"]) == a
    assert simplify(Or((a, And((b, c)))), ["a", "c"]) == FALSE
    assert simplify(Not(Not(a))) == a
    assert to_binary(And((a, b, c))) == And((And((a, b)), c))
    tree = And((Term("4"), And((Term("1"), Or((Term("3"), Term("2")))))))
    assert (node_count(flatten(tree)), leaf_count(tree)) == (6, 4)


def _random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return Term(rng.choice("abcdef"))
    kind = rng.choice([And, Or])
    return kind(tuple(_random_tree(rng, depth - 1) for _ in range(rng.randint(2, 3))))


def test_rewrites_keep_the_meaning():
    rng = random.Random(1)
    for _ in range(2000):
        tree = _random_tree(rng, 4)
        simple, clauses = simplify(tree), to_clauses(tree, 4096)
        for _ in range(20):
            present = {t for t in "abcdef" if rng.random() < 0.5}
            assert holds(tree, present) == holds(simple, present) == holds(to_binary(tree), present)
            assert holds(tree, present) == any(clause <= present for clause in clauses)


def test_estimates_and_order():
    # The tree, its selectivities and what they come to are part of the planner's contract.
    stats = {str(i): TermStats(i, i / 10) for i in (1, 2, 3, 4)}
    tree = flatten(And((Term("4"), And((Term("1"), Or((Term("3"), Term("2"))))))))
    found = estimate(tree, stats)
    assert [str(x.node) for x in found.children] == ["1", "4", "3 | 2"]
    assert [round(x.rank, 6) for x in found.children] == [-0.9, -0.6, -0.28]
    assert round(found.selectivity, 6) == 0.0176
    assert found.children[2].selectivity == pytest.approx(0.44)
    assert found.cumulative == pytest.approx(1 - (1 - 0.0176) ** 8)


def test_strategies():
    stats = {"a": TermStats(1, 0.1), "b": TermStats(1000, 0.9), "c": TermStats(1000, 0.9)}
    assert plan(And((b, c)), stats).strategy == "all"
    assert plan(And((a, b)), stats).strategy == "semi"
    assert plan(Or((a, b)), stats).strategy == "any"
    assert plan(And((a, Or((b, c)))), stats).strategy == "tree"
    assert plan(And((a, d)), stats).strategy == "empty"
    assert plan(Or((a, d)), stats).strategy == "term"
    assert terms_of(plan(Or((a, d)), stats).node) == ["a"]
