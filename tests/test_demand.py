"""Questions that bind arguments of a recursion give what the whole recursion has for them."""

import pytest

from credence.engine import Engine
from credence.operators import evaluate
from credence.sources.kb import KnowledgeBase

FACTS = """e(a,b) @{b:0.9}. e(b,c) @{b:0.8, d:0.1}. e(a,c) @{b:0.5}. e(c,d). e(x,y). e(y,z). path(d, q) @{b:0.5}."""
RIGHT = "path(X,Y) :- e(X,Y). path(X,Y) :- e(X,Z), path(Z,Y) @{b:0.9}."
LEFT = "path(X,Y) :- e(X,Y). path(X,Y) :- path(X,Z), e(Z,Y) @{b:0.9}."
DOUBLE = "path(X,Y) :- e(X,Y). path(X,Y) :- path(X,Z), path(Z,Y)."
CYCLE = "e(d, a). path(X,Y) :- e(X,Y). path(X,Y) :- e(X,Z), path(Z,Y)."


def asked(spark, program, query, options=""):
    rows = Engine(spark).evaluate(KnowledgeBase.parse(program), f"?- {query}{options}").rows()
    return sorted(((tuple(sorted(r[0].items())), round(r[1], 9), round(r[2], 9)) for r in rows), key=str)


MAXIMUM = " @{support_aggregation:maximum, rule_applicability:body_truth_only}"
CASES = [(RIGHT, "path(a, Y)", ""), (LEFT, "path(X, d)", ""), (LEFT, "path(a, Y), e(Y, Z)", MAXIMUM), (DOUBLE, "path(a, d)", MAXIMUM), (CYCLE, "path(a, Y)", MAXIMUM), (RIGHT, "path(a, Y)", " @{max_depth:2}")]


@pytest.mark.parametrize(("rules", "query", "options"), CASES)
def test_same_answers(spark, monkeypatch, rules, query, options):
    got = asked(spark, FACTS + rules, query, options)
    monkeypatch.setattr(evaluate, "rewrite", lambda *a: None)
    assert got == asked(spark, FACTS + rules, query, options)


def test_only_what_is_reached(spark):
    kb = KnowledgeBase.parse(FACTS + RIGHT)
    from credence.plans import syntax

    q = syntax.query("?- path(x, Y).")
    ev = evaluate.Evaluator(spark, kb, q.goals, q.options)
    assert ev.relation(("path$pbf", 2)).df.count() == 3
    assert ("path", 2) not in ev.graph.edges
