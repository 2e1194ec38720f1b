"""Random positive programs against a bottom-up evaluator of a few lines."""

import random
from itertools import product
from math import prod

import pytest

from credence.engine import Engine
from credence.plans import syntax
from credence.plans.model import Const
from credence.sources.kb import KnowledgeBase

AGGREGATE = {"noisy_or": lambda v: 1 - prod(1 - x for x in v), "maximum": max, "capped_sum": lambda v: min(1.0, sum(v))}


def brute(kb, rounds, how):
    """T applied ``rounds`` times: facts, and rules on the last round's aggregated states."""
    values = sorted({a.value for f in kb.facts for a in f.atom.args})
    agg = lambda v: AGGREGATE[how]([x for x in v if x > 0]) if any(x > 0 for x in v) else 0.0
    base = {}
    for f in kb.facts:
        base.setdefault((f.atom.pred, *(a.value for a in f.atom.args)), []).append((f.note.b, f.note.d))
    state = {k: (agg([b for b, _ in v]), agg([d for _, d in v])) for k, v in base.items()}
    for _ in range(rounds):
        found = {k: list(v) for k, v in base.items()}
        for r in kb.rules:
            names = sorted({v for g in r.goals for v in g.atom.variables()})
            for chosen in product(values, repeat=len(names)):
                env = dict(zip(names, chosen, strict=True))
                ground = lambda atom: (atom.pred, *(a.value if isinstance(a, Const) else env[a.name] for a in atom.args))  # noqa: E731, B023
                b, d = 1.0, 0.0
                for g in r.goals:
                    x, y = state.get(ground(g.atom), (0.0, 0.0))
                    b, d = b * x, 1 - (1 - d) * (1 - y)
                if b * (1 - d) > 0:
                    found.setdefault(ground(r.head), []).append((b * (1 - d) * r.note.b, b * (1 - d) * r.note.d))
        state = {k: (agg([b for b, _ in v]), agg([d for _, d in v])) for k, v in found.items()}
    return state


@pytest.mark.parametrize("seed", range(4))
def test_random_dag(spark, seed):
    rng = random.Random(seed)
    names = "abcde"
    lines = [f"e({x}, {y}) @{{b:{rng.choice([0.3, 0.5, 0.9, 1.0])}, d:{rng.choice([0.0, 0.0, 0.2])}}}." for i, x in enumerate(names) for y in names[i + 1 :] if rng.random() < 0.7]
    lines += ["path(X, Y) :- e(X, Y) @{b:0.9}.", "path(X, Y) :- e(X, Z), path(Z, Y) @{b:0.8, d:0.1}.", "far(X) :- path(X, Y), path(Y, e)."]
    kb = KnowledgeBase.parse("\n".join(lines))
    how = ["noisy_or", "maximum", "capped_sum"][seed % 3]
    want = brute(kb, 12, how)
    for pred, query in (("path", "?- path(X, Y)"), ("far", "?- far(X)")):
        got = {(pred, *r[0].values()): r[1:3] for r in Engine(spark).evaluate(kb, syntax.query(f"{query} @{{support_aggregation:{how}}}.")).rows()}
        expected = {k: v for k, v in want.items() if k[0] == pred and max(v) > 0}
        assert got.keys() == expected.keys()
        for k, v in expected.items():
            assert got[k] == pytest.approx(v, abs=1e-9)
