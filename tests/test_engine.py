"""Programs, queries and the answers they must have."""

from datetime import UTC, date, datetime, timedelta

import pytest

from credence.engine import Engine
from credence.functions.semantics import UnsupportedSemantics
from credence.operators.evaluate import Evaluator
from credence.plans import syntax
from credence.plans.analysis import UnsafeProgram
from credence.sources.kb import KnowledgeBase


def ask(spark, program, query):
    return Engine(spark).evaluate(KnowledgeBase.parse(program), query).rows()


def weights(spark, program, query):
    (_, b, d, status), = ask(spark, program, query)
    return pytest.approx(b, abs=1e-9), pytest.approx(d, abs=1e-9), status


def bindings(spark, program, query):
    return sorted((tuple(sorted(r[0].items())) for r in ask(spark, program, query)), key=str)


RULES = "rain(oslo) @{b:0.6, d:0.5}. slippery(X) :- rain(X) @{b:0.5, d:0.1}."
THREE = "alarm(hall). evacuate(X) :- alarm(X) @{b:0.2}. evacuate(X) :- alarm(X) @{b:0.3}. evacuate(X) :- alarm(X) @{b:0.4}."
NESTED = "n0(k). n1(X) :- n0(X). n2(X) :- n1(X). n3(X) :- n2(X)."
VALVE = "on(valve) @{b:0.8, d:0.5}. off(valve). !:- on(X), off(X) @{b:0.5}."
CLOSED = [
    ("wet(lane) @{b:0.35}.", "?- wet(lane).", 0.35, 0, "true"),
    ("wet(lane) @{b:0, d:0.45}.", "?- wet(lane).", 0, 0.45, "false"),
    ("wet(lane) @{b:0.55, d:0.15}.", "?- wet(lane).", 0.55, 0.15, "both"),
    ("wet(road).", "?- wet(lane).", 0, 0, "neither"),
    ("wet(lane) @{b:0.4}. icy(lane) @{b:0.7}.", "?- wet(lane), icy(lane).", 0.28, 0, "true"),
    ("wet(lane) @{b:0.4}. icy(lane) @{b:0.7}.", "?- icy(lane), wet(lane) @{body_truth:minimum}.", 0.4, 0, "true"),
    ("wet(lane) @{d:0.1}. icy(lane) @{d:0.5}.", "?- wet(lane), icy(lane).", 1, 0.55, "both"),
    ("wet(lane) @{d:0.1}. icy(lane) @{d:0.5}.", "?- wet(lane), icy(lane) @{body_falsity:maximum}.", 1, 0.5, "both"),
    ("rain(oslo). slippery(X) :- rain(X) @{b:0.45, d:0.35}.", "?- slippery(oslo).", 0.45, 0.35, "both"),
    (RULES, "?- slippery(oslo).", 0.15, 0.03, "both"),
    (RULES, "?- slippery(oslo) @{rule_applicability:body_truth_only}.", 0.3, 0.06, "both"),
    (THREE, "?- evacuate(hall).", 0.664, 0, "true"),
    (THREE, "?- evacuate(hall) @{support_aggregation:maximum}.", 0.4, 0, "true"),
    (THREE, "?- evacuate(hall) @{support_aggregation:capped_sum}.", 0.9, 0, "true"),
    (THREE + "evacuate(hall) @{b:0.7}.", "?- evacuate(hall) @{support_aggregation:capped_sum}.", 1, 0, "true"),
    (NESTED, "?- n3(k) @{max_depth:2}.", 0, 0, "neither"),
    (NESTED, "?- n3(k) @{max_depth:3}.", 1, 0, "true"),
    ("blocked(gate) @{b:0, d:0.6}.", "?- not blocked(gate).", 1, 0, "true"),
    ("blocked(gate) @{b:0.2}.", "?- not blocked(gate).", 0, 0, "neither"),
    ("on(valve). off(valve). !:- on(X), off(X) @{b:0.35}.", "?- on(valve), off(valve).", 1, 0.35, "both"),
    ("on(valve). off(valve). !:- on(X), off(X) @{b:0.35}.", "?- off(valve).", 1, 0, "true"),
    (VALVE, "?- off(valve), on(valve).", 0.8, 0.6, "both"),
    (VALVE, "?- off(valve), on(valve) @{constraint_applicability:body_truth_only}.", 0.8, 0.7, "both"),
    ("calm(sea) @{b:0.3}. calm(X) :- calm(X).", "?- calm(sea) @{support_aggregation:capped_sum, rule_applicability:body_truth_only}.", 0.3, 0, "true"),
    ("calm(sea) @{b:0.3}. calm(X) :- still(X). still(X) :- calm(X).", "?- still(sea).", 0.3, 0, "true"),
    ("sends(hub, n1) @{b:0.5}. sends(hub, n2) @{b:0.2}. sends(hub, n3) @{b:0.1}.", "?- sends(hub, _).", 0.64, 0, "true"),
    ("", "?- between(7, 7, 7).", 1, 0, "true"),
    ("", "?- between(7, 8, 20).", 0, 0, "neither"),
    ("", "?- add(2, 2, 5).", 0, 0, "neither"),
    ("depot(a). depot(b). road(a, b) @{b:0.25}. road(a, c). stocked(X) :- road(X, Y), depot(Y), depot(X).", "?- stocked(a).", 0.25, 0, "true"),
]


@pytest.mark.parametrize(("program", "query", "b", "d", "status"), CLOSED)
def test_closed(spark, program, query, b, d, status):
    assert (b, d, status) == weights(spark, program, query)


RING = "flows(p,q). flows(q,r). flows(r,s). flows(s,p). down(X,Y) :- flows(X,Y). down(X,Y) :- flows(X,Z), down(Z,Y)."
LINE = "next(1,2). next(2,3). next(3,4). next(4,5). after(X,Y) :- next(X,Y). after(X,Y) :- after(X,Z), next(Z,Y)."
OPEN = [
    (RING, "?- down(X, Y).", 16),
    (RING, "?- down(X, Y) @{support_aggregation:maximum, rule_applicability:body_truth_only}.", 16),
    (LINE, "?- after(X, Y).", 10),
    ("ping(0). ping(X) :- pong(X). pong(X) :- ping(X).", "?- pong(X).", 1),
    ("ship(ark). ship(bark). ship(cog). docked(bark). sailing(X) :- ship(X), not docked(X).", "?- sailing(X).", 2),
    ("tin(a). tin(b). zinc(b). copper(c). alloy(X) :- tin(X). alloy(X) :- zinc(X).", "?- alloy(X).", 2),
    ("owns(ana, x1). owns(ana, x2). owns(bo, x1). owns(cy, x3).", "?- owns(_, x1).", 1),
    ("owns(ana, x1). owns(ana, x2). owns(bo, x1). owns(cy, x3).", "?- owns(P, _).", 3),
    ("owns(ana, x1). owns(ana, x2). owns(bo, x1). owns(cy, x3).", "?- owns(_, _).", 1),
    ("loops(a,a). loops(a,b). loops(c,c).", "?- loops(X, X).", 2),
    ("hue(red). hue(blue). hue(green). shape(disc). shape(cube).", "?- hue(X), shape(Y).", 6),
    ("", "?- eq(X, Y).", 0),
    ("depth(4). depth(9).", "?- depth(X) @{limit:0}.", 0),
    ("depth(4). depth(9).", "?- depth(X) @{offset:2}.", 0),
    ("lamp(desk).", "?- assume(lamp(shelf), lamp(hall)), lamp(X).", 3),
    ('label(box, "fragile").', '?- label(X, "heavy").', 0),
    ("size(2, s). size(2.0, t). size(3, u).", "?- size(2, X).", 2),
    ('tag(red). tag("red"). tag("Red").', "?- tag(X).", 2),
]


@pytest.mark.parametrize(("program", "query", "rows"), OPEN)
def test_open(spark, program, query, rows):
    assert len(ask(spark, program, query)) == rows


VALUES = [
    ("?- add(11, 31, R).", 42),
    ("?- sub(50, R, 8).", 42),
    ("?- mul(R, 6, 42).", 7),
    ("?- div(9, 4, R).", 2.25),
    ("?- div(R, 3, 4).", 12),
    ("?- div(21, R, 3).", 7),
    ("?- add(0.25, 0.75, R).", 1),
    ("?- mul(0.3, 3.0, R).", 0.8999999999999999),
    ('?- add(d"2023-02-27", dur"P3D", R).', date(2023, 3, 2)),
    ('?- sub(d"2023-03-02", d"2023-02-27", R).', timedelta(days=3)),
    ('?- sub(d"2023-03-02", dur"P4D", R).', date(2023, 2, 26)),
    ('?- sub(d"2023-03-02", dur"PT20H", R).', date(2023, 3, 2)),
    ('?- add(d"2023-03-02", dur"-PT20H", R).', date(2023, 3, 1)),
    ('?- add(dur"PT6H", dur"PT30M", R).', timedelta(hours=6, minutes=30)),
    ('?- add(dt"2023-12-31T23:30:00Z", dur"PT45M", R).', datetime(2024, 1, 1, 0, 15, tzinfo=UTC)),
    ('?- sub(dt"2023-05-01T12:00:00Z", dt"2023-05-01T09:15:00Z", R).', timedelta(hours=2, minutes=45)),
    ("?- eq(X, 5), mul(X, X, R), gt(R, X).", 25),
]


@pytest.mark.parametrize(("query", "value"), VALUES)
def test_builtin_values(spark, query, value):
    (found, *_), = ask(spark, "", query)
    assert found["R"] == value and type(found["R"]) is type(value)


NOTHING = ["?- div(8, 0, R).", '?- div(dur"P2D", 2, R).', '?- gt(dt"2023-05-01T00:00:00Z", d"2020-01-01"), eq(R, 1).', '?- sub(d"2023-05-01", 3, R).', '?- geq("b", 2), eq(R, 1).']


@pytest.mark.parametrize("query", NOTHING)
def test_no_row(spark, query):
    assert ask(spark, "", query) == []


def test_mixed_values_sort_by_type_then_value(spark):
    program = 'm(a, "iron"). m(b, 12). m(c, dur"PT3H"). m(d, 0.75). m(e, d"2019-11-05"). m(f, 3). m(g, 8.5). m(h, copper). m(i, dt"2001-01-01T00:00:00").'
    # dates, moments, floats, ints, texts, durations
    assert [r[0]["X"] for r in ask(spark, program, '?- m(X, V) @{order_by:"V"}.')] == ["e", "i", "d", "g", "f", "b", "h", "a", "c"]


def test_type_tests(spark):
    program = 'm(12). m(-3). m(0.75). m(iron). m("iron ore"). m(mine/3). m(d"2019-11-05"). m(dt"2019-11-05T06:00:00"). m(dt"2019-11-05T06:00:00Z"). m(dur"PT3H").'
    count = {t: len(ask(spark, program, f"?- m(X), {t}(X).")) for t in ("int", "float", "string", "entity", "predicate_ref", "date", "datetime", "duration")}
    assert count == {"int": 2, "float": 1, "string": 3, "entity": 3, "predicate_ref": 3, "date": 1, "datetime": 2, "duration": 1}


def test_bitemporal(spark):
    program = """lease(flat) @{et:"2019-03-01T00:00:00Z", vf:"2019-04-01T00:00:00Z", vt:"2020-03-31T00:00:00Z"}.
    lease(shop) @{et:"2019-09-15T00:00:00Z"}. lease(yard) @{et:"2018-01-01T00:00:00Z", vt:"2019-06-30T00:00:00Z"}."""
    assert bindings(spark, program, '?- lease(X) @{query_time:"2019-08-01T00:00:00Z"}') == [(("X", "flat"),)]
    assert bindings(spark, program, '?- lease(X) @{query_time:"2019-08-01T00:00:00Z", known_at:"2019-10-01T00:00:00Z"}') == [(("X", "flat"),), (("X", "shop"),)]
    assert bindings(spark, program, '?- lease(X) @{query_time:"2019-08-01T00:00:00Z", valid_at:"2019-05-01T00:00:00Z"}') == [(("X", "flat"),), (("X", "yard"),)]


def test_focus(spark):
    program = "seen(otter) @{b:0.65}. seen(lynx) @{b:0, d:0.25}. seen(wolf) @{b:0.15, d:0.55}. seen(hare) @{b:0.95, d:0.05}."
    found = {f: [r[0]["X"] for r in ask(spark, program, f"?- seen(X) @{{focus:{f}}}.")] for f in ("support", "disbelief", "contradiction", "ignorance")}
    assert found == {"support": ["hare", "otter", "wolf"], "disbelief": ["wolf", "lynx", "hare"], "contradiction": ["wolf", "hare"], "ignorance": []}


def test_focus_then_order(spark):
    program = "seen(otter, 4) @{b:0.65}. seen(lynx, 1) @{b:0, d:0.25}. seen(wolf, 2) @{b:0.15, d:0.55}. seen(hare, 4) @{b:0.95}."
    assert [r[0]["X"] for r in ask(spark, program, '?- seen(X, N) @{focus:support, order_by:"N"}.')] == ["wolf", "hare", "otter"]


def test_constraints_work_downstream(spark):
    program = "open(north) @{b:0.9}. open(south). !:- open(north) @{b:0.5}. !:- open(south) @{b:0.25}. enter(X) :- open(X) @{b:0.8}."
    found = sorted((r[0]["X"], round(r[1], 9), round(r[2], 9)) for r in ask(spark, program, "?- open(X)."))
    assert found == [("north", 0.9, 0.45), ("south", 1.0, 0.25)]
    found = sorted((r[0]["X"], round(r[1], 9), round(r[2], 9)) for r in ask(spark, program, "?- enter(X)."))
    assert found == [("north", 0.396, 0.0), ("south", 0.6, 0.0)]


def test_type_constraint(spark):
    program = "pred moored/2 [vessel, quay]. vessel(ark). quay(k9). moored(ark, k9) @{b:0.5}. moored(ark, k7) @{b:0.5}."
    assert weights(spark, program, "?- moored(ark, k9).") == (0.5, 0, "true")
    assert weights(spark, program, "?- moored(ark, k7).") == (0.5, 0.5, "both")


def test_aggregation_of_one_predicate(spark):
    program = THREE + "warn(X) :- alarm(X) @{b:0.2}. warn(X) :- alarm(X) @{b:0.3}. act(X) :- evacuate(X), warn(X)."
    kb = KnowledgeBase.parse(program).configure("evacuate", 1, "maximum")
    (_, b, d, status), = Engine(spark).evaluate(kb, "?- act(hall), evacuate(hall).").rows()
    assert (round(b, 9), d, status) == (round(0.4 * (1 - 0.8 * 0.7) * 0.4, 9), 0, "true")
    with pytest.raises(UnsupportedSemantics):
        kb.configure("warn", 1, "average")


def test_tiny_beliefs_are_kept(spark):
    """A chain of six edges at 0.001 gives weights down to 1e-18."""
    program = " ".join(f"edge({i}, {i + 1}) @{{b:0.001}}." for i in range(6)) + " path(X,Y) :- edge(X,Y). path(X,Y) :- edge(X,Z), path(Z,Y)."
    for options in ("support_aggregation:maximum, rule_applicability:body_truth_only", "support_aggregation:maximum"):
        rows = ask(spark, program, f"?- path(X, Y) @{{{options}}}.")
        assert len(rows) == 21 and min(r[1] for r in rows) == pytest.approx(1e-18)


MORE_EDGES = {"tree": "", "dag": "edge(0, 2) @{b:0.5}. edge(1, 4) @{b:0.25}. edge(0, 5) @{b:0.125}. ", "ring": "edge(5, 0) @{b:0.5}. "}
RIGHT, LEFT, DOUBLE = (f"path(X,Y) :- {body} @{{b:0.9}}." for body in ("edge(X,Z), path(Z,Y)", "path(X,Z), edge(Z,Y)", "path(X,Z), path(Z,Y)"))
GROWS = "rule_applicability:body_truth_only, support_aggregation:maximum"
DELTAS = [("tree", RIGHT, ""), ("tree", LEFT, "max_depth:3"), ("dag", RIGHT, ""), ("dag", DOUBLE, ""), ("dag", LEFT, "support_aggregation:capped_sum"), ("dag", DOUBLE, GROWS), ("ring", LEFT, GROWS), ("ring", RIGHT, "")]


@pytest.mark.parametrize(("edges", "rule", "options"), DELTAS)
def test_delta_rounds_give_what_full_rounds_give(spark, monkeypatch, edges, rule, options):
    program = " ".join(f"edge({i}, {i + 1}) @{{b:0.8, d:0.1}}." for i in range(5)) + MORE_EDGES[edges] + "path(X,Y) :- edge(X,Y)." + rule
    query = f"?- path(X, Y) @{{{options}}}." if options else "?- path(X, Y)."
    flat = lambda rows: sorted((r[0]["X"], r[0]["Y"], round(r[1], 9), round(r[2], 9)) for r in rows)
    got = flat(ask(spark, program, query))
    monkeypatch.setattr(Evaluator, "_delta_rounds", lambda self, component, state, grows: (None, 0, state))
    assert got == flat(ask(spark, program, query)) and got


def test_unique_answers_are_not_grouped(spark):
    table = spark.range(20).selectExpr("id as a", "id % 3 as c")
    kb = KnowledgeBase.parse("both(X, Y) :- t(X, Z), t(Y, Z), lt(X, Y).").bind("t", table, ["a", "c"], distinct=True)
    plan = lambda q: Engine(spark).evaluate(kb, q).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan("?- t(7, C).") and "Aggregate" not in plan("?- t(X, C), t(Y, C).")
    assert "Aggregate" in plan("?- t(_, C).") and "Aggregate" in plan("?- both(X, Y).")
    assert len(Engine(spark).evaluate(kb, "?- t(_, C).").rows()) == 3


def test_order_limit_offset(spark):
    program = "score(ana, 31). score(bo, 17). score(cy, 17). score(di, 25). score(ed, 8)."
    assert [r[0]["X"] for r in ask(spark, program, '?- score(X, V) @{order_by:"V, X", offset:1, limit:3}.')] == ["bo", "cy", "di"]


def test_unsafe_programs(spark):
    with pytest.raises(UnsafeProgram):
        ask(spark, "town(bern). route(X, Y) :- town(X).", "?- route(X, Y).")
    with pytest.raises(UnsafeProgram):
        ask(spark, "town(bern). dry(X) :- town(X), not wet(X). wet(X) :- town(X), not dry(X).", "?- dry(X).")
    with pytest.raises(UnsupportedSemantics):
        syntax.query("?- p(X) @{body_truth:average}.")


def test_explain(spark):
    found = Engine(spark).evaluate(KnowledgeBase.parse("smoke(attic) @{b:0.5}. smoke(cellar) @{b:0.25, d:0.5}. fire(X) :- smoke(X) @{b:0.4}."), "?- fire(X) @{explain:true}.").events
    show = lambda v: v if v is None else round(v, 9)
    rows = sorted(((r.event, r.pred, *r.args, show(r.body_b), show(r.applies), show(r.b)) for r in found.collect()), key=str)
    assert rows == [
        ("fact_support", "smoke/1", "s:attic", None, None, 0.5), ("fact_support", "smoke/1", "s:cellar", None, None, 0.25),
        ("rule_applicability", "fire/1", "s:attic", 0.5, 0.5, None), ("rule_applicability", "fire/1", "s:cellar", 0.25, 0.125, None),
        ("rule_support", "fire/1", "s:attic", 0.5, 0.5, 0.2), ("rule_support", "fire/1", "s:cellar", 0.25, 0.125, 0.05),
    ]


def test_goal_and_rule_order_do_not_matter(spark):
    facts = "feeds(a,b) @{b:0.4}. feeds(b,c) @{b:0.35}. clean(c). clean(b) @{d:0.6}."
    one = ask(spark, facts + "safe(X) :- feeds(X, Y), clean(Y). safe(X) :- clean(X).", "?- safe(X), feeds(X, Y).")
    two = ask(spark, facts + "safe(X) :- clean(X). safe(X) :- clean(Y), feeds(X, Y).", "?- feeds(X, Y), safe(X).")
    flat = lambda rows: sorted((sorted(r[0].items()), round(r[1], 12), round(r[2], 12)) for r in rows)
    assert flat(one) == flat(two) and len(one) == 2


@pytest.mark.parametrize("goal,holds", [("lt(P, Q)", lambda p, q: p < q), ("leq(P, Q)", lambda p, q: p <= q), ("gt(P, Q)", lambda p, q: p > q), ("geq(Q, P)", lambda p, q: q >= p), ("lt(P, Q), gt(Q, 4)", lambda p, q: p < q > 4)])
def test_large_groups_of_ordered_pairs_are_split(spark, monkeypatch, goal, holds):
    """A predicate joined with itself, in order: each pair once, however its groups are cut."""
    from credence.operators import body

    rows = [(k, "a" if k % 4 else "b") for k in range(-9, 30)] + [(k, "c") for k in range(3)] + [(5, "c"), (None, "a"), (7, None)]
    kb = KnowledgeBase().bind("m", spark.createDataFrame(rows, "k long, x string"), ["k", "x"], distinct=True)
    want = sorted((p, x, q) for p, x in rows for q, y in rows if None not in (p, q, x) and x == y and holds(p, q))
    for most in (10_000, 3, 1):
        monkeypatch.setattr(body, "SPLIT_ROWS", most)
        df = Engine(spark).evaluate(kb, f"?- m(P, X), m(Q, X), {goal}.").df
        assert sorted((r.P, r.X, r.Q) for r in df.collect()) == want
        assert ("Generate explode" in df._jdf.queryExecution().executedPlan().toString()) == (most < 100)


def test_split_groups_are_joined_as_lists(spark, monkeypatch):
    """Rows of a group's range are one list on the joined side, with all their columns, weights that differ too; keys that grouping would change stay rows."""
    from credence.operators import body

    monkeypatch.setattr(body, "SPLIT_ROWS", 3)
    rows = [(k, x, f"w{k}", 0.5 + (k % 3) / 10, 0.1) for k in range(14) for x in ("a", "b")] + [(3, None, "w", 0.5, 0.1), (None, "a", "w", 0.5, 0.1), (4, "c", "w", 0.0, 0.0)]
    tables = [("string", rows)] + [("double", [(k, None if x is None else -0.0 if x == "a" else 0.0, *r) for k, x, *r in rows])]
    for kind, held in tables:
        for weights in ({}, {"b": "b", "d": "d"}):
            kb = KnowledgeBase().bind("m", spark.createDataFrame(held, f"k long, x {kind}, w string, b double, d double"), ["k", "x", "w"], distinct=True, **weights)
            df = Engine(spark).evaluate(kb, "?- m(P, X, V), m(Q, X, W), lt(P, Q).").df
            weight = lambda p, q: (p[3] * q[3], 1 - (1 - p[4]) * (1 - q[4])) if weights else (1.0, 0.0)  # noqa: B023, E731
            facts = [r for r in held if None not in r and (r[3] or not weights)]
            want = sorted((p[0], p[2], q[0], q[2], *map(lambda v: round(v, 9), weight(p, q))) for p in facts for q in facts if p[1] == q[1] and p[0] < q[0])
            got = sorted((r.P, r.V, r.Q, r.W, round(r.b, 9), round(r.d, 9)) for r in df.collect())
            assert got == want
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert ("collect_list" in plan) == (kind == "string")
            assert "BroadcastHashJoin" not in plan
