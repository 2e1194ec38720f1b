"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.engine import Engine
from credence.sources.kb import KnowledgeBase

FOREVER = "query_time:\"2030-01-01T00:00:00Z\""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Predicates bound to tables: name -> (table, arguments, options).
def _bindings() -> dict[str, tuple[str, list, dict]]:
    c = F.col
    return {
        "order": ("orders", ["o_orderkey", "o_custkey", "o_totalprice"], {"distinct": True}),
        "orderdate": ("orders", ["o_orderkey", "o_orderdate"], {"distinct": True}),
        "status": ("orders", ["o_orderkey", "o_orderstatus"], {"distinct": True}),
        "open_order": ("orders", ["o_orderkey"], {"distinct": True, "vf": c("o_orderdate"), "vt": c("o_orderdate") + F.expr("INTERVAL '90' DAY")}),
        "customer": ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"], {"distinct": True}),
        "balance": ("customer", ["c_custkey", "c_acctbal"], {"distinct": True}),
        "supplier": ("supplier", ["s_suppkey", "s_nationkey"], {"distinct": True}),
        "nation": ("nation", ["n_nationkey", "n_regionkey", "n_name"], {"distinct": True}),
        "region": ("region", ["r_regionkey", "r_name"], {"distinct": True}),
        "part": ("part", ["p_partkey", "p_size", "p_retailprice"], {"distinct": True}),
        "brand": ("part", ["p_partkey", "p_brand"], {"distinct": True}),
        "item": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"], {"b": 1 - c("l_discount"), "d": c("l_tax")}),
        "shipped": ("lineitem", ["l_orderkey", "l_shipdate"], {"b": 1 - c("l_discount"), "d": c("l_tax")}),
        "flag": ("lineitem", ["l_returnflag", "l_linestatus"], {"b": c("l_discount") / 1000, "d": c("l_tax") / 1000}),
        "pair": ("lineitem", ["l_linenumber", "l_quantity"], {"b": c("l_discount") / 100, "d": c("l_tax") / 100}),
        "good_doc": ("labels", ["doc_id"], {"b": c("quality"), "d": c("toxic")}),
        "doc": ("documents", ["doc_id", "lang", "source"], {"distinct": True}),
        "event": ("events", ["event_id", "user_id", "event_type"], {"distinct": True, "et": c("ts")}),
        "boss": ("customer", ["c_custkey", F.floor(c("c_custkey") / 2)], {"distinct": True, "b": 0.9 + (c("c_custkey") % 10) / 100}),
    }


@dataclass(frozen=True)
class Case:
    query: str
    sql: str | None
    program: str = ""
    uses: str = ""


def _status(b: str, d: str) -> str:
    return f"CASE WHEN {b} > 1e-12 AND {d} > 1e-12 THEN 'both' WHEN {b} > 1e-12 THEN 'true' WHEN {d} > 1e-12 THEN 'false' ELSE 'neither' END"


def _sql(columns: str, inner: str, tail: str = "") -> str:
    """Answers of a relation with b and d; ``columns`` may be empty."""
    lead = f"{columns}, " if columns else ""
    return f"SELECT {lead}round(b::DOUBLE, 6) AS b, round(d::DOUBLE, 6) AS d, {_status('b', 'd')} AS status FROM ({inner}) {tail}"


def _or(c: str) -> str:
    return f"(1 - product(1 - ({c})))"


_ITEMS = f"(SELECT l_orderkey, l_partkey, l_suppkey, {_or('(1 - l_discount)')} AS b, {_or('l_tax')} AS d FROM lineitem GROUP BY ALL)"
_SHIPS = f"(SELECT l_orderkey, l_shipdate, {_or('(1 - l_discount)')} AS b, {_or('l_tax')} AS d FROM lineitem GROUP BY ALL)"
_LABELS = f"(SELECT doc_id, {_or('quality::DOUBLE')} AS b, {_or('toxic::DOUBLE')} AS d FROM labels GROUP BY doc_id HAVING b > 0 OR d > 0)"
_BOSS = "(SELECT c_custkey AS x, floor(c_custkey / 2)::BIGINT AS y, 0.9 + (c_custkey % 10) / 100 AS b FROM customer)"
_PAIRS = "(SELECT l_linenumber, l_quantity, {b} AS b, {d} AS d FROM lineitem GROUP BY ALL)"


def _pairs(b: str, d: str) -> str:
    return _PAIRS.format(b=b.format("l_discount / 100"), d=d.format("l_tax / 100"))


_CLOSURE = "path(X, Y) :- boss(X, Y), geq(Y, 1). path(X, Y) :- boss(X, Z), path(Z, Y), geq(Z, 1)."
_CLOSURE_SQL = f"""WITH RECURSIVE e AS (SELECT * FROM {_BOSS} WHERE y >= 1),
p AS (SELECT x, y, b, 1 AS n FROM e UNION ALL SELECT e.x, p.y, e.b * p.b, n + 1 FROM e JOIN p ON e.y = p.x)
SELECT x AS "X", y AS "Y", round(b, 6) AS b, 0.0::DOUBLE AS d, 'true' AS status FROM p"""

CASES: dict[str, Case] = {
    "risky_customers": Case("?- risky(C)", _sql('"C"', f'SELECT o_custkey AS "C", {_or("0.9")} AS b, {_or("0.05")} AS d FROM orders WHERE o_totalprice > 300000 GROUP BY 1'), "risky(C) :- order(O, C, P), gt(P, 300000) @{b:0.9, d:0.05}.", "order"),
    # scans and bindings
    "fact_scan": Case("?- order(O, C, P)", 'SELECT o_orderkey AS "O", o_custkey AS "C", o_totalprice AS "P", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM orders', uses="order"),
    "constant_argument": Case('?- customer(C, N, "BUILDING")', 'SELECT c_custkey AS "C", c_nationkey::BIGINT AS "N", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM customer WHERE c_mktsegment = \'BUILDING\'', uses="customer"),
    "repeated_var": Case("?- pair(X, X)", _sql('"X"', f'SELECT l_linenumber::BIGINT AS "X", b, d FROM {_pairs(_or("{}"), _or("{}"))} WHERE l_linenumber = l_quantity AND (b > 0 OR d > 0)'), uses="pair"),
    "point_lookup": Case("?- order(7, C, P)", 'SELECT o_custkey AS "C", o_totalprice AS "P", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM orders WHERE o_orderkey = 7', uses="order"),
    "non_null_evidence": Case("?- good_doc(X)", _sql('"X"', f'SELECT doc_id AS "X", b, d FROM {_LABELS}'), uses="good_doc"),
    "anon_projection": Case("?- item(O, _, _)", _sql('"O"', f'SELECT l_orderkey AS "O", {_or("b")} AS b, {_or("d")} AS d FROM {_ITEMS} GROUP BY 1'), uses="item"),
    "visible_known_at": Case('?- event(E, U, T) @{query_time:"2024-01-10T12:00:00Z"}', 'SELECT event_id AS "E", user_id AS "U", event_type AS "T", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM events WHERE ts <= TIMESTAMP \'2024-01-10 12:00:00\'', uses="event"),
    "visible_valid_window": Case('?- open_order(O) @{query_time:"1998-03-15T00:00:00Z"}', "SELECT o_orderkey AS \"O\", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM orders WHERE TIMESTAMP '1998-03-15' BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY", uses="open_order"),
    # joins
    "conj_product": Case("?- item(O, P, S), supplier(S, N)", _sql('"O", "P", "S", "N"', f'SELECT l_orderkey AS "O", l_partkey AS "P", l_suppkey AS "S", s_nationkey::BIGINT AS "N", b, d FROM {_ITEMS} JOIN supplier ON l_suppkey = s_suppkey'), uses="item supplier"),
    "conj_minimum": Case("?- item(O, P, _), shipped(O, T) @{body_truth:minimum}", _sql('"O", "P", "T"', f'SELECT i.l_orderkey AS "O", l_partkey AS "P", l_shipdate AS "T", {_or("least(i.b, s.b)")} AS b, {_or("1 - (1 - i.d) * (1 - s.d)")} AS d FROM {_ITEMS} i JOIN {_SHIPS} s ON i.l_orderkey = s.l_orderkey GROUP BY 1, 2, 3'), uses="item shipped"),
    "falsity_noisy_or": Case("?- flag(R, S), flag(R, T)", _sql('"R", "S", "T"', f'WITH f AS (SELECT l_returnflag AS r, l_linestatus AS s, {_or("l_discount / 1000")} AS b, {_or("l_tax / 1000")} AS d FROM lineitem GROUP BY ALL) SELECT f.r AS "R", f.s AS "S", g.s AS "T", f.b * g.b AS b, 1 - (1 - f.d) * (1 - g.d) AS d FROM f JOIN f g ON f.r = g.r'), uses="flag"),
    "falsity_max": Case("?- flag(R, S), flag(R, T) @{body_falsity:maximum}", _sql('"R", "S", "T"', f'WITH f AS (SELECT l_returnflag AS r, l_linestatus AS s, {_or("l_discount / 1000")} AS b, {_or("l_tax / 1000")} AS d FROM lineitem GROUP BY ALL) SELECT f.r AS "R", f.s AS "S", g.s AS "T", f.b * g.b AS b, greatest(f.d, g.d) AS d FROM f JOIN f g ON f.r = g.r'), uses="flag"),
    "cross_product": Case("?- region(A, N), region(C, M)", 'SELECT a.r_regionkey::BIGINT AS "A", a.r_name AS "N", c.r_regionkey::BIGINT AS "C", c.r_name AS "M", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM region a, region c', uses="region"),
    "self_join": Case("?- brand(P, X), brand(Q, X), lt(P, Q)", 'SELECT a.p_partkey AS "P", a.p_brand AS "X", b.p_partkey AS "Q", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey', uses="brand"),
    "theta_join": Case("?- nation(N, R, X), nation(M, R, Y), gt(M, N)", 'SELECT a.n_nationkey::BIGINT AS "N", a.n_regionkey::BIGINT AS "R", a.n_name AS "X", b.n_nationkey::BIGINT AS "M", b.n_name AS "Y", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey', uses="nation"),
    "star_join": Case("?- from(O, X)", _sql('"O", "X"', 'SELECT o_orderkey AS "O", r_name AS "X", 1.0 AS b, 0.0 AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey'), "from(O, X) :- order(O, C, _), customer(C, N, _), nation(N, R, _), region(R, X).", "order customer nation region"),
    "naf": Case("?- customer(C, N, S), not order(_, C, _)", 'SELECT c_custkey AS "C", c_nationkey::BIGINT AS "N", c_mktsegment AS "S", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)', uses="customer order"),
    "naf_exists": Case("?- region(R, X), not nation(_, R, _)", 'SELECT r_regionkey::BIGINT AS "R", r_name AS "X", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)', uses="region nation"),
    "naf_disbelief_only": Case("?- doc(X, L, _), not good_doc(X)", f'SELECT doc_id AS "X", lang AS "L", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM (SELECT DISTINCT doc_id, lang FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM {_LABELS} WHERE b > 0)', uses="doc good_doc"),
    "naf_filtered": Case("?- customer(C, N, S), not rich(C)", 'SELECT c_custkey AS "C", c_nationkey::BIGINT AS "N", c_mktsegment AS "S", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM customer WHERE NOT c_acctbal > 4000', "rich(C) :- balance(C, X), gt(X, 4000).", "customer balance"),
    "naf_unbound": Case("?- nation(N, R, X), not spends(_, N)", 'SELECT n_nationkey::BIGINT AS "N", n_regionkey::BIGINT AS "R", n_name AS "X", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 499000)', "spends(C, N) :- order(_, C, P), gt(P, 499000), customer(C, N, _).", "nation order customer"),
    # aggregation of support
    "support_noisy_or": Case("?- pair(N, Q)", _sql('"N", "Q"', f'SELECT l_linenumber::BIGINT AS "N", l_quantity AS "Q", b, d FROM {_pairs(_or("{}"), _or("{}"))} WHERE b > 0 OR d > 0'), uses="pair"),
    "support_max": Case("?- pair(N, Q) @{support_aggregation:maximum}", _sql('"N", "Q"', f'SELECT l_linenumber::BIGINT AS "N", l_quantity AS "Q", b, d FROM {_pairs("max({})", "max({})")} WHERE b > 0 OR d > 0'), uses="pair"),
    "support_capped": Case("?- pair(N, Q) @{support_aggregation:capped_sum}", _sql('"N", "Q"', f'SELECT l_linenumber::BIGINT AS "N", l_quantity AS "Q", b, d FROM {_pairs("least(1.0, sum({}))", "least(1.0, sum({}))")} WHERE b > 0 OR d > 0'), uses="pair"),
    # rules
    "rule_weights": Case("?- used(P)", _sql('"P"', f'SELECT l_partkey AS "P", {_or("b * (1 - d) * 0.6")} AS b, {_or("b * (1 - d) * 0.2")} AS d FROM {_ITEMS} GROUP BY 1'), "used(P) :- item(_, P, _) @{b:0.6, d:0.2}.", "item"),
    "rule_truth_only": Case("?- used(P) @{rule_applicability:body_truth_only}", _sql('"P"', f'SELECT l_partkey AS "P", {_or("b * 0.6")} AS b, {_or("b * 0.2")} AS d FROM {_ITEMS} GROUP BY 1'), "used(P) :- item(_, P, _) @{b:0.6, d:0.2}.", "item"),
    "multi_rule_union": Case("?- watch(C)", _sql('"C"', f"""SELECT c AS "C", {_or('b')} AS b, 0.0 AS d FROM (SELECT c_custkey AS c, 0.4 AS b FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 0.5 FROM customer WHERE c_acctbal < 0) GROUP BY 1"""), 'watch(C) :- customer(C, _, "BUILDING") @{b:0.4}. watch(C) :- balance(C, X), lt(X, 0) @{b:0.5}.', "customer balance"),
    "head_constant": Case("?- tier(C, T, Y)", "SELECT c_custkey AS \"C\", 'gold' AS \"T\", 2024::BIGINT AS \"Y\", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM customer WHERE c_acctbal > 9000", "tier(C, gold, 2024) :- balance(C, X), gt(X, 9000).", "balance"),
    "derived_chain": Case("?- rich_region(X)", _sql('"X"', f'SELECT r_name AS "X", {_or("v")} AS b, 0.0 AS d FROM (SELECT n_regionkey, n_nationkey, {_or("0.02")} * 0.5 AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1, 2) JOIN region ON n_regionkey = r_regionkey GROUP BY 1'), "rich_nation(N) :- balance(C, X), gt(X, 9000), customer(C, N, _) @{b:0.02}. rich_region(X) :- rich_nation(N), nation(N, R, _), region(R, X) @{b:0.5}.", "balance customer nation region"),
    # builtins
    "cmp_ops": Case("?- part(P, S, X), geq(S, 10), leq(S, 20), ne(S, 15), lt(X, 1500.5)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", p_retailprice AS "X", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size <> 15 AND p_retailprice < 1500.5', uses="part"),
    "between": Case("?- part(P, S, _), between(S, 5, 9)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part WHERE p_size BETWEEN 5 AND 9', uses="part"),
    "arith_forward": Case("?- part(P, S, _), mul(S, 3, X), sub(X, 1, Y), add(Y, 0.5, Z)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", (p_size * 3)::DOUBLE AS "X", (p_size * 3 - 1)::DOUBLE AS "Y", p_size * 3 - 0.5::DOUBLE AS "Z", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part', uses="part"),
    "arith_inverse": Case("?- part(P, S, _), add(X, 7, S), mul(2, Y, S)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", (p_size - 7)::DOUBLE AS "X", p_size / 2.0::DOUBLE AS "Y", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part', uses="part"),
    "div_guard": Case("?- part(P, S, _), sub(S, 10, X), div(100, X, Y)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", (p_size - 10)::DOUBLE AS "X", 100 / (p_size - 10)::DOUBLE AS "Y", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part WHERE p_size <> 10', uses="part"),
    "eq_bind": Case("?- part(P, S, _), eq(X, S), gt(X, 40)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", p_size::BIGINT AS "X", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part WHERE p_size > 40', uses="part"),
    "type_checks": Case("?- part(P, S, X), int(S), float(X), brand(P, T), string(T), entity(T)", 'SELECT p_partkey AS "P", p_size::BIGINT AS "S", p_retailprice AS "X", p_brand AS "T", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM part', uses="part brand"),
    "type_rejects": Case(
        "?- kind(O, K)",
        """SELECT o_orderkey AS "O", unnest(['moment', 'length', 'real', 'text', 'ref']) AS "K", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM orders WHERE o_orderkey < 2000
        UNION ALL SELECT o_orderkey, unnest(['whole', 'day']), 1.0, 0.0, 'true' FROM orders WHERE o_orderkey < 2000 AND o_custkey % 2 = 0""",
        """few(O) :- order(O, _, _), lt(O, 2000). even(C) :- customer(C, _, _), mul(2, H, C), int(H).
        v(O, T) :- few(O), orderdate(O, T). v(O, D) :- few(O), orderdate(O, T), sub(T, dt"1990-01-01T00:00:00", D). v(O, P) :- few(O), order(O, _, P). v(O, S) :- few(O), status(O, S).
        v(O, C) :- few(O), order(O, C, _), even(C). v(O, d"2020-02-29") :- few(O), order(O, C, _), even(C).
        kind(O, moment) :- v(O, X), datetime(X). kind(O, length) :- v(O, X), duration(X). kind(O, real) :- v(O, X), float(X). kind(O, text) :- v(O, X), string(X).
        kind(O, ref) :- v(O, X), predicate_ref(X). kind(O, whole) :- v(O, X), int(X). kind(O, day) :- v(O, X), date(X).""",
        "order orderdate status customer",
    ),
    "temporal_add": Case('?- orderdate(O, T), add(T, dur"P30D", U)', 'SELECT o_orderkey AS "O", o_orderdate AS "T", o_orderdate + INTERVAL 30 DAY AS "U", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM orders', uses="orderdate"),
    "temporal_cmp": Case('?- orderdate(O, T), lt(T, dt"1996-01-01T00:00:00")', 'SELECT o_orderkey AS "O", o_orderdate AS "T", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM orders WHERE o_orderdate < TIMESTAMP \'1996-01-01\'', uses="orderdate"),
    "temporal_diff": Case('?- slow(O)', _sql('"O"', f"SELECT l_orderkey AS \"O\", {_or('b * (1 - d)')} AS b, 0.0 AS d FROM {_SHIPS} JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate - o_orderdate > INTERVAL 100 DAY GROUP BY 1"), 'slow(O) :- shipped(O, T), orderdate(O, U), sub(T, U, V), gt(V, dur"P100D").', "shipped orderdate"),
    # answers
    "closed_true": Case('?- region(_, "ASIA")', "SELECT 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status", uses="region"),
    "closed_neither": Case('?- region(_, "ATLANTIS")', "SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'neither' AS status", uses="region"),
    "belnap_status": Case("?- good_doc(X), doc(X, L, _)", _sql('"X", "L"', f'SELECT l.doc_id AS "X", lang AS "L", b, d FROM {_LABELS} l JOIN documents USING (doc_id)'), uses="good_doc doc"),
    "focus_support": Case("?- good_doc(X) @{focus:support}", _sql('"X"', f'SELECT doc_id AS "X", b, d FROM {_LABELS} WHERE b > 1e-12'), uses="good_doc"),
    "focus_disbelief": Case("?- good_doc(X) @{focus:disbelief}", _sql('"X"', f'SELECT doc_id AS "X", b, d FROM {_LABELS} WHERE d > 1e-12'), uses="good_doc"),
    "focus_contradiction": Case("?- good_doc(X) @{focus:contradiction}", _sql('"X"', f'SELECT doc_id AS "X", b, d FROM {_LABELS} WHERE least(b, d) > 1e-12'), uses="good_doc"),
    "focus_ignorance": Case('?- region(_, "ATLANTIS") @{focus:ignorance}', "SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'neither' AS status", uses="region"),
    "order_limit_offset": Case('?- order(O, C, P) @{order_by:"C, O", offset:5, limit:20}', 'SELECT o_orderkey AS "O", o_custkey AS "C", o_totalprice AS "P", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20 OFFSET 5', uses="order"),
    "assume": Case("?- assume(nation(99, 0, utopia)), nation(N, 0, X)", 'SELECT n_nationkey::BIGINT AS "N", n_name AS "X", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, \'true\' AS status FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 99, \'utopia\', 1.0, 0.0, \'true\'', uses="nation"),
    # recursion
    "reach_max": Case("?- path(X, Y) @{support_aggregation:maximum, rule_applicability:body_truth_only}", _CLOSURE_SQL, _CLOSURE, "boss"),
    "reach_noisy": Case("?- path(X, Y)", _CLOSURE_SQL, _CLOSURE, "boss"),
    "reach_depth_capped": Case("?- path(X, Y) @{max_depth:3}", _CLOSURE_SQL + " WHERE n <= 3", _CLOSURE, "boss"),
    "mutual_recursion": Case("?- even(X) @{support_aggregation:maximum, rule_applicability:body_truth_only}", "WITH RECURSIVE p AS (SELECT 1::BIGINT AS x, 0 AS n UNION ALL SELECT c_custkey, n + 1 FROM customer JOIN p ON floor(c_custkey / 2)::BIGINT = p.x WHERE c_custkey > 1) SELECT x AS \"X\", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM p WHERE n % 2 = 0", "even(1). even(X) :- up(X, Y), odd(Y). odd(X) :- up(X, Y), even(Y). up(X, Y) :- customer(X, _, _), mul(2, Z, X), int(Z), eq(Y, Z). up(X, Y) :- customer(X, _, _), sub(X, 1, W), mul(2, Y, W), int(Y), gt(Y, 0).", "customer"),
    "cycle_no_reinforce": Case("?- linked(R, S)", _sql('"R", "S"', f"SELECT r_regionkey::BIGINT AS \"R\", ((r_regionkey + 1) % 5)::BIGINT AS \"S\", 0.2 AS b, 0.0 AS d FROM region"), "linked(0, 1) @{b:0.2}. linked(1, 2) @{b:0.2}. linked(2, 3) @{b:0.2}. linked(3, 4) @{b:0.2}. linked(4, 0) @{b:0.2}. linked(X, Y) :- linked(X, Y), region(X, _).", "region"),
    "reach_from": Case("?- path(777, Y)", f"{_CLOSURE_SQL} WHERE x = 777".replace('x AS "X", ', ""), _CLOSURE, "boss"),
    "reach_to": Case("?- path(X, 5)", f"{_CLOSURE_SQL} WHERE y = 5".replace(', y AS "Y"', ""), _CLOSURE, "boss"),
    # a pair has several paths, some longer than others, so weights found in one round change in a later one
    "reach_two_ways": Case(
        "?- path(X, Y)",
        """WITH l AS (
  SELECT c_custkey + 1000.0 AS x, c_nationkey + 100.0 AS y, 0.9 AS b FROM customer
  UNION ALL SELECT c_custkey + 1000.0, s.k, 0.8 FROM customer JOIN (VALUES ('BUILDING', 201.0), ('MACHINERY', 202.0)) s(m, k) ON c_mktsegment = s.m
  UNION ALL SELECT n_nationkey + 100.0, n_regionkey, 0.7 FROM nation UNION ALL SELECT r_regionkey, 300.0, 0.6 FROM region
  UNION ALL VALUES (201.0, 2.0, 0.5), (201.0, 300.0, 0.4), (202.0, 3.0, 0.3)
), p1 AS (SELECT x, y, b FROM l WHERE x < 100
), p2 AS (SELECT x, y, 1 - product(1 - b) AS b FROM (
  SELECT x, y, b FROM l WHERE x BETWEEN 100 AND 999 UNION ALL SELECT l.x, p1.y, l.b * p1.b * 0.9 FROM l JOIN p1 ON l.y = p1.x WHERE l.x BETWEEN 100 AND 999) GROUP BY x, y
), p3 AS (SELECT x, y, 1 - product(1 - b) AS b FROM (
  SELECT x, y, b FROM l WHERE x >= 1000 UNION ALL SELECT l.x, p2.y, l.b * p2.b * 0.9 FROM l JOIN p2 ON l.y = p2.x WHERE l.x >= 1000) GROUP BY x, y
) SELECT x::DOUBLE AS "X", y::DOUBLE AS "Y", round(b, 6)::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)""",
        """link(X, Y) :- customer(C, N, _), add(C, 1000, X), add(N, 100, Y) @{b:0.9}. link(X, Y) :- customer(C, _, S), segment(S, Y), add(C, 1000, X) @{b:0.8}.
        link(X, R) :- nation(N, R, _), add(N, 100, X) @{b:0.7}. link(R, 300) :- region(R, _) @{b:0.6}. link(201, 2) @{b:0.5}. link(201, 300) @{b:0.4}. link(202, 3) @{b:0.3}.
        segment("BUILDING", 201). segment("MACHINERY", 202). path(X, Y) :- link(X, Y). path(X, Y) :- link(X, Z), path(Z, Y) @{b:0.9}.""",
        "customer nation region",
    ),
    # constraints
    "constraint_truth_only": Case("?- good_doc(X), doc(X, L, _) @{constraint_applicability:body_truth_only}", _sql('"X", "L"', f"SELECT l.doc_id AS \"X\", lang AS \"L\", b, CASE WHEN lang = 'en' AND b > 0 THEN 1 - (1 - d) * (1 - b * 0.7) ELSE d END AS d FROM {_LABELS} l JOIN documents USING (doc_id)"), '!:- good_doc(X), doc(X, "en", _) @{b:0.7}.', "good_doc doc"),
    "constraint_query": Case("?- good_doc(X), doc(X, L, _)", _sql('"X", "L"', f"SELECT l.doc_id AS \"X\", lang AS \"L\", b, CASE WHEN lang = 'en' AND b > 0 THEN 1 - (1 - d) * (1 - b * (1 - d) * 0.7) ELSE d END AS d FROM {_LABELS} l JOIN documents USING (doc_id)"), '!:- good_doc(X), doc(X, "en", _) @{b:0.7}.', "good_doc doc"),
    "constraint_downstream": Case("?- keep(X)", _sql('"X"', f"SELECT l.doc_id AS \"X\", b * (1 - CASE WHEN lang = 'en' THEN 1 - (1 - d) * (1 - b * (1 - d) * 0.7) ELSE d END) AS b, 0.0 AS d FROM {_LABELS} l JOIN documents USING (doc_id) WHERE b > 0 AND d < 1"), '!:- good_doc(X), doc(X, "en", _) @{b:0.7}. keep(X) :- good_doc(X), doc(X, _, _).', "good_doc doc"),
    "constraint_footprint_miss": Case("?- good_doc(X)", _sql('"X"', f'SELECT doc_id AS "X", b, d FROM {_LABELS}'), '!:- good_doc(X), doc(X, "en", _) @{b:0.7}.', "good_doc doc"),
    "type_constraint": Case("?- sells(N, S)", _sql('"N", "S"', 'SELECT s_nationkey::BIGINT AS "N", s_suppkey AS "S", 1.0 AS b, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 0.0 ELSE 1.0 END AS d FROM supplier'), "pred sells/2 [western, entity]. western(N) :- nation(N, 1, _). sells(N, S) :- supplier(S, N).", "supplier nation"),
}


def knowledge(spark: SparkSession, sf_dir: str, program: str, uses: str) -> KnowledgeBase:
    kb = KnowledgeBase.parse(program)
    known = _bindings()
    for name in uses.split():
        table, args, options = known[name]
        kb.bind(name, _table(spark, sf_dir, table), args, **options)
    return kb


def _run(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = case.query if "query_time" in case.query else case.query[:-1] + f", {FOREVER}}}" if case.query.endswith("}") else f"{case.query} @{{{FOREVER}}}"
        df = Engine(spark).evaluate(knowledge(spark, sf_dir, case.program, case.uses), query).df
        return df.withColumn("b", F.round("b", 6)).withColumn("d", F.round("d", 6))

    return run


# Knowledge-base operations and the event log.
def _merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KnowledgeBase.parse('tag(x, 1) @{et:"2024-01-01T00:00:00Z"}. tag(y, 2) @{b:0.5, et:"2024-01-01T00:00:00Z"}.')
    kb = kb.merge(KnowledgeBase.parse('tag(y, 2) @{b:0.5, et:"2024-01-01T00:00:00Z"}. tag(z, 3) @{et:"2024-01-01T00:00:00Z"}. tag(x, 1) @{b:0.5, et:"2025-01-01T00:00:00Z"}.'))
    return Engine(spark).evaluate(kb, "?- tag(N, I)").df


def _unload_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = knowledge(spark, sf_dir, "seen(R) :- nation(_, R, _). seen(R) :- region(R, _).", "nation region")
    return Engine(spark).evaluate(kb.unload_predicate("nation", 3)[0], "?- seen(R)").df


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = knowledge(spark, sf_dir, "city(Paris_x) :- region(Paris_x, _). city(parma). town(lyon).", "region")
    return spark.createDataFrame([(kind, len(found)) for kind, found in sorted(kb.search("PAR").items())], "kind string, n long")


def _log(spark: SparkSession, sf_dir: str):
    """A log of all orders as facts, of which those of every seventh key are retracted; and another branch."""
    from credence.sources.log import EventLog
    from credence.sources.shared import fresh_path
    from credence.streaming.ingest import as_assertions

    log = EventLog(spark, fresh_path(spark, "log"))
    orders = _table(spark, sf_dir, "orders")
    first = log.append(as_assertions(orders, "main", "placed", ["o_orderkey", "o_custkey"], et="o_orderdate"))
    nations = _table(spark, sf_dir, "nation")
    log.append(as_assertions(nations, "other", "nation", ["n_nationkey"]))
    live = log.facts("main").withColumn("key", F.get_json_object("payload", "$.atom.args[0].value").cast("long"))
    log.append(live.filter("key % 7 = 0").select("branch", F.lit("retract").alias("kind"), F.col("event_id").alias("target_event_id")))
    return log, first


def _placed(df: DataFrame) -> DataFrame:
    return df.select(*[F.get_json_object("payload", f"$.atom.args[{i}].value").cast("long").alias(c) for i, c in enumerate(("o_orderkey", "o_custkey"))])


def _log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_log(spark, sf_dir)[0].facts("main"))


def _log_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, first = _log(spark, sf_dir)
    return _placed(log.facts("main", first))


def _log_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = _log(spark, sf_dir)
    return log.upto("main").filter("kind = 'retract'").agg(F.count("*").alias("n"), F.countDistinct("target_event_id").alias("targets"))


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = _log(spark, sf_dir)
    return log.events().groupBy("branch", "kind").agg(F.count("*").alias("n"))


def _log_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, first = _log(spark, sf_dir)
    return log.since(first).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def _log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = _log(spark, sf_dir)
    kb = log.bind(KnowledgeBase(), "main", ("placed", 2))
    return Engine(spark).evaluate(kb, '?- placed(O, "7") @{query_time:"2030-01-01T00:00:00Z"}').df


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from credence.sources.log import EventLog
    from credence.sources.shared import fresh_path
    from credence.streaming.ingest import ingest

    base = fresh_path(spark, "stream")
    source = _table(spark, sf_dir, "nation")
    source.write.parquet(f"{base}/in")
    log = EventLog(spark, f"{base}/log")
    ingest(spark.readStream.schema(source.schema).parquet(f"{base}/in"), log, f"{base}/checkpoint", "main", "nation", ["n_nationkey", "n_name"], once=True).awaitTermination()
    df = log.facts("main")
    return df.select(*[F.get_json_object("payload", f"$.atom.args[{i}].value").alias(c) for i, c in enumerate(("key", "name"))])


def _materialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms evaluated from the log and kept with their watermark, of which later events make no part."""
    from credence.sources.log import EventLog, Materialization
    from credence.sources.shared import fresh_path

    base = fresh_path(spark, "made")
    log = EventLog(spark, f"{base}/log")
    log.record(KnowledgeBase.parse("edge(a, b). edge(b, c). path(X, Y) :- edge(X, Y). path(X, Y) :- edge(X, Z), path(Z, Y)."))
    made = Materialization(log, f"{base}/idb")
    made.build("main", "?- path(X, Y)")
    log.record(KnowledgeBase.parse("edge(c, d)."))
    return made.read("main").select("X", "Y", "b", "d", "status", F.lit(made.stale("main")).alias("stale"))


def _json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KnowledgeBase.parse('p(a, 1.5). p(b, "x"). p(c, d"2024-02-29"). q(X) :- p(X, V), not r(X) @{b:0.5}. r(b).')
    return Engine(spark).evaluate(KnowledgeBase.from_json(kb.to_json()), "?- q(X)").df


def _mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of values of several types, in the order of their types and then of the values, of those with support."""
    program = """mixed(O, P) :- order(O, _, P), gt(P, 490000) @{b:0.5}. mixed(O, T) :- orderdate(O, T), lt(T, dt"1995-02-01T00:00:00") @{b:0.25, d:0.5}.
    mixed(O, S) :- status(O, S), order(O, _, P), lt(P, 2000). mixed(O, C) :- order(O, C, P), lt(P, 5000) @{b:0, d:0.5}. mixed(O, dur"P2D") :- order(O, _, P), lt(P, 3000) @{b:0.125}."""
    found = Engine(spark).evaluate(knowledge(spark, sf_dir, program, "order orderdate status"), f'?- mixed(O, V) @{{focus:support, order_by:"V, O", offset:7, limit:{_MIXED_LIMIT}, {FOREVER}}}').df
    return found.select("O", "b", "d", "status")


_MIXED_LIMIT = 400
_MIXED_SQL = f"""WITH m AS (
  SELECT o_orderkey AS o, 1 AS kind, NULL::DOUBLE AS num, o_orderdate AS moment, NULL AS txt, 0.25 AS b, 0.5 AS d FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01'
  UNION ALL SELECT o_orderkey, 2, o_totalprice, NULL, NULL, 0.5, 0.0 FROM orders WHERE o_totalprice > 490000
  UNION ALL SELECT o_orderkey, 4, NULL, NULL, o_orderstatus, 1.0, 0.0 FROM orders WHERE o_totalprice < 2000
  UNION ALL SELECT o_orderkey, 5, NULL, NULL, NULL, 0.125, 0.0 FROM orders WHERE o_totalprice < 3000)
SELECT o AS "O", b::DOUBLE AS b, d::DOUBLE AS d, CASE WHEN d > 0 THEN 'both' ELSE 'true' END AS status FROM m ORDER BY kind, txt, num, moment, o LIMIT {_MIXED_LIMIT} OFFSET 7"""


def _typed_log(spark: SparkSession, sf_dir: str):
    from credence.sources.log import EventLog
    from credence.sources.shared import fresh_path
    from credence.streaming.ingest import as_assertions

    log = EventLog(spark, fresh_path(spark, "typed-log"))
    log.append(as_assertions(_table(spark, sf_dir, "orders"), "main", "placed", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"], et="o_orderdate"))
    return log


def _log_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and moments of the log compare as what they were."""
    kb = _typed_log(spark, sf_dir).bind(KnowledgeBase(), "main", ("placed", 4), typed=True)
    return Engine(spark).evaluate(kb, f'?- placed(O, P, T, "F"), gt(P, 300000), lt(T, dt"1997-06-01T00:00:00") @{{{FOREVER}}}').df


def _log_other_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged and read where the session's zone isn't UTC: what was known at a time, by columns and by payloads."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    log = _typed_log(other, sf_dir)
    at = '@{known_at:"1998-01-01T00:00:00Z"}'
    column = Engine(other).evaluate(log.bind(KnowledgeBase(), "main", ("placed", 4), typed=True), f'?- placed(O, P, T, _), gt(T, dt"1997-06-01T00:00:00") {at}').df.select("O")
    small = _log_of(other, log.facts("main").filter("cast(get_json_object(payload, '$.atom.args[0].value') as long) < 300"))
    payload = Engine(other).evaluate(small.replay("main"), f"?- placed(O, P, T, _) {at}").df.select("O")
    path = _kept(column.withColumn("by", F.lit("column")).unionByName(payload.withColumn("by", F.lit("payload"))))
    return spark.read.schema("O long, by string").parquet(path)


def _kept(df: DataFrame) -> str:
    from credence.sources.shared import store

    return store(df, "kept")


def _log_of(spark: SparkSession, events: DataFrame):
    """A log of some events of another."""
    from credence.sources.log import EventLog
    from credence.sources.shared import fresh_path

    log = EventLog(spark, fresh_path(spark, "log-part"))
    log.append(events.drop("event_id"))
    return log


def _attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch with rules in the log and facts that stay there."""
    log = _typed_log(spark, sf_dir)
    log.record(KnowledgeBase.parse("dear(O, S) :- placed(O, P, _, S), gt(P, 400000) @{b:0.75}."))
    return Engine(spark).evaluate(log.attach("main"), f"?- dear(O, S) @{{{FOREVER}}}").df


def _contributions(spark: SparkSession, sf_dir: str, version: int | None = None) -> DataFrame:
    """Each line of an order supports its customer's risk; the tax lines replace them, and those of every fifth part are taken back."""
    from credence.sources.contributions import Contributions
    from credence.sources.shared import fresh_path

    store = Contributions(spark, fresh_path(spark, "contributions"))
    lines = _table(spark, sf_dir, "lineitem").filter("l_orderkey < 3000").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("x"), F.max("l_tax").alias("y"), F.max("l_partkey").alias("p"))
    name = F.concat_ws("/", "l_orderkey", "l_linenumber")
    store.upsert(lines, "risk", ["l_suppkey"], name, b="x")
    store.upsert(lines.filter("l_linenumber % 2 = 0"), "risk", ["l_suppkey"], name, b="y", d="x")
    store.retract(lines.filter("p % 5 = 0"), "risk", ["l_suppkey"], name)
    found = Engine(spark).evaluate(store.bind(KnowledgeBase(), ("risk", 1), version), f"?- risk(S) @{{{FOREVER}}}").df
    return found.select(F.col("S.num").cast("long").alias("S"), F.round("b", 6).alias("b"), F.round("d", 6).alias("d"), "status")


def _contributions_sql(version: int) -> str:
    lines = "SELECT l_suppkey AS s, l_linenumber AS n, max(l_discount) AS x, max(l_tax) AS y, max(l_partkey) AS p FROM lineitem WHERE l_orderkey < 3000 GROUP BY l_suppkey, l_orderkey, l_linenumber"
    b, d = ("CASE WHEN n % 2 = 0 THEN y ELSE x END", "CASE WHEN n % 2 = 0 THEN x ELSE 0 END") if version > 1 else ("x", "0")
    kept = "WHERE p % 5 <> 0" if version > 2 else ""
    return _sql('"S"', f'SELECT s AS "S", {_or("b")} AS b, {_or("d")} AS d FROM (SELECT s, {b} AS b, {d} AS d FROM ({lines}) {kept}) GROUP BY s HAVING max(b) > 0 OR max(d) > 0')


def _per_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One predicate takes the largest support, the others the query's noisy-or."""
    kb = knowledge(spark, sf_dir, "best(P) :- item(_, P, _) @{b:0.5}. any(P) :- item(_, P, _) @{b:0.5}. both(P) :- best(P), any(P).", "item").configure("best", 1, "maximum")
    df = Engine(spark).evaluate(kb, f"?- both(P), best(P) @{{{FOREVER}}}").df
    return df.withColumn("b", F.round("b", 6)).withColumn("d", F.round("d", 6))


def _index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one part, from a copy sorted by part."""
    from credence.sources.kb import store_sorted
    from credence.sources.shared import fresh_path

    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
    kb = KnowledgeBase().bind("line", store_sorted(lines, fresh_path(spark, "by-part"), ["l_partkey", "l_orderkey"]), ["l_orderkey", "l_partkey", "l_suppkey"], b=F.col("l_discount"))
    df = Engine(spark).evaluate(kb, f"?- line(O, 42, S) @{{{FOREVER}}}").df
    return df.withColumn("b", F.round("b", 6))


def _jdbc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in a database, and a branch with a rule over it."""
    import uuid

    from credence.sources.log import JdbcLog
    from credence.streaming.ingest import as_assertions

    log = JdbcLog(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, partitions=2)
    log.append(as_assertions(_table(spark, sf_dir, "supplier"), "main", "supplier", ["s_suppkey", "s_nationkey"]))
    log.append(as_assertions(_table(spark, sf_dir, "nation"), "other", "nation", ["n_nationkey"]))
    gone = log.facts("main").filter("cast(get_json_object(payload, '$.atom.args[0].value') as long) % 5 = 0")
    log.append(gone.select("branch", F.lit("retract").alias("kind"), F.col("event_id").alias("target_event_id")))
    log.record(KnowledgeBase.parse("near(S) :- supplier(S, N), lt(N, 6) @{b:0.5}."))
    return Engine(spark).evaluate(log.attach("main"), f"?- near(S) @{{{FOREVER}}}").df


def _explain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _explain(spark, sf_dir)
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 4).alias(c)
    return events.groupBy("event", "pred").agg(F.count("*").alias("n"), F.countDistinct("args").alias("atoms"), total("body_b"), total("applies"), total("b"), total("d"))


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = CASES["risky_customers"]
    return Engine(spark).evaluate(knowledge(spark, sf_dir, case.program, case.uses), f"{case.query} @{{explain:true, {FOREVER}}}").events


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "merge_dedupe": (_merge_dedupe, "SELECT * FROM (VALUES ('x', 1::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 'true'), ('y', 2, 0.5, 0.0, 'true'), ('z', 3, 1.0, 0.0, 'true')) t(\"N\", \"I\", b, d, status)"),
    "unload_predicate": (_unload_predicate, "SELECT r_regionkey::BIGINT AS \"R\", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM region"),
    "search": (_search, "SELECT * FROM (VALUES ('constraints', 0::BIGINT), ('entities', 1), ('facts', 1), ('predicates', 0), ('rules', 1)) t(kind, n)"),
    "log_replay": (_log_replay, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0"),
    "log_watermark": (_log_watermark, "SELECT o_orderkey, o_custkey FROM orders"),
    "log_retract": (_log_retract, "SELECT count(*) AS n, count(*) AS targets FROM orders WHERE o_orderkey % 7 = 0"),
    "branch_isolation": (_branches, "SELECT 'main' AS branch, 'assert' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'main', 'retract', count(*) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'other', 'assert', count(*) FROM nation"),
    "log_since": (_log_since, "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0) AS n, (SELECT count(*) FROM orders) + 1 AS first_id"),
    "log_query": (_log_query, "SELECT o_orderkey::VARCHAR AS \"O\", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM orders WHERE o_custkey = 7 AND o_orderkey % 7 <> 0"),
    "stream_ingest": (_stream_ingest, "SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation"),
    "materialization": (_materialization, "SELECT *, 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status, true AS stale FROM (VALUES ('a', 'b'), ('b', 'c'), ('a', 'c')) t(\"X\", \"Y\")"),
    "json_round_trip": (_json_round_trip, "SELECT *, 0.5::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM (VALUES ('a'), ('c')) t(\"X\")"),
    "explain_events": (_explain, None),
    "explain_summary": (
        _explain_summary,
        """WITH r AS (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
SELECT 'fact_support' AS event, 'order/3' AS pred, count(*) AS n, count(*) AS atoms, 0.0::DOUBLE AS body_b, 0.0::DOUBLE AS applies, count(*)::DOUBLE AS b, 0.0::DOUBLE AS d FROM orders
UNION ALL SELECT 'rule_applicability', 'risky/1', count(*), count(DISTINCT o_custkey), count(*), count(*), 0, 0 FROM r
UNION ALL SELECT 'rule_support', 'risky/1', count(*), count(DISTINCT o_custkey), count(*), count(*), round(count(*) * 0.9, 4), round(count(*) * 0.05, 4) FROM r""",
    ),
    "order_mixed": (_mixed_order, _MIXED_SQL),
    "index_lookup": (_index_lookup, _sql('"O", "S"', f'SELECT l_orderkey AS "O", l_suppkey AS "S", {_or("l_discount")} AS b, 0.0 AS d FROM lineitem WHERE l_partkey = 42 GROUP BY 1, 2 HAVING max(l_discount) > 0')),
    "log_jdbc": (_jdbc_log, """SELECT s_suppkey AS "S", 0.5::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM supplier WHERE s_nationkey < 6 AND s_suppkey % 5 <> 0"""),
    "log_typed": (_log_typed, """SELECT o_orderkey AS "O", o_totalprice AS "P", o_orderdate AS "T", 1.0::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 AND o_orderdate < TIMESTAMP '1997-06-01'"""),
    "log_other_zone": (_log_other_zone, """SELECT o_orderkey AS "O", 'column' AS "by" FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' AND o_orderdate <= TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, 'payload' FROM orders WHERE o_orderkey < 300 AND o_orderdate <= TIMESTAMP '1998-01-01'"""),
    "log_attach": (_attach, """SELECT o_orderkey AS "O", o_orderstatus AS "S", 0.75::DOUBLE AS b, 0.0::DOUBLE AS d, 'true' AS status FROM orders WHERE o_totalprice > 400000"""),
    "contribution_upsert": (lambda spark, sf_dir: _contributions(spark, sf_dir, 2), _contributions_sql(2)),
    "contribution_retract": (_contributions, _contributions_sql(3)),
    "per_predicate_aggregation": (_per_predicate, _sql('"P"', f'SELECT p AS "P", x * (x * y) AS b, 0.0 AS d FROM (SELECT l_partkey AS p, max(b * (1 - d) * 0.5) AS x, {_or("b * (1 - d) * 0.5")} AS y FROM {_ITEMS} GROUP BY 1)')),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(CASES["risky_customers"])(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(case) for name, case in CASES.items()} | {name: f for name, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql for name, case in CASES.items() if case.sql} | {name: sql for name, (_, sql) in OTHERS.items() if sql}
