"""Goal lists as joins, anti-joins, filters and columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import builtins as B
from credence.functions.semantics import Semantics
from credence.functions.values import Val, equal, literal, merged_kind
from credence.plans.model import AnyGoal, Assume, Atom, Builtin, Const, Goal, Var

_fresh = count()
#: Members of a group that a self-join pairs at once; larger groups are split into ranges of values, at most MOST_RANGES.
SPLIT_ROWS = 2000
MOST_RANGES = 16


@dataclass(frozen=True)
class Relation:
    """Columns a0, a1 ... of these kinds, b and d; a row for each atom.  Witnesses also have ``seen``."""

    df: DataFrame
    kinds: tuple[str | None, ...]
    unique: bool = False  # no two rows have the same arguments


#: The relation of a goal, by its place in the body.
Provider = Callable[[int, Atom, bool], Relation]


@dataclass
class Body:
    """Rows of a goal list: ``df`` has the columns that ``env`` and ``atoms`` refer to; None before any.

    ``unique`` says that no two rows have the same values of all variables.
    """

    df: DataFrame | None
    env: dict[str, Val]
    b: Column
    d: Column
    atoms: list[tuple[Atom, list[Val]]]
    seen: list[Column]
    dead: bool = False
    unique: bool = True


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True)) if len(conditions) != 1 else conditions[0]


def compile_body(spark: SparkSession, goals: tuple[AnyGoal, ...], provide: Provider, semantics: Semantics, split: bool = False) -> Body:
    """The goals in their order.  With ``split``, the sizes of groups are counted that a predicate's join with itself pairs in order."""
    body = Body(None, {}, F.lit(1.0), F.lit(0.0), [], [])
    for at, g in enumerate(goals):
        if isinstance(g, Assume):
            continue
        if isinstance(g, Builtin):
            _builtin(spark, body, g)
        elif g.negated:
            _without(spark, body, g.atom, provide(at, g.atom, True))
        else:
            _join(body, g.atom, provide(at, g.atom, False), semantics, goals[at + 1 :] if split else ())
        if body.dead:
            break
    if body.df is None:
        body.df = spark.range(1)
    if body.dead:
        body.df = body.df.filter(F.lit(False))
    return body


def _renamed(rel: Relation, n: int) -> tuple[DataFrame, list[Val]]:
    names = {c: f"g{n}_{c}" for c in rel.df.columns}
    return rel.df.select(*[F.col(c).alias(x) for c, x in names.items()]), [Val(F.col(f"g{n}_a{i}"), k or "str") for i, k in enumerate(rel.kinds)]


def _match(atom: Atom, cols: list[Val], env: dict[str, Val]) -> tuple[list[Column], list[Column], dict[str, Val]]:
    """Conditions on the relation alone, conditions with what is bound, and what the atom binds."""
    own, with_bound, new = [], [], {}
    for a, v in zip(atom.args, cols, strict=True):
        if isinstance(a, Const):
            own.append(equal(v, literal(a)))
        elif a.name in new:
            own.append(equal(v, new[a.name]))
        elif a.name in env:
            with_bound.append(equal(env[a.name], v))
        else:
            new[a.name] = v
    return own, with_bound, new


def _ordered_pair(body: Body, atom: Atom, new: dict[str, Val], goals: tuple[AnyGoal, ...]) -> tuple[str, str] | None:
    """The names of a smaller and a larger whole number, one bound and one of ``new``, that a later goal wants in that order.

    Only where ``atom`` is the second and of the first's predicate, so that groups are as large on both sides.
    """
    if len(body.atoms) != 1 or body.atoms[0][0].signature != atom.signature:
        return None
    known = body.env | new
    for g in goals:
        if isinstance(g, Builtin) and g.name in ("lt", "leq", "gt", "geq") and all(isinstance(a, Var) and a.name in known for a in g.args):
            x, y = (a.name for a in g.args)
            if (x in new) != (y in new) and known[x].kind == known[y].kind == "int":
                return (x, y) if g.name in ("lt", "leq") else (y, x)
    return None


def _cuts(df: DataFrame, keys: list[Column], value: Column) -> list[int]:
    """Where to cut the values of rows, if many have the same keys."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    ranges = min(MOST_RANGES, -(-most // SPLIT_ROWS))
    if ranges < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []))


def _range_of(value: Column, cuts: list[int]) -> Column:
    return reduce(lambda x, y: x + y, [(value >= F.lit(c)).cast("int") for c in cuts])


def _ranged(df: DataFrame, own: Column, last: int, smaller: bool, names: tuple[str, str]) -> DataFrame:
    """A row for each pair of ranges, the smaller value's and the larger's, that it may be in; null is in none."""
    low, high = (own, F.explode(F.sequence(own, F.lit(last)))) if smaller else (F.explode(F.sequence(F.lit(0), own)), own)
    return df.withColumns({names[0]: low, names[1]: high})


def _packed(df: DataFrame, keys: list[str], value: Column, cuts: list[int], n: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """A row for each group and range, with all of its rows in a list; and what takes them out again.

    A loop over a list is the cheapest way to pairs.  Weights that never differ stay out of it, as literals do then.
    """
    b, d = F.col(f"g{n}_b"), F.col(f"g{n}_d")
    same = df.agg((F.min(b) == F.max(b)) & (F.min(d) == F.max(d))).first()[0]
    out = [*keys, f"g{n}_b", f"g{n}_d"] if same else keys
    within = [c for c in df.columns if c not in out]
    # a single column is the value, which isn't null here
    rows = F.collect_list(F.struct(*within) if len(within) > 1 else F.col(within[0]))
    taken = F.inline(f"p{n}_rows").alias(*within) if len(within) > 1 else F.explode(f"p{n}_rows").alias(within[0])
    packed = df.filter(value.isNotNull()).groupBy(*out, _range_of(value, cuts).alias(f"p{n}_own")).agg(rows.alias(f"p{n}_rows"))
    return packed, lambda met: met.select(*[c for c in met.columns if not c.startswith(f"p{n}_")], taken)


def _split_join(left: DataFrame, right: DataFrame, keys: list[tuple[Val, Val, str]], bound: list[Column], low: Val, high: Val, left_low: bool, cuts: list[int], n: int) -> DataFrame:
    """The join on ``bound`` of what may be in order: each pair of ranges on its own, and none whose values are the other way round.

    Few bytes give many pairs here, so the number of tasks is given and doesn't follow the bytes; there are several for a core, as pairs are dealt unevenly.
    """
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ls, rs = (f"l{n}_low", f"l{n}_high"), (f"r{n}_low", f"r{n}_high")
    mine, other = (low.col, high.col) if left_low else (high.col, low.col)
    left = _ranged(left, _range_of(mine, cuts), len(cuts), left_low, ls)
    # grouping would make -0.0 into 0.0
    if all(v.kind not in ("float", "num", "term") for _, v, _ in keys):
        right, unpacked = _packed(right, [c for _, _, c in keys], other, cuts, n)
        right = _ranged(right, F.col(f"p{n}_own"), len(cuts), not left_low, rs)
    else:
        right, unpacked = _ranged(right, _range_of(other, cuts), len(cuts), not left_low, rs), lambda met: met
    left = left.repartition(tasks, *[k.col for k, _, _ in keys], *ls)
    right = right.repartition(tasks, *[v.col for _, v, _ in keys], *rs)
    # merged, as a list must never be the streamed side: Spark holds all that one streamed row gives
    return unpacked(left.join(right.hint("merge"), _all([*bound, *[F.col(x) == F.col(y) for x, y in zip(ls, rs, strict=True)]]), "inner").drop(*ls, *rs))


def _join(body: Body, atom: Atom, rel: Relation, semantics: Semantics, later: tuple[AnyGoal, ...] = ()) -> None:
    n = next(_fresh)
    df, cols = _renamed(rel, n)
    own, bound, new = _match(atom, cols, body.env)
    if own:
        df = df.filter(_all(own))
    # values of different kinds may be equal without being the same, as large ints and floats
    known = body.env | new
    exact = all(v.kind == (literal(a).kind if isinstance(a, Const) else known[a.name].kind) for a, v in zip(atom.args, cols, strict=True))
    body.unique = body.unique and rel.unique and exact
    if body.df is None:
        body.df = df.filter(_all(bound)) if bound else df
    else:
        order = _ordered_pair(body, atom, new, later) if bound else None
        cuts = []
        if order:
            keys = [(body.env[a.name], v, f"g{n}_a{i}") for i, (a, v) in enumerate(zip(atom.args, cols, strict=True)) if isinstance(a, Var) and a.name in body.env]
            cuts = _cuts(body.df, [k.col for k, _, _ in keys], body.env[order[0] if order[0] in body.env else order[1]].col)
        if cuts:
            body.df = _split_join(body.df, df, keys, bound, known[order[0]], known[order[1]], order[0] in body.env, cuts, n)
        else:
            body.df = body.df.join(df, _all(bound), "inner") if bound else body.df.crossJoin(df)
    b, d = F.col(f"g{n}_b"), F.col(f"g{n}_d")
    first = not body.atoms
    body.b = b if first else semantics.truth(body.b, b)
    body.d = d if first else semantics.falsity(body.d, d)
    if f"g{n}_seen" in df.columns:
        body.seen.append(F.col(f"g{n}_seen"))
    body.atoms.append((atom, cols))
    body.env |= new


def _without(spark: SparkSession, body: Body, atom: Atom, rel: Relation) -> None:
    """No matching atom with support; variables bound nowhere match any value."""
    df, cols = _renamed(rel, next(_fresh))
    df = df.filter(F.col([c for c in df.columns if c.endswith("_b")][0]) > 0)
    own, bound, _ = _match(atom, cols, body.env)
    if own:
        df = df.filter(_all(own))
    body.df = (spark.range(1) if body.df is None else body.df).join(df, _all(bound) if bound else F.lit(True), "left_anti")


def _filter(spark: SparkSession, body: Body, condition: Column) -> None:
    body.df = (spark.range(1) if body.df is None else body.df).filter(F.coalesce(condition, F.lit(False)))


def _builtin(spark: SparkSession, body: Body, g: Builtin) -> None:
    vals = [literal(a) if isinstance(a, Const) else body.env.get(a.name) for a in g.args]
    free = [i for i, v in enumerate(vals) if v is None]
    names = [a.name if isinstance(a, Var) else None for a in g.args]
    if g.name == "eq" and free:
        if len(free) == 1:
            body.env[names[free[0]]] = vals[1 - free[0]]
        elif names[0] != names[1]:
            body.dead = True
        return
    if g.name in B.ARITHMETIC and len(free) == 1:
        found = B.solve(g.name, *vals)
        if found is None:
            body.dead = True
            return
        # a column of its own, so that later goals don't compute it again
        df, name = spark.range(1) if body.df is None else body.df, f"x{next(_fresh)}"
        body.df = df.withColumn(name, found.col).filter(F.col(name).isNotNull())
        body.env[names[free[0]]] = Val(F.col(name), found.kind)
        return
    if free:
        body.dead = True
    elif g.name in B.COMPARE:
        _filter(spark, body, B.compare(g.name, *vals))
    elif g.name == "between":
        _filter(spark, body, B.between(*vals))
    elif g.name in B.ARITHMETIC:
        _filter(spark, body, B.holds(g.name, *vals))
    else:
        _filter(spark, body, B.is_type(g.name, vals[0]))


def kinds_of(goals: tuple[AnyGoal, ...], of: Callable[[Atom], tuple[str | None, ...]]) -> dict[str, str | None]:
    """The kinds of a body's variables, from those of its relations; as compile_body binds them."""
    env: dict[str, str | None] = {}
    for g in goals:
        if isinstance(g, Goal) and not g.negated:
            for a, k in zip(g.atom.args, of(g.atom), strict=True):
                if isinstance(a, Var):
                    env.setdefault(a.name, k)
        elif isinstance(g, Builtin):
            vals = [Val(F.lit(None), a.kind) if isinstance(a, Const) else Val(F.lit(None), env[a.name] or "str") if a.name in env else None for a in g.args]
            free = [i for i, v in enumerate(vals) if v is None]
            if len(free) == 1 and isinstance(g.args[free[0]], Var):
                if g.name == "eq":
                    env[g.args[free[0]].name] = vals[1 - free[0]].kind
                elif g.name in B.ARITHMETIC:
                    found = B.solve(g.name, *vals)
                    env[g.args[free[0]].name] = found.kind if found else "num"
    return env


def merged(a: tuple[str | None, ...], b: tuple[str | None, ...]) -> tuple[str | None, ...]:
    return tuple(merged_kind(x, y) for x, y in zip(a, b, strict=True))
