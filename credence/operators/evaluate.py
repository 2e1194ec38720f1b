"""Predicates as relations: visible facts, rule contributions, constraints and fixpoints."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions.semantics import EPS, Semantics
from credence.functions.values import SPARK_TYPE, Val, as_kind, as_utc, equal, from_spark, group_key, literal, to_term
from credence.operators.body import Body, Provider, Relation, compile_body, kinds_of, merged
from credence.plans.analysis import Graph, applicable
from credence.plans.demand import rewrite
from credence.plans.model import AnyGoal, Assume, Atom, Const, Fact, Goal, Note, Options, Rule, Signature, Var
from credence.sources.kb import Binding, KnowledgeBase
from credence.sources.shared import store_counted, stored


class FixpointProblem(RuntimeError):
    """A recursion that wasn't settled within its bounds."""


#: Witnesses of a cyclic recursion, beyond which it is given up with an error rather than cut off.
MAX_WITNESSES = 5_000_000


class Evaluator:
    def __init__(self, spark: SparkSession, kb: KnowledgeBase, goals: tuple[AnyGoal, ...], options: Options):
        self.spark, self.kb, self.goals, self.options = spark, kb, goals, options
        self.semantics = options.semantics
        now = options.query_time or datetime.now(UTC)
        self.times = {"query_time": as_utc(now), "valid_at": as_utc(options.valid_at or now), "known_at": as_utc(options.known_at or now)}
        self.assumed = [Fact(a, Note()) for g in goals if isinstance(g, Assume) for a in g.atoms if not list(a.variables())]
        self.graph = Graph(goals, kb.rules, kb.constraints)
        self.known: dict[Signature, Relation] = {}
        self.facts_of: dict[Signature, Signature] = {}
        self.asks: dict[Signature, tuple[Signature, tuple[int, ...]]] = {}
        self._ask_only_what_is_needed()
        self.kinds: dict[Signature, tuple[str | None, ...]] = {}
        self._find_kinds()

    def _ask_only_what_is_needed(self) -> None:
        """Where the question binds arguments of a recursion, evaluate what those can reach and no more."""
        constrained = {g.atom.signature for c in self.kb.constraints for g in c.goals if isinstance(g, Goal)}
        found = rewrite(self.goals, self.graph, constrained)
        if found is None:
            return
        base = self.kb.copy()
        base.facts, base.rules = [*self.kb.facts, *found.seeds], [*self.kb.rules, *found.passing]
        options = self.options.with_(semantics=self.semantics.with_(support_aggregation="maximum"), query_time=self.times["query_time"])
        seeded = Evaluator(self.spark, base, tuple(Goal(a) for a in found.wanted), options)
        seeded.times, seeded.assumed = self.times, self.assumed
        self.kb, self.goals, self.facts_of, self.asks = self.kb.copy(), found.goals, found.copied, found.asks
        self.kb.rules += found.rules
        for a in found.wanted:
            df = stored(seeded.relation(a.signature).df.drop("b", "d"), "demand")
            self.kb.bind(a.pred, df, [f"a{i}" for i in range(len(a.args))], distinct=True)
        self.graph = Graph(self.goals, self.kb.rules, self.kb.constraints)

    # facts
    def _visible(self, n: Note) -> bool:
        valid, known = self.times["valid_at"], self.times["known_at"]
        return (n.et is None or as_utc(n.et) <= known) and (n.vf is None or as_utc(n.vf) <= valid) and (n.vt is None or valid <= as_utc(n.vt))

    def _facts(self, p: Signature) -> list[Fact]:
        p = self.facts_of.get(p, p)
        # assumptions are there whatever the times
        return [f for f in self.kb.facts if f.atom.signature == p and self._visible(f.note)] + [f for f in self.assumed if f.atom.signature == p]

    def _bound(self, x: Binding) -> DataFrame:
        """Its visible rows.  Moments without a zone are UTC and are compared as such, whatever the session's zone,
        and without a cast of the column, so that the filter reaches the scan."""
        df = x.df
        for c, test, cut in ((x.et, Column.__le__, "known_at"), (x.vf, Column.__le__, "valid_at"), (x.vt, Column.__ge__, "valid_at")):
            if c is not None:
                at = self.times[cut]
                zoned = not isinstance(df.select(c).schema[0].dataType, T.TimestampNTZType)
                limit = F.lit(at.isoformat()).cast("timestamp") if zoned else F.lit(at.replace(tzinfo=None).isoformat()).cast("timestamp_ntz")
                df = df.filter(c.isNull() | test(c, limit))
        return df

    def _find_kinds(self) -> None:
        kinds: dict[Signature, tuple[str | None, ...]] = {}
        for p in self.graph.edges:
            found: tuple[str | None, ...] = (None,) * p[1]
            for f in self._facts(p):
                found = merged(found, tuple(a.kind for a in f.atom.args))
            for x in self.kb.bindings.get(self.facts_of.get(p, p), []):
                types = x.df.select(*[c.alias(f"a{i}") for i, c in enumerate(x.args)]).schema
                found = merged(found, tuple(from_spark(F.lit(None), t.dataType).kind for t in types))
            kinds[p] = found
        changed = True
        while changed:  # kinds only widen, so this ends
            changed = False
            for p, rules in self.graph.rules.items():
                for r in rules:
                    env = kinds_of(r.goals, lambda a: kinds.get(a.signature, (None,) * len(a.args)))
                    head = tuple(a.kind if isinstance(a, Const) else env.get(a.name) for a in r.head.args)
                    now = merged(kinds[p], head)
                    if now != kinds[p]:
                        kinds[p], changed = now, True
        self.kinds = {p: tuple(k or "str" for k in found) for p, found in kinds.items()}

    def _fact_rows(self, p: Signature) -> tuple[list[DataFrame], bool]:
        """Fact tables with a0 ..., b, d; and whether no two rows have the same arguments."""
        kinds, out = self.kinds[p], []
        facts = self._facts(p)
        if facts:
            n = range(p[1])
            own = [c if c is not None else "str" for c in self._literal_kinds(facts, p[1])]
            if all(k in ("str", "int", "float", "date", "dur") for k in own):
                schema = T.StructType([T.StructField(f"a{i}", SPARK_TYPE[own[i]]) for i in n] + [T.StructField(c, T.DoubleType()) for c in "bd"])
                df = self.spark.createDataFrame([(*[a.py for a in f.atom.args], float(f.note.b), float(f.note.d)) for f in facts], schema)
                out.append(df.select(*[as_kind(Val(F.col(f"a{i}"), own[i]), kinds[i]).alias(f"a{i}") for i in n], "b", "d"))
            else:
                rows = [F.struct(*[as_kind(literal(a), kinds[i]).alias(f"a{i}") for i, a in enumerate(f.atom.args)], F.lit(float(f.note.b)).alias("b"), F.lit(float(f.note.d)).alias("d")) for f in facts]
                out.append(self.spark.range(1).select(F.inline(F.array(*rows))))
        distinct = not facts
        bound = self.kb.bindings.get(self.facts_of.get(p, p), [])
        for x in bound:
            types = x.df.select(*[c.alias(f"a{i}") for i, c in enumerate(x.args)]).schema
            cols = [as_kind(from_spark(c, t.dataType), k).alias(f"a{i}") for i, (c, t, k) in enumerate(zip(x.args, types, kinds, strict=True))]
            weight = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
            df = self._bound(x).select(*cols, weight(x.b).alias("b"), weight(x.d).alias("d"))
            out.append(df.dropna(subset=[f"a{i}" for i in range(p[1])]))
            distinct = distinct and x.distinct and len(bound) == 1
        if p in self.asks:
            out = [self._in_demand(p, df) for df in out]
        return out, distinct and bool(out)

    def _in_demand(self, p: Signature, df: DataFrame) -> DataFrame:
        """Facts of a call pattern, as far as they are asked for."""
        demand, places = self.asks[p]
        asked = reduce(DataFrame.unionByName, self._fact_rows(demand)[0]).select(*[F.col(f"a{j}").alias(f"__d{j}") for j in range(len(places))])
        same = [equal(Val(F.col(f"a{i}"), self.kinds[p][i]), Val(F.col(f"__d{j}"), self.kinds[demand][j])) for j, i in enumerate(places)]
        return df.join(asked, reduce(lambda x, y: x & y, same), "left_semi")

    @staticmethod
    def _literal_kinds(facts: list[Fact], arity: int) -> list[str | None]:
        kinds: tuple[str | None, ...] = (None,) * arity
        for f in facts:
            kinds = merged(kinds, tuple(a.kind for a in f.atom.args))
        return list(kinds)

    def _empty(self, p: Signature) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([T.StructField(f"a{i}", SPARK_TYPE[k]) for i, k in enumerate(self.kinds[p])] + [T.StructField(c, T.DoubleType()) for c in "bd"]))

    def _semantics(self, p: Signature) -> Semantics:
        """The query's semantics, but for what the knowledge base sets for the predicate."""
        own = self.kb.aggregations.get(self.facts_of.get(p, p))
        return self.semantics.with_(support_aggregation=own) if own else self.semantics

    def _aggregated(self, p: Signature, parts: list[DataFrame], distinct: bool = False) -> Relation:
        """One row for each atom with any evidence."""
        kinds = self.kinds[p]
        if not parts:
            return Relation(self._empty(p), kinds)
        df = reduce(DataFrame.unionByName, parts)
        if not (distinct and len(parts) == 1):
            cols = [f"a{i}" for i in range(p[1])]
            keys = [group_key(Val(F.col(c), k)).alias(f"k{i}") for i, (c, k) in enumerate(zip(cols, kinds, strict=True))]
            values = [F.min(c).alias(c) if k == "term" else F.col(f"k{i}").alias(c) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))]
            terms = [v for v, k in zip(values, kinds, strict=True) if k == "term"]
            own = self._semantics(p)
            grouped = df.groupBy(*keys).agg(*terms, own.aggregate(F.col("b")).alias("b"), own.aggregate(F.col("d")).alias("d"))
            df = grouped.select(*[F.col(c) if k == "term" else v for c, v, k in zip(cols, values, kinds, strict=True)], "b", "d")
        return Relation(df.filter("b > 0 or d > 0"), kinds, unique=True)

    # rules
    def body(self, goals: tuple[AnyGoal, ...], provide: Provider, constrained: bool = True, split: bool = False) -> Body:
        body = compile_body(self.spark, goals, provide, self.semantics, split)
        return self._constrained(body, goals, provide) if constrained else body

    def _head(self, r: Rule, body: Body) -> list[Column]:
        vals = [literal(a) if isinstance(a, Const) else body.env[a.name] for a in r.head.args]
        return [as_kind(v, k).alias(f"a{i}") for i, (v, k) in enumerate(zip(vals, self.kinds[r.head.signature], strict=True))]

    def contribution(self, r: Rule, provide: Provider) -> Relation | None:
        """What a rule adds to its head, a row for each body row that applies."""
        body = self.body(r.goals, provide)
        if body.dead:
            return None
        df = body.df.select(*self._head(r, body), self.semantics.rule_applies(body.b, body.d).alias("__applies"), *self._seen(r, body))
        df = df.filter("__applies > 0")
        df = df.select(*[c for c in df.columns if c != "__applies"], (F.col("__applies") * float(r.note.b)).alias("b"), (F.col("__applies") * float(r.note.d)).alias("d"))
        # the head's values tell body rows apart if it has all variables, each as it is in the body
        kinds = self.kinds[r.head.signature]
        whole = set(body.env) <= set(r.head.variables()) and all(isinstance(a, Const) or body.env[a.name].kind == k for a, k in zip(r.head.args, kinds, strict=True))
        return Relation(df, kinds, unique=body.unique and whole)

    def _seen(self, r: Rule, body: Body) -> list[Column]:
        return [F.array_distinct(F.concat(*body.seen)).alias("seen")] if body.seen else []

    def _provide(self, state: dict[Signature, Relation] | None = None) -> Provider:
        return lambda at, atom, negated: (state or {}).get(atom.signature) or self.relation(atom.signature)

    # constraints
    def _constrained(self, body: Body, goals: tuple[AnyGoal, ...], provide: Provider) -> Body:
        """Raise the falsity of body rows whose atoms hold all of a violated constraint's atoms."""
        found = applicable(goals, self.kb.constraints)
        if not found or body.dead:
            return body
        names = list(body.env)
        base = body.df.select(*[group_key(body.env[v]).alias(f"r{i}") for i, v in enumerate(names)], *[to_term(v).getField("key").alias(f"f{j}_{i}") for j, (_, vals) in enumerate(body.atoms) for i, v in enumerate(vals)])
        parts = []
        for number, c in enumerate(found):
            # a constraint is evaluated on the same states, without constraints on its own body
            own = compile_body(self.spark, c.goals, lambda at, atom, negated: provide(-1, atom, negated), self.semantics)
            if own.dead:
                continue
            value = self.semantics.constraint_applies(own.b, own.d) * float(c.note.b)
            cols = [to_term(v).getField("key").alias(f"c{j}_{i}") for j, (_, vals) in enumerate(own.atoms) for i, v in enumerate(vals)]
            rest = [to_term(v).getField("key") for v in own.env.values()]
            row = F.to_json(F.struct(F.lit(number).alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(rest)])).alias("__row")
            violated = own.df.select(*cols, value.alias("__v"), row).filter("__v > 0")
            places = [[j for j, (a, _) in enumerate(body.atoms) if a.signature == ca.signature] for ca, _ in own.atoms]
            for chosen in product(*places):
                same = [F.col(f"c{j}_{i}") == F.col(f"f{k}_{i}") for j, k in enumerate(chosen) for i in range(len(own.atoms[j][1]))]
                met = base.join(violated, reduce(lambda x, y: x & y, same), "inner")
                parts.append(met.select(*[f"r{i}" for i in range(len(names))], "__row", "__v"))
        if not parts:
            return body
        keys = [f"r{i}" for i in range(len(names))]
        met = reduce(DataFrame.unionByName, parts).dropDuplicates([*keys, "__row"])
        worst = met.groupBy(*keys).agg(self.semantics.aggregate(F.col("__v")).alias("__violation"))
        left = body.df.withColumns({f"l{i}": group_key(body.env[v]) for i, v in enumerate(names)} | {"__b": body.b, "__d": body.d})
        on = reduce(lambda x, y: x & y, [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(names))], F.lit(True))
        joined = left.join(worst, on, "left")
        d = F.when(F.col("__violation") > 0, self.semantics.aggregate_two(F.col("__d"), F.col("__violation"))).otherwise(F.col("__d"))
        return Body(joined.withColumn("__d2", d), body.env, F.col("__b"), F.col("__d2"), body.atoms, body.seen, unique=body.unique)

    # strata
    def relation(self, p: Signature) -> Relation:
        if p not in self.known:
            if p not in self.graph.edges:
                self.kinds.setdefault(p, ("str",) * p[1])
                return Relation(self._empty(p), self.kinds[p])
            self.evaluate()
        return self.known[p]

    def evaluate(self) -> None:
        recursive = any(self.graph.recursive(c) for c in self.graph.components)
        if not recursive and self.graph.height() > self.options.max_depth:
            self._rounds()
            return
        for c in self.graph.components:
            if not self.graph.recursive(c):
                p = c[0]
                facts, distinct = self._fact_rows(p)
                made = [x for r in self.graph.rules[p] if (x := self.contribution(r, self._provide())) is not None]
                distinct = distinct and not made or not facts and len(made) == 1 and made[0].unique
                self.known[p] = self._aggregated(p, facts + [x.df for x in made], distinct)
            elif not self._recursion(c):
                self._rounds()  # the depth limit cuts this program: count nesting from the query
                return

    def _stored(self, state: dict[Signature, Relation]) -> dict[Signature, Relation]:
        return {p: Relation(stored(x.df, "state"), x.kinds, x.unique) for p, x in state.items()}

    def _step(self, component: list[Signature], base: dict[Signature, list[DataFrame]], state: dict[Signature, Relation]) -> dict[Signature, Relation]:
        """Facts, and every rule on the last round's states."""
        out = {}
        for p in component:
            made = [x.df for r in self.graph.rules[p] if (x := self.contribution(r, self._provide(state))) is not None]
            out[p] = self._aggregated(p, base[p] + made)
        return self._stored(out)

    def _changes(self, old: dict[Signature, Relation], new: dict[Signature, Relation]) -> tuple[int, int]:
        """How many atoms are new or gone, and how many have other weights."""
        atoms = values = 0
        for p, kinds in ((p, new[p].kinds) for p in new):
            keys = lambda df, mark: df.select(*[group_key(Val(F.col(f"a{i}"), k)).alias(f"k{i}") for i, k in enumerate(kinds)], F.col("b").alias(f"b{mark}"), F.col("d").alias(f"d{mark}"))
            both = keys(old[p].df, 0).join(keys(new[p].df, 1), [f"k{i}" for i in range(p[1])], "full")
            gone = F.col("b0").isNull() | F.col("b1").isNull()
            moved = (F.abs(F.col("b0") - F.col("b1")) > EPS) | (F.abs(F.col("d0") - F.col("d1")) > EPS)
            r = both.agg(F.count_if(gone).alias("atoms"), F.count_if(~gone & moved).alias("moved")).first()
            atoms, values = atoms + r[0], values + r[1]
        return atoms, values

    def _recursion(self, component: list[Signature]) -> bool:
        """Evaluate a recursive component; False if the depth limit stops it first."""
        base = {p: self._fact_rows(p)[0] for p in component}
        state = self._stored({p: self._aggregated(p, base[p]) for p in component})
        used = 0
        if not any(applicable(r.goals, self.kb.constraints) for p in component for r in self.graph.rules[p]):
            grows = self.semantics.rule_applicability == "body_truth_only" and all(self._semantics(p).support_aggregation == "maximum" for p in component)
            done, used, state = self._delta_rounds(component, state, grows)
            if done is not None:
                return done
        steady, cyclic = 0, None
        for _ in range(used, self.options.max_depth):
            new = self._step(component, base, state)
            atoms, values = self._changes(state, new)
            state = new
            if not atoms and not values:
                self.known |= state
                return True
            steady = 0 if atoms else steady + 1
            if steady >= 2 and cyclic is None and self._cyclic(component, state):
                return self._witnesses(component, base)
            cyclic = False if steady >= 2 else cyclic
        return False

    def _delta_rounds(self, component: list[Signature], state: dict[Signature, Relation], grows: bool) -> tuple[bool | None, int, dict[Signature, Relation]]:
        """Rounds that only look at what the last one added, which is appended to the state.

        If weights only grow (``grows``), an atom that is found again takes the larger ones.  Otherwise an atom's weight must not change once
        others rest on it, so the first round that finds an atom again is undone, and None is given with the rounds
        before it and their state, from which all must be evaluated in full.
        """
        inside, delta, old, first = set(component), state, None, state
        paths: dict[Signature, list[str]] = {}
        for n in range(self.options.max_depth + (1 if grows else 0)):
            made: dict[Signature, list[DataFrame]] = {p: [] for p in component}
            for p in component:
                for r in self.graph.rules[p]:
                    places = [k for k, g in enumerate(r.goals) if isinstance(g, Goal) and not g.negated and g.atom.signature in inside]
                    if not places and n == 0:  # rules that start from outside
                        if (x := self.contribution(r, self._provide())) is not None:
                            made[p].append(x.df)
                    for at in places if old is not None else places[:1]:  # nothing is old at first
                        # new atoms at one place, old ones before it, any after it: no body row is made twice
                        def provide(k, atom, negated, at=at):
                            own = delta if k == at else old if k < at and old is not None else state
                            return own.get(atom.signature) or self.relation(atom.signature)

                        if (x := self.contribution(r, provide)) is not None:
                            made[p].append(x.df)
            new, found, again = {}, 0, 0
            for p in component:
                if not made[p]:
                    new[p] = Relation(self._empty(p), self.kinds[p], unique=True)
                    continue
                path, df, counts = self._grown(p, made[p], state[p], grows)
                found, again = found + counts[0], again + counts[1]
                new[p] = Relation(df.filter("__larger").drop("__larger", "__fresh"), self.kinds[p], unique=True)
                paths.setdefault(p, []).append(path)
            if again and not grows:
                return None, n, state
            if not found:
                self.known |= state
                return True, n, state
            old, delta = state, new
            if again:  # an atom found again has its larger weights in the later row
                state = self._stored({p: self._aggregated(p, [state[p].df, new[p].df]) for p in component})
                first, paths = state, {}
            else:
                state = {p: self._appended(first[p], new[p], paths.get(p, [])) for p in component}
        return False, self.options.max_depth, state

    def _appended(self, first: Relation, new: Relation, paths: list[str]) -> Relation:
        """A state and the deltas after it, none of which has an atom that another has; the deltas are one scan."""
        if not paths:
            return first
        schema = T.StructType([*new.df.schema.fields, T.StructField("__larger", T.BooleanType())])
        later = self.spark.read.schema(schema).parquet(*paths).filter("__larger").drop("__larger")
        return Relation(first.df.unionByName(later), first.kinds, unique=True)

    def _grown(self, p: Signature, made: list[DataFrame], known: Relation, grows: bool) -> tuple[str, DataFrame, tuple[int, int]]:
        """A table of the atoms made, and which are new or larger than known (``__larger``); how many these are, and how many
        of all, or of these if weights grow, were known."""
        n = range(p[1])
        got = self._aggregated(p, made).df
        keys = [group_key(Val(F.col(f"a{i}"), k)) for i, k in enumerate(self.kinds[p])]
        old = known.df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("b").alias("b0"), F.col("d").alias("d0"))
        met = got.select("*", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).join(old, [f"k{i}" for i in n], "left")
        fresh = F.col("b0").isNull()
        larger = fresh | (F.col("b") > F.col("b0") + EPS) | (F.col("d") > F.col("d0") + EPS)
        weights = [F.greatest(c, F.coalesce(f"{c}0", F.lit(0.0))).alias(c) for c in "bd"]
        rows = met.select(*[f"a{i}" for i in n], *weights, larger.alias("__larger"), fresh.alias("__fresh"))
        path, counts = store_counted(rows, "delta", [F.count_if("__larger"), F.count_if(~F.col("__fresh") & F.col("__larger") if grows else ~F.col("__fresh"))])
        return path, self.spark.read.schema(rows.schema).parquet(path), (counts[0], counts[1])

    def _cyclic(self, component: list[Signature], state: dict[Signature, Relation]) -> bool:
        """Whether atoms of the component support themselves: peel off those that rest on nothing inside."""
        inside, edges = set(component), []
        for p in component:
            for r in self.graph.rules[p]:
                body = compile_body(self.spark, r.goals, self._provide(state), self.semantics)
                head = self._atom_key(p[0], [literal(a) if isinstance(a, Const) else body.env[a.name] for a in r.head.args])
                edges += [body.df.select(head.alias("h"), self._atom_key(a.pred, vals).alias("t")) for a, vals in body.atoms if a.signature in inside]
        left = stored(reduce(DataFrame.unionByName, edges).distinct(), "edges")
        n = left.count()
        while n:
            left = stored(left.join(left.select(F.col("h").alias("x")).distinct(), F.col("t") == F.col("x"), "left_semi"), "edges")
            n, before = left.count(), n
            if n == before:
                return True
        return False

    @staticmethod
    def _atom_key(pred: str, vals: list[Val]) -> Column:
        return F.concat_ws("\x1f", F.lit(f"{pred}/{len(vals)}"), *[to_term(v).getField("key") for v in vals])

    def _witnesses(self, component: list[Signature], base: dict[Signature, list[DataFrame]]) -> bool:
        """Derivations that don't rest on their own conclusion, each with the atoms it rests on; then aggregated."""
        def marked(p: Signature, df: DataFrame) -> DataFrame:
            key = self._atom_key(p[0], [Val(F.col(f"a{i}"), k) for i, k in enumerate(self.kinds[p])])
            return df.withColumn("__key", key)

        first = {p: marked(p, self._aggregated(p, base[p]).df).withColumn("seen", F.array("__key")).drop("__key") for p in component}
        state = self._stored({p: Relation(first[p], self.kinds[p]) for p in component})
        total = sum(x.df.count() for x in state.values())
        for _ in range(self.options.max_depth):
            new = {}
            for p in component:
                parts = [first[p]]
                for r in self.graph.rules[p]:
                    found = self.contribution(r, self._provide(state))
                    if found is None:
                        continue
                    made = found.df
                    made = marked(p, made if "seen" in made.columns else made.withColumn("seen", F.array().cast("array<string>")))
                    made = made.filter(~F.array_contains("seen", F.col("__key")))
                    parts.append(made.withColumn("seen", F.array_append("seen", F.col("__key"))).drop("__key"))
                new[p] = Relation(reduce(DataFrame.unionByName, parts), self.kinds[p])
            state = self._stored(new)
            now = sum(x.df.count() for x in state.values())
            if now > MAX_WITNESSES:
                raise FixpointProblem(f"more than {MAX_WITNESSES} derivations in {component}; lower max_depth or use maximum")
            if now == total:
                break
            total = now
        self.known |= self._stored({p: self._aggregated(p, [state[p].df.drop("seen")]) for p in component})
        return True

    def _rounds(self) -> None:
        """All predicates together, max_depth rounds: what nests no deeper."""
        preds = list(self.graph.edges)
        full: dict[Signature, Relation] = {}
        negated = {g.atom.signature for rs in self.graph.rules.values() for r in rs for g in r.goals if isinstance(g, Goal) and g.negated}
        negated |= {g.atom.signature for g in self.goals if isinstance(g, Goal) and g.negated}
        if negated:  # negation looks at all that holds, not at what the limit leaves
            other = Evaluator(self.spark, self.kb, tuple(Goal(Atom(p, tuple(Var(f"V{i}") for i in range(n)))) for p, n in sorted(negated)), self.options.with_(max_depth=1000))
            other.assumed, other.times = self.assumed, self.times
            full = {p: other.relation(p) for p in negated}
        base = {p: self._fact_rows(p)[0] for p in preds}
        state = self._stored({p: self._aggregated(p, base[p]) for p in preds})
        for _ in range(self.options.max_depth):
            provide: Callable = lambda at, atom, neg, state=state: full[atom.signature] if neg and atom.signature in full else state[atom.signature]
            new = self._stored({p: self._aggregated(p, base[p] + [x.df for r in self.graph.rules[p] if (x := self.contribution(r, provide)) is not None]) for p in preds})
            done = self._changes(state, new) == (0, 0)
            state = new
            if done:
                break
        self.known = state
