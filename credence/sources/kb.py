"""Knowledge bases: facts, rules and constraints of program text, and tables bound to predicates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.semantics import CHOICES, UnsupportedSemantics
from credence.functions.values import Const, duration_text, moment_text, parse_duration, parse_moment
from credence.plans import syntax
from credence.plans.macros import Registry
from credence.plans.model import AnyGoal, Assume, Atom, Builtin, Constraint, Fact, Goal, Note, Predicate, Rule, Signature, Var

ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


class DuplicateDeclaration(ValueError):
    def __init__(self, name: str, arity: int):
        super().__init__(f"Duplicate predicate declaration: pred {name}/{arity}. Each predicate may only be declared once with 'pred'.")


@dataclass(frozen=True)
class Binding:
    """A table whose rows are facts."""

    df: DataFrame
    args: tuple[Column, ...]
    b: Column
    d: Column
    et: Column | None = None
    vf: Column | None = None
    vt: Column | None = None
    distinct: bool = False


def _column(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(float(c))


@dataclass
class KnowledgeBase:
    name: str = "main"
    facts: list[Fact] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    predicates: dict[Signature, Predicate] = field(default_factory=dict)
    bindings: dict[Signature, list[Binding]] = field(default_factory=dict)
    aggregations: dict[Signature, str] = field(default_factory=dict)

    # building
    @classmethod
    def parse(cls, text: str, registry: Registry | None = None, now: datetime | None = None) -> KnowledgeBase:
        made, registry = cls(), registry or Registry()
        now = now or datetime.now(UTC)
        todo = list(syntax.statements(text))[::-1]
        while todo:
            s = todo.pop()
            if isinstance(s, str):
                if not s:
                    continue
                if s.split(None, 2)[:2] == ["use", "templates"]:
                    registry.use(s)
                    continue
                expanded = registry.expand(s)
                if expanded is not None:
                    todo += expanded[::-1]
                    continue
                s = syntax.statement(s, now)
            made.add(s)
        return made

    def add(self, s: Fact | Rule | Constraint | Predicate) -> None:
        if isinstance(s, Predicate):
            key = (s.name, s.arity)
            if key in self.predicates and self.predicates[key].declared:
                raise DuplicateDeclaration(*key)
            self.predicates[key] = s
            return
        goals: tuple[AnyGoal, ...] = ()
        if isinstance(s, Fact):
            self.facts.append(s)
            self._see(s.atom)
        elif isinstance(s, Rule):
            self.rules.append(s)
            self._see(s.head)
            goals = s.goals
        else:
            self.constraints.append(s)
            goals = s.goals
        for g in goals:
            if isinstance(g, Goal):
                self._see(g.atom)

    def _see(self, atom: Atom) -> None:
        self.predicates.setdefault(atom.signature, Predicate(*atom.signature, ("entity",) * len(atom.args)))

    def bind(self, pred: str, df: DataFrame, args: list, b: Column | str | float = 1.0, d: Column | str | float = 0.0, et=None, vf=None, vt=None, distinct: bool = False) -> KnowledgeBase:
        """Make the rows of ``df`` facts of ``pred``.  ``distinct`` promises that no two rows have the same arguments.

        Rows with a null argument are no facts; null weights count as 0; a null ``et`` is always known.
        """
        times = [None if t is None else _column(t) for t in (et, vf, vt)]
        self.bindings.setdefault((pred, len(args)), []).append(Binding(df, tuple(map(_column, args)), _column(b), _column(d), *times, distinct))
        self.predicates.setdefault((pred, len(args)), Predicate(pred, len(args), ("entity",) * len(args)))
        return self

    def configure(self, pred: str, arity: int, support_aggregation: str) -> KnowledgeBase:
        """How the support of one predicate's atoms is aggregated, whatever a query sets for the others."""
        if support_aggregation not in CHOICES["support_aggregation"]:
            raise UnsupportedSemantics(f"support_aggregation can't be {support_aggregation!r}")
        self.aggregations[pred, arity] = support_aggregation
        return self

    def copy(self) -> KnowledgeBase:
        return replace(self, aggregations=dict(self.aggregations), facts=[*self.facts], rules=[*self.rules], constraints=[*self.constraints], predicates=dict(self.predicates), bindings={k: [*v] for k, v in self.bindings.items()})

    # merging and unloading
    def merge(self, other: KnowledgeBase) -> KnowledgeBase:
        """Both; statements that are there already, word for word, aren't added again."""
        out = self.copy()
        for key, p in other.predicates.items():
            if p.declared and key in out.predicates and out.predicates[key].declared:
                raise DuplicateDeclaration(*key)
            if p.declared or key not in out.predicates:
                out.predicates[key] = p
        for mine, theirs in ((out.facts, other.facts), (out.rules, other.rules), (out.constraints, other.constraints)):
            seen = set(mine)
            mine += [s for s in theirs if s not in seen]
        for key, found in other.bindings.items():
            out.bindings.setdefault(key, []).extend(found)
        out.aggregations |= other.aggregations
        return out

    def unload_predicate(self, pred: str, arity: int) -> tuple[KnowledgeBase, dict[str, int]]:
        key, out = (pred, arity), self.copy()
        uses = lambda goals: any(isinstance(g, Goal) and g.atom.signature == key for g in goals)
        out.facts = [f for f in self.facts if f.atom.signature != key]
        out.rules = [r for r in self.rules if r.head.signature != key and not uses(r.goals)]
        out.constraints = [c for c in self.constraints if not uses(c.goals)]
        gone = out.predicates.pop(key, None)
        out.bindings.pop(key, None)
        return out, {"declaration": int(gone is not None), "fact": len(self.facts) - len(out.facts), "rule": len(self.rules) - len(out.rules), "constraint": len(self.constraints) - len(out.constraints)}

    def unload_entity(self, entity: str) -> tuple[KnowledgeBase, int]:
        out = self.copy()
        out.facts = [f for f in self.facts if not any(isinstance(a, Const) and a.form == "entity" and a.value == entity for a in f.atom.args)]
        return out, len(self.facts) - len(out.facts)

    def search(self, text: str) -> dict[str, list]:
        """Predicates, entities, facts, rules and constraints whose text has ``text``, in any case."""
        low = text.lower()
        has = lambda s: low in s.lower()
        entities = sorted({a.value for f in self.facts for a in f.atom.args if isinstance(a, Const) and a.form == "entity"})
        return {
            "predicates": [p for p in self.predicates.values() if has(p.name) or has(p.description or "")],
            "entities": [e for e in entities if has(e)],
            "facts": [f for f in self.facts if has(f.render())],
            "rules": [r for r in self.rules if has(r.render())],
            "constraints": [c for c in self.constraints if has(c.render())],
        }

    # text and JSON
    def render(self, predicates: bool = True, facts: bool = True, rules: bool = True, constraints: bool = True) -> str:
        typed = {c.goals for p in self.predicates.values() if p.declared for c in _generated(p)}
        lines = [p.render() + "." for p in self.predicates.values()] if predicates else []
        lines += [f.render() + "." for f in self.facts] if facts else []
        lines += [r.render() + "." for r in self.rules] if rules else []
        lines += [c.render() + "." for c in self.constraints if not (predicates and c.goals in typed)] if constraints else []
        return "\n".join(lines)

    def to_json(self) -> str:
        rows = [{"kind": "predicate", "name": p.name, "arity": p.arity, "types": list(p.types), "description": p.description, "declared": p.declared} for p in self.predicates.values()]
        rows += [{"kind": "fact", "atom": _atom_json(f.atom), **_note_json(f.note)} for f in self.facts]
        rows += [{"kind": "rule", "head": _atom_json(r.head), "goals": list(map(_goal_json, r.goals)), **_note_json(r.note)} for r in self.rules]
        rows += [{"kind": "constraint", "goals": list(map(_goal_json, c.goals)), **_note_json(c.note)} for c in self.constraints]
        return json.dumps({"name": self.name, "statements": rows}, ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str, fix: bool = False) -> KnowledgeBase:
        """``fix`` infers the kinds of statements and values that lack one."""
        data = json.loads(text)
        out = cls(data.get("name", "main"))
        for row in data["statements"]:
            row = _fixed(row) if fix else row
            kind = row["kind"]
            if kind == "predicate":
                out.predicates[row["name"], row["arity"]] = Predicate(row["name"], row["arity"], tuple(row.get("types") or ()), row.get("description"), row.get("declared", True))
            elif kind == "fact":
                out.add(Fact(_atom(row["atom"]), _note(row)))
            elif kind == "rule":
                out.add(Rule(_atom(row["head"]), tuple(map(_goal, row["goals"])), _note(row)))
            elif kind == "constraint":
                out.add(Constraint(tuple(map(_goal, row["goals"])), _note(row)))
            else:
                raise ValueError(f"Unknown kind of statement: {kind!r}")
        return out

    @classmethod
    def load(cls, path: str, fix: bool = False) -> KnowledgeBase:
        """A program or JSON file, in whichever usual encoding it is."""
        raw = Path(path).read_bytes()
        marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")  # nearly any bytes would pass as unmarked utf-16
        for encoding in ("utf-16", *ENCODINGS) if marked else ENCODINGS:
            try:
                text = raw.decode(encoding)
                break
            except UnicodeError:
                continue
        return cls.from_json(text, fix) if path.endswith(".json") else cls.parse(text)


def store_sorted(df: DataFrame, path: str, by: list[str], files: int | None = None) -> DataFrame:
    """``df`` written in the order of ``by``: a secondary index for lookups of a prefix of it, as each file and row group then
    has a narrow range of values, and a scan skips all others by their statistics.  Bind a predicate to it like to any table."""
    spark = df.sparkSession
    count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(count, *by).sortWithinPartitions(*by).write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _generated(p: Predicate) -> list[Constraint]:
    from credence.plans.macros import type_constraints

    return type_constraints(p)


def _note_json(n: Note) -> dict:
    return {k: moment_text(v) if isinstance(v, datetime) else v for k, v in vars(n).items() if v is not None}


def _note(row: dict) -> Note:
    keep = {k: row[k] for k in ("b", "d", "src", "et", "vf", "vt", "name", "description") if row.get(k) is not None}
    return Note(**{k: parse_moment(v) if k in ("et", "vf", "vt") else v for k, v in keep.items()})


def _arg_json(a: Var | Const) -> dict:
    if isinstance(a, Var):
        return {"kind": "var", "name": a.name}
    v = a.value
    if isinstance(v, datetime):
        v = moment_text(v)
    elif isinstance(v, date):
        v = v.isoformat()
    elif isinstance(v, timedelta):
        v = duration_text(v)
    return {"kind": a.form, "value": v}


def _arg(row: dict) -> Var | Const:
    if row["kind"] == "var":
        return Var(row["name"])
    read = {"date": date.fromisoformat, "datetime": parse_moment, "duration": parse_duration, "float": float}.get(row["kind"], lambda v: v)
    return Const(read(row["value"]), row["kind"])


def _atom_json(a: Atom) -> dict:
    return {"pred": a.pred, "args": list(map(_arg_json, a.args))}


def _atom(row: dict) -> Atom:
    return Atom(row["pred"], tuple(map(_arg, row["args"])))


def _goal_json(g: AnyGoal) -> dict:
    if isinstance(g, Builtin):
        return {"kind": "builtin", "name": g.name, "args": list(map(_arg_json, g.args))}
    if isinstance(g, Assume):
        return {"kind": "assume", "atoms": list(map(_atom_json, g.atoms))}
    return {"kind": "atom", "negated": g.negated, "atom": _atom_json(g.atom)}


def _goal(row: dict) -> AnyGoal:
    if row["kind"] == "builtin":
        return Builtin(row["name"], tuple(map(_arg, row["args"])))
    if row["kind"] == "assume":
        return Assume(tuple(map(_atom, row["atoms"])))
    return Goal(_atom(row["atom"]), row.get("negated", False))


def _fixed(row: dict) -> dict:
    from credence.functions.builtins import ARITY

    def arg(a: dict) -> dict:
        if "kind" in a:
            return a
        if "name" in a:
            return {"kind": "var", **a}
        v = a.get("value")
        form = "int" if isinstance(v, int) else "float" if isinstance(v, float) else "entity" if str(v)[:1].islower() else "string"
        return {"kind": form, **a}

    def atom(a: dict) -> dict:
        return {**a, "args": list(map(arg, a.get("args", [])))}

    def goal(g: dict) -> dict:
        kind = g.get("kind") or ("builtin" if g.get("name") in ARITY else "assume" if "atoms" in g else "atom")
        body = {"args": list(map(arg, g["args"]))} if kind == "builtin" else {"atoms": list(map(atom, g["atoms"]))} if kind == "assume" else {"atom": atom(g["atom"])}
        return {**g, "kind": kind, **body}

    kind = row.get("kind") or ("rule" if "head" in row else "fact" if "atom" in row else "constraint" if "goals" in row else "predicate")
    out = {**row, "kind": kind}
    if "head" in row:
        out["head"] = atom(row["head"])
    if "atom" in row:
        out["atom"] = atom(row["atom"])
    if "goals" in row:
        out["goals"] = list(map(goal, row["goals"]))
    return out
