"""Atoms, goals, rules, constraints, facts and queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime

from credence.functions.semantics import Semantics
from credence.functions.values import Const, moment_text

Signature = tuple[str, int]


@dataclass(frozen=True)
class Var:
    name: str

    def render(self) -> str:
        return "_" if self.name.startswith("_anon") else self.name


Arg = Var | Const


@dataclass(frozen=True)
class Note:
    """The annotation of a statement."""

    b: float = 1.0
    d: float = 0.0
    src: str | None = None
    et: datetime | None = None
    vf: datetime | None = None
    vt: datetime | None = None
    name: str | None = None
    description: str | None = None

    def __post_init__(self):
        for key in ("b", "d"):
            if not 0 <= getattr(self, key) <= 1:
                raise ValueError(f"{key} must be between 0 and 1, not {getattr(self, key)}")

    def render(self) -> str:
        parts = [f"b:{float(self.b)!r}", f"d:{float(self.d)!r}"]
        for key in ("src", "et", "vf", "vt", "name", "description"):
            v = getattr(self, key)
            if isinstance(v, datetime):
                parts.append(f'{key}:"{moment_text(v)}"')
            elif v is not None:
                parts.append(f"{key}:{Const(v, 'string').render()}")
        return "@{" + ", ".join(parts) + "}"


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[Arg, ...]

    @property
    def signature(self) -> Signature:
        return self.pred, len(self.args)

    def variables(self) -> Iterator[str]:
        return (a.name for a in self.args if isinstance(a, Var))

    def render(self) -> str:
        return f"{self.pred}({', '.join(a.render() for a in self.args)})"


@dataclass(frozen=True)
class Goal:
    atom: Atom
    negated: bool = False

    def render(self) -> str:
        return ("not " if self.negated else "") + self.atom.render()


@dataclass(frozen=True)
class Builtin:
    name: str
    args: tuple[Arg, ...]

    def render(self) -> str:
        return f"{self.name}({', '.join(a.render() for a in self.args)})"


@dataclass(frozen=True)
class Assume:
    atoms: tuple[Atom, ...]

    def render(self) -> str:
        return f"assume({', '.join(a.render() for a in self.atoms)})"


AnyGoal = Goal | Builtin | Assume


@dataclass(frozen=True)
class Fact:
    atom: Atom
    note: Note

    def render(self) -> str:
        return f"{self.atom.render()} {self.note.render()}"


@dataclass(frozen=True)
class Rule:
    head: Atom
    goals: tuple[AnyGoal, ...]
    note: Note

    def render(self) -> str:
        return f"{self.head.render()} :- {', '.join(g.render() for g in self.goals)} {self.note.render()}"


@dataclass(frozen=True)
class Constraint:
    goals: tuple[AnyGoal, ...]
    note: Note

    def render(self) -> str:
        return f"!:- {', '.join(g.render() for g in self.goals)} {self.note.render()}"


@dataclass(frozen=True)
class Predicate:
    name: str
    arity: int
    types: tuple[str, ...] = ()
    description: str | None = None
    declared: bool = False

    def render(self) -> str:
        types = f" [{', '.join(self.types)}]" if self.types and set(self.types) != {"entity"} else ""
        note = f" @{{description:{Const(self.description, 'string').render()}}}" if self.description else ""
        return f"pred {self.name}/{self.arity}{types}{note}"


@dataclass(frozen=True)
class Options:
    query_time: datetime | None = None
    valid_at: datetime | None = None
    known_at: datetime | None = None
    semantics: Semantics = field(default_factory=Semantics)
    limit: int | None = None
    offset: int = 0
    order_by: tuple[str, ...] = ()
    max_depth: int = 24
    explain: str = "false"
    focus: str = "all"

    def __post_init__(self):
        if self.limit is not None and self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset can't be negative")
        if self.max_depth < 1:
            raise ValueError("max_depth must be positive")
        if self.focus not in ("all", "support", "disbelief", "contradiction", "ignorance"):
            raise ValueError(f"Unknown focus: {self.focus!r}")
        if self.explain not in ("false", "true", "human"):
            raise ValueError(f"Invalid explain mode: {self.explain!r}")

    def with_(self, **changes) -> Options:
        return replace(self, **changes)


@dataclass(frozen=True)
class Query:
    goals: tuple[AnyGoal, ...]
    options: Options = field(default_factory=Options)

    def variables(self) -> list[str]:
        """The projected variables, as they come."""
        seen: dict[str, None] = {}
        for g in self.goals:
            for a in () if isinstance(g, Assume) else g.args if isinstance(g, Builtin) else g.atom.args:
                if isinstance(a, Var) and not a.name.startswith("_anon"):
                    seen[a.name] = None
        return list(seen)
