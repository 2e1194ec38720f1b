"""Prompts that ask a language model for statements or for a query, and the JSON schema of what it may give."""

from __future__ import annotations

import json

from credence.functions.builtins import ARITHMETIC, ARITY, COMPARE, TYPES
from credence.functions.semantics import CHOICES
from credence.sources.kb import KnowledgeBase

_STATEMENTS = """Facts: name(argument, ...) @{b:0.9, d:0.1, src:"where from", et:"when it was learned", vf:"valid from", vt:"valid to"}.
Rules: head(X) :- goal(X, Y), not other(Y), gt(Y, 3) @{b:0.8}.
Constraints, which say what can't be: !:- goal(X), other(X) @{b:1.0}.
Declarations: pred name/2 [type, type] @{description:"what it says"}.
Variables begin with a capital letter and `_` is a new one each time; entities begin with a small letter; strings are in double quotes.
Dates are d"2024-02-29", moments dt"2024-02-29T12:00:00Z", durations dur"P1DT2H". b is belief and d is disbelief, each from 0 to 1 and independent of the other.
Every statement ends with a full stop. A head variable must be bound by the body, and nothing may depend on its own negation."""


def _builtins() -> str:
    named = [("comparisons", COMPARE), ("arithmetic, which solves for any one unknown", ARITHMETIC), ("range", ("between",)), ("type tests", TYPES)]
    return "\n".join(f"{title}: {', '.join(f'{n}/{ARITY[n]}' for n in names)}" for title, names in named)


def _known(kb: KnowledgeBase) -> str:
    lines = [p.render() + "." for p in kb.predicates.values()]
    return "\n".join([*lines, *(r.render() + "." for r in kb.rules)]) or "none"


def extract_prompt(source: str, kb: KnowledgeBase | None = None, as_json: bool = False) -> str:
    """Asks for the statements that a text supports; with ``kb``, for those that it doesn't have yet."""
    parts = ["Read the text and write down what it states, as a program and nothing else.", _STATEMENTS, "Builtin goals\n" + _builtins()]
    if kb is not None:
        parts.append("Use these predicates where they fit, and don't repeat what is there:\n" + _known(kb))
    if as_json:
        parts.append("Answer in JSON of this schema:\n" + json.dumps(schema(), indent=1))
    return "\n\n".join([*parts, "Text\n" + source])


def query_prompt(question: str, kb: KnowledgeBase) -> str:
    """Asks for the query that answers a question on a knowledge base."""
    options = "\n".join(f"{k}: {' | '.join(v)}" for k, v in CHOICES.items())
    form = 'A query is `?- goal(X), not other(X) @{limit:10, offset:0, order_by:"X", focus:support, query_time:"2024-01-01T00:00:00Z", max_depth:24}.`'
    return "\n\n".join(["Write the one query that answers the question, and nothing else.", form, "Predicates and rules\n" + _known(kb), "Builtin goals\n" + _builtins(), "Settings\n" + options, "Question\n" + question])


def schema() -> dict:
    """The JSON schema of a knowledge base."""
    number = {"type": "number", "minimum": 0, "maximum": 1}
    text = {"type": "string"}
    note = {"b": number, "d": number} | {k: text for k in ("src", "et", "vf", "vt", "name", "description")}
    variable = {"type": "object", "required": ["kind", "name"], "properties": {"kind": {"const": "var"}, "name": {"type": "string", "pattern": "^[A-Z_]"}}}
    value = {"type": "object", "required": ["kind", "value"], "properties": {"kind": {"enum": ["entity", "string", "ref", "int", "float", "date", "datetime", "duration"]}, "value": {"type": ["string", "number"]}}}
    atom = {"type": "object", "required": ["pred", "args"], "properties": {"pred": text, "args": {"type": "array", "minItems": 1, "items": {"anyOf": [variable, value]}}}}
    goal = {
        "anyOf": [
            {"type": "object", "required": ["kind", "atom"], "properties": {"kind": {"const": "atom"}, "negated": {"type": "boolean"}, "atom": {"$ref": "#/$defs/atom"}}},
            {"type": "object", "required": ["kind", "name", "args"], "properties": {"kind": {"const": "builtin"}, "name": {"enum": list(ARITY)}, "args": {"type": "array", "items": {"anyOf": [variable, value]}}}},
        ]
    }
    goals = {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/goal"}}
    kinds = {
        "predicate": (["name", "arity"], {"name": text, "arity": {"type": "integer", "minimum": 1}, "types": {"type": "array", "items": text}, "description": {"type": ["string", "null"]}, "declared": {"type": "boolean"}}),
        "fact": (["atom"], {"atom": {"$ref": "#/$defs/atom"}} | note),
        "rule": (["head", "goals"], {"head": {"$ref": "#/$defs/atom"}, "goals": goals} | note),
        "constraint": (["goals"], {"goals": goals} | note),
    }
    items = [{"type": "object", "required": ["kind", *need], "properties": {"kind": {"const": k}} | has} for k, (need, has) in kinds.items()]
    return {"type": "object", "required": ["statements"], "properties": {"name": text, "statements": {"type": "array", "items": {"anyOf": items}}}, "$defs": {"atom": atom, "goal": goal}}
