"""The builtin goals: comparisons, arithmetic that solves for any one unknown, and type tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.functions.values import DAY_US, FAMILY, Val, equal, micros, term, to_term, whole

COMPARE = ("eq", "ne", "lt", "leq", "gt", "geq")
ARITHMETIC = ("add", "sub", "mul", "div")
TYPES = ("int", "string", "float", "entity", "predicate_ref", "date", "datetime", "duration")
ARITY = {**dict.fromkeys(COMPARE, 2), **dict.fromkeys(ARITHMETIC, 3), "between": 3, **dict.fromkeys(TYPES, 1)}
TOLERANCE = 1e-9
TINY = 1e-12
_NUMERIC = ("int", "float", "num")


def ordered(op: str, a: Val, b: Val) -> Column:
    """lt, leq, gt or geq; values of different families compare as false."""
    test = {"lt": lambda x, y: x < y, "leq": lambda x, y: x <= y, "gt": lambda x, y: x > y, "geq": lambda x, y: x >= y}[op]
    if "term" not in (a.kind, b.kind):
        return test(a.col, b.col) if FAMILY[a.kind] == FAMILY[b.kind] else F.lit(False)
    x, y = to_term(a), to_term(b)
    fam = lambda t: F.regexp_extract(t["key"], "^[a-z]+", 0)
    by = F.when(fam(x) == "s", test(x["txt"], y["txt"])).when(fam(x) == "n", test(x["num"], y["num"])).otherwise(test(x["us"], y["us"]))
    return (fam(x) == fam(y)) & by


def compare(op: str, a: Val, b: Val) -> Column:
    if op in ("eq", "ne"):
        same = equal(a, b)
        return same if op == "eq" else ~same
    return ordered(op, a, b)


def between(x: Val, low: Val, high: Val) -> Column:
    """Numbers only, both ends included."""
    for v in (x, low, high):
        if v.kind != "term" and v.kind not in _NUMERIC:
            return F.lit(False)
    number = lambda v: v.col["num"] if v.kind == "term" else v.col
    return F.coalesce(number(x).between(number(low), number(high)), F.lit(False))


def is_type(name: str, v: Val) -> Column:
    if v.kind == "term":
        tag = v.col["tag"]
        return {"int": tag == "int", "float": tag == "float", "date": tag == "date", "datetime": tag.isin("datetime", "ntz"), "duration": tag == "dur"}.get(name, tag == "str")
    if v.kind == "num":
        return whole(v.col) if name == "int" else ~whole(v.col) if name == "float" else F.lit(False)
    wanted = {"int": ("int",), "float": ("float",), "date": ("date",), "datetime": ("datetime", "ntz"), "duration": ("dur",)}.get(name, ("str",))
    return F.lit(v.kind in wanted)


def snapped(x: Column) -> Column:
    """A whole number where it is within TOLERANCE of one."""
    return F.when(F.abs(x - F.round(x)) <= TOLERANCE, F.round(x)).otherwise(x) + F.lit(0.0)


def _number(op: str, a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    if op == "div":
        return F.when(F.abs(y) > TINY, F.try_divide(x, y))
    return {"add": x + y, "sub": x - y, "mul": x * y}[op]


def calculate(op: str, a: Val, b: Val) -> Val | None:
    """``a op b``; a null where it isn't defined, None where it never is."""
    if a.kind in _NUMERIC and b.kind in _NUMERIC:
        return Val(snapped(_number(op, a.col, b.col)), "num")
    if "term" not in (a.kind, b.kind):
        return _temporal(op, a, b)
    x, y = to_term(a), to_term(b)
    tx, ty = x["tag"], y["tag"]
    numbers = tx.isin("int", "float") & ty.isin("int", "float")
    n = snapped(_number(op, x["num"], y["num"]))
    out = F.when(numbers & n.isNotNull(), term(F.when(whole(n), "int").otherwise("float"), num=n))
    if op in ("add", "sub"):
        sign = 1 if op == "add" else -1
        days = F.floor(y["us"] / DAY_US) * DAY_US
        out = out.when((tx == "date") & (ty == "dur"), term(F.lit("date"), us=x["us"] + sign * days))
        out = out.when(tx.isin("datetime", "ntz", "dur") & (ty == "dur"), term(tx, us=x["us"] + sign * y["us"]))
        if op == "add":
            out = out.when((tx == "dur") & (ty == "date"), term(F.lit("date"), us=y["us"] + F.floor(x["us"] / DAY_US) * DAY_US))
            out = out.when((tx == "dur") & ty.isin("datetime", "ntz"), term(ty, us=x["us"] + y["us"]))
        else:
            out = out.when((tx == ty) & tx.isin("date", "datetime", "ntz"), term(F.lit("dur"), us=x["us"] - y["us"]))
    return Val(out, "term")


def _temporal(op: str, a: Val, b: Val) -> Val | None:
    if op not in ("add", "sub"):
        return None
    if op == "add" and a.kind == "dur" and b.kind != "dur":
        a, b = b, a
    if b.kind == "dur":
        by = b.col if op == "add" else -b.col
        if a.kind == "dur":
            return Val(a.col + by, "dur")
        if a.kind == "date":  # only whole days of a duration move a date
            days = F.floor(b.col / DAY_US).cast("int")
            return Val(F.date_add(a.col, days if op == "add" else -days), "date")
        if a.kind in ("datetime", "ntz"):
            return Val(F.timestamp_add("MICROSECOND", by, a.col), a.kind)
        return None
    if op == "sub" and a.kind == b.kind and a.kind in ("date", "datetime", "ntz"):
        return Val(micros(a) - micros(b), "dur")
    return None


#: op -> what gives its first and its second argument from the other one and the result, as (op, left, right).
_INVERSE = {
    "add": (("sub", "c", "b"), ("sub", "c", "a")),
    "sub": (("add", "c", "b"), ("sub", "a", "c")),
    "mul": (("div", "c", "b"), ("div", "c", "a")),
    "div": (("mul", "c", "b"), ("div", "a", "c")),
}


def solve(op: str, a: Val | None, b: Val | None, c: Val | None) -> Val | None:
    """The one unknown of ``a op b = c``."""
    if c is None:
        return calculate(op, a, b)
    how, left, right = _INVERSE[op][0 if a is None else 1]
    have = {"a": a, "b": b, "c": c}
    found = calculate(how, have[left], have[right])
    if found is not None and op == "div" and a is None:  # x / 0 = c has no solution
        known = to_term(b)["num"]
        col = F.when(F.abs(known) > TINY, found.col)
        return Val(col, found.kind)
    return found


def holds(op: str, a: Val, b: Val, c: Val) -> Column:
    """Whether ``a op b = c``: numbers within TOLERANCE, others exactly."""
    found = calculate(op, a, b)
    if found is None:
        return F.lit(False)
    if found.kind == "num":
        if c.kind not in (*_NUMERIC, "term"):
            return F.lit(False)
        given = c.col["num"] if c.kind == "term" else c.col.cast("double")
        return F.coalesce(F.abs(found.col - given) <= TOLERANCE, F.lit(False))
    if found.kind == "term":
        given = to_term(c)
        near = F.abs(found.col["num"] - given["num"]) <= TOLERANCE
        return F.coalesce(near, found.col["key"] == given["key"], F.lit(False))
    return F.coalesce(equal(found, c), F.lit(False))
