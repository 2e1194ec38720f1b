"""Answers: body rows grouped by the projected variables, then focus, order, offset and limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.semantics import EPS, focus_metric, status
from credence.functions.values import Val, group_key, python_value, to_term, whole
from credence.operators.evaluate import Evaluator
from credence.plans.model import Options

#: Type names, in the order in which they sort.
_RANK = {"date": 0, "datetime": 1, "ntz": 1, "float": 2, "int": 3, "str": 4, "dur": 5}


def sort_keys(v: Val) -> list[Column]:
    """By type name, then by value; a missing value last."""
    if v.kind == "term":
        rank = F.coalesce(*[F.when(v.col["tag"] == t, n) for t, n in _RANK.items()])
        return [v.col.isNull(), rank, v.col["txt"], v.col["num"], v.col["us"]]
    # a column of one type needs no rank, and a literal would be taken for a column's position
    rank = [F.when(whole(v.col), _RANK["int"]).otherwise(_RANK["float"])] if v.kind == "num" else []
    return [v.col.isNull(), *rank, v.col]


@dataclass(frozen=True)
class Answers:
    """``df`` has a column for each variable, then b, d and status."""

    df: DataFrame
    variables: list[str]
    kinds: list[str]

    def rows(self) -> list[tuple[dict[str, object], float, float, str]]:
        """Collected: bindings as Python values, b, d and status."""
        n = len(self.variables)
        return [({v: python_value(x, k) for v, x, k in zip(self.variables, r, self.kinds, strict=False)}, r[n], r[n + 1], r[n + 2]) for r in self.df.collect()]

    def plain(self) -> DataFrame:
        """``df`` with durations as intervals."""
        cols = [F.col(f"`{c}`") for c in self.df.columns]
        for i, k in enumerate(self.kinds):
            if k == "dur":
                cols[i] = F.make_dt_interval(secs=(cols[i] / F.lit(1_000_000)).cast("decimal(18,6)")).alias(self.variables[i])
        return self.df.select(*cols)


def answer(ev: Evaluator, variables: list[str], options: Options) -> Answers:
    body = ev.body(ev.goals, ev._provide(), split=True)
    names = [v for v in variables if v in body.env] if not body.dead else []
    vals = [body.env[v] for v in names]
    cols = [v.col.alias(f"v{i}") for i, v in enumerate(vals)]
    rows = body.df.select(*cols, body.b.alias("b"), body.d.alias("d"))
    s = ev.semantics
    weights = (s.aggregate(F.col("b")).alias("b"), s.aggregate(F.col("d")).alias("d"))
    held = [Val(F.col(f"v{i}"), v.kind) for i, v in enumerate(vals)]
    if names and body.unique and set(body.env) <= set(names):
        out = rows  # a row for each answer already
    elif names:
        keys = [group_key(v).alias(f"k{i}") for i, v in enumerate(held)]
        terms = [F.min(f"v{i}").alias(f"v{i}") for i, v in enumerate(vals) if v.kind == "term"]
        grouped = rows.groupBy(*keys).agg(*terms, *weights)
        out = grouped.select(*[F.col(f"v{i}") if v.kind == "term" else F.col(f"k{i}").alias(f"v{i}") for i, v in enumerate(vals)], "b", "d")
    elif variables:  # no row can bind them
        out = rows.filter(F.lit(False)).select(*[F.lit(None).cast("string").alias(f"v{i}") for i in range(len(variables))], "b", "d")
        names, vals, held = variables, [Val(F.lit(None), "str")] * len(variables), [Val(F.col(f"v{i}"), "str") for i in range(len(variables))]
    else:  # closed: one row, of nothing if nothing matches
        out = rows.agg(*weights)
    out = out.withColumn("status", status(F.col("b"), F.col("d")))

    metric = focus_metric(options.focus, F.col("b"), F.col("d"))
    if metric is not None:
        out = out.filter(metric > EPS)
    elif options.focus == "ignorance":
        out = out.filter((F.col("b") <= EPS) & (F.col("d") <= EPS))
    order = [k for name in options.order_by if name in names for k in sort_keys(held[names.index(name)])]
    if metric is not None:
        order.append(metric.desc())
    cut = options.limit is not None or options.offset
    if order or cut:
        # a total order, so that offset and limit always take the same rows
        order += [k for v in held for k in sort_keys(v)] if cut else []
        out = out.orderBy(*order) if order else out
    if options.offset:
        out = out.offset(options.offset)
    if options.limit is not None:
        out = out.limit(options.limit)
    return Answers(out.toDF(*names, "b", "d", "status"), names, [v.kind for v in vals])


def explain(ev: Evaluator) -> DataFrame:
    """Events: facts that hold, rules that apply and what they add, of every predicate that the query reaches."""
    parts = []
    schema = ["event", "pred", "args", "rule", "body_b", "body_d", "applies", "b", "d"]

    def shown(vals: list[Val]) -> Column:
        return F.array(*[to_term(v).getField("key") for v in vals]).cast("array<string>")

    none = F.lit(None).cast("double")
    for p in ev.graph.edges:
        for df in ev._fact_rows(p)[0]:
            vals = [Val(F.col(f"a{i}"), k) for i, k in enumerate(ev.kinds[p])]
            parts.append(df.select(F.lit("fact_support"), F.lit(f"{p[0]}/{p[1]}"), shown(vals), F.lit(None).cast("string"), none, none, none, "b", "d"))
        for r in ev.graph.rules[p]:
            body = ev.body(r.goals, ev._provide())
            if body.dead:
                continue
            head = [Val(c, k) for c, k in zip(ev._head(r, body), ev.kinds[p], strict=True)]
            applies = ev.semantics.rule_applies(body.b, body.d)
            rows = body.df.select(shown(head).alias("args"), body.b.alias("x"), body.d.alias("y"), applies.alias("a"))
            text = F.lit(r.render())
            parts.append(rows.select(F.lit("rule_applicability"), F.lit(f"{p[0]}/{p[1]}"), "args", text, "x", "y", "a", none, none))
            parts.append(rows.filter("a > 0").select(F.lit("rule_support"), F.lit(f"{p[0]}/{p[1]}"), "args", text, "x", "y", "a", F.col("a") * float(r.note.b), F.col("a") * float(r.note.d)))
    parts = [x.toDF(*schema) for x in parts]
    if not parts:
        return ev.spark.createDataFrame([], "event string, pred string, args array<string>, rule string, body_b double, body_d double, applies double, b double, d double")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
