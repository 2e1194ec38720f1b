"""The engine: a query over a knowledge base gives a DataFrame of answers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from credence.functions.semantics import CHOICES, Semantics
from credence.operators.answers import Answers, answer, explain
from credence.operators.evaluate import Evaluator
from credence.plans import syntax
from credence.plans.model import Query
from credence.sources.kb import KnowledgeBase


@dataclass(frozen=True)
class Result:
    answers: Answers
    times: dict[str, datetime]
    semantics: Semantics
    events: DataFrame | None

    @property
    def df(self) -> DataFrame:
        return self.answers.plain()

    def rows(self) -> list[tuple[dict[str, object], float, float, str]]:
        return self.answers.rows()


class Engine:
    """Evaluates queries; ``capabilities`` are the semantics settings it has, which is all there are."""

    capabilities = CHOICES

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def evaluate(self, kb: KnowledgeBase, query: Query | str) -> Result:
        q = syntax.query(query) if isinstance(query, str) else query
        ev = Evaluator(self.spark, kb, q.goals, q.options)
        found = answer(ev, q.variables(), q.options)
        return Result(found, ev.times, ev.semantics, explain(ev) if q.options.explain != "false" else None)
