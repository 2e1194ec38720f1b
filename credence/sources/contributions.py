"""Contributions to atoms by evidence: a table of what was put in and taken back, and the states that follow from it.

A contribution is an atom, an evidence id and weights.  Putting one in under an id that the atom has already replaces it; taking it
back leaves the others.  The table is only appended to, so any earlier state can be read by a version, and a state is one grouped
pass over the latest row of each evidence.  Under ``maximum`` evidence isn't told apart: weights only ever grow, and
nothing can be taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions.semantics import Semantics, status
from credence.functions.values import TERM, from_spark, to_term
from credence.plans.model import Signature
from credence.sources.kb import KnowledgeBase

SCHEMA = T.StructType(
    [T.StructField("pred", T.StringType()), T.StructField("arity", T.IntegerType()), T.StructField("args", T.ArrayType(TERM)), T.StructField("atom", T.StringType()), T.StructField("evidence", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in "bd"]
    + [T.StructField("gone", T.BooleanType()), T.StructField("version", T.LongType())]
)


class Contributions:
    """One writer at a time; a batch of rows is one version."""

    def __init__(self, spark: SparkSession, path: str, semantics: Semantics | None = None):
        self.spark, self.path, self.semantics = spark, path, semantics or Semantics()

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def version(self) -> int:
        return self.rows().agg(F.max("version")).first()[0] or 0

    def _append(self, df: DataFrame, pred: str, args: list[str], evidence: str | Column, b: Column, d: Column, gone: bool) -> int:
        version = self.version() + 1
        terms = [to_term(from_spark(F.col(a), df.schema[a].dataType)).cast(TERM) for a in args]
        named = F.col(evidence) if isinstance(evidence, str) else evidence
        made = df.dropna(subset=args).select(
            F.lit(pred).alias("pred"), F.lit(len(args)).alias("arity"), F.array(*terms).alias("args"), F.concat_ws("\x1f", *[t.getField("key") for t in terms]).alias("atom"),
            named.cast("string").alias("evidence"), b.cast("double").alias("b"), d.cast("double").alias("d"), F.lit(gone).alias("gone"), F.lit(version).cast("long").alias("version"),
        )
        made.write.mode("append").parquet(self.path)
        return version

    def upsert(self, df: DataFrame, pred: str, args: list[str], evidence: str | Column, b: str | float = 1.0, d: str | float = 0.0) -> int:
        """Put in a row's contribution for each row of ``df``; returns the version.  Of rows with the same atom and evidence the largest weights count."""
        weight = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if isinstance(c, str) else F.lit(float(c))
        return self._append(df, pred, args, evidence, weight(b), weight(d), False)

    def retract(self, df: DataFrame, pred: str, args: list[str], evidence: str | Column) -> int:
        """Take back the contributions that rows name; unknown ones do no harm."""
        return self._append(df, pred, args, evidence, F.lit(None), F.lit(None), True)

    def states(self, p: Signature, version: int | None = None, semantics: Semantics | None = None) -> DataFrame:
        """a0 ..., b, d and status of every atom with any weight, as of a version."""
        s = semantics or self.semantics
        rows = self.rows().filter((F.col("pred") == p[0]) & (F.col("arity") == p[1]))
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        if s.support_aggregation != "maximum":
            # the latest of each evidence, by a partial aggregate in every map task
            latest = F.max(F.struct("version", F.col("gone").alias("g"), F.col("b").alias("x"), F.col("d").alias("y"))).alias("last")
            rows = rows.groupBy("atom", "evidence").agg(latest, F.min("args").alias("args")).filter("not last.g").select("atom", "args", F.col("last.x").alias("b"), F.col("last.y").alias("d"))
        made = rows.groupBy("atom").agg(F.min("args").alias("args"), s.aggregate(F.col("b")).alias("b"), s.aggregate(F.col("d")).alias("d")).filter("b > 0 or d > 0")
        return made.select(*[F.get("args", F.lit(i)).alias(f"a{i}") for i in range(p[1])], "b", "d", status(F.col("b"), F.col("d")).alias("status"))

    def bind(self, kb: KnowledgeBase, p: Signature, version: int | None = None) -> KnowledgeBase:
        """Make the states facts of a knowledge base."""
        df = self.states(p, version)
        return kb.bind(p[0], df, [f"a{i}" for i in range(p[1])], b="b", d="d", distinct=True)
