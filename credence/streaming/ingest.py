"""Facts that arrive as a stream, appended to the event log batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from credence.functions.values import Val, at_moment, from_spark, iso_text
from credence.sources.log import EventLog


#: The form of an argument in the log, by the kind of its column.
_FORM = {"str": "string", "int": "int", "float": "float", "date": "date", "datetime": "datetime", "ntz": "datetime", "dur": "duration"}


def _argument(c: str, t: T.DataType) -> Column:
    """A column as an argument of the log, in JSON."""
    v = from_spark(F.col(c), t)
    if v.kind not in _FORM:
        raise TypeError(f"{c} can't be an argument of the log")
    value = v.col if v.kind in ("str", "int", "float") else iso_text(v)
    return F.to_json(F.struct(F.lit(_FORM[v.kind]).alias("kind"), value.alias("value")))


def as_assertions(df: DataFrame, branch: str, pred: str, args: list[str], b: str | float = 1.0, d: str | float = 0.0, et: str | None = None) -> DataFrame:
    """Rows of ``df`` as assert events of ``pred``; arguments keep their types, and times without a zone are UTC.

    A row with a null argument is no fact and gives no event.  A null ``et`` is left out, so such a fact is always known.
    """
    weight = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if isinstance(c, str) else F.lit(float(c))
    when = at_moment(F.col(et), df.schema[et].dataType) if et else F.current_timestamp()
    terms = [_argument(a, df.schema[a].dataType) for a in args]
    rest = F.to_json(F.struct(weight(b).alias("b"), weight(d).alias("d"), iso_text(Val(when, "datetime")).alias("et")))
    name = F.lit(json.dumps(pred))
    payload = F.concat(F.lit('{"kind":"fact","atom":{"pred":'), name, F.lit(',"args":['), F.concat_ws(",", *terms), F.lit("]},"), F.substring(rest, 2, 1_000_000))
    rows = df.dropna(subset=args)
    return rows.select(F.lit(branch).alias("branch"), F.lit("assert").alias("kind"), F.lit(pred).alias("pred"), F.lit(len(args)).alias("arity"), weight(b).alias("b"), weight(d).alias("d"), when.alias("et"), payload.alias("payload"))


def ingest(stream: DataFrame, log: EventLog, checkpoint: str, branch: str, pred: str, args: list[str], once: bool = False, **weights) -> StreamingQuery:
    """Append a stream's rows to the log.  A batch that is retried after its append would be appended again,
    so each event carries the batch it came with and a batch that is there is skipped."""

    def take(batch: DataFrame, number: int) -> None:
        tag = f"{checkpoint}#{number}"
        if log.events().filter(F.col("src") == tag).isEmpty() and not batch.isEmpty():
            log.append(as_assertions(batch, branch, pred, args, **weights).withColumn("src", F.lit(tag)))

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
