"""Queries of problem 5."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.functions.canon import name_key, type_key
from sentrail.llm.sequences import one_per_sequence, slim_events
from sentrail.llm.subsequences import frequent_subsequences
from sentrail.session import table

SHARE = Fraction(1, 20)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """label, seq_id and its steps event_type:action in the order of time, then event_id."""
    rows = slim_events(table(spark, d, "op_sequences").select("seq_id", "label", "events")).withColumn("label", name_key(F.col("label"))).filter("label IS NOT NULL")
    once = one_per_sequence(rows.withColumn("seq_id", F.struct("label", "seq_id")).filter("seq_id.seq_id IS NOT NULL"), "events")
    ordered = F.array_sort("events")
    step = F.transform(ordered, lambda e: F.concat(type_key(e["event_type"]), F.lit(":"), name_key(e["action"])))
    return once.select("seq_id.label", "seq_id.seq_id", step.alias("steps"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = frequent_subsequences(_steps(spark, d), "seq_id", "label", "steps", SHARE)
    return found.select("label", F.array_join("pattern", ">").alias("pattern"), "support")


QUERIES = {"p5_found": p5_found}
ORACLES: dict[str, str] = {}
