"""Shared reading of operation sequences: one row per sequence, events in order, names folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.functions.canon import fold, folded_target_key, name_key, type_key


FIELDS = ("timestamp", "event_id", "event_type", "action", "target")


def one_per_sequence(sequences: DataFrame, *columns: str) -> DataFrame:
    """Each non-null seq_id once, with the given columns of its smallest row (null columns first).

    Copies are dropped before the shuffle where they meet in one task; a seq_id copied without end
    still sends one row per task.
    """
    return sequences.filter(F.col("seq_id").isNotNull()).groupBy("seq_id").agg(F.min(F.struct(*columns)).alias("_row")).select("seq_id", *[F.col(f"_row.{c}").alias(c) for c in columns])


def slim_events(sequences: DataFrame) -> DataFrame:
    """events reduced to timestamp, event_id, event_type, action, target (an orderable array).

    Written field by field, so the scan reads these fields only.
    """
    return sequences.withColumn("events", F.arrays_zip(*[F.col(f"events.{f}") for f in FIELDS]))


def flat_events(sequences: DataFrame) -> DataFrame:
    """seq_id, timestamp, event_id, base_type, action_key, target_key; events of which all five are null are dropped."""
    rows = sequences.select("seq_id", F.explode("events").alias("e")).filter(F.coalesce(*[F.col(f"e.{f}").cast("string") for f in FIELDS]).isNotNull())
    base = type_key(F.col("e.event_type"))
    typed = rows.select("seq_id", F.col("e.timestamp").alias("timestamp"), F.col("e.event_id").alias("event_id"), base.alias("base_type"), name_key(F.col("e.action")).alias("action_key"), fold(F.col("e.target")).alias("target_fold"))
    return typed.select("seq_id", "timestamp", "event_id", "base_type", "action_key", folded_target_key(F.col("base_type"), F.col("target_fold")).alias("target_key"))
