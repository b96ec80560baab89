"""Queries of problem 1: raw sequences to flat tables of sequences, events and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrail.functions.times import coerce_ts
from sentrail.operators.shred import read_mapping, shred
from sentrail.session import table

UNWRAP = ("record",)


def _shredded(spark: SparkSession, d: str, keep: dict[str, tuple[str, ...] | None]) -> DataFrame:
    raw = table(spark, d, "raw_sequences").select("record_id", "payload")
    return shred(raw, "record_id", "payload", read_mapping(raw, "record_id", "payload", UNWRAP), UNWRAP, keep, "events")


def _col(name: str) -> Column:
    return F.try_element_at(F.col("cols"), F.lit(name))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records are shredded once; one exchange on the record brings each item its event and sequence."""
    rows = _shredded(spark, d, {"root": ("seq_id",), "events": ("event_id",), "attachments": ()})
    is_event, is_item = F.col("tab") == "events", F.col("tab") == "attachments"
    own = rows.select(
        F.col("source_id").alias("record_id"), "root_node", is_item.alias("is_item"),
        F.when(is_event, F.col("node")).when(is_item & F.col("under_node").isNotNull(), F.col("under_node")).otherwise(-1).alias("event_node"),
        F.when(F.col("tab") == "root", _col("seq_id")).alias("seq_id"), F.when(is_event, F.col("record_pos")).alias("event_pos"), F.when(is_event, F.coalesce(_col("event_id"), F.lit(""))).alias("event_id"),
        F.when(is_item, F.col("under_pos")).otherwise(-1).alias("item_pos"),
    ).repartition("record_id")
    whole, event = Window.partitionBy("record_id", "root_node"), Window.partitionBy("record_id", "root_node", "event_node")
    named = own.select("record_id", "event_node", F.max("seq_id").over(whole).alias("seq_id"), F.max("event_pos").over(event).alias("event_pos"), F.max("event_id").over(event).alias("event_id"), "item_pos")
    return named.filter("event_node >= 0").drop("event_node")


def p1_sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = _shredded(spark, d, {"root": None})
    return rows.select(F.col("source_id").alias("record_id"), "node", *[_col(c).alias(c) for c in ("seq_id", "vm_id", "user_role", "channel", "label", "difficulty", "ground_truth")])


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    rows = _shredded(spark, d, {"events": None})
    return rows.select(
        F.col("source_id").alias("record_id"), "node", "root_node", "parent_tab", "parent_node", F.col("record_pos").alias("event_pos"),
        *[_col(c).alias(c) for c in ("event_id", "vm_id", "user_role", "event_type", "action", "target", "sensitivity_level")],
        coerce_ts(_col("timestamp")).alias("event_time"), _col("metadata.scenario_id").alias("scenario_id"), _col("metadata.step").try_cast("int").alias("step"),
    )


def p1_attachments(spark: SparkSession, d: str) -> DataFrame:
    rows = _shredded(spark, d, {"attachments": None})
    return rows.select(F.col("source_id").alias("record_id"), "node", "root_node", F.coalesce("under_node", "parent_node").alias("event_node"), F.coalesce("under_pos", "pos").alias("item_pos"), _col("name").alias("name"), _col("bytes").try_cast("long").alias("bytes"), _col("origin.host").alias("origin_host"))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the mapping as it is: keys, the parent's, and the inlined columns as JSON text."""
    return _shredded(spark, d, {name: None}).select(F.col("source_id").alias("record_id"), "node", "root_node", "parent_tab", "parent_node", "pos", F.to_json("cols").alias("fields"))


def p1_tags(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "tags")


def p1_path(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "path")


def p1_stages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "stages")


def p1_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that give no rows, with the reason."""
    return _shredded(spark, d, {"_rejected": None}).select(F.col("source_id").alias("record_id"), _col("reason").alias("reason"))


QUERIES = {"p1_tags": p1_tags, "p1_path": p1_path, "p1_stages": p1_stages, "p1_rejected": p1_rejected, "p1_found": p1_found, "p1_sequences": p1_sequences, "p1_events": p1_events, "p1_attachments": p1_attachments}
ORACLES: dict[str, str] = {}
