"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.llm.winnow import leaked_passages
from sentrail.session import table


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Each document with each passage it holds, and how much of it."""
    return leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which passages leaked: into how many documents by 45 % or more, into how many by a fifth or more, how fully."""
    hits = leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage", 0.2)
    return hits.groupBy("item_id").agg(F.count_if(F.col("share") >= 0.45).alias("n_docs"), F.count_if(F.col("share") < 0.45).alias("n_partly"), F.max("share").alias("most"))


QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_items": p8_items}
ORACLES: dict[str, str] = {}
