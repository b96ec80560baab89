"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrail.llm.residue import residue, train
from sentrail.session import table


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue: flagged segments, highest score and an example."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return residue(docs, "doc_id", "text", train(docs, "text", "source"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).select("doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without residue."""
    return table(spark, d, "documents").join(p9_found(spark, d), "doc_id", "left_anti").select("doc_id", "n_chars", "doc_type")


def p9_validation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the decision of p9_found, by segment, against the weak labels of unseen sources."""
    held = train(table(spark, d, "documents").select("text", "source"), "text", "source").held_out
    return spark.createDataFrame([(held["segments"], held["precision"], held["recall"])], "segments double, precision double, recall double")


QUERIES = {"p9_found": p9_found, "p9_report": p9_report, "p9_clean": p9_clean, "p9_validation": p9_validation}
ORACLES: dict[str, str] = {}
