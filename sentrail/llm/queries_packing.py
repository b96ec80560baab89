"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.llm.packing import curve_places, pack
from sentrail.session import cut, table

CAPACITY = 2048


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its container."""
    return pack(curve_places(table(spark, d, "documents"), "doc_id", "text"), "doc_id", CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packed(spark, d).filter("n_pieces > 1 AND piece_no = 0").select("doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their fill and the unused share."""
    by = p7_packed(spark, d).filter("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return by.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.round(1 - F.sum("n") / (F.count(F.lit(1)) * CAPACITY), 4).alias("unused_share"))


def p7_nearness(spark: SparkSession, d: str) -> DataFrame:
    """How far apart the texts of one container lie in the curve's order, and how far in a random order."""
    places = curve_places(table(spark, d, "documents"), "doc_id", "text").filter("n_tokens > 0")
    places = cut(places)
    packed = pack(places, "doc_id", CAPACITY).filter("n_tokens < 2048").select("doc_id", "container")
    # Places count from a sort over ranges, whose starts are summed up; no task holds all texts.
    ranged = cut(places.repartitionByRange(16, "place", "doc_id").sortWithinPartitions("place", "doc_id").withColumn("part", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id() % (1 << 33)))
    starts, at = {}, 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        starts[part], at = at, at + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv]), F.col("part"))
    numbered = ranged.select("doc_id", (start + F.col("no")).alias("at"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40) * at).alias("chance"))
    spans = packed.join(numbered, "doc_id").groupBy("container").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at")).alias("span"), (F.max("chance") - F.min("chance")).alias("by_chance")).filter("n > 1")
    return spans.agg(F.count(F.lit(1)).alias("n_containers"), F.percentile_approx("span", 0.5).alias("median_span"), F.percentile_approx("by_chance", 0.5).cast("long").alias("median_span_by_chance"))


QUERIES = {"p7_found": p7_found, "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_nearness": p7_nearness}
ORACLES: dict[str, str] = {}
