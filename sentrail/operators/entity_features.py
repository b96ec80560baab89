"""One row per machine with count, recency and totals for every event type and level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.functions.canon import LEVELS, level_key, machine_key, type_key
from sentrail.operators.bitslice import entity_cells
from sentrail.operators.ordinals import counted_ordinals
from sentrail.session import broadcast_if_small, cut

_LEVELS = (*LEVELS, "none")


def feature_cells(events: DataFrame, machines: DataFrame, catalog: DataFrame, start: str = "2024-01-01", end: str = "2024-02-01") -> DataFrame:
    """vm_id, event_type, sensitivity_level, n_events, total_steps, last_seen of every cell that is not empty.

    Each event_id counts once: only deliveries with a known machine, a known type and a time in
    [start, end) are used; where such deliveries of one event_id differ, the smallest feature cell and the
    earliest time hold. Null event_ids can't be told apart and are dropped. total_steps adds
    metadata['step'] (missing, negative or unreadable: 0). Spelling is folded on every side; extra columns are ignored.
    """
    entities, n_entities = counted_ordinals(machines.select(F.col("vm_id").alias("vm_name")).dropna().distinct(), "vm_name")
    by_key = entities.select(machine_key(F.col("vm_name")).alias("vm_key"), "ordinal").dropna().groupBy("vm_key").agg(F.min("ordinal").alias("ordinal"))
    types, n_types = counted_ordinals(catalog.select(F.col("event_type").alias("type_name")).dropna().distinct(), "type_name", "type_no")
    type_by_key = types.select(type_key(F.col("type_name")).alias("type_key"), "type_no").dropna().groupBy("type_key").agg(F.min("type_no").alias("type_no"))
    ts = F.col("timestamp")
    step = F.coalesce(F.element_at(F.col("metadata"), F.lit("step")).try_cast("long"), F.lit(0)) if "metadata" in events.columns else F.lit(0).cast("long")
    level_no = F.coalesce(F.substring(level_key(F.col("spelling")), 2, 1).cast("int") - 1, F.lit(len(LEVELS)))
    machine_of, type_of, level_of = spelling_keys(
        events, ["vm_id", "event_type", "sensitivity_level"],
        [
            lambda df: df.withColumn("vm_key", machine_key(F.col("spelling"))).join(broadcast_if_small(by_key, n_entities), "vm_key").select("spelling", "ordinal"),
            lambda df: df.withColumn("type_key", type_key(F.col("spelling"))).join(broadcast_if_small(type_by_key, n_types), "type_key").select("spelling", "type_no"),
            lambda df: df.select("spelling", level_no.alias("level_no")),
        ],
    )
    timed = events.filter(F.col("event_id").isNotNull() & (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")))
    plain = timed.select("event_id", "vm_id", "event_type", "sensitivity_level", F.unix_seconds(ts).alias("ts"), F.greatest(step, F.lit(0)).alias("measure"))
    rows = plain.join(machine_of.withColumnRenamed("spelling", "vm_id"), "vm_id").join(type_of.withColumnRenamed("spelling", "event_type"), "event_type").join(level_of.withColumnRenamed("spelling", "sensitivity_level"), "sensitivity_level", "left")
    rows = rows.select("event_id", "ordinal", "type_no", F.coalesce("level_no", F.lit(len(LEVELS))).alias("level_no"), "ts", "measure")
    packed = F.shiftleft(F.col("type_no"), 43) + F.shiftleft(F.col("level_no").cast("long"), 40) + F.col("ordinal")
    once = rows.groupBy("event_id").agg(F.min(packed).alias("packed"), F.min("ts").alias("ts"), F.min("measure").alias("measure"))
    cells = entity_cells(once.select(F.shiftright("packed", 40).cast("int").alias("cell"), F.col("packed").bitwiseAND(F.lit((1 << 40) - 1)).alias("ordinal"), "ts", "measure"))
    return (
        cells.join(broadcast_if_small(entities, n_entities), "ordinal")
        .join(broadcast_if_small(types, n_types), F.shiftright("cell", 3) == F.col("type_no"))
        .select(F.col("vm_name").alias("vm_id"), F.col("type_name").alias("event_type"), F.element_at(F.array(*map(F.lit, _LEVELS)), F.col("cell").bitwiseAND(7) + 1).alias("sensitivity_level"), "n_events", F.col("total").alias("total_steps"), "last_seen")
    )


def spelling_keys(df: DataFrame, columns: list[str], keys: list[Callable[[DataFrame], DataFrame]]) -> list[DataFrame]:
    """Per column a table of its distinct spellings with what keys[i] adds to them (spellings may drop out).

    Spellings are far fewer than rows, so folding them once spares every row the patterns. They are gathered
    in one pass, combined in each task, and broadcast if they are counted to be few; else Spark shuffles.
    """
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("spelling")) for i, c in enumerate(columns)])
    known = cut(df.select(F.explode(every).alias("e")).select("e.*").dropna().distinct())
    return [broadcast_if_small(cut(add(known.filter(F.col("i") == i).select("spelling")))) for i, add in enumerate(keys)]


def feature_table(cells: DataFrame, machines: DataFrame) -> DataFrame:
    """One row per machine: totals, latest time, and maps of counts and latest times by type and by level.

    Machines without events have zero counts and empty maps. A machine holds at most one entry per type
    of the catalog and level, which bounds the maps.
    """
    kind = F.when(F.grouping("event_type") == 0, "type").otherwise("level")
    by = cells.groupBy("vm_id", "event_type", "sensitivity_level").agg(F.sum("n_events").alias("n"), F.sum("total_steps").alias("s"), F.max("last_seen").alias("t"))
    by = by.groupingSets([["vm_id", "event_type"], ["vm_id", "sensitivity_level"]], "vm_id", "event_type", "sensitivity_level").agg(kind.alias("kind"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("t").alias("t"))
    by = by.withColumn("name", F.coalesce("event_type", "sensitivity_level"))

    def as_map(which: str, value: str) -> F.Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == which, F.struct("name", value)))))

    wide = by.groupBy("vm_id").agg(
        F.sum(F.when(F.col("kind") == "type", F.col("n"))).alias("n_events"),
        F.sum(F.when(F.col("kind") == "type", F.col("s"))).alias("total_steps"),
        F.max("t").alias("last_seen"),
        as_map("type", "n").alias("count_by_type"),
        as_map("type", "t").alias("last_by_type"),
        as_map("level", "n").alias("count_by_level"),
    )
    base = machines.select("vm_id").dropna().distinct()
    return base.join(wide, "vm_id", "left").withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "total_steps": F.coalesce("total_steps", F.lit(0))})
