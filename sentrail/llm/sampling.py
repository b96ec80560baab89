"""A sample whose categories follow target shares, with minima, and what could not be met.

Per-category reservoirs: every row gets a priority from a hash of its id, and a category's reservoir is
the rows with the smallest priorities. A sample may be a fifth of the corpus, so a reservoir is kept as
its row counts per priority slot: of fixed size, built in one pass and merged by adding. All later steps
read the merged reservoirs: final counts, exhausted categories and feasible quotas, then the slot at which
each reservoir is trimmed to its quota; rows below that slot are drawn whole and only the slot is ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrail.session import cut

#: Three hexadecimal digits.
SLOTS = 4096


def _priority(row_id: str, seed: int) -> Column:
    """A hash in text that any engine can compute, in its order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def _slot(priority: Column) -> Column:
    """The leading 12 bits of the priority, 0 to 4095, in the priority's order."""
    return F.conv(F.substring(priority, 1, 3), 16, 10).cast("int")


def reservoirs(rows: DataFrame, row_id: str, keys: list[str], seed: int = 42) -> DataFrame:
    """keys, slot, n: the merged reservoirs, at most SLOTS rows a category, computed once.

    rows has unique row_ids; rows with a null id are dropped. Counts are combined in each task before they
    are merged, so a category with a third of all rows sends SLOTS counts a task. Empty in, empty out.
    """
    return cut(rows.filter(F.col(row_id).isNotNull()).groupBy(*keys, _slot(_priority(row_id, seed)).alias("slot")).agg(F.count(F.lit(1)).alias("n")))


def size_of(merged: DataFrame) -> int:
    """Rows that went into the reservoirs."""
    return merged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def quota_report(merged: DataFrame, targets: DataFrame, keys: list[str], share_bp: str, minimum: str, sample_size: int) -> DataFrame:
    """Per target category: available rows, wanted = ceil(max(minimum, share of sample_size)), taken, shortfall, met.

    merged has the reservoirs. Categories without a reservoir have 0 rows; a null share or minimum counts as 0.
    """
    have = merged.groupBy(*keys).agg(F.sum("n").alias("available"))
    share = F.coalesce(F.col(share_bp), F.lit(0)).cast("long") * F.lit(sample_size)
    wanted = F.greatest(F.coalesce(F.col(minimum).cast("long"), F.lit(0)), F.expr(f"(coalesce({share_bp}, 0) * {int(sample_size)}L + 9999) div 10000"))
    return (
        targets.select(*keys, share_bp, minimum)
        .join(have, keys, "left")
        .select(*keys, share_bp, F.coalesce("available", F.lit(0)).alias("available"), wanted.alias("wanted"), (share / 10000).alias("share_rows"))
        .withColumn("taken", F.least("available", "wanted"))
        .withColumn("shortfall", F.col("wanted") - F.col("taken"))
        .withColumn("met", F.col("available") >= F.col("wanted"))
    )


def draw_sample(rows: DataFrame, merged: DataFrame, report: DataFrame, row_id: str, keys: list[str], seed: int = 42) -> DataFrame:
    """The rows of every category's reservoir after trimming to `taken` of the report.

    rows are those of which the reservoirs `merged` were built, with the same seed; rows of categories
    without a target are not drawn. Ties of priority go by row_id. The same rows and seed always give the
    same sample, however the rows are partitioned.
    """
    marked = rows.filter(F.col(row_id).isNotNull()).withColumn("_p", _priority(row_id, seed)).withColumn("_slot", _slot(F.col("_p")))
    upto = Window.partitionBy(*keys).orderBy("slot")
    cuts = (
        merged.withColumn("_upto", F.sum("n").over(upto))
        .join(report.select(*keys, "taken"), keys)
        .filter(F.col("_upto") - F.col("n") < F.col("taken"))
        .groupBy(*keys)
        .agg(F.max("slot").alias("_last"), F.max_by(F.col("taken") - F.col("_upto") + F.col("n"), "slot").alias("_rest"))
    )
    within = marked.join(cuts, keys).filter(F.col("_slot") <= F.col("_last"))
    whole = within.filter(F.col("_slot") < F.col("_last"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_p", row_id))
    trimmed = within.filter(F.col("_slot") == F.col("_last")).withColumn("_rank", rank).filter("_rank <= _rest").drop("_rank")
    return whole.unionByName(trimmed).drop("_p", "_slot", "_last", "_rest")


def matching(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (already canonical) keys form a row of targets; a null in any key matches nothing."""
    none_null = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    return rows.filter(none_null).join(targets.select(*keys).distinct(), keys, "left_semi")
