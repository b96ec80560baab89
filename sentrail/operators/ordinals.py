"""Dense ordinals 0..n-1 in key order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.session import cut


def with_ordinals(df: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """Add the 0-based rank of each row by key (unique, null keys dropped; empty in, empty out)."""
    return counted_ordinals(df, key, out)[0]


def counted_ordinals(df: DataFrame, key: str, out: str = "ordinal") -> tuple[DataFrame, int]:
    """with_ordinals and the number of its rows.

    Range-sorted partitions number their own rows; only the partitions' row counts reach the driver.
    """
    ranged = cut(df.filter(F.col(key).isNotNull()).sort(key).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    if not starts:
        return ranged.withColumn(out, F.lit(0).cast("long")).drop("_mid"), 0
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "p long, start long")
    within = F.col("_mid") - F.shiftleft(part, 33)
    return ranged.join(F.broadcast(offsets), part == F.col("p")).withColumn(out, F.col("start") + within).drop("_mid", "p", "start"), total
