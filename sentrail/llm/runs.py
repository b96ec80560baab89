"""Runs of equal consecutive events, collapsed to one row with count and duration.

Boundary rows only: an event is kept if it differs from its predecessor; the position of the next start
gives the count, the last time before it the duration. A sequence is cut into time chunks, so a sequence
that holds a third of all rows is worked on by many tasks; only the first and last piece of each chunk
are joined up afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse_runs(events: DataFrame, seq: str, ts: str, event_id: str, keys: list[str], chunk_seconds: int = 86_400) -> DataFrame:
    """seq, run_no, first_event_id, *keys, n_events, start_time, end_time, duration_s.

    Events are ordered by ts, then event_id, then keys (nulls first); a repeated row counts as an event
    of its own. Null keys equal only null. Rows with a null seq are dropped; rows with a null ts come
    first and don't count towards the duration, which is null if no event of the run has a time. Empty
    in, empty out. Columns other than those named are dropped.
    """
    chunk = F.coalesce(F.floor(F.col(ts).cast("double") / chunk_seconds), F.lit(-(2**40)))
    rows = events.filter(F.col(seq).isNotNull()).select(F.col(seq).alias("_seq"), chunk.alias("_chunk"), F.col(ts).alias("_ts"), F.col(event_id).alias("_id"), F.struct(*[F.col(k).alias(k) for k in keys]).alias("_key"))
    order = [F.col("_ts").asc_nulls_first(), F.col("_id").asc_nulls_first(), F.col("_key").asc_nulls_first()]
    part = Window.partitionBy("_seq", "_chunk")
    by = part.orderBy(*order)
    marked = rows.select("*", F.row_number().over(by).alias("_pos"), F.lag("_key").over(by).alias("_before"), F.lag("_ts").over(by).alias("_ts_before"))
    # Rows that start a run, plus the chunk's last row for its time and length.
    size = marked.select("*", F.max("_pos").over(part).alias("_n"), F.max("_ts").over(part).alias("_last_ts"))
    starts = size.filter((F.col("_pos") == 1) | ~F.col("_before").eqNullSafe(F.col("_key")))
    pieces = starts.select(
        "_seq", "_chunk", "_id", "_key", "_pos", F.col("_ts").alias("_start"),
        (F.coalesce(F.lead("_pos").over(by), F.col("_n") + 1) - F.col("_pos")).alias("_count"),
        F.when(F.lead("_pos").over(by).isNull(), F.col("_last_ts")).otherwise(F.lead("_ts_before").over(by)).alias("_end"),
        F.lead("_pos").over(by).isNull().alias("_is_last"),
    )
    # A chunk's pieces between its first and last are runs already (`_inner`); only the edges of one
    # sequence's chunks meet. Joining up again keeps the rows that start a run.
    edge = (F.col("_pos") == 1) | F.col("_is_last")
    along = Window.partitionBy("_seq", "_inner").orderBy("_chunk", "_pos")
    goes_on = F.lag("_key").over(along).eqNullSafe(F.col("_key")) & (F.col("_pos") == 1) & F.coalesce(F.lag("_is_last").over(along), F.lit(False))
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    met = pieces.withColumn("_inner", F.when(~edge, F.col("_chunk"))).select("*", goes_on.alias("_goes_on"), F.sum("_count").over(upto).alias("_upto"), F.lag("_end").over(along).alias("_end_before"), F.lead("_start").over(along).alias("_start_after"), F.sum("_count").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"), F.last("_end").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last_end"))
    runs = met.filter(~F.col("_goes_on")).select(
        "_seq", "_chunk", "_pos", "_id", "_key",
        # Only the chunk without times has a null start; a run that goes on from it starts at its first time.
        F.coalesce("_start", F.when(F.coalesce(F.lead(F.col("_upto") - F.col("_count")).over(along), F.col("_all")) > F.col("_upto"), F.col("_start_after"))).alias("_start"),
        (F.coalesce(F.lead(F.col("_upto") - F.col("_count")).over(along), F.col("_all")) - F.col("_upto") + F.col("_count")).alias("_count"),
        F.when(F.lead("_pos").over(along).isNull(), F.col("_last_end")).otherwise(F.lead("_end_before").over(along)).alias("_end"),
    )
    return runs.select(
        F.col("_seq").alias(seq), F.col("_chunk").alias("chunk_no"), F.col("_pos").alias("pos_in_chunk"), F.col("_id").alias("first_event_id"), "_key.*", F.col("_count").cast("long").alias("n_events"),
        F.col("_start").alias("start_time"), F.col("_end").alias("end_time"), (F.unix_micros("_end") - F.unix_micros("_start")).alias("duration_us"),
    )
