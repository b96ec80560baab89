"""Ordered folds: state carried along a key's rows in time, in bounded memory.

Rows are partitioned by key and sorted by key and order; a task folds its rows batch by batch and keeps
one state at a time, so a key of any length fits. The fold itself is sequential per key by nature.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, object], tuple[object, tuple]], out: str) -> DataFrame:
    """step(state, row) -> (state, values of out) for each row of a key in order; null keys are dropped.

    out is the schema of the result, e.g. 'event_id long, score double'. Ties in order are broken by the
    columns given there: name a unique column last. Empty in, empty out.
    """
    names = [c.strip().split()[0] for c in out.split(",")]
    rows = df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                own = getattr(row, key)
                if at is None or own != at:
                    at, state = own, start()
                state, values = step(state, row)
                done.append(values)
            yield pd.DataFrame(done, columns=names)

    return rows.mapInPandas(run, out)


def ema_baseline(df: DataFrame, key: str, order: list[str], row_id: str, value: str, eta: float = 0.1) -> DataFrame:
    """row_id, mean, variance: each key's moving baseline, the mean first, the spread from the new mean."""

    def step(state: tuple[float, float] | None, row: object) -> tuple[object, tuple]:
        x = getattr(row, value)
        if x is None or x != x:
            m, v = state or (None, None)
            return state, (getattr(row, row_id), m, v)
        if state is None:
            state = (x, 0.0)
        else:
            m = (1 - eta) * state[0] + eta * x
            state = (m, (1 - 2 * eta) * state[1] + eta * (x - m) ** 2)
        return state, (getattr(row, row_id), *state)

    kind = dict(df.dtypes)[row_id]
    return ordered_fold(df, key, order, lambda: None, step, f"{row_id} {kind}, mean double, variance double")


def admit(times: deque, now: float, limit: int, seconds: float) -> bool:
    """Whether an alert at `now` is let through: fewer than `limit` let through in the `seconds` before."""
    while times and times[0] <= now - seconds:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(now)
    return True


def admission(df: DataFrame, key: str, ts: str, row_id: str, limit: int = 5, seconds: float = 60.0) -> DataFrame:
    """row_id, admitted: alerts per key, at most `limit` in any `seconds`; held back ones don't count."""
    timed = df.withColumn("_now", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)

    def step(times: deque, row: object) -> tuple[deque, tuple]:
        return times, (getattr(row, row_id), admit(times, row.now, limit, seconds))

    kind = dict(df.dtypes)[row_id]
    return ordered_fold(timed.withColumnRenamed("_now", "now").filter("now IS NOT NULL"), key, ["now", row_id], deque, step, f"{row_id} {kind}, admitted boolean")


def expiring_set(df: DataFrame, key: str, item: str, ts: str, row_id: str, admit_if: str, ttl_s: float = 86_400.0) -> DataFrame:
    """row_id, known: whether the item was admitted for the key at most ttl_s ago, before this row.

    admit_if is a predicate over the row; an admitted item's time is renewed by each admission, so the last
    one before a row decides, which is a running maximum. Null keys and rows without a time are dropped.
    """
    from sentrail.operators.temporal import running_max

    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    last = running_max(rows, [key, item], ts, [ts, row_id], F.when(F.coalesce(F.expr(admit_if), F.lit(False)), at), "_last")
    return last.select(row_id, F.coalesce(at - F.col("_last") <= int(ttl_s * 1e6), F.lit(False)).alias("known"))
