"""Joins and windows in time: interval joins, recent-history joins, sliding counts, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_of(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone (without: the session's)."""
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """Left rows with every right row of the same key at most `seconds` away; unmatched ones keep nulls.

    The time is cut into buckets of that width: a right row is sent to its own and both neighbouring
    buckets, so the join is an equi-join on (key, bucket), and a hot key is spread over its buckets.
    """
    bucket = lambda c: F.floor(seconds_of(c) / seconds)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.explode(F.array(bucket(right_ts) - 1, bucket(right_ts), bucket(right_ts) + 1)).alias("_b"))
    near = F.abs(F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col(f"r_{right_ts}").cast("timestamp"))) <= seconds * 1_000_000
    return left.withColumn("_lb", bucket(left_ts)).join(r, (F.col(key) == F.col(f"r_{key}")) & (F.col("_lb") == F.col("_b")) & near, "left").drop("_b", "_lb")


def recent_history(events: DataFrame, is_trigger: Column, is_history: Column, key: str, ts: str, order: str, max_rows: int, max_age_s: int) -> DataFrame:
    """Trigger rows with the last max_rows history rows of their key no older than max_age_s.

    recent holds their `order` values, oldest first. Time is cut into buckets of max_age_s; a history row
    goes to its own and the next bucket, so a hot key is spread over its buckets and needs no self-join.
    Each history row carries the last max_rows up to itself, and a trigger takes those of the last one
    before it: no row ever holds more than max_rows.
    """
    rows = _in_buckets(events, ts, max_age_s, F.coalesce(is_history, F.lit(False))).withColumns({"_trigger": F.coalesce(is_trigger, F.lit(False)), "_past": F.coalesce(is_history, F.lit(False))})
    own, by = F.struct(seconds_of(ts).alias("s"), F.col(order).alias("o")), [F.col(ts), F.col(order)]
    upto = F.collect_list(own).over(Window.partitionBy(key, "_bucket", "_past").orderBy(*by).rowsBetween(1 - max_rows, 0))
    held = rows.withColumn("_own", F.when(F.col("_past"), upto))
    before = Window.partitionBy(key, "_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    last = F.filter(F.coalesce(F.last("_own", ignorenulls=True).over(before), F.array().cast(held.schema["_own"].dataType)), lambda h: h["s"] >= seconds_of(ts) - max_age_s)
    return held.withColumn("_last", last).filter(F.col("_trigger") & ~F.col("_context")).select(*events.columns, F.transform("_last", lambda h: h["o"]).alias("recent"))


def _in_buckets(df: DataFrame, ts: str, seconds: int, copied: Column | None = None) -> DataFrame:
    """Rows in buckets of `seconds`; those to be copied also stand in the next bucket, there as _context."""
    home = F.floor(seconds_of(ts) / seconds)
    copies = F.array(home, home + 1) if copied is None else F.when(copied, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_bucket", F.explode(copies)).withColumn("_context", F.col("_bucket") != F.col("_home")).drop("_home")


def within_seconds(df: DataFrame, key: str, ts: str, seconds: int, **columns: Column) -> DataFrame:
    """Adds aggregates over the key's rows in the `seconds` up to and including each row's second.

    columns: name to aggregate, e.g. n=F.count(F.lit(1)). A hot key is spread over buckets of time; each row
    also stands in the next bucket, so no frame leaves its bucket. Rows without a time are dropped.
    """
    w = Window.partitionBy(key, "_bucket").orderBy(seconds_of(ts)).rangeBetween(-seconds, 0)
    rows = _in_buckets(df.filter(F.col(ts).isNotNull()), ts, seconds)
    return rows.withColumns({n: c.over(w) for n, c in columns.items()}).filter(~F.col("_context")).drop("_bucket", "_context")


def with_context(df: DataFrame, key: str, bucket: Column, order: list[str], before: int) -> DataFrame:
    """Rows in buckets that follow the order, each bucket with the key's last `before` rows before it.

    A window over (key, _bucket) in this order then sees up to `before` rows back, as one over the key would;
    filter ~_context afterwards. So a hot key is spread over its buckets; what crosses them is `before` rows each.
    """
    rows = df.withColumn("_bucket", F.coalesce(bucket, F.lit(-(2**40))))
    own = F.struct(*order, *[c for c in df.columns if c not in order])
    back = Window.partitionBy(key, "_bucket").orderBy(*[F.col(c).desc() for c in order])
    tails = rows.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= before).groupBy(F.col(key).alias("_k"), "_bucket").agg(F.sort_array(F.collect_list(own)).alias("_tail"))
    # Every bucket has a row, so the last `before` buckets hold enough of them.
    past = F.flatten(F.collect_list("_tail").over(Window.partitionBy("_k").orderBy("_bucket").rowsBetween(-before, -1)))
    context = tails.withColumn("_past", past).select("_bucket", F.explode(F.slice("_past", F.greatest(F.size("_past") - before + 1, F.lit(1)), before)).alias("_c")).select("_c.*", "_bucket", F.lit(True).alias("_context"))
    return rows.withColumn("_context", F.lit(False)).unionByName(context)


def day_of(ts: str) -> Column:
    """A bucket for with_context."""
    return F.floor(seconds_of(ts) / 86_400)


def rate(df: DataFrame, x: str, y: Column, key: str, ts: str, order: list[str], out: str = "rate") -> DataFrame:
    """Change of x per change of y since the key's previous row; null on the first row or where y stands still."""
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    dy = y - F.lag(y).over(w)
    return with_context(df, key, day_of(ts), order, 1).withColumn(out, (F.col(x) - F.lag(x).over(w)) / F.when(dy != 0, dy)).filter(~F.col("_context")).drop("_bucket", "_context")


def running_max(df: DataFrame, keys: list[str], ts: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The largest value among the rows of the keys before each row; null before the first.

    Within days by a window, and over whole days before by a window over their maxima alone.
    """
    rows = df.withColumn("_day", day_of(ts)).withColumn("_v", value)
    days = rows.groupBy(*keys, "_day").agg(F.max("_v").alias("_m")).withColumn("_before", F.max("_m").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
    same = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_day").alias("_d"), "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_day").eqNullSafe(F.col("_d"))]
    return rows.withColumn("_w", F.max("_v").over(same)).join(known, on).withColumn(out, F.greatest("_w", "_before")).select(*df.columns, out)


def every_nth(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Every n-th row in the given order, the first included, numbered over range-sorted partitions."""
    from sentrail.operators.ordinals import with_ordinals

    keyed = df.withColumn("_order", F.struct(*order))
    return with_ordinals(keyed, "_order", "_n").filter(F.col("_n") % n == 0).drop("_order", "_n")
