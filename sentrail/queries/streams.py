"""Streams and ordered state (STR, DC5, DC6 rows): each stream is run over all its table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.operators.folds import admission, ema_baseline, expiring_set
from sentrail.session import table
from sentrail.streaming.standing import admitted_stream, drain, first_deliveries, table_stream, windows


def str_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return drain(windows(table_stream(spark, d, "events"), "ts", "tumbling", "1 hour", "30 days", ["event_type"]), "complete")


def str_sliding(spark: SparkSession, d: str) -> DataFrame:
    return drain(windows(table_stream(spark, d, "events"), "ts", "sliding", "2 hours", "30 days", [], "1 hour"), "complete")


def str_session(spark: SparkSession, d: str) -> DataFrame:
    return drain(windows(table_stream(spark, d, "events"), "ts", "session", "6 hours", "30 days", ["user_id"]), "complete")


def str_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of behaviour events, each event_id once."""
    return drain(first_deliveries(table_stream(spark, d, "behavior_events").select("event_id", "ingested_at"), "event_id", "ingested_at", "60 days")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


def str2_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Errors per user let through at most twice in six hours."""
    return admission(table(spark, d, "events").filter("event_type = 'error'"), "user_id", "ts", "event_id", 2, 21_600)


def str2_admitted_stream(spark: SparkSession, d: str) -> DataFrame:
    return drain(admitted_stream(table_stream(spark, d, "events").filter("event_type = 'error'"), "user_id", "ts", "event_id", 2, 21_600))


def str3_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 event types of each user in order (a correlation's chain holds 100)."""
    e = table(spark, d, "events")
    from sentrail.operators.relational import top_per_group

    t = top_per_group(e.select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], 100)
    return t.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"]), ">").alias("chain"))


def str12_liveness(spark: SparkSession, d: str) -> DataFrame:
    """Machines heard from in the last day of the table's time."""
    e = table(spark, d, "behavior_events").filter("timestamp < '2024-02-01' AND vm_id IS NOT NULL")
    last = e.groupBy("vm_id").agg(F.max("timestamp").alias("t"))
    top = last.agg(F.unix_seconds(F.max("t"))).first()[0]  # one number
    return last.select("vm_id", (F.lit(top) - F.unix_seconds("t") < 86_400).alias("online"))


def dc5_baseline(spark: SparkSession, d: str) -> DataFrame:
    b = ema_baseline(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id", "value")
    return b.select("event_id", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


def dc6_whitelist(spark: SparkSession, d: str) -> DataFrame:
    return expiring_set(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", "value < 40")


QUERIES = {f.__name__: f for f in (str_tumbling, str_sliding, str_session, str_dedup, str2_admitted, str2_admitted_stream, str3_correlation, str12_liveness, dc5_baseline, dc6_whitelist)}
_ADMITTED = """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
        r AS (SELECT event_id, user_id, i, [t] AS times, true AS admitted FROM o WHERE i = 1 UNION ALL SELECT event_id, user_id, i, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END, len(kept) < 2
        FROM (SELECT o.event_id, o.user_id, o.i, o.t, list_filter(r.times, lambda x: x > o.t - 21600000000) AS kept FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)) SELECT event_id, admitted FROM r"""
ORACLES = {
    "str_tumbling": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL",
    "str_sliding": "SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL",
    "str_session": "WITH b AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w) > INTERVAL 6 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS n FROM g GROUP BY user_id, s",
    "str_dedup": "SELECT count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS n_ids FROM behavior_events",
    "str3_correlation": "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS chain FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 100) GROUP BY 1",
    "str12_liveness": "WITH l AS (SELECT vm_id, max(\"timestamp\") AS t FROM behavior_events WHERE \"timestamp\" < TIMESTAMPTZ '2024-02-01 00:00:00+00' AND vm_id IS NOT NULL GROUP BY 1) SELECT vm_id, floor(epoch((SELECT max(t) FROM l))) - floor(epoch(t)) < 86400 AS online FROM l",
    "str2_admitted": _ADMITTED,
    "str2_admitted_stream": _ADMITTED,
    "dc5_baseline": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT event_id, user_id, i, value AS m, 0.0::DOUBLE AS v FROM o WHERE i = 1 UNION ALL
        SELECT o.event_id, o.user_id, o.i, 0.9 * r.m + 0.1 * o.value, 0.8 * r.v + 0.1 * pow(o.value - (0.9 * r.m + 0.1 * o.value), 2) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT event_id, round(m, 6) AS mean, round(v, 4) AS variance FROM r""",
    "dc6_whitelist": "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(max(ts) FILTER (value < 40) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) <= 86400000000, false) AS known FROM events",
}
