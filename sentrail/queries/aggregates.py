"""Aggregations and windows (AG and WN rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrail.operators.metrics import binary_metrics
from sentrail.operators.temporal import day_of, every_nth, rate, seconds_of, with_context, within_seconds
from sentrail.session import table

R = lambda c, n=6: F.round(c, n)


def ag3_time_bins(spark: SparkSession, d: str) -> DataFrame:
    """Share of each user's events in 48 half-hour bins; bins without events are absent here (zero)."""
    e = table(spark, d, "events").groupBy("user_id", F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", "bin", R(F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


def ag4_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    p = e.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg(R(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("entropy"))


def _trigrams(spark: SparkSession, d: str) -> DataFrame:
    """user_id, a, b, c: each event type with the user's two before it; hot users are spread over days."""
    rows = with_context(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", day_of("ts"), ["ts", "event_id"], 2)
    w = Window.partitionBy("user_id", "_bucket").orderBy("ts", "event_id")
    t = rows.select("user_id", "_context", F.lag("event_type", 2).over(w).alias("a"), F.lag("event_type", 1).over(w).alias("b"), F.col("event_type").alias("c"), F.lag(F.lit(1), 2).over(w).alias("third"))
    return t.filter("third = 1 AND c IS NOT NULL AND NOT _context")


def ag5_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """P(third | first, second) of event types in each user's order."""
    t = _trigrams(spark, d)
    n = t.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    return n.select("a", "b", "c", "n", R(F.col("n") / F.sum("n").over(Window.partitionBy("a", "b"))).alias("p"))


def ag6_top_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Each user's trigrams as a vector of 32 shares: by name, or the 32 most frequent if there are more; zeros fill up."""
    n = _trigrams(spark, d).select("user_id", F.concat_ws(">", "a", "b", "c").alias("t")).groupBy("user_id", "t").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("user_id")
    top = n.withColumns({"rank": F.row_number().over(by.orderBy(F.col("n").desc(), "t")), "total": F.sum("n").over(by)}).filter("rank <= 32")
    v = top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", R(F.col("n") / F.col("total")).alias("share")))).alias("v"))
    return v.select("user_id", F.concat(F.transform("v", lambda x: x["share"]), F.array_repeat(F.lit(0.0), 32 - F.size("v"))).alias("vector")).select("user_id", F.posexplode("vector").alias("pos", "share"))


def ag7_resource_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of every event type that occurs, zero where a user has none of it."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = n.select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("kinds"))
    users = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("total"))
    every = users.select("*", F.explode(F.lit(kinds.first()[0])).alias("event_type"))
    return every.select("user_id", "event_type", R(F.coalesce(F.try_element_at("m", F.col("event_type")), F.lit(0)) / (F.col("total") + 1e-8)).alias("share"))


def ag7_zscore(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return zscore(n, "n").select("user_id", R(F.col("z")).alias("z"))


def zscore(df: DataFrame, column: str, mean: float | None = None, std: float | None = None) -> DataFrame:
    """Adds z of a column, by a given mean and deviation or by those of all rows (two numbers to the driver)."""
    if mean is None or std is None:
        own = df.agg(F.avg(column), F.stddev_pop(column)).first()
        mean, std = own[0] if mean is None else mean, own[1] if std is None else std
    return df.withColumn("z", (F.col(column) - F.lit(float(mean or 0.0))) / F.lit(max(float(std or 0.0), 1e-8)))


def ag18_majority(spark: SparkSession, d: str) -> DataFrame:
    """Each user's most frequent event type and its share; ties go to the type seen first."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "first"))
    return e.select("user_id", "event_type", R(F.col("n") / total).alias("share"), r.alias("r")).filter("r = 1").drop("r")


def ag17_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Entropy plus 0.6 times the summed vote variance over each user's types."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = e.withColumn("p", F.col("n") / (F.sum("n").over(Window.partitionBy("user_id")) + 1e-8))
    return p.groupBy("user_id").agg(R(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)) + 0.6 * F.sum(F.col("p") - F.col("p") * F.col("p"))).alias("u"))


def ag19_severity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "behavior_events")
    n = e.groupBy("sensitivity_level", "action").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("sensitivity_level").orderBy(F.col("n").desc(), F.col("action").asc_nulls_first()))).filter("r <= 3").select("sensitivity_level", "action", "n")


def ag23_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(length(text)) div count(text)").alias("avg_len"), F.count_if(F.lower("text").rlike("attachment|anlage|附件")).alias("n_attached"))


def ag24_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupingSets([["source"], ["doc_type"], []], "source", "doc_type").agg(F.grouping_id().cast("int").alias("g"), F.count(F.lit(1)).alias("n"))


def ag25_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return o


def ag26_lists(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))
    return n


def ag27_enumerate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("keys"))
    return c


def ag28_last_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


def ag30_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, false positives and F1 of 'value above 40' as a detector of errors."""
    e = table(spark, d, "events").select((F.col("event_type") == "error").alias("y"), (F.col("value") > 40).alias("p"))
    return binary_metrics(e, [], "y", "p")


def ag33_by_channel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("channel"), (F.col("event_type") == "error").alias("y"), (F.col("value") > 40).alias("p"))
    return binary_metrics(e, ["channel"], "y", "p")


def ag34_folds(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("m"))
    return f.agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_pop("m"), 4).alias("std"))


def ag_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def wn2_recent_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each user's last 30 values, from 15 values on."""
    rows = with_context(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", day_of("ts"), ["ts", "event_id"], 29)
    w = Window.partitionBy("user_id", "_bucket").orderBy("ts", "event_id").rowsBetween(-29, 0)
    e = rows.select("event_id", "_context", F.count(F.lit(1)).over(w).alias("c"), F.avg("value").over(w).alias("m"))
    return e.filter("c >= 15 AND NOT _context").select("event_id", R(F.col("m")).alias("mean"))


def wn3_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rate(e, "value", seconds_of("ts").cast("double"), "user_id", "ts", ["ts", "event_id"]).select("event_id", R(F.col("rate")).alias("rate"))


def wn4_every_nth(spark: SparkSession, d: str) -> DataFrame:
    return every_nth(table(spark, d, "events").select("event_id", "ts"), 10, ["ts", "event_id"]).select("event_id")


def wn6_bulk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return within_seconds(e.select("event_id", "user_id", "ts"), "user_id", "ts", 3600, n=F.count(F.lit(1))).select("event_id", "n").filter("n > 3")


def wn7_spread(spark: SparkSession, d: str) -> DataFrame:
    """Events whose user showed more than 3 distinct types in the two hours before."""
    e = within_seconds(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", 7200, kinds=F.collect_set("event_type"))
    return e.select("event_id", F.size("kinds").alias("k")).filter("k > 3")


def ag22_process_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Accesses of each machine by process, and its share of them."""
    e = table(spark, d, "behavior_events").select("vm_id", F.lower(F.trim(F.col("metadata")["proc"])).alias("proc")).filter("proc IS NOT NULL")
    n = e.groupBy("vm_id", "proc").agg(F.count(F.lit(1)).alias("n"))
    return n.select("vm_id", "proc", "n", R(F.col("n") / F.sum("n").over(Window.partitionBy("vm_id"))).alias("share"))


def wn13_after_day(spark: SparkSession, d: str, day: int = 8) -> DataFrame:
    """Each user's mean value before and from a 0-based day on (a change of role), null where there is none."""
    late = F.dayofmonth("ts") - 1 >= day
    return table(spark, d, "events").groupBy("user_id").agg(R(F.avg(F.when(~late, F.col("value")))).alias("before"), R(F.avg(F.when(late, F.col("value")))).alias("after"))


def wn9_softmax(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey")
    s = table(spark, d, "nation").withColumn("s", (F.col("n_nationkey") % 7) / 7)
    x = F.exp(F.col("s") / (0.5 + 1e-8) - F.max(F.col("s") / (0.5 + 1e-8)).over(w))
    return s.withColumn("x", x).select("n_nationkey", R(F.col("x") / (F.sum("x").over(w) + 1e-8)).alias("p"))


def wn10_top_p(spark: SparkSession, d: str) -> DataFrame:
    """Each region's largest nations by customers until 60 % are reached, the crossing one included."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("n_regionkey")))
    before = F.coalesce(F.sum("p").over(Window.partitionBy("n_regionkey").orderBy(F.col("n").desc(), "n_nationkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    k = p.withColumn("before", before).filter("before < 0.6")
    return k.select("n_nationkey", R(F.col("p") / F.sum("p").over(Window.partitionBy("n_regionkey"))).alias("p"))


def wn11_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers and the first row of each order's part in one running count per supplier."""
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy("l_linenumber")
    return n.select("l_suppkey", "l_linenumber", F.row_number().over(w).alias("part"), (F.sum("n").over(w) - F.col("n")).alias("start_row"))


def wn12_periods(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("period"), (F.col("event_type") == "error").alias("y"), (F.col("value") > 40).alias("p"))
    return binary_metrics(e, ["period"], "y", "p")


QUERIES = {f.__name__: f for f in (ag3_time_bins, ag4_entropy, ag5_trigrams, ag6_top_trigrams, ag7_resource_share, ag7_zscore, ag17_uncertainty, ag18_majority, ag19_severity, ag23_stats, ag24_grouping_sets, ag25_pivot, ag26_lists, ag27_enumerate, ag28_last_per_group, ag30_confusion, ag33_by_channel, ag34_folds, ag_cube, wn2_recent_mean, wn3_rate, wn4_every_nth, wn6_bulk, wn7_spread, ag22_process_frequency, wn13_after_day, wn9_softmax, wn10_top_p, wn11_numbering, wn12_periods)}

_METRICS = "round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall, round(fp / (fp + tn + 1e-8), 6) AS fpr, round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8)) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8), 6) AS f1"
_COUNTS = "count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn"
_EVENTS = "SELECT *, event_type = 'error' AS y, value > 40 AS p FROM events"
ORACLES = {
    "ag3_time_bins": "WITH c AS (SELECT user_id, ((hour(ts) * 60 + minute(ts)) // 30)::INTEGER AS bin, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, bin, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c",
    "ag4_entropy": "WITH c AS (SELECT user_id, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * ln(p + 1e-12)), 6) AS entropy FROM p GROUP BY 1",
    "ag5_trigrams": "WITH t AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL) SELECT a, b, c, n, round(n / sum(n) OVER (PARTITION BY a, b), 6) AS p FROM n",
    "ag6_top_trigrams": "WITH t AS (SELECT user_id, event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT user_id, t, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t) <= 32), v AS (SELECT user_id, list(round(n / total, 6) ORDER BY t) AS v FROM k GROUP BY 1) SELECT user_id, p::INTEGER AS pos, coalesce(v[p + 1], 0.0)::DOUBLE AS share FROM v, (SELECT unnest(range(32)) AS p)",
    "ag7_resource_share": "WITH u AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1), k AS (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL), n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, round(coalesce(n, 0) / (total + 1e-8), 6) AS share FROM u JOIN k ON true LEFT JOIN n USING (user_id, event_type)",
    "ag22_process_frequency": "WITH e AS (SELECT vm_id, lower(trim(metadata['proc'])) AS proc FROM behavior_events), n AS (SELECT vm_id, proc, count(*) AS n FROM e WHERE proc IS NOT NULL GROUP BY ALL) SELECT vm_id, proc, n, round(n / sum(n) OVER (PARTITION BY vm_id), 6) AS share FROM n",
    "wn13_after_day": "SELECT user_id, round(avg(value) FILTER (day(ts) <= 8), 6) AS before, round(avg(value) FILTER (day(ts) > 8), 6) AS after FROM events GROUP BY 1",
    "ag7_zscore": "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round((n - (SELECT avg(n) FROM n)) / greatest((SELECT stddev_pop(n) FROM n), 1e-8), 6) AS z FROM n",
    "ag17_uncertainty": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / (sum(n) OVER (PARTITION BY user_id) + 1e-8) AS p FROM c) SELECT user_id, round(-sum(p * ln(p + 1e-12)) + 0.6 * sum(p - p * p), 6) AS u FROM p GROUP BY 1",
    "ag18_majority": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "ag19_severity": "WITH c AS (SELECT sensitivity_level, action, count(*) AS n FROM behavior_events GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sensitivity_level ORDER BY n DESC, action NULLS FIRST) <= 3",
    "ag23_stats": "SELECT doc_type, count(*) AS n, (sum(length(text)) // count(text))::BIGINT AS avg_len, count(*) FILTER (regexp_matches(lower(text), 'attachment|anlage|附件')) AS n_attached FROM documents GROUP BY 1",
    "ag24_grouping_sets": "SELECT source, doc_type, grouping_id(source, doc_type)::INTEGER AS g, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (doc_type), ())",
    "ag25_pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "ag26_lists": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "ag27_enumerate": "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS keys FROM supplier GROUP BY 1",
    "ag28_last_per_group": "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1",
    "ag30_confusion": f"SELECT {_METRICS} FROM (SELECT {_COUNTS} FROM ({_EVENTS}))",
    "ag33_by_channel": f"SELECT channel, {_METRICS} FROM (SELECT user_id % 4 AS channel, {_COUNTS} FROM ({_EVENTS}) GROUP BY 1)",
    "ag34_folds": "SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std FROM (SELECT o_orderkey % 5 AS f, avg(o_totalprice) AS m FROM orders GROUP BY 1)",
    "ag_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "wn2_recent_mean": "SELECT event_id, round(m, 6) AS mean FROM (SELECT event_id, count(*) OVER w AS c, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING)) WHERE c >= 15",
    "wn3_rate": "SELECT event_id, round((value - lag(value) OVER w) / nullif(floor(epoch(ts)) - lag(floor(epoch(ts))) OVER w, 0), 6) + 0 AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "wn4_every_nth": "SELECT event_id FROM events QUALIFY (row_number() OVER (ORDER BY ts, event_id) - 1) % 10 = 0",
    "wn6_bulk": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events QUALIFY n > 3",
    "wn7_spread": "SELECT event_id, k::INTEGER AS k FROM (SELECT event_id, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))) AS k FROM events) WHERE k > 3",
    "wn9_softmax": "WITH s AS (SELECT n_nationkey, n_regionkey, (n_nationkey % 7) / 7 / (0.5 + 1e-8) AS s FROM nation), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY n_regionkey)) AS x FROM s) SELECT n_nationkey, round(x / (sum(x) OVER (PARTITION BY n_regionkey) + 1e-8), 6) AS p FROM x",
    "wn10_top_p": "WITH c AS (SELECT n_nationkey, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY n_regionkey) AS p FROM c), b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT n_nationkey, round(p / sum(p) OVER (PARTITION BY n_regionkey), 6) AS p FROM b WHERE before < 0.6",
    "wn11_numbering": "WITH n AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_linenumber, row_number() OVER w::INTEGER AS part, (sum(n) OVER w - n)::BIGINT AS start_row FROM n WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_linenumber)",
    "wn12_periods": f"SELECT period, {_METRICS} FROM (SELECT ((day(ts) - 1) // 5)::INTEGER AS period, {_COUNTS} FROM ({_EVENTS}) GROUP BY 1)",
}
