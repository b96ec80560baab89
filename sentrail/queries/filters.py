"""Filters and projections (FLT rows of the survey). Query names carry the row's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.operators.predicates import between_open, excluded, first_match, in_work_hours, one_of, only_if_any, or_else, search, table_filter
from sentrail.session import table

# Fixed values of these queries.
PROCESSES = ["sync.exe", "indexer.exe"]
CHANNELS = [("usb", "usb"), ("mail", "email"), ("http", "http"), (".exe", "im")]
EXCLUDED = ["*.tmp", "*_1*.csv", "board_pack_?7*.pdf"]
SENSITIVE = ["docx", "xlsx", "pdf", "sql", "7z"]


def flt1_drop_processes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "behavior_events")
    return e.filter(~one_of(F.element_at("metadata", F.lit("proc")), PROCESSES)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def flt2_structured(spark: SparkSession, d: str) -> DataFrame:
    """Events as subject, object and context structs with defaults."""
    e = table(spark, d, "behavior_events").dropDuplicates(["event_id", "ingested_at", "vm_id", "event_type", "sensitivity_level"])
    s = e.select("event_id", "ingested_at", F.struct(F.coalesce("vm_id", F.lit("")).alias("machine"), F.coalesce("user_role", F.lit("normal")).alias("role")).alias("subject"), F.struct(F.coalesce("target", F.lit("")).alias("target"), F.coalesce(F.col("metadata")["proc"], F.lit("internal")).alias("proc")).alias("object"))
    return s.groupBy("subject.role", "object.proc").agg(F.count(F.lit(1)).alias("n"))


def flt3_action_group(spark: SparkSession, d: str) -> DataFrame:
    known = ["write", "copy", "delete", "rename", "send", "upload"]
    a = F.lower("action")
    return table(spark, d, "behavior_events").groupBy(F.when(a.isin(known), F.upper(a)).otherwise("READ").alias("action_class")).agg(F.count(F.lit(1)).alias("n"))


def flt4_channel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "behavior_events").groupBy(first_match(F.col("target"), CHANNELS, "local").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def flt6_extension(spark: SparkSession, d: str) -> DataFrame:
    ext = F.regexp_extract(F.lower(F.coalesce("file_name", F.lit(""))), r"\.([a-z0-9]+)$", 1)
    return table(spark, d, "documents").groupBy(ext.alias("extension"), ext.isin(SENSITIVE).alias("is_sensitive")).agg(F.count(F.lit(1)).alias("n"))


def flt7_globs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(~excluded(F.col("file_name"), EXCLUDED)).select("doc_id", "file_name")


def flt8_work_hours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(in_work_hours(F.col("ts")).alias("at_work"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def flt9_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 errors (top-k report)."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "user_id", "value")


def flt11_table_filter(spark: SparkSession, d: str) -> DataFrame:
    return table_filter(table_filter(table(spark, d, "orders"), "o_orderpriority", "^[12]-"), "o_orderstatus", "!p").select("o_orderkey", "o_orderpriority", "o_orderstatus")


def flt12_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship_day"))


def flt13_precondition(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return only_if_any(table(spark, d, "nation"), e.filter("value > 50")).select("n_nationkey").unionByName(only_if_any(table(spark, d, "nation"), e.filter("value < -1e9")).select("n_nationkey"))


def flt14_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "behavior_events").filter(F.col("target").rlike(r"(?i)^https?://[^/]*vault")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def flt15_or_else(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(or_else(F.col("source"), F.col("doc_type")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def flt16_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 2 + 1, 2).alias("x"), F.concat("o_orderstatus", F.lit("-"), F.repeat(F.col("o_orderstatus"), 2)).alias("s"))


def flt19_alias_in_where(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("is_large", F.col("o_totalprice") > 400000)
    return o.filter(F.col("is_large") | (F.col("o_orderstatus") == "F")).select("o_orderkey", "is_large")


def flt21_field_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """The event ids in a sequence's array of structs."""
    s = table(spark, d, "op_sequences").select("seq_id", "events.event_id").dropDuplicates()
    return s.select("seq_id", F.array_join("event_id", ",").alias("ids"), F.size("event_id").alias("n"))


def flt22_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search(docs, "kind:policy kind:memo lang:en vault", {"kind": "doc_type", "lang": "lang"}, ["text", "file_name"], tags=["kind"]).select("doc_id", "doc_type")


def flt24_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an urgent or high order, none of status P over 300000, seen since 1998."""
    o = table(spark, d, "orders")
    wanted = o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= "1998-01-01")).select("o_custkey").distinct()
    out = o.filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)).select("o_custkey")
    c = table(spark, d, "customer")
    return c.join(wanted, c.c_custkey == wanted.o_custkey, "left_semi").join(out, F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def flt25_time_test(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(between_open(F.col("o_orderdate"), "1997-01-01", "1997-03-01") & between_open(F.col("o_totalprice"), above=100000.0)).select("o_orderkey")


QUERIES = {f.__name__: f for f in (flt1_drop_processes, flt2_structured, flt3_action_group, flt4_channel, flt6_extension, flt7_globs, flt8_work_hours, flt9_last_n, flt11_table_filter, flt12_columns, flt13_precondition, flt14_regex, flt15_or_else, flt16_arithmetic, flt19_alias_in_where, flt21_field_of_rows, flt22_search, flt24_estimate, flt25_time_test)}
ORACLES = {
    "flt1_drop_processes": "SELECT action, count(*) AS n FROM behavior_events WHERE coalesce(lower(metadata['proc']), '') NOT IN ('sync.exe', 'indexer.exe') GROUP BY 1",
    "flt2_structured": """SELECT role, proc, count(*) AS n FROM (SELECT DISTINCT event_id, ingested_at, vm_id, event_type, sensitivity_level, coalesce(user_role, 'normal') AS role, coalesce(metadata['proc'], 'internal') AS proc FROM behavior_events) GROUP BY ALL""",
    "flt3_action_group": "SELECT CASE WHEN lower(action) IN ('write','copy','delete','rename','send','upload') THEN upper(action) ELSE 'READ' END AS action_class, count(*) AS n FROM behavior_events GROUP BY 1",
    "flt4_channel": "SELECT CASE WHEN t LIKE '%usb%' THEN 'usb' WHEN t LIKE '%mail%' THEN 'email' WHEN t LIKE '%http%' THEN 'http' WHEN t LIKE '%.exe%' THEN 'im' ELSE 'local' END AS channel, count(*) AS n FROM (SELECT lower(coalesce(target, '')) AS t FROM behavior_events) GROUP BY 1",
    "flt6_extension": "SELECT e AS extension, e IN ('docx','xlsx','pdf','sql','7z') AS is_sensitive, count(*) AS n FROM (SELECT regexp_extract(lower(coalesce(file_name, '')), '\\.([a-z0-9]+)$', 1) AS e FROM documents) GROUP BY ALL",
    "flt7_globs": "SELECT doc_id, file_name FROM documents WHERE NOT coalesce(regexp_matches(lower(file_name), '^.*\\.tmp$|^.*_1.*\\.csv$|^board_pack_.7.*\\.pdf$'), false)",
    "flt8_work_hours": "SELECT isodow(ts) <= 5 AND hour(ts) >= 9 AND hour(ts) < 18 AS at_work, event_type, count(*) AS n FROM events GROUP BY ALL",
    "flt9_last_n": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "flt11_table_filter": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-') AND NOT regexp_matches(o_orderstatus, '(?i)p')",
    "flt12_columns": "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS ship_day FROM lineitem",
    "flt13_precondition": "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM events WHERE value > 50) UNION ALL SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM events WHERE value < -1e9)",
    "flt14_regex": "SELECT action, count(*) AS n FROM behavior_events WHERE regexp_matches(target, '(?i)^https?://[^/]*vault') GROUP BY 1",
    "flt15_or_else": "SELECT coalesce(nullif(source, ''), doc_type) AS origin, count(*) AS n FROM documents GROUP BY 1",
    "flt16_arithmetic": "SELECT o_orderkey, round(o_totalprice * 2 + 1, 2) AS x, o_orderstatus || '-' || repeat(o_orderstatus, 2) AS s FROM orders",
    "flt19_alias_in_where": "SELECT o_orderkey, o_totalprice > 400000 AS is_large FROM orders WHERE is_large OR o_orderstatus = 'F'",
    "flt21_field_of_rows": "SELECT seq_id, array_to_string(i, ',') AS ids, len(i)::INTEGER AS n FROM (SELECT DISTINCT seq_id, list_transform(events, lambda e: e.event_id) AS i FROM op_sequences)",
    "flt22_search": "SELECT doc_id, doc_type FROM documents WHERE lower(doc_type) IN ('policy', 'memo') AND lower(lang) = 'en' AND (text ILIKE '%vault%' OR file_name ILIKE '%vault%')",
    "flt24_estimate": """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= '1998-01-01')
        AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) GROUP BY 1""",
    "flt25_time_test": "SELECT o_orderkey FROM orders WHERE o_orderdate > '1997-01-01' AND o_orderdate < '1997-03-01' AND o_totalprice > 100000",
}
