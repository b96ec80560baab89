"""Joins, set operations, sorting and paging (JN, SET, ST and part of the SRC rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.functions.canon import machine_key
from sentrail.operators.relational import call_chain, chain, flatten_lists, items, latest_by, page, path_rollup, replace_on_key, snapshot_diff, top_per_group
from sentrail.operators.temporal import interval_join, recent_history
from sentrail.operators.vectors import knn
from sentrail.session import table


def jn1_interval(spark: SparkSession, d: str) -> DataFrame:
    """Errors with purchases of the same user within 30 minutes; errors without any stay."""
    e = table(spark, d, "events")
    j = interval_join(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), "user_id", "ts", "ts", 1800)
    return j.select("event_id", F.col("r_event_id").alias("near_id"))


def jn3_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events with their machine's site, by spelling-free name; unknown machines get defaults."""
    m = table(spark, d, "machines").select(machine_key(F.col("vm_id")).alias("k"), "site", F.col("user_role").alias("own_role"))
    e = table(spark, d, "behavior_events").select(machine_key(F.col("vm_id")).alias("k"))
    return e.join(m, "k", "left").groupBy(F.coalesce("site", F.lit("unknown")).alias("site"), F.coalesce("own_role", F.lit("unknown")).alias("own_role")).agg(F.count(F.lit(1)).alias("n"))


def jn5_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 5 vectors most like each one whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    found = knn(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.select("query_id", "row_id", F.round("score", 6).alias("score"), "rank")


def _lateral(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    o = table(spark, d, "orders")
    top = top_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)
    return c.join(top, c.c_custkey == top.o_custkey).select("c_custkey", "o_orderkey", "rank")


def jn7_lateral(spark: SparkSession, d: str) -> DataFrame:
    """For each customer its two largest orders, as a correlated join."""
    return _lateral(spark, d, table(spark, d, "customer"))


def jn8_expand(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column as columns."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT").alias("s")).select("event_id", "s.*")


def jn10_dict_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in {"error": "fault", "purchase": "sale"}.items() for x in kv])
    return table(spark, d, "events").groupBy(F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def jn11_enrich(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def jn14_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every machine with those it took over from, over any number of steps."""
    m = table(spark, d, "machines").select("vm_id", machine_key(F.col("vm_id")).alias("k"), machine_key(F.col("replaces_vm_id")).alias("old"))
    ties = m.join(m.select(F.col("vm_id").alias("old_vm"), F.col("k").alias("old")), "old").filter("vm_id <> old_vm")
    return call_chain(ties, "vm_id", "old_vm").select(F.col("node").alias("vm_id"), F.col("ancestor").alias("old_vm_id"), F.col("depth").cast("int").alias("depth"))


def jn15_fifo(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last 5 errors of the hour before it."""
    e = table(spark, d, "events")
    r = recent_history(e, F.col("event_type") == "purchase", F.col("event_type") == "error", "user_id", "ts", "event_id", 5, 3600)
    return r.select("event_id", F.array_join("recent", ",").alias("recent"))


def set1_chain(spark: SparkSession, d: str) -> DataFrame:
    return chain(table(spark, d, "region"), table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("r_regionkey"))).select(F.col("_part").alias("part"), "r_regionkey", "r_name", "n_name")


def set3_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select("o_custkey").distinct())


def set4_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each user's event types on even and odd days."""
    e = table(spark, d, "events")
    even = F.dayofmonth("ts") % 2 == 0
    s = e.groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("a"), F.collect_set(F.when(~even, F.col("event_type"))).alias("b"))
    return s.select("user_id", F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def set6_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return latest_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def src8_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Changes between customers' balances and a snapshot with one removed, one changed in every seven."""
    new = table(spark, d, "customer")
    old = new.filter("c_custkey % 7 <> 3").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return snapshot_diff(old, new.filter("c_custkey % 11 <> 1"), "c_custkey", ["c_acctbal"])


def src22_range(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 20, 3).select("id")


def src24_items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "behavior_events").select("event_id", "metadata")
    return items(e, "metadata").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_value").alias("n_values"))


def sc35_flatten(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "nation").select("n_nationkey", F.array(F.lit(1), F.col("n_regionkey")).alias("x"), F.split("n_name", "_").alias("y"))
    return flatten_lists(s, "x", "y")


def ag29_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_type"), F.lit("/"), F.col("file_name")).alias("path"), F.length("text").cast("long").alias("size"))
    return path_rollup(docs, "path", "size")


def snk7_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return replace_on_key(n, n.filter("n_nationkey < 5").withColumn("n_name", F.lit("changed")), "n_nationkey")


def st1_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").orderBy(F.col("s_acctbal").desc(), "s_suppkey").select("s_suppkey", "s_acctbal")


def st2_page(spark: SparkSession, d: str) -> DataFrame:
    return page(table(spark, d, "orders"), ["-o_totalprice", "o_orderkey"], 40, 20).select("o_orderkey", "o_totalprice")


def st4_timed_read(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter((F.col("ts") >= "2024-01-03") & (F.col("ts") < "2024-01-05")).select("event_id", "ts")


def st7_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 3 most frequent words of each document, ties by word."""
    w = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("word"))
    return top_per_group(w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")), ["doc_id"], [F.col("n").desc(), F.col("word")], 3)


QUERIES = {f.__name__: f for f in (jn1_interval, jn3_lookup, jn5_knn, jn7_lateral, jn8_expand, jn10_dict_lookup, jn11_enrich, jn14_chain, jn15_fifo, set1_chain, set3_except, set4_jaccard, set6_latest, src8_snapshot, src22_range, src24_items, sc35_flatten, ag29_rollup, snk7_upsert, st1_sorted, st2_page, st4_timed_read, st7_top_terms)}
from sentrail.queries.features import machine_sql  # noqa: E402

ORACLES = {
    "jn1_interval": "SELECT a.event_id, b.event_id AS near_id FROM (FROM events WHERE event_type = 'error') a LEFT JOIN (FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000",
    "jn3_lookup": f"SELECT coalesce(m.site, 'unknown') AS site, coalesce(m.user_role, 'unknown') AS own_role, count(*) AS n FROM behavior_events e LEFT JOIN machines m ON {machine_sql('e.vm_id')} = {machine_sql('m.vm_id')} GROUP BY ALL",
    "jn5_knn": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8) AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT query_id, row_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
    "jn7_lateral": "SELECT c_custkey, o_orderkey, rank FROM customer, LATERAL (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders WHERE o_custkey = c_custkey QUALIFY rank <= 2)",
    "jn8_expand": "SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events",
    "jn10_dict_lookup": "SELECT CASE event_type WHEN 'error' THEN 'fault' WHEN 'purchase' THEN 'sale' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "jn11_enrich": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "jn14_chain": f"""WITH RECURSIVE m AS (SELECT vm_id, {machine_sql('vm_id')} AS k, {machine_sql('replaces_vm_id')} AS old FROM machines), t AS (SELECT a.vm_id, b.vm_id AS old_vm FROM m a JOIN m b ON a.old = b.k AND a.vm_id <> b.vm_id),
        r AS (SELECT vm_id, old_vm, 1 AS depth FROM t UNION SELECT r.vm_id, t.old_vm, depth + 1 FROM r JOIN t ON r.old_vm = t.vm_id WHERE depth < 32) SELECT vm_id, old_vm AS old_vm_id, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""",
    "jn15_fifo": """SELECT p.event_id, coalesce((SELECT string_agg(q.event_id::VARCHAR, ',' ORDER BY q.ts, q.event_id) FROM (SELECT x.event_id, x.ts FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) < (p.ts, p.event_id)
        AND floor(epoch(x.ts)) >= floor(epoch(p.ts)) - 3600 ORDER BY x.ts DESC, x.event_id DESC LIMIT 5) q), '') AS recent FROM events p WHERE p.event_type = 'purchase'""",
    "set1_chain": "SELECT 0 AS part, r_regionkey, r_name, NULL AS n_name FROM region UNION ALL SELECT 1, n_regionkey, NULL, n_name FROM nation",
    "set3_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set4_jaccard": "SELECT user_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (day(ts) % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (day(ts) % 2 = 1), []) AS b FROM events GROUP BY 1)",
    "set6_latest": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "src8_snapshot": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 3 THEN 'added' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 11 <> 1 AND c_custkey % 7 IN (3, 5) UNION ALL SELECT c_custkey, 'removed' FROM customer WHERE c_custkey % 11 = 1 AND c_custkey % 7 <> 3""",
    "src22_range": "SELECT range AS id FROM range(0, 20, 3)",
    "src24_items": "SELECT u.key AS _key, count(*) AS n, count(DISTINCT u.value) AS n_values FROM (SELECT unnest(map_entries(metadata)) AS u FROM behavior_events) GROUP BY 1",
    "sc35_flatten": "SELECT n_nationkey, x, unnest(string_split(n_name, '_')) AS y FROM (SELECT n_nationkey, n_name, unnest([1, n_regionkey]) AS x FROM nation)",
    "ag29_rollup": """WITH f AS (SELECT coalesce(source, 'none') AS s, doc_type AS t, coalesce(length(text), NULL) AS n FROM documents WHERE doc_type IS NOT NULL AND file_name IS NOT NULL)
        SELECT dir, sum(n)::BIGINT AS total, count(*) AS n_files FROM (SELECT '/' AS dir, n FROM f UNION ALL SELECT '/' || s, n FROM f UNION ALL SELECT '/' || s || '/' || t, n FROM f) GROUP BY 1""",
    "snk7_upsert": "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'changed' ELSE n_name END AS n_name, n_regionkey FROM nation",
    "st1_sorted": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey",
    "st2_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "st4_timed_read": "SELECT event_id, ts FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-05'",
    "st7_top_terms": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word)::INTEGER AS rank FROM c QUALIFY rank <= 3""",
}
