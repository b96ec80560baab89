"""Further rows of the survey, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrail.functions.canon import machine_key, type_key
from sentrail.operators import vectors as V
from sentrail.operators.metrics import binary_metrics, normal_tail
from sentrail.operators.relational import top_per_group
from sentrail.operators.scan import pattern_hits
from sentrail.operators.temporal import with_context, within_seconds
from sentrail.plans.workbook import Workbook
from sentrail.queries.profiles import _vectors
from sentrail.session import table

def src31_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """A query given as text, with bound values."""
    return Workbook(spark).let("e", lambda _: table(spark, d, "events")).query("SELECT event_type, count(*) AS n FROM {e} WHERE value > :least GROUP BY 1", least=20.0)


def src32_named(spark: SparkSession, d: str) -> DataFrame:
    """Stored queries that use each other; rows name their source."""
    book = Workbook(spark).let("orders_of", lambda b, status: table(spark, d, "orders").filter(F.col("o_orderstatus") == status)).fixed("totals", lambda b, status: b.use("orders_of", status=status).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
    return book.call("totals", status="F").unionByName(book.call("totals", status="P"))


def src34_scan(spark: SparkSession, d: str) -> DataFrame:
    return pattern_hits(table(spark, d, "documents"), "doc_id", "text", {"host": r"vm[0-9]{4}", "ticket": r"[A-Z]{2,3}-[0-9]{5}", "name": "0x48616c64656e"}).select("doc_id", "rule", "start", "found")


def src35_stat(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose named file is known to some other document's name."""
    t = table(spark, d, "documents").select("doc_id", "file_name")
    names = t.filter("file_name IS NOT NULL").groupBy("file_name").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return t.join(names, "file_name", "left_semi").select("doc_id")


def flt20_star(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("*", (F.col("n_nationkey") * 2).alias("twice"), F.split("n_name", "_")[1].alias("no"))


def flt26_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Filter, classify and look up behaviour events in one plan."""
    e = table(spark, d, "behavior_events").filter(F.coalesce(F.col("metadata")["proc"], F.lit("")) != "sync.exe")
    m = table(spark, d, "machines").select(machine_key(F.col("vm_id")).alias("k"), "site")
    c = table(spark, d, "event_catalog").select(type_key(F.col("event_type")).alias("t"), "base_type")
    j = e.select(machine_key(F.col("vm_id")).alias("k"), type_key(F.col("event_type")).alias("t"), "action").join(m, "k").join(c, "t")
    return j.groupBy("site", "base_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("action").alias("n_actions"))


def jn17_paired(spark: SparkSession, d: str) -> DataFrame:
    """Two predictions joined by row, counted by agreement."""
    e = table(spark, d, "events")
    a, b = e.select("event_id", (F.col("value") > 30).alias("a")), e.select("event_id", (F.col("value") > 50).alias("b"))
    return a.join(b, "event_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def ag13_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Sample covariance of each label's vectors, for every two dimensions; a single row gives 0.01 on the diagonal.

    A task sends sums and products of each label per batch, centred by the batch's means.
    """
    import numpy as np
    import pandas as pd

    def partial(batches):
        for pdf in batches:
            for label, own in pdf.groupby("label", dropna=False)["v"]:
                x = np.array(own.tolist(), np.float64)
                m = x.mean(0)
                yield pd.DataFrame({"label": [label], "n": [len(x)], "m": [m.tolist()], "q": [((x - m).T @ (x - m)).ravel().tolist()]})

    def merged(key, pdf):
        n, m = pdf["n"].to_numpy(np.float64), np.array(pdf["m"].tolist())
        apart = m - (n[:, None] * m).sum(0) / n.sum()
        q = np.array(pdf["q"].tolist()).sum(0).reshape(m.shape[1], -1) + (n[:, None] * apart).T @ apart
        i, j = np.triu_indices(m.shape[1])
        cov = q[i, j] / (n.sum() - 1) if n.sum() > 1 else np.where(i == j, 0.01, 0.0)
        return pd.DataFrame({"label": key[0], "pos": i, "other": j, "cov": cov})

    e = _vectors(spark, d)
    kind = dict(e.dtypes)["label"]
    parts = e.select("label", "v").mapInPandas(partial, f"label {kind}, n long, m array<double>, q array<double>")
    return parts.groupBy("label").applyInPandas(merged, f"label {kind}, pos int, other int, cov double").withColumn("cov", F.round("cov", 8))


def ag14_recent_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the last 30 vectors per label and dimension, up to each vector; hot labels are spread over ranges of ids."""
    rows = with_context(_vectors(spark, d), "label", F.floor(F.col("vec_id") / 1000), ["vec_id"], 29)
    w = Window.partitionBy("label", "_bucket", "pos").orderBy("vec_id").rowsBetween(-29, 0)
    x = rows.select("vec_id", "label", "_bucket", "_context", F.posexplode("v").alias("pos", "x"))
    return x.select("vec_id", "pos", "_context", F.round(F.avg("x").over(w), 6).alias("mean")).filter("NOT _context").drop("_context")


def ag12_selected(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions whose information gain lies above mean plus one deviation."""
    from sentrail.queries.profiles import ag11_information_gain

    g = ag11_information_gain(spark, d).withColumn("_all", F.lit(1))
    w = Window.partitionBy("_all")
    return g.select("pos", "gain", (F.avg("gain").over(w) + F.stddev_pop("gain").over(w)).alias("bar")).filter("gain > bar").select("pos")


def ag20_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "behavior_events").groupBy(F.concat(F.lit("published."), F.coalesce(type_key(F.col("event_type")), F.lit("none"))).alias("counter")).agg(F.count(F.lit(1)).alias("n"))


def ag32_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents")
    return e.agg(*[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(n) for n, c in (("has_text", F.length(F.trim("text")) > 0), ("has_lang", F.col("lang").isNotNull()), ("counted", F.col("n_chars") == F.length("text")))])


def wn8_cross_channel(spark: SparkSession, d: str) -> DataFrame:
    """Machines that used three or more base types within one hour, with the first such second."""
    e = table(spark, d, "behavior_events").select(machine_key(F.col("vm_id")).alias("k"), F.substring_index(type_key(F.col("event_type")), ".", 1).alias("t"), "timestamp").filter("k IS NOT NULL AND timestamp IS NOT NULL AND t IN ('file', 'email', 'http', 'im', 'device')")
    n = within_seconds(e, "k", "timestamp", 3600, kinds=F.collect_set("t"))
    return n.filter(F.size("kinds") >= 3).groupBy("k").agg(F.unix_seconds(F.min("timestamp")).alias("first"))


def st9_priority(spark: SparkSession, d: str) -> DataFrame:
    """All documents in grade order, unknown grades last."""
    return _graded(table(spark, d, "documents"))


def _graded(documents: DataFrame) -> DataFrame:
    from sentrail.functions.canon import level_key

    rank = F.coalesce(4 - F.substring(level_key(F.col("sensitivity_level")), 2, 1).cast("int"), F.lit(99))
    return documents.select("doc_id", rank.alias("rank")).orderBy("rank", "doc_id")


def set5_deleted(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    return p.join(table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


def set8_recently_used(spark: SparkSession, d: str) -> DataFrame:
    """The 500 users seen last (what a cache of 500 would hold)."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.col("last").desc(), "user_id").limit(500).select("user_id")


def sc2_document_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", "file_name", F.lit("")), 256).alias("h"))


def sc6_nested_json(spark: SparkSession, d: str) -> DataFrame:
    """A nested JSON value, null unless one of the allowed words."""
    j = F.concat(F.lit('{"rule": {"kind": "'), F.col("event_type"), F.lit('"}}'))
    k = F.get_json_object(j, "$.rule.kind")
    return table(spark, d, "events").select("event_id", F.when(k.isin("error", "view"), k).alias("kind"))


def sc21_components(spark: SparkSession, d: str) -> DataFrame:
    p = F.filter(F.split(F.regexp_replace("target", r"^[a-z]+://", "/"), r"[/\\]"), lambda x: x != "")
    e = table(spark, d, "behavior_events").filter("target LIKE 'https://%'").select(F.try_element_at(p, F.lit(1)).alias("host"), F.size(p).alias("depth"))
    return e.groupBy("host", "depth").agg(F.count(F.lit(1)).alias("n"))


def sc22_index_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_catalog").select("event_type", F.lower(F.regexp_replace("event_type", "[/.]", "_")).alias("name"))


def sc24_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.lower("text").rlike("attach|enclos|see (the )?file")).select("doc_id")


def sc28_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Base64 in lines of 16 characters."""
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.base64(F.encode(F.concat("p_name", F.lit(" / "), "p_type"), "utf-8")), "(.{16})", "$1\n").alias("b"))


def sc39_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Events in another schema by a lookup of kinds."""
    m = spark.createDataFrame([("error", "failure", 3), ("purchase", "sale", 1), ("signup", "account", 1)], "event_type string, category string, severity int")
    j = table(spark, d, "events").join(m, "event_type", "left")
    return j.groupBy(F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("severity", F.lit(0)).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def gr10_first_hit(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    g = F.when(low.contains("top secret"), "L4").when(low.contains("confidential"), "L3").when(low.contains("internal"), "L2").otherwise("L1")
    return table(spark, d, "documents").groupBy(g.alias("grade"), "lang").agg(F.count(F.lit(1)).alias("n"))


def gr11_category_level(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("memo", "L1"), ("policy", "L2"), ("contract_draft", "L3")], "doc_type string, level string")
    return table(spark, d, "documents").join(m, "doc_type").select("doc_id", "level")


def gr16_prompt(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", F.concat_ws("\n", F.format_string("[type] %s", F.coalesce("doc_type", F.lit(""))), F.concat(F.lit("[text] "), F.substring("text", 1, 500))).alias("prompt"))


def gr18_fused(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of each label's vectors, weights falling with the id."""
    x = _vectors(spark, d).withColumn("w", 1 / (1 + F.col("vec_id") % 10)).select("label", "w", F.posexplode("v").alias("pos", "x"))
    return x.groupBy("label", "pos").agg(F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 6).alias("h"))


def gr21_misses(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content no earlier document (smaller id) had: only these need grading."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def cl10_spark_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Plain k-means of Spark's library as a baseline: cluster sizes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = _vectors(spark, d).select("vec_id", array_to_vector("v").alias("features"))
    return KMeans(k=4, seed=1, maxIter=10).fit(e).transform(e).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def cl14_ema_centres(spark: SparkSession, d: str) -> DataFrame:
    """Label centres of even ids moved a tenth of the way to those of odd ids."""
    even = V.grouped_mean(_vectors(spark, d).filter("vec_id % 2 = 0"), ["label"], "v").select("label", "pos", F.col("mean").alias("a"))
    odd = V.grouped_mean(_vectors(spark, d).filter("vec_id % 2 = 1"), ["label"], "v").select("label", "pos", F.col("mean").alias("b"))
    return even.join(odd, ["label", "pos"]).select("label", "pos", F.round(0.9 * F.col("a") + 0.1 * F.col("b"), 6).alias("c"))


def cl19_feature_row(spark: SparkSession, d: str) -> DataFrame:
    """User vectors joined from two sources, zeros where one is missing: length and sum."""
    a = table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.array(F.avg("value"), F.max("value")).alias("a"))
    b = table(spark, d, "events").filter("value > 90").groupBy("user_id").agg(F.array(F.count(F.lit(1)).cast("double")).alias("b"))
    v = F.concat(F.coalesce("a", F.array(F.lit(0.0), F.lit(0.0))), F.coalesce("b", F.array(F.lit(0.0))))
    return a.join(b, "user_id", "full_outer").select("user_id", F.size(v).alias("d"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


def dc2_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each vector from its label's mean, by the label's variances."""
    x = _vectors(spark, d).select("vec_id", "label", F.posexplode("v").alias("pos", "x"))
    s = x.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.var_samp("x").alias("s"))
    return x.join(s, ["label", "pos"]).groupBy("vec_id").agg(F.round(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2) / (F.col("s") + 1e-6))), 5).alias("d"))


def dc10_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour one-hot vectors: where the one stands."""
    b = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int")
    v = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: (i == b).cast("double"))
    return table(spark, d, "events").select("event_id", (F.array_position(v, F.lit(1.0)) - 1).cast("int").alias("slot"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"))


def dc16_grid(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every pair of four lower and four upper thresholds in one pass."""
    each = lambda xs: F.array(*map(F.lit, xs))
    e = table(spark, d, "events").select((F.col("event_type") == "error").alias("y"), "value", F.explode(each((10.0, 20.0, 30.0, 40.0))).alias("low"))
    e = e.select("*", F.explode(each((50.0, 60.0, 70.0, 80.0))).alias("high"))
    return binary_metrics(e.withColumn("p", (F.col("value") > F.col("low")) & (F.col("value") <= F.col("high"))), ["low", "high"], "y", "p")


def ev2_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank sums of each user's mean in the first against the second half of January (mean ranks on ties)."""
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.dayofmonth("ts") <= 15, F.col("value"))).alias("a"), F.avg(F.when(F.dayofmonth("ts") > 15, F.col("value"))).alias("b"))
    v = m.select(F.round(F.col("a") - F.col("b"), 1).alias("x")).filter("x <> 0").groupBy(F.abs("x").alias("r")).agg(F.count_if(F.col("x") > 0).alias("up"), F.count_if(F.col("x") < 0).alias("down")).withColumn("_all", F.lit(1))
    w = Window.partitionBy("_all").orderBy("r")
    before = F.sum(F.col("up") + F.col("down")).over(w) - F.col("up") - F.col("down")
    rank = before + (F.col("up") + F.col("down") + 1) / 2
    n = F.col("up") + F.col("down")
    t = v.select("up", "down", rank.alias("rank"), (n * n * n - n).alias("tied")).agg(F.sum(F.col("up") * F.col("rank")).alias("w_up"), F.sum(F.col("down") * F.col("rank")).alias("w_down"), F.sum(n).alias("n"), F.sum("tied").alias("tied"))
    # The normal approximation, with its correction for ties; the tail from a series, as SQL has no error function.
    k = F.col("n")
    z = (F.least("w_up", "w_down") - k * (k + 1) / 4) / F.sqrt(k * (k + 1) * (2 * k + 1) / 24 - F.col("tied") / 48)
    return t.select("w_up", "w_down", F.round(F.least(2 * normal_tail(z), F.lit(1.0)), 5).alias("p"))


# The tables of a test folder.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings behavior_events op_sequences raw_sequences machines event_catalog sample_targets eval_items".split()


def ev10_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of each table."""
    parts = [table(spark, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(table(spark, d, n).columns)).alias("n_columns")) for n in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def str4_history(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 deliveries of each action, by time of arrival and id."""
    e = table(spark, d, "behavior_events").filter("ingested_at IS NOT NULL AND action IS NOT NULL")
    return top_per_group(e.select("action", "ingested_at", "event_id"), ["action"], [F.col("ingested_at").desc(), F.col("event_id").desc()], 100).select("action", "event_id", "rank")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}
from sentrail.queries.features import level_sql, machine_sql  # noqa: E402
from sentrail.queries.profiles import ORACLES as _PROFILES  # noqa: E402

_S = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_LONG = f"{_S}, x AS (SELECT vec_id, label, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS x FROM s)"
_TYPE = "regexp_replace(lower(trim(translate({c}, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ．' || chr(9) || chr(160), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.  '))), '[\\s_/:>.-]+', '.', 'g')"
ORACLES = {
    "src31_dynamic": "SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1",
    "src32_named": "SELECT o_orderpriority, count(*) AS n, 'totals' AS _source FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus, o_orderpriority",
    "src34_scan": "SELECT doc_id, rule, strpos(text, f)::INTEGER - 1 AS start, f AS found FROM (" + " UNION ALL ".join(f"SELECT doc_id, text, '{n}' AS rule, regexp_extract(text, '{p}') AS f FROM documents" for n, p in (("host", "vm[0-9]{4}"), ("ticket", "[A-Z]{2,3}-[0-9]{5}"), ("name", "Halden"))) + ") WHERE f <> ''",
    "src35_stat": "SELECT doc_id FROM documents WHERE file_name IN (SELECT file_name FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "flt20_star": "SELECT *, n_nationkey * 2 AS twice, string_split(n_name, '_')[2] AS no FROM nation",
    "flt26_aligned": f"SELECT m.site, c.base_type, count(*) AS n, count(DISTINCT action) AS n_actions FROM behavior_events e JOIN machines m ON {machine_sql('e.vm_id')} = {machine_sql('m.vm_id')} JOIN event_catalog c ON {_TYPE.format(c='e.event_type')} = c.event_type WHERE coalesce(e.metadata['proc'], '') <> 'sync.exe' GROUP BY ALL",
    "jn17_paired": "SELECT value > 30 AS a, value > 50 AS b, count(*) AS n FROM events GROUP BY ALL",
    "ag14_recent_vectors": f"WITH {_LONG} SELECT vec_id, pos, round(avg(x) OVER (PARTITION BY label, pos ORDER BY vec_id ROWS 29 PRECEDING), 6) AS mean FROM x",
    "ag12_selected": f"WITH g AS ({_PROFILES['ag11_information_gain']}) SELECT pos FROM g WHERE gain > (SELECT avg(gain) + stddev_pop(gain) FROM g)",
    "ag20_counters": f"SELECT 'published.' || coalesce(nullif({_TYPE.format(c='event_type')}, ''), 'none') AS counter, count(*) AS n FROM behavior_events GROUP BY 1",
    "ag32_rates": "SELECT round(avg((length(trim(text)) > 0 AND text IS NOT NULL)::INT), 6) AS has_text, round(avg((lang IS NOT NULL)::INT), 6) AS has_lang, round(avg(coalesce(n_chars = length(text), false)::INT), 6) AS counted FROM documents",
    "wn8_cross_channel": f"""WITH e AS (SELECT {machine_sql('vm_id')} AS k, string_split({_TYPE.format(c='event_type')}, '.')[1] AS t, "timestamp" AS ts FROM behavior_events), f AS (SELECT * FROM e WHERE k IS NOT NULL AND ts IS NOT NULL AND t IN ('file', 'email', 'http', 'im', 'device')),
        w AS (SELECT k, ts, """ + " + ".join(f"max((t = '{t}')::INT) OVER w" for t in ("file", "email", "http", "im", "device")) + " AS n FROM f WINDOW w AS (PARTITION BY k ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)) SELECT k, floor(epoch(min(ts)))::BIGINT AS first FROM w WHERE n >= 3 GROUP BY 1",
    "st9_priority": f"SELECT doc_id, coalesce(4 - right({level_sql('sensitivity_level')}, 1)::INTEGER, 99) AS rank FROM documents",
    "set5_deleted": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
    "set8_recently_used": "SELECT user_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 500",
    "sc2_document_hash": "SELECT doc_id, sha256(coalesce(text, file_name, '')) AS h FROM documents",
    "sc6_nested_json": "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN event_type END AS kind FROM events",
    "sc21_components": "SELECT p[1] AS host, len(p)::INTEGER AS depth, count(*) AS n FROM (SELECT list_filter(string_split_regex(regexp_replace(target, '^[a-z]+://', '/'), '[/\\\\]'), lambda x: x <> '') AS p FROM behavior_events WHERE target LIKE 'https://%') GROUP BY ALL",
    "sc22_index_name": "SELECT event_type, replace(lower(event_type), '.', '_') AS name FROM event_catalog",
    "sc24_mentions": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'attach|enclos|see (the )?file')",
    "sc28_wrapped": "SELECT p_partkey, regexp_replace(to_base64(encode(p_name || ' / ' || p_type)), '(.{16})', '\\1' || chr(10), 'g') AS b FROM part",
    "sc39_mapped": "SELECT CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'account' ELSE 'other' END AS category, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 0 END AS severity, count(*) AS n FROM events GROUP BY ALL",
    "gr10_first_hit": "SELECT CASE WHEN t LIKE '%top secret%' THEN 'L4' WHEN t LIKE '%confidential%' THEN 'L3' WHEN t LIKE '%internal%' THEN 'L2' ELSE 'L1' END AS grade, lang, count(*) AS n FROM (SELECT lower(coalesce(text, '')) AS t, lang FROM documents) GROUP BY ALL",
    "gr11_category_level": "SELECT doc_id, CASE doc_type WHEN 'memo' THEN 'L1' WHEN 'policy' THEN 'L2' ELSE 'L3' END AS level FROM documents WHERE doc_type IN ('memo', 'policy', 'contract_draft')",
    "gr16_prompt": "SELECT doc_id, '[type] ' || coalesce(doc_type, '') || chr(10) || '[text] ' || text[1:500] AS prompt FROM documents WHERE text IS NOT NULL",
    "gr18_fused": f"WITH {_LONG} SELECT label, pos, round(sum(x / (1 + vec_id % 10)) / sum(1 / (1 + vec_id % 10)), 6) AS h FROM x GROUP BY ALL",
    "gr21_misses": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
    "cl14_ema_centres": f"WITH {_LONG} SELECT label, pos, round(0.9 * avg(x) FILTER (vec_id % 2 = 0) + 0.1 * avg(x) FILTER (vec_id % 2 = 1), 6) AS c FROM x GROUP BY ALL HAVING count(*) FILTER (vec_id % 2 = 0) > 0 AND count(*) FILTER (vec_id % 2 = 1) > 0",
    "cl19_feature_row": "SELECT user_id, 3 AS d, round(coalesce(avg(value) FILTER (event_type = 'error'), 0) + coalesce(max(value) FILTER (event_type = 'error'), 0) + count(*) FILTER (value > 90), 4) AS s FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error' OR value > 90) > 0",
    "dc2_mahalanobis": f"WITH {_LONG}, g AS (SELECT label, pos, avg(x) AS m, var_samp(x) AS s FROM x GROUP BY ALL) SELECT vec_id, round(sqrt(sum(pow(x - m, 2) / (s + 1e-6))), 5) AS d FROM x JOIN g USING (label, pos) GROUP BY 1",
    "dc10_one_hot": "SELECT event_id, ((hour(ts) * 60 + minute(ts)) // 30)::INTEGER AS slot, 1.0::DOUBLE AS total FROM events",
    "dc16_grid": "SELECT low, high, round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall, round(fp / (fp + tn + 1e-8), 6) AS fpr, round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8)) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8), 6) AS f1 FROM (SELECT low, high, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT low, high, event_type = 'error' AS y, value > low AND value <= high AS p FROM events, (SELECT unnest([10, 20, 30, 40])::DOUBLE AS low), (SELECT unnest([50, 60, 70, 80])::DOUBLE AS high)) GROUP BY ALL)",
    "ev2_wilcoxon": """WITH m AS (SELECT round(avg(value) FILTER (day(ts) <= 15) - avg(value) FILTER (day(ts) > 15), 1) AS x FROM events GROUP BY user_id), r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2 AS r, pow(count(*) OVER (PARTITION BY abs(x)), 2) - 1 AS tied FROM m WHERE x <> 0),
        s AS (SELECT coalesce(sum(r) FILTER (x > 0), 0) AS w_up, coalesce(sum(r) FILTER (x < 0), 0) AS w_down, count(*) AS n, sum(tied) AS tied FROM r), z AS (SELECT *, abs((least(w_up, w_down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)) AS z FROM s), t AS (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM z)
        SELECT w_up, w_down, round(least(2 * exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * pow(t, 2) + 1.781477937 * pow(t, 3) - 1.821255978 * pow(t, 4) + 1.330274429 * pow(t, 5)), 1.0), 5) AS p FROM t""",
    "ev10_report": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {n})) AS n_columns FROM {n}" for n in TABLES),
    "str4_history": "SELECT action, event_id, row_number() OVER (PARTITION BY action ORDER BY ingested_at DESC, event_id DESC)::INTEGER AS rank FROM behavior_events WHERE ingested_at IS NOT NULL AND action IS NOT NULL QUALIFY rank <= 100",
}
ORACLES["ag13_covariance"] = (f"WITH {_LONG} SELECT a.label, a.pos, b.pos AS other, round(coalesce(covar_samp(a.x, b.x), CASE WHEN a.pos = b.pos THEN 0.01 ELSE 0 END), 8) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.label, a.pos, b.pos")
