"""Profiles, clustering, drift and similarity (AG1, AG8-AG14, CL, DC rows)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrail.functions.scalars import sigmoid
from sentrail.operators import vectors as V
from sentrail.operators.metrics import class_report, fleiss, mcnemar, youden
from sentrail.operators.relational import hash_rank
from sentrail.session import table

#: Centres of these queries: the vectors with the smallest ids.
K = 4


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _centres(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r.v for r in _vectors(spark, d).orderBy("vec_id").limit(K).collect()])


def ag1_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    m = V.grouped_mean(_vectors(spark, d), ["label"], "v", F.col("vec_id") % 5 + 1)
    return m.select("label", "pos", F.round("mean", 6).alias("mean"))


def cl6_nearest(spark: SparkSession, d: str) -> DataFrame:
    c = _centres(spark, d)
    return _vectors(spark, d).select("vec_id", V.nearest_centre(F.col("v"), c.tolist(), [1 / c.shape[1]] * c.shape[1]).alias("cluster"))


def cl3_step(spark: SparkSession, d: str) -> DataFrame:
    """One k-means round from fixed centres: the new centres."""
    c = _centres(spark, d)
    new, _, _ = V.kmeans_step(_vectors(spark, d), "v", c, np.full(c.shape[1], 1 / c.shape[1]))
    rows = [(i, j, round(float(x), 6)) for i, c in enumerate(new) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, pos int, mean double")


def cl4_weights(spark: SparkSession, d: str) -> DataFrame:
    """Dimension weights of one round from scatter within and between clusters."""
    a = cl6_nearest(spark, d).join(_vectors(spark, d), "vec_id").select("cluster", F.posexplode("v").alias("pos", "x"))
    g = a.groupBy("cluster", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))
    t = g.groupBy("pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    s = g.join(t, "pos").groupBy("pos").agg(F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")).alias("within"), F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))).alias("between"))
    w = s.select("pos", (0.6 / (F.col("within") + 1e-8) + 0.4 * F.col("between")).alias("w")).withColumn("_all", F.lit(1))
    return w.select("pos", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("_all")), 6).alias("weight"))


def cl5_kmeans(spark: SparkSession, d: str) -> DataFrame:
    centres, weights, history = V.kmeans(_vectors(spark, d), "v", _centres(spark, d), 20)
    return _vectors(spark, d).select("vec_id", V.nearest_centre(F.col("v"), centres.tolist(), weights.tolist()).alias("cluster"))


def cl7_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette of the vectors whose id is divisible by 20, each against all vectors, by label."""
    e = _vectors(spark, d)
    s = V.cluster_distances(e, e.filter("vec_id % 20 = 0"), "vec_id", "v", "label")
    ab = s.groupBy("query_id").agg(F.max(F.when(F.col("own") == F.col("cluster"), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster"), F.col("s") / F.col("n"))).alias("b"))
    return ab.agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def cl8_calinski(spark: SparkSession, d: str) -> DataFrame:
    g = _vectors(spark, d).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))
    t = g.groupBy("pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("k"))
    s = g.join(t, "pos").agg(F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")).alias("w"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), 2)).alias("b"), F.max("all_n").alias("n"), F.max("k").alias("k"))
    return s.select(F.round((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))), 4).alias("ch"))


def cl9_nmi(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of clusters with labels, normalised by the mean entropy."""
    c = cl6_nearest(spark, d).join(_vectors(spark, d), "vec_id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    w = lambda *p: Window.partitionBy(*p)
    p = c.select((F.col("n") / F.sum("n").over(w("_all"))).alias("p"), (F.sum("n").over(w("cluster")) / F.sum("n").over(w("_all"))).alias("a"), (F.sum("n").over(w("label")) / F.sum("n").over(w("_all"))).alias("b"))
    return p.agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("a") * F.col("b")))) / ((-F.sum(F.col("p") * F.ln("a")) - F.sum(F.col("p") * F.ln("b"))) / 2), 6).alias("nmi"))


def ag11_information_gain(spark: SparkSession, d: str) -> DataFrame:
    """Information gain of each dimension about the label, in ten equal-frequency bins."""
    x = _vectors(spark, d).select("label", F.posexplode("v").alias("pos", "x"))
    cuts = V.quantiles(x, "pos", "x", [i / 10 for i in range(1, 10)])
    b = x.join(F.broadcast(cuts), "pos").select("pos", "label", F.size(F.filter("cuts", lambda c: c <= F.col("x"))).alias("bin"))
    c = b.groupBy("pos", "bin", "label").agg(F.count(F.lit(1)).alias("n"))
    w = lambda *p: Window.partitionBy(*p)
    p = c.select("pos", (F.col("n") / F.sum("n").over(w("pos"))).alias("p"), (F.sum("n").over(w("pos", "bin")) / F.sum("n").over(w("pos"))).alias("a"), (F.sum("n").over(w("pos", "label")) / F.sum("n").over(w("pos"))).alias("b"))
    return p.groupBy("pos").agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("a") * F.col("b")))), 6).alias("gain"))


def cl13_drift(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each user's second half of January from the first, scaled by the first half's variance."""
    e = table(spark, d, "events").select("user_id", "value", (F.dayofmonth("ts") <= 15).alias("early"))
    g = e.groupBy("user_id").agg(F.avg(F.when(F.col("early"), F.col("value"))).alias("m"), F.var_pop(F.when(F.col("early"), F.col("value"))).alias("v"), F.avg(F.when(~F.col("early"), F.col("value"))).alias("m2"), F.count_if("early").alias("n"))
    return g.filter("n >= 2 AND m2 IS NOT NULL").select("user_id", F.round(F.sqrt(F.pow(F.col("m2") - F.col("m"), 2) / (F.col("v") + 1e-6)), 5).alias("distance"))


def dc1_consistency(spark: SparkSession, d: str) -> DataFrame:
    """exp(-KL/2) of each vector's share profile against its label's mean profile."""
    m = V.grouped_mean(_vectors(spark, d), ["label"], "v").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("m"))
    j = _vectors(spark, d).join(m, "label")
    share = lambda c: F.transform(c, lambda x: (F.abs(x) + 1e-8) / F.aggregate(c, F.lit(0.0), lambda s, y: s + F.abs(y) + 1e-8))
    kl = F.aggregate(F.zip_with(share(F.col("v")), share(F.col("m")), lambda p, q: p * F.ln(p / q)), F.lit(0.0), lambda s, x: s + x)
    return j.select("vec_id", F.round(F.exp(-0.5 * kl), 6).alias("s"))


def dc3_environment(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    phi = ((k % 3 == 0).cast("double") + F.hour("ts").between(9, 17).cast("double") + (k % 4 == 0).cast("double") + (k % 3 != 1).cast("double")) / 4
    return table(spark, d, "events").select("event_id", F.round(sigmoid(3 * phi - 1), 6).alias("c"))


def dc9_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_type") == "error").alias("y"), (F.least(F.col("value"), F.lit(100.0)) / 100).alias("s"))
    return youden(e, "y", "s").select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def ev1_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_type") == "error").alias("y"), (F.col("value") > 40).alias("a"), (F.col("value") > 60).alias("b"))
    x, p = mcnemar(e, "y", "a", "b")
    return spark.createDataFrame([(round(x, 4), p < 0.05)], "chi2 double, differs boolean")


def ev3_fleiss(spark: SparkSession, d: str) -> DataFrame:
    """Kappa of three seeded ratings per nation."""
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.col("n_nationkey") % 3, F.col("n_nationkey") % 2, F.col("n_regionkey") % 3)).alias("c"))
    return spark.range(1).select(F.round(fleiss(n, "n_nationkey", "c"), 6).alias("kappa"))


def ev4_folds(spark: SparkSession, d: str) -> DataFrame:
    """Stratified 5 folds of documents by type, in hash order."""
    t = hash_rank(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_type", "doc_id")
    return t.select("doc_id", ((F.col("rank") - 1) % 5).alias("fold"))


def ev5_quotas(spark: SparkSession, d: str) -> DataFrame:
    """At most 18, 22, 12 documents of three types, in hash order (a sampling operator)."""
    q = spark.createDataFrame([("memo", 18), ("policy", 22), ("mail", 12)], "doc_type string, quota int")
    t = hash_rank(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_type", "doc_id").join(q, "doc_type")
    return t.filter("rank <= quota").select("doc_id", "doc_type")


def ag31_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.when(F.col("value") > 40, "error").when(F.col("value") > 20, "view").otherwise("click").alias("p"))
    return class_report(e, "event_type", "p")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}
_S = "s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_LONG = f"{_S}, x AS (SELECT vec_id, label, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS x FROM s)"
_C = f"{_S}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS cv FROM (FROM s ORDER BY vec_id LIMIT {K})), a AS (SELECT vec_id, arg_min(k, (list_distance(v, cv), k))::INTEGER AS cluster FROM s, c GROUP BY 1)"
_AX = f"{_C}, x AS (SELECT s.vec_id, label, cluster, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS x FROM s JOIN a USING (vec_id))"
ORACLES = {
    "ag1_weighted_mean": f"WITH {_LONG} SELECT label, pos, round(sum(x * (vec_id % 5 + 1)) / (sum(vec_id % 5 + 1) + 1e-8), 6) AS mean FROM x GROUP BY ALL",
    "cl6_nearest": f"WITH {_C} FROM a",
    "cl3_step": f"WITH {_AX} SELECT cluster, pos, round(avg(x), 6) AS mean FROM x GROUP BY ALL",
    "cl4_weights": f"WITH {_AX}, g AS (SELECT cluster, pos, count(*) AS n, avg(x) AS m, sum(x * x) AS q FROM x GROUP BY ALL), t AS (SELECT pos, avg(x) AS mu FROM x GROUP BY 1), s2 AS (SELECT pos, sum(q - n * m * m) AS w, sum(n * (m - mu) * (m - mu)) AS b FROM g JOIN t USING (pos) GROUP BY 1), w AS (SELECT pos, 0.6 / (w + 1e-8) + 0.4 * b AS w FROM s2) SELECT pos, round(w / sum(w) OVER (), 6) AS weight FROM w",
    "cl7_silhouette": f"WITH {_S}, p AS (SELECT a.vec_id, a.label AS own, b.label AS cluster, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM s a JOIN s b ON true WHERE a.vec_id % 20 = 0 GROUP BY ALL), q AS (SELECT vec_id, max(s / greatest(n - 1, 1)) FILTER (own = cluster) AS a, min(s / n) FILTER (own <> cluster) AS b FROM p GROUP BY 1) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM q",
    "cl8_calinski": f"WITH {_LONG}, g AS (SELECT label, pos, count(*) AS n, avg(x) AS m, sum(x * x) AS q FROM x GROUP BY ALL), t AS (SELECT pos, avg(x) AS mu FROM x GROUP BY 1), s2 AS (SELECT sum(q - n * m * m) AS w, sum(n * (m - mu) * (m - mu)) AS b FROM g JOIN t USING (pos)) SELECT round((b / ((SELECT count(DISTINCT label) FROM s) - 1)) / (w / ((SELECT count(*) FROM s) - (SELECT count(DISTINCT label) FROM s))), 4) AS ch FROM s2",
    "cl9_nmi": f"WITH {_C}, n AS (SELECT cluster, label, count(*) AS n FROM a JOIN s USING (vec_id) GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY cluster) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY label) / sum(n) OVER () AS b FROM n) SELECT round(sum(p * ln(p / (a * b))) / ((-sum(p * ln(a)) - sum(p * ln(b))) / 2), 6) AS nmi FROM p",
    "ag11_information_gain": f"WITH {_LONG}, k AS (SELECT pos, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM x GROUP BY 1), b AS (SELECT pos, label, len(list_filter(cuts, lambda c: c <= x)) AS bin FROM x JOIN k USING (pos)), n AS (SELECT pos, bin, label, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS p, sum(n) OVER (PARTITION BY pos, bin) / sum(n) OVER (PARTITION BY pos) AS a, sum(n) OVER (PARTITION BY pos, label) / sum(n) OVER (PARTITION BY pos) AS b FROM n) SELECT pos, round(sum(p * ln(p / (a * b))), 6) AS gain FROM p GROUP BY 1",
    "cl13_drift": "SELECT user_id, round(sqrt(pow(m2 - m, 2) / (v + 1e-6)), 5) AS distance FROM (SELECT user_id, avg(value) FILTER (day(ts) <= 15) AS m, var_pop(value) FILTER (day(ts) <= 15) AS v, avg(value) FILTER (day(ts) > 15) AS m2, count(*) FILTER (day(ts) <= 15) AS n FROM events GROUP BY 1) WHERE n >= 2 AND m2 IS NOT NULL",
    "dc1_consistency": f"WITH {_LONG}, m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), p AS (SELECT vec_id, (abs(x) + 1e-8) / sum(abs(x) + 1e-8) OVER (PARTITION BY vec_id) AS p, (abs(m) + 1e-8) / sum(abs(m) + 1e-8) OVER (PARTITION BY vec_id) AS q FROM x JOIN m USING (label, pos)) SELECT vec_id, round(exp(-0.5 * sum(p * ln(p / q))), 6) AS s FROM p GROUP BY 1",
    "dc3_environment": "SELECT event_id, round(1 / (1 + exp(-(3 * ((k % 3 = 0)::INT + (hour(ts) BETWEEN 9 AND 17)::INT + (k % 4 = 0)::INT + (k % 3 <> 1)::INT) / 4 - 1))), 6) AS c FROM (SELECT *, (props::JSON->>'k')::INTEGER AS k FROM events)",
    "dc9_threshold": "WITH v AS (SELECT round(least(value, 100) / 100, 3) AS threshold, count(*) FILTER (event_type = 'error') AS p, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY 1), r AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER () AS fpr FROM v) SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r WHERE fpr <= 0.05 ORDER BY tpr - r.fpr DESC, threshold DESC LIMIT 1",
    "ev1_mcnemar": "SELECT round(pow(abs(x - y) - 1, 2) / (x + y), 4) AS chi2, pow(abs(x - y) - 1, 2) / (x + y) > 3.841459 AS differs FROM (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM (SELECT (event_type = 'error') = (value > 40) AS a, (event_type = 'error') = (value > 60) AS b FROM events))",
    "ev3_fleiss": "WITH r AS (SELECT n_nationkey AS i, unnest([n_nationkey % 3, n_nationkey % 2, n_regionkey % 3]) AS c FROM nation), n AS (SELECT i, c, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT avg((q - 3) / (6 + 1e-8)) AS a FROM (SELECT i, sum(n * n) AS q FROM n GROUP BY 1)), e AS (SELECT sum(pow(s / 75, 2)) AS e FROM (SELECT sum(n) AS s FROM n GROUP BY c)) SELECT round((a - e) / (1 - e + 1e-8), 6) AS kappa FROM a, e",
    "ev4_folds": "SELECT doc_id, ((row_number() OVER (PARTITION BY doc_type ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5)::INTEGER AS fold FROM documents",
    "ev5_quotas": "SELECT doc_id, doc_type FROM documents WHERE doc_type IN ('memo', 'policy', 'mail') QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY md5(doc_id::VARCHAR), doc_id) <= CASE doc_type WHEN 'memo' THEN 18 WHEN 'policy' THEN 22 ELSE 12 END",
    "ag31_report": """WITH s AS (SELECT event_type AS y, CASE WHEN value > 40 THEN 'error' WHEN value > 20 THEN 'view' ELSE 'click' END AS p FROM events), c AS (SELECT y AS cls FROM s UNION SELECT p FROM s),
        k AS (SELECT cls, (SELECT count(*) FROM s WHERE y = cls) AS t, (SELECT count(*) FROM s WHERE p = cls) AS p, (SELECT count(*) FROM s WHERE y = cls AND p = cls) AS h FROM c), m AS (SELECT cls, t, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS re FROM k)
        SELECT cls, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, t AS support FROM m""",
}
