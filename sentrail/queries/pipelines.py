"""Composed rows of the survey: scoring, grading and its ablations, baselines, template checks, fifo as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.functions.canon import level_key, machine_key
from sentrail.operators import pipelines as P
from sentrail.operators import rules as RL
from sentrail.operators import vectors as V
from sentrail.queries.features import level_sql, machine_sql
from sentrail.queries.joins import ORACLES as _JOINS
from sentrail.queries.profiles import ORACLES as _PROFILES
from sentrail.queries.profiles import K, _centres, _vectors, ag11_information_gain
from sentrail.queries.rules import ORACLES as _RULES
from sentrail.queries.rules import gr1_graded, gr6_entity_grade
from sentrail.session import table
from sentrail.streaming.standing import drain, fifo_stream, table_stream

TEMPLATES = [
    (0, "usb", ["copy", "move"], "exfil", "high", 40.0, "L2"), (1, "usb", ["copy"], "exfil", "low", 50.0, "L3"), (2, "usb", ["any"], "probe", "low", 9.0, None), (3, "mail", ["send"], "exfil", "high", 12.0, "L1"),
    (4, "mail", ["send", "forward"], "exfil", "high", 70.0, "L4"), (5, "mail", ["read"], "exfil", "low", 8.0, "L2"), (6, "web", ["upload"], "exfil", None, 20.0, "L2"),
]
_TEMPLATE_COLUMNS = "template_no int, category string, actions array<string>, alert string, severity string, mem double, least_level string"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    phi = ((k % 3 == 0).cast("double") + F.hour("ts").between(9, 17).cast("double")) / 2
    return P.score_events(table(spark, d, "events"), "user_id", "event_type", "value", phi, P.Scoring())


def dc12_scored(spark: SparkSession, d: str) -> DataFrame:
    """Every event through look-up, deviation, consistency, environment, score and decision, in one plan."""
    return _scored(spark, d).select("event_id", F.round("consistency", 5).alias("consistency"), F.round("deviation", 4).alias("deviation"), F.round("confidence", 5).alias("confidence"), F.round("score", 5).alias("score"))


def dc13_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The same over a batch, counted by event type and decision."""
    return _scored(spark, d).groupBy("event_type", "decision").agg(F.count(F.lit(1)).alias("n"))


def dc11_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile vectors of users: two parts where both are there, zeros otherwise; length and sum."""
    e = table(spark, d, "events")
    a = F.array(F.avg(F.when(F.col("event_type") == "error", F.col("value"))))
    b = F.array(F.max(F.when(F.col("event_type") == "view", F.col("value"))), F.count_if(F.col("event_type") == "view").cast("double"))
    g = e.groupBy("user_id").agg(a.alias("a"), b.alias("b"))
    part = lambda c: F.when(F.col(c)[0].isNotNull(), F.col(c))
    v = P.profile_vector(F.lit(None).cast("array<double>"), [part("a"), part("b")], 3)
    return g.select("user_id", F.size(v).alias("d"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


def dc15_detectors(spark: SparkSession, d: str) -> DataFrame:
    """Documents flagged by the pattern grade, by the entity grade, and by both."""
    j = gr1_graded(spark, d).select("doc_id", (F.col("grade") >= "L3").alias("static")).join(gr6_entity_grade(spark, d).select("doc_id", (F.col("grade") >= "L3").alias("entities")), "doc_id", "left").na.fill(False)
    return j.agg(F.count_if("static").alias("static"), F.count_if("entities").alias("entities"), F.count_if(F.col("static") & F.col("entities")).alias("both"))


def _graded(spark: SparkSession, d: str, **without: object) -> DataFrame:
    docs = table(spark, d, "documents")
    return P.grade_by_votes(docs, "doc_id", "text", "doc_type", level_key(F.col("sensitivity_level")), without.pop("profile", machine_key(F.col("author_vm_id"))), **without)


def gr14_graded(spark: SparkSession, d: str) -> DataFrame:
    """Retrieve three cases, write the prompt, take five votes."""
    return _graded(spark, d).select("doc_id", "level", F.round("share", 6).alias("share"), "accepted")


def gr15_ablations(spark: SparkSession, d: str) -> DataFrame:
    """Grades and acceptance without the profile, without cases, and by one vote."""
    parts = {"no_profile": {"profile": F.lit(None)}, "no_cases": {"cases": 0}, "one_vote": {"votes": 1}}
    out = [_graded(spark, d, **x).groupBy("level", "accepted").agg(F.count(F.lit(1)).alias("n")).withColumn("variant", F.lit(name)) for name, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def gr22_regrade(spark: SparkSession, d: str) -> DataFrame:
    """Documents graded before their author's machine was enrolled, with the highest grades first."""
    docs = table(spark, d, "documents").select("doc_id", machine_key(F.col("author_vm_id")).alias("who"), F.unix_seconds("modified_at").alias("version"), level_key(F.col("sensitivity_level")).alias("level"))
    machines = table(spark, d, "machines").select(machine_key(F.col("vm_id")).alias("who"), F.unix_seconds("enrolled_at").alias("version"))
    rank = F.coalesce(4 - F.substring("level", 2, 1).cast("int"), F.lit(99))
    return P.to_regrade(docs, machines, "who", "version", rank).select("doc_id", "priority", "new_version").orderBy("priority", "doc_id")


def cl2_gain_weights(spark: SparkSession, d: str) -> DataFrame:
    """Starting weights of k-means: each dimension's information gain as a share of all."""
    g = {r.pos: r.gain for r in ag11_information_gain(spark, d).collect()}  # one number a dimension
    return spark.createDataFrame([(i, round(float(w), 6)) for i, w in enumerate(V.gain_weights([g[i] for i in sorted(g)]))], "pos int, weight double")


def cl10_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A Gaussian mixture as a baseline: cluster sizes."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    e = _vectors(spark, d).select("vec_id", array_to_vector("v").alias("features"))
    return GaussianMixture(k=K, seed=1, maxIter=5).fit(e).transform(e).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


def cl10_entropy_weights(spark: SparkSession, d: str) -> DataFrame:
    """Dimension weights of the entropy-weighted baseline: entropy of ten equal bins, as a share of all."""
    return spark.createDataFrame([(i, round(float(w), 6)) for i, w in enumerate(V.entropy_weights(_vectors(spark, d), "v"))], "pos int, weight double")


def cl10_entropy_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """k-means under entropy weights: cluster sizes."""
    e = _vectors(spark, d)
    w = V.entropy_weights(e, "v")
    centres, _, _ = V.kmeans(e, "v", _centres(spark, d), 20, weights=w, fixed_weights=True)
    return e.groupBy(V.nearest_centre(F.col("v"), centres.tolist(), w.tolist()).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def cl11_weights(spark: SparkSession, d: str) -> DataFrame:
    """Dimension weights by three rules: equal, term frequency by rarity, principal components."""
    e = _vectors(spark, d)
    rows = [(name, i, round(float(x), 6)) for name, w in (("equal", V.equal_weights(e, "v")), ("tfidf", V.tfidf_weights(e, "v"))) for i, x in enumerate(w)]
    return spark.createDataFrame(rows, "rule string, pos int, weight double")


def cl11_pca_weights(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(V.pca_weights(_vectors(spark, d), "v"))], "pos int, weight double")


def jn13_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of templates of a category that share an action and disagree, or need too much memory together."""
    return RL.template_conflicts(spark.createDataFrame(TEMPLATES, _TEMPLATE_COLUMNS), 50.0)


def rl10_synthesized(spark: SparkSession, d: str) -> DataFrame:
    """Templates that pass verification for a wanted action, level and budget, cheapest first."""
    return RL.verified(spark.createDataFrame(TEMPLATES, _TEMPLATE_COLUMNS), ["send", "copy"], "L3", 60.0).select("template_no", "mem").orderBy("mem", "template_no")


def rl16_responses(spark: SparkSession, d: str) -> DataFrame:
    """What a rule's text asks for."""
    texts = [(1, "SELECT * FROM e WHERE sensitivity >= 4"), (2, "SELECT * FROM e WHERE sensitivity = 4"), (3, "SELECT * FROM e WHERE sensitivity >= 3"), (4, None)]
    return spark.createDataFrame(texts, "rule_no int, query string").select("rule_no", RL.response_of(F.col("query")).alias("response"))


def jn4_owner_profile(spark: SparkSession, d: str) -> DataFrame:
    """The cluster that stands for the level of each document, 0 where there is none."""
    level = level_key(F.col("sensitivity_level"))
    c = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"L1": 0, "L2": 0, "L3": 1, "L4": min(2, K - 1)}.items() for x in kv]), level), F.lit(0))
    return table(spark, d, "documents").select("doc_id", c.alias("cluster"))


def sc31_inclusive_hours(spark: SparkSession, d: str) -> DataFrame:
    """Working hours as rules have them: 9 to 18, both included, any day."""
    return table(spark, d, "events").groupBy(F.hour("ts").between(9, 18).alias("at_work")).agg(F.count(F.lit(1)).alias("n"))


def str8_fifo_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last 5 errors of the hour before it, as a stream."""
    s = table_stream(spark, d, "events")
    out = fifo_stream(s, "user_id", "ts", "event_id", "event_type = 'purchase'", "event_type = 'error'", 5, 3600)
    return drain(out).select("event_id", F.array_join("recent", ",").alias("recent"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_SCORED = """WITH e AS (SELECT *, (props::JSON->>'k')::INTEGER AS k FROM events), b AS (SELECT user_id, avg(value) AS m, var_pop(value) AS v, count(*) AS a FROM events GROUP BY 1), n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT event_id, event_type, exp(0.5 * ln(n / a)) AS consistency, CASE WHEN v > 0 THEN abs(value - m) / sqrt(v + 1e-6) ELSE 0 END AS deviation, 1 / (1 + exp(-(3 * ((k % 3 = 0)::INT + (hour(ts) BETWEEN 9 AND 17)::INT) / 2 - 1))) AS confidence FROM e JOIN b USING (user_id) JOIN n USING (user_id, event_type)),
s AS (SELECT *, (1 - consistency) / 3 + least(deviation / 5, 1) / 3 + (1 - confidence) / 3 AS score FROM p)
"""
_LEVEL, _WHO = level_sql("sensitivity_level"), machine_sql("author_vm_id")


def _votes_sql(cases: int, votes: int, who: str) -> str:
    near = f"list_filter(coalesce(h, []), lambda c: c.id <> d.doc_id)[1:{cases}]" if cases else "[]"
    return f"""WITH d AS (SELECT doc_id, doc_type, coalesce(text, '') AS t, {_LEVEL} AS own, {who} AS who FROM documents),
f AS (SELECT * FROM d WHERE own IS NOT NULL AND doc_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY doc_id) <= {cases + 1}), h AS (SELECT doc_type, list({{'id': doc_id, 'own': own}} ORDER BY doc_id) AS h FROM f GROUP BY 1),
p AS (SELECT d.doc_id, coalesce(who, '') || '|' || array_to_string({f"list_transform({near}, lambda c: c.own)" if cases else "[]::VARCHAR[]"}, ',') || '|' || t AS prompt FROM d LEFT JOIN h USING (doc_type)),
v AS (SELECT doc_id, s AS seed, (('0x' || md5(prompt || '|' || s)[1:8])::BIGINT % 4)::INTEGER AS level FROM p, (SELECT unnest(range({votes})) AS s)), n AS (SELECT doc_id, level, count(*) AS n, min(seed) AS f FROM v GROUP BY ALL)
SELECT doc_id, level, round(n / {votes}, 6) AS share, n / {votes} > 0.5 AS accepted FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1"""


_X = "x AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"
_T = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{c}', {a}, '{k}', {'NULL' if s is None else repr(s)}, {m}, {'NULL' if lv is None else repr(lv)})" for n, c, a, k, s, m, lv in TEMPLATES) + ") AS v(template_no, category, actions, alert, severity, mem, least_level))"
_PAIR = f"WITH {_T}, p AS (SELECT a.template_no AS a_no, b.template_no AS b_no, a.alert = b.alert AND a.severity <> b.severity AS clash, a.mem + b.mem > 100 AS heavy FROM t a JOIN t b ON a.category = b.category AND a.template_no < b.template_no AND (len(list_intersect(a.actions, b.actions)) > 0 OR list_contains(a.actions, 'any') OR list_contains(b.actions, 'any')))"
ORACLES = {
    "dc12_scored": _SCORED + "SELECT event_id, round(consistency, 5) AS consistency, round(deviation, 4) AS deviation, round(confidence, 5) AS confidence, round(score, 5) AS score FROM s",
    "dc13_decisions": _SCORED + "SELECT event_type, CASE WHEN score < 0.5 THEN 'pass' WHEN score < 0.7 THEN 'alert' ELSE 'block' END AS decision, count(*) AS n FROM s GROUP BY ALL",
    "dc11_profile": "SELECT user_id, 3 AS d, round(coalesce(e + v + n, 0), 4) AS s FROM (SELECT user_id, avg(value) FILTER (event_type = 'error') AS e, max(value) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY 1)",
    "dc15_detectors": f"WITH a AS ({_RULES['gr1_graded']}), b AS ({_RULES['gr6_entity_grade']}) SELECT count(*) FILTER (a.grade >= 'L3') AS static, count(*) FILTER (b.grade >= 'L3') AS entities, count(*) FILTER (a.grade >= 'L3' AND b.grade >= 'L3') AS \"both\" FROM a LEFT JOIN b USING (doc_id)",
    "gr14_graded": _votes_sql(3, 5, _WHO),
    "gr15_ablations": " UNION ALL ".join(f"SELECT level, accepted, count(*) AS n, '{v}' AS variant FROM ({_votes_sql(c, n, w)}) GROUP BY ALL" for v, c, n, w in (("no_profile", 3, 5, "NULL"), ("no_cases", 0, 5, _WHO), ("one_vote", 3, 1, _WHO))),
    "gr22_regrade": f"SELECT doc_id, coalesce(4 - right({_LEVEL}, 1)::INTEGER, 99) AS priority, floor(epoch(enrolled_at))::BIGINT AS new_version FROM documents JOIN machines ON {_WHO} = {machine_sql('vm_id')} WHERE coalesce(floor(epoch(modified_at)), -1) < floor(epoch(enrolled_at))",
    "cl2_gain_weights": f"WITH g AS ({_PROFILES['ag11_information_gain']}) SELECT pos, round(greatest(gain, 0) / sum(greatest(gain, 0)) OVER (), 6) AS weight FROM g",
    "cl10_entropy_weights": f"WITH {_X}, m AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1), n AS (SELECT pos, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) AS n FROM x JOIN m USING (pos) GROUP BY ALL), h AS (SELECT pos, -sum(p * ln(p)) AS h FROM (SELECT pos, n / sum(n) OVER (PARTITION BY pos) AS p FROM n) GROUP BY 1) SELECT pos, round(h / sum(h) OVER (), 6) AS weight FROM h",
    "cl11_weights": f"WITH {_X}, s AS (SELECT pos, avg(abs(x)) AS tf, avg((abs(x) > 0.1)::INT) AS df FROM x GROUP BY 1), w AS (SELECT pos, tf / (max(tf) OVER () + 1e-12) * ln(1 / (df + 1e-12) + 1) AS w FROM s) SELECT 'tfidf' AS rule, pos, round(w / (sum(w) OVER () + 1e-12), 6) AS weight FROM w UNION ALL SELECT 'equal', pos, round(1 / count(*) OVER (), 6) FROM s",
    "jn13_conflicts": _PAIR + " SELECT a_no, b_no, 'severity' AS reason FROM p WHERE clash UNION ALL SELECT a_no, b_no, 'memory' FROM p WHERE heavy",
    "rl10_synthesized": f"WITH {_T} SELECT template_no, mem::DOUBLE AS mem FROM t WHERE mem <= 60 AND (len(list_intersect(actions, ['send', 'copy'])) > 0 OR list_contains(actions, 'any')) AND coalesce(least_level >= 'L3', true)",
    "rl16_responses": "SELECT * FROM (VALUES (1, 'block'), (2, 'block'), (3, 'alert'), (4, 'alert')) AS t(rule_no, response)",
    "jn4_owner_profile": f"SELECT doc_id, coalesce(CASE {_LEVEL} WHEN 'L3' THEN 1 WHEN 'L4' THEN 2 END, 0) AS cluster FROM documents",
    "sc31_inclusive_hours": "SELECT hour(ts) BETWEEN 9 AND 18 AS at_work, count(*) AS n FROM events GROUP BY 1",
    "str8_fifo_stream": _JOINS["jn15_fifo"],
}
