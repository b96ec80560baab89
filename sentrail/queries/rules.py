"""Rules as data (RL rows), text grading by rule tables and entity patterns (GR rows), seeded votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrail.functions.scalars import hash_choice
from sentrail.operators import rules as RL
from sentrail.operators.folds import ordered_fold
from sentrail.session import table

RULES = [
    {"id": "r1", "where": [["event_type", "==", "error"], ["value", ">", 40.0]]},
    {"id": "r2", "logic": "or", "where": [["user_id", "in", [1, 2, 3]], ["event_type", "contains", "chase"]]},
    {"id": "r3", "where": [["event_type", "matches", "^(view|click)$"], ["value", "<=", 5.0], ["user_id", "not_in", [4, 5]]]},
    {"id": "r4", "where": [["value", "!=", 1.0], ["user_id", "<", 10]]},
]
ATTRIBUTES = ["event_type", "value", "user_id"]
# Patterns and the grade that a match gives, weakest first.
GRADES = [("L2", "contract|vertrag|合同"), ("L3", "salary|payroll|lohn|工资"), ("L4", "key register|schlüsselverzeichnis|密钥")]
ENTITIES = {"host": r"vm\d{4}", "ticket": r"[A-Z]{2,3}-\d{5}", "amount": r"\d{1,3}(?:,\d{3})+"}
MOVES = {("s", "error"): "e", ("e", "error"): "e", ("e", "purchase"): "p", ("p", "view"): "p", ("s", "view"): "s", ("s", "click"): "s"}


def rl1_matches(spark: SparkSession, d: str) -> DataFrame:
    return RL.evaluate(table(spark, d, "events"), RULES).select("event_id", "rule_id")


def rl2_checked(spark: SparkSession, d: str) -> DataFrame:
    bad = [{"id": "b1", "where": [["colour", "==", 1]]}, {"id": "b2", "where": [["value", "~", 1]]}, {"id": "b3", "where": [["value", "in", 3]]}]
    return spark.createDataFrame([(r["id"], "; ".join(RL.errors(r, ATTRIBUTES))) for r in RULES + bad], "rule_id string, errors string")


def rl3_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Constraints read from policy sentences by patterns."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"The rule fires when a file of grade [^.\n]+"), F.lit(0))).alias("s"))
    return t.groupBy(F.regexp_extract("s", r"grade (.+) leaves", 1).alias("grade"), F.regexp_extract("s", r"leaves by an? (.+) outside", 1).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def rl4_grammar(spark: SparkSession, d: str) -> DataFrame:
    """The grammar state after all of each user's event types, in order of time, folded row by row."""
    states = ordered_fold(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], lambda: ("s", 0), _moved, "user_id long, n long, state string")
    return states.groupBy("user_id").agg(F.max_by("state", "n").alias("state"))


def _moved(state: tuple[str, int], row: object) -> tuple[tuple[str, int], tuple]:
    now, n = MOVES.get((state[0], row.event_type), "fail"), state[1] + 1
    return (now, n), (row.user_id, n, now)


def rl6_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, ["finance", "ops"][: 1 + i % 2], ["file", "email", "http"][i % 3 :], float(4 + i)) for i in range(8)]
    return RL.rank_templates(spark.createDataFrame(rows, "template_no int, roles array<string>, kinds array<string>, cost double"), ["finance"], ["file", "http"])


def rl12_as_sql(spark: SparkSession, d: str) -> DataFrame:
    """Rules as query text, run as such."""
    parts = [spark.sql(RL.sql_text(r, "{events}"), events=table(spark, d, "events")).groupBy().agg(F.lit(r["id"]).alias("rule_id"), F.count(F.lit(1)).alias("n")) for r in RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rl14_conflicts(spark: SparkSession, d: str) -> DataFrame:
    some = [*RULES, {"id": "c1", "where": [["value", ">", 5], ["value", "<", 3]]}, {"id": "c2", "where": [["event_type", "==", "a"], ["event_type", "!=", "a"]]}, {"id": "c3", "where": [["value", ">=", 3], ["value", "<=", 3]]}]
    return spark.createDataFrame([(r["id"], RL.contradicts(r), RL.is_well_formed(RL.sql_text(r, "t"))) for r in some], "rule_id string, contradicts boolean, well_formed boolean")


def gr1_graded(spark: SparkSession, d: str) -> DataFrame:
    """Grade of a text: the highest whose pattern stands in it, L1 if none; confidence by number of patterns."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(g)) for g, p in GRADES]))
    g = table(spark, d, "documents").select("doc_id", F.coalesce(F.array_max(hits), F.lit("L1")).alias("grade"), F.size(hits).alias("n"))
    return g.select("doc_id", "grade", F.round(F.least(0.5 + 0.1 * F.col("n"), F.lit(0.95)), 6).alias("confidence"))


def gr5_entities(spark: SparkSession, d: str) -> DataFrame:

    def found(kind: str, pattern: str) -> F.Column:
        return F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity")))

    kinds = [found(k, p) for k, p in ENTITIES.items()]
    return table(spark, d, "documents").select("doc_id", F.explode(F.concat(*kinds)).alias("e")).select("doc_id", "e.*").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("n_distinct"))


def gr6_entity_grade(spark: SparkSession, d: str) -> DataFrame:
    """Grade from entity counts: any host L2, five or more amounts L3, three or more L3 kinds of tickets L4."""
    e = gr5_entities(spark, d)
    c = e.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ENTITIES])
    return c.select("doc_id", F.when(F.col("ticket") >= 3, "L4").when(F.col("amount") >= 5, "L3").when(F.col("host") > 0, "L2").otherwise("L1").alias("grade"))


def gr13_votes(spark: SparkSession, d: str) -> DataFrame:
    """Five seeded votes per document: the winner (ties: first seed), its share, and whether it is accepted."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seed"), F.coalesce("text", F.lit("")).alias("t"))
    v = t.select("doc_id", "seed", hash_choice(F.concat("t", F.lit("|"), F.col("seed").cast("string")), 4).alias("level"))
    n = v.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("first"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first"))).filter("r = 1")
    return r.select("doc_id", "level", F.round(F.col("n") / 5, 6).alias("share"), (F.col("n") >= 3).alias("accepted"))


def gr20_level_changes(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose grade by text differs from the label they carry."""
    from sentrail.functions.canon import level_key

    g = gr1_graded(spark, d)
    old = table(spark, d, "documents").select("doc_id", level_key(F.col("sensitivity_level")).alias("old"))
    return g.join(old, "doc_id").filter("old <> grade").groupBy("old", F.col("grade").alias("new")).agg(F.count(F.lit(1)).alias("n"))


def gr23_stale(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.filter(F.col("modified_at") < F.lit("2024-01-01").cast("timestamp") - F.expr("INTERVAL 400 DAYS")).select("doc_id")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}
_GRADED = "SELECT doc_id, CASE WHEN l4 THEN 'L4' WHEN l3 THEN 'L3' WHEN l2 THEN 'L2' ELSE 'L1' END AS grade, round(least(0.5 + 0.1 * (l2::INT + l3::INT + l4::INT), 0.95)::DOUBLE, 6) AS confidence FROM (SELECT doc_id, " + ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{p}') AS {g.lower()}" for g, p in GRADES) + " FROM documents)"
_ENTITY = "SELECT doc_id, kind, count(*) AS n, count(DISTINCT e) AS n_distinct FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS e FROM documents" for k, p in ENTITIES.items()) + ") GROUP BY ALL"
from sentrail.queries.features import level_sql  # noqa: E402

_RULE_SQL = {"r1": "event_type = 'error' AND value > 40", "r2": "user_id IN (1, 2, 3) OR event_type LIKE '%chase%'", "r3": "event_type IN ('view', 'click') AND value <= 5 AND user_id NOT IN (4, 5)", "r4": "value <> 1 AND user_id < 10"}
ORACLES = {
    "rl1_matches": " UNION ALL ".join(f"SELECT event_id, '{k}' AS rule_id FROM events WHERE {w}" for k, w in _RULE_SQL.items()),
    "rl3_parsed": "SELECT regexp_extract(s, 'grade (.+) leaves', 1) AS grade, regexp_extract(s, 'leaves by an? (.+) outside', 1) AS channel, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'The rule fires when a file of grade [^.\\n]+')) AS s FROM documents) GROUP BY ALL",
    "rl12_as_sql": " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) AS n FROM events WHERE {w}" for k, w in _RULE_SQL.items()),
    "gr1_graded": _GRADED,
    "gr5_entities": _ENTITY,
    "gr6_entity_grade": f"SELECT doc_id, CASE WHEN coalesce(sum(n) FILTER (kind = 'ticket'), 0) >= 3 THEN 'L4' WHEN coalesce(sum(n) FILTER (kind = 'amount'), 0) >= 5 THEN 'L3' WHEN coalesce(sum(n) FILTER (kind = 'host'), 0) > 0 THEN 'L2' ELSE 'L1' END AS grade FROM ({_ENTITY}) GROUP BY 1",
    "gr13_votes": "WITH v AS (SELECT doc_id, s AS seed, (('0x' || md5(coalesce(text, '') || '|' || s)[1:8])::BIGINT % 4)::INTEGER AS level FROM documents, (SELECT unnest(range(5)) AS s)), n AS (SELECT doc_id, level, count(*) AS n, min(seed) AS f FROM v GROUP BY ALL) SELECT doc_id, level, round(n / 5, 6) AS share, n >= 3 AS accepted FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1",
    "gr20_level_changes": f"SELECT old, grade AS new, count(*) AS n FROM ({_GRADED}) JOIN (SELECT doc_id, {level_sql('sensitivity_level')} AS old FROM documents) USING (doc_id) WHERE old <> grade GROUP BY ALL",
    "gr23_stale": "SELECT doc_id FROM documents WHERE modified_at < TIMESTAMPTZ '2024-01-01 00:00:00+00' - INTERVAL 400 DAY",
    "rl2_checked": "SELECT * FROM (VALUES ('r1', ''), ('r2', ''), ('r3', ''), ('r4', ''), ('b1', 'attribute colour'), ('b2', 'operator ~'), ('b3', 'value of value in')) AS t(rule_id, errors)",
    "rl4_grammar": "WITH RECURSIVE o AS (SELECT user_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 's' AS s FROM o UNION ALL SELECT o.user_id, o.i, CASE " + " ".join(f"WHEN r.s = '{a}' AND o.e = '{t}' THEN '{b}'" for (a, t), b in MOVES.items()) + " ELSE 'fail' END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, arg_max(s, i) AS state FROM r GROUP BY 1",
    "rl6_ranked": """WITH t AS (SELECT i::INTEGER AS template_no, ['finance', 'ops'][1:1 + i % 2] AS roles, ['file', 'email', 'http'][1 + i % 3:] AS kinds, 4.0 + i AS cost FROM (SELECT unnest(range(8)) AS i)),
        s AS (SELECT template_no, len(list_intersect(roles, ['finance'])) / len(list_distinct(list_concat(roles, ['finance']))) AS a, len(list_intersect(kinds, ['file', 'http'])) / len(list_distinct(list_concat(kinds, ['file', 'http']))) AS b, 1 - cost / max(cost) OVER () AS c FROM t)
        SELECT template_no, round(0.4 * a + 0.4 * b + 0.2 * c, 6) AS score FROM s ORDER BY 0.4 * a + 0.4 * b + 0.2 * c DESC, template_no LIMIT 5""",
    "rl14_conflicts": "SELECT * FROM (VALUES ('r1', false, true), ('r2', false, true), ('r3', false, true), ('r4', false, true), ('c1', true, true), ('c2', true, true), ('c3', false, true)) AS t(rule_id, contradicts, well_formed)",
}
