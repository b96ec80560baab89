"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentrail.operators.entity_features import feature_cells, feature_table
from sentrail.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cells = feature_cells(table(spark, d, "behavior_events"), table(spark, d, "machines"), table(spark, d, "event_catalog"))
    return cells.select("vm_id", "event_type", "sensitivity_level", "n_events", "last_seen")


def p6_features(spark: SparkSession, d: str) -> DataFrame:
    machines = table(spark, d, "machines")
    wide = feature_table(feature_cells(table(spark, d, "behavior_events"), machines, table(spark, d, "event_catalog")), machines)
    return wide.selectExpr("vm_id", "n_events", "total_steps", "last_seen", "cardinality(count_by_type) AS n_types", "coalesce(try_element_at(count_by_level, 'L4'), 0) AS n_l4", "coalesce(try_element_at(last_by_type, 'file'), 0) AS last_file")


_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_FOLD = "lower(trim(translate({c}, '" + _WIDE + "' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288), '" + _NARROW.replace("'", "''").replace("{", "{{").replace("}", "}}") + "     ')))"


def fold_sql(c: str) -> str:
    return _FOLD.format(c=c)


def machine_sql(c: str) -> str:
    return f"nullif(regexp_extract({fold_sql(c)}, '^([a-z]+)[-_ ]*0*([0-9]+)(\\.[a-z0-9.-]*)?$', 1) || ':' || regexp_extract({fold_sql(c)}, '^([a-z]+)[-_ ]*0*([0-9]+)(\\.[a-z0-9.-]*)?$', 2), ':')"


def level_sql(c: str) -> str:
    f = fold_sql(c)
    named = " ".join(f"WHEN regexp_matches({f}, '^{n}级?([(]?{v.lower()}[)]?)?$') THEN '{v}'" for v, n in (("L1", "公开"), ("L2", "内部"), ("L3", "机密"), ("L4", "绝密")))
    return f"CASE WHEN regexp_matches({f}, '^(level|l)[\\s_-]*[1-4]$') THEN 'L' || right({f}, 1) {named} END"


_CELLS = f"""
WITH m AS (SELECT vm_id, {machine_sql('vm_id')} AS k FROM machines),
t AS (SELECT event_type, regexp_replace({fold_sql('event_type')}, '[\\s_/:>.-]+', '.', 'g') AS k FROM event_catalog),
e AS (
  SELECT b.event_id, m.vm_id, t.event_type, coalesce({level_sql('b.sensitivity_level')}, 'none') AS sensitivity_level, b."timestamp" AS ts,
         greatest(coalesce(try_cast(b.metadata['step'] AS BIGINT), 0), 0) AS step
  FROM behavior_events b JOIN m ON m.k = {machine_sql('b.vm_id')}
  JOIN t ON t.k = regexp_replace({fold_sql('b.event_type')}, '[\\s_/:>.-]+', '.', 'g')
  WHERE b."timestamp" >= TIMESTAMPTZ '2024-01-01 00:00:00+00' AND b."timestamp" < TIMESTAMPTZ '2024-02-01 00:00:00+00'),
o AS (SELECT event_id, min(vm_id) AS vm_id, min(event_type) AS event_type, min(sensitivity_level) AS sensitivity_level, min(ts) AS ts, min(step) AS step FROM e GROUP BY event_id),
cells AS (SELECT vm_id, event_type, sensitivity_level, count(*) AS n_events, sum(step)::BIGINT AS total_steps, max(epoch(ts))::BIGINT AS last_seen FROM o GROUP BY ALL)
"""

QUERIES = {"p6_found": p6_found, "p6_features": p6_features}
ORACLES = {
    "p6_found": _CELLS + "SELECT vm_id, event_type, sensitivity_level, n_events, last_seen FROM cells",
    "p6_features": _CELLS
    + """SELECT m.vm_id, coalesce(sum(n_events), 0)::BIGINT AS n_events, coalesce(sum(total_steps), 0)::BIGINT AS total_steps, max(last_seen) AS last_seen,
    CASE WHEN count(n_events) = 0 THEN NULL ELSE count(DISTINCT event_type) END::INTEGER AS n_types,
    coalesce(sum(n_events) FILTER (sensitivity_level = 'L4'), 0)::BIGINT AS n_l4, coalesce(max(last_seen) FILTER (event_type = 'file'), 0)::BIGINT AS last_file
    FROM machines m LEFT JOIN cells USING (vm_id) GROUP BY m.vm_id""",
}
