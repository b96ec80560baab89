"""Queries of problems 2, 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.functions.canon import machine_key, name_key
from sentrail.llm.components import assign_splits, components
from sentrail.llm.runs import collapse_runs
from sentrail.llm.sampling import draw_sample, matching, quota_report, reservoirs, size_of
from sentrail.llm.sequences import flat_events, one_per_sequence, slim_events
from sentrail.queries.features import fold_sql, machine_sql
from sentrail.session import cut, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
CATEGORY = ["user_role", "channel", "label", "difficulty"]


def _runs(spark: SparkSession, d: str) -> DataFrame:
    once = one_per_sequence(slim_events(table(spark, d, "op_sequences").select("seq_id", "events")), "events")
    return collapse_runs(flat_events(once), "seq_id", "timestamp", "event_id", ["base_type", "action_key", "target_key"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).filter("n_events >= 2").select("seq_id", "first_event_id", "n_events")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One event per run, with count and duration."""
    return _runs(spark, d).select("seq_id", "first_event_id", "base_type", "action_key", "target_key", "n_events", F.unix_micros("start_time").alias("start_us"), "duration_us")


def _machine_groups(machines: DataFrame) -> DataFrame:
    """vm_key, group_vm_id: machines tied by replaces_vm_id to another row of machines, however far."""
    named = machines.select("vm_id", machine_key(F.col("vm_id")).alias("vm_key"), machine_key(F.col("replaces_vm_id")).alias("old_key")).filter("vm_key IS NOT NULL")
    known = named.groupBy("vm_key").agg(F.min("vm_id").alias("vm_name"))
    ties = named.join(known.select(F.col("vm_key").alias("old_key"), F.col("vm_name").alias("old_name")), "old_key").join(known, "vm_key")
    groups = components(ties, "vm_name", "old_name")
    return known.join(groups, known.vm_name == groups.node, "left").select("vm_key", F.coalesce("root", "vm_name").alias("group_vm_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "op_sequences").select("seq_id", machine_key(F.col("vm_id")).alias("vm_key")).dropna().distinct()
    return own.join(_machine_groups(table(spark, d, "machines")), "vm_key").groupBy("seq_id").agg(F.min("group_vm_id").alias("group_vm_id"))


def split_table(sequences: DataFrame, machines: DataFrame) -> DataFrame:
    """seq_id, split, group_id, n_rows: all rows of a seq_id and of tied machines in one split.

    A sequence without a known machine is a group of its own, unless an unknown machine's name (a name
    with a number) ties it to others; placeholders tie nothing.
    """
    rows = sequences.filter(F.col("seq_id").isNotNull()).groupBy("seq_id", machine_key(F.col("vm_id")).alias("vm_key")).agg(F.count(F.lit(1)).alias("n"))
    keyed = cut(rows.join(_machine_groups(machines), "vm_key", "left").select("seq_id", "n", F.coalesce("group_vm_id", "vm_key").alias("home")))
    # Only a seq_id with several homes ties groups to each other; all other rows go by their home alone.
    homes = keyed.groupBy("seq_id").agg(F.min("home").alias("home"), F.max("home").alias("far"), F.sum("n").alias("n"))
    several = homes.filter("home <> far").select("seq_id")
    ties = keyed.filter("home IS NOT NULL").join(several, "seq_id").join(homes.select("seq_id", F.col("home").alias("least")), "seq_id").select("home", "least").filter("home <> least")
    tied = components(ties, "home", "least")
    grouped = homes.join(tied, homes.home == tied.node, "left").select("seq_id", F.coalesce("root", "home", F.concat(F.lit("seq:"), "seq_id")).alias("group_id"), "n")
    grouped = cut(grouped)
    return grouped.join(assign_splits(grouped, "group_id", "n", SHARES), "group_id").select("seq_id", "split", "group_id", F.col("n").alias("n_rows"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return split_table(table(spark, d, "op_sequences"), table(spark, d, "machines"))


def _categories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "sample_targets").withColumns({k: name_key(F.col(k)) for k in CATEGORY})
    rows = table(spark, d, "op_sequences").select("seq_id", *[name_key(F.col(k)).alias(k) for k in CATEGORY])
    # Of copies that disagree, the smallest row that names a target counts.
    return one_per_sequence(matching(rows, targets, CATEGORY), *CATEGORY), targets


def _report(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged reservoirs and what they say of each target."""
    merged = reservoirs(rows, "seq_id", CATEGORY)
    return merged, quota_report(merged, targets, CATEGORY, "target_bp", "min_rows", size_of(merged) // 5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _report(*_categories(spark, d))[1].filter("NOT met").select(*CATEGORY)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(*_categories(spark, d))[1].select(*CATEGORY, "target_bp", "available", "wanted", "taken", "shortfall", "met")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample itself; the sequences are read once, into narrow rows that both steps use."""
    rows, targets = _categories(spark, d)
    rows = cut(rows)
    merged, report = _report(rows, targets)
    return draw_sample(rows, merged, report, "seq_id", CATEGORY).select("seq_id", *CATEGORY)


QUERIES = {"p2_found": p2_found, "p2_collapsed": p2_collapsed, "p3_found": p3_found, "p3_split": p3_split, "p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample}

_name = lambda c: f"nullif(regexp_replace({fold_sql(c)}, '[\\s-]+', '_', 'g'), '')"

_P3 = f"""
WITH RECURSIVE m AS (SELECT vm_id, {machine_sql('vm_id')} AS k, {machine_sql('replaces_vm_id')} AS old FROM machines),
tie AS (SELECT a.vm_id AS a, b.vm_id AS b FROM m a JOIN m b ON a.old = b.k),
both_ways AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie),
reach AS (SELECT vm_id AS a, vm_id AS b FROM m UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
g AS (SELECT a AS vm_id, min(b) AS group_vm_id FROM reach GROUP BY a)
"""
_P4 = f"""
WITH t AS (SELECT {', '.join(f'{_name(k)} AS {k}' for k in CATEGORY)}, target_bp, min_rows FROM sample_targets),
s AS (SELECT DISTINCT seq_id, {', '.join(f'{_name(k)} AS {k}' for k in CATEGORY)} FROM op_sequences WHERE seq_id IS NOT NULL),
c AS (SELECT seq_id, min(struct_pack({', '.join(f'{k} := s.{k}' for k in CATEGORY)})) AS r FROM s JOIN t USING ({', '.join(CATEGORY)}) GROUP BY seq_id),
n AS (SELECT count(*) // 5 AS size FROM c),
h AS (SELECT {', '.join(f'r.{k} AS {k}' for k in CATEGORY)}, count(*) AS available FROM c GROUP BY ALL),
q AS (SELECT {', '.join(f't.{k}' for k in CATEGORY)}, target_bp, coalesce(available, 0) AS available, greatest(min_rows, (target_bp * size + 9999) // 10000)::BIGINT AS wanted FROM t LEFT JOIN h USING ({', '.join(CATEGORY)}), n)
"""
_TYPE = f"regexp_replace({fold_sql('e.event_type')}, '[\\s_/:>.-]+', '.', 'g')"
_TEXT = f"regexp_replace({fold_sql('e.target')}, '^[\"''<\\s]+|[\"''>;,\\s]+$', '', 'g')"
_LEAF = f"trim(regexp_extract(url_decode(replace({_TEXT}, '+', '%2B')), '([^/\\\\]*)$', 1))"
_PAGE = f"regexp_replace(regexp_replace(url_decode(replace(regexp_replace({_TEXT}, '^[a-z]+://|[?#].*$', '', 'g'), '+', '%2B')), ':(80|443)(/|$)', '\\2'), '/+', '/', 'g')"
_P2 = f"""
WITH s AS (SELECT seq_id, min(list_transform(events, lambda e: {{'t': e."timestamp", 'i': e.event_id, 'ty': e.event_type, 'a': e.action, 'g': e.target}})) AS ev FROM op_sequences WHERE seq_id IS NOT NULL GROUP BY seq_id),
x AS (SELECT seq_id, unnest(ev) AS r FROM s),
y AS (SELECT seq_id, {{'timestamp': r.t, 'event_id': r.i, 'event_type': r.ty, 'action': r.a, 'target': r.g}} AS e FROM x WHERE r IS NOT NULL),
k AS (SELECT seq_id, e."timestamp" AS ts, e.event_id AS event_id, {_TYPE} AS base_type, {_name('e.action')} AS action_key,
  CASE WHEN e.target IS NULL THEN NULL WHEN {_TYPE} = 'email' THEN coalesce(nullif(regexp_extract({_TEXT}, '[^\\s<>:;,]+@[^\\s<>;,]+'), ''), {_TEXT})
  WHEN {_TYPE} = 'http' THEN regexp_replace({_PAGE}, '/$', '') WHEN {_TYPE} = 'device' THEN regexp_replace({_LEAF}, '[\\s_-]+', '_', 'g') ELSE {_LEAF} END AS target_key FROM y),
b AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY seq_id, base_type, action_key, target_key ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS same FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST)),
r AS (SELECT seq_id, base_type, action_key, target_key, pos - same AS run, min_by(event_id, pos) AS first_event_id, count(*) AS n_events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM b GROUP BY ALL)
"""
ORACLES = {
    "p2_found": _P2 + "SELECT seq_id, first_event_id, n_events FROM r WHERE n_events >= 2",
    "p2_collapsed": _P2 + "SELECT seq_id, first_event_id, base_type, action_key, target_key, n_events, start_us, duration_us FROM r",
    "p3_found": _P3 + f"SELECT s.seq_id, min(g.group_vm_id) AS group_vm_id FROM op_sequences s JOIN m ON m.k = {machine_sql('s.vm_id')} JOIN g ON g.vm_id = m.vm_id WHERE s.seq_id IS NOT NULL GROUP BY s.seq_id",
    "p4_found": _P4 + f"SELECT {', '.join(CATEGORY)} FROM q WHERE available < wanted",
    "p4_report": _P4 + f"SELECT {', '.join(CATEGORY)}, target_bp, available, wanted, least(available, wanted) AS taken, wanted - least(available, wanted) AS shortfall, available >= wanted AS met FROM q",
    "p4_sample": _P4 + f", o AS (SELECT seq_id, {', '.join(f'r.{k} AS {k}' for k in CATEGORY)} FROM c), ranked AS (SELECT o.*, row_number() OVER (PARTITION BY {', '.join(f'o.{k}' for k in CATEGORY)} ORDER BY md5('42:' || seq_id), seq_id) AS place FROM o) SELECT seq_id, {', '.join(f'ranked.{k}' for k in CATEGORY)} FROM ranked JOIN q USING ({', '.join(CATEGORY)}) WHERE place <= least(available, wanted)",
}
