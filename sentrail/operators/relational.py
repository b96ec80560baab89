"""Relational helpers for investigations: unions of unlike tables, expansion, snapshots, tree roll-ups, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chain(*frames: DataFrame) -> DataFrame:
    """Union of tables with different columns; missing ones are null. Rows carry their part's number."""
    parts = [f.withColumn("_part", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flatten_lists(df: DataFrame, *columns: str) -> DataFrame:
    """One row per combination of the listed array columns' elements; empty and null arrays give one null."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(c))
    return df


def items(df: DataFrame, column: str) -> DataFrame:
    """A map column as rows of _key and _value."""
    return df.select("*", F.explode(column).alias("_key", "_value"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, state: list[str]) -> DataFrame:
    """key, change: added, removed or changed between two snapshots; keys are unique, null keys are dropped."""
    a = old.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.struct(*state).alias("_old"))
    b = new.filter(F.col(key).isNotNull()).select(F.col(key).alias("_n"), F.struct(*state).alias("_new"))
    both = a.join(b, F.col("_k") == F.col("_n"), "full_outer")
    change = F.when(F.col("_k").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(F.coalesce("_k", "_n").alias(key), change.alias("change")).filter("change IS NOT NULL")


def path_rollup(df: DataFrame, path: str, size: str, sep: str = "/") -> DataFrame:
    """dir, total, n_files: every directory with the sizes of all files below it, without recursion."""
    parts = F.filter(F.split(F.col(path), sep), lambda p: p != "")
    up = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.concat(F.lit(sep), F.array_join(F.slice(parts, 1, i), sep)))
    return df.filter(F.col(path).isNotNull()).select(F.explode(up).alias("dir"), F.col(size).alias("_s")).groupBy("dir").agg(F.sum("_s").alias("total"), F.count(F.lit(1)).alias("n_files"))


def page(df: DataFrame, order: list[str], start: int, rows: int) -> DataFrame:
    """Rows start to start + rows in the given (total) order; '-c' sorts c descending."""
    cols = [F.col(c.lstrip("-")).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    return df.orderBy(*cols).offset(start).limit(rows)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in the given order, by partial aggregation (no per-key sort)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def replace_on_key(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with rows of changes put in place of rows of the same key, and new keys added."""
    return base.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.select(*base.columns))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in the given order (Spark prunes each task's groups to k first)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def call_chain(df: DataFrame, child: str, parent: str) -> DataFrame:
    """node, ancestor, depth: every ancestor over any number of steps, by doubling of the reach.

    A round joins the newest reach with the known one, so depth d needs about log2(d) rounds; it ends when
    no pair is new or nearer. In a cycle every member is an ancestor of every other and, one round later,
    of itself, each with its smallest depth. Null parents end a chain.
    """
    from sentrail.session import cut

    known = cut(df.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).dropna().distinct().withColumn("depth", F.lit(1)))
    while True:
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        wider = cut(known.unionByName(further).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        if wider.join(known, ["node", "ancestor", "depth"], "left_anti").limit(1).count() == 0:
            return wider
        known = wider


def first_with_rows(*frames: DataFrame) -> DataFrame:
    """The rows of the first table that has any; all tables have the same columns. None: no rows."""
    parts = reduce(lambda a, b: a.unionByName(b), [f.withColumn("_branch", F.lit(i)) for i, f in enumerate(frames)])
    first = parts.agg(F.min("_branch").alias("_branch"))
    return parts.join(first, "_branch", "left_semi").drop("_branch")


def overlay(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of several layers by key, the earliest layer that has the key winning; null keys are dropped."""
    rest = [c for c in layers[0].columns if c != key]
    parts = reduce(lambda a, b: a.unionByName(b), [f.select(key, *rest).withColumn("_layer", F.lit(i)) for i, f in enumerate(layers)])
    best = parts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), "_layer").alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def hash_rank(df: DataFrame, group: str, row_id: str, out: str = "rank") -> DataFrame:
    """Rank from 1 of each row within its group, in md5 order of the unique row_id.

    Ranks are made per slot of the hash's first 12 bits and moved by the counts of the slots before, so
    a group that holds most rows is ranked by many tasks.
    """
    h = F.md5(F.col(row_id).cast("string"))
    rows = df.withColumn("_h", h).withColumn("_slot", F.substring("_h", 1, 3))
    slots = rows.groupBy(group, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = slots.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_slot")) - F.col("_n")).select(F.col(group).alias("_g"), F.col("_slot").alias("_s"), "_before")
    inside = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_slot").orderBy("_h", row_id)))
    joined = inside.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slot") == F.col("_s")))
    return joined.withColumn(out, (F.col("_before") + F.col("_r")).cast("int")).drop("_h", "_slot", "_g", "_s", "_before", "_r")
