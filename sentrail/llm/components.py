"""Groups of records tied by shared keys, and splits that keep groups whole.

Distributed union-find: each task builds a local forest over its links and passes on one link per node, to
the node's root. Forests are merged by levels: at each, FAN_IN of them go to one task and become one forest,
until one is left. Between levels a node that stands in one forest only is settled: nothing but its root
can change its root, so it is taken out and looks its root up at the end. What is merged are the nodes that
forests share, and their roots. Should these be more than the next level's tasks may hold, they are first
contracted by a round of stars (every node is tied to the smallest neighbour of its neighbours, by grouped
minima). Only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.session import cut

#: Links of one task's local forest, forests that one task merges, and forests to begin with at least.
LOCAL_LINKS, FAN_IN, LEAST_FORESTS = 250_000, 8, 4


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over string links with path halving; every node with the smallest node of its tree."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(names)))
    n = len(a)
    for x, y in zip(codes[:n].tolist(), codes[n:].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, dtype=np.int64)
    while not np.array_equal(up := root[root], root):
        root = up
    return names, names[root]


def _grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest over a task's links: (number of the task, node, root), roots with themselves."""
    parts = [(pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)) for pdf in batches]
    if sum(len(a) for a, _ in parts):
        names, roots = _forest(np.concatenate([a for a, _ in parts]).astype(str), np.concatenate([b for _, b in parts]).astype(str))
        yield pd.DataFrame({"f": TaskContext.get().partitionId(), "node": names, "root": roots})


def _pairs(df: DataFrame) -> DataFrame:
    """Links as (a, b) with a > b, each once."""
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star_round(links: DataFrame) -> DataFrame:
    """Large star, then small star, over links a > b. Grouped minima are combined before the shuffle."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
    return _pairs(small)


def _are_stars(links: DataFrame) -> bool:
    """Whether no node is both a leaf and a root, or a leaf of two roots, in links a > b."""
    leaves = links.select("a")
    return leaves.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0 and leaves.distinct().count() == leaves.count()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every node of the links with the smallest node (as text) tied to it.

    Links with a null end are dropped; repeated links, self-links and cycles are allowed; empty in, empty
    out. A node with a third of all links is spread over all tasks: each sends its part's forest, and minima
    are combined before any shuffle.
    """
    named = links.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    alone = named.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    todo = cut(_pairs(named))
    tasks = max(LEAST_FORESTS, -(-todo.count() // LOCAL_LINKS))
    forest = cut(todo.repartition(tasks).mapInPandas(_grown, "f int, node string, root string"))
    settled: list[DataFrame] = []
    while tasks > 1:
        marked = cut(forest.filter("node <> root").join(forest.groupBy("node").count(), "node"))
        settled.append(marked.filter("count = 1").select("node", "root"))
        shared = marked.filter("count > 1").select("f", F.col("node").alias("a"), F.col("root").alias("b"))
        tasks = -(-tasks // FAN_IN)
        room = tasks * FAN_IN * LOCAL_LINKS
        if shared.count() > room:
            shared = cut(_pairs(shared.select("a", "b")))
            while shared.count() > room and not _are_stars(shared):
                shared = cut(_star_round(shared))
            if shared.count() > room:  # stars say each node's root: nothing is left to merge
                stars = shared.select(F.lit(0).alias("f"), F.col("a").alias("node"), F.col("b").alias("root"))
                forest = stars.unionByName(stars.select("f", F.col("root").alias("node"), "root").distinct())
                break
            shared = shared.withColumn("f", F.pmod(F.xxhash64("a", "b"), F.lit(tasks * FAN_IN)).cast("int"))
        merging = shared.repartition(tasks, F.floor(F.col("f") / FAN_IN)) if tasks > 1 else shared.coalesce(1)
        forest = cut(merging.select("a", "b").mapInPandas(_grown, "f int, node string, root string"))
    known = forest.select("node", "root")
    for level in reversed(settled):
        above = known.select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = known.unionByName(level.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    known = cut(known)
    # Roots of trees that share no node with another forest, and nodes that are only linked to themselves.
    own = known.select(F.col("root").alias("node"), "root").unionByName(alone).distinct()
    return known.unionByName(own.join(known.select("node"), "node", "left_anti"))


def assign_splits(groups: DataFrame, group: str, size: str, shares: dict[str, float], heavy_share: float = 1e-4, buckets: int = 10_000) -> DataFrame:
    """group, split: greedy, largest first, each group to the split furthest below its target.

    Groups of more than heavy_share of all rows (at most 1/heavy_share of them) are placed one by one;
    the light rest is placed in `buckets` hash buckets by the same rule, so the driver sees a bounded
    number of sizes at any scale. Ties go by name. Null groups are dropped. A split misses its target by at
    most the largest unit placed, a group or a bucket (a bucket holds about 1/buckets of the light rows, and
    one light group more at most than chance gives it). Empty in, empty out.
    """
    sized = groups.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.sum(size).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > F.lit(total * heavy_share)
    bucket = F.concat(F.lit("bucket:"), F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("string"))
    unit = F.when(heavy, F.concat(F.lit("group:"), F.col("g"))).otherwise(bucket)
    units = sorted(((r[1], r[0]) for r in sized.groupBy(unit.alias("u")).agg(F.sum("n")).collect()), key=lambda x: (-x[0], x[1]))
    goal = {s: share * total for s, share in shares.items()}
    have = dict.fromkeys(shares, 0)
    placed = []
    for n, name in units:
        best = max(shares, key=lambda s: goal[s] - have[s])
        have[best] += n
        placed.append((name, best))
    plan = groups.sparkSession.createDataFrame(placed, "u string, split string")
    return sized.withColumn("u", unit).join(plan, "u").select(F.col("g").alias(group), "split")
