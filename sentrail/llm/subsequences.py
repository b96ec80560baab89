"""Frequent ordered patterns with gaps, by position-coded access-pattern trees.

Sequences are merged into a prefix tree with counts. A node's position code is its preorder interval:
x lies below y exactly if start(y) < start(x) <= end(y). Header links list the nodes of each step in
preorder, and each node knows the nearest node of the same step above it, so the first occurrences below
any set of roots are found by interval search in the header list and no intermediate tree is ever built.

No tree holds all sequences: each task builds one tree per class over its own share. A pattern frequent
in all the data is frequent in at least one share (its support there would else sum to too little), so
the locally frequent patterns are the candidates. In a share that does not report a pattern its support
is below that share's bar, so what the shares report bounds a candidate's support from above; those that
can't reach the class's bar are dropped, and a second pass over the same trees counts the rest exactly. The
candidates stay a table: blocks of bounded size are broadcast one after the other.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.session import cut

#: Candidates of one broadcast (about 100 bytes each); more are counted in as many passes as it takes.
CANDIDATE_BLOCK = 200_000


class PatternTree:
    """Prefix tree of (steps, count) with preorder codes and header links, all as arrays."""

    def __init__(self, weighted: dict[tuple[int, ...], int]):
        step, count = [-1], [0]
        last: tuple[int, ...] = ()
        path: list[int] = []
        ends = {}
        for seq in sorted(weighted):
            n = weighted[seq]
            keep = 0
            while keep < min(len(seq), len(last)) and seq[keep] == last[keep]:
                keep += 1
            while len(path) > keep:
                ends[path.pop()] = len(step) - 1
            for s in seq[keep:]:
                step.append(s)
                count.append(0)
                path.append(len(step) - 1)
            for node in path:
                count[node] += n
            last = seq
        while path:
            ends[path.pop()] = len(step) - 1
        self.count = np.array(count, np.int64)
        self.end = np.array([len(step) - 1] + [ends[i] for i in range(1, len(step))], np.int64)
        steps = np.array(step, np.int64)
        self.header, self.nearest = {}, {}
        for s in np.unique(steps[1:]):
            nodes = np.flatnonzero(steps == s)
            near, open_nodes = np.full(len(nodes), -1, np.int64), []
            for i, node in enumerate(nodes.tolist()):
                while open_nodes and self.end[open_nodes[-1]] < node:
                    open_nodes.pop()
                near[i] = open_nodes[-1] if open_nodes else -1
                open_nodes.append(node)
            self.header[int(s)], self.nearest[int(s)] = nodes, near
        self.total = sum(weighted.values())

    def below(self, roots: np.ndarray, step: int) -> np.ndarray:
        """First nodes of the step strictly below each root (roots: disjoint subtrees in preorder)."""
        nodes = self.header.get(step)
        if nodes is None:
            return np.empty(0, np.int64)
        lo, hi = np.searchsorted(nodes, roots, "right"), np.searchsorted(nodes, self.end[roots], "right")
        sizes = hi - lo
        if not sizes.any():
            return np.empty(0, np.int64)
        at = np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return nodes[at[self.nearest[step][at] <= np.repeat(roots, sizes)]]

    def mine(self, least: int, longest: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Every pattern of up to `longest` steps with support of at least `least`."""
        todo: list[tuple[tuple[int, ...], np.ndarray]] = [((), np.zeros(1, np.int64))]
        while todo:
            pattern, roots = todo.pop()
            for s in self.header:
                found = self.below(roots, s)
                support = int(self.count[found].sum())
                if support >= least:
                    yield (*pattern, s), support
                    if len(pattern) + 1 < longest:
                        todo.append(((*pattern, s), found))

    def supports(self, trie: dict) -> Iterator[tuple[tuple[int, ...], int]]:
        """Support of each pattern of a trie {step: trie}; None as a key marks a pattern's end."""
        todo: list[tuple[tuple[int, ...], np.ndarray, dict]] = [((), np.zeros(1, np.int64), trie)]
        while todo:
            pattern, roots, node = todo.pop()
            for s, below in node.items():
                if s is None:
                    continue
                found = self.below(roots, s)
                if not len(found):
                    continue
                if None in below:
                    yield (*pattern, s), int(self.count[found].sum())
                todo.append(((*pattern, s), found, below))


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, dict[str, int], PatternTree]]:
    weighted: dict[str, Counter] = {}
    codes: dict[str, int] = {}
    for pdf in batches:
        for cls, steps in zip(pdf["cls"], pdf["steps"]):
            weighted.setdefault(cls, Counter())[tuple(codes.setdefault(s, len(codes)) for s in steps)] += 1
    for cls, w in weighted.items():
        yield cls, codes, PatternTree(w)


def frequent_subsequences(sequences: DataFrame, seq: str, cls: str, steps: str, share: float | Fraction = Fraction(1, 20), shortest: int = 3, longest: int = 5, per_share: int = 5_000) -> DataFrame:
    """cls, pattern (array of steps), support: patterns held by at least `share` of the class's sequences.

    sequences has one row per sequence (seq unique within cls) with its ordered array of steps. Rows with
    a null class are dropped; null steps are skipped; empty or null arrays count in the class's size but
    hold nothing. A sequence counts once for a pattern however often it holds it. Empty in, empty out.
    About per_share sequences of a class go into one tree, whatever the input's size. The driver holds the
    classes' sizes and at most CANDIDATE_BLOCK candidates at a time.
    """
    share = Fraction(share).limit_denominator(1_000_000)
    spark = sequences.sparkSession
    rows = sequences.filter(F.col(cls).isNotNull()).select(F.col(seq).cast("string").alias("seq"), F.col(cls).cast("string").alias("cls"), F.filter(F.coalesce(F.col(steps), F.array().cast("array<string>")), lambda s: s.isNotNull()).alias("steps"))
    rows = cut(rows)
    sizes = {r[0]: r[1] for r in rows.groupBy("cls").count().collect()}
    shares = spark.createDataFrame([(c, max(1, n // per_share)) for c, n in sizes.items()], "cls string, k int")
    # Shares are dealt out by hash; shares of one class that meet in a task become one tree.
    part = F.pmod(F.xxhash64("seq"), F.col("k")).alias("part")
    tasks = sum(max(1, n // per_share) for n in sizes.values()) or 1
    dealt = cut(rows.join(shares, "cls").select("cls", part, "steps").repartition(tasks, "cls", "part").select("cls", "steps"))

    bars = spark.createDataFrame([(c, max(1, math.ceil(n * share))) for c, n in sizes.items()], "cls string, least long")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Support above what a silent share may hold of each locally frequent pattern; null: what it may hold."""
        for name, codes, tree in _trees(batches):
            names = list(codes)
            most = max(1, math.ceil(tree.total * share)) - 1
            found = [(name, [names[s] for s in p], n - most) for p, n in tree.mine(most + 1, longest) if len(p) >= shortest]
            yield pd.DataFrame([*found, (name, None, most)], columns=["cls", "pattern", "n"])

    local = cut(dealt.mapInPandas(candidates, "cls string, pattern array<string>, n long"))
    silent = local.filter("pattern IS NULL").groupBy("cls").agg(F.sum("n").alias("silent")).join(bars, "cls")
    wanted = local.filter("pattern IS NOT NULL").groupBy("cls", "pattern").agg(F.sum("n").alias("n")).join(F.broadcast(silent), "cls").filter("n + silent >= least")
    wanted = cut(wanted.select("cls", "pattern"))
    blocks = max(1, -(-wanted.count() // CANDIDATE_BLOCK))

    def coded(trie: dict, codes: dict[str, int]) -> dict:
        return {None if s is None else codes[s]: coded(t, codes) for s, t in trie.items() if s is None or s in codes}

    def counts(block: DataFrame) -> DataFrame:
        tries: dict[str, dict] = {}
        for name, pattern in block.collect():
            node = tries.setdefault(name, {})
            for s in pattern:
                node = node.setdefault(s, {})
            node[None] = {}
        shared = spark.sparkContext.broadcast(pickle.dumps(tries))

        def supports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every = None
            for name, codes, tree in _trees(batches):
                every = pickle.loads(shared.value) if every is None else every
                names = list(codes)
                found = [(name, [names[s] for s in p], n) for p, n in tree.supports(coded(every.get(name, {}), codes))]
                yield pd.DataFrame(found, columns=["cls", "pattern", "n"])

        return dealt.mapInPandas(supports, "cls string, pattern array<string>, n long")

    parts = [counts(wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("cls", "pattern"), F.lit(blocks)) == i)) for i in range(blocks)]
    counted = reduce(DataFrame.unionByName, parts).groupBy("cls", "pattern").agg(F.sum("n").alias("support"))
    return counted.join(F.broadcast(bars), "cls").filter("support >= least").select(F.col("cls").alias(cls), "pattern", "support")
