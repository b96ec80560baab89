"""Vector operators: weighted means, nearest centres, k-means steps, drift, search by blocks of queries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one broadcast block holds.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def weighted_distance(x: Column, centre: list[float], weights: list[float]) -> Column:
    """Sum of w (x - c)^2 over the dimensions."""
    c, w = F.array(*[F.lit(float(v)) for v in centre]), F.array(*[F.lit(float(v)) for v in weights])
    d = F.zip_with(x, c, lambda p, q: p.cast("double") - q)
    return F.aggregate(F.zip_with(d, w, lambda p, q: p * p * q), F.lit(0.0), lambda s, v: s + v)


def nearest_centre(x: Column, centres: list[list[float]], weights: list[float]) -> Column:
    """Number of the nearest centre; ties go to the lowest."""
    d = [weighted_distance(x, c, weights) for c in centres]
    return F.array_position(F.array(*d), F.array_min(F.array(*d))).cast("int") - 1


def grouped_mean(df: DataFrame, group: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """group, pos, mean, n: weighted mean per position, by partial aggregation of the exploded positions."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*group, w.alias("_w"), F.posexplode(vector).alias("pos", "_x"))
    return rows.groupBy(*group, "pos").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / (F.sum("_w") + F.lit(0.0 if weight is None else 1e-8))).alias("mean"), F.count(F.lit(1)).alias("n"))


def kmeans_step(df: DataFrame, vector: str, centres: np.ndarray, weights: np.ndarray, lam: float = 0.6) -> tuple[np.ndarray, np.ndarray, float]:
    """One round: assign, new centres (an empty cluster becomes the zero vector), new weights, objective.

    Each task sends K x d sums and squares, so the shuffle doesn't grow with the rows.
    """
    k, d = centres.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, obj = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), np.float64).reshape(len(pdf), d)
            dist = np.stack([((x - c) ** 2 * weights).sum(1) for c in centres], 1)
            own = dist.argmin(1)
            obj += dist[np.arange(len(x)), own].sum()
            np.add.at(n, own, 1)
            np.add.at(s, own, x)
            np.add.at(q, own, x * x)
        yield pd.DataFrame({"part": [pickle.dumps((n, s, q, obj))]})

    parts = [pickle.loads(r[0]) for r in df.select(vector).filter(F.col(vector).isNotNull()).mapInPandas(partial, "part binary").collect()]
    n, s, q = (sum(p[i] for p in parts) for i in range(3))
    new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], 0.0)
    total = max(n.sum(), 1)
    within = (q - n[:, None] * new**2).sum(0)
    between = (n[:, None] * (new - s.sum(0) / total) ** 2).sum(0)
    w = lam / (within + 1e-8) + (1 - lam) * between
    return new, w / w.sum() if w.sum() else weights, float(sum(p[3] for p in parts))


def kmeans(df: DataFrame, vector: str, centres: np.ndarray, max_rounds: int = 100, tolerance: float = 1e-4, weights: np.ndarray | None = None, fixed_weights: bool = False) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Rounds of kmeans_step from given centres and weights (else equal ones) until the objective stands still."""
    weights, history = np.full(centres.shape[1], 1 / centres.shape[1]) if weights is None else weights, []
    for _ in range(max_rounds):
        centres, new, objective = kmeans_step(df, vector, centres, weights)
        weights = weights if fixed_weights else new
        history.append(objective)
        if len(history) > 1 and abs(history[-2] - history[-1]) < tolerance:
            break
    return centres, weights, history


def knn(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int) -> DataFrame:
    """query_id, row_id, score, rank: the k rows most like each query by cosine, exactly.

    The query set goes out in blocks of QUERY_BLOCK vectors; each task keeps its best k per query, and
    only these meet in the shuffle. A row is no match for itself. Null vectors are skipped.
    """
    spark = rows.sparkSession
    qs = queries.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")).dropna()
    n = qs.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    found = []
    for b in range(blocks):
        part = (qs if blocks == 1 else qs.filter(F.pmod("id", F.lit(blocks)) == b)).orderBy("id").collect()
        ids = np.array([r[0] for r in part], np.int64)
        m = np.array([r[1] for r in part], np.float64)
        block = spark.sparkContext.broadcast(pickle.dumps((ids, m)))

        def best(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, m = pickle.loads(block.value)
            keep_id = np.full((len(ids), k), -1, np.int64)
            keep = np.full((len(ids), k), -np.inf)
            for pdf in batches:
                own = pdf["id"].to_numpy(np.int64)
                x = np.array(pdf["v"].tolist(), np.float64)
                if not len(own) or not len(ids):
                    continue
                s = m @ x.T / (np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-8)
                s[ids[:, None] == own[None, :]] = -np.inf
                s, own = np.hstack([keep, s]), np.hstack([keep_id, np.broadcast_to(own, (len(ids), len(own)))])
                top = np.lexsort((own, -s), axis=1)[:, :k]
                keep, keep_id = np.take_along_axis(s, top, 1), np.take_along_axis(own, top, 1)
            q, j = np.nonzero(keep > -np.inf) if len(ids) else ([], [])
            yield pd.DataFrame({"query_id": ids[q], "row_id": keep_id[q, j], "score": keep[q, j]})

        found.append(rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")).dropna().mapInPandas(best, "query_id long, row_id long, score double"))
    from sentrail.operators.relational import chain, top_per_group

    return top_per_group(chain(*found).drop("_part"), ["query_id"], [F.col("score").desc(), F.col("row_id")], k)


def cluster_distances(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, cluster: str) -> DataFrame:
    """query_id, own, cluster, s, n: summed distances of each query to each cluster's rows, and their number.

    The query set goes out in blocks of QUERY_BLOCK vectors; a task adds up per query and cluster only.
    Null vectors and clusters are skipped.
    """
    spark = rows.sparkSession
    every = rows.select(F.col(vector).alias("v"), F.col(cluster).alias("c")).dropna()
    qs = queries.select(F.col(row_id).cast("long").alias("id"), F.col(cluster).alias("own"), F.col(vector).alias("v")).dropna()
    blocks = max(1, -(-qs.count() // QUERY_BLOCK))
    kind, found = dict(every.dtypes)["c"], []
    for b in range(blocks):
        part = (qs if blocks == 1 else qs.filter(F.pmod("id", F.lit(blocks)) == b)).orderBy("id").collect()
        block = spark.sparkContext.broadcast(pickle.dumps((np.array([r.id for r in part], np.int64), [r.own for r in part], np.array([r.v for r in part], np.float64))))

        def sums(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            ids, own, m = pickle.loads(block.value)
            total: dict = {}
            for pdf in batches if len(ids) else ():
                x, of = np.array(pdf["v"].tolist(), np.float64), pdf["c"].to_numpy()
                for lo in range(0, len(x), 512):
                    y, c = x[lo : lo + 512], of[lo : lo + 512]
                    dist = np.sqrt(np.maximum((m * m).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * m @ y.T, 0))
                    for k in np.unique(c):
                        s, n = total.get(k, (0.0, 0))
                        total[k] = s + dist[:, c == k].sum(1), n + int((c == k).sum())
            for k, (s, n) in total.items():
                yield pd.DataFrame({"query_id": ids, "own": own, "cluster": k, "s": s, "n": n})

        found.append(every.mapInPandas(sums, f"query_id long, own {kind}, cluster {kind}, s double, n long"))
    from sentrail.operators.relational import chain

    return chain(*found).groupBy("query_id", "own", "cluster").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, cuts: exact quantiles (linear between neighbours) of each group, whatever its size.

    A sketch brackets every quantile within a thousandth of the ranks; only the values inside a bracket are
    ranked, counted on from those below. Small groups are bracketed whole. Null values are skipped.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    near = lambda by: F.percentile_approx("x", F.array(*[F.lit(min(1.0, max(0.0, q + by))) for q in shares]), 4000)
    s = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), near(-0.001).alias("lo"), near(0.001).alias("hi"), F.min("x").alias("least"), F.max("x").alias("most"))
    small = F.col("n") < 4000
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.when(small, F.col("least")).otherwise(F.col("lo")[i]).alias("lo"), F.when(small, F.col("most")).otherwise(F.col("hi")[i]).alias("hi"), ((F.col("n") - 1) * q).alias("at")) for i, q in enumerate(shares)])
    j = rows.join(F.broadcast(s.select("g", each.alias("b"))), "g").select("g", "x", F.explode("b").alias("b")).select("g", "x", "b.*")
    below = j.groupBy("g", "i").agg(F.count_if(F.col("x") < F.col("lo")).alias("below"))
    inside = j.filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).withColumn("r", F.row_number().over(Window.partitionBy("g", "i").orderBy("x")) - 1)
    ranked = inside.join(below, ["g", "i"]).withColumn("rank", F.col("r") + F.col("below"))
    two = ranked.groupBy("g", "i").agg(F.max(F.when(F.col("rank") == F.floor("at"), F.col("x"))).alias("a"), F.max(F.when(F.col("rank") == F.ceil("at"), F.col("x"))).alias("b"), F.max(F.col("at") - F.floor("at")).alias("t"))
    cuts = two.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("c")))), lambda x: x["c"]).alias("cuts"))
    return cuts.withColumnRenamed("g", group)


def seed_centres(df: DataFrame, vector: str, k: int, seed: int = 42, sample: int = 20_000) -> np.ndarray:
    """k centres by the k-means++ rule on a bounded sample (by hash of the vector, so reruns agree)."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.to_json(F.struct(vector))), 32).alias("h"))
    share = int(min(1.0, 1.2 * sample / max(1, df.count())) * (1 << 32))
    x = np.array([r.v for r in sorted(rows.filter(F.col("h") < share).collect(), key=lambda r: (r.h, list(r.v)))[:sample]], np.float64)
    if len(x) < k:
        raise ValueError(f"{len(x)} vectors for {k} centres")
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        p = d / d.sum() if d.sum() > 0 else None
        centres.append(x[rng.choice(len(x), p=p)])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def calinski_harabasz(df: DataFrame, vector: str, centres: np.ndarray) -> float:
    """Scatter between clusters against scatter within, by nearest centre; 0 if it isn't defined."""
    k, d = centres.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = np.zeros(k), np.zeros((k, d)), 0.0
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), np.float64).reshape(len(pdf), d)
            own = np.stack([((x - c) ** 2).sum(1) for c in centres], 1).argmin(1)
            np.add.at(n, own, 1)
            np.add.at(s, own, x)
            q += (x * x).sum()
        yield pd.DataFrame({"part": [pickle.dumps((n, s, q))]})

    parts = [pickle.loads(r[0]) for r in df.select(vector).filter(F.col(vector).isNotNull()).mapInPandas(partial, "part binary").collect()]
    n, s, q = (sum(p[i] for p in parts) for i in range(3))
    used, total = n > 0, n.sum()
    if used.sum() < 2 or total <= used.sum():
        return 0.0
    of_means = (s[used] ** 2 / n[used][:, None]).sum()
    between, within = of_means - (s.sum(0) ** 2).sum() / total, q - of_means
    return float((between / (used.sum() - 1)) / (within / (total - used.sum()))) if within > 0 else 0.0


def best_k(df: DataFrame, vector: str, ks: range = range(2, 9), rounds: int = 20) -> tuple[int, dict[int, float]]:
    """The number of clusters with the highest Calinski-Harabasz score; ties go to the fewest."""
    scores = {}
    for k in ks:
        centres, _, _ = kmeans(df, vector, seed_centres(df, vector, k), rounds)
        scores[k] = calinski_harabasz(df, vector, centres)
    return min(scores, key=lambda k: (-scores[k], k)), scores


def drifted(df: DataFrame, vector: str, mean: list[float], covariance: list[list[float]], limit: float = 2.5) -> DataFrame:
    """distance and drifted of each vector from a mean, by the full covariance (its inverse is made once)."""
    s = np.array(covariance) + 1e-6 * np.eye(len(mean))
    try:
        inverse = np.linalg.inv(s)
    except np.linalg.LinAlgError:
        inverse = np.eye(len(mean))
    m = [float(x) for x in mean]
    diff = F.zip_with(vector, F.array(*map(F.lit, m)), lambda x, y: x.cast("double") - y)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in inverse])
    d2 = dot(diff, F.transform(rows, lambda r: dot(r, diff)))
    return df.withColumn("distance", F.sqrt(F.when(d2 > 0, d2).otherwise(d2 * 0))).withColumn("drifted", F.col("distance") > limit)


def gain_weights(gains: list[float]) -> np.ndarray:
    """Information gains as shares, negative ones as 0; equal weights if there is no gain at all."""
    g = np.maximum(np.array(gains, np.float64), 0)
    return g / g.sum() if g.sum() > 0 else np.full(len(g), 1 / max(1, len(g)))


def _sums(df: DataFrame, vector: str, f: object) -> np.ndarray:
    """The sum over all vectors of f(matrix of a batch); a task sends one array."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            part = f(np.array(pdf["v"].tolist(), np.float64))
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [pickle.dumps(total)]})

    return sum(pickle.loads(r[0]) for r in df.select(F.col(vector).alias("v")).dropna().mapInPandas(partial, "part binary").collect())


def equal_weights(df: DataFrame, vector: str) -> np.ndarray:
    d = len(df.select(vector).dropna().first()[0])
    return np.full(d, 1 / d)


def tfidf_weights(df: DataFrame, vector: str, least: float = 0.1) -> np.ndarray:
    """Mean size of a dimension (as a share of the largest) times the log of how rarely it exceeds `least`."""
    s = _sums(df, vector, lambda x: np.stack([np.abs(x).sum(0), (np.abs(x) > least).sum(0), np.full(x.shape[1], float(len(x)))]))
    tf, rare = s[0] / s[2], np.log(1 / (s[1] / s[2] + 1e-12) + 1)
    w = tf / (tf.max() + 1e-12) * rare
    return w / (w.sum() + 1e-12)


def pca_weights(df: DataFrame, vector: str, most: int = 50) -> np.ndarray:
    """Each dimension's size in the first components, weighted by their share of the variance.

    The d x d products are summed in the tasks; only their decomposition is made on the driver.
    """
    s = _sums(df, vector, lambda x: np.vstack([x.T @ x, x.sum(0), np.full(x.shape[1], float(len(x)))]))
    n, mean = s[-1, 0], s[-2] / s[-1, 0]
    values, axes = np.linalg.eigh(s[:-2] / n - np.outer(mean, mean))
    order = np.argsort(-values)[:most]
    w = (np.maximum(values[order], 0) / max(np.maximum(values, 0).sum(), 1e-300)) @ np.abs(axes.T[order])
    return w / (w.sum() + 1e-12)


def entropy_weights(df: DataFrame, vector: str, bins: int = 10) -> np.ndarray:
    """Entropy of each dimension over equal bins between its least and greatest value, as a share of all."""
    x = df.select(F.posexplode(vector).alias("pos", "x"))
    ends = x.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(((F.col("hi") - F.col("lo")) / bins), F.lit(0.0))), F.lit(bins - 1))
    n = x.join(F.broadcast(ends), "pos").groupBy("pos", F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # bins a dimension
    count = np.zeros((1 + max(r.pos for r in n), bins))
    for r in n:
        count[r.pos, r.bin] = r.n
    p = count / count.sum(1, keepdims=True)
    h = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    return h / (h.sum() + 1e-12)


def update_centres(df: DataFrame, vector: str, centres: np.ndarray, weights: np.ndarray, explicit: bool, limit: float, eta: float = 0.1) -> tuple[np.ndarray, str]:
    """Centres after new vectors, and how: 'full' on an explicit change or if the mean distance to the nearest
    centre exceeds limit, else 'incremental', which moves them by eta towards the new vectors' means."""
    new, _, objective = kmeans_step(df, vector, centres, weights)
    n = df.filter(F.col(vector).isNotNull()).count()
    if explicit or (n and objective / n > limit):
        return kmeans(df, vector, centres, weights=weights, fixed_weights=True)[0], "full"
    seen = (new != 0).any(axis=1)  # a cluster without new vectors stays where it is
    return np.where(seen[:, None], (1 - eta) * centres + eta * new, centres), "incremental"
