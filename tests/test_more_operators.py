"""Clusters, drift, overlays, late joins, stalls, templates, binary layouts."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrail.operators import relational, rules, vectors
from sentrail.sources import files
from sentrail.streaming import standing


def blobs(spark, k=3, n=60, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, (rng.normal(scale=0.1, size=2) + [10 * (i % k), 0]).tolist()) for i in range(n)], "id int, v array<double>")


def test_best_k_and_seeds(spark):
    df = blobs(spark)
    a, b = vectors.seed_centres(df, "v", 3), vectors.seed_centres(df.repartition(5), "v", 3)
    assert (a == b).all() and len({round(x / 10) for x, _ in a}) == 3
    k, scores = vectors.best_k(df, "v", range(2, 5), 5)
    assert k == 3 and scores[3] > scores[2]
    with pytest.raises(ValueError):
        vectors.seed_centres(df.limit(2), "v", 3)


def test_drift(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 0.0],), ([0.0, 3.0],), (None,)], "v array<double>")
    got = [(r.drifted, r.distance) for r in vectors.drifted(df, "v", [0.0, 0.0], [[4.0, 0.0], [0.0, 1.0]]).collect()]
    assert [g[0] for g in got] == [False, False, True, None] and abs(got[1][1] - 1.5) < 1e-3


def test_branches_and_layers(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b"), (None, "b")], "k int, v string")
    assert {r.v for r in relational.first_with_rows(a.limit(0), b).collect()} == {"b"}
    assert {r.v for r in relational.first_with_rows(a, b).collect()} == {"a"}
    assert relational.first_with_rows(a.limit(0), b.limit(0)).count() == 0
    assert sorted(map(tuple, relational.overlay([a, b], "k").collect())) == [(1, "a"), (2, "b")]


def test_templates_and_counts(spark):
    t = spark.createDataFrame([(1, ["read"]), (2, ["send", "copy"])], "no int, actions array<string>")
    assert [r.no for r in rules.fitting_templates(t, ["copy"]).collect()] == [2] and rules.fitting_templates(t, []).count() == 2
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    assert [tuple(r) for r in rules.rule_counts(df, [{"id": "a", "where": [["v", ">", 2]]}, {"id": "b", "where": []}]).collect()] == [("a", 1, 2), ("b", 3, 0)]
    r, g = spark.createDataFrame([("r1", "x"), ("r2", None)], "rule_id string, role string"), spark.createDataFrame([("x", 1), ("x", 2), (None, 3)], "role string, agent_id int")
    assert sorted(map(tuple, rules.pushed(r, g).collect())) == [("r1", 1), ("r1", 2)]


def test_unpack(spark):
    df = spark.createDataFrame([(1, struct.pack("<xHid", 7, -3, 1.5)), (2, b"\x00"), (3, None)], "id int, raw binary")
    assert [tuple(r) for r in files.unpack(df, "raw", "<xHid", ["a", "b", "c"]).drop("raw").orderBy("id").collect()] == [(1, 7, -3, 1.5), (2, None, None, None), (3, None, None, None)]


def test_merge_config():
    assert files.merge_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}, {"b": 2, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 2, "c": 4}


def test_late_join_and_interleave(spark, tmp_path):
    """Every left row once: met, or with nulls after the watermark."""
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:10"), (3, "z", "2024-01-02 00:00:00")]
    right = [("a", 10, "2024-01-01 00:00:03"), ("b", 11, "2024-01-01 00:09:00"), ("z", 12, "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/left.parquet")
    spark.createDataFrame(right, "k string, n int, u string").withColumn("u", F.col("u").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/right.parquet")
    left, r = standing.table_stream(spark, str(tmp_path), "left"), standing.table_stream(spark, str(tmp_path), "right")
    got = standing.drain(standing.late_join(left, r, "k", "t", "u", 5, "1 minute").select("id", "r_n")).collect()
    assert sorted((x.id, x.r_n) for x in got) == [(1, 10), (2, None), (3, 12)]
    both = standing.interleave(standing.table_stream(spark, str(tmp_path), "left"), standing.table_stream(spark, str(tmp_path), "right"))
    assert standing.drain(both.select("id", "n", "k")).count() == 6


def test_stall_watch():
    class P:
        name, id, numInputRows = "q", 1, 5  # noqa: N815

    class E:
        name, id, progress, exception = "q", 1, P, None

    now = [0.0]
    w = standing.StallWatch(lambda: now[0])
    w.onQueryStarted(E)
    now[0] = 50.0
    assert w.stalled(10) == ["q"]
    w.onQueryProgress(E)
    assert w.stalled(10) == []
    w.onQueryTerminated(E)
    assert w.ended == {"1": None}


def test_ticks_is_a_stream(spark):
    assert standing.ticks(spark).isStreaming


def test_hash_rank_is_a_plain_rank(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(2000)], "id int, g string")
    got = {r.id: r.rank for r in relational.hash_rank(df, "g", "id").collect()}
    import hashlib

    for g in ("a", None):
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(2000) if ("a" if i % 3 else None) == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_recent_history_across_buckets(spark):
    from sentrail.operators.temporal import recent_history

    rows = [(i, s, s % 3 == 0) for i, s in enumerate([0, 1, 59, 60, 61, 119, 120, 180, 181])]
    df = spark.createDataFrame(rows, "id int, s int, trig boolean").withColumn("t", F.timestamp_seconds("s")).withColumn("k", F.lit("x"))
    got = {r.id: list(r.recent) for r in recent_history(df, F.col("trig"), ~F.col("trig"), "k", "t", "id", 2, 60).collect()}
    want = {i: [j for j, u, h in rows if not h and s - 60 <= u and (u, j) < (s, i)][-2:] for i, s, h in rows if h}
    assert got == want


def test_vectors_are_read_whole(spark, tmp_path):
    """Groups that differ only in dimension 40 of 48: nothing may hang on the first eight."""
    from sentrail import queries as Q

    rng = np.random.default_rng(3)
    x = np.zeros((80, 48), np.float32)
    x[:, 40] = [10 * (i % 4) for i in range(80)] + rng.normal(scale=0.1, size=80)
    x[:, 41] = rng.normal(size=80)
    spark.createDataFrame([(i, i % 4, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = {n: f for m in Q.modules() for n, f in m.QUERIES.items()}
    run = lambda n: q[n](spark, str(tmp_path)).collect()
    assert {(r.vec_id, r.cluster) for r in run("cl5_kmeans")} == {(i, i % 4) for i in range(80)}
    assert sorted(r.n for r in run("cl10_spark_kmeans")) == [20] * 4
    assert {(r.vec_id, r.cluster) for r in run("cl6_nearest")} == {(i, i % 4) for i in range(80)}
    assert [r.nmi for r in run("cl9_nmi")] == [1.0]
    assert [r.pos for r in run("ag12_selected")] == [40]
    cov = {(r.label, r.pos, r.other): r.cov for r in run("ag13_covariance")}
    assert len(cov) == 4 * 48 * 49 // 2
    for label in range(4):
        assert cov[label, 40, 41] == pytest.approx(np.cov(x[label::4].astype(float).T)[40, 41], abs=1e-7)


def test_no_rows_are_left_out(spark, tmp_path, data):
    """The grammar reads events after the sixth; orders of all nations and documents of all sources count."""
    from sentrail import queries as Q

    q = {n: f for m in Q.modules() for n, f in m.QUERIES.items()}
    kinds = {1: ["view"] * 6 + ["error", "purchase"], 2: ["click"] * 7 + ["signup"], 3: ["view"] * 9}
    spark.createDataFrame([(u, i, f"2024-01-01 00:{i:02d}:00", k) for u, own in kinds.items() for i, k in enumerate(own)], "user_id int, event_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.state for r in q["rl4_grammar"](spark, str(tmp_path)).collect()} == {1: "p", 2: "fail", 3: "s"}
    buyers = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey").distinct().count()
    assert q["jn7_lateral"](spark, data).filter("rank = 1").count() == buyers
    assert q["st9_priority"](spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
