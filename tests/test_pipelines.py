"""Composed pipelines, baselines, template checks, streams and files against brute force and awkward cases."""

from __future__ import annotations

import io
import math
import zipfile
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sentrail.operators import pipelines, relational, rules, scan, temporal, vectors
from sentrail.queries.aggregates import zscore
from sentrail.queries.pipelines import _TEMPLATE_COLUMNS, TEMPLATES
from sentrail.sources import files
from sentrail.streaming import standing


def test_chains_beyond_any_depth(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(70)], "c int, p int")
    got = {(r.node, r.ancestor): r.depth for r in relational.call_chain(chain, "c", "p").collect()}
    assert got == {(a, b): a - b for a in range(71) for b in range(a)}
    assert relational.call_chain(chain.limit(0), "c", "p").count() == 0


def test_windows_in_buckets_are_windows(spark):
    """Frames that reach back over days, with gaps and ties, against frames over the whole key."""
    rng = np.random.RandomState(1)
    rows = [(int(i), int(rng.randint(3)), int(rng.choice([0, 5, 86_400 * 3]) + rng.randint(0, 5 * 86_400, 1)[0] // 7 * 7), float(rng.randint(9))) for i in range(600)] + [(999, None, 5, 1.0)]
    df = spark.createDataFrame(rows, "id int, k int, s int, v double").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: (r.n, sorted(r.vs)) for r in temporal.within_seconds(df, "k", "t", 3600, n=F.count(F.lit(1)), vs=F.collect_list("v")).collect()}
    for i, k, s, _ in rows:
        own = [r[3] for r in rows if r[1] == k and s - 3600 <= r[2] <= s]
        assert got[i] == (len(own), sorted(own))
    by: dict = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    ctx = temporal.with_context(df.filter("k IS NOT NULL").select("id", "k", "t", "v"), "k", temporal.day_of("t"), ["t", "id"], 7)
    from pyspark.sql import Window

    w = Window.partitionBy("k", "_bucket").orderBy("t", "id").rowsBetween(-7, 0)
    seen = {r.id: r.x for r in ctx.withColumn("x", F.sum("v").over(w)).filter("NOT _context").collect()}
    assert seen == {own[i][0]: sum(r[3] for r in own[max(0, i - 7) : i + 1]) for own in by.values() for i in range(len(own))}


def test_running_max(spark):
    rows = [(1, "a", 10, 5), (2, "a", 20, None), (3, "a", 90_000, 7), (4, "a", 200_000, 1), (5, "b", 5, 1), (6, None, 6, 2), (7, None, 90_000, 3)]
    df = spark.createDataFrame(rows, "id int, k string, s int, v int").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: r.m for r in temporal.running_max(df, ["k"], "t", ["t", "id"], F.col("v"), "m").collect()}
    assert got == {1: None, 2: 5, 3: 5, 4: 7, 5: None, 6: None, 7: 2}


def test_recent_history_holds_few(spark):
    rows = [(i, i // 3, i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s int, asks boolean").withColumns({"t": F.timestamp_seconds("s"), "k": F.lit(1)})
    got = {r.id: list(r.recent) for r in temporal.recent_history(df, F.col("asks"), ~F.col("asks"), "k", "t", "id", 3, 10).collect()}
    want = {i: [j for j, u, past in rows if not past and (u, j) < (s, i) and u >= s - 10][-3:] for i, s, asks in rows if asks}
    assert got == want


def test_quantiles(spark, monkeypatch):
    rng = np.random.RandomState(3)
    x = {"a": rng.randn(9000).round(2), "b": rng.randn(5), "c": np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, xs in x.items() for v in xs] + [("a", None)], "g string, x double")
    shares = [0.1, 0.25, 0.5, 0.9]
    for r in vectors.quantiles(df, "g", "x", shares).collect():
        assert np.allclose(r.cuts, np.quantile(x[r.g], shares))


def test_weights_and_updates(spark):
    rng = np.random.RandomState(2)
    m = np.vstack([rng.randn(60, 5) + 4, rng.randn(60, 5) - 4])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, v array<double>").repartition(5)
    tf = np.abs(m).mean(0) / np.abs(m).mean(0).max() * np.log(1 / (np.abs(m) > 0.1).mean(0) + 1)
    assert np.allclose(vectors.tfidf_weights(df, "v"), tf / tf.sum(), atol=1e-6)
    values, axes = np.linalg.eigh(np.cov(m.T, ddof=0))
    w = (values / values.sum()) @ np.abs(axes.T)
    assert np.allclose(vectors.pca_weights(df, "v"), w / w.sum(), atol=1e-6)
    h = [-sum(c / 120 * math.log(c / 120) for c in np.histogram(m[:, j], 10)[0] if c) for j in range(5)]
    assert np.allclose(vectors.entropy_weights(df, "v"), np.array(h) / sum(h), atol=1e-6)
    assert vectors.gain_weights([1.0, -2.0, 3.0]).tolist() == [0.25, 0.0, 0.75] and vectors.gain_weights([0.0, -1.0]).tolist() == [0.5, 0.5]
    centres, equal = np.vstack([np.full(5, 4.0), np.full(5, -4.0)]), np.full(5, 0.2)
    moved, how = vectors.update_centres(df, "v", centres, equal, False, 50.0)
    assert how == "incremental" and np.allclose(moved, 0.9 * centres + 0.1 * np.vstack([m[:60].mean(0), m[60:].mean(0)]))
    assert vectors.update_centres(df, "v", centres, equal, True, 50.0)[1] == "full" == vectors.update_centres(df, "v", centres + 90, equal, False, 1.0)[1]


def test_cluster_distances_in_blocks(spark, monkeypatch):
    rng = np.random.RandomState(4)
    m, c = rng.randn(50, 3), [i % 3 for i in range(50)]
    df = spark.createDataFrame([(i, c[i], v.tolist()) for i, v in enumerate(m)], "id long, c int, v array<double>").repartition(4)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    got = {(r.query_id, r.cluster): (r.s, r.n) for r in vectors.cluster_distances(df, df.filter("id % 5 = 0"), "id", "v", "c").collect()}
    assert set(got) == {(i, k) for i in range(0, 50, 5) for k in range(3)}
    for (i, k), (s, n) in got.items():
        own = [j for j in range(50) if c[j] == k]
        assert n == len(own) and math.isclose(s, sum(np.linalg.norm(m[i] - m[j]) for j in own), rel_tol=1e-6)


def test_scores_and_grades_of_awkward_rows(spark):
    e = spark.createDataFrame([(1, "u", "a", 1.0), (2, "u", "a", None), (3, "u", None, 2.0), (4, None, "a", 3.0)], "id int, k string, t string, v double")
    rows = {r.id: r for r in pipelines.score_events(e, "k", "t", "v", F.lit(0.5), pipelines.Scoring()).collect()}
    assert len(rows) == 4 and rows[4].consistency == 1.0 and rows[4].deviation == 0.0 and math.isclose(rows[3].consistency, math.sqrt(1 / 3))
    assert rows[2].deviation == 0.0 and all(0 <= r.score <= 1 for r in rows.values())
    docs = spark.createDataFrame([(1, None, "m", "L1"), (2, "x", None, None), (3, "x", "m", None)], "id int, t string, g string, lv string")
    got = pipelines.grade_by_votes(docs, "id", "t", "g", F.col("lv"), F.lit(None)).collect()
    assert {r.id for r in got} == {1, 2, 3} and all(0 <= r.level < 4 and 0.2 <= r.share <= 1 for r in got)
    assert pipelines.grade_by_votes(docs.limit(0), "id", "t", "g", F.col("lv"), F.lit(None)).count() == 0
    z = zscore(spark.createDataFrame([(1.0,), (3.0,)], "n double"), "n", mean=1.0, std=2.0)
    assert [r.z for r in z.collect()] == [0.0, 1.0]


def test_templates(spark):
    df = spark.createDataFrame(TEMPLATES, _TEMPLATE_COLUMNS)
    want = set()
    for a, b in combinations(TEMPLATES, 2):
        if a[1] == b[1] and (set(a[2]) & set(b[2]) or "any" in a[2] + b[2]):
            if a[3] == b[3] and a[4] and b[4] and a[4] != b[4]:
                want.add((a[0], b[0], "severity"))
            if a[5] + b[5] > 100:
                want.add((a[0], b[0], "memory"))
    assert set(map(tuple, rules.template_conflicts(df, 50.0).collect())) == want
    both = df.withColumns({"roles": F.array(F.lit("ops")), "kinds": F.col("actions"), "cost": F.col("mem")})
    assert rules.synthesize(both, ["ops"], ["send"], ["send"], "L1", 60.0) == 3
    assert rules.synthesize(both, ["ops"], ["send"], ["send"], "L4", 8.0) is None
    moves = {("s", "select"): "a", ("a", "star"): "b", ("b", "from"): "c", ("c", "name"): "end"}
    assert rules.corrected(["select", "star", "form", "name"], moves, "s", {"end"}) == ["select", "star", "from", "name"]
    assert rules.corrected(["select", "oops", "star", "from", "name"], moves, "s", {"end"}) == ["select", "star", "from", "name"]
    assert rules.corrected(["a", "b", "c"], moves, "s", {"end"}) is None


def test_priorities_and_parts(spark):
    seen: list = []
    df = spark.range(25)
    subscribers = {n: ("id >= 0", lambda b, n=n: seen.append(n), *p) for n, p in (("low", ()), ("high", (5,)), ("mid", (1,)), ("low2", ()))}
    standing.fan_out(subscribers, lambda *a: None)(df, 0)
    assert seen == ["high", "mid", "low", "low2"]
    parts: list = []
    standing.in_parts(lambda b: parts.append(sorted(r.id for r in b.collect())), max_rows=10)(df, 0)
    assert sorted(x for p in parts for x in p) == list(range(25)) and 1 < len(parts) <= 3
    standing.in_parts(parts.append)(df.limit(0), 0)
    assert len(parts) <= 3


def test_office_files_and_ranges(spark, tmp_path):
    def zipped(name: str, members: dict[str, str]) -> None:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n, t in members.items():
                z.writestr(n, t)
        (tmp_path / name).write_bytes(raw.getvalue())

    zipped("A.docx", {"word/document.xml": '<w:d xmlns:w="w"><w:p><w:r><w:t>One</w:t><w:t> line</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:d>'})
    zipped("b.xlsx", {"xl/sharedStrings.xml": '<s xmlns="x"><si><t>name</t></si><si><t>sum</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="x"><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>k</t></is></c><c><v>3.5</v></c></row></w>'})
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_text("plain", "utf-8")
    got = {r.path.rpartition("/")[2]: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"A.docx": "One line\nTwo", "b.xlsx": "name\tsum\nk\t3.5", "broken.docx": "", "c.txt": "plain"}
    assert [r.name for r in files.find_nocase(spark, str(tmp_path), "a.DOCX").collect()] == ["A.docx"]
    df = spark.createDataFrame([(b"abcdefgh",), (None,)], "c binary")
    assert [r.c and bytes(r.c) for r in files.read_ranges(df, "c", [(4, 2), (None, 2), (0, 3)]).collect()] == [b"ef\x00\x00abc", None]
    hits = scan.pattern_hits(spark.createDataFrame([(1, "a1 a2 a3")], "id int, t string"), "id", "t", {"a": r"a\d"}, hits=2, backward=True).collect()
    assert [(r.found, r.start) for r in hits] == [("a3", 6), ("a2", 3)]


def test_zip_bombs_and_depth(spark, tmp_path):
    body = b"deepest"
    for i in range(6):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("x.txt" if i == 0 else f"n{i}.zip", body)
        body = raw.getvalue()
    (tmp_path / "o.zip").write_bytes(body)
    got = files.read_zip_members(spark, str(tmp_path)).collect()
    assert [(r.member, bytes(r.content), r.note) for r in got] == [("n5.zip!n4.zip!n3.zip!n2.zip!n1.zip!x.txt", b"deepest", None)]
    assert Counter(r.note for r in files.read_zip_members(spark, str(tmp_path), most_bytes=100).collect()) == {"too large": 1}
