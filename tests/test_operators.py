"""Small fixtures with known results, and the awkward cases: nulls, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrail.functions import canon, scalars
from sentrail.functions.times import coerce_ts
from sentrail import session
from sentrail.operators import bitslice, folds, predicates, relational, rules, shred, temporal, vectors
from sentrail.operators.entity_features import feature_cells, feature_table
from sentrail.operators.ordinals import with_ordinals
from sentrail.operators.scan import pattern_hits
from sentrail.plans.workbook import Workbook
from sentrail.sources import files, sinks
from sentrail.streaming.standing import StandingQueries, fan_out


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_machine_key(spark):
    assert column(spark, ["vm0041", " VM-41 ", "Vm0041.DESK.EXAMPLE", "ｖｍ００４１", "vm_41", "VM 41"], canon.machine_key) == ["vm:41"] * 6
    assert column(spark, ["vm0000", None, "", "n/a", "localhost", "-"], canon.machine_key) == ["vm:0", None, None, None, None, None]


def test_level_key(spark):
    assert column(spark, ["L2", " l2", "Level 2", "LEVEL_2", "Ｌ２", "内部级", "内部级(L2)", "内部级（L2）"], canon.level_key) == ["L2"] * 8
    assert column(spark, ["L9", "?", "", None, "unrated"], canon.level_key) == [None] * 5


def test_target_key(spark):
    def keys(kind, values):
        return column(spark, values, lambda c: canon.target_key(F.lit(kind), c))

    assert set(keys("file", ["a_1.csv", "D:\\x\\A_1.CSV", "file:///srv/a_1.csv", "a%5F1.csv", " ａ＿１．ｃｓｖ\xa0"])) == {"a_1.csv"}
    assert set(keys("email", ["a@b.c", "<A@b.c>", "mailto:a@b.c", "Team a <a@b.c>", "a@b.c;"])) == {"a@b.c"}
    assert set(keys("http", ["https://h.x/files/a", "HTTPS://H.X/files/a/", "https://h.x:443/files/a?s=1", "https://h.x//files/a#top"])) == {"h.x/files/a"}
    assert keys("http", ["https://h.x/files/ab"]) != keys("http", ["https://h.x/files/a"])
    assert set(keys("device", ["Pell_Drive", "USB\\Pell_Drive", "Pell Drive", "pell-drive"])) == {"pell_drive"}
    assert keys("file", [None, "", "100%zz"]) == [None, "", "100%zz"]


def test_coerce_ts(spark):
    same = ["1704366605", "1704366605000", "1704366605000000", "2024-01-04T11:10:05Z", "2024/01/04 11:10:05", "2024-01-04T19:10:05+08:00", "2024-01-04 11:10:05"]
    assert set(column(spark, same, lambda c: F.unix_seconds(coerce_ts(c)))) == {1704366605}
    assert column(spark, [None, "", "soon", "2024-13-40"], lambda c: coerce_ts(c)) == [None] * 4


def test_ordinals(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i) for i in random.Random(1).sample(range(500), 500)] + [(None, -1)], "k string, ordinal_x int")
    assert [(r.k, r.n) for r in with_ordinals(df, "k", "n").orderBy("k").collect()] == [(f"k{i:04d}", i) for i in range(500)]
    assert with_ordinals(df.filter("k = 'none'"), "k").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_carry_add(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 3000, 500)
    ia, ib = np.flatnonzero(a), np.flatnonzero(b)
    planes = bitslice.carry_add(bitslice.slices(ia, a[ia]), bitslice.slices(ib, b[ib]))
    assert (bitslice.decode(planes, np.arange(500)) == np.pad(a, (0, 200)) + b).all()
    assert (bitslice.members(bitslice.dense(bitslice.pack(ia))) == ia).all()
    assert bitslice._dump(bitslice._load(bitslice._dump(planes))) == bitslice._dump(planes)


def test_entity_cells_against_counting(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice([0, 1, 5, 70_000, 70_001, 200_000]), rng.randrange(1000), rng.randrange(9)) for _ in range(6000)] + [(None, 1, 1, 1), (1, None, 1, 1)]
    df = spark.createDataFrame(rows, "cell int, ordinal long, ts long, measure long").repartition(5)
    want = {}
    for c, o, t, m in rows[:-2]:
        n, s, last = want.get((c, o), (0, 0, -1))
        want[c, o] = (n + 1, s + m, max(last, t))
    got = {(r.cell, r.ordinal): (r.n_events, r.total, r.last_seen) for r in bitslice.entity_cells(df).collect()}
    assert got == want
    assert bitslice.entity_cells(df.limit(0)).count() == 0


EVENT = "event_id string, vm_id string, event_type string, sensitivity_level string, timestamp timestamp, metadata map<string,string>, ordinal int, cell string"


def test_feature_cells_cases(spark):
    t = "2024-01-05 10:00:00"
    rows = [("e1", "VM-1", "FILE", "l1", t, {"step": "3"}), ("e1", "vm0001", "file ", "L1", t, None), (None, "vm0001", "file", "L1", t, {}), ("e2", "vm9999", "file", "L1", t, {}), ("e3", "vm0001", "nope", "L1", t, {}), ("e4", "vm0001", "file", None, "2024-02-01 00:00:00", {}), ("e5", "vm0001", "file", "?", "2024-01-31 23:59:59", {"step": "x"}), ("e6", None, None, None, None, None)]
    ev = spark.createDataFrame([(*r, 1, "x") for r in rows], EVENT.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    machines = spark.createDataFrame([("vm0001", 7), ("vm0002", 8)], "vm_id string, ordinal int")
    catalog = spark.createDataFrame([("file", "file")], "event_type string, base_type string")
    cells = feature_cells(ev, machines, catalog)
    assert sorted(map(tuple, cells.collect())) == [("vm0001", "file", "L1", 1, 0, 1704448800), ("vm0001", "file", "none", 1, 0, 1706745599)]
    wide = {r.vm_id: r for r in feature_table(cells, machines).collect()}
    assert wide["vm0001"].n_events == 2 and wide["vm0001"].count_by_level == {"L1": 1, "none": 1} and wide["vm0002"].n_events == 0
    assert feature_cells(ev.limit(0), machines, catalog).count() == 0
    assert feature_cells(ev, machines.limit(0), catalog).count() == 0


def shredded(spark, payloads, **kw):
    df = spark.createDataFrame([(i, p, "c") for i, p in enumerate(payloads)], "record_id long, payload string, tab string")
    m = shred.read_mapping(df, "record_id", "payload", ("record",))
    return m, shred.shred(df, "record_id", "payload", m, ("record",), **kw).collect()


def test_shred(spark):
    deep = {"name": "n", "children": [{"name": "m", "children": [{"name": "o"}]}]}
    payloads = [
        json.dumps({"seqId": "s1", "events": [{"event_id": "a", "metadata": {"step": 1, "attachments": {"name": "x"}}}, {"event_id": "b", "attachments": [{"name": "y"}, {"name": "z"}]}]}),
        json.dumps({"schema": 2, "record": {"seq_id": "s2", "events": {"0": {"event_id": "c"}, "1": {"event_id": "d"}}}}),
        json.dumps({"seq_id": "s3", "events": json.dumps([{"event_id": "e"}])}),
        json.dumps([{"seq_id": "s4", "stages": [{"stage": "q", "events": [{"event_id": "f"}]}, {"stage": "r", "events": None}, {"events": [{"event_id": "g"}]}]}]),
        '{"seq_id": "cut", "events": [', None, "", "null", "{}", "[]", "collector restarted", json.dumps(deep), json.dumps({"t": "x" * 200_000}),
    ]
    m, rows = shredded(spark, payloads)
    assert {"events", "attachments", "stages", "children"} <= m.tables and "metadata" not in m.tables
    ev = sorted((r.source_id, r.record_pos, r.cols["event_id"], r.parent_tab) for r in rows if r.tab == "events")
    assert ev == [(0, 0, "a", "root"), (0, 1, "b", "root"), (1, 0, "c", "root"), (1, 1, "d", "root"), (2, 0, "e", "root"), (3, 0, "f", "stages"), (3, 1, "g", "stages")]
    by = {(r.source_id, r.node): r for r in rows}
    att = sorted((r.cols["name"], by[r.source_id, r.parent_node].cols["event_id"], r.pos) for r in rows if r.tab == "attachments")
    assert att == [("x", "a", 0), ("y", "b", 0), ("z", "b", 1)]
    assert {r.source_id for r in rows if r.tab == "_rejected"} == {4, 5, 6, 10}
    assert [r.cols["metadata.step"] for r in rows if r.tab == "events" and "metadata.step" in r.cols] == ["1"]
    assert sorted(by[r.source_id, r.parent_node].cols["name"] for r in rows if r.tab == "children") == ["m", "n"]
    _, few = shredded(spark, payloads, keep={"events": ("event_id",)})
    assert {k for r in few for k in r.cols} == {"event_id"}
    assert {r.tab for r in few} == {"events"}


def test_shred_keys_that_are_data(spark, monkeypatch):
    """Beyond the bound of keys a label's keys become rows of key and value; no value is lost."""
    monkeypatch.setattr(shred, "MAX_CHILDREN", 20)
    payloads = [json.dumps({"seq_id": str(i), "by_host": {f"h{i}-{j}": {"n": j} if j % 2 else j for j in range(30)}}) for i in range(40)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "record_id long, payload string").repartition(8)
    edges = [tuple(e) for e in shred.schema_edges(df, "record_id", "payload").collect()]
    assert sorted(e[:2] for e in edges) == [("by_host", "by_host_entry"), ("root", "by_host"), ("root", "seq_id")]
    m = shred.map_schema(edges)
    rows = shred.shred(df, "record_id", "payload", m).filter("tab = 'by_host_entry'").collect()
    assert len(rows) == 40 * 30 and {(r.cols["key"], r.cols["value"]) for r in rows} == {(f"h{i}-{j}", json.dumps({"n": j} if j % 2 else j)) for i in range(40) for j in range(30)}


def test_shred_alike_keys_and_depth(spark):
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    m, rows = shredded(spark, ['{"eventId":"A","event_id":"B"}', deep])
    assert next(r.cols for r in rows if r.source_id == 0) == {"event_id": "A", "event_id#2": "B"}
    assert sum(r.tab == "a" for r in rows) == 5000 and not any(r.tab == "_rejected" for r in rows)


def test_shred_empty(spark):
    df = spark.createDataFrame([], "record_id long, payload string")
    m = shred.read_mapping(df, "record_id", "payload")
    assert shred.shred(df, "record_id", "payload", m).count() == 0


def test_predicates(spark):
    assert column(spark, ["a.tmp", "b.csv", None], lambda c: predicates.excluded(c, ["*.tmp"])) == [True, False, False]
    assert column(spark, ["USB mail", "http", None], lambda c: predicates.first_match(c, [("usb", "u"), ("mail", "m")], "local")) == ["u", "local", "local"]
    assert column(spark, ["", None, "x"], lambda c: predicates.or_else(c, F.lit("d"))) == ["d", "d", "x"]
    df = spark.createDataFrame([("ab",), (None,), ("c",)], "v string")
    assert predicates.table_filter(df, "v", "!A").count() == 2 and predicates.table_filter(df, "v", "A").count() == 1
    assert predicates.only_if_any(df, df.limit(0)).count() == 0


def test_relational(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), (None, 9)], "k string, s int")
    new = spark.createDataFrame([("b", 2), ("c", 3), ("d", 4)], "k string, s int")
    assert sorted(map(tuple, relational.snapshot_diff(old, new, "k", ["s"]).collect())) == [("a", "removed"), ("c", "changed"), ("d", "added")]
    tree = spark.createDataFrame([("/a/b/x", 1), ("/a/y", 2), ("z", 4), (None, 8)], "p string, n int")
    assert {r.dir: r.total for r in relational.path_rollup(tree, "p", "n").collect()} == {"/": 7, "/a": 3, "/a/b": 1}
    chain = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(30, 31), (31, 30)], "c int, p int")
    got = {(r.node, r.ancestor): r.depth for r in relational.call_chain(chain, "c", "p").collect()}
    assert got[(20, 0)] == 20 and got[(5, 2)] == 3 and got[(30, 30)] == 2


def test_temporal(spark):
    e = spark.createDataFrame([(i, i % 2, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 1, 2, 30, 31, 59])], "id int, k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    j = temporal.interval_join(e, e, "k", "t", "t", 120).select("id", "r_id").collect()
    assert sorted(map(tuple, j)) == [(0, 0), (0, 2), (1, 1), (2, 0), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_rules(spark):
    bad = {"id": "x", "logic": "xor", "where": [["colour", "==", 1], ["v", "~", 2], ["v", "in", 3]]}
    assert len(rules.errors(bad, ["v"])) == 4
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b'c")], "v int, s string")
    some = [{"id": "r", "where": [["s", "!=", "a"]]}, {"id": "q", "where": [["s", "==", "b'c"], ["v", ">=", 3]]}, {"id": "all", "where": []}]
    assert sorted((r.v, r.rule_id) for r in rules.evaluate(df, some).collect()) == [(1, "all"), (2, "all"), (3, "all"), (3, "q"), (3, "r")]
    df.createOrReplaceTempView("rule_rows")
    assert spark.sql(rules.sql_text(some[1], "rule_rows")).count() == 1
    assert rules.evaluate(df, []).count() == 0
    assert rules.contradicts({"where": [["v", ">", 5], ["v", "<", 3]]}) and not rules.contradicts({"where": [["v", ">", 3], ["v", "<", 5]]})
    assert rules.is_well_formed("// note\nSELECT a FROM b WHERE c = 'x)'") and not rules.is_well_formed("SELECT (a FROM b")


def test_folds_match_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), rng.randrange(500)) for i in range(600)]
    df = spark.createDataFrame([(i, k, float(t)) for i, k, t in rows], "id int, k int, s double").withColumn("t", F.timestamp_micros((F.col("s") * 1000000).cast("long")))
    got = {r.id: r.admitted for r in folds.admission(df, "k", "t", "id", 3, 40).collect()}
    want = {}
    for k in range(3):
        let: list[int] = []
        for t, i in sorted((t, i) for i, kk, t in rows if kk == k):
            ok = sum(x > t - 40 for x in let) < 3
            want[i] = ok
            if ok:
                let.append(t)
    assert got == want
    assert folds.admission(df.limit(0), "k", "t", "id").count() == 0


def test_grok_and_text(spark):
    assert column(spark, ["GET /a/b 200", "x"], lambda c: scalars.grok(c, "%{WORD:verb} %{PATH:path} %{INT:code:int}")["code"]) == [200, None]
    with pytest.raises(ValueError):
        scalars.grok(F.col("v"), "%{NOPE:x}")
    assert column(spark, ["/a/b/c.txt", "c", "", None], scalars.basename) == ["c.txt", "c", "", None]
    assert column(spark, ["/a/b", "", None], lambda c: scalars.path_part(c, -1)) == ["b", None, None]


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä 中", "2024-01-01"), (2, None, "2024-01-02")], "id int, t string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    sinks.write_jsonl(df.drop("ts"), f"{tmp_path}/j")
    (tmp_path / "j" / "more.json").write_text('{"id": 3, "t": "x", "d"\n')
    assert sorted(r.id for r in files.read_jsonl(spark, f"{tmp_path}/j", "id int, t string, d string").collect()) == [1, 2]
    assert files.read_jsonl(spark, f"{tmp_path}/j", "id int, t string, d string", True).filter("_broken IS NOT NULL").count() == 1
    sinks.write_csv(df, f"{tmp_path}/c", ["t", "id"])
    assert {r.id for r in files.read_csv(spark, f"{tmp_path}/c").collect()} == {"1", "2"}
    for _ in range(2):
        sinks.append_audit(df, f"{tmp_path}/a", "ts")
    assert spark.read.json(f"{tmp_path}/a").count() == 4
    sinks.export(df, f"{tmp_path}/e", ["ts"], "Asia/Shanghai")
    assert {r.ts for r in spark.read.json(f"{tmp_path}/e").collect()} == {"2024-01-01T08:00:00", "2024-01-02T08:00:00"}
    sinks.write_indexed(df.drop("ts"), f"{tmp_path}/i", "d")
    assert spark.read.json(f"{tmp_path}/i").count() == 2
    (tmp_path / "l.txt").write_text("a b/c.tif 7\nbroken\nd.tif 1\n")
    assert sorted(map(tuple, files.read_path_labels(spark, f"{tmp_path}/l.txt").collect())) == [("a b/c.tif", 7), ("d.tif", 1)]
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "inner.zip", "w") as z:
        z.writestr("in.txt", "deep")
    with zipfile.ZipFile(tmp_path / "z" / "o.zip", "w") as z:
        z.write(tmp_path / "inner.zip", "inner.zip")
        z.writestr("top.txt", "flat")
    (tmp_path / "z" / "bad.zip").write_bytes(b"no zip")
    assert {(r.member, r.content and bytes(r.content)) for r in files.read_zip_members(spark, f"{tmp_path}/z").collect()} == {("inner.zip!in.txt", b"deep"), ("top.txt", b"flat"), ("", None)}
    assert {r.name for r in files.snapshot(spark, f"{tmp_path}/z").collect()} == {"o.zip", "bad.zip"}
    assert files.read_texts(spark, f"{tmp_path}", "l.txt").first().text.startswith("a b")


def test_fan_out_sets_failures_aside(spark):
    kept, dead = [], []

    def fail(df):
        raise RuntimeError("no")

    fan_out({"a": ("v > 1", lambda df: kept.append(df.count())), "b": ("v = 1", fail)}, lambda df, name, why: dead.append((name, df.count())))(spark.createDataFrame([(1,), (2,)], "v int"), 0)
    assert kept == [1] and dead == [("b", 1)]


def test_standing_queries():
    class Q:
        def __init__(self):
            self.running = True

        def stop(self):
            self.running = False

    made = {}

    def start(name):
        made[name] = Q()
        return made[name]

    s = StandingQueries()
    assert s.set({"a": ("1", lambda: start("a")), "b": ("1", lambda: start("b"))}) == ["a", "b"]
    assert s.set({"a": ("1", lambda: start("a")), "b": ("1", lambda: start("b"))}) == [] and s.version == 1
    old = made["a"]
    assert s.set({"a": ("2", lambda: start("a"))}) == ["a"] and not old.running and not made["b"].running
    s.stop()


def test_pattern_hits(spark):
    df = spark.createDataFrame([(1, "ab 12 ab 34 ab"), (2, None), (3, ""), (4, "x\x00y")], "id int, text string")
    got = sorted(map(tuple, pattern_hits(df, "id", "text", {"n": r"\d+", "e": "z*", "h": "0x6162", "z": "\x00"}, hits=2, context=1).collect()))
    assert got == [(1, "h", 0, 0, "ab", "ab "), (1, "h", 1, 6, "ab", " ab "), (1, "n", 0, 3, "12", " 12 "), (1, "n", 1, 9, "34", " 34 "), (4, "z", 0, 1, "\x00", "x\x00y")]
    assert pattern_hits(df.limit(0), "id", "text", {"n": "1"}).count() == 0


def test_workbook(spark):
    runs = []

    def numbers(book, upto=3):
        runs.append(upto)
        return spark.range(upto)

    book = Workbook(spark).fixed("numbers", numbers).let("twice", lambda b, upto=3: b.use("numbers", upto=upto).selectExpr("id * 2 AS id"))
    assert book.use("twice").count() == 3 and book.use("twice").count() == 3 and runs == [3]
    assert book.use("twice", upto=5).count() == 5 and runs == [3, 5]
    assert {r._source for r in book.call("twice").collect()} == {"twice"}
    assert book.query("SELECT id FROM {twice} WHERE id > :least", least=1).count() == 2
    assert book.query("SELECT 1 AS x WHERE :name = 'a'' OR 1=1'", name="b").count() == 0
    with pytest.raises(KeyError):
        book.use("nothing")


def test_knn_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 6)).round(2)
    m[7] = m[9]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, v array<double>").repartition(5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    got = {}
    for r in vectors.knn(rows, rows.filter("id % 5 = 0"), "id", "v", 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.row_id))
    norm = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(0, 120, 5):
        s = norm @ norm[q]
        want = [i for i in np.lexsort((np.arange(120), -s.round(12))) if i != q][:4]
        assert [i for _, i in sorted(got[q])] == want
    assert vectors.knn(rows, rows.limit(0), "id", "v", 4).count() == 0


def test_kmeans_step_empty_cluster(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],), (None,)], "v array<double>")
    new, weights, objective = vectors.kmeans_step(df, "v", np.array([[0.5, 0.5], [9.0, 9.0]]), np.array([0.5, 0.5]))
    assert new.tolist() == [[0.5, 0.5], [0.0, 0.0]] and abs(weights.sum() - 1) < 1e-9 and abs(objective - 0.5) < 1e-9


def test_broadcast_only_when_small(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 3)
    plan = lambda n: session.broadcast_if_small(spark.range(n))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(3).lower() and "broadcast" not in plan(4).lower()


def test_attachments_below_any_table(spark, tmp_path):
    """Attachments find their event also where metadata is a table of its own."""
    from sentrail.queries.nested import QUERIES as Q

    events = [{"event_id": "a", "metadata": {"attachments": [{"name": "x"}, {"name": "y"}]}}, {"event_id": "b", "attachments": [{"name": "z"}], "metadata": [{"attachments": {"name": "u"}}, {"attachments": {"name": "v"}}]}]
    payloads = [json.dumps({"seq_id": "s", "events": events}), json.dumps({"seq_id": "t", "metadata": {"by": "m"}, "attachments": [{"name": "w"}]})]
    spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string").write.parquet(f"{tmp_path}/raw_sequences.parquet")
    found = sorted((r.event_id, r.item_pos) for r in Q["p1_found"](spark, str(tmp_path)).collect())
    assert found == [("a", -1), ("a", 0), ("a", 1), ("b", -1), ("b", 0), ("b", 1), ("b", 2)]
    node = {r.event_id: r.node for r in Q["p1_events"](spark, str(tmp_path)).collect()}
    own = {r.name: (r.event_node, r.item_pos) for r in Q["p1_attachments"](spark, str(tmp_path)).collect()}
    assert {k: own[k] for k in "xyzuv"} == {"x": (node["a"], 0), "y": (node["a"], 1), "z": (node["b"], 0), "u": (node["b"], 1), "v": (node["b"], 2)}
