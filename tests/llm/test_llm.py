"""Operators for training data against brute force, round trips and awkward cases."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrail import llm
from sentrail.llm import components as C
from sentrail.llm import packing, residue, winnow
from sentrail.llm import subsequences as S
from sentrail.llm.runs import collapse_runs
from sentrail.llm.sampling import draw_sample, matching, quota_report, reservoirs, size_of
from sentrail.llm.subsequences import PatternTree, frequent_subsequences
from tests.oracle import compare

QUERIES = {n: f for m in llm.modules() for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in llm.modules() for n, s in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    compare(spark, data, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    df.collect()
    assert df.columns


def test_registered():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 7, 8, 9)} <= set(QUERIES)


# Runs


def runs_of(rows):
    out = {}
    for s in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        found, i = [], 0
        while i < len(own):
            j = i
            while j < len(own) and own[j][3] == own[i][3]:
                j += 1
            times = [r[1] for r in own[i:j] if r[1] is not None]
            found.append((own[i][2], own[i][3], j - i, max(times) - min(times) if times else None))
            i = j
        out[s] = sorted(found, key=str)
    return out


@pytest.mark.parametrize("chunk", [50, 400, 10**6])
def test_runs_for_any_chunk(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 1500, 7)]), f"e{i}", rng.choice(["x", "x", "x", "y", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "seq_id string, s int, event_id string, k string").withColumn("t", F.timestamp_seconds("s"))
    got: dict = {}
    for r in collapse_runs(df, "seq_id", "t", "event_id", ["k"], chunk).collect():
        got.setdefault(r.seq_id, []).append((r.first_event_id, r.k, r.n_events, None if r.duration_us is None else r.duration_us // 10**6))
    assert {s: sorted(v, key=str) for s, v in got.items()} == runs_of(rows)
    assert collapse_runs(df.limit(0), "seq_id", "t", "event_id", ["k"], chunk).count() == 0


# Components and splits


@pytest.mark.parametrize("local,fan_in,least", [(10**6, 8, 4), (10**6, 2, 9), (60, 2, 4), (5, 2, 4), (1, 2, 2)])
def test_components(spark, monkeypatch, local, fan_in, least):
    """However many local forests there are, merged in one or more levels, with and without rounds of stars."""
    monkeypatch.setattr(C, "LOCAL_LINKS", local)
    monkeypatch.setattr(C, "FAN_IN", fan_in)
    monkeypatch.setattr(C, "LEAST_FORESTS", least)
    rng = random.Random(2)
    links = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(170)] + [(None, "n1"), ("hub", "n000")] + [("hub", f"leaf{i}") for i in range(50)] + [(f"path{i:02d}", f"path{i + 1:02d}") for i in range(60)] + [("self", "self"), ("hub", "hub")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a string, b string").repartition(6), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_components_empty(spark):
    assert C.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_splits_keep_groups_and_targets(spark):
    rng = random.Random(4)
    rows = [(f"g{int(rng.paretovariate(0.8)) % 900}", 1) for _ in range(5000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, n int")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = {r.g: r.split for r in C.assign_splits(df, "g", "n", shares).collect()}
    sizes = Counter(r[0] for r in rows if r[0])
    assert set(got) == set(sizes)
    largest = max(sizes.values())
    for s, share in shares.items():
        assert abs(sum(n for g, n in sizes.items() if got[g] == s) - share * 5000) <= largest
    light = {r.g: r.split for r in C.assign_splits(df, "g", "n", shares, heavy_share=0.05, buckets=50).collect()}
    assert set(light) == set(sizes)
    assert C.assign_splits(df.limit(0), "g", "n", shares).count() == 0


# Sampling


def test_sample(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, k string")
    targets = spark.createDataFrame([("a", 5000, 1), ("b", 2500, 1), ("c", 2500, 4000), ("d", 0, 7)], "k string, bp int, least int")
    known = matching(df, targets, ["k"])
    merged = reservoirs(known, "id", ["k"])
    assert size_of(merged) == known.count() and size_of(reservoirs(known.limit(0), "id", ["k"])) == 0
    parts = reservoirs(known.filter("id < 9000"), "id", ["k"]).unionByName(reservoirs(known.filter("id >= 9000"), "id", ["k"])).groupBy("k", "slot").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, merged.collect()))
    report = quota_report(merged, targets, ["k"], "bp", "least", 2000).cache()
    by = {r.k: r for r in report.collect()}
    assert (by["a"].wanted, by["a"].taken, by["b"].taken) == (1000, 1000, 500) and not by["d"].met and by["d"].available == 0
    assert by["d"].shortfall == 7 and by["a"].shortfall == 0
    assert by["c"].wanted == 4000 and by["c"].taken == min(4000, by["c"].available)
    sample = [r.id for r in draw_sample(known, merged, report, "id", ["k"]).collect()]
    assert len(sample) == len(set(sample)) == sum(r.taken for r in by.values())
    again = [r.id for r in draw_sample(known.repartition(7), merged, report, "id", ["k"]).collect()]
    assert sorted(sample) == sorted(again)
    half = sum(i < 10_000 for i in sample) / len(sample)
    assert 0.45 < half < 0.55
    assert draw_sample(known.limit(0), merged, report, "id", ["k"]).count() == 0


# Frequent subsequences


def holds(seq, pattern):
    it = iter(seq)
    return all(s in it for s in pattern)


def brute(seqs, share, shortest, longest):
    sup = Counter()
    for s in seqs:
        sup.update({p for n in range(shortest, longest + 1) for p in combinations(s, n)})
    return {p: n for p, n in sup.items() if n >= share * len(seqs)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=8).map(tuple), min_size=1, max_size=40))
def test_pattern_tree(seqs):
    tree = PatternTree(Counter(seqs))
    want = brute(seqs, 0, 1, 4)
    least = max(1, len(seqs) // 4)
    assert dict(tree.mine(least, 4)) == {p: n for p, n in want.items() if n >= least}
    trie: dict = {}
    for p in list(want)[:20]:
        node = trie
        for s in p:
            node = node.setdefault(s, {})
        node[None] = {}
    assert dict(tree.supports(trie)) == {p: want[p] for p in list(want)[:20]}


@pytest.mark.parametrize("block", [200_000, 7])
def test_frequent_subsequences(spark, monkeypatch, block):
    monkeypatch.setattr(S, "CANDIDATE_BLOCK", block)
    rng = random.Random(8)
    rows = [(f"s{i}", rng.choice(["n", "n", "a", None]), [rng.choice("abcde") if rng.random() > 0.02 else None for _ in range(rng.randrange(9))]) for i in range(900)] + [("x", "rare", ["a", "b", "c"]), ("y", "n", None)]
    df = spark.createDataFrame(rows, "seq string, cls string, steps array<string>")
    got = {}
    for r in frequent_subsequences(df, "seq", "cls", "steps", 0.1, 2, 3, per_share=100).collect():
        got[r.cls, tuple(r.pattern)] = r.support
    want = {}
    for c in ("n", "a", "rare"):
        seqs = [[s for s in (r[2] or []) if s] for r in rows if r[1] == c]
        want |= {(c, p): n for p, n in brute(seqs, 0.1, 2, 3).items()}
    assert got == want
    assert frequent_subsequences(df.limit(0), "seq", "cls", "steps").count() == 0


# Packing


def test_hilbert_is_a_walk():
    """Every cell once, and each step to a neighbouring cell."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 5, 90, 300, 700, 2047, 2048, 2049, 5000, 9 * 2048]) if i % 50 else 0, rng.randrange(1000)) for i in range(5000)] + [(None, 10, 1), (7, 10, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, place long")
    out = packing.pack(df, "doc_id").collect()
    by: dict = {}
    for r in out:
        if r.n_tokens:
            by.setdefault(r.container, []).append((r.offset, r.n_tokens))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(r.n_tokens for r in out) == sum(r[1] for r in rows)
    sizes = Counter({(i, n): 0 for i, n, _ in rows})
    assert {r.doc_id for r in out if r.n_pieces > 1} == {i for (i, n) in sizes if n > 2048}
    assert all(r.n_pieces == 1 and r.container is None for r in out if not r.n_tokens)
    used = sum(r[1] for r in rows) / (len(by) * 2048)
    assert used > 0.95
    assert packing.pack(df.limit(0), "doc_id").count() == 0


def test_containers_hold_neighbours(spark):
    """Texts of a container lie within a few windows of each other along the curve."""
    rng = random.Random(3)
    rows = [(i, int(min(2000, rng.lognormvariate(5.6, 0.8))) + 1, i) for i in range(12_000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, place long"), "doc_id").collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.container, []).append(r.doc_id)
    spans = sorted(max(x) - min(x) for x in by.values() if len(x) > 1)
    chance = sorted(max(x) - min(x) for x in ([rng.randrange(12_000) for _ in range(6)] for _ in range(500)))
    assert spans[len(spans) // 2] <= 0.02 * chance[250] and spans[len(spans) * 9 // 10] <= 0.1 * chance[250]
    assert 1 - sum(r[1] for r in rows) / (len(by) * 2048) <= 0.03


def test_token_slices(spark, monkeypatch):
    with open(packing.DEFAULT_RANKS, "rb") as f:
        enc = packing._encoder(f.read())
    text = "some words of a longer text, 中文也在里面 " * 300
    whole = enc.encode_ordinary(text)
    monkeypatch.setattr(packing, "SLICE", 500)
    assert packing.token_ids(enc, text) == whole
    assert enc.decode(packing.token_ids(enc, "x" * 5000)) == "x" * 5000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id int, text string")
    assert sorted(r.n_tokens for r in packing.curve_places(df, "doc_id", "text").collect()) == [0, 0, 2, 2]


# Leaks

ITEM = "Entry 9404: freckled bursar overnight duplicates tower blueprints smelling of violet ink, on a wager, and this letter must reverse covering notes before the half-blind notary weighs silence against sheet 4544."
ZH = "趁着那座赛艇，幕间果农带走半焚测深图，见9983，但两读者将会权衡严级。不顾一张终端，打赌后译员寄出错放釉料方。"


def shares(spark, texts, items=((1, ITEM), (2, ZH))):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("item_id", F.lit("clash")).withColumn("item", F.lit(0))
    it = spark.createDataFrame([(f"i{i}", p) for i, p in items], "item_id string, passage string").withColumn("doc_id", F.lit(1))
    return {(r.doc_id, r.item_id): r.share for r in winnow.leaked_passages(docs, "doc_id", "text", it, "item_id", "passage").collect()}


def test_leaks_however_written(spark):
    words = ITEM.split()
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)
    texts = [
        f"Memo\n\n{ITEM}\n\nend", ITEM.upper().replace(",", ""), wide, "​".join(ITEM), ITEM.replace("a", "а").replace("e", "е"), "<p>" + ITEM.replace("tower", "<b>to</b>wer") + "</p>", ">> " + "\n>> ".join(words),
        " ".join(words[:20]) + " filler words between the parts " + " ".join(words[20:]), " ".join(words[: len(words) * 3 // 5]), ZH, " ".join(ZH), ZH.encode("unicode_escape").decode(), "&#x41; " + ITEM.replace("ink", "i&#110;k"),
    ]
    found = shares(spark, texts)
    assert set(found) == {(i, "i2" if i in (9, 10, 11) else "i1") for i in range(len(texts))}
    assert all(s > 0.9 for (i, _), s in found.items() if i not in (7, 8))


def test_no_leaks(spark):
    words = ITEM.split()
    assert shares(spark, [" ".join(words[5:13]), "", None, "a", "no such thing " * 5000, " ".join(reversed(words)), " ".join(words[::2])]) == {}
    assert shares(spark, [ITEM], [(1, None), (2, "abc"), (3, "")]) == {}


def test_winnowing_guarantee():
    """Any shared stretch of WINDOW + K - 1 units has a fingerprint on both sides."""
    rng = random.Random(11)
    for _ in range(60):
        span = "".join(rng.choices("abcdefgh", k=winnow.WINDOW + winnow.K - 1))
        prints = []
        for _ in range(2):
            u = winnow.units_of(["".join(rng.choices("abcdefgh", k=rng.randrange(40))) + span + "".join(rng.choices("abcdefgh", k=rng.randrange(40))), "next text"])
            h = winnow.kgram_hashes(u)
            prints.append(set(h[winnow.winnowed(h)].tolist()))
        assert prints[0] & prints[1]


def test_leaks_in_short_stretches(spark, monkeypatch):
    """Whatever chained k-grams find in any pair is found, however few fingerprints the pair shares."""
    rng = random.Random(5)
    lexicon = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(400)]
    passages = [" ".join(rng.choices(lexicon, k=40)) for _ in range(12)]
    texts = []
    for passage in passages:
        words = passage.split()
        for gap in (3, 4, 5, 6):
            texts.append(" ".join("zq%dy" % rng.randrange(10**6) if i % gap == gap - 1 else w for i, w in enumerate(words)))
        texts.append(" ".join(words[i] for i in range(40) if i % 8 < 5) + " tail")
    items = [(i, p) for i, p in enumerate(passages)]
    table = winnow.passages_of([f"i{i}" for i, _ in items], passages, 0.0)
    wanted = {}
    for d, text in enumerate(texts):
        u = winnow.units_of([winnow.plain(text)])
        for i in range(len(passages)):
            if (share := winnow.ordered_share(table, i, winnow.kgram_hashes(u))) >= 0.45:
                wanted[d, f"i{i}"] = share
    assert len(wanted) > 40
    assert shares(spark, texts, items) == pytest.approx(wanted)
    monkeypatch.setattr(winnow, "_PAIRS", 7)
    found = {(d, f"i{i}"): share for d, i, _, share in winnow.scan(winnow.passages_of([str(i) for i, _ in items], passages), texts) if share >= 0.45}
    assert found == pytest.approx(wanted)


def test_no_pair_of_the_tables_is_lost(spark, data):
    """Every pair of a document and a passage, by chaining alone, without any choice of candidates."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text]
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect() if r.passage]
    for least in (0.45, 0.2):
        table = winnow.passages_of([i for i, _ in items], [t for _, t in items], 0.0)
        want = set()
        for doc, text in docs:
            h = winnow.kgram_hashes(winnow.units_of([winnow.plain(text)]))
            own = np.unique(h)
            for n, (item, _) in enumerate(items):
                if np.isin(table.grams[n][0], own, assume_unique=False).any() and winnow.ordered_share(table, n, h) >= least:
                    want.add((doc, item))
        found = winnow.leaked_passages(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{data}/eval_items.parquet"), "item_id", "passage", least)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want


def test_long_chains():
    """A document with thousands of scattered stretches is chained in reasonable time."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    table = winnow.passages_of(["i"], [" ".join(words)], 0.0)
    text = " ".join(f"{a} {b} {c} {rng.randrange(10**9)}" for a, b, c in zip(words[::3], words[1::3], words[2::3]))
    h = winnow.kgram_hashes(winnow.units_of([winnow.plain(text)]))
    assert winnow.ordered_share(table, 0, h) > 0.95


def test_blocks_of_passages(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK_BYTES", 60)
    assert set(shares(spark, [ITEM, ZH])) == {(0, "i1"), (1, "i2")}


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    items = spark.createDataFrame([("i", ITEM)], "item_id string, passage string")
    assert winnow.leaked_passages(none, "doc_id", "text", items, "item_id", "passage").count() == 0
    docs = spark.createDataFrame([(1, ITEM)], "doc_id int, text string")
    assert winnow.leaked_passages(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


# Residue


@pytest.mark.parametrize("text", ["Dear {{name}},", "The <%= site %> filter", "404 Not Found", "Please enable JavaScript to continue.", "blah blah blah blah blah", "您没有权限查看该文档，请联系管理员。", "旧版本的{{日期}}合同草案", "Bitte später erneut versuchen.", "due [TBD: amount] today", "Your session has expired."])
def test_weak_positive(text):
    assert residue.weak_label(text)


@pytest.mark.parametrize("text", ["", "The mail template contains {{doc.title}} and the renderer puts the value there before delivery.", "The training slide shows the message \"Page not found\" as an example.", "Run export HOME_DIR=${HOME}/x before the first scan.", "We opened 404 files on 3 May.", "Access denied was the right answer here, since legal had never asked.", "邮件模板中的{{recipient}}由渲染器在投递前自动替换，已逐一核对。"])
def test_weak_clean(text):
    assert not residue.weak_label(text)


def test_wordings_outside_the_labels(spark, data):
    """Residue that no phrase or seed words this way is found, and clean twins of it are let be."""
    from tests.llm.wordings import CLEAN, RESIDUE

    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = residue.train(docs.select("text", "source"), "text", "source")
    found = {RESIDUE[k] for k, *_ in residue.flagged(model, RESIDUE)}
    wrong = {CLEAN[k] for k, *_ in residue.flagged(model, CLEAN)}
    assert len(found) >= 0.9 * len(RESIDUE), set(RESIDUE) - found
    assert len(found) / (len(found) + len(wrong)) >= 0.9, wrong
    assert model.held_out["precision"] >= 0.9 and model.held_out["recall"] >= 0.9


def test_phrases_decide_nothing_after_training(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = residue.train(docs, "text", "source")
    found = sorted(map(tuple, residue.residue(docs, "doc_id", "text", model).collect()))
    monkeypatch.setattr(residue, "weak_label", None)
    assert sorted(map(tuple, residue.residue(docs, "doc_id", "text", model).collect())) == found


def test_readable():
    assert residue.readable("<p>A <b>w</b>ord</p> of _two_ **bold** __NAME__ a_b\x00\u00ad") == " A word  of two bold __NAME__ a_b "


def test_segments():
    texts = ["First line\nSecond one. Third!", "", "中文。下一句；末", "a" * 300_000]
    s = residue.segments_of(texts)
    joined = "\n".join(texts) + "\n"
    assert [joined[a:b].strip() for a, b in s.spans[:3]] == ["First line", "Second one.", "Third!"]
    assert np.bincount(s.texts, minlength=4).tolist() == [3, 0, 3, 1]
    long = residue.segments_of(["word " * 1000])
    assert len(long.starts) == -(-1000 // residue.LONG_SEGMENT) and long.spans[0, 0] == 0 and long.spans[-1, 1] >= 4999
    assert len(residue.segments_of(["", " \n"]).starts) == 0


def test_classifier_learns_held_out_segments():
    rng = random.Random(1)
    names = ["ledger", "board", "notes", "plan", "site", "depot"]
    clean = [f"The {rng.choice(names)} of the {rng.choice(names)} was read {rng.randrange(90)} times." for _ in range(1500)]
    dirty = [f"The {{{{ {rng.choice(names)} }}}} of the {rng.choice(names)} was read {rng.randrange(90)} times." for _ in range(200)]
    texts = clean + dirty
    y = np.array([False] * 1500 + [True] * 200)
    s = residue.segments_of(texts)
    train = np.random.RandomState(0).rand(len(y)) < 0.5
    w, b = residue.fit(residue._only(s, train), y[train])
    z = residue.scores(residue._only(s, ~train), w, b) > 0
    assert (z == y[~train]).mean() > 0.99


def test_residue_cases(spark):
    texts = [None, "", "  ", "A finished memo about the plan.", "A finished memo about the plan.", "Dear {{name}}, hello.", "\x00{{x}}", "a longer text of many words, " * 30_000]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "wiki", 1) for i, t in enumerate(texts)], "doc_id int, text string, source string, doc int")
    model = residue.train(docs, "text", "source")
    assert {r.doc_id for r in residue.residue(docs, "doc_id", "text", model).collect()} == {5, 6}
    none = residue.train(docs.limit(0), "text", "source")
    assert residue.residue(docs.limit(0), "doc_id", "text", none).count() == 0


def test_pieces_are_the_text():
    t = "line one\n" + "word " * 300_000 + "x" * 1_200_000
    parts, of = residue.pieces_of(["a", t, ""])
    assert "".join(p for p, i in zip(parts, of) if i == 1) == t and max(map(len, parts)) <= residue.PIECE_CHARS and of.tolist() == sorted(of.tolist())


def test_slices_change_nothing(monkeypatch):
    rng = random.Random(12)
    u = winnow.units_of(["".join(rng.choices("abcdefghijk", k=n)) for n in (5, 300, 0, 1000, 13)])
    h = winnow.kgram_hashes(u)
    at = winnow.winnowed(h)
    monkeypatch.setattr(winnow, "_SLICE", 37)
    assert (winnow.kgram_hashes(u) == h).all() and (winnow.winnowed(h) == at).all()
    naive = sorted({j for i in range(-winnow.WINDOW + 1, len(h)) for w in [range(max(0, i), min(len(h), i + winnow.WINDOW))] for j in w if h[j] == min(h[k] for k in w) and h[j] != winnow._NONE})
    assert at.tolist() == naive


def test_residue_select_from_is_no_veto():
    """Only SQL is let go, not any sentence with 'select' and 'from'."""
    assert residue.weak_label("Please select another file from the list, access denied")
    assert not residue.weak_label("SELECT id, count(*) AS n FROM logs WHERE msg = 'page not found'")
