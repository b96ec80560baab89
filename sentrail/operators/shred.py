"""Deeply nested records to related flat tables, by shared inlining over the schema graph.

The schema graph is read from the data: its nodes are element labels (keys in snake case), an edge joins
a label to each label found directly in it. A label gets a table of its own if it is repeated, shared by
several parents, or recursive; every other label is inlined as columns of its nearest ancestor with a
table. Each row holds its parent's table and node as foreign key.

Lists and objects whose keys are all numbers are repetitions; text that is itself a JSON list or object
is read as what it encodes. A label with more than MAX_CHILDREN different keys below it has data for keys:
its keys are no labels, but rows of a table <label>_entry of key and value (nested values as JSON text).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from json import decoder, scanner

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.session import cut

ROOT = "root"
#: Different keys below one label, beyond which they are data and no schema.
MAX_CHILDREN = 500
#: Nesting that is read; deeper payloads are rejected. Python's own calls take no stack here.
MAX_DEPTH = 100_000

_EDGES = "parent string, child string, repeated boolean, nested boolean"
_ROWS = "tab string, source_id long, node int, root_node int, parent_tab string, parent_node int, pos int, record_pos int, cols map<string,string>, under_node int, under_pos int"


@lru_cache(maxsize=100_000)
def snake(key: str) -> str:
    return re.sub(r"[\s\-.]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key.strip())).lower()


class _DeepDecoder(json.JSONDecoder):
    """Reads nesting that the usual decoder refuses, in calls that Python's recursion limit alone bounds."""

    def __init__(self) -> None:
        super().__init__()
        self.parse_object, self.parse_array, self.parse_string = decoder.JSONObject, decoder.JSONArray, decoder.scanstring
        self.scan_once = scanner.py_make_scanner(self)


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        sys.setrecursionlimit(MAX_DEPTH)
        return _DeepDecoder().decode(text)


def _opened(value: object) -> object:
    """Text that encodes a list or object, as that; an object keyed by numbers, as its list in reading order."""
    if isinstance(value, str) and value[:1] in "[{ \n" and value.strip()[:1] in ("[", "{"):
        try:
            value = _loads(value)
        except (ValueError, RecursionError):
            return value
    if isinstance(value, dict) and value and all(k.isdigit() for k in value):
        return list(value.values())
    return value


def parse(payload: object, unwrap: tuple[str, ...]) -> list[dict] | None:
    """The root objects of a payload; None if it isn't complete JSON."""
    if not isinstance(payload, str):
        return None
    try:
        value = _loads(payload)
    except (ValueError, RecursionError):
        return None
    value = _opened(value)
    roots = []
    for r in value if isinstance(value, list) else [value]:
        r = _opened(r)
        while isinstance(r, dict) and (inner := next((r[k] for k in unwrap if isinstance(r.get(k), dict)), None)) is not None:
            r = inner
        if isinstance(r, dict):
            roots.append(r)
    return roots


def _nested(value: object) -> bool:
    """Whether a value is, or encodes, a list or object. Most values are plain and end here."""
    kind = type(value)
    return kind is dict or kind is list or (kind is str and value[:1] in ("[", "{", " ", "\n"))


def _edges(obj: dict, label: str, found: set, keys: dict[str, set[str]]) -> None:
    own = keys.setdefault(label, set())
    if len(own) <= MAX_CHILDREN:
        own.update(obj)
    if len(own) > MAX_CHILDREN:
        found.add((label, entry_of(label), True, False))
        return
    for key, value in obj.items():
        child = snake(key)
        if not _nested(value):
            found.add((label, child, False, False))
            continue
        value = _opened(value)
        repeated = isinstance(value, list)
        for x in value if repeated else [value]:
            x = _opened(x)
            if isinstance(x, list):
                x = {child: x}
            found.add((label, child, repeated, isinstance(x, dict)))
            if isinstance(x, dict):
                _edges(x, child, found, keys)


def entry_of(label: str) -> str:
    """The table of a label whose keys are data."""
    return f"{label}_entry"


def schema_edges(records: DataFrame, source_id: str, payload: str, unwrap: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges of the schema graph. Broken payloads add nothing.

    A label with data for keys has one edge, to its entry table; what lies below those keys has none.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(MAX_DEPTH)
        found, keys = set(), {}
        for pdf in batches:
            for text in pdf[payload]:
                for r in parse(text, unwrap) or []:
                    try:
                        _edges(r, ROOT, found, keys)
                    except RecursionError:
                        continue
        yield pd.DataFrame(sorted(found), columns=["parent", "child", "repeated", "nested"])

    edges = cut(records.select(payload).mapInPandas(read, _EDGES).distinct())
    is_entry = F.col("repeated") & ~F.col("nested") & (F.col("child") == F.concat("parent", F.lit("_entry")))
    many = edges.groupBy("parent").agg(F.countDistinct("child").alias("n"), F.max(is_entry).alias("marked")).filter((F.col("n") > MAX_CHILDREN) | F.col("marked")).select("parent")
    wide = [r[0] for r in many.collect()]
    kept = edges
    if wide:
        kept = kept.filter(~F.col("parent").isin(wide)).unionByName(records.sparkSession.createDataFrame([(w, entry_of(w), True, False) for w in wide], _EDGES))
        n = -1
        while (now := (kept := cut(kept)).count()) != n:  # what hung below the dropped keys alone
            n = now
            live = kept.select(F.col("child").alias("parent")).distinct()
            kept = kept.filter(F.col("parent") == ROOT).unionByName(kept.filter(F.col("parent") != ROOT).join(live, "parent", "left_semi"))
    return kept


@dataclass(frozen=True)
class Mapping:
    """tables: labels with a table of their own; all others are inlined. wide: labels whose keys are data."""

    tables: frozenset[str]
    wide: frozenset[str] = frozenset()


def map_schema(edges: list[tuple[str, str, bool, bool]]) -> Mapping:
    """Which labels get tables: repeated, shared (nested, under several parents) or recursive ones."""
    down: dict[str, set[str]] = {}
    parents: dict[str, set[str]] = {}
    tables, nested = set(), set()
    for parent, child, repeated, is_nested in edges:
        if repeated:
            tables.add(child)
        if is_nested:
            nested.add(child)
            down.setdefault(parent, set()).add(child)
        parents.setdefault(child, set()).add(parent)
    for label in nested:
        seen, todo = set(), [label]
        while todo:
            for nxt in down.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        if label in seen or len(parents[label]) > 1:
            tables.add(label)
    return Mapping(frozenset(tables), frozenset(p for p, c, repeated, is_nested in edges if c == entry_of(p) and repeated and not is_nested))


class _Shredder:
    def __init__(self, mapping: Mapping, keep: dict[str, frozenset[str] | None] | None, source: int, under: str | None = None):
        self.mapping, self.keep, self.source, self.rows, self.under = mapping, keep, source, [], under
        self.nodes, self.counts = 0, {}

    def row(self, tab: str, parent: tuple[str, int] | None, root: int, positions: dict, home: int | None = None) -> tuple[int, dict, dict]:
        node, cols = self.nodes, {}
        self.nodes += 1
        pos = positions.get(tab, 0)
        positions[tab] = pos + 1
        seen = self.counts.get(tab, 0)
        self.counts[tab] = seen + 1
        under_pos = None
        if home is not None:
            under_pos = self.counts.get((tab, home), 0)
            self.counts[tab, home] = under_pos + 1
        if self.keep is None or tab in self.keep:
            self.rows.append((tab, self.source, node, node if root < 0 else root, parent[0] if parent else None, parent[1] if parent else None, pos, seen, cols, home, under_pos))
        return node, cols, {}

    def fill(self, obj: dict, prefix: str, cols: dict, tab: str, node: int, root: int, positions: dict, home: int | None = None) -> None:
        wanted = None if self.keep is None else self.keep.get(tab, frozenset())
        if (label_of := prefix.rstrip(".").rpartition(".")[2] or tab) in self.mapping.wide:
            for key, value in obj.items():
                _, own, _ = self.row(entry_of(label_of), (tab, node), root, positions, home)
                own["key"] = key
                if value is not None:
                    own["value"] = _text(value)
            return
        for key, value in obj.items():
            label = snake(key)
            table = label in self.mapping.tables
            if not table and not _nested(value):
                if value is not None and (wanted is None or prefix + label in wanted):
                    self.put(cols, prefix + label, value)
                continue
            value = _opened(value)
            if table:
                for x in value if isinstance(value, list) else [value]:
                    x = _opened(x)
                    if x is None:
                        continue
                    if isinstance(x, list):
                        x = {key: x}
                    child, own, below = self.row(label, (tab, node), root, positions, home)
                    if isinstance(x, dict):
                        self.fill(x, "", own, label, child, root, below, child if label == self.under else home)
                    else:
                        own["value"] = _text(x)
            elif isinstance(value, dict):
                self.fill(value, f"{prefix}{label}.", cols, tab, node, root, positions, home)
            elif value is not None and (wanted is None or prefix + label in wanted):
                self.put(cols, prefix + label, value)

    @staticmethod
    def put(cols: dict, name: str, value: object) -> None:
        """Keys of one object that are spelt alike keep their values: the first as name, then name#2 and so on."""
        own, n = name, 1
        while own in cols:
            n += 1
            own = f"{name}#{n}"
        cols[own] = _text(value)


def _text(x: object) -> str:
    try:
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    except RecursionError:
        return "".join(json.encoder._make_iterencode(None, json.JSONEncoder().default, json.encoder.encode_basestring, None, float.__repr__, ": ", ", ", False, False, False)(x, 0))


def shred(records: DataFrame, source_id: str, payload: str, mapping: Mapping, unwrap: tuple[str, ...] = (), keep: dict[str, tuple[str, ...] | None] | None = None, under: str | None = None) -> DataFrame:
    """All rows of all tables in one pass, told apart by `tab`.

    node numbers a record's elements in reading order; (source_id, node) is the key, (source_id,
    parent_node) in parent_tab the foreign key, root_node the top row. pos counts a table's rows under
    one parent, record_pos those in the record, from 0. cols holds the inlined columns by path. Payloads
    that are null or not complete JSON give one row of table '_rejected'; a null source_id is kept.
    keep limits the tables that are returned, and with names their columns; all is read all the same.
    under_node is the nearest ancestor in table `under`, whatever tables lie between, and under_pos counts
    a table's rows below it; null without one.
    """
    kept = {k: None if v is None else frozenset(v) for k, v in keep.items()} if keep is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(MAX_DEPTH)
        names = [c.split()[0] for c in _ROWS.replace("map<string,string>", "map").split(", ")]
        for pdf in batches:
            out = []
            for source, text in zip(pdf["source_id"], pdf["payload"]):
                roots, s = parse(text, unwrap), _Shredder(mapping, kept, None if pd.isna(source) else int(source), under)
                try:
                    positions: dict = {}
                    for r in roots or []:
                        node, cols, below = s.row(ROOT, None, -1, positions)
                        s.fill(r, "", cols, ROOT, node, node, below)
                except RecursionError:
                    roots, s.rows = None, []
                if roots is None and (kept is None or "_rejected" in kept):
                    s.rows.append(("_rejected", s.source, 0, 0, None, None, 0, 0, {"reason": "null" if text is None else "not complete JSON"}, None, None))
                out += s.rows
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("under_node", "under_pos")})
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("under_node", "under_pos")})

    return records.select(F.col(source_id).cast("long").alias("source_id"), F.col(payload).cast("string").alias("payload")).mapInPandas(run, _ROWS)


def read_mapping(records: DataFrame, source_id: str, payload: str, unwrap: tuple[str, ...] = ()) -> Mapping:
    """The mapping of these records' own schema graph; only the graph's edges reach the driver.

    A label has at most MAX_CHILDREN edges, so they are as many as the schema, not the data, has.
    """
    return map_schema([tuple(e) for e in schema_edges(records, source_id, payload, unwrap).collect()])
