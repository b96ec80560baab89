"""Held-out passages inside a training corpus, by winnowed fingerprints and extended hits.

Texts are reduced to their letters and digits: encodings (JSON escapes, entities, percent signs), tags,
width, case, ligatures, look-alike letters, invisible marks, line breaks and punctuation don't count. A
CJK character weighs as four units, so one k serves all scripts. Of every window of `WINDOW` k-grams the
smallest hash is kept, on both sides, so any shared stretch of WINDOW + K - 1 units shares a fingerprint;
these are counted for the report. Shorter stretches may share none, so what is extended doesn't hang on
them: a pair is left out only if all the k-grams it shares cover fewer units of the passage than
the shortest words that make up the wanted share. In all others stretches of equal k-grams are chained in the
passage's order, and the share of the passage's words inside the chain is the result.

All work on a batch of documents is array arithmetic over its code units; documents are never cut.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a k-gram (12 letters or 3 CJK characters), k-grams in a window.
K, WINDOW = 12, 8
CJK_UNITS = 4
#: Bytes of passages whose tables one broadcast holds (about 50 times as much); more are taken in blocks.
BLOCK_BYTES = 2_000_000
_CHUNK_UNITS = 250_000
#: Positions hashed at a time, so that a very long text needs no more memory than many short ones.
_SLICE = 1_000_000
#: Pairs of a document's k-gram and a place of it in a passage that are held at a time (one document may go beyond).
_PAIRS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = dict(zip("аеорсухіѕјһԁԛԝкмтвнαορνικ", "aeopcyxisjhdqwkmtbhaopvik"))
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2}){2,}|\w%20\w")
_ENTITY = re.compile(r"&[#a-zA-Z0-9]{1,10};")


def plain(text: str) -> str:
    """The text with encodings undone, width and case folded. Cheap tests guard each rarer step."""
    if "\\" in text:
        if "\\u" in text:
            text = _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = text.replace("\\n", "\n").replace("\\t", " ").replace('\\"', '"')
    if "%" in text and _PERCENT.search(text):
        text = unquote(text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


@lru_cache(maxsize=1)
def _unit_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point (below 65,536) to unit code, 0 for what is dropped; and how many units it weighs."""
    points = [chr(c) for c in range(0x10000)]
    keep = np.array([p.isalnum() for p in points])
    keep[0xD800:0xE000] = False
    unit = np.where(keep, np.arange(0x10000), 0).astype(np.uint16)
    for seen, latin in _LOOKALIKE.items():
        unit[ord(seen)] = ord(latin)
    weight = np.ones(0x10000, np.uint8)
    for lo, hi in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0), (0xF900, 0xFB00)):
        weight[lo:hi] = CJK_UNITS
    return unit, weight


@dataclass
class Units:
    """Units of several texts in a row: text i has units[starts[i]:starts[i + 1]]."""

    units: np.ndarray
    starts: np.ndarray


def units_of(texts: list[str]) -> Units:
    unit, weight = _unit_table()
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() > 0xFFFF:
        points = np.where(points > 0xFFFF, 0x4E00 + (points & 0x3FFF), points)
    codes = unit[points]
    kept = codes != 0
    ends = np.cumsum([len(t) for t in texts])
    reps = np.where(kept, weight[points], 0) if not joined.isascii() else kept
    total = np.r_[0, np.cumsum(reps, dtype=np.int64)]
    starts = total[np.r_[0, ends].astype(np.int64)]
    if joined.isascii():
        return Units(codes[kept], starts)
    return Units(np.repeat(codes, reps), starts)


def _hashes(units: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        b2 = _BASE * _BASE
        b4 = b2 * b2
        n = len(units) - K + 1
        h1 = units.astype(np.uint64) + np.uint64(1)
        h2 = h1[:-1] + h1[1:] * _BASE
        h4 = h2[:-2] + h2[2:] * b2
        h8 = h4[:-4] + h4[4:] * b4
        h = h8[:n] + h4[8 : 8 + n] * (b4 * b4)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def kgram_hashes(u: Units) -> np.ndarray:
    """Hash of the K units from each position on; _NONE where they would cross a text's end."""
    n = len(u.units)
    out = np.full(n, _NONE, np.uint64)
    for lo in range(0, n - K + 1, _SLICE):
        part = u.units[lo : lo + _SLICE + K - 1]
        out[lo : lo + len(part) - K + 1] = _hashes(part)
    for end in u.starts[1:]:
        out[max(0, end - K + 1) : end] = _NONE
    return out


def _slid(f: np.ufunc, x: np.ndarray) -> np.ndarray:
    """f over every WINDOW neighbours (a power of two)."""
    width = 1
    while width < WINDOW:
        x = f(x[:-width], x[width:])
        width *= 2
    return x


def winnowed(h: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest hash of some window of WINDOW positions (ties: all of them)."""
    edge = np.full(WINDOW - 1, _NONE)
    found = []
    for lo in range(0, len(h), _SLICE):
        a, b = max(0, lo - WINDOW + 1), min(len(h), lo + _SLICE + WINDOW - 1)
        own = h[a:b]
        high = _slid(np.maximum, _slid(np.minimum, np.r_[edge, own, edge]))[: len(own)]
        at = np.flatnonzero((own == high) & (own != _NONE)) + a
        found.append(at[(at >= lo) & (at < lo + _SLICE)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass
class Passages:
    """K-gram positions of a block of passages, and its distinct k-grams.

    k-gram keys[i] stands at places[j] of the joined passages, in passage owners[j], for j from firsts[i]
    to firsts[i + 1]; prints[j] is set once for each passage of which it is a fingerprint. needed: units
    of each passage without which the share can't be reached.
    """

    ids: list[str]
    units: list[np.ndarray]
    words: list[np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]
    keys: np.ndarray
    firsts: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    prints: np.ndarray
    needed: np.ndarray
    sieve: np.ndarray
    shift: np.uint64


_WORD = re.compile(r"[\w]+(?:[-'’][\w]+)*")


def _word_numbers(text: str) -> np.ndarray:
    """For each unit of the text the number of its word; every CJK character is a word."""
    unit, weight = _unit_table()
    out, no = [], -1
    for m in _WORD.finditer(text):
        fresh = True
        for ch in m.group():
            c = ord(ch) if ord(ch) <= 0xFFFF else 0x4E00 + (ord(ch) & 0x3FFF)
            if not unit[c]:
                continue
            if weight[c] > 1:
                no, fresh = no + 1, True
            elif fresh:
                no, fresh = no + 1, False
            out += [no] * int(weight[c])
    return np.array(out, np.int32)


def _needed(numbers: np.ndarray, least_share: float) -> int:
    """Units that least_share of the words have at the very least: those of the shortest words."""
    sizes = np.sort(np.bincount(numbers)) if len(numbers) else np.empty(0, np.int64)
    n = int(np.ceil(least_share * len(sizes) - 1e-9))
    return int(sizes[:n].sum())


def passages_of(ids: list[str], texts: list[str], least_share: float = 0.45) -> Passages:
    clean = [plain(t) for t in texts]
    u = units_of(clean)
    h = kgram_hashes(u)
    is_print = np.zeros(len(h), bool)
    is_print[winnowed(h)] = True
    grams, words, own = [], [], []
    for i, text in enumerate(clean):
        lo, hi = u.starts[i], u.starts[i + 1]
        hashes = h[lo:hi]
        valid = np.flatnonzero(hashes != _NONE)
        order = valid[np.argsort(hashes[valid], kind="stable")]
        grams.append((hashes[order], order.astype(np.int32)))
        numbers = _word_numbers(text)
        words.append(numbers if len(numbers) == hi - lo else np.arange(hi - lo, dtype=np.int32))
        own.append(u.units[lo:hi])
    at = np.flatnonzero(h != _NONE)
    at = at[np.argsort(h[at], kind="stable")]
    owner = np.searchsorted(u.starts, at, "right") - 1
    keys, firsts = np.unique(h[at], return_index=True)
    prints = np.zeros(len(at), bool)
    if len(at):
        fresh = np.flatnonzero(np.r_[True, (h[at][1:] != h[at][:-1]) | (owner[1:] != owner[:-1])])
        prints[fresh] = np.logical_or.reduceat(is_print[at], fresh)
    bits = min(24, max(16, int(8 * len(keys)).bit_length()))
    shift, sieve = np.uint64(64 - bits), np.zeros(1 << bits, bool)
    sieve[(keys >> shift).astype(np.int64)] = True
    needed = np.array([_needed(w, least_share) for w in words], np.int64)
    return Passages(ids, own, words, grams, keys, np.r_[firsts, len(at)], owner, at, prints, needed, sieve, shift)


def ordered_share(p: Passages, item: int, doc: np.ndarray) -> float:
    """Share of the passage's words inside stretches of equal k-grams, chained in the passage's order."""
    hashes, places = p.grams[item]
    if not len(hashes):
        return 0.0
    lo = np.searchsorted(hashes, doc)
    lo[lo == len(hashes)] = 0
    hit = np.flatnonzero(hashes[lo] == doc)
    if not len(hit):
        return 0.0
    # Where a k-gram stands at several places of the passage, the one that goes on from the previous hit.
    place = places[lo[hit]]
    starts = [0]
    for i in range(1, len(hit)):
        if hit[i] == hit[i - 1] + 1 and place[i] != place[i - 1] + 1:
            k, want = lo[hit[i]], place[i - 1] + 1
            while k < len(hashes) and hashes[k] == doc[hit[i]]:
                if places[k] == want:
                    place[i] = want
                    break
                k += 1
        if hit[i] != hit[i - 1] + 1 or place[i] != place[i - 1] + 1:
            starts.append(i)
    ends = [*starts[1:], len(hit)]
    blocks = [(int(place[a]), int(place[b - 1]) + K) for a, b in zip(starts, ends)]
    # The chain that covers most units of the passage: each block after the best one that ends in its order.
    a, b = np.array(blocks, np.int64).T
    gains, back = b - a, np.full(len(a), -1, np.int64)
    for i in range(1, len(a)):
        fits = (a[:i] <= a[i]) & (b[:i] <= b[i])
        reached = np.where(fits, gains[:i] + b[i] - np.maximum(a[i], b[:i]), 0)
        if reached[j := int(reached.argmax())] > gains[i]:
            gains[i], back[i] = reached[j], j
    i = int(gains.argmax())
    covered = np.zeros(len(p.words[item]), bool)
    while i >= 0:
        covered[blocks[i][0] : blocks[i][1]] = True
        i = int(back[i])
    numbers = p.words[item]
    n_words = int(numbers[-1]) + 1
    missing = np.unique(numbers[~covered])
    return 1 - len(missing) / n_words


def scan(p: Passages, texts: list[str]) -> Iterator[tuple[int, int, int, float]]:
    """(text number, passage number, shared fingerprints, share of its words) of each extended hit."""
    clean = [plain(t) for t in texts]
    first, size = 0, 0
    for i, t in enumerate(clean):
        size += len(t)
        if size >= _CHUNK_UNITS or i == len(clean) - 1:
            yield from _scan_chunk(p, clean[first : i + 1], first)
            first, size = i + 1, 0


def _scan_chunk(p: Passages, clean: list[str], offset: int) -> Iterator[tuple[int, int, int, float]]:
    u = units_of(clean)
    h = kgram_hashes(u)
    at = np.flatnonzero(p.sieve[(h >> p.shift).astype(np.int64)] & (h != _NONE))
    if not len(at) or not len(p.keys):
        return
    key = np.searchsorted(p.keys, h[at])
    key[key == len(p.keys)] = 0
    same = p.keys[key] == h[at]
    at, key = at[same], key[same]
    is_print = np.zeros(len(h), bool)
    is_print[winnowed(h)] = True
    # Distinct k-grams per document, then the passages that hold them.
    code = (np.searchsorted(u.starts, at, "right") - 1).astype(np.int64) * len(p.keys) + key
    seen = np.unique(code)
    chosen = np.isin(seen, code[is_print[at]])
    doc, key = seen // len(p.keys), seen % len(p.keys)
    sizes = p.firsts[key + 1] - p.firsts[key]
    ends, lo = np.cumsum(sizes), 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        if hi < len(doc):  # whole documents
            first = int(np.searchsorted(doc, doc[hi]))
            hi = first if first > lo else int(np.searchsorted(doc, doc[lo], "right"))
        n = sizes[lo:hi]
        k = np.repeat(p.firsts[key[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        hit = np.repeat(doc[lo:hi], n) * len(p.ids) + p.owners[k]
        order = np.lexsort((p.places[k], hit))
        hit, k = hit[order], k[order]
        firsts = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]])
        gain = np.minimum(K, np.diff(p.places[k], append=0))
        gain[np.r_[firsts[1:], len(hit)] - 1] = K
        pair, covered = hit[firsts], np.add.reduceat(gain, firsts)
        shared = np.add.reduceat((p.prints[k] & np.repeat(chosen[lo:hi], n)[order]).astype(np.int64), firsts)
        item = pair % len(p.ids)
        strong = covered >= p.needed[item]
        for q, i, s in zip(pair[strong].tolist(), item[strong].tolist(), shared[strong].tolist()):
            d = q // len(p.ids)
            yield offset + d, i, s, ordered_share(p, i, h[u.starts[d] : u.starts[d + 1]])
        lo = hi


def leaked_passages(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least_share: float = 0.45) -> DataFrame:
    """doc_id, item_id, shared_prints, share: documents that hold at least least_share of a passage's words.

    Null ids, texts and passages match nothing; a passage of fewer than K units has no fingerprint and is
    never found; copies of a document or passage each give their own rows (items of one id and text
    count once). Empty in, empty out. The passages are the query set: they are read in blocks of about
    BLOCK_BYTES, each broadcast once and held against all documents. No text goes through a shuffle.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id).cast("string").alias("i"), F.col(passage).alias("p")).dropna().distinct()
    size = wanted.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).dropna()
    kind = dict(docs.dtypes)["_doc"]
    schema = f"doc {kind}, item string, shared_prints int, share double"
    results = []
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("i", "p"), F.lit(blocks)) == block)
        rows = sorted(part.collect())
        table = spark.sparkContext.broadcast(pickle.dumps(passages_of([r[0] for r in rows], [r[1] for r in rows], least_share)))

        def run(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            p = pickle.loads(table.value)
            for pdf in batches:
                ids = pdf["_doc"].tolist()
                found = [(ids[d], p.ids[i], s, share) for d, i, s, share in scan(p, pdf["_text"].tolist()) if share >= least_share]
                if found:
                    yield pd.DataFrame(found, columns=["doc", "item", "shared_prints", "share"])

        results.append(docs.mapInPandas(run, schema))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    best = out.groupBy("doc", "item").agg(F.max("shared_prints").alias("shared_prints"), F.max("share").alias("share"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "shared_prints", "share")
