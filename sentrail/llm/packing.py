"""Texts into containers of fixed capacity, neighbours in meaning first.

Each text is measured in tokens of a public tokenizer and its hashed token vector is projected to three
dimensions; the cell of the point has a place on a Hilbert curve. Texts are range-sorted by that place
and packed along the curve: a window of neighbours is placed longest first, each into the open container
that it fills best, and containers close once the curve has moved on. Only a text longer than a container
is split, into full containers and a rest.
"""

from __future__ import annotations

import base64
import bisect
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.session import cut

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern that belongs to the rank files (published with the GPT-2 vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DIMENSIONS, BITS = 3, 10
#: Texts are tokenized in slices of at most so many characters, cut before a blank where there is one.
SLICE = 200_000
#: Neighbours along the curve that are placed together, longest first.
WINDOW = 64
#: Passes along the curve: a container is closed when the curve has moved on by so many texts; one that is
#: filled by less than this share is emptied again into the next pass, which reaches further.
PASSES = ((64, 0.97), (512, 0.95), (4096, 0.0))
#: Rows of one packing task; the number of tasks follows from the number of texts.
ROWS_PER_TASK = 200_000

_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    """The tokenizer of a rank file, built once per Python process."""
    key = hash(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_ids(encoder, text: str) -> list[int]:
    """All tokens of a text; long ones slice by slice, so no text is too long for the tokenizer."""
    if len(text) <= SLICE:
        return encoder.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            blank = text.rfind(" ", at + 1, end)
            end = blank if blank > at + SLICE // 2 else end
        out += encoder.encode_ordinary(text[at:end])
        at = end
    return out


def _axes(n: int) -> np.ndarray:
    """Per token id three numbers of mean 0 and variance 1, from a hash of the id."""
    x = np.arange(n * DIMENSIONS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5).reshape(n, DIMENSIONS) * np.sqrt(12)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of cells (n x d, each below 2**bits), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_places(documents: DataFrame, doc_id: str, text: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """doc_id, n_tokens, place: token count and Hilbert key of each text. Null texts have 0 tokens."""
    spark = documents.sparkSession
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, axes = _encoder(raw.value), None
        for pdf in batches:
            sizes, points = [], []
            for t in pdf["text"]:
                ids = token_ids(encoder, t) if isinstance(t, str) else []
                sizes.append(len(ids))
                if axes is None:
                    axes = _axes(encoder.n_vocab)
                if ids:
                    distinct = np.unique(np.array(ids))
                    points.append(axes[distinct].sum(axis=0) / np.sqrt(len(distinct)))
                else:
                    points.append(np.zeros(DIMENSIONS))
            z = np.array(points).reshape(len(points), DIMENSIONS)
            cells = np.clip((1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            yield pd.DataFrame({"doc": pdf["doc"], "n_tokens": sizes, "place": hilbert(cells)})

    return docs.mapInPandas(run, f"doc {dict(docs.dtypes)['doc']}, n_tokens long, place long").withColumnRenamed("doc", doc_id)


@dataclass
class _Piece:
    at: int  # place in the curve's order
    doc: object
    size: int
    no: int
    of: int
    start: int


class _Open:
    """Open containers, best fit; one is handed on when it is full or the curve has moved on by `reach` texts."""

    def __init__(self, capacity: int, reach: int, done: Callable[[list[_Piece], int], None]):
        self.capacity, self.reach, self.done = capacity, reach, done
        self.free: list[tuple[int, int]] = []  # free tokens, container
        self.held: dict[int, tuple[int, list[_Piece]]] = {}
        self.opened: deque[tuple[int, int]] = deque()
        self.count = 0

    def place(self, pieces: list[_Piece], at: int) -> None:
        """Pieces of a window that begins at the place `at`, longest first."""
        while self.opened and at - self.opened[0][0] > self.reach:
            self._close(self.opened.popleft()[1])
        for piece in sorted(pieces, key=lambda p: -p.size):
            i = bisect.bisect_left(self.free, (piece.size, -1))
            if i < len(self.free):
                free, k = self.free.pop(i)
                inside = self.held[k][1]
            else:
                free, k, inside = self.capacity, self.count, []
                self.count += 1
                self.opened.append((at, k))
            inside.append(piece)
            free -= piece.size
            self.held[k] = free, inside
            bisect.insort(self.free, (free, k))
            if not free:
                self._close(k)

    def _close(self, k: int) -> None:
        if k in self.held:
            free, inside = self.held.pop(k)
            self.free.pop(bisect.bisect_left(self.free, (free, k)))
            self.done(inside, free)

    def end(self) -> None:
        for k in list(self.held):
            self._close(k)


class _Packer:
    """Passes along the curve (PASSES): what a pass can't fill well goes on, in the curve's order, to the next."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.rows = capacity, base, []
        self.passes = [_Open(capacity, reach, partial(self._closed, i)) for i, (reach, _) in enumerate(PASSES)]
        self.waiting: list[list[_Piece]] = [[] for _ in PASSES]

    def _closed(self, i: int, pieces: list[_Piece], free: int) -> None:
        if i + 1 < len(PASSES) and free > (1 - PASSES[i][1]) * self.capacity:
            self.waiting[i + 1] += pieces
            return
        at = 0
        for p in sorted(pieces, key=lambda p: (p.at, p.no)):
            self.rows.append((p.doc, p.no, p.of, p.start, p.size, self.next, at))
            at += p.size
        self.next += 1

    def _feed(self, least: int) -> None:
        for open_, waiting in zip(self.passes, self.waiting):
            if len(waiting) >= least:
                window = sorted(waiting, key=lambda p: p.at)
                waiting.clear()
                for lo in range(0, len(window), WINDOW):
                    open_.place(window[lo : lo + WINDOW], window[lo].at)

    def add(self, at: int, doc: object, size: int) -> None:
        if not size:
            self.rows.append((doc, 0, 1, 0, 0, None, None))
            return
        whole, rest = divmod(size, self.capacity)
        pieces = whole + (rest > 0)
        for no in range(whole):
            self.rows.append((doc, no, pieces, no * self.capacity, self.capacity, self.next, 0))
            self.next += 1
        if rest:
            self.waiting[0].append(_Piece(at, doc, rest, whole, pieces, whole * self.capacity))
            self._feed(WINDOW)

    def end(self) -> None:
        for open_ in self.passes:
            self._feed(1)
            open_.end()

    def taken(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=["doc", "piece_no", "n_pieces", "start_token", "n_tokens", "container", "offset"])
        self.rows = []
        return out.astype({"container": "Int64", "offset": "Int32"})


def pack(places: DataFrame, doc_id: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece_no, n_pieces, start_token, n_tokens, container, offset: every token in one container.

    places: doc_id, n_tokens, place. Texts of one container lie near each other on the curve (PASSES). Rows
    of 0 tokens (null or empty texts) come back once with a null container; repeated doc_ids are packed each
    for itself; null doc_ids and ties of place are packed like any other. Empty in, empty out. Containers
    are numbered within tasks of about ROWS_PER_TASK texts, so no task's share grows with the input.
    """
    rows = cut(places.select(F.col(doc_id).alias("doc"), "n_tokens", "place"))
    tasks = max(1, -(-rows.count() // ROWS_PER_TASK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, at = _Packer(capacity, TaskContext.get().partitionId() << 40), 0
        for pdf in batches:
            for doc, size in zip(pdf["doc"].tolist(), pdf["n_tokens"].tolist()):
                packer.add(at, doc, size)
                at += 1
            yield packer.taken()
        packer.end()
        yield packer.taken()

    schema = f"doc {dict(rows.dtypes)['doc']}, piece_no int, n_pieces int, start_token long, n_tokens long, container long, offset int"
    ordered = rows.repartitionByRange(tasks, "place", "doc").sortWithinPartitions("place", "doc")
    return ordered.mapInPandas(run, schema).withColumnRenamed("doc", doc_id)
