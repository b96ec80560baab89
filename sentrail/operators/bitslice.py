"""Per-entity feature cells from events: bit-sliced counters over entity ordinals.

For each feature cell (event type x level) and each block of 65,536 entity ordinals a counter is held
as bit planes: plane j is the compressed bitmap of the ordinals whose count has bit j set. Partial
counters of different partitions are added by carry (xor for the sum, majority for the carry), totals
of a measure likewise; the latest times lie in arrays aligned to the bitmap of present ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
#: Events gathered in one Python worker before their partial counters are sent on.
FLUSH_ROWS = 1_000_000

_PARTIAL = "cell int, block int, counts binary, totals binary, present binary, latest binary"


def pack(ids: np.ndarray) -> bytes:
    """A bitmap of sorted ids below 65,536: as a list of numbers, or as words up to the last set bit."""
    if not len(ids):
        return b""
    words = (int(ids[-1]) >> 3) + 1
    if len(ids) * 2 < words:
        return b"\x00" + ids.astype("<u2").tobytes()
    bits = np.zeros(words * 8, np.uint8)
    bits[ids] = 1
    return b"\x01" + np.packbits(bits, bitorder="little").tobytes()


def dense(raw: bytes, size: int = 0) -> np.ndarray:
    """The bitmap as bytes of bits, at least `size` long."""
    if not raw:
        return np.zeros(size, np.uint8)
    if raw[0] == 1:
        bits = np.frombuffer(raw, np.uint8, offset=1)
        return bits if len(bits) >= size else np.pad(bits, (0, size - len(bits)))
    ids = np.frombuffer(raw, "<u2", offset=1)
    bits = np.zeros(max(size, (int(ids[-1]) >> 3) + 1) * 8, np.uint8)
    bits[ids] = 1
    return np.packbits(bits, bitorder="little")


def members(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits, bitorder="little"))


def slices(ids: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Bit planes of non-negative numbers held at ids."""
    size = (int(ids[-1]) >> 3) + 1
    return [dense(pack(ids[(values >> j) & 1 == 1]), size) for j in range(int(values.max()).bit_length())]


def carry_add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced counters, plane by plane with carry."""
    size = max([len(p) for p in a + b], default=0)
    grow = lambda p: p if len(p) == size else np.pad(p, (0, size - len(p)))
    zero, out = np.zeros(size, np.uint8), []
    carry = zero
    for j in range(max(len(a), len(b))):
        x = grow(a[j]) if j < len(a) else zero
        y = grow(b[j]) if j < len(b) else zero
        half = x ^ y
        out.append(half ^ carry)
        carry = (x & y) | (half & carry)
    if carry.any():
        out.append(carry)
    return out


def decode(planes: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    value = np.zeros(len(ids), np.int64)
    for j, p in enumerate(planes):
        bits = np.unpackbits(p, bitorder="little")
        inside = ids < len(bits)
        value[inside] += bits[ids[inside]].astype(np.int64) << j
    return value


def _dump(planes: list[np.ndarray]) -> bytes:
    packed = [pack(members(p)) for p in planes]
    return b"".join(len(p).to_bytes(4, "little") + p for p in packed)


def _load(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(dense(bytes(raw[at + 4 : at + 4 + n])))
        at += 4 + n
    return out


def _partials(pdf: pd.DataFrame) -> pd.DataFrame:
    cell = pdf["cell"].to_numpy(np.int64)
    ordinal = pdf["ordinal"].to_numpy(np.int64)
    ts, measure = pdf["ts"].to_numpy(np.int64), pdf["measure"].to_numpy(np.int64)
    key = (cell << 40) | ordinal
    order = np.argsort(key, kind="stable")
    key, ts, measure = key[order], ts[order], measure[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts, totals, latest = np.diff(np.r_[first, len(key)]), np.add.reduceat(measure, first), np.maximum.reduceat(ts, first)
    key = key[first]
    group = key >> BLOCK_BITS
    ids = key & ((1 << BLOCK_BITS) - 1)
    edges = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        own, total = ids[lo:hi], totals[lo:hi]
        rows.append((group[lo] >> (40 - BLOCK_BITS), group[lo] & ((1 << (40 - BLOCK_BITS)) - 1), _dump(slices(own, counts[lo:hi])), _dump(slices(own, total)) if total.any() else b"", pack(own), latest[lo:hi].tobytes()))
    return pd.DataFrame(rows, columns=["cell", "block", "counts", "totals", "present", "latest"])


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= FLUSH_ROWS:
            yield _partials(pd.concat(held))
            held, n = [], 0
    if n:
        yield _partials(pd.concat(held))


def _decoded(cell: int, block: int, counts, totals, present, latest) -> pd.DataFrame:
    ids = members(present)
    return pd.DataFrame({"cell": cell, "ordinal": ids + (int(block) << BLOCK_BITS), "n_events": decode(counts, ids), "total": decode(totals, ids), "last_seen": latest})


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell and block; each counter is decoded when its last partial has been added."""
    at, state = None, None
    out, n = [], 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            counts, totals, present = _load(row.counts), _load(row.totals), dense(row.present)
            latest = np.frombuffer(row.latest, np.int64)
            if at == (row.cell, row.block):
                size = max(len(present), len(state[2]))
                both = np.pad(state[2], (0, size - len(state[2]))) | np.pad(present, (0, size - len(present)))
                slots = members(both)
                newest = np.full(len(slots), np.iinfo(np.int64).min)
                newest[np.searchsorted(slots, members(state[2]))] = state[3]
                mine = np.searchsorted(slots, members(present))
                newest[mine] = np.maximum(newest[mine], latest)
                state = (carry_add(state[0], counts), carry_add(state[1], totals), both, newest)
                continue
            if at is not None:
                out.append(_decoded(*at, *state))
                n += len(out[-1])
            at, state = (row.cell, row.block), (counts, totals, present, latest)
            if n >= 50_000:
                yield pd.concat(out)
                out, n = [], 0
    if at is not None:
        out.append(_decoded(*at, *state))
    if out:
        yield pd.concat(out)


def entity_cells(events: DataFrame) -> DataFrame:
    """Counts, totals and latest times per (ordinal, cell) by bit-sliced counters.

    events: ordinal long (0..2^40), cell int, ts long, measure long >= 0, none of them null (rows with a
    null are dropped). Returns cell, ordinal, n_events, total, last_seen; empty in, empty out. The shuffle
    carries compressed partial counters, so a hot entity or type costs no more than any other.
    """
    clean = events.select("cell", "ordinal", "ts", "measure").dropna()
    partial = clean.mapInPandas(_build, _PARTIAL)
    return partial.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInPandas(_merge, "cell int, ordinal long, n_events long, total long, last_seen long")
