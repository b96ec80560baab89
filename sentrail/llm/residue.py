"""Template residue, filler and error pages, by a linear classifier over hashed n-grams of segments.

A text is read as segments (sentences and lines). A segment's features are its hashed word 1- to 3-grams,
whether a word repeats the one before, its shapes, its length, and its place (first segment of the text,
segment of a short text). Weak labels come from status lines, phrases in general use and placeholder
notations (residue_labels.py); a logistic regression with L2 penalty is fitted on a bounded sample and on
seeds, its threshold chosen and the decision validated on sources that it has not seen. The classifier
alone decides. Scoring is array arithmetic over whole batches: token hashes by prefix sums, n-gram weights
by one table lookup, segment sums by one reduction.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrail.llm.residue_labels import seeds, weak_label
from sentrail.session import cut

TABLE_BITS = 21
#: Texts that are labelled for the fit, at most: half of them at random, half of those that hold a cue.
SAMPLE_TEXTS = 4000
#: Longer texts are scored like any other, but not fitted on, so the sample is bounded in bytes too.
SAMPLE_CHARS = 20_000
#: Of the clean segments that hold no cue of residue about so many are fitted on, and into so many a placeholder is set.
CLEAN_SEGMENTS, PLANTED_SEGMENTS = 30_000, 8_000
EPOCHS, RATE, PENALTY = 64, 0.15, 1e-6
#: Features of fewer segments have no weight: they would only learn single sentences by heart.
LEAST_SEEN = 3
#: A label is dropped as noise if the first fit contradicts it by this many log odds.
NOISE = 2.0
#: Thresholds (log odds) among which held-out sources choose: the highest whose F1 is so near to the best. The
#: sample holds residue more often than the corpus, so at equal F1 the higher one makes fewer errors there.
THRESHOLDS, NEAR_BEST = tuple(x / 4 for x in range(-8, 13)), 0.001
SHORT_TEXT_TOKENS = 60
_CHUNK_POINTS = 250_000
FEATURES = 6  # per token
LONG_SEGMENT = 150
PIECE_CHARS = 500_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 blank, 1 letter, 2 digit, 3 CJK letter, 4 mark, per code point."""
    out = np.full(0x10000, 4, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace() or unicodedata.category(ch) in ("Cc", "Cf"):
            out[c] = 0
        elif ch.isdigit():
            out[c] = 2
        elif ch.isalpha():
            out[c] = 1
    for lo, hi in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0), (0xF900, 0xFB00)):
        out[lo:hi] = 3
    return out


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@dataclass
class Segments:
    """n-gram slots of all segments of some texts in a row."""

    slots: np.ndarray  # table slot of each feature
    starts: np.ndarray  # first feature of each segment
    texts: np.ndarray  # text number of each segment
    spans: np.ndarray  # first and last code point of each segment


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_ENDERS = np.array([ord(c) for c in "。！？；"])


def segments_of(texts: list[str]) -> Segments:
    """Segments end after a line, after 。！？； and after . ! ? with a blank behind. Texts hold no NUL."""
    with np.errstate(over="ignore"):
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = (points == 10) | np.isin(points, _ENDERS)
        points = np.where(points > 0xFFFF, 0x4E00 + (points & 0x3FFF), points)
        points = np.where((points > 0xFF00) & (points < 0xFF5F), points - 0xFEE0, points)  # full-width forms
        kind = _classes()[points]
        n = len(points)
        low = points.astype(np.uint64)
        upper = (points >= 65) & (points <= 90)
        low[upper] += np.uint64(32)
        low[kind == 2] = 48
        before = np.r_[np.uint8(0), kind[:-1]]
        # A token starts where the class changes, and at every CJK letter and mark.
        start = (kind != 0) & ((kind != before) | (kind >= 3))
        first = np.flatnonzero(start)
        if not len(first):
            return Segments(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64))
        # A token's end: the next start or the next blank; blanks add nothing to the prefix sum.
        low[kind == 0] = 0
        # Digits count once: a run of digits is one sign.
        low[(kind == 2) & (before == 2)] = 0
        prefix = np.r_[np.uint64(0), np.cumsum(low * _powers(int(_B), n))]
        last = np.r_[first[1:], n]
        token = _mix((prefix[last] - prefix[first]) * _powers(int(_B_INVERSE), n)[first])
        stop |= ((points == 46) | (points == 33) | (points == 63)) & (np.r_[kind[1:], np.uint8(0)] == 0)
        number = np.r_[0, np.cumsum(stop)[:-1]]
        seg = number[first]
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
        fresh = np.r_[True, seg[1:] != seg[:-1]]
        # A stretch without an end is read in segments of LONG_SEGMENT tokens.
        within = np.arange(len(seg)) - np.maximum.accumulate(np.where(fresh, np.arange(len(seg)), 0))
        fresh |= within % LONG_SEGMENT == 0
        seg_first = np.flatnonzero(fresh)
        seg_no = np.cumsum(fresh) - 1
        m, mask = len(token), np.uint64((1 << TABLE_BITS) - 1)
        same1 = np.r_[False, seg_no[1:] == seg_no[:-1]]
        same2 = np.r_[False, False, seg_no[2:] == seg_no[:-2]] if m > 1 else np.zeros(m, bool)
        prev1 = np.r_[np.uint64(7), token[:-1]]
        prev1[~same1] = 7  # the segment's edge
        prev2 = np.r_[np.uint64(7), np.uint64(7), token[:-2]] if m > 1 else np.full(m, 7, np.uint64)
        prev2[~same2] = 7
        two = _mix(token * np.uint64(3) + prev1 * np.uint64(0xD6E8FEB86659FD93))
        three = _mix(two * np.uint64(5) + prev2 * np.uint64(0xA0761D6478BD642F))
        repeat = np.where(same1 & (token == prev1), np.uint64(11), np.uint64(13))
        # Shapes: a run of words is one sign (upper case apart), marks stand for themselves.
        kinds = kind[first].astype(np.uint64)
        upper_case = upper[first] & upper[np.minimum(first + 1, n - 1)]
        sign = np.where(kinds == 4, token, np.where(upper_case, np.uint64(102), np.uint64(101)) + (kinds == 3))
        run = np.r_[True, (sign[1:] != sign[:-1]) | (kinds[1:] == 4) | ~same1[1:]]
        at = np.flatnonzero(run)
        sign, home = sign[at], seg_no[at]
        k = len(at)
        s1 = np.where(np.r_[False, home[1:] == home[:-1]], np.r_[np.uint64(7), sign[:-1]], np.uint64(7))
        s2 = np.where(np.r_[np.zeros(min(2, k), bool), home[2:] == home[:-2]], np.r_[np.full(min(2, k), 7, np.uint64), sign[:-2]], np.uint64(7))
        s3 = np.where(np.r_[np.zeros(min(3, k), bool), home[3:] == home[:-3]], np.r_[np.full(min(3, k), 7, np.uint64), sign[:-3]], np.uint64(7))
        shape3 = _mix(sign * np.uint64(0x9FB21C651E98DF25) + s1 * np.uint64(0xD6E8FEB86659FD93) + s2 * np.uint64(0xA0761D6478BD642F))
        shape4 = _mix(shape3 + s3 * np.uint64(0xE7037ED1A0B428DB))
        same_shape = np.full(m, 19, np.uint64)
        spread3, spread4 = same_shape.copy(), same_shape.copy()
        spread3[at], spread4[at] = shape3, shape4
        slots = np.empty((m, FEATURES), np.int32)
        for i, h in enumerate((token, two, three, repeat, spread3, spread4)):
            slots[:, i] = (h & mask).astype(np.int32)
        seg_text = text[seg_first]
        sizes = np.diff(np.r_[seg_first, m])
        per_text = np.bincount(text, minlength=len(texts))
        title = np.r_[True, seg_text[1:] != seg_text[:-1]]
        extra = np.stack([17 + np.minimum(np.log2(sizes).astype(np.int64), 8), 29 + title.astype(np.int64), 31 + (per_text[seg_text] <= SHORT_TEXT_TOKENS).astype(np.int64)], axis=1)
        flat = np.empty(FEATURES * m + 3 * len(seg_first), np.int32)
        starts = FEATURES * seg_first + 3 * np.arange(len(seg_first))
        is_extra = np.zeros(len(flat), bool)
        for i in range(3):
            is_extra[starts + i] = True
        flat[is_extra] = extra.ravel()
        flat[~is_extra] = slots.ravel()
        ends = np.r_[last[seg_first[1:] - 1], last[-1]]
        return Segments(flat, starts, seg_text, np.stack([first[seg_first], ends], axis=1))


def scores(s: Segments, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of each segment: the sum of its features' weights."""
    return np.add.reduceat(weights[s.slots], s.starts) + bias if len(s.starts) else np.empty(0)


def fit(s: Segments, labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 penalty by full-batch steps scaled per weight; both classes weigh alike.

    Only slots that occur LEAST_SEEN times have weights to fit; all others stay 0.
    """
    count = np.bincount(s.slots, minlength=1 << TABLE_BITS)
    used = np.flatnonzero(count >= LEAST_SEEN)
    code = np.full(1 << TABLE_BITS, -1, np.int32)
    code[used] = np.arange(len(used))
    sizes = np.diff(np.r_[s.starts, len(s.slots)])
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    slots = code[s.slots]
    row, slots = row[slots >= 0], slots[slots >= 0]
    starts = np.searchsorted(row, np.arange(len(sizes)))  # every segment has its length and place, so none is empty
    y = labels.astype(np.float64)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, bias, seen = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8)
    seen_bias = 1e-8
    for _ in range(epochs):
        z = np.add.reduceat(w[slots], starts) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
        grad = np.bincount(slots, weights=g[row], minlength=len(used)) + PENALTY * w
        seen += grad * grad
        w -= RATE * grad / np.sqrt(seen)
        seen_bias += g.sum() ** 2
        bias -= RATE * g.sum() / np.sqrt(seen_bias)
    every = np.zeros(1 << TABLE_BITS, np.float32)
    every[used] = w
    return every, float(bias)


# Tags of layout, within words and between them, which say nothing about a text.
INLINE, LAYOUT = re.compile(r"</?(?:b|i|u|em|strong|span|br)\b[^<>]{0,80}>"), re.compile(r"</?(?:p|div|li|ul|ol|td|tr|table|h\d)\b[^<>]{0,80}>")


INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Marks of emphasis; two underscores may be a placeholder's.
EMPHASIS = re.compile(r"\*\*|_(?<![_A-Za-z0-9]_)(?!_)|_(?<!__)(?![_A-Za-z0-9])")


def readable(text: str) -> str:
    """The text without NULs, invisible marks, layout tags and emphasis."""
    text = LAYOUT.sub(" ", INLINE.sub("", text)) if "<" in text else text
    text = EMPHASIS.sub("", text) if "_" in text or "**" in text else text
    for c in INVISIBLE if not text.isascii() else "":
        text = text.replace(c, "")
    return text.replace("\x00", " ")


def pieces_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts in pieces of at most PIECE_CHARS, cut after a line or blank, and the text number of each piece."""
    out, of = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE_CHARS:
            end = at + PIECE_CHARS
            cut_at = max(t.rfind("\n", at, end), t.rfind(" ", end - 1000, end)) + 1
            end = cut_at if cut_at > at + PIECE_CHARS // 2 else end
            out.append(t[at:end])
            of.append(i)
            at = end
        out.append(t[at:])
        of.append(i)
    return out, np.array(of, np.int64)


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK_POINTS or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _is_marked(segment: str) -> bool:
    """Clean segments that look like residue to a counter of n-grams: mark-up, emphasis, quotations, code."""
    return any(m in segment for m in ("<", "**", "_", "[", "{", "$", "#", "\xad", "@", "%", '"', "“", "„"))


def _cue() -> str:
    """A cheap pattern (for the JVM) that texts worth labelling are likely to match; it only steers the sample."""
    return r"\{\{|<%|\$\{|%%|@@|<<|«|\[\[|__|XXXX|%\(|&lt;|#|\[|\{|(?i)\b(?:404|403|50[0-4]|script|javascript|cookies|browser|denied|expired|lorem|dummy|click to|sample|later|sorry|oops|loading|permission|Sitzung|Blindtext|Hinweis)\b|脚本|占位|此处|登录|权限|请稍|浏览器|不存在"


@dataclass
class Model:
    """weights and bias of the classifier; a segment is residue above `threshold`, and nothing else decides."""

    weights: np.ndarray
    bias: float
    threshold: float
    held_out: dict[str, float]


def _joined(parts: list[Segments]) -> Segments:
    base = np.cumsum([0] + [len(p.slots) for p in parts])
    return Segments(np.concatenate([p.slots for p in parts]), np.concatenate([p.starts + b for p, b in zip(parts, base)]), np.concatenate([p.texts for p in parts]), np.concatenate([p.spans for p in parts]))


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the weak label of each segment of a text."""
    for pdf in batches:
        labels = []
        for t in map(readable, pdf["t"]):
            labels.append([weak_label((t + "\n")[a:b]) for a, b in segments_of([t]).spans.tolist()])
        yield pdf.assign(labels=labels)


def _sample(documents: DataFrame, text: str, source: str, sample_texts: int, seed: int) -> list[tuple[str, str, list[bool]]]:
    """At most sample_texts distinct texts by hash (half of them any, half with a cue), with source and weak labels."""
    rows = documents.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).filter(F.length("t") <= SAMPLE_CHARS)
    # A bound of the hash that follows from the number of distinct texts spares most rows the sort.
    total = rows.agg(F.approx_count_distinct(F.xxhash64("t"))).first()[0]
    below = lambda n: F.lit(int(min(1.0, n / max(1, total)) * (1 << 32)))
    half = max(1, sample_texts // 2)
    cue = F.col("t").rlike(_cue())
    near = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "t"), 32)).filter((F.col("h") < below(1.1 * half)) | ((F.col("h") < below(10 * half)) & cue))
    once = cut(near.withColumn("cue", cue).groupBy("t").agg(F.first("h").alias("h"), F.min("s").alias("s"), F.first("cue").alias("cue")))
    some = [once.filter(f).orderBy("h", "t").limit(half) for f in (F.col("h") < below(1.1 * half), F.col("cue"))]
    both = some[0].union(some[1]).select("t", "h", "s").distinct().repartition(16)
    # Sorted here: Spark's own sort would label every text twice, once to find its ranges.
    return [r[1:] for r in sorted(both.mapInPandas(_labelled, "t string, h long, s string, labels array<boolean>").select("h", "t", "s", "labels").collect())]


def train(documents: DataFrame, text: str, source: str, sample_texts: int = SAMPLE_TEXTS, seed: int = 7) -> Model:
    """Fit on weak labels of at most sample_texts texts and on seeds; a fifth of the sources is held out.

    Two fits: labels that the first contradicts clearly are dropped as noise before the second. The threshold
    is chosen on the unseen sources (NEAR_BEST); held_out has precision and recall there,
    against their weak labels, of exactly the decision that residue() makes.
    """
    picked = _sample(documents, text, source, sample_texts, seed)
    texts = [readable(t) for t, _, _ in picked]
    unseen = np.array([zlib.crc32(s.encode()) % 5 == 0 for _, s, _ in picked], bool)
    y = np.array([label for _, _, labels in picked for label in labels], bool)
    parts, own, hosts = [], [], []
    for first, some in chunks(texts):
        parts.append(seg := segments_of(some))
        joined = "\n".join(some) + "\n"
        own += [joined[a:b].strip() for a, b in seg.spans.tolist()]
        hosts.append(unseen[first + seg.texts])
    rng = np.random.default_rng(seed)
    out = np.concatenate(hosts) if hosts else np.empty(0, bool)
    if not (~out & y).any():
        out = np.zeros(len(y), bool)  # too few sources to hold one out
    marked = np.fromiter(map(_is_marked, own), bool, len(own))
    plain = ~y & ~marked & (np.arange(len(y)) % max(1, len(y) // CLEAN_SEGMENTS) == 0)
    extra = list(seeds([own[i] for i in np.flatnonzero(~out & ~y & (rng.random(len(y)) < 0.5))], rng, PLANTED_SEGMENTS))
    # A seed is a text of its own, so it may hold several segments: all but those of a message are one.
    seeded = segments_of([t.replace("\n", " ") for t, _ in extra])
    every = _joined([*parts, seeded])
    of_seed = np.array([label for _, label in extra], bool)[seeded.texts]
    labels, kept = np.r_[y, of_seed], np.r_[~out & (y | marked | plain), np.ones(len(of_seed), bool)]
    weights, bias = fit(_only(every, kept), labels[kept], EPOCHS // 3)
    z = scores(every, weights, bias)
    noise = np.r_[np.where(y, z[: len(y)] < -NOISE, z[: len(y)] > NOISE), np.zeros(len(of_seed), bool)]
    kept &= ~noise
    weights, bias = fit(_only(every, kept), labels[kept])
    test = np.r_[out, np.zeros(len(of_seed), bool)]
    z, truth = scores(_only(every, test), weights, bias), labels[test]
    found = []
    for t in THRESHOLDS if truth.any() else ():
        hit, said = int((truth & (z > t)).sum()), int((z > t).sum())
        found.append((2 * hit / max(1, said + int(truth.sum())), t, hit / max(1, said), hit / int(truth.sum())))
    best = max((x for x in found if x[0] >= max(found)[0] - NEAR_BEST), key=lambda x: x[1], default=(0.0, 0.0, 1.0, 1.0))
    return Model(weights, bias, best[1], {"segments": float(len(truth)), "precision": best[2], "recall": best[3]})


def _only(s: Segments, mask: np.ndarray) -> Segments:
    sizes = np.diff(np.r_[s.starts, len(s.slots)])
    kept = sizes[mask]
    return Segments(s.slots[np.repeat(mask, sizes)], np.r_[0, np.cumsum(kept)[:-1]].astype(np.int64) if len(kept) else np.empty(0, np.int64), s.texts[mask], s.spans[mask])


def flagged(model: Model, texts: list[str]) -> Iterator[tuple[int, int, int, float, str]]:
    """(text number, segments, segments above the threshold, highest score, its segment) of texts with residue."""
    parts, of = pieces_of([readable(t) for t in texts])
    n_segments, by = np.zeros(len(texts), np.int64), {}
    for first, some in chunks(parts):
        seg = segments_of(some)
        z = scores(seg, model.weights, model.bias)
        np.add.at(n_segments, of[first + seg.texts], 1)
        above = np.flatnonzero(z > model.threshold)
        if len(above):
            joined = "\n".join(some) + "\n"
            for i in above.tolist():
                a, b = seg.spans[i]
                by.setdefault(int(of[first + seg.texts[i]]), []).append((float(z[i]), joined[a:b].strip()))
    for k, v in by.items():
        yield k, int(n_segments[k]), len(v), *max(v)


def residue(documents: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """doc_id, n_segments, n_flagged, score, example of every text with a segment above the model's threshold.

    The classifier decides alone; phrases only label its sample. Null and blank texts have no segments and
    are never flagged; repeated rows give a row each; empty in, empty out. Very long texts are read in
    pieces, none is cut short. One pass, no shuffle; the model is broadcast (1 MB).
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc"].tolist()
            if out := [(ids[k], *rest) for k, *rest in flagged(shared.value, pdf["text"].tolist())]:
                yield pd.DataFrame(out, columns=["doc", "n_segments", "n_flagged", "score", "example"])

    return docs.mapInPandas(run, f"doc {dict(docs.dtypes)['doc']}, n_segments int, n_flagged int, score double, example string").withColumnRenamed("doc", doc_id)
