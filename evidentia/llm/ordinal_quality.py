"""Ordinal quality: cumulative-link regression on graded ratings.

A document has one score, the sum of weights shared by all grades over the hashed features that occur in its
text: its words without punctuation, their beginnings, and in four degrees of their share the shapes of its words (``Aa,`` or
``A!!``) and windows of five words that come again. Ordered
thresholds cut the score into grades: P(grade <= k) = sigmoid(threshold_k - score). The weights are fitted
by FTRL-proximal steps, whose L1 term leaves words without evidence at zero, on a bounded sample of labelled
documents (``TRAIN_ROWS``, the labels with the smallest hashes of their ids).

The rating is quality + (1 - toxic), so 0, 1 or 2; the expected grade and the probability of grade 2 and
more come out, and documents whose probability is at least 0.5 are kept.

Defined results: a null or empty text has no features, so its score is 0. Labels with a null are not used;
without labels of two grades every document has the top grade. Rows of one id are judged each by itself.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, Words, mix, text_slices

TRAIN_ROWS = 16_000
FEATURE_BITS = 20
EPOCHS, BATCH, ALPHA, L1, L2 = 12, 128, 0.3, 8.0, 0.5
#: Sampled documents that must hold a feature for it to get a weight.
LEAST_DOCUMENTS = 5
SHARES = (0.0, 1 / 32, 1 / 8, 1 / 2)
REPEAT = 5
#: Beginnings of longer words that are features too, in bytes.
PREFIXES = (4, 5, 6)
#: Punctuation gives way to spaces, so that a word is the same at the end of a sentence.
_BARE = bytes(32 if 33 <= i < 127 and not chr(i).isalnum() else i for i in range(256))
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), sorted and distinct."""
    w = Words([(t or b"").translate(_BARE) for t in texts], lower=True)
    doc, hashes = np.repeat(np.arange(len(texts)), w.n), w.hashes()
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    found = [np.unique(doc.astype(np.uint64) << np.uint64(FEATURE_BITS) | hashes & mask)]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        h = mix(w.spans(w.start[long], w.start[long] + k))
        found.append(np.unique(doc[long].astype(np.uint64) << np.uint64(FEATURE_BITS) | h & mask))
    at, window = w.windows(REPEAT, hashes)
    distinct = np.bincount((np.unique(doc[at].astype(np.uint64) << np.uint64(52) | window >> np.uint64(12)) >> np.uint64(52)).astype(np.int64), minlength=len(texts))
    windows = np.maximum(w.n - REPEAT + 1, 0)
    for degree, least in enumerate(SHARES):
        again = np.flatnonzero(windows - distinct > least * np.maximum(windows, 1))
        found.append(again.astype(np.uint64) << np.uint64(FEATURE_BITS) | mix(np.array([degree + 1], np.uint64)) & mask)
    shape = _SHAPE[np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)]
    first = np.r_[True, (shape[1:] != shape[:-1]) | SPACE[shape[1:]]]  # runs of a kind of character count once
    end = np.cumsum(first)
    joined = shape[first].tobytes()
    cuts = np.r_[0, end[w.begin[1:] - 1]]
    s = Words([joined[a : b - 1] for a, b in zip(cuts[:-1], cuts[1:])])
    key = np.repeat(np.arange(len(texts)), s.n).astype(np.uint64) << np.uint64(40) | s.hashes() >> np.uint64(24)
    key, times = np.unique(key, return_counts=True)
    of = (key >> np.uint64(40)).astype(np.int64)
    share = times / np.maximum(s.n[of], 1)
    for degree, least in enumerate(SHARES):
        some = share > least
        h = mix(key[some] & np.uint64((1 << 40) - 1) | np.uint64(degree + 1) << np.uint64(48))
        found.append(np.unique(of[some].astype(np.uint64) << np.uint64(FEATURE_BITS) | h & mask))
    key = np.unique(np.concatenate(found))
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), (key & mask).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return _sigmoid(score[:, None] - self.thresholds)


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray) -> Ordinal | None:
    """From sorted (document, feature) pairs and each document's grade, 0 upwards; None without two grades."""
    if len(np.unique(grade)) < 2:
        return None
    size, top = 1 << FEATURE_BITS, int(grade.max())
    often = np.bincount(feature, minlength=size) >= LEAST_DOCUMENTS
    doc, feature = doc[often[feature]], feature[often[feature]]
    first = np.searchsorted(doc, np.arange(len(grade) + 1))
    share = np.array([(grade <= k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    thresholds = np.log(share / (1 - share))
    z, n, weights = np.zeros(size), np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(grade))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            lengths = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            f, of = feature[at], np.repeat(np.arange(len(own)), lengths)
            score = np.bincount(of, weights[f], len(own))
            edge = np.r_[-40.0, thresholds, 40.0]
            upper, lower = _sigmoid(edge[grade[own] + 1] - score), _sigmoid(edge[grade[own]] - score)
            slope = 1 - upper - lower  # of the loss, by the score
            some, own_place = np.unique(f, return_inverse=True)
            g = np.bincount(own_place, slope[of], len(some))
            sigma = (np.sqrt(n[some] + g * g) - np.sqrt(n[some])) / ALPHA
            z[some] += g - sigma * weights[some]
            n[some] += g * g
            shrunk = np.maximum(np.abs(z[some]) - L1, 0) * np.sign(z[some])
            weights[some] = -shrunk / ((1 + np.sqrt(n[some])) / ALPHA + L2)
            p = np.maximum(upper - lower, 1e-9)
            for k in range(top):
                up, down = grade[own] == k, grade[own] == k + 1
                step = (-(upper * (1 - upper) / p)[up].sum() + (lower * (1 - lower) / p)[down].sum()) / len(own)
                thresholds[k] -= 0.1 / (1 + epoch) * step
            thresholds = np.maximum.accumulate(thresholds + np.arange(top) * 1e-6)  # ordered
    return Ordinal(weights.astype(np.float32), thresholds)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Ordinal | None:
    """Fit on at most ``rows`` documents with a rating of quality + (1 - toxic)."""
    rating = (F.col("quality") + 1 - F.col("toxic")).cast("int")
    sample = labels.select(F.col(id_col).alias("id"), rating.alias("grade")).dropna().filter("grade between 0 and 2").orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b.column(2)):
                d, f = features(texts)
                cuts = np.searchsorted(d, np.arange(part.stop - part.start + 1))
                packed = [f[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], b.column(1)[part], pa.array(packed, pa.binary())], ["id", "grade", "features"])

    # the sample is bounded by ``rows``, so it is the side to broadcast
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # of the rows of a repeated id the one with the smallest text hash, so ``rows`` bounds them too
    joined = joined.groupBy("id", "grade").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    got = sorted(joined.mapInArrow(run, "id long, grade int, features binary").toLocalIterator(), key=lambda r: (r["id"], r["grade"], bytes(r["features"])))
    lists = [np.frombuffer(bytes(r["features"]), "<u4") for r in got]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fit(doc, np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64), np.array([r["grade"] for r in got], np.int64))


def ordinal_quality(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, expected_grade, p_top, kept), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for part, texts in text_slices(b.column(1)):
                rows = part.stop - part.start
                if m is None:
                    expected, top = np.full(rows, 2.0), np.ones(rows)
                else:
                    d, f = features(texts)
                    tails = m.tails(np.bincount(d, m.weights[f], rows))
                    expected, top = tails.sum(axis=1), tails[:, -1]
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(expected), pa.array(top), pa.array(top >= least)], [id_col, "expected_grade", "p_top", "kept"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, expected_grade double, p_top double, kept boolean")
