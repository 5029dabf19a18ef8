"""Quality rules: two fixed rules and gradient-boosted trees over document statistics.

The statistics of whole texts are computed in numpy over many documents at once. The trees are grown on
histograms from a bounded sample of labelled documents (``TRAIN_ROWS``, the labels with the smallest hashes
of their ids), with monotonic constraints: more repetition, symbols, capitals or exclamation marks never
raise a score. They are flattened into node arrays, so scoring is a few array look-ups a tree.

Defined results: a null or empty text has no words and fails. Null labels are not used; without labels of
both kinds every document that passes the fixed rules is kept. Rows of one id are judged each by itself.
Other columns, whatever their names, go through unread. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, Words, release, text_slices

#: Labelled documents used for fitting, at most.
TRAIN_ROWS = 12_000
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Statistics of a document, and the sense in which each may move the score (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeated": -1, "capitals": -1,
    "exclaims": -1, "digits": 0, "punctuation": 0, "words_a_line": 0, "distinct": 1, "not_ascii": 0,
}
BINS, DEPTH, ROUNDS, RATE, LEAST_LEAF, L2 = 64, 4, 60, 0.2, 20, 1.0


def _counts(buf: np.ndarray, begin: np.ndarray, chars: bytes | None = None, table: np.ndarray | None = None) -> np.ndarray:
    if table is None:
        table = np.zeros(256, bool)
        table[list(chars or b"")] = True
    return np.diff(np.r_[0, np.cumsum(table[buf])][begin])


_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_START = (np.arange(256) & 0xC0) != 0x80
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:?!\"'()-")] = True


def statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of the contract and, under the names of FEATURES, what the trees see."""
    w = Words(texts)
    lengths = np.diff(w.begin)
    total = np.maximum(_counts(w.buf, w.begin, table=_START & ~SPACE), 1)
    out = {"n_words": w.n.astype(np.int64), "word_chars": _counts(w.buf, w.begin, table=_START & ~SPACE), "n_symbols": _counts(w.buf, w.begin, SYMBOLS)}
    lines = [[x for x in (t or b"").split(b"\n") if x.strip(b" \t\n\v\f\r")] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    hashes = w.hashes()
    out["n_repeat_words"] = np.zeros(len(texts), np.int64)
    at, h = w.windows(REPEAT_WINDOW, hashes)
    doc = np.repeat(np.arange(len(texts)), w.n)
    if len(at):
        key = doc[at].astype(np.uint64) << np.uint64(52) | h >> np.uint64(12)
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        again = np.zeros(len(at), bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        cover = np.zeros(len(doc) + 1, np.int64)
        cover[at[again]] += 1
        np.subtract.at(cover, at[again] + REPEAT_WINDOW, 1)
        covered = np.cumsum(cover)[:-1] > 0
        out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(texts)).astype(np.int64)
    key = np.unique(doc.astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(12))
    distinct = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(texts))
    words = np.maximum(w.n, 1)
    out |= {
        "log_words": np.log1p(w.n), "word_length": out["word_chars"] / words, "symbols": out["n_symbols"] / total, "dup_lines": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeated": out["n_repeat_words"] / words, "capitals": _counts(w.buf, w.begin, table=_CAPITAL) / total, "exclaims": _counts(w.buf, w.begin, b"!") / words,
        "digits": _counts(w.buf, w.begin, table=_DIGIT) / total, "punctuation": _counts(w.buf, w.begin, table=_PUNCTUATION) / total,
        "words_a_line": np.log1p(w.n / np.maximum(n_lines, 1)), "distinct": distinct / words / np.maximum(1, np.log1p(w.n)) * 5, "not_ascii": (lengths - _counts(w.buf, w.begin, table=_START)) / lengths,
    }
    out["base_failed"] = (w.n < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * w.n)
    return out


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[f] for f in FEATURES], axis=1).astype(np.float64)


@dataclass
class Trees:
    """Complete binary trees as node arrays: a row a tree, a column a node, children of i at 2 i + 1 and 2 i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, good: np.ndarray, depth: int = DEPTH, rounds: int = ROUNDS) -> Trees | None:
    """Boosted trees for the log-odds of ``good``; None without both kinds."""
    if not len(x) or good.all() or not good.any():
        return None
    sense = np.array(list(FEATURES.values()))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    inner, width = 2**depth - 1, BINS * x.shape[1]
    flat = binned + np.arange(x.shape[1]) * BINS
    base = float(np.log(good.sum() / (~good).sum()))
    raw = np.full(len(x), base)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = good - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        node, low, high = np.zeros(len(x), np.int64), {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            own = np.flatnonzero(node == i)
            split = _split(flat[own], g[own], h[own], width, sense, low[i], high[i]) if len(own) >= 2 * LEAST_LEAF else None
            left, right = 2 * i + 1, 2 * i + 2
            low[left] = low[right] = low[i]
            high[left] = high[right] = high[i]
            if split is None:
                node[own] = left
                continue
            f, b, lv, rv = split
            feature[i], threshold[i] = f, edges[f][b]
            node[own] = left + (binned[own, f] > b)
            middle = (lv + rv) / 2
            if sense[f] > 0:
                high[left], low[right] = middle, middle
            elif sense[f] < 0:
                low[left], high[right] = middle, middle
        for k in range(2**depth):
            own = node == inner + k
            if own.any():
                leaf[k] = RATE * np.clip(g[own].sum() / (h[own].sum() + L2), low[inner + k], high[inner + k])
        raw += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def _split(flat: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, sense: np.ndarray, low: float, high: float) -> tuple[int, int, float, float] | None:
    """(feature, bin, left value, right value) of the best split that keeps the constraints."""
    k = flat.shape[1]
    sums = [np.bincount(flat.ravel(), np.repeat(v, k), width).reshape(k, BINS) for v in (g, h, np.ones(len(g)))]
    left = [np.cumsum(s, axis=1)[:, :-1] for s in sums]
    whole = [s.sum(axis=1, keepdims=True) for s in sums]
    right = [w - s for w, s in zip(whole, left)]
    value = lambda s: np.clip(s[0] / (s[1] + L2), low, high)
    gain = lambda s, v: 2 * s[0] * v - (s[1] + L2) * v * v
    lv, rv = value(left), value(right)
    better = gain(left, lv) + gain(right, rv) - gain(whole, value(whole))
    ok = (left[2] >= LEAST_LEAF) & (right[2] >= LEAST_LEAF) & ((rv - lv) * sense[:, None] >= 0)
    better = np.where(ok, better, -np.inf)
    f, b = np.unravel_index(int(np.argmax(better)), better.shape)
    return (int(f), int(b), float(lv[f, b]), float(rv[f, b])) if better[f, b] > 1e-6 else None


_STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean"}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees | None:
    """Fit on at most ``rows`` labelled documents."""
    sample = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good")).dropna().orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b.column(1)):
                x = matrix(statistics(texts))
                yield pa.RecordBatch.from_arrays([b.column(0)[part], *(pa.array(c) for c in x.T)], ["good", *FEATURES])

    # the sample is bounded by ``rows``, so it is the side to broadcast
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # of the rows of a repeated id the one with the smallest text hash, so ``rows`` bounds them too
    joined = joined.groupBy("id", "good").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("good", "text")
    got = joined.mapInArrow(run, "good boolean, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    order = np.lexsort(got.to_numpy(np.float64).T)  # the same trees, however the rows arrive
    got = got.iloc[order]
    return fit(got[list(FEATURES)].to_numpy(np.float64), got["good"].to_numpy(bool))


def _judge(model: Trees | None, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    score = model.score(matrix(stats)) if model else np.full(len(stats["n_words"]), np.inf)
    return score, ~stats["base_failed"] & (score > 0)


def quality_rules(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the six statistics, score, kept), one row per row of ``docs``; the score is the log-odds of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b.column(1)):
                s = statistics(texts)
                score, kept = _judge(shared.value, s)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], *(pa.array(s[c]) for c in _STATS), pa.array(score), pa.array(kept)], [id_col, *_STATS, "score", "kept"])

    schema = f"`{id_col}` long, " + ", ".join(f"{c} {t}" for c, t in _STATS.items()) + ", score double, kept boolean"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that ``quality_rules`` rejects; nothing is shuffled."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b.column(at)):
                kept = _judge(shared.value, statistics(texts))[1]
                yield b[part].filter(pa.array(kept))
        release()

    return docs.mapInArrow(run, docs.schema)
