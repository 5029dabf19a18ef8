"""Substring dedup: every window of 20 words that starts earlier elsewhere is removed.

Documents are dealt into chunks of about ``CHUNK_BYTES`` by ranges of their id, so that (chunk, place in
the chunk) is the order of (id, start). Each chunk computes the Rabin-Karp hash of every window and sends
each distinct hash once, as packed arrays, to the hash's bucket: a window that a third of all documents
hold costs one hash a chunk. A bucket sorts its hashes and answers with one bit a hash: does it start
earlier in another chunk? With the answer each chunk marks its repeated windows, merges the words that
they cover into maximal intervals and cuts those from the texts.

Windows of different chunks are told apart by 88 bits, a hash of 64 and 24 of a second one: among n windows about
n**2 / 2**89 pairs are taken for equal by chance, less than one in 100 TB; those of one chunk by 64. Both looks at a chunk read one shuffle of the texts, so they see the same rows.

Defined results: a null text has no words and stays null. A null id counts as smaller than any other; rows
with the same id are ordered by their text, and equal rows are separate documents. A text of fewer than 20
words loses nothing. Removed words go with the white space that follows them; nothing else is changed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WINDOW_Q, Words, as_bytes, release, slices

WINDOW = 20
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
LEAST_ID = -(2**63)
#: Ranges of ids by quantiles; more chunks are even parts of these.
MOST_RANGES = 4096


class _Chunk:
    """The windows of one chunk, in the order of (id, text, start)."""

    def __init__(self, ids: list, texts: list, window: int, buckets: int):
        key = [LEAST_ID if i is None else i for i in ids]
        self.order = sorted(range(len(ids)), key=lambda i: (key[i], texts[i] or b""))
        self.texts = [texts[i] for i in self.order]
        n, start, end, at, hashes, more, base = [], [], [], [], [], [], 0
        for part in slices([len(t or b"") for t in self.texts]):
            w = Words(self.texts[part])
            words = w.hashes()
            i, h = w.windows(window, words)
            more.append((w.windows(window, words, WINDOW_Q)[1] >> np.uint64(40)).astype(np.uint32))
            begin = np.repeat(w.begin[:-1], w.n)
            n.append(w.n)
            start.append(w.start - begin)
            end.append(w.end - begin)
            at.append(i + base)
            hashes.append(h)
            base += len(w.start)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.n, self.start, self.end, self.at = (cat(x, np.int64) for x in (n, start, end, at))
        h, self.more = cat(hashes, np.uint64), cat(more, np.uint32)
        #: Indices of the windows that are the chunk's first with their hash, bucket by bucket.
        self.sent = np.sort(np.unique(h, return_index=True)[1])
        bucket = ((h[self.sent] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        self.sent = self.sent[by]
        self.cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        self.hashes = h


def _chunk_of(table: pa.Table, window: int, buckets: int) -> _Chunk:
    return _Chunk(table.column("id").to_pylist(), as_bytes(table.column("text").combine_chunks()), window, buckets)


def _send(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        c = _chunk_of(table, window, buckets)
        full = np.flatnonzero(np.diff(c.cuts))
        h, more = c.hashes[c.sent], np.ascontiguousarray(c.more[c.sent].view(np.uint8).reshape(-1, 4)[:, :3])
        release()
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array(np.full(len(full), table.column("chunk")[0].as_py()), pa.int64()),
            "hashes": pa.array([h[c.cuts[b] : c.cuts[b + 1]].tobytes() for b in full], pa.binary()),
            "more": pa.array([more[c.cuts[b] : c.cuts[b + 1]].tobytes() for b in full], pa.binary()),
        })

    return run


def repeats(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Is there an equal pair (h, more) before each?"""
    by = np.argsort(h, kind="stable")
    same, differ = h[by[1:]] == h[by[:-1]], more[by[1:]] != more[by[:-1]]
    again = np.zeros(len(h), bool)
    again[by[1:]] = same & ~differ
    if (same & differ).any():  # different windows with one hash: their runs are looked at pair by pair
        run = np.cumsum(np.r_[True, ~same])
        for r in np.unique(run[1:][same & differ]):
            seen: set[int] = set()
            for i in by[run == r].tolist():
                again[i] = int(more[i]) in seen
                seen.add(int(more[i]))
    return again


def _answer(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    more = np.zeros((len(h), 4), np.uint8)
    more[:, :3] = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("more").to_pylist()]).reshape(-1, 3)
    again = repeats(h, more.view(np.uint32).ravel())
    ends = np.cumsum([len(p) for p in parts])
    del h, more
    release()
    bits = [np.packbits(again[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _nullable(rest: pa.StructArray) -> pa.StructArray:
    """Spark declares the fields of results nullable."""
    return pa.StructArray.from_arrays(rest.flatten(), fields=[pa.field(f.name, f.type, True) for f in rest.type])


def _cut(window: int, buckets: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _chunk_of(table, window, buckets)
        again = np.ones(len(c.hashes), bool)
        again[c.sent] = False
        for b, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
            own = c.sent[c.cuts[b] : c.cuts[b + 1]]
            again[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        words = len(c.start)
        covered = np.zeros(words + 1, np.int64)
        covered[c.at[again]] += 1
        np.subtract.at(covered, c.at[again] + window, 1)
        gone = np.cumsum(covered)[:-1] > 0
        first = np.r_[0, np.cumsum(c.n)]
        removed = np.diff(np.r_[0, np.cumsum(gone)][first])
        spans, kept = [], []
        for d, text in enumerate(c.texts):
            if not removed[d]:
                spans.append([])
                kept.append(text)
                continue
            i, j = first[d], first[d + 1]
            edge = np.flatnonzero(np.diff(np.r_[False, gone[i:j], False].astype(np.int8)))
            begin = np.r_[c.start[i:j], len(text)]
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            keep = np.r_[0, begin[edge], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(keep[::2], keep[1::2])))
        take = pa.array(c.order, pa.int64())
        release()
        return pa.table({
            "id": table.column("id").take(take),
            "text": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(c.n, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "rest": _nullable(table.column("rest").combine_chunks().take(take)),
        })

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """(id, text, n_words, n_removed, spans, rest): texts without repeated windows, the removed word intervals, and the columns ``carry`` as a struct."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks, buckets = max(16, -(-size // CHUNK_BYTES)), max(16, -(-size // BUCKET_BYTES))
    ranges = min(chunks, MOST_RANGES)
    parts, at = -(-chunks // ranges), [(i + 1) / ranges for i in range(ranges - 1)]
    key = F.col(id_col).cast("long")
    found = docs.agg(F.percentile_approx(key, at, max(10_000, 20 * ranges)), F.min(key), F.max(key)).first()
    bounds = np.array(found[0] or [0], np.int64)
    low, high = np.r_[found[1] or 0, bounds[: ranges - 1]].astype(np.float64), np.r_[bounds[: ranges - 1], found[2] or 0].astype(np.float64)

    @F.pandas_udf("long")
    def chunk(i: pd.Series) -> pd.Series:
        """The range of an id, and its even part of the range, both growing with the id."""
        own = i.fillna(LEAST_ID).astype("int64").to_numpy()
        r = np.searchsorted(bounds[: ranges - 1], own, "left")
        part = np.floor((own - low[r]) / np.maximum(high[r] - low[r], 1) * parts)
        return pd.Series(r * parts + np.clip(part, 0, parts - 1).astype(np.int64))

    rest = F.struct(*(docs[c] for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest.alias("rest")).withColumn("chunk", chunk("id"))
    hashes = dealt.groupBy("chunk").applyInArrow(_send(window, buckets), "bucket long, chunk long, hashes binary, more binary")
    replies = hashes.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, bits binary")
    kind = dealt.schema["rest"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_cut(window, buckets), f"id long, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>, rest {kind}")
