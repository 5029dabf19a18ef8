"""A counting Bloom filter of two bits a position, built by all executors.

Positions are counted 0, 1 or "2 and more". A key that occurs twice has counted each of its positions
twice, so a key with a position below 2 occurs once. The filter has at most ``CAP_BITS`` positions: what
reaches the driver and is broadcast is at most CAP_BITS / 8 bytes (32 MiB), however large the input is.
Beyond the capacity more single keys pass the test; results stay exact, as passing rows are compared.

Defined results: no key gives a filter that nothing passes; a key that counts a position twice by itself counts it
once; null keys are the caller's to keep out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP_BITS = 1 << 28
SEGMENT_BITS = 1 << 20
BITS_PER_KEY = 16
#: Keys of one filter at most; more are dealt into shards by who asks for repeats.
CAPACITY = CAP_BITS // BITS_PER_KEY
#: Partial filters that one task merges.
FAN_IN = 256
KEYS_A_TASK = 100_000


def bits_for(n: int) -> int:
    return int(min(CAP_BITS, max(SEGMENT_BITS, 1 << (max(1, n) * BITS_PER_KEY - 1).bit_length())))


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """keys: (n, 4) 64-bit words of each key's digest; gives (n, 4) positions."""
    return (keys & np.uint64(bits - 1)).astype(np.int64)


def words_of(digests: pa.Array) -> np.ndarray:
    """The four 64-bit words of 32-byte digests."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _pack(on: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(on).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8)


def repeated(digests: DataFrame, column: str, n: int, least: int = 2) -> tuple[Broadcast, int]:
    """The positions counted at least once or twice, as a broadcast of packed bits, and the number of positions."""
    bits = bits_for(n)
    digests = digests.select(column).coalesce(max(1, -(-n // KEYS_A_TASK)))  # few keys don't need many partial filters
    tasks = digests.rdd.getNumPartitions()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [positions(words_of(b.column(0)), bits) for b in batches if b.num_rows]
        if not found:
            return
        # one key may count a position twice by itself: those are its own repeats, not another key's
        rows = np.sort(np.concatenate(found), axis=1)
        own = np.ones(rows.shape, bool)
        own[:, 1:] = rows[:, 1:] != rows[:, :-1]
        at, times = np.unique(rows[own], return_counts=True)
        cuts = np.searchsorted(at, np.arange(0, bits + 1, SEGMENT_BITS))
        salt = TaskContext.get().partitionId() // FAN_IN
        out = []
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if i < j:
                one, two = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                one[at[i:j] - k * SEGMENT_BITS] = True
                two[at[i:j][times[i:j] > 1] - k * SEGMENT_BITS] = True
                out.append((k, salt, _pack(one), _pack(two)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["segment", "salt", "one", "two"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
        for a, b in zip(pdf["one"], pdf["two"]):
            a = _unpack(a)
            two |= _unpack(b) | (one & a)
            one |= a
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "salt": [0], "one": [zstandard.compress(one.tobytes(), 1)], "two": [zstandard.compress(two.tobytes(), 1)]})

    schema = "segment int, salt int, one binary, two binary"
    merged = digests.mapInArrow(count, schema)
    if tasks > FAN_IN:
        merged = merged.groupBy("segment", "salt").applyInPandas(merge, schema)
    merged = merged.groupBy("segment").applyInPandas(merge, schema)
    out, kept = np.zeros(bits // 8, np.uint8), "two" if least > 1 else "one"
    for row in merged.select("segment", kept).collect():  # at most CAP_BITS / 8 bytes
        at = row["segment"] * SEGMENT_BITS // 8
        out[at : at + SEGMENT_BITS // 8] = _unpack(bytes(row[kept]))
    return digests.sparkSession.sparkContext.broadcast(out), bits


def test(packed: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = positions(keys, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def id_words(ids: np.ndarray) -> np.ndarray:
    """The digest words under which ``members`` holds ids."""
    return np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in ids.tolist()), "<u8").reshape(-1, 4)


def members(keys: DataFrame, column: str, n: int) -> tuple[Broadcast, int]:
    """A plain filter (positions counted once and more) of 64-bit ids."""
    return repeated(keys.select(F.unhex(F.sha2(F.col(column).cast("string"), 256)).alias("key")), "key", n, 1)
