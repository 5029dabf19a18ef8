"""Token-id files in canonical length-limited Huffman code.

Layout under one folder, written by Spark's own writers so that any store will do:

- ``code``: one row with the code length of every id (0: not in use). Codes are canonical, of at most
  ``LIMIT`` bits, built by package-merge from the counts of all ids.
- ``blocks``: rows (shard, block, start, doc_ids, n_tokens, offsets, bits). A block holds whole documents of
  about ``BLOCK_BYTES`` of text and is decoded on its own. ``offsets`` are the bit positions of every
  ``STRIDE``-th id, from which the lanes of the table-driven decoder run side by side. Shards are ranges of
  the document id; ``start`` counts the ids before the block in its shard.
- ``shards``: (shard, first), the ids before each shard; one row a shard, so it is small by construction.

Defined results: a null text is empty, so it is the end id alone. Documents are in ascending id, null ids
first; rows of one id are ordered by their text. An empty table gives no blocks. More than 65,536 different
ids in use don't fit codes of 16 bits and are refused with an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, shuffle_partitions
from .tokens import encoder
from .words import as_bytes

LIMIT = 16
BLOCK_BYTES = 1 << 20
STRIDE = 256
#: Ids turned into bits at once, a multiple of STRIDE.
PIECE = 1 << 15


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    merged, leaf = weight, [np.ones(len(weight), bool)]
    for _ in range(limit - 1):
        even = len(merged) & ~1
        both = np.concatenate([weight, merged[:even:2] + merged[1:even:2]])
        by = np.argsort(both, kind="stable")
        leaf.append((np.arange(len(both)) < len(weight))[by])
        merged = both[by]
    take, length = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by id."""
    out = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    # the next code is one more than the last, shifted to its length
    step = np.cumsum(np.r_[0, (1 << (LIMIT - size))[:-1]]) if len(order) else size
    out[order] = step >> (LIMIT - size)
    return out


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids and the offset of every STRIDE-th."""
    bits, offsets, before = [], [], 0
    for i in range(0, len(ids), PIECE):
        own = ids[i : i + PIECE]
        size = lengths[own].astype(np.int32)
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(int(end[-1]), dtype=np.int64) - 1
        bits.append((np.repeat(code[own], size) >> left.astype(np.uint32) & 1).astype(np.uint8))
        offsets.append(before + (end - size)[::STRIDE])
        before += int(end[-1])
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return np.packbits(cat(bits, np.uint8)).tobytes(), cat(offsets, np.uint32)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LIMIT bits: the id that they begin with and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    fill = 1 << (LIMIT - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
    n = int(fill.sum())
    symbol[:n], size[:n] = np.repeat(order, fill), np.repeat(lengths[order], fill)
    return symbol, size


def unpack(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """n ids; every checkpoint is a lane, and all lanes take a step at a time."""
    symbol, size = table
    b = np.frombuffer(bits + b"\0\0\0", np.uint8).astype(np.uint32)
    words = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    at, lanes = offsets.astype(np.int64), len(offsets)
    out = np.zeros((STRIDE, lanes), np.uint32)
    last = n - (lanes - 1) * STRIDE if lanes else 0
    for i in range(STRIDE if lanes > 1 else last):
        if i == last:
            lanes -= 1
            at = at[:lanes]
        window = words[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        out[i, :lanes] = symbol[window]
        at = at + size[window]
    return out.T.ravel()[:n]


HEAD = "shard int, block long, start long, doc_ids binary, nulls binary, n_tokens binary"


def _blocks(path: str, end_id: int, special_as_text: bool = False):
    """Encode a shard's documents, which come in order, and pack them into blocks of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block, start = encoder(path, special_as_text), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], enc.kind).tobytes()
        ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, ids, texts, held
            coded = [x + end for x in enc.encode(texts)]
            n = np.array([len(x) // enc.kind.itemsize for x in coded], "<u4")
            row = [shard, block, start, np.array([i or 0 for i in ids], "<i8").tobytes(), np.packbits([i is None for i in ids]).tobytes(), n.tobytes(), zstandard.compress(b"".join(coded), 3)]
            block, start = block + 1, start + int(n.sum())
            ids, texts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["shard", "block", "start", "doc_ids", "nulls", "n_tokens", "ids"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 1
                if held >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return run


def write_token_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> None:
    """Encode all texts, append ``end_id`` to each, and write the files under ``folder``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = texts.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    blocks = cut(dealt.mapInArrow(_blocks(tokenizer, end_id, special_as_text), f"{HEAD}, ids binary"))
    kind = encoder(tokenizer).kind
    vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(zstandard.decompress(x), kind), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    times = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[times["id"].to_numpy(np.int64)] = times["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    code = spark.sparkContext.broadcast((lengths, codes(lengths)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [pack(np.frombuffer(zstandard.decompress(x), kind), *code.value) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([o.tobytes() for _, o in done], pa.binary()), pa.array([x for x, _ in done], pa.binary())], [*b.schema.names[:6], "offsets", "bits"])

    blocks.mapInArrow(encode, f"{HEAD}, offsets binary, bits binary").write.mode("overwrite").parquet(f"{folder}/blocks")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/code")
    sizes = _shard_sizes(spark, folder)
    first = np.r_[0, np.cumsum(sizes["n"].to_numpy(np.int64))]
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(sizes["shard"], first)], "shard int, first long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/shards")


def _shard_sizes(spark: SparkSession, folder: str) -> pd.DataFrame:
    """(shard, n) in order; there are as many as shuffle partitions at most."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(np.frombuffer(x, "<u4").sum()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["shard", "n"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "n_tokens")
    return blocks.mapInArrow(size, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).toPandas().sort_values("shard")


def read_token_ids(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids): ids are unsigned 32-bit little-endian, start counts the ids of all documents before."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first()[0]), np.uint8)
    first = {r["shard"]: r["first"] for r in spark.read.parquet(f"{folder}/shards").toLocalIterator()}
    shared = spark.sparkContext.broadcast((lengths, first))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value[0])
        for b in batches:
            for shard, start, ids, nulls, n, offsets, bits in zip(*(b.column(i).to_pylist() for i in range(7))):
                n = np.frombuffer(n, "<u4").astype(np.int64)
                got = unpack(bits, np.frombuffer(offsets, np.uint32), int(n.sum()), table).astype("<u4").tobytes()
                end = np.cumsum(n)
                at = shared.value[1][shard] + start + end - n
                null = np.unpackbits(np.frombuffer(nulls, np.uint8), count=len(n)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, "<i8"), mask=null), pa.array(at), pa.array(n), pa.array([got[4 * (e - k) : 4 * e] for e, k in zip(end.tolist(), n.tolist())], pa.binary())],
                    [id_col, "start", "n_tokens", "ids"],
                )

    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "start", "doc_ids", "nulls", "n_tokens", "offsets", "bits")
    return blocks.mapInArrow(decode, f"`{id_col}` long, start long, n_tokens long, ids binary")
