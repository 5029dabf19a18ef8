"""Product codes of vectors by a delta-maintained Lloyd iteration in whole numbers.

A component x becomes floor(1024 x), a vector is cut into 4 parts, and each part has a codebook that starts as that
part of the first 256 vectors. A round assigns every part to its nearest entry and then moves each entry to the
componentwise floor of the mean of its parts.

Assignments are kept from round to round beside the vectors, in a checkpoint that replaces the one before, and the
sums and counts of all entries are running whole numbers. So a round shuffles only what changed: the rows whose
assignment is another one add their part to the new entry and take it from the old one; a task sends one delta for
each entry and position that it has touched, 4 x 256 entries at most. What reaches the driver is of the size of the
codebooks, whatever the input, and so is what is broadcast. Distances are exact: whole numbers below 2**53 in float64
matrix products, beyond that 64-bit whole numbers.

Defined results: rows whose vector is null, or holds a null, NaN or infinite component, are left out, and so are those
whose length isn't that of the first vector. First is the smallest id, a null id being larger than any other, then the
smallest vector; every row of a repeated id counts. With fewer than 256 vectors the codebooks are as much smaller. Of
equally near entries the first one is taken, an entry without parts stays. Where 4 doesn't divide the length, the last
parts are shorter. Components so large that a squared distance may leave 64 bits raise ValueError. Null labels are one
label. Other columns, whatever their names, are not read. No vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, forget, join_groups
from .words import release

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are held at once.
ROWS = 4096
TABLE = "id long, label string, vec binary, code binary, was binary"


def _whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE)


def _edges(length: int) -> list[slice]:
    width = -(-length // PARTS)
    return [slice(min(length, p * width), min(length, (p + 1) * width)) for p in range(PARTS)]


def _packed(most: int) -> str:
    return "<i4" if most < 2**31 else "<i8"


class Codebooks:
    """The entries of every part and their running sums, of a size that doesn't grow with the input."""

    def __init__(self, vectors: np.ndarray, most: int):
        if 4 * most * most * max(1, vectors.shape[1]) >= 2**63:
            raise ValueError(f"a component of {most / SCALE} is too large: squared distances leave 64 bits")
        self.length, self.parts, self.packed = vectors.shape[1], _edges(vectors.shape[1]), _packed(most)
        self.entries = [vectors[:, p].astype(np.int64) for p in self.parts]
        self.sums, self.counts = [np.zeros_like(e) for e in self.entries], np.zeros((PARTS, len(vectors)), np.int64)
        #: Whether float64 holds every sum of products.
        self.floats = 4 * most * most * max(1, self.length) < 2**53

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes (n, 4) of whole-number vectors, and the sums of their squared distances."""
        codes, error = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
        for p, (part, entries) in enumerate(zip(self.parts, self.entries)):
            step = ROWS if self.floats else max(1, ROWS // max(1, entries.shape[1]))
            for i in range(0, len(vectors), step):
                x = vectors[i : i + step, part].astype(np.int64)
                if self.floats:
                    x, e = x.astype(np.float64), entries.astype(np.float64)
                    far = (e * e).sum(axis=1)[None] - 2 * (x @ e.T)
                    own = (x * x).sum(axis=1)
                else:
                    far, own = ((x[:, None] - entries[None]) ** 2).sum(axis=2), np.zeros(len(x), np.int64)
                best = far.argmin(axis=1)
                codes[i : i + step, p] = best
                error[i : i + step] += (far[np.arange(len(x)), best] + own).astype(np.int64)
        return codes, error

    def move(self, deltas: list) -> None:
        """Takes in the changes (part, entry, position, change) of a round; position -1 is the count."""
        for part, entry, position, change in deltas:
            if position < 0:
                self.counts[part, entry] += change
            else:
                self.sums[part][entry, position] += change
        for entries, sums, counts in zip(self.entries, self.sums, self.counts):
            used = counts > 0
            entries[used] = sums[used] // counts[used, None]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _vectors(column: pa.Array, books: Codebooks) -> np.ndarray:
    return np.ndarray((len(column), books.length), books.packed, b"".join(column.to_pylist()) or bytes(8))


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x or bytes(PARTS) for x in column.to_pylist()), np.uint8).reshape(-1, PARTS)


def _blobs(rows: np.ndarray) -> pa.Array:
    width, data = rows.shape[1] * rows.itemsize, np.ascontiguousarray(rows).tobytes()
    return pa.array([data[i : i + width] for i in range(0, width * len(rows), width)] if width else [b""] * len(rows), pa.binary())


def _pack(packed: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _whole(b.column(2).flatten().to_numpy(zero_copy_only=False)).astype(packed)
            none = pa.nulls(b.num_rows, pa.binary())
            vectors = values.reshape(b.num_rows, -1) if len(values) else np.zeros((b.num_rows, 0), packed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _blobs(vectors), none, none], ["id", "label", "vec", "code", "was"])

    return pack


def _assign(books):
    """The rows with their new code; ``was`` is the one before."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, _ = books.value.nearest(_vectors(b.column(2), books.value))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _blobs(codes), b.column(3)], ["id", "label", "vec", "code", "was"])
        release()

    return assign


def _changes(books):
    """What rows with another code than before add to and take from the sums of entries, a task's changes in one."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        sums, counts = [np.zeros_like(e) for e in own.entries], np.zeros_like(own.counts)
        for b in batches:
            vectors, new, old = _vectors(b.column(0), own).astype(np.int64), _codes(b.column(1)), _codes(b.column(2))
            before = np.array([x is not None for x in b.column(2).to_pylist()], bool)
            for p, part in enumerate(own.parts):
                other = ~before | (new[:, p] != old[:, p])
                for code, rows, sign in ((new, other, 1), (old, other & before, -1)):
                    np.add.at(sums[p], code[rows, p], sign * vectors[rows, part])
                    np.add.at(counts[p], code[rows, p], sign)
        out = [(p, e, -1, n) for p, row in enumerate(counts.tolist()) for e, n in enumerate(row) if n]
        out += [(p, e, i, int(sums[p][e, i])) for p in range(PARTS) for e, i in zip(*(a.tolist() for a in np.nonzero(sums[p])))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "position", "change"])

    return changes


def _measure(books):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = books.value.nearest(_vectors(b.column(2), books.value))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _blobs(codes), pa.array(error)], ["id", "label", "code", "error"])
        release()

    return measure


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): a row per row of ``vectors`` that is kept."""
    spark = vectors.sparkSession
    vec, label = F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string")
    keyed = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), label), F.lit("")).alias("label"), vec)
    kept = keyed.filter("vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    order = (F.col("id").isNull(), "id", "vec")
    first = kept.orderBy(*order).select(F.size("vec").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], f"`{id_col}` long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.filter(F.size("vec") == first["n"])
    chosen = [r["vec"] for r in kept.orderBy(*order).select("vec").limit(ENTRIES).collect()]
    start = _whole(np.array(chosen, np.float64).reshape(len(chosen), first["n"]))
    most = int(kept.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(F.floor(x * SCALE).cast("double"))))).alias("m")).first()["m"] or 0)
    books = Codebooks(start, most)

    rows = cut(kept.mapInArrow(_pack(books.packed), TABLE))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(books)
        rows, last = cut(rows.mapInArrow(_assign(sent), TABLE)), rows
        forget(last)
        changed = rows.filter("not code <=> was").select("vec", "code", "was").mapInArrow(_changes(sent), "part int, entry int, position int, change long")
        books.move(changed.groupBy("part", "entry", "position").agg(F.sum("change").alias("change")).collect())  # at most the codebooks' size
        sent.unpersist()
    sent = spark.sparkContext.broadcast(books)
    coded = cut(rows.mapInArrow(_measure(sent), "id long, label string, code binary, error long"))
    forget(rows)
    groups = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    out = join_groups(coded, groups, "label", "__n", coded.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
