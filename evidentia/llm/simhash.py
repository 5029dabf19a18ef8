"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

A bit of a document's fingerprint is 1 where it is 1 in over half of the XXH64 hashes of its 4-word shingles,
repeats included. Fingerprints that differ in at most ``RADIUS`` bits link.

Equal fingerprints form a class, so copies are never compared. Classes are dealt into cells by the population
counts of their two halves: 33 x 33 cells, whatever the input. Two fingerprints differ in at least
|x - x'| + |y - y'| bits, so a cell meets 41 cells and the others are skipped; cells with many classes are dealt
into tiles of about ``TILE``. A pair of tiles is one row (two packed binaries), and the rows are spread by an
equi-join over tasks. Inside a task the tiles are sorted by the counts of their quarters and cut into runs; pairs of
runs whose counts differ by more than the radius are skipped too, the rest is compared by exclusive-or and bit
counts, all against all. A pair of tiles gives a star per component instead of its links, so at most one edge for
each of its fingerprints leaves a task; connected components join the stars.

The comparisons of pairs grow with the square of the number of different fingerprints, over the share of runs that
is not skipped; that is the method's cost, no pair within the radius is left out for it.

Defined results: A-Z are lower-cased; a text of 1 to 3 words is one shingle; null, empty and blank texts have
fingerprint zero, which links like any other. A null id is larger than any other: a component of null ids only has
a null component_id. Each row of a repeated id is judged by its own text. Other columns, whatever their names, are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import cut, join_groups, shuffle_partitions
from .words import Words, release, text_slices
from .xxh64 import xxh64_spans

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Classes of a tile, about: 128 KiB.
TILE = 1 << 14
#: Tiles that one tile meets under one key of the join, about; further ones have a key of their own.
MET = 64
#: Pairs of fingerprints compared at once, and links kept before they are joined to stars.
BLOCK = 1 << 18
#: Pairs of fingerprints, before runs are skipped, that one task should have.
TASK_PAIRS = 2_000_000_000
#: Shingles whose bits are counted at once.
COUNTED = 1 << 14


def _bits_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have bit 63 - i set, for each i."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = hashes[i : i + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """The fingerprints of texts (UTF-8; None counts as empty)."""
    words = Words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(words.start):
        return out
    length = words.end - words.start
    # the same words, held apart by one space
    inside = np.zeros(len(words.buf) + 1, np.int8)
    inside[words.start] += 1
    inside[np.minimum(words.end + 1, len(words.buf))] -= 1
    spaced = words.buf.copy()
    spaced[words.end] = 0x20
    data = spaced[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)].tobytes()
    end = np.cumsum(length + 1) - 1
    start = end - length
    for d in np.flatnonzero(words.n).tolist():
        first, last = int(words.first[d]), int(words.first[d + 1])
        width = min(SHINGLE, last - first)
        if last - first > COUNTED:  # a long text is hashed by itself, in parts
            n, total = last - first - width + 1, np.zeros(64, np.int64)
            for i in range(0, n, COUNTED):
                s = np.arange(first + i, first + min(n, i + COUNTED))
                total += _bits_of(xxh64_spans(data[start[s[0]] : end[s[-1] + width - 1]], start[s] - start[s[0]], end[s + width - 1] - start[s[0]], SEED))
            out[d] = np.packbits(2 * total > n).view(">u8")[0]
    short = np.flatnonzero((words.n > 0) & (words.n <= COUNTED))
    if len(short):
        width = np.minimum(SHINGLE, words.n[short])
        count = words.n[short] - width + 1
        cuts = np.r_[0, np.cumsum(count)]
        s = np.arange(cuts[-1]) + np.repeat(words.first[short] - cuts[:-1], count)
        hashes = xxh64_spans(data, start[s], end[s + np.repeat(width, count) - 1], SEED)
        for d, i, j in zip(short.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            out[d] = np.packbits(2 * _bits_of(hashes[i:j]) > j - i).view(">u8")[0]
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, texts in text_slices(b.column(1)):
            ids = b.column(0).slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fingerprints(texts).view(np.int64))], ["id", "fp"])
    release()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of longs as packed binaries."""
    for b in batches:
        lists = b.column(3)
        values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        packed = pa.array([values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["x", "y", "t", "fps"])


def stars(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, low, high = u[open_], v[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def _runs(fps: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by the counts of their quarters, where each run of equal counts begins, and its counts.

    Without ``split`` all are one run, which stands for any counts.
    """
    if not split:
        return fps, np.array([0, len(fps)]), np.zeros((1, 4), np.int16)
    counts = np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(counts.T)
    fps, counts = fps[order], counts[order]
    begin = np.r_[0, np.flatnonzero((counts[1:] != counts[:-1]).any(axis=1)) + 1] if len(fps) else np.zeros(0, np.int64)
    return fps, np.r_[begin, len(fps)].astype(np.int64), counts[begin]


def close_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with at most RADIUS bits between a[i] and b[j], a block at a time; both are sorted as by ``_runs``."""
    (a, cut_a, counts_a), (b, cut_b, counts_b) = a, b
    sizes = np.diff(cut_b)
    for k in range(len(counts_a)):
        met = np.abs(counts_b - counts_a[k]).sum(axis=1) <= RADIUS
        columns = np.flatnonzero(np.repeat(met, sizes))
        if not len(columns):
            continue
        other, step = b[columns], max(1, BLOCK // len(columns))
        for i in range(int(cut_a[k]), int(cut_a[k + 1]), step):
            rows = a[i : min(i + step, int(cut_a[k + 1]))]
            for j in range(0, len(other), BLOCK):
                x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ other[None, j : j + BLOCK]) <= RADIUS)
                if len(x):
                    yield x + i, columns[y + j]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (u, v), u > v, that connect what the links of each pair of tiles connect."""
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = np.frombuffer(left, "<u8"), None if right is None else np.frombuffer(right, "<u8")
            by_runs = len(a) * len(a if b is None else b) > BLOCK  # small tiles are compared whole
            a = _runs(a, by_runs)
            b = a if b is None else _runs(b, by_runs)
            nodes = a[0] if right is None else np.r_[a[0], b[0]]
            shift, u, v, held = 0 if right is None else len(a[0]), [], [], 0
            for i, j in close_pairs(a, b):
                other = i != j + shift
                u.append(i[other])
                v.append(j[other] + shift)
                held += len(u[-1])
                if held > BLOCK + len(nodes):
                    label = stars(len(nodes), np.concatenate(u), np.concatenate(v))
                    u, v = [np.flatnonzero(label != np.arange(len(nodes)))], [label[label != np.arange(len(nodes))]]
                    held = len(u[0])
            if held:
                label = stars(len(nodes), np.concatenate(u), np.concatenate(v))
                leaf = np.flatnonzero(label != np.arange(len(nodes)))
                ends = [nodes[leaf].view(np.int64), nodes[label[leaf]].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*ends)), pa.array(np.minimum(*ends))], ["u", "v"])
    release()


def links(classes: DataFrame) -> DataFrame:
    """(u, v): edges between different fingerprints ``classes.fp`` that connect all those within the radius."""
    spark = classes.sparkSession
    halves = classes.select("fp", F.expr("cast(bit_count(shiftrightunsigned(fp, 32)) as int) x"), F.expr("cast(bit_count(fp & 4294967295L) as int) y"))
    counts = {(r["x"], r["y"]): r["n"] for r in halves.groupBy("x", "y").agg(F.count("*").alias("n")).collect()}  # at most 33 x 33 rows
    if not counts:
        return spark.createDataFrame([], "u long, v long")
    cells = F.broadcast(spark.createDataFrame([(x, y, -(-n // TILE)) for (x, y), n in counts.items()], "x int, y int, tiles int"))
    dealt = halves.join(cells, ["x", "y"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    tiles = cut(dealt.groupBy("x", "y", "t").agg(F.collect_list("fp").alias("fps")).select("x", "y", "t", "fps").mapInArrow(_pack, "x int, y int, t int, fps binary"))

    # each pair of cells once: the second one is later in (x, y); pairs of tiles of one cell by their numbers
    near = [(i, j) for i in range(RADIUS + 1) for j in range(-RADIUS, RADIUS + 1) if i + abs(j) <= RADIUS and (i, j) >= (0, 0)]
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near))
    met = tiles.withColumn("step", F.explode(steps)).selectExpr("x + step.i x2", "y + step.j y2", "x", "y", "t", "step.i = 0 and step.j = 0 own", "fps a")
    met = met.join(cells.toDF("x2", "y2", "tiles"), ["x2", "y2"])
    met = met.withColumn("t2", F.explode(F.expr("sequence(if(own, t, 0), tiles - 1)")))
    pairs = sum(n * counts.get((x + i, y + j), 0) for (x, y), n in counts.items() for i, j in near)
    parts = max(shuffle_partitions(spark), -(-pairs // TASK_PAIRS))
    keys, folds = ["x2", "y2", "t2", "fold"], -(-len(near) * -(-max(counts.values()) // TILE) // MET)
    fold = F.pmod(F.hash("x", "y", "t"), F.lit(folds)).alias("fold")
    itself = F.col("own") & (F.col("t2") == F.col("t"))
    other = tiles.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), F.col("fps").alias("b"))
    apart = met.filter(~itself).select("x2", "y2", "t2", fold, "a").repartition(parts, *keys).join(other.repartition(parts, *keys), keys).select("a", "b")
    same = tiles.repartition(parts, "x", "y", "t").select(F.col("fps").alias("a"), F.lit(None).cast("binary").alias("b"))
    return apart.unionByName(same).mapInArrow(_links, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id, copies): a row per row of ``docs``; copies are the rows with its fingerprint."""
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint, "id long, fp long"))
    total = rows.count()
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    comp = components(cut(links(classes)).distinct()).toDF("fp", "label")
    labelled = cut(classes.join(comp, "fp", "left").select("fp", "least", "copies", F.coalesce("label", "fp").alias("label")))
    groups = labelled.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("__n"))
    found = join_groups(labelled, groups, "label", "__n", total).select("fp", "copies", "component")
    out = join_groups(rows, found, "fp", "copies", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"), "copies")
