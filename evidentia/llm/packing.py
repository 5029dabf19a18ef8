"""Packing by non-negative least squares.

Documents are encoded into blocks. Full windows are cut off long documents; what is left of each document
is rounded up to a grain of 32 ids and counted by length. Shallow combinations of at most three distinct
lengths that fill a window exactly are enumerated, non-negative least squares finds how often to use each so
that the histogram is met, and the repeat counts are rounded down until no length is overdrawn. A document
takes its place by its rank among the documents of its length, so no task sees more than a block.

The residual documents (and as many others as the rounding up leaves room for) are packed greedily: laid end
to end they fill the gaps of the sequences in order, cut where a gap ends, and then further windows. Only
the last sequence is not full.

Defined results: a null text is empty, so it is the end id alone. Rows with the same id are separate
documents. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .tokens import encoder
from .words import as_bytes, release

WINDOW = 4096
GRAIN = 32
BLOCK_BYTES = 1 << 20
#: Neighbours summed by one task for running totals, and ids of gaps and residual documents matched by one.
RUN = 1 << 16
FULL = 0  # the "length" under which full windows are counted


def combinations(cells: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of repeats by length (0..cells): every way to fill ``cells`` with one or two lengths repeated or three lengths once."""
    has = np.zeros(cells + 1, bool)
    has[lengths] = True
    found = set()
    for a in lengths.tolist():
        for m in range(1, cells // a + 1):
            rest = cells - a * m
            if rest == 0:
                found.add(((a, m),))
            for b in range(1, rest + 1):
                if rest % b == 0 and b != a and has[b]:
                    found.add(tuple(sorted(((a, m), (b, rest // b)))))
        for b in range(a + 1, cells):
            c = cells - a - b
            if c > b and has[b] and has[c]:
                found.add(((a, 1), (b, 1), (c, 1)))
    out = np.zeros((len(found), cells + 1), np.int64)
    for i, parts in enumerate(sorted(found)):
        for length, times in parts:
            out[i, length] = times
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |a x - b| with x >= 0."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        passive[j] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = np.maximum(x + step * (s - x), 0)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
        x = s if passive.any() else x
    return np.maximum(x, 0)


def repeats(count: np.ndarray, used: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(combinations in use, how often) for ``count`` documents of each length in cells, ``used`` ids in all of them."""
    room = int((np.arange(cells + 1) * GRAIN * count).sum() - used.sum())
    share = room / max(1, room + int(used.sum()))  # of documents kept back to fill what the rounding leaves
    target = np.floor(count * (1 - share)).astype(np.int64)
    target[0] = 0
    lengths = np.flatnonzero(target)
    table = combinations(cells, lengths)
    if not len(table):
        return table, np.zeros(0, np.int64)
    scale = 1 / np.sqrt(np.maximum(target[lengths], 1))
    x = nnls(table[:, lengths].T * scale[:, None], target[lengths] * scale)
    times = np.floor(x + 1e-6).astype(np.int64)
    for length in lengths:
        over = int((table[:, length] * times).sum() - target[length])
        for j in np.argsort(-times, kind="stable") if over > 0 else ():
            if over <= 0:
                break
            if table[j, length] and times[j]:
                less = min(times[j], -(-over // table[j, length]))
                times[j] -= less
                over -= less * table[j, length]
    return table[times > 0], times[times > 0]


class Slots:
    """Where the documents of each length go, by rank."""

    def __init__(self, table: np.ndarray, times: np.ndarray, count: np.ndarray):
        base = np.r_[0, np.cumsum(times)]
        self.sequences = int(base[-1])
        self.of: dict[int, tuple] = {}
        self.slots = np.zeros(len(count), np.int64)
        for length in np.flatnonzero(table.sum(axis=0)) if len(table) else ():
            use = np.flatnonzero(table[:, length])
            begin = np.r_[0, np.cumsum(times[use] * table[use, length])]
            self.of[int(length)] = (begin, base[use], table[use, length])
            self.slots[length] = begin[-1]
        self.residual = np.r_[0, np.cumsum(count - self.slots)]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence or -1, place among its documents or number among the residual ones)."""
        sequence, place = np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        for n in np.unique(length).tolist():
            own = length == n
            r = rank[own]
            seq, at = np.full(len(r), -1), self.residual[n] + r - self.slots[n]
            if n in self.of:
                begin, base, times = self.of[n]
                j = np.minimum(np.searchsorted(begin, r, "right") - 1, len(base) - 1)
                inside = r < begin[-1]
                t = r - begin[j]
                seq = np.where(inside, base[j] + t // times[j], -1)
                at = np.where(inside, n * WINDOW + t % times[j], at)
            sequence[own], place[own] = seq, at
        return sequence, place


def _running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the total of ``value`` before each row in ``order``, which numbers rows densely from 0; runs of rows are summed apart."""
    df = df.withColumn("__run", F.floor(F.col(order) / RUN))
    runs = df.groupBy("__run").agg(F.sum(value).alias("__sum"))
    before = runs.select("__run", F.coalesce(F.sum("__sum").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__own", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(before, "__run").withColumn(name, F.col("__own") + F.col("__base")).drop("__run", "__own", "__base")


def _encode(path: str, end_id: int, special_as_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, block = encoder(path, special_as_text), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.kind).tobytes()
        ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, texts, held
            coded = [x + end for x in enc.encode(texts)]
            n = [len(x) // enc.kind.itemsize for x in coded]
            row = [part, block, np.array([i or 0 for i in ids], "<i8").tobytes(), np.packbits([i is None for i in ids]).tobytes(), np.array(n, "<i8").tobytes(), zstandard.compress(b"".join(coded), 3)]
            block, ids, texts, held = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["part", "block", "doc_ids", "nulls", "n", "ids"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 1
                if held >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()
        release()

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (part, block, row, full, rest, length) for each document of a block."""
    for b in batches:
        for part, block, n in zip(*(c.to_pylist() for c in b.columns)):
            n = np.frombuffer(n, "<i8")
            k, rest = len(n), n % WINDOW
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(k, part), np.full(k, block), np.arange(k), n // WINDOW, rest, -(-rest // GRAIN))], ["part", "block", "row", "full", "rest", "length"])


PIECE = "part long, block long, row long, start long, length long, sequence_id long, offset long"


def _fill(gap_total: int, first_sequence: int):
    """Lay residual documents into gaps; both are intervals of one line of ids, here those of one stretch of it."""

    def run(gaps: pa.Table, docs: pa.Table) -> pa.Table:
        g = {c: gaps.column(c).to_numpy() for c in ("from", "size", "sequence_id", "offset")}
        d = {c: docs.column(c).to_numpy() for c in ("part", "block", "row", "full", "from", "rest", "stretch")}
        if not len(d["from"]):
            return pa.table({c: pa.array([], pa.int64()) for c in ("part", "block", "row", "start", "length", "sequence_id", "offset")})
        lo, hi = int(d["stretch"][0]) * RUN, (int(d["stretch"][0]) + 1) * RUN
        gby, dby = np.argsort(g["from"]), np.argsort(d["from"])
        g, d = {k: v[gby] for k, v in g.items()}, {k: v[dby] for k, v in d.items()}
        windows = np.arange(max(0, -(-(lo - gap_total) // WINDOW)) * WINDOW + gap_total, hi, WINDOW)
        stop = min(hi, int((d["from"] + d["rest"]).max()))
        edge = np.unique(np.r_[lo, hi, stop, g["from"], d["from"], windows])
        edge = edge[(edge >= max(lo, int(d["from"].min()))) & (edge <= stop)]
        begin, length = edge[:-1], np.diff(edge)
        of = np.searchsorted(d["from"], begin, "right") - 1
        inner = begin < gap_total
        out = {c: d[c][of] for c in ("part", "block", "row")}
        out["start"] = d["full"][of] * WINDOW + begin - d["from"][of]
        out["length"] = length
        sequence, offset = first_sequence + (begin - gap_total) // WINDOW, (begin - gap_total) % WINDOW
        if inner.any():
            at = np.searchsorted(g["from"], begin[inner], "right") - 1
            sequence[inner], offset[inner] = g["sequence_id"][at], g["offset"][at] + begin[inner] - g["from"][at]
        return pa.table(out | {"sequence_id": sequence, "offset": offset})

    return run


def _cut_pieces(kind: str):
    def run(block: pa.Table, pieces: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0].as_py() for c in ("doc_ids", "nulls", "n", "ids")}
        n = np.frombuffer(row["n"], "<i8")
        ids, first = np.frombuffer(zstandard.decompress(row["ids"]), kind).astype("<u4"), np.r_[0, np.cumsum(n)]
        null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(n)).astype(bool)
        p = {c: pieces.column(c).to_numpy() for c in ("row", "start", "length", "sequence_id", "offset")}
        at = first[p["row"]] + p["start"]
        return pa.table({
            "id": pa.array(np.frombuffer(row["doc_ids"], "<i8")[p["row"]], mask=null[p["row"]]),
            "start": p["start"], "length": p["length"], "doc_tokens": n[p["row"]], "sequence_id": p["sequence_id"], "offset": p["offset"],
            "ids": pa.array([ids[i : i + k].tobytes() for i, k in zip(at.tolist(), p["length"].tolist())], pa.binary()),
        })

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """A row (id_col, start, length, doc_tokens, sequence_id, offset, ids) for each piece; ids are unsigned 32-bit little-endian."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = cut(texts.mapInArrow(_encode(tokenizer, end_id, special_as_text), "part long, block long, doc_ids binary, nulls binary, n binary, ids binary"))
    kind = encoder(tokenizer).kind.str
    rows = cut(blocks.select("part", "block", "n").mapInArrow(_lengths, "part long, block long, row long, full long, rest long, length long"))

    cells = WINDOW // GRAIN
    count, used = np.zeros(cells + 1, np.int64), np.zeros(cells + 1, np.int64)
    for r in rows.filter("rest > 0").groupBy("length").agg(F.count("*").alias("n"), F.sum("rest").alias("ids")).collect():  # at most ``cells`` rows
        count[r["length"]], used[r["length"]] = r["n"], r["ids"]
    windows = rows.agg(F.sum("full")).first()[0] or 0
    slots = spark.sparkContext.broadcast(Slots(*repeats(count, used, cells), count))
    packed = slots.value.sequences

    # ranks: counts by (length, part, block) are summed along blocks and parts, then along the rows of a block
    each = rows.filter("rest > 0").groupBy("length", "part", "block").agg(F.count("*").alias("n"))
    each = each.unionByName(rows.filter("full > 0").groupBy("part", "block").agg(F.sum("full").alias("n")).withColumn("length", F.lit(FULL).cast("long")))
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = each.groupBy("length", "part").agg(F.sum("n").alias("n")).select("length", "part", earlier("length", "part").alias("before"))
    base = each.withColumn("inner", earlier("length", "part", "block")).join(parts, ["length", "part"]).select("length", "part", "block", (F.col("inner") + F.col("before")).alias("base"))

    in_block = Window.partitionBy("part", "block", "length").orderBy("row")
    ranked = rows.filter("rest > 0").withColumn("own", F.row_number().over(in_block) - 1).join(base, ["length", "part", "block"]).withColumn("rank", F.col("own") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, at = slots.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(at)], [*b.schema.names, "sequence_id", "place"])

    placed = cut(ranked.select("part", "block", "row", "full", "rest", "length", "rank").mapInArrow(place, "part long, block long, row long, full long, rest long, length long, rank long, sequence_id long, place long"))
    fitted = placed.filter("sequence_id >= 0")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    direct = fitted.select(
        "part", "block", "row", (F.col("full") * WINDOW).alias("start"), F.col("rest").alias("length"), (F.col("sequence_id") + windows).alias("sequence_id"),
        F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("offset"),
    )

    gaps = cut(_running(fitted.groupBy("sequence_id").agg((WINDOW - F.sum("rest")).alias("size"), F.sum("rest").alias("offset")), "sequence_id", "size", "from"))
    gaps = gaps.filter("size > 0").withColumn("sequence_id", F.col("sequence_id") + windows)
    gap_total = gaps.agg(F.sum("size")).first()[0] or 0
    residual = _running(placed.filter("sequence_id < 0"), "place", "rest", "from")
    stretch = lambda df, size: df.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from") / RUN), F.floor((F.col("from") + F.col(size) - 1) / RUN))))
    filled = (
        stretch(gaps, "size").groupBy("stretch").cogroup(stretch(residual, "rest").select("part", "block", "row", "full", "from", "rest", "stretch").groupBy("stretch"))
        .applyInArrow(_fill(gap_total, windows + packed), PIECE)
    )

    in_rows = Window.partitionBy("part", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        rows.filter("full > 0").withColumn("own", F.coalesce(F.sum("full").over(in_rows), F.lit(0))).join(base.filter(F.col("length") == FULL).drop("length"), ["part", "block"])
        .select("part", "block", "row", (F.col("own") + F.col("base")).alias("first"), F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("full"))).alias("k", "_"))
        .select("part", "block", "row", (F.col("k") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    pieces = whole.unionByName(direct).unionByName(filled)
    out = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return blocks.groupBy("part", "block").cogroup(pieces.groupBy("part", "block")).applyInArrow(_cut_pieces(kind), out).withColumnRenamed("id", id_col)
