"""N-gram Jaccard self-join with set-relation skipping: connected components at a similarity of 0.75.

A document's set is its distinct 5-word shingles. Equal sets form a class, so copies are never compared.
Prefix filtering is exact: in one global order of shingles (rare ones first, by grades of their counts in a
sketch of bounded size; the order bears on the work alone) two sets that link share a shingle among the first
|x| - ceil(0.75 |x|) + 1 of each.

Index level: the position of a shingle in a set of n bounds the size of a partner. With u shingles from there on,
a partner has at most ``cap`` = floor((7 u - 3 n) / 3), and two sets of one list may link only if each one's size is
within the other's cap. A list sorted by size is cut where a size exceeds all caps before it, so blocks of
postings are skipped without being read against each other; templates too small a share of their sets to link
them are cut into single postings.

Answer level: blocks with few possible pairs give those pairs. In a long, dense block no pairs are formed; it is
worked off in rounds. In a round some centres (1, then 64, then 1,024) are compared with the block's sets, which all
then know the centre's answer. Sets that are connected by now are never compared again, and a block whose sets
are all connected is done; so a block of copies of one text takes a round or two. From the second round on the answers of a pair are
derived, where they decide, from the overlaps of both with the block's first centre (its anchor): at most
min(s, t) + min(|x| - s, |y| - t) shingles and at least s + t - |anchor| are shared. Only pairs that these bounds
leave open are compared. All rounds are joins of rows: no task holds a block, and blocks meet no blocks. Dense
blocks of sets that are neither connected nor told apart by the bounds cost comparisons of all their pairs.

Defined results: A-Z are lower-cased; a text of 1 to 4 words is one shingle; null and empty texts have an
empty set and link with nothing, so they are their own component. A null id counts as larger than any other.
Rows are judged by their own texts: a repeated id doesn't connect its rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .components import components, contracted
from .store import cut, forget, join_groups
from .words import WINDOW_R, Words, mix, release, text_slices

SHINGLE = 5
#: Blocks with up to so many possible partners a posting are compared pair by pair.
FEW_PARTNERS = 8
#: Centres of a block by round, the last number again and again.
CENTRES = (1, 64, 1024)
#: Pairs of one centre that are compared in one place.
PAIRS_AT_ONCE = 200
#: Shingles counted by one cell of the sketch on average, and cells at most (a byte each is broadcast).
CELL_LOAD, MOST_CELLS, SEGMENT = 8, 1 << 26, 1 << 18
#: Postings of a shingle whose cell counts so many, and so many times the usual, don't meet in a bucket but are dealt by set.
HOT_LIST, HOT_TIMES = 1 << 15, 16
COUNT_AT_ONCE = 4 << 20
BUCKET_BYTES = 12 << 20
#: Stands for a null id.
NO_ID = 2**63 - 1
TOKEN_BITS = np.uint64(52)
#: Grades of frequency by which shingles are ordered, the rare ones first.
GRADES, HOT = 8, 0x80
POSTING = np.dtype([("token", "<u8"), ("cls", "<i8"), ("size", "<i4"), ("cap", "<i4")])


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash of 52 bits) sorted and distinct, and the size of each document's set."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at, s = w.windows(SHINGLE, h)
    doc = np.repeat(np.arange(len(texts)), w.n)
    few = np.flatnonzero((w.n > 0) & (w.n < SHINGLE))
    if len(few):
        own = []
        for d in few:
            v = 0
            for x in h[w.first[d] : w.first[d + 1]]:
                v = (v * int(WINDOW_R) + int(x)) % 2**64
            own.append((v * 31 + int(w.n[d])) % 2**64)
        doc, s = np.r_[doc[at], few], np.r_[s, mix(np.array(own, np.uint64))]
    else:
        doc = doc[at]
    key = doc.astype(np.uint64) << TOKEN_BITS | s >> (np.uint64(64) - TOKEN_BITS)  # texts come by 4,096 at most
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    doc, s = (key >> TOKEN_BITS).astype(np.int64), key & ((np.uint64(1) << TOKEN_BITS) - np.uint64(1))
    return doc, s, np.bincount(doc, minlength=len(texts))


def _classes(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    total = np.zeros(len(n), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(total, doc, mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    return mix(total + n.astype(np.uint64)).view(np.int64)


def _scan(cells: int):
    """Rows of kind 0: a document, its set's size and class; of kind 1: a segment of one task's sketch."""
    names, types = ["kind", "id", "n", "cls", "counts"], (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lots, held = np.zeros(cells, np.uint16), [], 0

        def add() -> None:
            at, times = np.unique(np.concatenate(lots), return_counts=True)
            counts[at] = np.minimum(counts[at] + times, 0xFFFF)

        for b in batches:
            for part, texts in text_slices(b.column(1)):
                doc, s, n = shingle_sets(texts)
                rows = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows), types[0]), b.column(0)[part], pa.array(n, types[2]), pa.array(_classes(doc, s, n), types[3]), pa.nulls(rows, types[4])], names)
                lots.append((s & np.uint64(cells - 1)).astype(np.uint32))
                held += len(s)
                if held >= COUNT_AT_ONCE:
                    add()
                    lots, held = [], 0
        if lots:
            add()
        salt = TaskContext.get().partitionId() // bloom.FAN_IN
        for k in range(0, cells, SEGMENT):
            own = counts[k : k + SEGMENT]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((1, k, salt, None, zstandard.compress(own.astype("<u4").tobytes(), 1)), types)], names)
        del counts
        release()

    return run


def _total(parts: pd.Series) -> np.ndarray:
    total = np.zeros(SEGMENT, np.int64)
    for x in parts:
        own = np.frombuffer(zstandard.decompress(x), "<u4")
        total[: len(own)] += own
    return total


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.minimum(_total(pdf["counts"]), 0xFFFFFFFF).astype("<u4")
    return pd.DataFrame({"id": [pdf["id"].iloc[0]], "n": [0], "counts": [zstandard.compress(total.tobytes(), 1)]})


def _grade(usual: float):
    """Grades of frequency from all partial counts of a segment, with the mark of hot cells; most are 0, so they pack well."""
    hot = max(HOT_LIST, HOT_TIMES * usual)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = _total(pdf["counts"])
        grades = np.clip(np.log2(np.maximum(counts, 1) / usual), 0, GRADES - 1).astype(np.uint8) | np.where(counts >= hot, HOT, 0).astype(np.uint8)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "grades": [zstandard.compress(grades.tobytes(), 1)]})

    return run


def _post(sketch: Broadcast, buckets: int):
    """Postings of the prefixes, packed for the bucket of each shingle; a class is posted once a lot.

    Those of hot shingles go to buckets of their own, from ``buckets`` on, by their class.
    """

    def flush(lot: list[np.ndarray], warm: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p, hot = np.concatenate(lot), np.concatenate(warm)
        bucket = np.where(hot, mix(p["cls"].view(np.uint64)), mix(p["token"])) % np.uint64(buckets) + hot * np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        p, cuts = p[by], np.searchsorted(bucket[by], np.arange(2 * buckets + 1).astype(np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        for i in range(0, len(full), 256):
            some = full[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([p[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = sketch.value
        seen, lot, warm, held = set(), [], [], 0
        for b in batches:
            for part, texts in text_slices(b.column(0)):
                doc, s, n = shingle_sets(texts)
                cls = _classes(doc, s, n)
                fresh = np.zeros(len(n), bool)
                for i, c in enumerate(cls.tolist()):
                    if n[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                grade = grades[(s & np.uint64(len(grades) - 1)).astype(np.int64)]
                by = np.argsort(doc.astype(np.uint16) * np.uint16(GRADES) + (grade & np.uint8(GRADES - 1)).astype(np.uint16), kind="stable")
                doc, s, hot = doc[by], s[by], grade[by] >= HOT
                first = np.r_[0, np.cumsum(n)]
                at = np.arange(len(s)) - first[doc]
                size = n[doc]
                keep = fresh[doc] & (at < size - (3 * size + 3) // 4 + 1)
                p = np.zeros(int(keep.sum()), POSTING)
                p["token"], p["cls"] = s[keep], cls[doc[keep]]
                p["size"], p["cap"] = size[keep], (7 * (size[keep] - at[keep]) - 3 * size[keep]) // 3
                lot.append(p)
                warm.append(hot[keep])
                held += len(p)
                if held >= COUNT_AT_ONCE // 4:
                    yield from flush(lot, warm)
                    seen, lot, warm, held = set(), [], [], 0
        if held:
            yield from flush(lot, warm)
        lot.clear()
        release()

    return run


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    a, b = np.minimum(x, y), np.maximum(x, y)
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def blocks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first posting of each block, each posting's block, and how many that follow it its cap admits; p is sorted by (token, size)."""
    of = np.cumsum(np.r_[0, p["token"][1:] != p["token"][:-1]]) << 33
    size, cap = of + p["size"], of + np.maximum(p["cap"], 0)
    reach = np.maximum.accumulate(cap)
    begin = np.flatnonzero(np.r_[True, size[1:] > reach[:-1]])
    after = np.maximum(np.searchsorted(size, cap, "right") - np.arange(len(p)) - 1, 0)
    return begin, np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(p)])), after


FOUND = "a long, b long, token long, block int, size int, cap int"


def _candidates(hot_from: int):
    """Rows (a, b) of classes to compare, and rows (a, token, block, size, cap) of postings in long blocks; ``block`` is the least size."""

    def run(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x, POSTING) for x in table.column("postings").to_pylist()])
        p = p[np.lexsort((p["cls"], p["token"]))]
        new = np.ones(len(p), bool)
        new[1:] = (p["token"][1:] != p["token"][:-1]) | (p["cls"][1:] != p["cls"][:-1])
        p = p[new]
        pairs, long, block = [], p, np.full(len(p), -1)
        if table.column("bucket")[0].as_py() < hot_from:
            p = p[np.lexsort((p["size"], p["token"]))]
            begin, of, after = blocks(p)
            few = (np.bincount(of, after) <= FEW_PARTNERS * np.bincount(of))[of]
            own = np.flatnonzero(few & (after > 0))
            for some in np.array_split(own, max(1, int(after[own].sum()) // 1_000_000)):
                n = after[some]
                i = np.repeat(some, n)
                j = i + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                ok = p["size"][i] <= p["cap"][j]
                pairs.append(_distinct([(p["cls"][i[ok]], p["cls"][j[ok]])]))
            long, block = p[~few], p["size"][begin][of[~few]]
        a, b = _distinct(pairs)
        del p
        release()
        ends = lambda x, kind: pa.concat_arrays([pa.nulls(len(a), kind), pa.array(x, kind)])
        return pa.table({
            "a": pa.array(np.r_[a, long["cls"]]), "b": pa.concat_arrays([pa.array(b), pa.nulls(len(long), pa.int64())]), "token": ends(long["token"].astype(np.int64), pa.int64()),
            "block": ends(block.astype(np.int32), pa.int32()), "size": ends(long["size"], pa.int32()), "cap": ends(long["cap"], pa.int32()),
        })

    return run


LIST = ["token", "block"]


def _cut_hot(postings: DataFrame) -> DataFrame:
    """Postings of hot shingles with their blocks, cut as ``blocks`` does, but from the caps of each size."""
    total = postings.count()
    if not total:
        return postings.select("cls", *LIST, "size", "cap")
    sizes = postings.groupBy("token", "size").agg(F.max("cap").alias("reach"), F.count("*").alias("__n"))
    order = Window.partitionBy("token").orderBy("size")
    first = F.col("size") > F.coalesce(F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    sizes = sizes.withColumn("first", F.when(first, F.col("size"))).withColumn("block", F.max("first").over(order)).select("token", "size", "block", "__n")
    return join_groups(postings.drop("block"), sizes, ["token", "size"], "__n", total).select("cls", *LIST, "size", "cap")


def _compared(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, c, sizes, same): the overlaps of the distinct ``pairs(a, c, sizes, n)``.

    ``n`` bounds the pairs of a centre c by the block in which they met; they are spread over so many places that
    each has some ``PAIRS_AT_ONCE``, and the centre's items go once to each.
    """
    place = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PAIRS_AT_ONCE))
    placed = pairs.select("a", "c", "sizes", place.alias("place"))
    centres = placed.select("c", "place").distinct().join(own.toDF("c", "items_c"), "c")
    both = placed.join(own.toDF("a", "items_a"), "a").join(centres, ["c", "place"]).select("a", "c", "sizes", "items_a", "items_c")
    return both.mapInArrow(_shared, "a long, c long, sizes int, same int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = np.zeros(b.num_rows, np.int32)
        for i, (x, y) in enumerate(zip(b.column(3), b.column(4))):
            both = np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")])
            both.sort()
            same[i] = (both[1:] == both[:-1]).sum()
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same)], ["a", "c", "sizes", "same"])


def _open(c: Column) -> Column:
    """May a posting's set link with the centre c, as far as labels, caps and what both share with the anchor tell?"""
    size, cap, s = F.col("size"), F.col("cap"), F.col("s")
    possible = (F.col("label") != c["label"]) & (size <= c["cap"]) & (c["size"] <= cap) & (~F.col("chosen") | (F.col("cls") < c["cls"]))
    most = F.least(s, c["s"]) + F.least(size - s, c["size"] - c["s"])
    return possible & F.coalesce(7 * most >= 3 * (size + c["size"]), F.lit(True))


def block_links(postings: DataFrame, own: DataFrame) -> DataFrame:
    """Edges (u, v) between classes: they connect all that links inside the blocks of ``postings(cls, token, block, size, cap)`` connect.

    ``own`` has each class's (cls, items). A class's label is a class that it is known to be connected to.
    """
    edges = postings.select(F.col("cls").alias("u"), F.col("cls").alias("v")).limit(0)
    held = ["cls", *LIST, "size", "cap", "label", "s", "anchor"]
    live = cut(postings.select("cls", *LIST, "size", "cap", F.col("cls").alias("label"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("anchor")))
    central = F.struct((F.col("cap") / F.col("size")).alias("central"), "cls", "size", "cap", "label", "s")
    for turn in count():
        most, total = CENTRES[min(turn, len(CENTRES) - 1)], live.count()
        if not total:
            return edges
        if turn:  # what is outside each block's largest part, in as many slots as the round has centres
            slot = F.when(F.col("rest") <= most, F.col("cls")).otherwise(F.pmod(F.xxhash64("cls"), F.lit(most)))
            chosen = live.filter("label <> top").groupBy(*LIST, slot.alias("slot")).agg(F.max(central).alias("c"), F.max("n").alias("n"), F.max("rest").alias("rest"))
        else:
            chosen = live.groupBy(*LIST).agg(F.max(central).alias("c"), F.count("*").alias("n"), F.count("*").alias("rest"))
        centres = cut(chosen.groupBy(*LIST).agg(F.collect_list("c").alias("centres"), F.max("n").alias("__n"), F.max("rest").alias("rest")))  # ``most`` at most
        met = join_groups(live.select(*held), centres.drop("rest"), LIST, "__n", total)
        met = met.withColumn("chosen", F.exists("centres", lambda x: x["cls"] == F.col("cls")))
        met = met.withColumn("c", F.explode(F.filter("centres", _open))).withColumn("sure", F.expr("coalesce(7 * (s + c.s - anchor) >= 3 * (size + c.size), false)"))
        pairs = cut(met.groupBy(F.col("cls").alias("a"), F.col("c.cls").alias("c")).agg(F.max("sure").alias("sure"), F.max(F.col("size") + F.col("c.size")).alias("sizes"), F.max("__n").alias("n")))
        same = cut(_compared(pairs.filter("not sure"), own))
        new = same.filter("7 * same >= 3 * sizes").select("a", "c").unionByName(pairs.filter("sure").select("a", "c")).toDF("u", "v")
        edges, before = contracted(edges.unionByName(new)), edges

        # the centres have met their block, and where they were all outside its largest part, so has everything
        now = edges.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("now"))
        gone = centres.select(*LIST, F.explode("centres.cls").alias("cls"))
        met = live.select(*held).join(now, "cls", "left").withColumn("label", F.coalesce("now", "label")).join(gone, ["cls", *LIST], "left_anti").select(*held)
        if not turn:  # each block's first centre is its anchor: its sets know what they share with it
            anchors = centres.select(*LIST, F.col("centres")[0]["cls"].alias("c"), F.col("centres")[0]["size"].alias("anchor"), "__n")
            met = join_groups(met.drop("s", "anchor"), anchors, LIST, "__n", total)
            met = met.join(same.select(F.col("a").alias("cls"), "c", F.col("same").alias("s")), ["cls", "c"], "left").select(*held)
        left = cut(met)
        labels = left.groupBy(*LIST, "label").agg(F.count("*").alias("n"))
        top = labels.groupBy(*LIST).agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).filter("labels > 1")
        if turn:
            top = top.join(centres.filter(F.col("rest") <= most).select(*LIST), LIST, "left_anti")
        top = top.select(*LIST, F.col("most.label").alias("top"), (F.col("n") - F.col("most.n")).alias("rest"), "n", F.col("n").alias("__n"))
        live, met = cut(join_groups(left, top, LIST, "__n", total).drop("__n")), live
        forget(before, centres, pairs, same, met, left)


def _overlap(kind: str):
    """Keeps pairs with 7 times the overlap at least 3 times the sum of the sizes, which is a similarity of 0.75."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                if kind == "<u8":
                    both = np.concatenate([x, y])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                else:  # several shingles may share 16 bits
                    same = int(np.minimum(np.bincount(x, minlength=1 << 16), np.bincount(y, minlength=1 << 16)).sum())
                ok.append(7 * same >= 3 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:4]], ["a", "ra", "b", "rb"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id), one row per row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(SEGMENT, 1 << (size // (6 * CELL_LOAD)).bit_length()))
    scan = cut(texts.mapInArrow(_scan(cells), "kind byte, id long, n long, cls long, counts binary"))
    rows = scan.filter("kind = 0").select("id", "n", "cls")
    total, shingles = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = scan.filter("kind = 1").select("id", "n", "counts")
    kind = "id long, n long, counts binary"
    grades = np.zeros(cells, np.uint8)
    usual = max(1.0, shingles / cells)
    if scan.rdd.getNumPartitions() > bloom.FAN_IN:
        parts = parts.groupBy("id", "n").applyInPandas(_merge, kind)
    for r in parts.groupBy("id").applyInPandas(_grade(usual), "id long, grades binary").collect():  # at most a byte a cell, packed
        grades[r["id"] : r["id"] + SEGMENT] = np.frombuffer(zstandard.decompress(bytes(r["grades"])), np.uint8)
    sketch = spark.sparkContext.broadcast(grades)

    classes = rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"))
    buckets = max(16, -(-size // BUCKET_BYTES))
    posted = texts.select("text").mapInArrow(_post(sketch, buckets), "bucket long, postings binary")
    found = cut(posted.groupBy("bucket").applyInArrow(_candidates(buckets), FOUND))

    def sets_of(nodes: DataFrame, n: int, exact: bool) -> DataFrame:
        """(cls, id, items) of the documents whose id is in ``nodes.rep``, and of few others."""
        filter_, bits = bloom.members(nodes, "rep", n)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed = filter_.value
            for b in batches:
                ids = b.column(0).to_numpy()
                own = np.flatnonzero(bloom.test(packed, bits, bloom.id_words(ids))) if len(ids) else []
                for part, texts in text_slices(b.column(1).take(pa.array(own, pa.int64()))):
                    doc, s, n = shingle_sets(texts)
                    first, items = np.r_[0, np.cumsum(n)], s if exact else (mix(s) >> np.uint64(48)).astype("<u2")
                    blobs = [items[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(_classes(doc, s, n)), pa.array(ids[own[part]]), pa.array(blobs, pa.binary())], ["cls", "id", "items"])

        return texts.mapInArrow(sets, "cls long, id long, items binary")

    # long blocks, in rounds
    postings = found.filter("b is null").withColumnRenamed("a", "cls")
    postings = postings.filter("block >= 0").select("cls", *LIST, "size", "cap").unionByName(_cut_hot(postings.filter("block < 0")))
    members = cut(postings.select("cls").distinct().join(classes.select("cls", "rep"), "cls"))
    own = sets_of(members, members.count(), True).withColumnRenamed("id", "rep").join(members, ["cls", "rep"], "left_semi")
    inside = block_links(postings, cut(own.dropDuplicates(["cls"]).select("cls", "items")))
    label = inside.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    label = cut(label.unionByName(inside.select("v", "v").toDF("node", "component").distinct().join(label, "node", "left_anti")))

    # pairs of other blocks, but for those that are connected already
    pairs = found.filter("b is not null").select("a", "b").distinct()
    pairs = pairs.join(label.toDF("a", "ga"), "a", "left").join(label.toDF("b", "gb"), "b", "left").filter("coalesce(ga <> gb, true)")
    rep = classes.select("cls", "rep")
    some = cut(pairs.join(rep.toDF("a", "ra"), "a").join(rep.toDF("b", "rb"), "b").select("a", "ra", "b", "rb"))
    for exact in (False, True):
        nodes = cut(some.select(F.explode(F.array("ra", "rb")).alias("rep")).distinct())
        own = sets_of(nodes, nodes.count(), exact)
        x, y = (own.select(F.col("cls").alias(c), F.col("id").alias(f"r{c}"), F.col("items").alias(f"items_{c}")) for c in "ab")
        both = some.join(x, ["a", "ra"]).join(y, ["b", "rb"]).select("a", "ra", "b", "rb", "items_a", "items_b")
        some = cut(both.mapInArrow(_overlap("<u8" if exact else "<u2"), "a long, ra long, b long, rb long"))

    comp = components(inside.unionByName(some.select(F.col("a").alias("u"), F.col("b").alias("v")))).toDF("cls", "label")
    labelled = cut(classes.join(comp, "cls", "left").select("cls", "rep", "copies", F.coalesce("label", "cls").alias("label")))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"), F.count("*").alias("__n"))
    groups = join_groups(labelled, least, "label", "__n", total).select("cls", "component", "copies")
    none = rows.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    linked = join_groups(rows.filter("n > 0"), groups, "cls", "copies", total).select("id", "n", "component")
    return none.unionByName(linked).select(F.expr(f"nullif(id, {NO_ID})").alias(id_col), F.col("n").alias("n_shingles"), F.expr(f"nullif(component, {NO_ID})").alias("component_id"))
