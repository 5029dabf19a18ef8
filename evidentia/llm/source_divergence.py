"""How far the words of each source are from those of its language and of the language's other sources.

Each (lang, source) group and each language gives a kept term the smoothed share
p = 1 + floor(10**9 (count + 2) / (N + 2 V)); the divergence of two shares is f = floor((p - q)**2 / (p + q)).

``term`` rows are the terms that a group uses most beyond its language, found by an upper-bound search. A group's
terms lie in buckets by count; f grows with the group's share and falls with the language's, so the largest share and
the smallest language share of a bucket bound all its terms. Buckets are evaluated best bound first, in turns that
hold four times as many terms each, for all groups at once; a group is done as soon as the bounds of what is left are
strictly below its k-th value. So rare terms, most of any vocabulary, are seldom evaluated.

``pair`` rows are sums of f over all V terms for each two sources of a language. Let p0 be the share of a term that a
source lacks. A term that both lack gives f(p0, p0'), one that only the first has f(p, p0'); these are known from counts
and from how often each count occurs. Postings, the sources of one term, give what is left: for the terms that both
have, f(p, p') - f(p, p0') - f(p0, p') + f(p0, p0'). Postings are cut into blocks of 64 sources, and a task sends one
number for each pair of sources, so no task holds all sources of a term.

Defined results: null text, lang and source count as ''. A term is a run of letters A-Z, a-z and of characters beyond
ASCII; only A-Z are lower-cased. A language keeps the terms of at least ``LEAST`` of its documents; repeated rows are
documents of their own. Groups without terms take part; without kept terms (V = 0) all values of pairs are 0. Equal
values rank by the UTF-8 of the item. Other columns, whatever their names, are not read. An empty table gives no rows.
All numbers are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, forget
from .words import as_bytes, release

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text whose terms are listed at once, and counted terms that a task holds, about.
PIECE, HELD = 1 << 20, 500_000
#: A counted term is one number, occurrences and documents times this.
DOCUMENT = 1 << 40
#: Sources of a block of postings, and pairs of blocks that a task holds.
BLOCK, BLOCKS = 64, 256
#: Groups, or buckets of them, up to this number are broadcast; more are joined by a shuffle.
FEW = 100_000


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            after = BREAK.search(text, at + PIECE)
            end = after.start() if after else end
        yield text[at:end] if at or end < len(text) else text
        at = end


def _count(held: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, n, docs): occurrences and documents, those of a task added up as far as memory is given."""
        groups = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for group, found in groups.items():
                packed = np.fromiter(found.values(), np.int64, len(found))
                columns = [pa.array([g] * len(found), pa.string()) for g in group]
                columns.append(pa.array(list(found), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(packed % DOCUMENT), pa.array(packed // DOCUMENT)], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, group in enumerate(zip(langs, sources)):
                text = as_bytes(b.column(2).slice(i, 1))[0]
                if not text:
                    continue
                own = Counter()
                for piece in _pieces(text.lower()):
                    own.update(TERM.findall(piece))
                found = groups.setdefault(group, {})
                seen = found.get
                for term, n in own.items():
                    found[term] = seen(term, 0) + n + DOCUMENT
                if sum(map(len, groups.values())) > held:
                    yield from rows()
        yield from rows()
        release()

    return count


def share(n: Column, total: str, terms: str = "terms") -> Column:
    """p of a count, in whole numbers of 38 digits."""
    return F.call_function("div", (n + 2).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")) + 1


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _near(df: DataFrame, n: int) -> DataFrame:
    """To be broadcast where it is small."""
    return F.broadcast(df) if n <= FEW else df


def counted(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, term, source, n, total, once): the kept terms of each group; ``once`` is 1 in one row of each (lang, term)."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    found = plain.mapInArrow(_count(HELD), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    term = Window.partitionBy("lang", "term")
    sums = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = sums.select("lang", "term", "source", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"), F.min("source").over(term).alias("least"))
    return whole.filter(F.col("docs") >= LEAST).select("lang", "term", "source", "n", "total", (F.col("source") == F.col("least")).cast("long").alias("once"))


def _sum_pairs(block: int, blocks: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, a, b, value): what terms that both sources have add to their pair, a < b, summed over a task."""
        held = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), values in held.items():
                a, b = np.nonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + i * block), pa.array(b + j * block), pa.array(values[a, b])], ["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            lists = [(columns[name].values.to_numpy(), columns[name].offsets.to_numpy()) for name in ("k", "p", "p0", "k2", "p2", "p02")]
            for row, key in enumerate(zip(columns["lang"].to_pylist(), columns["i"].to_pylist(), columns["j"].to_pylist())):
                k, p, p0, k2, p2, p02 = (v[c[row] : c[row + 1]] for v, c in lists)
                p, p0, p2, p02 = p[:, None], p0[:, None], p2[None], p02[None]
                value = _f(p, p2) - _f(p, p02) - _f(p0, p2) + _f(p0, p02)
                if key[1] == key[2]:
                    value = np.where(k[:, None] < k2[None], value, 0)
                if key not in held:
                    if len(held) >= blocks:
                        yield from rows()
                    held[key] = np.zeros((block, block), np.int64)
                held[key][k[:, None], k2[None]] += value
        yield from rows()

    return sums


def _pairs(posted: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways."""
    sources = groups.select("lang", F.expr(f"k div {BLOCK}").alias("block"), "k", "p0", "kept", "terms")
    blocks = sources.groupBy("lang", "block").agg(F.collect_list(F.struct("k", "p0", "kept")).alias("others"))  # at most BLOCK
    every = groups.select("lang", "k", "p0", "kept", "terms", F.explode(F.expr(f"sequence(0, (sources - 1) div {BLOCK})")).alias("block"))
    base = every.join(blocks, ["lang", "block"]).select("lang", "k", "p0", "kept", "terms", F.explode("others").alias("o")).filter("k < o.k")
    value = f"if(terms = 0, 0L, (terms - kept - o.kept) * ({divergence('p0', 'o.p0')}))"
    parts = [base.select("lang", F.col("k").alias("a"), F.col("o.k").alias("b"), F.expr(value).alias("value"))]

    counts = posted.groupBy("lang", "k", "sources", "p").agg(F.count("*").alias("times"))
    spread = counts.withColumn("block", F.explode(F.expr(f"sequence(0, (sources - 1) div {BLOCK})")))
    alone = spread.join(blocks, ["lang", "block"]).select("lang", "k", "p", "times", F.explode("others").alias("o")).filter("k <> o.k")
    parts.append(alone.selectExpr("lang", "least(k, o.k) a", "greatest(k, o.k) b", f"times * ({divergence('p', 'o.p0')}) value"))

    own = posted.groupBy("lang", "term", F.expr(f"k div {BLOCK}").alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.expr(f"k % {BLOCK}").alias("k"), "p", "p0"))).alias("at"))
    own = own.select("lang", "term", "i", *(F.col(f"at.{c}").alias(c) for c in ("k", "p", "p0")))
    other = own.select("lang", "term", F.col("i").alias("j"), *(F.col(c).alias(a) for c, a in (("k", "k2"), ("p", "p2"), ("p0", "p02"))))
    columns = ["lang", "i", "j", "k", "p", "p0", "k2", "p2", "p02"]
    inside = own.selectExpr("lang", "i", "i j", "k", "p", "p0", "k k2", "p p2", "p0 p02")
    met = inside.select(*columns).unionByName(own.join(other, ["lang", "term"]).filter("i < j").select(*columns))
    parts.append(met.mapInArrow(_sum_pairs(BLOCK, BLOCKS), "lang string, a long, b long, value long"))

    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = _near(groups.select("lang", F.col("k").alias("a"), "source"), n_groups)
    named = whole.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    return named.select("lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")).select("lang", "s.source", "s.item", "value")


def _terms(posted: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of the TOP terms of each group."""
    spark, group = posted.sparkSession, ["lang", "source"]
    log = "(length(bin(n)) - 1)"
    bucket = F.expr(f"if(n < 16, n, 8 * {log} + shiftright(n, {log} - 3) % 8)")  # single counts, then eight buckets an octave
    over = posted.filter("p > q").withColumn("bucket", bucket).select(*group, "bucket", "term", "p", "q")
    bounds = over.groupBy(*group, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("n")).withColumn("bound", F.expr(divergence("p", "q")))
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("n").over(best), F.lit(0))
    # the turn of a bucket: 0 while fewer than TOP terms come before it, then a turn for each four times as many
    left = cut(bounds.select(*group, "bucket", "bound", seen.alias("seen")).selectExpr(*group, "bucket", "bound", f"cast(if(seen < {TOP}, 0, 1 + floor(log(4, seen / {TOP}))) as int) turn"))
    rank = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    top = spark.createDataFrame([], "lang string, source string, item string, value long, rank int")
    while True:
        now = left.agg(F.min("turn")).first()[0]
        if now is None:
            return top
        turn = left.filter(F.col("turn") == now).select(*group, "bucket")
        found = over.join(_near(turn, turn.count()), [*group, "bucket"]).select(*group, F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
        top, before = cut(top.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= TOP)), top
        kth = top.filter(F.col("rank") == TOP).select(*group, F.col("value").alias("kth"))
        left, last = cut(left.filter(F.col("turn") > now).join(kth, group, "left").filter("kth is null or bound >= kth").drop("kth")), left
        forget(before, last)


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other sources, part ``term`` the TOP terms."""
    postings = cut(counted(docs, lang, source, text))
    empty = F.lit("")
    named = docs.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source")).distinct()
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("kept"))
    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum("once").alias("terms"))
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    by = Window.partitionBy("lang")
    groups = groups.withColumn("k", F.row_number().over(by.orderBy("source")).cast("long") - 1).withColumn("sources", F.count("*").over(by))
    groups = cut(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), "size"))))
    n_groups = groups.count()
    posted = postings.join(_near(groups, n_groups), ["lang", "source"]).withColumns({"p": share(F.col("n"), "size"), "q": share(F.col("total"), "lang_size")})
    posted = cut(posted.select("lang", "source", "k", "sources", "term", "n", "p", "p0", "q"))
    forget(postings)
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(posted, groups, n_groups).withColumn("rank", F.row_number().over(rank)).withColumn("part", F.lit("pair"))
    out = pairs.unionByName(_terms(posted).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
