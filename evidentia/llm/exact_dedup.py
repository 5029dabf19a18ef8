"""Exact dedup by two-pass Bloom filtering.

Pass 1 hashes every text once (SHA-256 of the text with A-Z lower-cased) and counts the hashes in a
counting Bloom filter of bounded size, or one of each shard of the hashes where they are many. Pass 2 tests every hash: a hash that was seen once passes straight
through with its own id; only hashes that may repeat are shuffled, and those by (hash, id), never by text.

Defined results: a null text counts as empty. Of equal texts the row with the largest id stays; a null id
is smaller than any other; of rows with the same id and text exactly one stays. Other columns, whatever
their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .dropping import flag_ids, id_key
from .store import cut, join_groups


def lowered(text: str) -> Column:
    """A text as it is compared: null is empty, A-Z are lower-cased."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, rid, sha) per row: the SHA-256 of the normalised text and a number of the row's own."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2(lowered(text_col), 256)).alias("sha"))


def _flagged(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``maybe``: false where the filter shows that the hash occurs once.

    A filter of bounded size serves a bounded number of hashes, so with more of them the hashes are dealt into
    shards, each with a filter and a test of its own over the hashes alone; the share of single hashes that
    pass for repeated ones stays what it is for few.
    """
    shards = -(-n // bloom.CAPACITY)
    out = []
    for shard in range(max(1, shards)):
        own = rows if shards <= 1 else rows.filter(F.pmod(F.xxhash64("sha"), F.lit(shards)) == shard)
        filter_, bits = bloom.repeated(own, "sha", -(-n // max(1, shards)))

        def flag(batches: Iterator[pa.RecordBatch], filter_=filter_, bits=bits) -> Iterator[pa.RecordBatch]:
            packed = filter_.value
            for b in batches:
                on = bloom.test(packed, bits, bloom.words_of(b.column(2))) if b.num_rows else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(on)], ["id", "rid", "sha", "maybe"])

        out.append(own.mapInArrow(flag, "id long, rid long, sha binary, maybe boolean"))
    return reduce(DataFrame.unionByName, out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    rows = cut(digests(docs, id_col, text_col))
    n = rows.count()
    tested = _flagged(rows, n)
    maybe = tested.filter("maybe").drop("maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("id", "rid")).alias("last"), F.count("*").alias("group_size"))
    grouped = join_groups(maybe, groups, "sha", "group_size", n)
    out = grouped.select("id", F.col("last.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("last.rid")).alias("kept"), "sha")
    single = tested.filter("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return single.unionByName(out).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that another row repeats.

    Rows whose id isn't in a Bloom filter of the ids in groups of equal texts pass straight through; the
    others meet the ids to drop by a shuffled join. A null id counts as an id of its own.
    """
    found = cut(exact_dedup(docs.select(id_col, text_col), id_col, text_col).filter("group_size > 1").select(id_key(id_col), F.col("text_sha256").alias("__sha"), "kept"))
    flagged = flag_ids(docs, id_col, found.select("__id"), found.count())
    straight = flagged.filter("not __maybe").drop("__maybe", "__id")
    groups = found.groupBy("__id", "__sha").agg(F.max("kept").alias("__kept"))
    met = flagged.filter("__maybe").drop("__maybe").withColumn("__sha", F.sha2(lowered(text_col), 256)).join(groups, ["__id", "__sha"], "left").filter("coalesce(__kept, true)")
    # rows with one id and one text were one document twice: one of them stays
    kept = met.dropDuplicates(["__id", "__sha"])
    return straight.unionByName(kept.select(*docs.columns))
