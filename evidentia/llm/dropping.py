"""Dropping documents by id without shuffling the texts of those that stay for sure.

Defined results: null ids are one id (the empty string); rows whose id isn't named stay; an empty table gives no rows;
columns named ``__id``, ``__maybe`` and the like are the module's own, all others pass through.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .store import cut, join_groups


def id_key(column: str):
    """Ids as strings; a null id is an id of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("__id")


def flag_ids(docs: DataFrame, id_col: str, ids: DataFrame, n: int) -> DataFrame:
    """``docs`` with ``__id`` and ``__maybe``: false where a Bloom filter of the n ids in ``ids.__id`` rules the row out."""
    filter_, bits = bloom.members(ids, "__id", n)

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=bool)
        keys = bloom.words_of(pa.array([hashlib.sha256(x.encode()).digest() for x in s], pa.binary()))
        return pd.Series(bloom.test(filter_.value, bits, keys))

    return docs.withColumn("__id", id_key(id_col)).withColumn("__maybe", maybe("__id"))


def drop_linked(docs: DataFrame, found: DataFrame, row: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without ``row``, and of each component in ``found(row, component_id)`` only the first row.

    ``row`` tells rows apart, whatever their ids. First is the smallest id, a null id being larger than any
    other, then the smallest ``row``; of rows with the same ``row`` in a component one stays. Rows that are not
    in ``found`` stay. Only rows that the filter can't rule out are shuffled with their texts.
    """
    ids = docs.groupBy(row).agg(F.first(id_col).alias("__first_id"), F.count("*").alias("__copies"))
    nodes = cut(found.groupBy(row).agg(F.first("component_id").alias("__component")).join(ids, row))
    order = F.struct(F.col("__first_id").isNull(), F.col("__first_id"), F.col(row))
    groups = nodes.groupBy("__component").agg(F.min(order)[row].alias("__least"), F.sum("__copies").alias("__rows"), F.count("*").alias("__nodes")).filter("__rows > 1")
    linked = join_groups(nodes, groups, "__component", "__nodes", nodes.count())
    decided = cut(linked.select(id_key(row), (F.col(row) == F.col("__least")).alias("__kept")))
    flagged = flag_ids(docs, row, decided.select("__id"), decided.count())
    met = flagged.filter("__maybe").join(decided, "__id", "left")
    columns = [c for c in docs.columns if c != row]
    first = met.filter("__kept").dropDuplicates(["__id"])
    free = flagged.filter("not __maybe").select(*columns).unionByName(met.filter("__kept is null").select(*columns))
    return free.unionByName(first.select(*columns))
