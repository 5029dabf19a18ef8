"""Batches of records merged into a table in the order they came, with an outcome for every one of them.

The result is that of taking the rows one by one, found without a loop: of the rows of one key the first decides
whether it is new, the last what is kept. Both come from one aggregate by key, combined before the shuffle, so a key
that makes up most of a batch costs no more than any other.

Defined results: rows with a problem are refused and change nothing; rows with the same place in the order, or all where
the batch has no such column, are taken in an order of their content; null keys are refused; an empty batch leaves the table as it is; a table's own repeated
keys stay until a row replaces them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a known source that a new record of it refreshes; all others stay.
REFRESHED = ("retrieved_at", "tier", "tier_reason")


def _dealt(batch: DataFrame, key: str, order: str, problem: Column | None) -> tuple[DataFrame, DataFrame]:
    """The batch with ``__why`` (null where a row is taken) and ``__at``, and its keys with their first and last row."""
    why = F.when(F.col(key).isNull(), F.lit(f"no {key}"))
    why = F.coalesce(why, problem) if problem is not None else why
    rows = batch.withColumns({"__why": why, "__at": F.struct(F.col(order).alias("o"), F.xxhash64(*batch.columns).alias("h"))})
    taken = rows.filter("__why is null")
    ends = taken.groupBy(key).agg(F.min("__at").alias("__first"), F.max_by(F.struct(*batch.columns), "__at").alias("__last"), F.min_by(F.struct(*batch.columns), "__at").alias("__start"))
    return rows, ends


def _outcomes(rows: DataFrame, ends: DataFrame, known: DataFrame, key: str, order: str, again: str) -> DataFrame:
    """(order, key, outcome, detail) of every row of a batch."""
    status = ends.select(key, "__first").join(known.select(F.col(key), F.lit(True).alias("__known")).dropDuplicates([key]), key, "left")
    first = (F.col("__at") == F.col("__first")) & F.col("__known").isNull()
    outcome = F.when(F.col("__why").isNotNull(), "refused").when(first, "added").otherwise(again)
    return rows.join(status, key, "left").select(order, key, outcome.alias("outcome"), F.col("__why").alias("detail"))


def merge(table: DataFrame, batch: DataFrame, key: str, order: str, problem: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(``table`` with the last row of each key in place of those that it had, outcomes).

    ``order`` is a column of the batch; ``problem`` says why a row can't be taken, or is null. Outcomes are ``added``,
    ``replaced`` and ``refused``.
    """
    batch = batch if order in batch.columns else batch.withColumn(order, F.lit(0))
    rows, ends = _dealt(batch, key, order, problem)
    last = ends.select("__last.*").drop(order) if order not in table.columns else ends.select("__last.*")
    merged = table.join(ends.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)
    return merged, _outcomes(rows, ends, table, key, order, "replaced")


def merge_sources(known: DataFrame, batch: DataFrame, order: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(``known`` with the batch's new sources, outcomes).

    A source that is known already, or that the batch has had, only refreshes ``REFRESHED``, also with nulls. A row
    with an ``error`` is recorded as failed where its source is new; outcomes are ``added``, ``refreshed``, ``failed``
    and ``refused``.
    """
    batch = batch if order in batch.columns else batch.withColumn(order, F.lit(0))
    rows, ends = _dealt(batch, key, order, None)
    renewed = [c for c in REFRESHED if c in known.columns and c in batch.columns]
    last = ends.select(key, *(F.col(f"__last.{c}").alias(f"__{c}") for c in renewed), F.lit(True).alias("__met"))
    kept = known.join(last, key, "left").select(*(F.when(F.col("__met"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in renewed else F.col(c) for c in known.columns))
    fresh = ends.join(known.select(key), key, "left_anti")
    new = fresh.select(*(F.col(f"__last.{c}" if c in renewed else f"__start.{c}").alias(c) for c in batch.columns if c != order))
    outcomes = _outcomes(rows, ends, known, key, order, "refreshed")
    if "error" in batch.columns:
        new = new.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status") if "status" in batch.columns else F.lit("pending")))
        errors = rows.filter("error is not null").select(order, key, F.col("error").alias("__error")).dropDuplicates([order, key])
        met = outcomes.join(errors, [order, key], "left")
        outcomes = met.select(order, key, F.when((F.col("outcome") != "refused") & F.col("__error").isNotNull(), "failed").otherwise(F.col("outcome")).alias("outcome"), F.coalesce("detail", "__error").alias("detail"))
    return kept.unionByName(new, allowMissingColumns=True), outcomes
