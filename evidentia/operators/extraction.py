"""Canonical texts kept in step with captures: only what changed is read again, and no text moves unasked.

Captures and stored texts meet by digests alone. A row whose capture is the one that its text was made from is left as
it is; only the others go through the readers, so a second run over an unchanged corpus reads no page. Quotations cite
characters of a stored text, so a text that would come out differently is refused and stays, unless the row is forced.

Outcomes: ``unchanged``; ``extracted`` (no text was stored); ``confirmed`` (a changed capture, the same text);
``forced`` (rewritten on demand); ``drifted`` (the stored text is not the recorded one, comes from another version of
the normalizer, or would change: nothing is written, and ``code`` is E-NORM-DRIFT); ``needs_extraction`` (no reader, or
an empty text); ``pending`` (no capture to read); ``failed`` (the capture failed; a stored text stays).

Defined results: null ids meet no stored text; a stored text without a capture is ``pending`` and stays; a stored text
without a recorded digest may be rewritten; of repeated ids in the stored texts the one with the largest digest counts;
repeated captures of an id are judged one by one; extra columns are not read; empty tables give the other side's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.store import cut
from .gates import NORMALIZER_VERSION

#: So many changed captures at most are named to all tasks; more are met by a shuffle.
FEW = 100_000
COLUMNS = ("source_id", "outcome", "code", "detail", "status", "text", "raw_sha256", "normalized_sha256", "normalizer_version")


def decide(captured: DataFrame, stored: DataFrame, force: Column | bool = False) -> DataFrame:
    """What is to be done for each source: ``step`` is unchanged, drifted, extract, failed or pending; ``old`` is what is stored, but for the text. No capture is read."""
    fields = F.struct("raw_sha256", "normalized_sha256", "normalizer_version", F.sha2("text", 256).alias("actual"))
    kept = stored.groupBy("source_id").agg(F.max_by(fields, F.coalesce("normalized_sha256", F.lit(""))).alias("old")).withColumn("actual", F.col("old.actual"))
    new = captured.select("source_id", F.col("raw_sha256").alias("new_raw"), F.col("status").alias("capture"), (F.lit(force) if isinstance(force, bool) else force).alias("force"), F.lit(True).alias("captured"))
    both = new.join(kept, "source_id", "full_outer").withColumn("recorded", F.nullif("old.normalized_sha256", F.lit("")))
    held = F.col("actual").isNotNull() & ~F.coalesce("force", F.lit(False))
    moved = held & ((F.col("recorded").isNotNull() & (F.col("recorded") != F.col("actual"))) | ~F.col("old.normalizer_version").eqNullSafe(F.lit(NORMALIZER_VERSION)))
    step = (
        F.when(F.col("captured").isNull(), F.when(moved, "drifted").otherwise("pending")).when(F.col("capture") == "failed", "failed").when(moved, "drifted")
        .when(held & F.col("old.raw_sha256").eqNullSafe(F.col("new_raw")), "unchanged").when(F.col("new_raw").isNull(), "pending").otherwise("extract")
    )
    return both.withColumn("step", step)


def extract(captured: DataFrame, stored: DataFrame, force: Column | bool = False) -> DataFrame:
    """``COLUMNS`` of every source after a run. ``captured``: (source_id, media_type, content, raw_sha256, status); ``stored``:
    (source_id, text, raw_sha256, normalized_sha256, normalizer_version). ``force`` may be a column of ``captured``.
    """
    met = cut(decide(captured, stored, force))  # digests only
    idle = met.filter("step <> 'extract'")
    stale = ~F.col("old.normalizer_version").eqNullSafe(F.lit(NORMALIZER_VERSION))
    why = F.when(F.col("step") == "drifted", F.when(stale, "made by another version of the normalizer").otherwise("its text is no longer the one that was recorded"))
    status = F.when(F.col("actual").isNotNull(), "ready").otherwise(F.col("step"))
    as_is = idle.select(
        "source_id", F.col("step").alias("outcome"), F.when(F.col("step") == "drifted", "E-NORM-DRIFT").alias("code"), why.alias("detail"), status.alias("status"), F.lit(None).cast("string").alias("text"),
        "old.raw_sha256", "old.normalized_sha256", "old.normalizer_version", F.col("actual").isNotNull().alias("__stays"),
    )

    due = met.filter("step = 'extract'").select(F.col("source_id").alias("__id"), F.col("new_raw").alias("__raw"), F.coalesce("force", F.lit(False)).alias("__force")).dropDuplicates(["__id", "__raw"])
    few = F.broadcast(due) if due.count() <= FEW else due  # then no content is shuffled
    same_row = F.col("source_id").eqNullSafe(F.col("__id")) & (F.col("raw_sha256") == F.col("__raw"))
    rows = captured.join(few, same_row).select("source_id", "media_type", "content", "status", "raw_sha256", "__force")
    read = files.route(rows.withColumnRenamed("source_id", "path"), "raw_sha256", "__force").withColumnRenamed("path", "source_id")
    before = met.filter("step = 'extract' and actual is not null").select("source_id", "old", "actual", "recorded").dropDuplicates(["source_id"])
    found = read.join(before, "source_id", "left").withColumn("sha", F.sha2("text", 256))
    blank, same = F.col("text").isNull() | ~F.col("text").rlike(r"\S"), F.col("sha") == F.col("actual")
    refused = F.col("recorded").isNotNull() & ~same
    outcome = F.when(blank, "needs_extraction").when(F.col("__force"), "forced").when(refused, "drifted").when(same, "confirmed").otherwise("extracted")
    judged = found.withColumn("outcome", outcome)
    stays, drifted = F.col("outcome").isin("needs_extraction", "drifted"), F.col("outcome") == "drifted"
    keep = lambda new, kept: F.when(~stays, new).otherwise(F.lit(None) if kept == "text" else F.col(f"old.{kept}")).alias(kept)
    done = judged.select(
        "source_id", "outcome", F.when(drifted, "E-NORM-DRIFT").alias("code"), F.when(drifted, "the capture gives another text, and a text that may be cited stays").alias("detail"),
        F.when(~stays | F.col("actual").isNotNull(), "ready").otherwise("needs_extraction").alias("status"), keep(F.col("text"), "text"), keep(F.col("raw_sha256"), "raw_sha256"),
        keep(F.col("sha"), "normalized_sha256"), keep(F.lit(NORMALIZER_VERSION), "normalizer_version"), (stays & F.col("actual").isNotNull()).alias("__stays"),
    )
    # rows whose stored text stays meet it here, once; the others carry a new one or none
    texts = stored.select("source_id", F.coalesce("normalized_sha256", F.lit("")).alias("__sha"), F.col("text").alias("__text")).dropDuplicates(["source_id", "__sha"])
    rows = as_is.unionByName(done).withColumn("__kept", F.coalesce("normalized_sha256", F.lit("")))
    same_text = F.col("__stays") & (F.col("source_id") == F.col("__source")) & (F.col("__kept") == F.col("__sha"))
    joined = rows.join(texts.withColumnRenamed("source_id", "__source"), same_text, "left")
    return joined.withColumn("text", F.when(F.col("__stays"), F.col("__text")).otherwise(F.col("text"))).select(*COLUMNS)


def findings(extracted: DataFrame) -> DataFrame:
    """The drifted rows as findings."""
    from .gates import finding

    return finding(extracted.filter("code is not null"), "normalizer", F.col("code"), "source_id", F.col("detail"))
