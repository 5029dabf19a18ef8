"""Frozen seeds: sources as they were at one moment, kept by content and read at a pinned version.

A text is kept once, under the digest of its content, however many seeds hold it; a seed is a list of (source, digest)
and fields. Its id is a digest of that list which doesn't depend on the order of rows: counts and sums of parts of
SHA-256 values, so it is computed by partial aggregates and never sees a whole list. Freezing what is frozen already
writes no text and gives the same id. Reading a seed checks each text against its digest.

Defined results: null texts are listed without a text; a repeated (source, text) is listed as often as it is there; an
empty table is a seed too; texts that don't match their digest are findings, not errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

SHARDS = 256


def _digest(entries: DataFrame) -> str:
    """A digest of a multiset of rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(entries.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31, 46)]
    sums = entries.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"s{i}") for i, w in enumerate(words)))
    return sums.select(F.sha2(F.concat_ws("|", *sums.columns), 256).alias("id")).first()["id"]


def freeze(store: Store, sources: DataFrame, texts: DataFrame) -> str:
    """Keeps ``sources`` (source_id and fields) with ``texts`` (source_id, text) as a seed; returns its id."""
    dealt = texts.select("source_id", "text", F.sha2("text", 256).alias("digest"))
    listed = sources.join(dealt.select("source_id", "digest"), "source_id", "left")
    seed = _digest(listed)
    held = store.manifest()
    if f"seed_{seed}" in held:
        return seed
    shard = F.pmod(F.conv(F.substring("digest", 1, 4), 16, 10).cast("int"), F.lit(SHARDS))
    blobs = dealt.filter("text is not null").select("digest", "text").dropDuplicates(["digest"]).withColumn("shard", shard)
    names = [n for n in held if n.startswith("blobs_")]
    for name in names:  # each brought what those before it lacked
        blobs = blobs.join(store.read(name).select("digest"), "digest", "left_anti")
    store.publish({f"seed_{seed}": listed, f"blobs_{len(names):04d}": blobs}, partition={f"blobs_{len(names):04d}": ["shard"]})
    return seed


def seeds(store: Store) -> list[str]:
    return sorted(n.removeprefix("seed_") for n in store.manifest() if n.startswith("seed_"))


def thaw(spark: SparkSession, store: Store, seed: str, version: int | None = None) -> DataFrame:
    """The sources of a seed with ``text`` and ``code``: null, E-SEED-MISSING or E-SEED-CHANGED."""
    listed = store.read(f"seed_{seed}", version)
    blobs = None
    for name in sorted(n for n in store.manifest(version) if n.startswith("blobs_")):
        more = store.read(name, version).select("digest", "text")
        blobs = more if blobs is None else blobs.unionByName(more)
    joined = listed.join(blobs, "digest", "left")
    code = F.when(F.col("digest").isNotNull() & F.col("text").isNull(), "E-SEED-MISSING").when(F.sha2("text", 256) != F.col("digest"), "E-SEED-CHANGED")
    return joined.withColumn("code", code)
