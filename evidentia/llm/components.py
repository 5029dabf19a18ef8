"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all distributed.

Defined results: edges from a node to itself, and repeated ones, change nothing, and a node with no other edge
has no row; edges with a null end are left out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, forget, join_groups


def contracted(edges: DataFrame) -> DataFrame:
    """One step: edges (u, v) with u > v that connect what ``edges`` connect, nearer to stars around smallest nodes; a checkpoint.

    A node may have most of all edges, so in the small-star nodes meet their edges by ``join_groups``.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # large-star: each larger neighbour of u is tied to the smallest of u and its neighbours
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    # small-star: u and its smaller neighbours are tied to the smallest of them
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_groups(large, least, "u", "n", large.count()).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    done = cut(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    forget(large)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``: component is the smallest node reachable."""
    e, before = edges, None
    while True:
        e, last = contracted(e), e
        if before is not None:
            forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
