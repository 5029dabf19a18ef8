"""Contradiction detection in linear time, adjudication, and what adjudications still owe.

Comparing all pairs of a topic is quadratic. A claim is in conflict with some other exactly if it is in
conflict with an extreme of its group, so minima and maxima by topic, joined back, find the same claims: numbers
against the group's least and greatest, dates and negation by whether the group's values differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import cluster_id
from ..functions.text import iso_dates, leading_number, negated

TOLERANCE, RECENCY_DAYS = 0.05, 180


def _apart(x: Column, y: Column, tolerance: float) -> Column:
    scale = F.greatest(F.abs(x), F.abs(y))
    return F.coalesce((scale > 0) & (F.abs(x - y) / scale > tolerance), F.lit(False))


def _extremes(name: str, x: Column) -> dict[str, Column]:
    return {f"{name}_lo": F.min(x), f"{name}_hi": F.max(x)}


def numeric(tolerance: float = TOLERANCE) -> tuple[dict[str, Column], Column]:
    x = F.when(F.col("kind") == "number", F.col("number"))
    return _extremes("number", x), _apart(x, F.col("number_lo"), tolerance) | _apart(x, F.col("number_hi"), tolerance)


def dated() -> tuple[dict[str, Column], Column]:
    x = F.when((F.col("kind") == "date") & (F.size("dates") > 0), F.array_join("dates", " "))
    return _extremes("dates", x), F.coalesce(x.isNotNull() & (F.col("dates_lo") != F.col("dates_hi")), F.lit(False))


def polarity() -> tuple[dict[str, Column], Column]:
    return _extremes("negated", F.col("negated")), F.col("negated_lo") != F.col("negated_hi")


def recency(days: int = RECENCY_DAYS) -> tuple[dict[str, Column], Column]:
    x = F.when(F.col("volatile"), F.try_to_date("as_of"))
    return _extremes("as_of", x), F.coalesce((F.date_diff(x, F.col("as_of_lo")) > days) | (F.date_diff(F.col("as_of_hi"), x) > days), F.lit(False))


#: Detectors by name: what to know of a topic, and a condition on a claim that knows it. Explicit links are found by a join.
DETECTORS: dict[str, Callable[[], tuple[dict[str, Column], Column]]] = {"numeric": numeric, "date": dated, "polarity": polarity, "recency": recency}


def register_detector(name: str, detector: Callable[[], tuple[dict[str, Column], Column]]) -> None:
    DETECTORS[name] = detector


def _linked(claims: DataFrame) -> DataFrame:
    """(id, topic_key) of claims that name another of their topic as contradicting, or are named."""
    edge = claims.select("topic_key", F.col("id").alias("a"), F.explode("contradicts").alias("b"))
    met = edge.join(claims.select("topic_key", F.col("id").alias("b")), ["topic_key", "b"]).filter("a <> b")
    return met.select("topic_key", F.explode(F.array("a", "b")).alias("id")).distinct()


def flags(claims: DataFrame) -> DataFrame:
    """Active claims of topics with two and more, with a column for each detector. A ``number`` or ``negated`` of the claims' own goes before what their text says."""
    active = claims.filter(F.coalesce("status", F.lit("active")) == "active")
    read = active.withColumns({
        "number": F.col("number") if "number" in claims.columns else leading_number(F.col("text")), "dates": iso_dates(F.col("text")),
        "negated": F.coalesce(F.col("negated") if "negated" in claims.columns else negated(F.col("text")), F.lit(False)), "volatile": F.coalesce("volatile", F.lit(False)),
    })
    detectors = {n: d() for n, d in DETECTORS.items()}
    known = {k: v for aggregates, _ in detectors.values() for k, v in aggregates.items()}
    # extremes are combined before the shuffle, so that a topic with very many claims costs a row a task
    topics = read.groupBy("topic_key").agg(F.count("*").alias("members"), *(v.alias(k) for k, v in known.items())).filter("members > 1")
    out = read.join(topics, "topic_key").withColumns({f"is_{n}": condition for n, (_, condition) in detectors.items()}).drop(*known)
    if "contradicts" in claims.columns:
        linked = _linked(active).withColumn("is_explicit", F.lit(True))
        return out.join(linked, ["topic_key", "id"], "left").withColumn("is_explicit", F.coalesce("is_explicit", F.lit(False)))
    return out.withColumn("is_explicit", F.lit(False))


def detect(claims: DataFrame, adjudications: DataFrame | None = None) -> DataFrame:
    """A row for each topic with a conflict: (cluster_id, topic_key, claim_ids, detectors, status, outcome, unadjudicated_claim_ids).

    Members are the claims involved. A cluster is resolved while its adjudication names all of them.
    """
    names = [*DETECTORS, "explicit"]
    found = F.array_compact(F.array(*(F.when(F.col(f"is_{n}"), F.lit(n)) for n in sorted(names))))
    involved = flags(claims).select("topic_key", "id", found.alias("found")).filter(F.size("found") > 0)
    clusters = involved.groupBy("topic_key").agg(F.array_sort(F.collect_set("id")).alias("claim_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("detectors")).withColumn("cluster_id", cluster_id(F.col("topic_key")))
    if adjudications is None:
        clusters = clusters.withColumns({"outcome": F.lit(None).cast("string"), "named": F.lit(None).cast("array<string>")})
    else:
        clusters = clusters.join(adjudications.select("cluster_id", "outcome", F.col("claim_ids").alias("named")), "cluster_id", "left")
    late = F.when(F.col("outcome").isNull(), F.array().cast("array<string>")).otherwise(F.array_except("claim_ids", F.coalesce("named", F.array().cast("array<string>"))))
    clusters = clusters.withColumn("unadjudicated_claim_ids", late)
    status = F.when(F.col("outcome").isNotNull() & (F.size("unadjudicated_claim_ids") == 0), "RESOLVED").otherwise("OPEN")
    return clusters.select("cluster_id", "topic_key", "claim_ids", "detectors", status.alias("status"), "outcome", "unadjudicated_claim_ids")


def open_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.filter("status = 'OPEN'")


def obligations(claims: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(id, cluster_id, new_status, new_confidence, new_superseded_by): what adjudications still change, one row a change.

    Adjudications act in the order of their cluster ids and only on claims still active, so a claim's status
    changes once, by the first that ends it; a claim becomes contested once, by the first that lets both stand
    before its end.
    """
    act = adjudications.select("cluster_id", "outcome", "winner", F.explode(F.array_distinct("claim_ids")).alias("id")).join(claims.select("id", "status", "confidence"), "id")
    has_winner = F.col("winner").isNotNull() & (F.col("winner") != "")
    ends = has_winner & F.col("outcome").isin("supersede", "retract") & (F.col("id") != F.col("winner"))
    act = act.filter("status = 'active'").withColumns({"ends": ends, "stands": (F.col("outcome") == "both_stand") & (F.col("confidence") != "contested")})
    by_claim = Window.partitionBy("id")
    act = act.withColumns({"end_at": F.min(F.when(F.col("ends"), F.col("cluster_id"))).over(by_claim), "stand_at": F.min(F.when(F.col("stands"), F.col("cluster_id"))).over(by_claim)})
    ended = F.col("ends") & (F.col("cluster_id") == F.col("end_at"))
    contested = F.col("stands") & (F.col("cluster_id") == F.col("stand_at")) & (F.col("end_at").isNull() | (F.col("cluster_id") < F.col("end_at")))
    return act.filter(ended | contested).select(
        "id", "cluster_id", F.when(ended & (F.col("outcome") == "supersede"), "superseded").when(ended, "retracted").alias("new_status"),
        F.when(contested, "contested").alias("new_confidence"), F.when(ended & (F.col("outcome") == "supersede"), F.col("winner")).alias("new_superseded_by"),
    )


def apply_outcomes(claims: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Claims as the recorded adjudications oblige."""
    owed = obligations(claims, adjudications).groupBy("id").agg(F.max("new_status").alias("s"), F.max("new_confidence").alias("c"), F.max("new_superseded_by").alias("b"))
    new = {"status": F.coalesce("s", "status"), "confidence": F.coalesce("c", "confidence")}
    if "superseded_by" in claims.columns:
        new["superseded_by"] = F.coalesce("b", "superseded_by")
    return claims.join(owed, "id", "left").withColumns(new).select(*claims.columns)


def unapplied(claims: DataFrame, adjudications: DataFrame) -> DataFrame:
    return obligations(claims, adjudications)
