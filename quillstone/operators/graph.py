"""Facts and tunnels as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = ("id", "subject", "predicate", "object", "confidence", "valid_from", "valid_to", "current")


def as_of(triples: DataFrame, at: str | None) -> DataFrame:
    """Facts valid at a time (half open, the flag ignored), or without a time those flagged current."""
    if at is None:
        return triples.where("current")
    t = F.lit(at).cast("timestamp_ntz")
    return triples.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def facts_about(triples: DataFrame, entity: str, direction: str = "both", at: str | None = None) -> DataFrame:
    """Incident facts with their direction; a loop appears once each way."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    valid = as_of(triples, at)
    out = valid.where(F.col("subject") == entity).select(F.lit("outgoing").alias("direction"), *FACT)
    into = valid.where(F.col("object") == entity).select(F.lit("incoming").alias("direction"), *FACT)
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def list_tunnels(tunnels: DataFrame, wing: str | None = None) -> DataFrame:
    return tunnels if wing is None else tunnels.where((F.col("source_wing") == wing) | (F.col("target_wing") == wing))


def follow_tunnels(tunnels: DataFrame, drawers: DataFrame, wing: str, room: str | None = None) -> DataFrame:
    """The other end of each tunnel at (wing, room), with a preview of its drawer; a loop is outgoing, once."""
    at = lambda side: (F.col(f"{side}_wing") == wing) & (F.lit(True) if room is None else F.col(f"{side}_room") == room)
    is_source = F.coalesce(at("source"), F.lit(False))
    other = lambda c: F.when(is_source, F.col(f"target_{c}")).otherwise(F.col(f"source_{c}"))
    ends = tunnels.where(is_source | at("target")).select(
        "id", F.when(is_source, "outgoing").otherwise("incoming").alias("direction"),
        other("wing").alias("wing"), other("room").alias("room"), other("drawer_id").alias("drawer_id"), "label", "kind",
    )
    wanted = drawers.join(ends.select(F.col("drawer_id").alias("id")).where("id <> ''").distinct(), "id", "left_semi")
    texts = wanted.groupBy("id").agg(F.min(F.substring("text", 1, 300)).alias("text")).withColumnRenamed("id", "drawer_id")
    return ends.join(texts, "drawer_id", "left").withColumn("preview", F.coalesce("text", F.lit(""))).drop("text")


def rooms_one_hop(drawers: DataFrame, start: str) -> DataFrame:
    """(room, hops): rooms that share a wing with the start room. One hop; hops is always 1."""
    pairs = drawers.select("wing", "room").distinct()
    wings = pairs.where(F.col("room") == start).select("wing")
    return pairs.where(F.col("room") != start).join(wings, "wing", "left_semi").select("room").distinct().withColumn("hops", F.lit(1))


def close_facts(triples: DataFrame, now: str, fact_id: str | None = None, triple: tuple[str, str, str] | None = None) -> DataFrame:
    """triples with the matching facts closed at `now`: by id or by (subject, predicate, object), not both.

    Facts closed before are closed again with the new time.
    """
    if (fact_id is None) == (triple is None) or (triple is not None and (len(triple) != 3 or None in triple)):
        raise ValueError("give either an id or a whole triple")
    if fact_id is not None:
        match = F.col("id") == fact_id
    else:
        match = (F.col("subject") == triple[0]) & (F.col("predicate") == triple[1]) & (F.col("object") == triple[2])
    match = F.coalesce(match, F.lit(False))
    return triples.withColumn("valid_to", F.when(match, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("valid_to"))).withColumn("current", F.when(match, False).otherwise(F.col("current")))
