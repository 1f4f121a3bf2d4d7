"""Counts over the store, and rooms shared between wings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logical(drawers: DataFrame) -> DataFrame:
    return drawers.where(F.col("parent_drawer_id").isNull())


def status(drawers: DataFrame) -> DataFrame:
    """(level, name, n): all rows (also none), rows by wing and rows by room, the last two in one pass."""
    total = drawers.agg(F.count("*").alias("n")).select(F.lit("total").alias("level"), F.lit("").alias("name"), "n")
    by = drawers.groupingSets([("wing",), ("room",)], "wing", "room").agg(F.grouping("room").alias("g"), F.count("*").alias("n"))
    wing = F.col("g") == 1
    return total.unionByName(by.select(F.when(wing, "wing").otherwise("room").alias("level"), F.when(wing, F.col("wing")).otherwise(F.col("room")).alias("name"), "n"))


def list_wings(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing").agg(F.count("*").alias("n"))


def taxonomy(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy("wing", "room").agg(F.count("*").alias("n"))


def taxonomy_nested(drawers: DataFrame) -> DataFrame:
    """(wing, rooms map<string,bigint>)."""
    return taxonomy(drawers).groupBy("wing").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("room", "n")))).alias("rooms"))


def shared_rooms(drawers: DataFrame, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
    """(room, wings, wing_count): rooms in at least two wings. The wings filter only if both are given."""
    out = (
        drawers.select("room", "wing").distinct().groupBy("room").agg(F.sort_array(F.collect_set("wing")).alias("wings"))
        .withColumn("wing_count", F.size("wings").cast("long"))
        .where("wing_count >= 2")
    )
    if wing_a and wing_b:
        out = out.where(F.array_contains("wings", wing_a) & F.array_contains("wings", wing_b))
    return out


def room_graph_stats(drawers: DataFrame) -> DataFrame:
    """(rooms, shared_rooms, connections) in one row."""
    per = drawers.select("room", "wing").distinct().groupBy("room").agg(F.count("wing").alias("w"))
    return per.agg(F.count("*").alias("rooms"), F.count_if(F.col("w") >= 2).alias("shared_rooms"), F.coalesce(F.sum(F.when(F.col("w") >= 2, F.col("w"))), F.lit(0)).alias("connections"))


def endpoint_count(drawers: DataFrame, wing: str, room: str) -> DataFrame:
    return drawers.where((F.col("wing") == wing) & (F.col("room") == room)).agg(F.count("*").alias("n"))


def fact_stats(triples: DataFrame) -> DataFrame:
    """(entities, triples, current, expired); a null flag is in neither of the last two."""
    entities = triples.select(F.col("subject").alias("e")).union(triples.select("object")).where("e is not null").distinct().agg(F.count("*").alias("entities"))
    totals = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("current")).alias("current"), F.count_if(~F.col("current")).alias("expired"))
    return entities.crossJoin(totals)


def list_page(drawers: DataFrame, limit: int = 20, offset: int = 0, wing: str | None = None, room: str | None = None) -> DataFrame:
    """One page of logical drawers, newest first, with the total beside it. The limit is the feature."""
    found = logical(drawers)
    if wing is not None:
        found = found.where(F.col("wing") == wing)
    if room is not None:
        found = found.where(F.col("room") == room)
    total = found.agg(F.count("*").alias("total"))
    page = found.select("id", "wing", "room", "title", F.substring("text", 1, 200).alias("preview"), "filed_at").orderBy(F.desc_nulls_last("filed_at"), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def wing_variants(drawers: DataFrame, slug) -> DataFrame:
    """(wing, n, main, main_n): spellings of a wing that a larger spelling shares its slug with."""
    from pyspark.sql import Window

    per = list_wings(drawers).where("wing is not null").withColumn("slug", slug)
    best = Window.partitionBy("slug").orderBy(F.desc("n"), "wing")
    top = per.withColumn("main", F.first("wing").over(best)).withColumn("main_n", F.first("n").over(best))
    return top.where("wing <> main").select("wing", "n", "main", "main_n")
