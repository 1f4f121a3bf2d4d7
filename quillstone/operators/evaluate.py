"""Retrieval metrics and guards on evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import normalized


def recall_at_k(found: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k found; 0 without any relevant."""
    return F.when(F.size(relevant) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), relevant)) / F.size(F.array_distinct(relevant)))


def reciprocal_rank(found: Column, relevant: Column) -> Column:
    """1 / position of the first relevant id in the whole list, else 0."""
    at = F.array_min(F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / at, F.lit(0.0))


def metrics(rankings: DataFrame, k: int = 10) -> DataFrame:
    """(kind, n, recall, mrr) of (kind, found, relevant), per kind and for 'all'; an empty kind is 'unspecified'."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("unspecified"))
    return averaged(rankings.select(kind.alias("kind"), recall_at_k(F.col("found"), F.col("relevant"), k).alias("r"), reciprocal_rank(F.col("found"), F.col("relevant")).alias("m")))


def scored(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, kind, n_common, r, m) from rows instead of lists: no set of relevant ids is ever gathered.

    hits: (query_id, rank), the places of relevant ids in each ranking; queries: (query_id, kind,
    n_relevant). r is recall at k, 0 without relevant ids; m the reciprocal of the first place.
    """
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("c"), F.min("rank").alias("first"))
    c = F.coalesce("c", F.lit(0))
    r = F.when(F.col("n_relevant") > 0, c / F.col("n_relevant")).otherwise(0.0)
    return queries.join(per, "query_id", "left").select("query_id", "kind", c.alias("n_common"), r.alias("r"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("m"))


def averaged(scores: DataFrame) -> DataFrame:
    """(kind, n, recall, mrr) of scored() rows, per kind and for 'all'; an empty kind is 'unspecified'."""
    one = scores.select(F.coalesce(F.nullif("kind", F.lit("")), F.lit("unspecified")).alias("kind"), "r", "m")
    both = one.unionByName(one.withColumn("kind", F.lit("all")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.avg("r").alias("recall"), F.avg("m").alias("mrr"))


def gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, accepted) of two metrics(): recall strictly up and MRR not down, per kind and for all."""
    b = before.select("kind", F.col("recall").alias("_r"), F.col("mrr").alias("_m"))
    return after.join(b, "kind").select("kind", ((F.col("recall") > F.col("_r")) & (F.col("mrr") >= F.col("_m"))).alias("accepted"))


def accepted(before: tuple[float, float], after: tuple[float, float]) -> bool:
    """(recall, mrr): recall strictly up and MRR not down."""
    return after[0] > before[0] and after[1] >= before[1]


def known_items(queries: DataFrame, relevant: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, known): whether a query gives away a relevant drawer.

    queries: (query_id, query); relevant: (query_id, id); corpus: (id, title). Known if an id stands
    in the query, or the normalized title in the normalized query, or the query in the title; an
    empty normalized query is part of any title, an empty title of none.
    """
    pairs = relevant.join(queries, "query_id").join(corpus.select("id", "title"), "id", "left")
    q, t = normalized("query"), normalized("title")
    leak = ((F.col("id") != "") & F.col("query").contains(F.col("id"))) | ((t != "") & (q.contains(t) | t.contains(q)))
    hit = pairs.groupBy("query_id").agg(F.bool_or(F.coalesce(leak, F.lit(False))).alias("k"))
    return queries.select("query_id").join(hit, "query_id", "left").select("query_id", F.coalesce("k", F.lit(False)).alias("known"))
