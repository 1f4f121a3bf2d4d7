"""BM25 over all searchable units: postings and statistics as tables, scores by one join."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import TOKEN, expand, index_tokens, tokens
from quillstone.session import staged

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Most rows of query tokens that are broadcast.
BROADCAST_TOKENS = 100_000
#: Most rows of query tokens that become literals of a filter.
PUSHED_TOKENS = 500


@dataclass(frozen=True)
class Index:
    """postings: (token, unit, cid, tf, dl); terms: (token, df, idf)."""

    postings: DataFrame
    terms: DataFrame


@dataclass(frozen=True)
class Documents:
    """docs: (cid, own, dls, lens, tokens, tfs), one row per canonical id; terms as in Index.

    own: a logical drawer has this id. dls, lens: length and number of distinct tokens of each of its
    units; tokens, tfs: those of all its units, one unit behind the other.
    """

    docs: DataFrame
    terms: DataFrame


def units(drawers: DataFrame) -> DataFrame:
    """(unit, cid, body): chunks, and logical drawers without chunks; body is title and text.

    A drawer that has chunks is found through them alone.
    """
    cid = F.coalesce(F.nullif("parent_drawer_id", F.lit("")), F.col("id"))
    rows = drawers.select(F.col("id").alias("unit"), cid.alias("cid"), F.concat_ws(" ", "title", "text").alias("body"))
    rows = rows.groupBy("unit", "cid").agg(F.min("body").alias("body"))
    parents = drawers.select(F.nullif("parent_drawer_id", F.lit("")).alias("unit")).where("unit is not null").distinct()
    return rows.join(parents, "unit", "left_anti")


def build(unit_rows: DataFrame, keep: bool = True, clustered: bool = False) -> Index:
    """The index of (unit, cid, body), one row per unit. keep: write the postings once to the shared folder.

    Statistics cover all units: N, mean length, df. A negative idf becomes a quarter of the mean
    idf over the vocabulary. Double arithmetic throughout. The texts are moved to their unit's
    partition once (clustered: they are there); tokens, counts and lengths need no further shuffle.
    """
    if not clustered:
        unit_rows = unit_rows.repartition("unit", "cid")
    words = unit_rows.select("unit", "cid", F.explode_outer(tokens("body")).alias("raw"))
    counted = words.select("unit", "cid", F.explode_outer(expand(F.col("raw"))).alias("token")).groupBy("unit", "cid", "token").agg(F.count("token").cast("double").alias("tf"))
    postings = counted.withColumn("dl", F.sum("tf").over(Window.partitionBy("unit", "cid")))
    if keep:
        # Sorted, so that a search for a few tokens skips most of each file.
        postings = staged(postings.sortWithinPartitions("token"), "postings")
    corpus = postings.select("unit", "dl").distinct().agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    postings = postings.where("token is not null")
    terms = _terms(postings, corpus)
    # A row per distinct token; a search would else count all postings again.
    return Index(postings, staged(terms, "terms") if keep else terms)


def _terms(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """(token, df, avgdl, idf) of a row per token and unit; corpus: one row (n, avgdl)."""
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = postings.groupBy("token").agg(F.count("*").cast("double").alias("df")).crossJoin(F.broadcast(corpus)).withColumn("raw", raw)
    mean = terms.agg(F.avg("raw").alias("mean"))
    return terms.crossJoin(F.broadcast(mean)).select("token", "df", "avgdl", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents.docs of (cid, own, units (unit, body)): the least body of each unit, its tokens as index_tokens() has them.

    By Arrow batches: with keys, a row a token is many times the texts.
    """
    token, joint = re.compile(TOKEN), re.compile("[._-]")

    def expanded(t: str) -> list[str]:
        ends = [m.start() for m in joint.finditer(t)]
        return list(dict.fromkeys([t, *joint.split(t), *(t[:e] for e in ends)])) if ends else [t]

    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            dls, lens, words, tfs, last = [], [], [], [], [0]
            for units in batch["units"].to_pylist():
                least: dict = {}
                for u in units:
                    least[u["unit"]] = min(least.get(u["unit"], u["body"]), u["body"])
                for body in least.values():
                    n = Counter(x for t in token.findall(body.lower()) for x in expanded(t))
                    words += n.keys()
                    tfs += n.values()
                    lens.append(len(n))
                    dls.append(n.total())
                last.append(len(dls))
            unit_at = pa.array(last, pa.int32())
            word_at = pa.array([0, *accumulate(lens)], pa.int32()).take(unit_at)
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for at, x, t in ((unit_at, dls, pa.float64()), (unit_at, lens, pa.int32()), (word_at, words, pa.string()), (word_at, tfs, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch["cid"], batch["own"], *lists], ["cid", "own", "dls", "lens", "tokens", "tfs"])


def documents(drawers: DataFrame) -> Documents:
    """The units() of drawers with their tokens, a row per canonical id, written once to the shared folder.

    Rows with chunks lose their text but stay until then, as they say which ids are logical drawers.
    """
    cid = F.coalesce(F.nullif("parent_drawer_id", F.lit("")), F.col("id"))
    own = F.col("parent_drawer_id").isNull() & F.col("id").isNotNull()
    rows = drawers.select(F.col("id").alias("unit"), cid.alias("cid"), F.concat_ws(" ", "title", "text").alias("body"), own.alias("own"))
    parents = drawers.select(F.nullif("parent_drawer_id", F.lit("")).alias("unit")).where("unit is not null").distinct().withColumn("parent", F.lit(True))
    rows = rows.join(parents, "unit", "left").select("unit", "cid", "own", F.when(F.col("parent").isNull(), F.col("body")).alias("body"))
    # A list of units is as long as the drawer's text.
    texts = F.collect_list(F.when(F.col("body").isNotNull(), F.struct("unit", "body"))).alias("units")
    docs = rows.repartition("cid").groupBy("cid").agg(F.max("own").alias("own"), texts)
    docs = staged(docs.mapInArrow(_counted, "cid string, own boolean, dls array<double>, lens array<int>, tokens array<string>, tfs array<double>"), "documents")
    corpus = docs.select(F.explode("dls").alias("dl")).agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    return Documents(docs, staged(_terms(docs.select(F.explode("tokens").alias("token")), corpus), "terms"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, cid, score): all units of all queries (query_id, query), the best unit of each canonical id.

    A token that a query repeats counts again. Scores at or below 0 are no hits.
    """
    q = queries.select("query_id", F.explode(index_tokens("query")).alias("token")).groupBy("query_id", "token").agg(F.count("*").cast("double").alias("qtf"))
    few = q.limit(BROADCAST_TOKENS + 1).collect()
    postings = index.postings
    if len(few) <= PUSHED_TOKENS:
        # The tokens of a query or two are literals that the scans of terms and postings can test.
        wanted = F.col("token").isin(list({r["token"] for r in few}))
        known = {r["token"]: r for r in index.terms.where(wanted).collect()}
        rows = [(r["query_id"], r["token"], r["qtf"], known[r["token"]]["idf"], known[r["token"]]["avgdl"]) for r in few if r["token"] in known]
        kind = T.StructType([*q.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("idf", "avgdl")]])
        idf, postings = F.broadcast(q.sparkSession.createDataFrame(rows, kind)), postings.where(wanted)
    elif len(few) <= BROADCAST_TOKENS:
        # Some pick their postings before any shuffle; many are joined by shuffling.
        idf = F.broadcast(index.terms.join(F.broadcast(q), "token"))
    else:
        idf = index.terms.join(q, "token")
    term = F.col("qtf") * F.col("idf") * (F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl"))))
    return (
        postings.join(idf, "token")
        .groupBy("query_id", "unit", "cid")
        .agg(F.sum(term).alias("score"))
        .where("score > 0")
        .groupBy("query_id", "cid")
        .agg(F.max("score").alias("score"))
    )
