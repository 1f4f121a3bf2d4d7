"""Exact vector search, hybrid search and duplicate checks over the store."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import vector as vx
from quillstone.operators import bm25, lanes
from quillstone.session import checkpointed

RRF_K, OVERFETCH, STITCH_MAX, SNIPPET, DUPLICATE_POOL = 60, 10, 10_000, 300, 50
#: Decimals of a distance or score beyond which two are a tie, decided by id.
DIGITS = 9
#: Most distances that a task holds at once, and most rows in a batch that it returns.
CELLS, SENT = 2**18, 10_000
EPOCH = datetime(1970, 1, 1)


def canonical(df: DataFrame) -> DataFrame:
    """df + cid: the parent's id for a chunk, else the own id."""
    return df.withColumn("cid", F.coalesce(F.nullif("parent_drawer_id", F.lit("")), F.col("id")))


def _squared(vectors: pd.Series, q: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to q, rounded; NaN where it is null, of another length or holds a null or NaN."""
    out = np.full(len(vectors), np.nan)
    fit = np.flatnonzero(vectors.map(lambda v: v is not None and len(v) == len(q)).to_numpy(dtype=bool))
    if len(fit):
        x = np.stack(vectors.to_numpy()[fit]).astype(np.float64)
        out[fit] = np.round(((x - q) ** 2).sum(1), DIGITS)
    return out


def distances(rows: DataFrame, vector: list[float]) -> DataFrame:
    """rows with dist, the squared distance to `vector`, in place of the embedding; null where it is not usable.

    By Arrow batches: lambda expressions over arrays are interpreted element by element. Select the
    columns that are needed before.
    """
    q = np.array(vector, dtype=np.float64)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "embedding"] + [T.StructField("dist", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = pd.Series(_squared(pdf["embedding"], q), dtype=object)
            yield pdf.drop(columns="embedding").assign(dist=d.where(d.notna(), None))

    return rows.mapInPandas(run, schema)


def nearest_rows(rows: DataFrame, vector: list[float], keep: int) -> DataFrame:
    """The keep nearest distinct rows (id, ..., dist) of rows (id, ..., embedding), ties by id: keep rows a task leave it."""
    q = np.array(vector, dtype=np.float64)
    names = [c for c in rows.columns if c != "embedding"]
    schema = T.StructType([f for f in rows.schema.fields if f.name != "embedding"] + [T.StructField("dist", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            some = pdf[names].assign(dist=_squared(pdf["embedding"], q)).dropna(subset=["dist"])
            if held is not None:
                some = pd.concat([held, some])
            held = some.sort_values(["dist", "id"], kind="stable").drop_duplicates().head(keep)
        if held is not None:
            yield held

    return rows.mapInPandas(run, schema).distinct().orderBy("dist", "id").limit(keep)


def tagged(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """(id): drawers with all tags of the list; a tag listed twice can never be met twice, so nothing matches."""
    return tags.where(F.col("tag").isin(wanted)).groupBy(F.col("drawer_id").alias("id")).agg(F.countDistinct("tag").alias("k")).where(F.col("k") == len(wanted)).select("id")


def scoped(df: DataFrame, wing: str | None, room: str | None) -> DataFrame:
    if wing is not None:
        df = df.where(F.col("wing") == wing)
    return df if room is None else df.where(F.col("room") == room)


def vector_lane(drawers: DataFrame, vector: list[float], limit: int, wing: str | None = None, room: str | None = None, tags: DataFrame | None = None, tag_filter: list[str] | None = None) -> DataFrame:
    """(cid, rank): the nearest limit x 10 rows, rolled up to canonical ids by their best row.

    A tag filter tests the row's own id, so chunks of a tagged drawer do not pass.
    """
    rows = scoped(drawers, wing, room)
    if tag_filter:
        rows = rows.join(tagged(tags, tag_filter), "id", "left_semi")
    near = nearest_rows(canonical(rows).select("id", "cid", "embedding"), vector, max(int(limit), 1) * OVERFETCH)
    best = near.groupBy("cid").agg(F.min(F.struct("dist", "id")).alias("b"))
    # At most limit x 10 rows are ranked in one task.
    return best.select("cid", F.row_number().over(Window.orderBy("b")).alias("rank"))


def keyword_hits(drawers: DataFrame, index: bm25.Index, query: str, wing: str | None = None, room: str | None = None, tags: DataFrame | None = None, tag_filter: list[str] | None = None) -> DataFrame:
    """(cid, score): all logical drawers with a positive score, scoped after scoring and never cut."""
    spark = drawers.sparkSession
    hits = bm25.scores(index, spark.createDataFrame([(0, query)], "query_id int, query string")).select("cid", F.round("score", DIGITS).alias("score"))
    meta = scoped(drawers.where(F.col("parent_drawer_id").isNull()), wing, room).select(F.col("id").alias("cid"))
    hits = hits.join(meta, "cid", "left_semi")
    if tag_filter:
        hits = hits.join(tagged(tags, tag_filter).withColumnRenamed("id", "cid"), "cid", "left_semi")
    return hits


def keyword_lane(drawers: DataFrame, index: bm25.Index, query: str, wing: str | None = None, room: str | None = None, tags: DataFrame | None = None, tag_filter: list[str] | None = None) -> DataFrame:
    """(cid, rank) of keyword_hits().

    The rank of a score is the number of better ones, counted per distinct score and summed over
    buckets of scores, so that no task sorts all hits.
    """
    return ranked(keyword_hits(drawers, index, query, wing, room, tags, tag_filter))


def ranked(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, cid, rank) by descending score, then cid: offsets of score buckets plus a rank inside the bucket."""
    bucket = F.floor(F.col("score") * 8).cast("int")
    hits = hits.withColumn("b", bucket)
    # One row per bucket of an eighth of a score: few, whatever the number of hits.
    sizes = hits.groupBy(*by, "b").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*by, "b", "before")
    inside = F.row_number().over(Window.partitionBy(*by, "b").orderBy(F.desc("score"), "cid"))
    return hits.join(before if by else F.broadcast(before), [*by, "b"]).select(*by, "cid", (F.col("before") + inside).cast("int").alias("rank"))


def nearest_batch(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, cid, dist, rank): knn_batch() over distinct rows (id, cid, embedding), kept in the shared folder."""
    both = rows.select(F.concat_ws("\x1f", "id", "cid").alias("id"), "embedding")
    part = lambda n: F.substring_index("id", "\x1f", n)
    return checkpointed(knn_batch(both, queries, k).select("query_id", part(1).alias("id"), part(-1).alias("cid"), "dist", "rank"))


def hybrid_batch(drawers: DataFrame, index: bm25.Documents, queries: DataFrame, limit: int = 10, near: DataFrame | None = None) -> DataFrame:
    """(query_id, cid, score, rank): the fused lanes of hybrid_search() for many queries (query_id, query, embedding), without snippets.

    near: the nearest_batch() of limit x 10 rows, if it is there. As in hybrid_search() only drawers
    of the vector lane and the first `limit` keyword hits need a place in the keyword lane.
    """
    if near is None:
        near = nearest_batch(canonical(drawers).select("id", "cid", "embedding").dropDuplicates(["id", "cid"]), queries, limit * OVERFETCH)
    best = near.groupBy("query_id", "cid").agg(F.min(F.struct("dist", "id")).alias("at"))
    lane = best.select("query_id", "cid", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank"))
    hits = lanes.keyword_places(index, queries, near, limit, DIGITS)
    fused = lane.unionByName(hits).groupBy("query_id", "cid").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"))
    filed = drawers.where(F.col("parent_drawer_id").isNull()).groupBy(F.col("id").alias("cid")).agg(F.max("filed_at").alias("filed_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("filed_at"), "cid")
    return fused.join(filed, "cid", "left").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "cid", "score", "rank")


def leading(hits: DataFrame, limit: int, also: set[str]) -> list[tuple[str, float]]:
    """The `limit` best of hits (cid, score), and those of the cids in `also`: a task sends no more than that."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, asked = None, []
        for pdf in batches:
            asked.append(pdf[pdf["cid"].isin(also)])
            held = (pdf if held is None else pd.concat([held, pdf])).sort_values(["score", "cid"], ascending=[False, True]).head(limit)
        if held is not None:
            yield pd.concat([held, *asked]).drop_duplicates("cid")

    rows = sorted((-r["score"], r["cid"]) for r in hits.mapInPandas(pick, hits.schema).collect())
    return [(c, -s) for at, (s, c) in enumerate(rows) if at < limit or c in also]


def better(hits: DataFrame, some: list[tuple[str, float]]) -> dict[str, int]:
    """The rank among hits (cid, score) of each of some (cid, score) of them: 1 + the number of better ones, in one pass."""
    order = sorted((-s, c) for c, s in some)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(order) + 1, dtype=np.int64)
        for pdf in batches:
            for c, s in zip(pdf["cid"], pdf["score"]):
                total[bisect_right(order, (-s, c))] += 1
        yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

    n = dict(hits.mapInPandas(count, "at int, n bigint").groupBy("at").agg(F.sum("n")).collect())
    # A hit beats those of `some` that stand at or behind its place; itself not.
    out, before = {}, 0
    for at, (_, c) in enumerate(order):
        before += n.get(at, 0)
        out[c] = before + 1
    return out


def hydrate(ids: list[str], drawers: DataFrame, vector: list[float]) -> DataFrame:
    """(id, wing, room, title, snippet, distance) of a handful of drawers, in one pass over the table.

    distance is the least of all rows of the drawer. Rows with a chunk_index give the snippet: the
    best one and its neighbours by index, joined by a blank line, at most 10000 characters; a
    drawer without gives the first 300 characters of its text.
    """
    own = F.col("id").isin(ids) | F.col("parent_drawer_id").isin(ids)
    rows = canonical(drawers.where(own).select("id", "wing", "room", "title", "text", "embedding", "chunk_index", "parent_drawer_id")).where(F.col("cid").isin(ids))
    rows = distances(rows.drop("parent_drawer_id").dropDuplicates(["id"]), vector)
    head = F.when(F.col("id") == F.col("cid"), F.struct("wing", "room", "title", "text"))
    per = rows.groupBy("cid").agg(F.min("dist").alias("distance"), F.max(head).alias("own"), F.collect_list(F.when(F.col("chunk_index").isNotNull(), F.struct("chunk_index", "dist", "text"))).alias("parts"))
    snippet = F.coalesce(stitched(F.col("parts")), F.substring("own.text", 1, SNIPPET))
    return per.where("own is not null").select(F.col("cid").alias("id"), "own.wing", "own.room", "own.title", snippet.alias("snippet"), "distance")


def stitched(parts: Column) -> Column:
    """The chunk of least dist, then index, and those beside it by index, of the chunks (chunk_index, dist, text) of one drawer.

    Joined in order by a blank line and cut at 10000 characters; of rows with one index the greatest
    text counts; null without chunks. A list of chunks is as long as the drawer's text.
    """
    far = F.lit(float("inf"))
    best = F.array_min(F.transform(parts, lambda x: F.struct(F.coalesce(x["dist"], far).alias("d"), x["chunk_index"].alias("i"))))["i"]
    near = F.sort_array(F.transform(F.filter(parts, lambda x: x["chunk_index"].between(best - 1, best + 1)), lambda x: F.struct(x["chunk_index"].alias("i"), x["text"].alias("t"))), asc=False)
    one = F.filter(F.transform(near, lambda x, k: F.struct(x["i"].alias("i"), x["t"].alias("t"), F.when(k > 0, F.get(near, k - 1)["i"]).alias("before"))), lambda x: x["before"].isNull() | (x["before"] != x["i"]))
    return F.when(F.size(parts) > 0, F.substring(F.array_join(F.transform(F.reverse(one), lambda x: x["t"]), "\n\n"), 1, STITCH_MAX))


def hybrid_search(drawers: DataFrame, index: bm25.Index, query: str, vector: list[float], limit: int = 10, wing: str | None = None, room: str | None = None, tags: DataFrame | None = None, tag_filter: list[str] | None = None) -> DataFrame:
    """The `limit` best drawers for a query text and its vector: both lanes, fused, with snippet, score and rank.

    Only drawers of the vector lane, at most limit x 10, and the first `limit` keyword hits can be
    among the best: a later hit that the vector lane lacks is behind all earlier ones. So hits are
    counted, not sorted, for the ranks of the former, and no more than that reaches the driver.
    Fused scores that tie go to the newest, then to the least id.
    """
    limit = max(int(limit), 1)
    scope = {"wing": wing, "room": room, "tags": tags, "tag_filter": tag_filter}
    # The lanes need nothing of each other, so their jobs run side by side.
    with ThreadPoolExecutor(1) as beside:
        asked = beside.submit(vector_lane(drawers, vector, limit, **scope).collect)
        hits = checkpointed(keyword_hits(drawers, index, query, **scope))
        near = {r["cid"]: r["rank"] for r in asked.result()}
    some = leading(hits, limit, set(near))
    ranks = better(hits, some) if some else {}
    score = {c: round(sum(1.0 / (RRF_K + lane[c]) for lane in (near, ranks) if c in lane), 12) for c in {*near, *ranks}}
    least = sorted(score.values(), reverse=True)[min(limit, len(score)) - 1] if score else 0.0
    chosen = [c for c in score if score[c] >= least]
    tied = [c for c in chosen if sum(score[c] == score[d] for d in chosen) > 1]
    filed = dict(drawers.where(F.col("parent_drawer_id").isNull() & F.col("id").isin(tied)).groupBy("id").agg(F.max("filed_at")).collect()) if tied else {}
    age = lambda c: (filed.get(c) is None, -(filed[c] - EPOCH).total_seconds() if filed.get(c) else 0.0)
    best = sorted(chosen, key=lambda c: (-score[c], *age(c), c))[:limit]
    order = drawers.sparkSession.createDataFrame([(c, score[c], at + 1) for at, c in enumerate(best)], "id string, score double, rank int")
    return hydrate(best, drawers, vector).join(F.broadcast(order), "id")


def check_duplicate(drawers: DataFrame, vector: list[float], threshold: float = 0.9) -> DataFrame:
    """(id, wing, room, similarity): of the 50 nearest logical rows those similar enough, whatever the scope."""
    near = nearest_rows(drawers.where(F.col("parent_drawer_id").isNull()).select("id", "wing", "room", "embedding"), vector, DUPLICATE_POOL)
    return near.withColumn("similarity", vx.l2_to_cosine("dist")).where(F.col("similarity") >= threshold).drop("dist")


def knn_one(base: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(id, dist): the k rows of base (id, embedding) nearest to one vector; one pass, k rows a task reach the driver."""
    return nearest_rows(base.select("id", "embedding"), vector, k)


def knn_batch(base: DataFrame, queries: DataFrame, k: int, at_once: int = 4096) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest rows of base (id, embedding) for each query (query_id, embedding).

    Queries are met in blocks of at_once, each a bounded broadcast; a task keeps the k best of its
    rows per query, so what is shuffled does not grow with the rows of a task. It meets a batch of
    rows with a few queries at a time, as all of a block would need some hundred MB. Exact: distances
    in double precision, rounded, ties by id. Vectors of another length than the queries' are left out.
    """
    spark = base.sparkSession
    queries = queries.where("embedding is not null").select("query_id", "embedding")
    blocks = max(1, math.ceil(queries.count() / at_once))
    base = base.where("embedding is not null").select("id", "embedding")
    kind = {f.name: f.dataType.simpleString() for f in base.schema} | {f.name: f.dataType.simpleString() for f in queries.schema}
    parts = []
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        if not some:
            continue
        dim = max(len(r[1]) for r in some)
        some = [r for r in some if len(r[1]) == dim]
        shared = spark.sparkContext.broadcast(([r[0] for r in some], np.array([r[1] for r in some], dtype=np.float64)))

        def nearest(batches: Iterator[pd.DataFrame], shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            q2 = (q * q).sum(1)
            # No row behind k others of one batch is among the k best.
            bound = np.full(len(q), np.inf)
            kept: list[pd.DataFrame] = []
            for pdf in batches:
                pdf = pdf[pdf["embedding"].map(len) == dim]
                if not len(pdf):
                    continue
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                ok = ~np.isnan(x).any(axis=1)
                x, ids = x[ok], pdf["id"].to_numpy()[ok]
                if not len(x):
                    continue
                x2, step, found = (x * x).sum(1), max(1, CELLS // len(x)), []
                for at in range(0, len(q), step):
                    some = slice(at, at + step)
                    rough = q2[some, None] - 2 * q[some] @ x.T + x2[None, :]
                    if len(x) >= k:
                        bound[some] = np.fmin(bound[some], np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-6)
                    i, j = np.nonzero(rough <= bound[some, None])
                    i += at
                    found.append((i, j, np.round(((q[i] - x[j]) ** 2).sum(1), DIGITS)))
                i, j, d = (np.concatenate(a) for a in zip(*found))
                kept.append(pd.DataFrame({"q": i, "id": ids[j], "dist": d}))
                if sum(map(len, kept)) > 1_000_000:
                    kept = [pd.concat(kept).sort_values(["q", "dist", "id"]).groupby("q").head(k)]
            if kept:
                best = pd.concat(kept).sort_values(["q", "dist", "id"]).groupby("q").head(k)
                for at in range(0, len(best), SENT):
                    some = best.iloc[at : at + SENT]
                    yield pd.DataFrame({"query_id": [names[i] for i in some["q"]], "id": some["id"], "dist": some["dist"]})

        parts.append(base.mapInPandas(nearest, f"query_id {kind['query_id']}, id {kind['id']}, dist double"))
    if not parts:
        return spark.createDataFrame([], f"query_id {kind['query_id']}, id {kind['id']}, dist double, rank int")
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
