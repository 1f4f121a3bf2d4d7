"""Retrieval queries over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import vector as vx
from quillstone.operators import bm25, evaluate, search, sweep
from quillstone.plans import scalars as scalar_plans
from quillstone.sources.tables import table, texts

WING = "harbor_atlas"


def _probe(drawers: DataFrame) -> tuple[str, list[float]]:
    """Title and vector of the logical drawer of least id with a usable vector: the query of the examples."""
    r = drawers.where(F.col("parent_drawer_id").isNull() & vx.usable("embedding", 64) & (F.length("title") > 20)).orderBy("id").select("title", "embedding").first()
    return r[0], r[1]


def _index(drawers: DataFrame) -> bm25.Index:
    return bm25.build(bm25.units(drawers), clustered=True)


def bm25_stats(spark: SparkSession, root: str) -> DataFrame:
    ix = _index(table(spark, root, "drawers"))
    return ix.terms.agg(F.count("*").alias("n_terms"), F.sum("df").cast("long").alias("n_postings"), F.round(F.max("avgdl"), 6).alias("avgdl"), F.round(F.avg("idf"), 6).alias("mean_idf"))


def bm25_top10(spark: SparkSession, root: str) -> DataFrame:
    """The ten best documents for every evaluation text."""
    docs = texts(spark, root, "documents").select(F.col("doc_id").alias("unit"), F.col("doc_id").alias("cid"), F.coalesce("text", F.lit("")).alias("body"))
    items = table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = bm25.scores(bm25.build(docs), items).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.col("query_id").alias("item_id"), F.col("cid").alias("doc_id"), "score", "rank")


def keyword_lane(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    return search.keyword_lane(d, _index(d), _probe(d)[0]).withColumnRenamed("cid", "id")


def knn(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    return search.vector_lane(d, _probe(d)[1], 10).withColumnRenamed("cid", "id")


def knn_scoped(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    return search.vector_lane(d, _probe(d)[1], 10, wing=WING).withColumnRenamed("cid", "id")


def knn_raw(spark: SparkSession, root: str) -> DataFrame:
    """Ten nearest rows of the embeddings for every twentieth, all rows searched."""
    e = table(spark, root, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), "embedding")
    near = search.knn_batch(base, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return near.select("query_id", "id", F.round("dist", 6).alias("dist"), "rank")


def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    title, vector = _probe(d)
    out = search.hybrid_search(d, _index(d), title, vector, 10)
    return out.select("id", "wing", "room", "title", F.md5("snippet").alias("snippet_md5"), F.round("distance", 6).alias("distance"), "rank")


def hybrid_search_scoped(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    title, vector = _probe(d)
    tags = table(spark, root, "drawer_tags")
    top = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").first()[0]
    out = search.hybrid_search(d, _index(d), title, vector, 10, tags=tags, tag_filter=[top])
    return out.select("id", "wing", "room", F.round("distance", 6).alias("distance"), "rank")


def check_duplicate(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    return search.check_duplicate(d, _probe(d)[1]).withColumn("similarity", F.round("similarity", 6))


def _scored(spark: SparkSession, root: str, k: int) -> DataFrame:
    """Every twentieth embedding asks for those of its label."""
    e = table(spark, root, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    near = search.knn_batch(base, asked.select("query_id", "embedding"), 11).where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.select("query_id", "id", place.alias("rank")).join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id")
    hits = near.join(asked.select("query_id", "label"), "query_id").where("own = label").select("query_id", "rank")
    # The query itself is not among the relevant ones.
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")).where("n_relevant > 0")
    queries = asked.join(sizes, "label").join(near.select("query_id").distinct(), "query_id", "left_semi")
    return evaluate.scored(hits, queries.select("query_id", F.col("label").cast("string").alias("kind"), "n_relevant"), k)


def recall_mrr(spark: SparkSession, root: str) -> DataFrame:
    m = evaluate.averaged(_scored(spark, root, 10))
    return m.select("kind", "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def known_item(spark: SparkSession, root: str) -> DataFrame:
    """Tag names as queries: do they give away a drawer that has the tag?"""
    tags = table(spark, root, "drawer_tags").where("tag is not null").select("tag", F.col("drawer_id").alias("id")).distinct()
    queries = tags.select(F.col("tag").alias("query_id"), F.col("tag").alias("query")).distinct()
    corpus = table(spark, root, "drawers").where("parent_drawer_id is null").select("id", "title").distinct()
    return evaluate.known_items(queries, tags.select(F.col("tag").alias("query_id"), "id"), corpus)


def near_dup_sweep(spark: SparkSession, root: str) -> DataFrame:
    out = sweep.near_duplicates(table(spark, root, "drawers"))
    return out.withColumn("distance", F.round("distance", 6))


def _with_paths(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("o"), tx.extract_paths("text").alias("paths"))


def wave_schedule(spark: SparkSession, root: str) -> DataFrame:
    """First-fit groups of the documents that name a path, none in common, in order of id."""
    items = _with_paths(spark, root).where("size(paths) > 0")
    return sweep.first_fit(sweep.claims(items, "o"))


def seam_scan(spark: SparkSession, root: str) -> DataFrame:
    """Documents that share no path with an earlier chosen one, greedily in order of id; those without a path always."""
    items = _with_paths(spark, root)
    state = sweep.first_fit(sweep.claims(items, "o"), waves=False)
    return items.join(state.where("wave = 0"), "id", "left_anti").select("id")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, bm25_top10, keyword_lane, knn, knn_scoped, knn_raw, hybrid_search, hybrid_search_scoped, check_duplicate, recall_mrr,
        known_item, near_dup_sweep, wave_schedule, seam_scan,
    )
}

_D2 = "round(list_sum(list_transform(range(1, 65), lambda i: ({a}[i]::double - {b}[i]::double) ** 2)), 9)"
_USABLE = "embedding is not null and len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: isnan(x)))"
_PROBE = f"probe as (select title pt, embedding pv from drawers where parent_drawer_id is null and {_USABLE} and length(title) > 20 order by id limit 1)"
_EXPAND = f"""
ex as (select token, unnest(list_distinct(list_concat([token], regexp_split_to_array(token, '[._-]'),
    list_transform(range(1, len(regexp_split_to_array(token, '[._-]'))), lambda i: regexp_extract(token, '^((?:[a-z0-9]+[._-]){{' || (i - 1)::varchar || '}}[a-z0-9]+)', 1))))) t
  from (select distinct token from raw where regexp_matches(token, '[._-]'))),"""


def _bm25(units: str, queries: str) -> str:
    """CTEs up to score(query_id, cid, s) for unit(unit, cid, body) and q(query_id, query)."""
    return f"""unit as ({units}), q as ({queries}),
raw as (select 'u' side, unit::varchar k, unnest(regexp_extract_all(lower(body), '{tx.TOKEN}')) token from unit
  union all select 'q', query_id::varchar, unnest(regexp_extract_all(lower(query), '{tx.TOKEN}')) from q),{_EXPAND}
tok as (select side, k, token t from raw where not regexp_matches(token, '[._-]') union all select side, k, ex.t from raw join ex using (token)),
post as (select k, t, count(*)::double tf from tok where side = 'u' group by 1, 2),
len_ as (select unit::varchar k, cid, coalesce(n, 0)::double dl from unit left join (select k, count(*) n from tok where side = 'u' group by 1) c on c.k = unit.unit::varchar),
st as (select count(*)::double n, avg(dl) avgdl from len_),
rawidf as (select t, count(*)::double df, any_value(avgdl) avgdl, ln(any_value(n) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) r from post, st group by t),
term as (select t, df, avgdl, case when r < 0 then 0.25::double * (select avg(r) from rawidf) else r end idf from rawidf),
qt as (select k query_id, t, count(*)::double qtf from tok where side = 'q' group by 1, 2),
us as (select qt.query_id, post.k, sum(qtf * idf * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)))) s
  from qt join term using (t) join post using (t) join len_ on len_.k = post.k group by 1, 2),
score as (select query_id, cid, max(s) s from us join len_ using (k) where s > 0 group by 1, 2)"""


_CID = "coalesce(nullif(parent_drawer_id, ''), id)"
_UNITS = f"""select id unit, {_CID} cid, min(concat_ws(' ', title, "text")) body from drawers
  where id not in (select parent_drawer_id from drawers where parent_drawer_id <> '') group by 1, 2"""
_KEY = f"{_bm25(_UNITS, 'select 0 query_id, pt query from probe')}"


def _klane(scope: str = "true") -> str:
    return f"""klane as (select cid, row_number() over (order by round(s, 9) desc, cid)::int "rank" from score
  where cid in (select id from drawers where parent_drawer_id is null and {scope}))"""


def _vlane(scope: str = "true") -> str:
    d2 = _D2.format(a="embedding", b="pv")
    return f"""near as (select distinct id, {_CID} cid, {d2} dist from drawers, probe where {_USABLE} and {scope} order by dist, id limit 100),
vlane as (select cid, row_number() over (order by d, i)::int "rank" from (select cid, min(dist) d, min_by(id, (dist, id)) i from near group by cid))"""


_D2P = _D2.format(a="embedding", b="pv")
_HYDRATE = f"""
filed as (select id cid, max(filed_at) filed_at from drawers where parent_drawer_id is null group by 1),
fused as (select cid, round(sum(1.0::double / (60 + "rank")), 12) score from (select * from vlane union all select * from klane) group by cid),
best as (select cid, row_number() over (order by score desc, filed_at desc nulls last, cid)::int "rank" from fused left join filed using (cid) order by "rank" limit 10),
rws as (select distinct on (id) *, {_CID} cid, case when {_USABLE} then {_D2P} end dist from drawers, probe where {_CID} in (select cid from best)),
per as (select cid, min(dist) distance, min_by(chunk_index, (coalesce(dist, 'inf'::double), chunk_index)) filter (chunk_index is not null) b from rws group by cid),
part as (select cid, chunk_index, max("text") t from rws where chunk_index is not null group by 1, 2),
st2 as (select cid, substr(string_agg(t, chr(10) || chr(10) order by chunk_index), 1, 10000) s from part join per using (cid) where chunk_index between b - 1 and b + 1 group by cid),
own as (select cid, wing, room, title, "text" from rws where id = cid)"""
_TOPTAG = "(select tag from drawer_tags group by tag order by count(*) desc, tag limit 1)"
_TAGGED = f"id in (select drawer_id from drawer_tags where tag = {_TOPTAG})"

_PATHED = f"""it as (select doc_id id, list_distinct(regexp_extract_all("text", '{scalar_plans._PATH}')) ps from documents where "text" is not null),
nn as (select *, row_number() over (order by id) n from it where len(ps) > 0)"""

_FIRST_WORD = r"lower(regexp_extract(coalesce(title, ''), '^[# ]*\s*(\S+)', 1))"
_TITLE_TOKENS = f"list_distinct(regexp_extract_all(lower(coalesce(title, '')), '{tx.TITLE_TOKEN}'))"
_LEAD = f"case when regexp_matches({_FIRST_WORD}, '^[a-z][a-z0-9]*-[a-z0-9][a-z0-9.]*$') then {_FIRST_WORD} end"
_SWEEP = f"""d0 as (select distinct on (id) id, wing, room, coalesce(length("text"), 0) n, embedding::double[] v, {_TITLE_TOKENS} tk, {_LEAD} ld
  from drawers where parent_drawer_id is null and {_USABLE}),
pr as (select a.id a, b.id b, 1 - list_cosine_similarity(a.v, b.v) dist, a.n an from d0 a join d0 b on a.wing is not distinct from b.wing and a.room is not distinct from b.room and a.id <> b.id
  and (a.n > b.n or (a.n = b.n and a.id < b.id)) and list_bool_or(list_transform(a.v, lambda x: x <> 0)) and list_bool_or(list_transform(b.v, lambda x: x <> 0))
  where 1 - list_cosine_similarity(a.v, b.v) <= 0.08 and (a.ld = b.ld or (len(a.tk) = 0 and len(b.tk) = 0) or len(list_intersect(a.tk, b.tk)) >= 0.8 * len(list_distinct(list_concat(a.tk, b.tk))))),
cf as (select b, list(a) xs, row_number() over (order by any_value(bn) desc, b) k from (select pr.*, d0.n bn from pr join d0 on d0.id = pr.b) group by b),
kp(k, b, gone) as (select 0::bigint, null::varchar, []::varchar[] union all
  select cf.k, cf.b, case when len(list_filter(cf.xs, lambda x: not list_contains(kp.gone, x))) > 0 then list_append(kp.gone, cf.b) else kp.gone end from kp join cf on cf.k = kp.k + 1),
gn as (select unnest(gone) id from (select gone from kp order by k desc limit 1))"""

_NEAR = f"""e as (select b.vec_id query_id, a.vec_id id, {_D2.format(a="a.embedding", b="b.embedding")} dist from embeddings a, embeddings b where b.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by dist, id)::int "rank" from e)"""

SQL = {
    # A pass in order, as a recursion that carries what earlier documents took.
    "wave_schedule": f"""with recursive {_PATHED},
r(n, id, w, taken) as (select 0::bigint, null::bigint, 0, []::varchar[] union all
  select n, id, w, list_concat(taken, list_transform(ps, lambda p: w || ' ' || p)) from (
    select nn.n, nn.id, nn.ps, taken, list_filter(range(1, nn.n + 1), lambda x: not list_has_any(list_transform(nn.ps, lambda p: x || ' ' || p), taken))[1]::int w from r join nn on nn.n = r.n + 1))
select id, w wave from r where n > 0""",
    "seam_scan": f"""with recursive {_PATHED},
r(n, id, ok, taken) as (select 0::bigint, null::bigint, false, []::varchar[] union all
  select nn.n, nn.id, not list_has_any(nn.ps, taken), case when list_has_any(nn.ps, taken) then taken else list_concat(taken, nn.ps) end from r join nn on nn.n = r.n + 1)
select doc_id id from documents where doc_id not in (select id from r where n > 0 and not ok)""",
    "near_dup_sweep": f"""with recursive {_SWEEP}
select pr.b id, min_by(pr.a, (pr.dist, -pr.an, pr.a)) canonical_id, any_value(wing) wing, any_value(room) room, round(min(pr.dist), 6) distance
from pr join gn on gn.id = pr.b join d0 on d0.id = pr.b where pr.a not in (select id from gn) group by 1""",
    "bm25_stats": f"""with {_bm25(_UNITS, "select 0 query_id, 'x' query")}
select count(*) n_terms, sum(df)::bigint n_postings, round(max(avgdl), 6) avgdl, round(avg(idf), 6) mean_idf from term""",
    "bm25_top10": f"""with {_bm25('select doc_id unit, doc_id cid, coalesce("text", chr(0)) body from documents', 'select item_id query_id, "text" query from eval_items')}
select query_id::bigint item_id, cid doc_id, round(s, 6) score, (row_number() over (partition by query_id order by round(s, 6) desc, cid))::int "rank" from score
qualify "rank" <= 10""",
    "keyword_lane": f'with {_PROBE}, {_KEY}, {_klane()} select cid id, "rank" from klane',
    "knn": f'with {_PROBE}, {_vlane()} select cid id, "rank" from vlane',
    "knn_scoped": f"""with {_PROBE}, {_vlane(f"wing = '{WING}'")} select cid id, "rank" from vlane""",
    "knn_raw": f'with {_NEAR} select query_id, id, round(dist, 6) dist, "rank" from r where "rank" <= 10',
    "hybrid_search": f"""with {_PROBE}, {_KEY}, {_klane()}, {_vlane()}, {_HYDRATE}
select cid id, wing, room, title, md5(coalesce(s, substr("text", 1, 300))) snippet_md5, round(distance, 6) distance, "rank" from best join own using (cid) join per using (cid) left join st2 using (cid)""",
    "hybrid_search_scoped": f"""with {_PROBE}, {_KEY}, {_klane(_TAGGED)}, {_vlane(_TAGGED)}, {_HYDRATE}
select cid id, wing, room, round(distance, 6) distance, "rank" from best join own using (cid) join per using (cid)""",
    "check_duplicate": f"""with {_PROBE}, n as (select distinct id, wing, room, {_D2P} dist from drawers, probe where parent_drawer_id is null and {_USABLE} order by dist, id limit 50)
select id, wing, room, round(1 - dist / 2, 6) similarity from n where 1 - dist / 2 >= 0.9""",
    "recall_mrr": f"""with {_NEAR},
f as (select query_id, id, row_number() over (partition by query_id order by "rank") p from r where "rank" <= 11 and id <> query_id),
rel as (select q.vec_id query_id, q."label" kind, e.vec_id id from embeddings q join embeddings e on q."label" = e."label" and q.vec_id <> e.vec_id where q.vec_id % 20 = 0),
s as (select rel.query_id, any_value(kind)::varchar kind, count(f.id) filter (p <= 10) / count(*) r, coalesce(1.0::double / min(p), 0) m from rel left join f using (query_id, id) group by 1)
select kind, count(*) n, round(avg(r), 6) recall, round(avg(m), 6) mrr from (select kind, r, m from s union all select 'all', r, m from s) group by 1""",
    "known_item": """with t as (select distinct tag, drawer_id id from drawer_tags where tag is not null),
p as (select tag, t.id, trim(regexp_replace(lower(tag), '[^a-z0-9]+', ' ', 'g')) q, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) ti
  from t left join (select distinct id, title from drawers where parent_drawer_id is null) d on d.id = t.id)
select tag query_id, bool_or(coalesce((id <> '' and contains(tag, id)) or (ti <> '' and (contains(q, ti) or contains(ti, q))), false)) known from p group by 1""",
}
