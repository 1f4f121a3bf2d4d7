"""Queries of the operators in this folder, with SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import abuse, leakage, mixing, neardup, splitting, vectors
from quillstone.sources.tables import table, texts


def _near(spark: SparkSession, root: str) -> neardup.NearDuplicates:
    bodies = neardup.drawer_bodies(texts(spark, root, "drawers"))
    return neardup.near_duplicates(bodies, t=0.5, k=3, min_words=20)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).expanded()


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).groups()


def _neighbours(spark: SparkSession, root: str) -> DataFrame:
    return vectors.nearest(table(spark, root, "drawers").select("id", "embedding"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return vectors.neighbour_pairs(_neighbours(spark, root))


def p3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return _neighbours(spark, root)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.resplit(texts(spark, root, "drawers")).select(F.col("parent_drawer_id").alias("drawer_id")).distinct()


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.pieces(texts(spark, root, "drawers"))


def p4_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold for the pieces of every drawer over the limit: size, numbering, overlap, and that they cover the text."""
    drawers = texts(spark, root, "drawers")
    own = F.struct("chunk_index", "text", "overlap")
    # A drawer's pieces together are little longer than its text.
    per = splitting.pieces(drawers).groupBy(F.col("parent_drawer_id").alias("drawer_id")).agg(
        (F.max(F.length("text")) <= 800).alias("fits"),
        ((F.min("chunk_index") == 0) & (F.max("chunk_index") == F.count("*") - 1) & (F.countDistinct("chunk_index") == F.count("*"))).alias("numbered"),
        F.bool_and(F.when(F.col("chunk_index") == 0, F.col("overlap") == 0).otherwise(F.col("overlap").between(1, 120))).alias("overlapping"),
        F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda x: F.substring(x["text"], x["overlap"] + 1, 800)), "").alias("joined"),
    )
    whole = drawers.where("parent_drawer_id is null or parent_drawer_id = ''").select(F.col("id").alias("drawer_id"), F.sha2("text", 256).alias("h")).distinct()
    return per.join(whole, "drawer_id").select("drawer_id", "fits", "numbered", "overlapping", (F.sha2("joined", 256) == F.col("h")).alias("whole"))


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(texts(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id")


def p7_overlap(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root)


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, root))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(texts(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(texts(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_checks(spark: SparkSession, root: str) -> DataFrame:
    """Per target what must hold of the mix: no document above its cap, and the tokens within 2 % and one document of what the cap lets it reach."""
    docs, targets = texts(spark, root, "documents"), table(spark, root, "mix_targets")
    made = mixing.shares(docs, targets)
    worst = mixing.mix(docs, targets).groupBy("source").agg(F.max("copy").alias("most"))
    # One row a target: the window is over a short list.
    planned = F.sum("tokens").over(Window.partitionBy())
    goal = F.least(F.col("target_share") * planned, F.col("max_repeats") * F.col("tokens"))
    near = F.abs(F.col("mix_tokens") - goal) <= 0.02 * goal + F.col("largest")
    return made.withColumn("near", near).join(worst, "source", "left").select("source", "n_docs", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"), "near")


def _scores(spark: SparkSession, root: str) -> DataFrame:
    return abuse.fitted_scores(texts(spark, root, "documents"), table(spark, root, "doc_labels"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _scores(spark, root).where("flagged").select("doc_id")


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    return _scores(spark, root)


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(texts(spark, root, "documents"), _scores(spark, root))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_groups, p3_found, p3_neighbours, p4_found, p4_pieces, p4_checks, p7_found, p7_overlap, p7_items,
        p8_mix, p8_shares, p8_checks, p9_found, p9_scores, p9_rates,
    )
}

_SHINGLES = r"""
with w as (
  select distinct id, list_transform(regexp_extract_all(coalesce(title, '') || chr(10) || coalesce("text", ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) w
  from drawers where parent_drawer_id is null or parent_drawer_id = ''),
s as (
  select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
  from (select id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 20)),
n as (select id, count(*) n from s group by id),
p as (select a.id id_a, b.id id_b, count(*) c from s a join s b on a.g = b.g and a.id < b.id group by 1, 2),
pairs as (select id_a, id_b from p join n x on x.id = id_a join n y on y.id = id_b where 2 * c >= x.n + y.n - c)"""

_GROUPS = f"""{_SHINGLES.replace("with w as", "with recursive w as", 1)},
m as (select id, min(id) over (partition by w) rep from (select id, w from w where len(w) >= 20)),
e as (select distinct a.rep a, b.rep b from pairs join m a on a.id = id_a join m b on b.id = id_b where a.rep <> b.rep),
l as (select a, b from e union select b, a from e),
r(x, y) as (select rep, rep from m union select r.x, l.b from r join l on l.a = r.y)
select m.id, m.rep class_id, (select min(y) from r where r.x = m.rep) group_id, (select count(*) from l where l.a = m.rep) n_links from m"""

_NEAREST = """
with u as (
  select distinct on (id) id, embedding::double[] v from drawers
  where embedding is not null and len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: isnan(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
c as (select a.id, b.id neighbour, round(list_cosine_similarity(a.v, b.v), 10) cosine from u a join u b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by cosine desc, neighbour)::int "rank" from c),
nn as (select * from r where "rank" <= 5 and cosine >= 0.85)"""

_RUNS = r"""
with w as (select doc_id, list_transform(regexp_extract_all("text", '[\p{L}\p{N}]+'), lambda x: lower(x)) w from documents where "text" is not null),
v as (select item_id, list_transform(regexp_extract_all("text", '[\p{L}\p{N}]+'), lambda x: lower(x)) w from eval_items where "text" is not null),
i as (select item_id, x, list_aggregate(w[x : x + 9], 'string_agg', ' ') g from (select item_id, w, unnest(range(1, len(w) - 8)) x from v where len(w) >= 10)),
d as (select distinct doc_id, list_aggregate(w[x : x + 9], 'string_agg', ' ') g from (select doc_id, w, unnest(range(1, len(w) - 8)) x from w where len(w) >= 10))"""

SQL = {
    "p2_found": f"{_SHINGLES} select id_a, id_b from pairs",
    "p4_found": """
with big as (select distinct on (id) id, "text" from drawers where (parent_drawer_id is null or parent_drawer_id = '') and length("text") > 800),
ch as (select distinct parent_drawer_id p, chunk_index i, "text" t from drawers where parent_drawer_id is not null and parent_drawer_id <> ''),
j as (select p, count(*) n, count(distinct i) k, min(i) lo, max(i) hi, string_agg(t, '' order by i) whole from ch group by p)
select id drawer_id from big left join j on p = id where p is null or not (n = k and lo = 0 and hi = n - 1 and whole = "text")""",
    "p7_found": f"{_RUNS} select distinct doc_id, item_id from d join i using (g)",
    "p7_items": f"""{_RUNS}, o as (select distinct doc_id, item_id from d join i using (g)),
c as (select doc_id, item_id, count(distinct k) n from (select doc_id, item_id, unnest(range(x, x + 10)) k from d join i using (g)) group by 1, 2)
select item_id, count(*) n_docs, max(n)::int max_words from o join c using (doc_id, item_id) group by 1""",
    "p2_groups": _GROUPS,
    "p4_checks": """select distinct id drawer_id, true fits, true numbered, true overlapping, true whole
from drawers where (parent_drawer_id is null or parent_drawer_id = '') and length("text") > 800""",
    "p7_overlap": f"""{_RUNS}, q as (select item_id, case when regexp_matches("text", '[?？]') then len(regexp_extract_all(string_split_regex("text", '[?？]')[1], '[\\p{{L}}\\p{{N}}]+')) else 0 end q from eval_items),
k as (select distinct doc_id, item_id, unnest(range(x, x + 10)) k from d join i using (g))
select doc_id, item_id, (count(*) filter (k <= q))::int question_words, (count(*) filter (k > q))::int answer_words from k join q using (item_id) group by 1, 2""",
    "p8_checks": """with c as (select replace(lower(trim(source)), '-', '_') s from documents)
select s0 source, (select count(*) from c where s = s0) n_docs, true capped, true near from (select distinct replace(lower(trim(source)), '-', '_') s0 from mix_targets)""",
    "p3_found": f"{_NEAREST} select distinct least(id, neighbour) id_a, greatest(id, neighbour) id_b from nn",
    "p3_neighbours": f"{_NEAREST} select * from nn",
}
