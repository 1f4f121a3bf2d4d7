"""Scalar functions applied to whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import vector as vx
from quillstone.operators import census
from quillstone.sources import files
from quillstone.sources.tables import table, texts

NOW = "2026-01-01 00:00:00"


def content_hash(spark: SparkSession, root: str) -> DataFrame:
    d = census.logical(table(spark, root, "drawers"))
    return d.select("id", tx.content_hash("wing", "room", "text").alias("content_hash")).distinct()


def drawer_id(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").where("source is not null and lang is not null and text is not null")
    return d.select("doc_id", tx.drawer_id("source", "lang", "text").alias("drawer_id"))


def tunnel_id(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "tunnels")
    return t.select("id", tx.tunnel_id("source_wing", "source_room", "target_wing", "target_room").alias("tunnel_id")).distinct()


def chunk_text(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return tx.exploded_chunks(d)


def tokenize(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").where("text is not null").select("doc_id", F.explode(tx.tokens("text")).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def expand_identifier(spark: SparkSession, root: str) -> DataFrame:
    t = texts(spark, root, "documents").select(F.explode(tx.tokens("text")).alias("token")).distinct().where("token rlike '[._-]'")
    return t.select("token", F.array_join(tx.expand(F.col("token")), " ").alias("expanded"))


def derive_title(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").select("doc_id", tx.derive_title("text").alias("title"))


def title_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").select("id", F.array_join(tx.title_tokens("title"), " ").alias("tokens")).distinct()


def leading_id(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").select("id", tx.leading_id("title").alias("leading_id")).distinct()


def normalize_alnum(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").select("id", tx.normalized("title").alias("normalized")).distinct()


def jaccard_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Title against first line of the text, of each logical drawer."""
    d = census.logical(table(spark, root, "drawers")).select("id", "title", tx.derive_title("text").alias("first"))
    return d.select("id", F.round(tx.jaccard(tx.word_set("title"), tx.word_set("first"), 0.0), 6).alias("similarity")).distinct()


def id_prefixes(spark: SparkSession, root: str) -> DataFrame:
    ids = texts(spark, root, "documents").select(F.explode(tx.any_id_scan("text")).alias("id"))
    return ids.select(tx.id_prefix("id").alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def id_scan(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").select("doc_id", F.explode(tx.any_id_scan("text")).alias("issue_id"))


def extract_paths(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").select("doc_id", F.explode(tx.extract_paths("text")).alias("path"))


def path_cluster(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").select("doc_id", F.array_join(tx.extract_paths("text"), ",").alias("files"))
    return d.select("doc_id", tx.cluster_key("files").alias("cluster"))


def row_serialize(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").select("id", tx.iso("filed_at").alias("filed_at")).distinct()


def previews(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").select("id", F.substring("text", 1, 200).alias("preview"), F.substring("text", 1, 300).alias("snippet"), tx.truncate_entry("title", 20).alias("entry")).distinct()


def strip_fence(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").where("text like '%```%'")
    return d.select("doc_id", F.md5(tx.strip_fences("text")).alias("body_md5"))


def age_bucket(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples").where(f"created_at <= timestamp_ntz '{NOW}'")
    return t.select(tx.age_bucket("created_at", F.lit(NOW).cast("timestamp_ntz")).alias("age")).groupBy("age").agg(F.count("*").alias("n"))


def days_between(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples").where("valid_from is not null and valid_to is not null")
    s = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return t.select("id", F.floor((s("valid_to") - s("valid_from")) / 86400).alias("days")).distinct()


def json_get(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("")).alias("missing"))


def l2_squared(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    d = e.crossJoin(F.broadcast(q)).select("vec_id", vx.l2_squared("embedding", "q").alias("d2"))
    return d.select("vec_id", F.round("d2", 6).alias("l2_squared"), F.round(vx.l2_to_cosine("d2"), 6).alias("cosine"))


def cosine_distance(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(vx.cosine_distance("embedding", "q"), 6).alias("distance"))


def vector_literal(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", vx.rounded("embedding").alias("embedding"))


def manifest_hash(spark: SparkSession, root: str) -> DataFrame:
    """One digest per wing over its sorted 'id  sha256' lines."""
    d = census.logical(table(spark, root, "drawers")).select("wing", F.concat("id", F.lit("  "), F.sha2("text", 256), F.lit("\n")).alias("line")).distinct()
    return files.manifest_digests(d, "wing")


def wing_variants(spark: SparkSession, root: str) -> DataFrame:
    return census.wing_variants(table(spark, root, "drawers"), tx.wing_slug("wing"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, drawer_id, tunnel_id, chunk_text, tokenize, expand_identifier, derive_title, title_tokens, leading_id, normalize_alnum,
        jaccard_tokens, id_prefixes, id_scan, extract_paths, path_cluster, row_serialize, previews, strip_fence, age_bucket, days_between,
        json_get, l2_squared, cosine_distance, vector_literal, manifest_hash, wing_variants,
    )
}

_TOK = tx.TOKEN
_PATH = r"[A-Za-z0-9_./-]+\.(?:" + "|".join(sorted(tx.PATH_EXTENSIONS, key=len, reverse=True)) + r")\b"
_IDS = r"(?:^|[^A-Za-z0-9._/-])([a-z][a-z0-9_]*-[0-9a-f]{3}(?:\.[0-9]+)*)"
_FRAMED = "length(wing) || ':' || wing || length(room) || ':' || room || length(\"text\") || ':' || \"text\""
_LINES = f"""list_filter(list_transform(regexp_split_to_array(coalesce("text", ''), '{tx.LINE_END}'), lambda x: regexp_replace(x, '^{tx.BLANKS}|{tx.BLANKS}$', '', 'g')), lambda x: x <> '')"""
_FIRST = f"coalesce(substr({_LINES}[1], 1, 512), '(untitled)')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: length(t) >= 3))"
_FILES = f"""array_to_string(list_sort(list_distinct(regexp_extract_all("text", '{_PATH}'))), ',')"""

SQL = {
    "content_hash": f"select distinct id, substr(sha256({_FRAMED}), 1, 24) content_hash from drawers where parent_drawer_id is null",
    "drawer_id": """select doc_id, 'drawer_' || source || '_' || lang || '_' ||
  substr(sha256(length(source) || ':' || source || length(lang) || ':' || lang || length("text") || ':' || "text"), 1, 24) drawer_id
from documents where source is not null and lang is not null and "text" is not null""",
    "tunnel_id": """select distinct id, substr(sha256(least(a, b) || '|' || greatest(a, b)), 1, 16) tunnel_id
from (select id, source_wing || '/' || source_room a, target_wing || '/' || target_room b from tunnels)""",
    "chunk_text": """select doc_id::varchar parent_id, doc_id::varchar || '_chunk_' || lpad(i::varchar, 6, '0') id, i::int chunk_index, substr("text", (i * 800 + 1)::bigint, 800) "text"
from (select doc_id, "text", unnest(range(0, ceil(length("text") / 800.0)::bigint)) i from documents where length("text") > 800)""",
    "tokenize": f"""select doc_id, token, count(*) n from (select doc_id, unnest(regexp_extract_all(lower("text"), '{_TOK}')) token from documents) group by 1, 2""",
    "expand_identifier": f"""with t as (select distinct token from (select unnest(regexp_extract_all(lower("text"), '{_TOK}')) token from documents) where regexp_matches(token, '[._-]')),
p as (select token, 0 o, 0 i, token part from t
  union all select token, 1, generate_subscripts(regexp_split_to_array(token, '[._-]'), 1), unnest(regexp_split_to_array(token, '[._-]')) from t
  union all select token, 2, i, regexp_extract(token, '^((?:[a-z0-9]+[._-]){{' || (i - 1)::varchar || '}}[a-z0-9]+)', 1) from (select token, unnest(range(1, len(regexp_split_to_array(token, '[._-]')))) i from t)),
f as (select token, part, min(o * 1000 + i) k from p group by 1, 2)
select token, string_agg(part, ' ' order by k) expanded from f group by token""",
    "derive_title": f"select doc_id, {_FIRST} title from documents",
    "title_tokens": f"""with t as (select distinct id, regexp_extract_all(lower(coalesce(title, '')), '{tx.TITLE_TOKEN}') a from drawers),
u as (select id, tok, min(i) i from (select id, unnest(a) tok, generate_subscripts(a, 1) i from t) group by 1, 2)
select id, coalesce(string_agg(tok, ' ' order by i), '') tokens from t left join u using (id) group by id""",
    "leading_id": r"""select distinct id, case when regexp_matches(f, '^[a-z][a-z0-9]*-[a-z0-9][a-z0-9.]*$') then f end leading_id
from (select id, lower(regexp_extract(coalesce(title, ''), '^[# ]*\s*(\S+)', 1)) f from drawers)""",
    "normalize_alnum": "select distinct id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) normalized from drawers",
    "jaccard_tokens": f"""with w as (select id, {_WORDS.format('title')} a, {_WORDS.format(_FIRST)} b from drawers where parent_drawer_id is null),
n as (select id, len(list_intersect(a, b)) i, len(a) + len(b) - len(list_intersect(a, b)) u from w)
select distinct id, case when u = 0 then 0.0 else round(i / u, 6) end similarity from n""",
    "id_prefixes": rf"""select nullif(regexp_extract(regexp_extract(id, '^([^.]*)', 1), '^(.+)-[a-z0-9]{{3,}}$', 1), '') prefix, count(*) n
from (select unnest(list_distinct(regexp_extract_all("text", '{_IDS}', 1))) id from documents) group by 1""",
    "id_scan": f"""select doc_id, unnest(list_distinct(regexp_extract_all("text", '{_IDS}', 1))) issue_id from documents""",
    "extract_paths": f"""select doc_id, unnest(list_distinct(regexp_extract_all("text", '{_PATH}'))) path from documents""",
    "path_cluster": rf"""with f as (select doc_id, coalesce({_FILES}, '') f from documents)
select doc_id, case when lower(f) like '%schema%' then 'schema' when lower(f) like '%migrat%' then 'migrat' when lower(f) like '%proto%' then 'proto'
  when lower(f) like '%interface%' then 'interface' when lower(f) like '%config%' then 'config'
  when split_part(f, ',', 1) like '%/%' then split_part(split_part(f, ',', 1), '/', 1) when f = '' then '_misc' else '_root' end "cluster" from f""",
    "row_serialize": "select distinct id, strftime(filed_at, '%Y-%m-%dT%H:%M:%S') filed_at from drawers",
    "previews": r"""select distinct id, substr("text", 1, 200) preview, substr("text", 1, 300) snippet,
  case when length(b) > 20 then substr(b, 1, 20) || '...' else b end entry from (select *, regexp_replace(title, '[\t-\r ]+$', '') b from drawers)""",
    "strip_fence": """select doc_id, md5(array_to_string(list_filter(string_split("text", chr(10)), lambda x: not starts_with(x, '```')), chr(10))) body_md5
from documents where "text" like '%```%'""",
    "age_bucket": f"""with s as (select (epoch(timestamp '{NOW}') - epoch(created_at))::bigint s from kg_triples where created_at <= timestamp '{NOW}')
select case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h' else (s // 86400) || 'd' end age, count(*) n from s group by 1""",
    "days_between": "select distinct id, floor((epoch(valid_to)::bigint - epoch(valid_from)::bigint) / 86400.0)::bigint \"days\" from kg_triples where valid_from is not null and valid_to is not null",
    "json_get": "select event_id, coalesce(props::json->>'$.k', '') k, coalesce(props::json->>'$.none', '') missing from events",
    "l2_squared": """with d as (select e.vec_id, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)) d
  from embeddings e, embeddings q where q.vec_id = 0) select vec_id, round(d, 6) l2_squared, round(1 - d / 2, 6) cosine from d""",
    "cosine_distance": """select e.vec_id, round(1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) distance
from embeddings e, embeddings q where q.vec_id = 1""",
    "vector_literal": "select vec_id, list_transform(embedding, lambda x: round(x::double, 6)) embedding from embeddings",
    "manifest_hash": """select wing, sha256(string_agg(line, '' order by line)) manifest
from (select distinct wing, id || '  ' || sha256("text") || chr(10) line from drawers where parent_drawer_id is null) group by wing""",
    "wing_variants": """with w as (select wing, count(*) n, regexp_replace(replace(lower(trim(wing)), '-', '_'), 's$', '') slug from drawers where wing is not null group by wing),
m as (select *, first_value(wing) over (partition by slug order by n desc, wing) main, first_value(n) over (partition by slug order by n desc, wing) main_n from w)
select wing, n, main, main_n from m where wing <> main""",
}
