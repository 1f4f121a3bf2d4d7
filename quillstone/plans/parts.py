"""The smaller operators on their own, over whole tables, with their SQL; parts of larger ones keep that operator's code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import vector as vx
from quillstone.operators import bm25, census, evaluate, graph, nested, search, store, sweep, transcripts
from quillstone.plans import logs as log_plans
from quillstone.plans import problems as problem_plans
from quillstone.plans import retrieval as retrieval_plans
from quillstone.plans import scalars as scalar_plans
from quillstone.session import shared_dir
from quillstone.sources import files
from quillstone.sources.tables import table, texts

WING, ROOM, NOW = "harbor_atlas", "runbooks", "2026-01-01 00:00:00"


def _file(values: DataFrame, separator: str = "\n") -> str:
    """The one text column of values as files in the shared folder, for the file sources to read back."""
    path = f"{shared_dir(values.sparkSession)}/lines-{uuid.uuid4().hex}"
    values.write.option("lineSep", separator).text(path)
    return path


# --- scans of files written from the tables --------------------------------------------------------


def scan_jsonl(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples").select("id", "subject", "predicate", "object", "confidence")
    path = _file(t.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([("",), ("  ",)], "value string")))
    return files.json_lines(spark, path, files.FACT).select("id", "subject", "predicate", "object", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    d = census.logical(table(spark, root, "drawers"))
    path = _file(d.select(F.to_json(F.struct(F.col("id").alias("drawer_id"), "wing", "title")).alias("value")))
    return files.corpus(spark, path).select("id", "wing", "title").distinct()


def scan_ground_truth(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "tunnels").where("label is not null and source_drawer_id <> ''")
    t = t.select(F.to_json(F.struct(F.col("label").alias("query"), F.array("source_drawer_id").alias("relevant_drawer_ids"), "kind")).alias("value"))
    return files.ground_truth(spark, _file(t), ["explicit"]).select("query", F.col("relevant_drawer_ids")[0].alias("id")).distinct()


def scan_protected(spark: SparkSession, root: str) -> DataFrame:
    """Ids named by objects, JSON strings and bare lines in one file."""
    t, g = table(spark, root, "tunnels"), table(spark, root, "drawer_deletions")
    both = t.where("source_drawer_id <> '' and target_drawer_id <> ''").select(F.to_json(F.struct(F.array("source_drawer_id", "target_drawer_id").alias("relevant_drawer_ids"))).alias("value"))
    quoted = g.select(F.concat(F.lit('"'), "drawer_id", F.lit('"')).alias("value"))
    bare = table(spark, root, "drawer_tags").select(F.col("drawer_id").alias("value"))
    return files.protected_ids(spark.read.text(_file(both.unionByName(quoted).unionByName(bare))))


def scan_git_log(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").where("text is not null")
    fields = [F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), F.lit("2024"), tx.derive_title("text"), F.col("text"), F.lit("a.py\nb.py")]
    log = files.git_log(spark, _file(d.select(F.concat_ws("\x1f", *fields).alias("value")), "\x1e"))
    return log.select(F.col("sha").cast("bigint").alias("doc_id"), F.md5("body").alias("body_md5"), "files")


def scan_pr_list(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "eval_items")
    one = F.struct(F.col("item_id").alias("number"), F.col("kind").alias("title"), F.col("text").alias("body"), F.array(F.struct(F.col("kind").alias("name"))).alias("labels"))
    return files.pull_requests(spark, _file(e.agg(F.to_json(F.collect_list(one)).alias("value")))).select("number", "title", "labels", F.md5("body").alias("body_md5"))


def scan_ready_issues(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "eval_items")
    one = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("description"), F.array(F.struct(F.col("kind").alias("id"))).alias("dependencies"))
    return files.ready_issues(spark, _file(e.agg(F.to_json(F.struct(F.collect_list(one).alias("issues"))).alias("value")))).select("id", F.array_join("deps", ",").alias("deps"))


def scan_frontmatter(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").where("text is not null").select("doc_id", F.concat(F.lit("---\nwing: '"), F.coalesce("wing", F.lit("")), F.lit("' # set\nn: 1\n---\n"), "text").alias("t"))
    return d.select("doc_id", files.yaml_scalar(files.front_matter("t"), "wing").alias("wing"))


def validate_jsonl(spark: SparkSession, root: str) -> DataFrame:
    """Per file: lines that are not blank, and those of them that are no JSON object."""
    lines = texts(spark, root, "agent_records").where("trim(raw) <> ''").select("record_id", "file_name", "line_no", "raw")
    good = nested.parse_lines(lines).select("record_id", F.lit(1).alias("good"))
    return lines.join(good, "record_id", "left").groupBy("file_name").agg(F.count("*").alias("n"), F.count_if(F.col("good").isNull()).alias("n_bad"))


# --- the store -------------------------------------------------------------------------------------


def upsert_anti(spark: SparkSession, root: str) -> DataFrame:
    """Drawers after an upsert of all logical ones under room 'moved'."""
    d = table(spark, root, "drawers").select("id", "room").groupBy("id").agg(F.min("room").alias("room"))
    new = census.logical(table(spark, root, "drawers")).select("id", F.lit("moved").alias("room")).distinct()
    return store.upsert(d, new, ["id"]).groupBy("room").agg(F.count("*").alias("n"))


def chunk_id(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers").where("chunk_index is not null and parent_drawer_id <> ''")
    return d.select("id", tx.chunk_id("parent_drawer_id", "chunk_index").alias("chunk_id")).distinct()


# --- projections and joins -------------------------------------------------------------------------


def preview_200(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.substring("text", 1, 200).alias("preview"))


def snippet_300(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.substring("text", 1, 300).alias("snippet"))


def fact_shape(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples").withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))
    return graph.facts_about(t, "project:loomcraft", "outgoing", "2024-06-01 00:00:00").withColumn("valid_from", tx.iso("valid_from")).withColumn("valid_to", tx.iso("valid_to"))


def preview_lookup(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "tunnels").select("id", "target_drawer_id").distinct()
    d = table(spark, root, "drawers").groupBy(F.col("id").alias("target_drawer_id")).agg(F.min(F.substring("text", 1, 300)).alias("p"))
    return t.join(d, "target_drawer_id", "left").select("id", F.coalesce("p", F.lit("")).alias("preview"))


def self_wing_hop(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of rooms that share a wing."""
    p = table(spark, root, "drawers").select("wing", "room").distinct()
    return p.withColumnRenamed("room", "a").join(p.withColumnRenamed("room", "b"), "wing").where("a < b").select("a", "b").distinct()


def files_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Documents that share a path: per path the first of them and each of them."""
    d = texts(spark, root, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("o"), tx.extract_paths("text").alias("paths"))
    c = sweep.claims(d, "o")
    # Membership: a path with m documents is m rows, not the m * m pairs that it stands for.
    named = c.groupBy("p").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return c.join(named, "p").select(F.md5("p").alias("path_md5"), "first", "id")


def kg_both(spark: SparkSession, root: str) -> DataFrame:
    """Facts incident to each entity, a loop twice."""
    t = table(spark, root, "kg_triples")
    return t.select(F.col("subject").alias("entity")).unionAll(t.select("object")).groupBy("entity").agg(F.count("*").alias("n"))


def wings_split(spark: SparkSession, root: str) -> DataFrame:
    joined = census.shared_rooms(table(spark, root, "drawers")).select("room", F.array_join("wings", ",").alias("wings"))
    return joined.select("room", F.explode(F.split("wings", ",")).alias("wing"))


# --- scalars ---------------------------------------------------------------------------------------


def truncate_entry(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").select("doc_id", tx.truncate_entry("text").alias("entry"))


def json_escape(spark: SparkSession, root: str) -> DataFrame:
    """Backslash, quote, tab and newline escaped, carriage returns dropped."""
    c = F.col("text")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return texts(spark, root, "documents").select("doc_id", F.md5(c).alias("escaped_md5"))


def failure_regex(spark: SparkSession, root: str) -> DataFrame:
    return texts(spark, root, "documents").where(F.col("text").rlike(transcripts.FAILURE)).select("doc_id")


def test_path(spark: SparkSession, root: str) -> DataFrame:
    p = texts(spark, root, "documents").select(F.explode(tx.extract_paths("text")).alias("path"))
    return p.groupBy(F.col("path").rlike(transcripts.TEST_PATH).alias("is_test")).agg(F.count("*").alias("n"))


def norm_path(spark: SparkSession, root: str) -> DataFrame:
    p = texts(spark, root, "documents").select("doc_id", F.explode(F.split(tx.derive_title("text"), " ")).alias("raw"))
    return p.select("doc_id", tx.norm_path("raw").alias("path")).distinct()


def is_path(spark: SparkSession, root: str) -> DataFrame:
    p = texts(spark, root, "documents").select(F.explode(F.split(F.regexp_replace("text", "\\s+", " "), " ")).alias("raw")).distinct()
    return p.where(tx.is_path(tx.norm_path("raw"))).select("raw")


def pr_url(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", F.concat(F.lit("see https://github.com/org/"), F.coalesce("wing", F.lit("x y")), F.lit("/pull/"), F.col("doc_id").cast("string"), F.lit(" now")).alias("t"))
    return d.select("doc_id", tx.pull_url("t").alias("url"))


def repo_slug(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers").where("wing is not null").select("wing").distinct()
    return d.select("wing", F.array_join(tx.repo_slugs(F.concat(F.lit("git@github.com:org/"), "wing", F.lit(".git"))), ",").alias("slug"))


def id_chip(spark: SparkSession, root: str) -> DataFrame:
    ids = texts(spark, root, "documents").select(F.explode(tx.any_id_scan("text")).alias("id")).distinct()
    return ids.select("id", F.regexp_replace("id", "^[a-z0-9_]+-", "").alias("chip"))


def normalize_dt(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples").select("id", tx.iso("valid_from").alias("x")).distinct()
    return t.select("id", files.normalize_time("x").alias("valid_from"))


def recency_key(spark: SparkSession, root: str) -> DataFrame:
    key = F.coalesce(-F.unix_timestamp(F.col("filed_at").cast("timestamp")).cast("double"), F.lit(float("inf")))
    return table(spark, root, "drawers").groupBy("id").agg(F.min(key).alias("key"))


def token_sets(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").where("text is not null").select("doc_id", tx.word_set(tx.derive_title("text")).alias("a"), tx.word_set("text").alias("b"))
    return d.select("doc_id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("all_"))


def path_sets(spark: SparkSession, root: str) -> DataFrame:
    d = texts(spark, root, "documents").where("text is not null").select("doc_id", tx.extract_paths(tx.derive_title("text")).alias("a"), tx.extract_paths("text").alias("b"))
    return d.select("doc_id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("all_"))


def content_text(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.events(nested.parse_lines(texts(spark, root, "agent_records"))).select("record_id", "text")


def tool_count(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.events(nested.parse_lines(texts(spark, root, "agent_records"))).where("n_tool > 0").select("record_id", "n_tool")


def nested_explode(spark: SparkSession, root: str) -> DataFrame:
    """Items of the lists that tool calls carry: record, block, item, status."""
    p = nested.parse_lines(texts(spark, root, "agent_records")).selectExpr("record_id", "case when schema_of_variant(try_variant_get(doc, '$.message.content', 'variant')) like 'ARRAY%' then try_variant_get(doc, '$.message.content', 'array<variant>') end as blocks")
    b = p.selectExpr("record_id", "posexplode(blocks) as (i, b)").selectExpr("record_id", "i", "case when schema_of_variant(try_variant_get(b, '$.input.todos', 'variant')) like 'ARRAY%' then try_variant_get(b, '$.input.todos', 'array<variant>') end as todos")
    return b.selectExpr("record_id", "i", "posexplode(todos) as (k, t)").selectExpr("record_id", "i", "k", "coalesce(try_variant_get(t, '$.status', 'string'), '') as status")


# --- windows ---------------------------------------------------------------------------------------


def _kept(spark: SparkSession, root: str) -> DataFrame:
    e = transcripts.events(nested.parse_lines(texts(spark, root, "agent_records"))).where("not side and (role = 'assistant' or (role = 'user' and text <> ''))")
    real = (F.col("role") == "user") & ~F.col("text").startswith("<") & ~F.col("text").startswith("[Request interrupted")
    w = Window.partitionBy("file_name").orderBy("line_no", "record_id")
    return e.withColumn("g", F.coalesce(F.sum(real.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


_IN_GROUP = ("file_name", "g")


def consec_assistant(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy(*_IN_GROUP).orderBy("line_no", "record_id")
    return _kept(spark, root).select("record_id", F.count_if(F.col("role") == "assistant").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("consec"))


def tool_calls_running(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("file_name").orderBy("line_no", "record_id")
    return _kept(spark, root).select("record_id", F.count_if((F.col("role") == "assistant") & (F.col("n_tool") > 0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tools"))


def next_turn_upgrade(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("file_name").orderBy("line_no", "record_id")
    k = _kept(spark, root).withColumn("next", F.lead("role").over(w))
    return k.where("role = 'user'").select("record_id", F.coalesce(F.col("next") == "assistant", F.lit(False)).alias("answered"))


def header_lookback(spark: SparkSession, root: str) -> DataFrame:
    """For each line that begins with a bracket, the number of the nearest line above that has text and does not."""
    d = texts(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    slot = F.col("line").rlike(r"^\s*\[")
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("above", F.last(F.when(~slot & F.col("line").rlike(r"\S"), F.col("at")), ignorenulls=True).over(w)).where(slot).select("doc_id", "at", "above")


def longest_first(spark: SparkSession, root: str) -> DataFrame:
    d = census.logical(table(spark, root, "drawers")).select("id", "wing", "room", F.length("text").alias("n")).distinct()
    w = Window.partitionBy("wing", "room").orderBy(F.desc("n"), "id")
    return d.select("id", F.row_number().over(w).alias("rank"))


def max_units(spark: SparkSession, root: str) -> DataFrame:
    """The first thirty surviving units in order. The limit is the feature."""
    return log_plans.commit_score(spark, root).where("score >= 2").orderBy("doc_id").limit(30)


def newest_source(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers").where("source_file is not null and filed_at is not null")
    return d.groupBy("wing").agg(F.max(F.struct("filed_at", "source_file"))["source_file"].alias("source_file"))


def hit_counts(spark: SparkSession, root: str) -> DataFrame:
    p = nested.parse_lines(texts(spark, root, "agent_records"))
    hits = log_plans.struggle_signals(spark, root).agg(F.count("*").alias("hits"), F.countDistinct("file_name").alias("files_hit"))
    return hits.crossJoin(F.broadcast(p.agg(F.countDistinct("file_name").alias("scanned"))))


# --- retrieval parts -------------------------------------------------------------------------------


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.col("doc_id").alias("unit"), F.col("doc_id").alias("cid"), F.coalesce("text", F.lit("")).alias("body"))


def bm25_df(spark: SparkSession, root: str) -> DataFrame:
    return bm25.build(_docs(spark, root)).terms.select("token", F.col("df").cast("bigint").alias("df"))


def idf(spark: SparkSession, root: str) -> DataFrame:
    return bm25.build(_docs(spark, root)).terms.select("token", F.round("idf", 6).alias("idf"))


def avgdl(spark: SparkSession, root: str) -> DataFrame:
    return bm25.build(_docs(spark, root)).terms.agg(F.round(F.max("avgdl"), 6).alias("avgdl"))


def min_dist_per_doc(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    near = search.distances(search.canonical(d).select("cid", "embedding"), retrieval_plans._probe(d)[1]).where("dist is not null")
    return near.groupBy("cid").agg(F.round(F.min("dist"), 6).alias("dist"))


def best_chunk(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    near = search.distances(search.canonical(d).where("chunk_index is not null").select("cid", "chunk_index", "embedding"), retrieval_plans._probe(d)[1]).where("dist is not null")
    return near.groupBy("cid").agg(F.min(F.struct("dist", "chunk_index"))["chunk_index"].alias("best"))


def rrf_sum(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    title, vector = retrieval_plans._probe(d)
    lanes = search.vector_lane(d, vector, 10).unionByName(search.keyword_lane(d, bm25.build(bm25.units(d), clustered=True), title))
    return lanes.groupBy("cid").agg(F.round(F.sum(1.0 / (search.RRF_K + F.col("rank"))), 9).alias("score"))


def dup_top50(spark: SparkSession, root: str) -> DataFrame:
    """The fifty nearest logical rows, whatever their similarity."""
    d = table(spark, root, "drawers")
    return search.check_duplicate(d, retrieval_plans._probe(d)[1], threshold=-2.0).withColumn("similarity", F.round("similarity", 6)).select("id", "similarity")


def l2_to_cosine(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    near = search.distances(d.select("id", "embedding"), retrieval_plans._probe(d)[1]).where("dist is not null")
    return near.groupBy("id").agg(F.round(F.max(vx.l2_to_cosine("dist")), 6).alias("cosine"))


def recall_at_k(spark: SparkSession, root: str) -> DataFrame:
    return retrieval_plans._scored(spark, root, 5).groupBy("kind").agg(F.round(F.sum("r"), 6).alias("recall_sum"), F.sum("n_common").alias("n_common"))


def reciprocal_rank(spark: SparkSession, root: str) -> DataFrame:
    return retrieval_plans._scored(spark, root, 10).groupBy("kind").agg(F.round(F.sum("m"), 6).alias("rr_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_jsonl, scan_corpus, scan_ground_truth, scan_protected, scan_git_log, scan_pr_list, scan_ready_issues, scan_frontmatter, validate_jsonl,
        upsert_anti, 
        chunk_id, preview_200, snippet_300, fact_shape, preview_lookup, self_wing_hop, files_overlap, kg_both, wings_split,
        truncate_entry, json_escape, failure_regex, test_path, norm_path, is_path, pr_url, repo_slug, id_chip,
        normalize_dt, recency_key, token_sets, path_sets, content_text, tool_count, nested_explode, consec_assistant,
        tool_calls_running, next_turn_upgrade, header_lookback, longest_first, max_units, newest_source, 
        hit_counts, bm25_df, idf, avgdl, min_dist_per_doc, best_chunk, rrf_sum, dup_top50,
        l2_to_cosine, recall_at_k, reciprocal_rank, 
    )
}

_TITLE = scalar_plans._FIRST
_PATHS = f"""list_distinct(regexp_extract_all({{0}}, '{scalar_plans._PATH}'))"""
_KEPT = f"""{log_plans._EVENTS},
k as (select *, "role" = 'user' and not starts_with("text", '<') and not starts_with("text", '[Request interrupted') re from ev where not side and ("role" = 'assistant' or ("role" = 'user' and "text" <> ''))),
kg as (select *, coalesce(sum(re::int) over (partition by file_name order by line_no, record_id rows between unbounded preceding and 1 preceding), 0) g from k)"""
_PROBE, _CID, _D2P, _USABLE = retrieval_plans._PROBE, retrieval_plans._CID, retrieval_plans._D2P, retrieval_plans._USABLE
_DOCS = retrieval_plans._bm25('select doc_id unit, doc_id cid, coalesce("text", chr(0)) body from documents', 'select item_id query_id, "text" query from eval_items order by item_id limit 1')
_RANK = f"""{retrieval_plans._NEAR},
f as (select query_id, id, row_number() over (partition by query_id order by "rank") p from r where "rank" <= 11 and id <> query_id),
rel as (select q.vec_id query_id, q."label" kind, e.vec_id id from embeddings q join embeddings e on q."label" = e."label" and q.vec_id <> e.vec_id where q.vec_id % 20 = 0)"""
_COUNTS = problem_plans.SQL["p1_counts"]

SQL = {
    "scan_jsonl": "select id, subject, predicate, object, round(confidence::double, 4) confidence from kg_triples",
    "scan_corpus": "select distinct id, wing, title from drawers where parent_drawer_id is null",
    "scan_ground_truth": """select distinct "label" query, source_drawer_id id from tunnels where "label" is not null and source_drawer_id <> '' and kind = 'explicit'""",
    "scan_protected": """select source_drawer_id id from tunnels where source_drawer_id <> '' and target_drawer_id <> '' union select target_drawer_id from tunnels where source_drawer_id <> '' and target_drawer_id <> ''
union select drawer_id from drawer_deletions where drawer_id is not null union select trim(drawer_id, chr(10) || ' ') from drawer_tags where trim(drawer_id, chr(10) || ' ') <> ''""",
    "scan_git_log": r"""select doc_id, md5(trim(regexp_replace("text", '[\r\n]+', ' ', 'g'))) body_md5, 'a.py,b.py' files from documents where "text" is not null""",
    "scan_pr_list": """select item_id number, kind title, kind labels, md5("text") body_md5 from eval_items""",
    "scan_ready_issues": "select item_id::varchar id, kind deps from eval_items",
    "scan_frontmatter": """select doc_id, nullif(wing, '') wing from documents where "text" is not null""",
    "validate_jsonl": """select file_name, count(*) n, count(*) filter (not case when json_valid(raw) then json_type(raw::json) = 'OBJECT' else false end) n_bad from agent_records where trim(raw) <> '' group by 1""",
    "upsert_anti": """with l as (select distinct id from drawers where parent_drawer_id is null), a as (select id, min(room) room from drawers group by id)
select room, count(*) n from (select room from a where id not in (select id from l) union all select 'moved' from l) group by 1""",
    "chunk_id": "select distinct id, parent_drawer_id || '_chunk_' || lpad(chunk_index::varchar, 6, '0') chunk_id from drawers where chunk_index is not null and parent_drawer_id <> ''",
    "preview_200": 'select doc_id, substr("text", 1, 200) preview from documents',
    "snippet_300": 'select doc_id, substr("text", 1, 300) snippet from documents',
    "fact_shape": """select 'outgoing' direction, id, subject, predicate, object, round(confidence::double, 4) confidence, strftime(valid_from, '%Y-%m-%dT%H:%M:%S') valid_from, strftime(valid_to, '%Y-%m-%dT%H:%M:%S') valid_to, "current"
from kg_triples where subject = 'project:loomcraft' and (valid_from is null or valid_from <= timestamp '2024-06-01') and (valid_to is null or valid_to > timestamp '2024-06-01')""",
    "preview_lookup": """with t as (select distinct id, target_drawer_id d from tunnels) select t.id, coalesce(p, '') preview from t left join (select id, min(substr("text", 1, 300)) p from drawers group by id) x on x.id = t.d""",
    "self_wing_hop": "select distinct x.room a, y.room b from drawers x join drawers y on x.wing = y.wing and x.room < y.room",
    "files_overlap": f"""with p as (select doc_id, unnest({_PATHS.format('"text"')}) p from documents), w as (select *, min(doc_id) over (partition by p) f, count(*) over (partition by p) n from p)
select md5(p) path_md5, f "first", doc_id id from w where n > 1""",
    "kg_both": "select e entity, count(*) n from (select subject e from kg_triples union all select object from kg_triples) group by 1",
    "wings_split": "select distinct room, wing from drawers where wing is not null and room in (select room from drawers group by room having count(distinct wing) >= 2)",
    "truncate_entry": r"""select doc_id, case when length(b) > 200 then substr(b, 1, 200) || '...' else b end entry from (select doc_id, regexp_replace("text", '[\t-\r ]+$', '') b from documents)""",
    "json_escape": r"""select doc_id, md5(replace(replace(replace(replace(replace("text", '\', '\\'), '"', '\"'), chr(9), '\t'), chr(10), '\n'), chr(13), '')) escaped_md5 from documents""",
    "failure_regex": f"""select doc_id from documents where regexp_matches("text", '{transcripts.FAILURE}')""",
    "test_path": f"""select regexp_matches(p, '{transcripts.TEST_PATH}') is_test, count(*) n from (select unnest({_PATHS.format('"text"')}) p from documents) group by 1""",
    "norm_path": rf"""with r as (select doc_id, unnest(string_split({_TITLE}, ' ')) raw from documents)
select distinct doc_id, regexp_replace(regexp_replace(trim(regexp_replace(raw, '[(\[].*$', ''), ' '), '^optional ', ''), '/$', '') path from r""",
    "is_path": r"""with r as (select distinct unnest(string_split(regexp_replace("text", '[\t-\r ]+', ' ', 'g'), ' ')) raw from documents),
n as (select raw, regexp_replace(regexp_replace(trim(regexp_replace(raw, '[(\[].*$', ''), ' '), '^optional ', ''), '/$', '') p from r)
select raw from n where p <> '' and not regexp_matches(p, '[\t-\r ]') and not starts_with(p, '(') and (contains(p, '/') or regexp_matches(p, '^\..') or regexp_matches(p, '^.+\.[^.]+$'))""",
    "pr_url": """select doc_id, case when wing is null then null else 'https://github.com/org/' || wing || '/pull/' || doc_id end url from documents""",
    "repo_slug": "select distinct wing, 'org/' || wing slug from drawers where wing is not null",
    "id_chip": f"""select id, regexp_replace(id, '^[a-z0-9_]+-', '') chip from (select distinct unnest(regexp_extract_all("text", '{scalar_plans._IDS}', 1)) id from documents)""",
    "normalize_dt": "select distinct id, valid_from from kg_triples",
    "recency_key": "select id, min(coalesce(-epoch(filed_at), 'inf'::double)) key from drawers group by id",
    "token_sets": f"""with t as (select doc_id, {log_plans._WORDS.format(_TITLE)} a, {log_plans._WORDS.format('"text"')} b from documents where "text" is not null)
select doc_id, len(list_intersect(a, b))::int common, len(list_distinct(list_concat(a, b)))::int all_ from t""",
    "path_sets": f"""with t as (select doc_id, {_PATHS.format(_TITLE)} a, {_PATHS.format('"text"')} b from documents where "text" is not null)
select doc_id, len(list_intersect(a, b))::int common, len(list_distinct(list_concat(a, b)))::int all_ from t""",
    "content_text": f'with {log_plans._EVENTS} select record_id, "text" from ev',
    "tool_count": f"with {log_plans._EVENTS} select record_id, n_tool from ev where n_tool > 0",
    "nested_explode": f"""with {log_plans._OK}, {log_plans._ITEMS}, t as (select record_id, i::int i, b->'$.input.todos' c from it where json_type(b->'$.input.todos') = 'ARRAY'),
u as (select record_id, i, (n - 1)::int k, json_extract(c, '$[' || (n - 1)::varchar || ']') x from (select record_id, i, c, unnest(range(1, json_array_length(c)::bigint + 1)) n from t)) select record_id, i, k, coalesce(x->>'$.status', '') status from u""",
    "consec_assistant": f"""with {_KEPT} select record_id, count(*) filter ("role" = 'assistant') over (partition by file_name, g order by line_no, record_id rows between unbounded preceding and current row) consec from kg""",
    "tool_calls_running": f"""with {_KEPT} select record_id, count(*) filter ("role" = 'assistant' and n_tool > 0) over (partition by file_name order by line_no, record_id rows between unbounded preceding and current row) tools from kg""",
    "next_turn_upgrade": f"""with {_KEPT}, n as (select *, lead("role") over (partition by file_name order by line_no, record_id) nx from kg) select record_id, coalesce(nx = 'assistant', false) answered from n where "role" = 'user'""",
    "header_lookback": r"""with l as (select doc_id, generate_subscripts(a, 1) - 1 i, unnest(a) x from (select doc_id, string_split("text", chr(10)) a from documents where "text" is not null)),
f as (select *, regexp_matches(x, '^[\t-\r ]*\[') s from l),
w as (select *, last_value(case when not s and regexp_matches(x, '[^\t-\r ]') then i end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) above from f)
select doc_id, i::int "at", above::int above from w where s""",
    "longest_first": """with d as (select distinct id, wing, room, length("text") n from drawers where parent_drawer_id is null) select id, row_number() over (partition by wing, room order by n desc, id)::int "rank" from d""",
    "max_units": f"with {log_plans._UNIT} select doc_id, score from cs where score >= 2 order by doc_id limit 30",
    "newest_source": "select wing, arg_max(source_file, (filed_at, source_file)) source_file from drawers where source_file is not null and filed_at is not null group by 1",
    "hit_counts": f"""select count(*) hits, count(distinct file_name) files_hit, (select count(distinct file_name) from agent_records where json_valid(raw) and case when json_valid(raw) then json_type(raw::json) = 'OBJECT' else false end) scanned from ({log_plans.SQL["struggle_signals"].replace("select record_id, file_name, cls", "select record_id, file_name, cls", 1)})""",
    "bm25_df": f"with {_DOCS} select t token, df::bigint df from term",
    "idf": f"with {_DOCS} select t token, round(idf, 6) idf from term",
    "avgdl": f"with {_DOCS} select round(max(avgdl), 6) avgdl from term",
    "min_dist_per_doc": f"with {_PROBE} select {_CID} cid, round(min({_D2P}), 6) dist from drawers, probe where {_USABLE} group by 1",
    "best_chunk": f"with {_PROBE}, d as (select {_CID} cid, chunk_index, {_D2P} dist from drawers, probe where {_USABLE} and chunk_index is not null) select cid, min_by(chunk_index, (dist, chunk_index)) best from d group by 1",
    "rrf_sum": f"""with {_PROBE}, {retrieval_plans._KEY}, {retrieval_plans._klane()}, {retrieval_plans._vlane()} select cid, round(sum(1.0::double / (60 + "rank")), 9) score from (select * from vlane union all select * from klane) group by cid""",
    "dup_top50": f"with {_PROBE}, n as (select distinct id, wing, room, {_D2P} dist from drawers, probe where parent_drawer_id is null and {_USABLE} order by dist, id limit 50) select id, round(1 - dist / 2, 6) similarity from n where 1 - dist / 2 >= -2",
    "l2_to_cosine": f"with {_PROBE} select id, round(max(1 - {_D2P} / 2), 6) cosine from drawers, probe where {_USABLE} group by id",
    "recall_at_k": f"""with {_RANK}, s as (select rel.query_id, any_value(kind)::varchar kind, count(f.id) filter (p <= 5) c, count(*) n from rel left join f using (query_id, id) group by 1)
select kind, round(sum(c / n), 6) recall_sum, sum(c)::bigint n_common from s group by 1""",
    "reciprocal_rank": f"""with {_RANK}, s as (select rel.query_id, any_value(kind)::varchar kind, coalesce(1.0::double / min(p), 0) m from rel left join f using (query_id, id) group by 1) select kind, round(sum(m), 6) rr_sum from s group by 1""",
}
