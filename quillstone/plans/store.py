"""Scans, filters, counts, set operations and graph queries over the store's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import census, graph
from quillstone.sources.tables import table, texts

ROOM, WING_A, WING_B, AT, ENTITY = "runbooks", "harbor_atlas", "quarry", "2024-09-01 00:00:00", "project:loomcraft"


def scan_logical(spark: SparkSession, root: str) -> DataFrame:
    return census.logical(table(spark, root, "drawers")).select("id", "wing", "room", "title").distinct()


def scan_candidates(spark: SparkSession, root: str) -> DataFrame:
    d = census.logical(table(spark, root, "drawers")).where((F.col("wing") == WING_A) & (F.col("room") == ROOM) & F.col("source_file").isNotNull())
    return d.select("id", "title", F.length("text").alias("n_chars"), "source_file").distinct()


def scan_index_corpus(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").select("id", "wing", "room", F.length("title").alias("title_chars"), F.length("text").alias("text_chars"), "parent_drawer_id", "filed_at").distinct()


def scope_filter(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").where((F.col("wing") == WING_A) & (F.col("room") == ROOM)).select("id").distinct()


def like_ci(spark: SparkSession, root: str) -> DataFrame:
    """`_` in the needle is a wildcard."""
    return table(spark, root, "drawers").where(F.lower("title").like("%n_tes on%")).select("id", "title").distinct()


def wing_denylist(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawers").where(F.col("wing").isNotNull() & ~F.col("wing").isin(WING_A, WING_B)).groupBy("wing").agg(F.count("*").alias("n"))


def either_side(spark: SparkSession, root: str) -> DataFrame:
    return graph.list_tunnels(table(spark, root, "tunnels"), WING_A).select("id", "source_wing", "target_wing").distinct()


def list_tunnels(spark: SparkSession, root: str) -> DataFrame:
    return graph.list_tunnels(table(spark, root, "tunnels")).select("id", "source_wing", "source_room", "target_wing", "target_room", "label", "kind").distinct()


def temporal_asof(spark: SparkSession, root: str) -> DataFrame:
    return graph.as_of(table(spark, root, "kg_triples"), AT).select("id", "subject", "predicate", "object").distinct()


def current_only(spark: SparkSession, root: str) -> DataFrame:
    return graph.as_of(table(spark, root, "kg_triples"), None).select("id").distinct()


def kg_query(spark: SparkSession, root: str) -> DataFrame:
    return graph.facts_about(table(spark, root, "kg_triples"), ENTITY, "both", AT).drop("confidence", "current")


def kg_query_current(spark: SparkSession, root: str) -> DataFrame:
    return graph.facts_about(table(spark, root, "kg_triples"), ENTITY).select("direction", "id", "subject", "predicate", "object")


def kg_stats(spark: SparkSession, root: str) -> DataFrame:
    return census.fact_stats(table(spark, root, "kg_triples"))


def kg_stats_fallback(spark: SparkSession, root: str) -> DataFrame:
    return census.fact_stats(table(spark, root, "kg_triples")).select("entities", "triples")


def entity_union(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples")
    return t.select(F.col("subject").alias("entity")).union(t.select("object")).distinct()


def kg_invalidate(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "kg_triples")
    return graph.close_facts(t, AT, triple=("project:loomcraft", "has_status", "active")).groupBy("current").agg(F.count("*").alias("n"), F.count_if(F.col("valid_to") == F.lit(AT).cast("timestamp_ntz")).alias("closed_then"))


def status(spark: SparkSession, root: str) -> DataFrame:
    return census.status(table(spark, root, "drawers"))


def list_wings(spark: SparkSession, root: str) -> DataFrame:
    return census.list_wings(table(spark, root, "drawers"))


def taxonomy(spark: SparkSession, root: str) -> DataFrame:
    return census.taxonomy(table(spark, root, "drawers"))


def taxonomy_nested(spark: SparkSession, root: str) -> DataFrame:
    return census.taxonomy_nested(table(spark, root, "drawers")).select("wing", F.to_json("rooms").alias("rooms"))


def top_wings(spark: SparkSession, root: str) -> DataFrame:
    return census.list_wings(table(spark, root, "drawers")).orderBy(F.desc("n"), "wing").limit(10)


def find_tunnels(spark: SparkSession, root: str) -> DataFrame:
    return census.shared_rooms(table(spark, root, "drawers"), WING_A, WING_B).withColumn("wings", F.array_join("wings", ","))


def find_tunnels_all(spark: SparkSession, root: str) -> DataFrame:
    return census.shared_rooms(table(spark, root, "drawers")).withColumn("wings", F.array_join("wings", ","))


def tunnel_graph_stats(spark: SparkSession, root: str) -> DataFrame:
    return census.room_graph_stats(table(spark, root, "drawers"))


def endpoint_count(spark: SparkSession, root: str) -> DataFrame:
    return census.endpoint_count(table(spark, root, "drawers"), WING_A, ROOM)


def list_page(spark: SparkSession, root: str) -> DataFrame:
    return census.list_page(table(spark, root, "drawers").dropDuplicates(["id", "filed_at"]), 20, 40, wing=WING_A)


def diary_recent(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers").where((F.col("wing") == WING_A) & (F.col("room") == "diary"))
    return d.select("id", "title", "filed_at").distinct().orderBy(F.desc_nulls_last("filed_at"), F.desc("id")).limit(3)


def traverse_graph(spark: SparkSession, root: str) -> DataFrame:
    return graph.rooms_one_hop(table(spark, root, "drawers"), ROOM)


def follow_tunnels(spark: SparkSession, root: str) -> DataFrame:
    return graph.follow_tunnels(table(spark, root, "tunnels"), table(spark, root, "drawers"), WING_A).drop("drawer_id")


def tag_semi(spark: SparkSession, root: str) -> DataFrame:
    """Drawers with all of several tags."""
    tags = table(spark, root, "drawer_tags")
    top = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(2)
    has = tags.join(F.broadcast(top.select("tag")), "tag", "left_semi").groupBy("drawer_id").agg(F.countDistinct("tag").alias("k")).where("k = 2")
    return table(spark, root, "drawers").join(has, F.col("id") == F.col("drawer_id"), "left_semi").select("id", "wing", "room").distinct()


def list_tags(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "drawer_tags").select("drawer_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("n"))


def untag_drawer(spark: SparkSession, root: str) -> DataFrame:
    gone = table(spark, root, "drawer_deletions").select("drawer_id")
    return table(spark, root, "drawer_tags").select("drawer_id", "tag").distinct().join(gone, "drawer_id", "left_anti").groupBy("tag").agg(F.count("*").alias("n"))


def parents_with_children(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers")
    parents = d.select(F.col("parent_drawer_id").alias("id")).where("id <> ''").distinct()
    return census.logical(d).join(parents, "id", "left_anti").select("id").distinct()


def parent_semi(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the logical drawers of one wing and room, their chunks included."""
    d = table(spark, root, "drawers").withColumn("cid", F.coalesce(F.nullif("parent_drawer_id", F.lit("")), F.col("id")))
    chosen = census.logical(d).where((F.col("wing") == WING_A) & (F.col("room") == ROOM)).select("cid").distinct()
    return d.join(chosen, "cid", "left_semi").select("id", "cid").distinct()


def reassemble_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunk texts of each parent joined in order of index; of rows with one index the least text counts."""
    d = table(spark, root, "drawers").where("parent_drawer_id <> '' and chunk_index is not null and text is not null")
    one = d.groupBy("parent_drawer_id", "chunk_index").agg(F.min("text").alias("text"))
    whole = one.groupBy("parent_drawer_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return whole.select("parent_drawer_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join(F.col("c.text"), "")).alias("text_md5"))


def delete_by_source(spark: SparkSession, root: str) -> DataFrame:
    """The preview of a removal: what would go, per source file."""
    return table(spark, root, "drawers").where("source_file is not null").groupBy("source_file").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def delete_drawer(spark: SparkSession, root: str) -> DataFrame:
    """What stays per wing once the logged removals and their chunks are gone."""
    gone = table(spark, root, "drawer_deletions").select(F.col("drawer_id").alias("cid")).distinct()
    d = table(spark, root, "drawers").withColumn("cid", F.coalesce(F.nullif("parent_drawer_id", F.lit("")), F.col("id")))
    return d.join(gone, "cid", "left_anti").join(gone.withColumnRenamed("cid", "id"), "id", "left_anti").groupBy("wing").agg(F.count("*").alias("n"))


def add_drawer(spark: SparkSession, root: str) -> DataFrame:
    """The rows that adding every document would write: parents, chunks, what each row embeds."""
    from quillstone.operators.store import plan_rows

    d = texts(spark, root, "documents").where("source is not null and lang is not null and text is not null")
    d = d.select(F.col("source").alias("wing"), F.col("lang").alias("room"), tx.derive_title("text").alias("title"), "text").distinct()
    rows = plan_rows(d)
    return rows.select("id", F.md5("text").alias("text_md5"), F.md5("embed_source").alias("embed_md5"), "chunk_index", "parent_drawer_id", "is_parent").distinct()


def row_upsert(spark: SparkSession, root: str) -> DataFrame:
    """One row per id: the latest filing, ties by the least added_by."""
    from quillstone.operators.store import latest

    return latest(table(spark, root, "drawers"), ["id"], [F.desc_nulls_last("filed_at"), F.asc_nulls_last("added_by"), F.asc_nulls_last("source_file")]).select("id", "filed_at", "added_by")


def dead_ids(spark: SparkSession, root: str) -> DataFrame:
    """Issue ids cited in documents that no drawer title leads with."""
    cited = texts(spark, root, "documents").select(F.explode(tx.any_id_scan("text")).alias("issue_id")).distinct()
    known = table(spark, root, "drawers").select(tx.leading_id("title").alias("issue_id")).where("issue_id is not null").distinct()
    return cited.join(known, "issue_id", "left_anti")


def catalogue_drift(spark: SparkSession, root: str) -> DataFrame:
    """Predicates listed against predicates used: missing, single or duplicate uses."""
    used = table(spark, root, "kg_triples").groupBy("predicate").agg(F.count("*").alias("n"))
    listed = table(spark, root, "kg_predicates")
    n = F.coalesce("n", F.lit(0))
    return listed.join(used, "predicate", "left").select("predicate", n.alias("n"), F.when(n == 0, "MISSING").when(n > 1, "DUPLICATE").otherwise("OK").alias("state"))


def lines_not_listed(spark: SparkSession, root: str) -> DataFrame:
    used = table(spark, root, "documents").select(F.regexp_replace(F.lower(F.trim("source")), "-", "_").alias("source")).where("source is not null")
    return used.subtract(table(spark, root, "mix_targets").select("source"))


def dup_triples(spark: SparkSession, root: str) -> DataFrame:
    """Facts stored under several ids: equal subject, predicate and object."""
    t = table(spark, root, "kg_triples").select("subject", "predicate", "object", "id").distinct()
    return t.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n_ids")).where("n_ids > 1")


def latency_stats(spark: SparkSession, root: str) -> DataFrame:
    """Index picks on the sorted values, s[n // 2] and s[int(n * 0.95)], and the mean, per event type.

    Ranks come from a window count over runs of equal values, so no list of values is gathered.
    """
    e = table(spark, root, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    n = F.sum("c").over(Window.partitionBy("event_type"))
    r = e.withColumn("upto", upto).withColumn("n", n)
    pick = lambda at: F.min(F.when(F.col("upto") > at, F.col("value")))
    return r.groupBy("event_type").agg(
        pick(F.floor(F.col("n") / 2)).alias("p50"), pick(F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1)).alias("p95"),
        F.round(F.sum(F.col("value") * F.col("c")) / F.sum("c"), 6).alias("mean"),
    )


def fail_fraction(spark: SparkSession, root: str) -> DataFrame:
    """Per transcript file: processed lines, unparseable ones, whether over a quarter of at least four failed."""
    r = table(spark, root, "agent_records").where("trim(raw) <> ''")
    per = r.groupBy("file_name").agg(F.count("*").alias("processed"), F.count_if(F.expr("try_parse_json(raw) is null")).alias("failed"))
    return per.withColumn("abort", (F.col("processed") >= 4) & (F.col("failed") * 100 > F.col("processed") * 25))


def count_jsonl(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "agent_records").where("trim(raw) <> ''").groupBy("file_name").agg(F.count("*").alias("n"))


def scan_tail_n(spark: SparkSession, root: str) -> DataFrame:
    """The last 80 lines of each file."""
    w = Window.partitionBy("file_name").orderBy(F.desc("line_no"), F.desc("record_id"))
    r = table(spark, root, "agent_records").withColumn("r", F.row_number().over(w)).where("r <= 80")
    return r.select("record_id", "file_name", "line_no")


def offsets(spark: SparkSession, root: str) -> DataFrame:
    """Byte offset at which each line of a file starts and ends, one newline between."""
    w = Window.partitionBy("file_name").orderBy("line_no", "record_id")
    r = table(spark, root, "agent_records").withColumn("n", F.octet_length("raw"))
    return r.select("record_id", (F.sum(F.col("n") + 1).over(w) - F.col("n") - 1).alias("off_start"), (F.sum(F.col("n") + 1).over(w) - 1).alias("off_end"))


def budget_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Per wing the newest tags' worth of titles while their running size is at most 10000, always one."""
    d = census.logical(table(spark, root, "drawers")).select("wing", "id", "title").distinct()
    w = Window.partitionBy("wing").orderBy("id")
    d = d.withColumn("size", F.sum(F.length("title") + 1).over(w)).withColumn("r", F.row_number().over(w))
    return d.where("r = 1 or size <= 10000").select("wing", "id", "size")


def first_occurrence(spark: SparkSession, root: str) -> DataFrame:
    """Issue ids of each document in order of first appearance."""
    return texts(spark, root, "documents").select("doc_id", F.posexplode(tx.any_id_scan("text")).alias("at", "issue_id"))


def escalation_only(spark: SparkSession, root: str) -> DataFrame:
    """Events whose tier is above that of the user's event before."""
    tier = F.when(F.col("value") > 90, 2).when(F.col("value") > 60, 1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, root, "events").select("event_id", "user_id", "ts", tier.alias("tier"))
    return e.withColumn("before", F.coalesce(F.lag("tier").over(w), F.lit(0))).where("tier > before").select("event_id", "user_id", "tier")


def hourly_counts(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def since_last_gap(spark: SparkSession, root: str) -> DataFrame:
    """Per user the last gap over three hours and the events since."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, root, "events").withColumn("gap", F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lag(F.unix_timestamp(F.col("ts").cast("timestamp"))).over(w))
    last = F.max(F.when(F.col("gap") > 10800, F.col("ts"))).over(Window.partitionBy("user_id"))
    return e.withColumn("since", last).where("since is not null and ts >= since").groupBy("user_id", "since").agg(F.count("*").alias("n"))


def eav_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Attribute rows of drawers joined and pivoted back to one row per id."""
    d = table(spark, root, "drawers").select("id", "wing", "room", "source_file").distinct()
    eav = d.select("id", F.expr("stack(3, 'wing', wing, 'room', room, 'source_file', source_file) as (key, string_value)"))
    wide = d.select("id").distinct().join(eav, "id").groupBy("id").pivot("key", ["wing", "room", "source_file"]).agg(F.min("string_value"))
    return wide


QUERIES = {
    f.__name__: f
    for f in (
        scan_logical, scan_candidates, scan_index_corpus, scope_filter, like_ci, wing_denylist, either_side, list_tunnels, temporal_asof,
        current_only, kg_query, kg_query_current, kg_stats, kg_stats_fallback, entity_union, kg_invalidate, status, list_wings, taxonomy,
        taxonomy_nested, top_wings, find_tunnels, find_tunnels_all, tunnel_graph_stats, endpoint_count, list_page, diary_recent,
        traverse_graph, follow_tunnels, tag_semi, list_tags, untag_drawer, parents_with_children, parent_semi,
        reassemble_chunks, delete_by_source, delete_drawer, add_drawer, row_upsert, dead_ids, 
        catalogue_drift, lines_not_listed, dup_triples, latency_stats, fail_fraction, count_jsonl, scan_tail_n, offsets, budget_prefix,
        first_occurrence, escalation_only, hourly_counts, since_last_gap, eav_pivot, 
    )
}

_IDS = r"(?:^|[^A-Za-z0-9._/-])([a-z][a-z0-9_]*-[0-9a-f]{3}(?:\.[0-9]+)*)"
_LEAD = r"lower(regexp_extract(coalesce(title, ''), '^[# ]*\s*(\S+)', 1))"
_TITLE = f"""coalesce(substr(list_filter(list_transform(regexp_split_to_array(coalesce("text", ''), '{tx.LINE_END}'), lambda x: regexp_replace(x, '^{tx.BLANKS}|{tx.BLANKS}$', '', 'g')), lambda x: x <> '')[1], 1, 512), '(untitled)')"""
_CID = "coalesce(nullif(parent_drawer_id, ''), id)"
_VALID = f"(valid_from is null or valid_from <= timestamp '{AT}') and (valid_to is null or valid_to > timestamp '{AT}')"
_SCOPE = f"wing = '{WING_A}' and room = '{ROOM}'"

SQL = {
    "scan_logical": "select distinct id, wing, room, title from drawers where parent_drawer_id is null",
    "scan_candidates": f'select distinct id, title, length("text")::int n_chars, source_file from drawers where parent_drawer_id is null and {_SCOPE} and source_file is not null',
    "scan_index_corpus": 'select distinct id, wing, room, length(title)::int title_chars, length("text")::int text_chars, parent_drawer_id, filed_at from drawers',
    "scope_filter": f"select distinct id from drawers where {_SCOPE}",
    "like_ci": "select distinct id, title from drawers where lower(title) like '%n_tes on%'",
    "wing_denylist": f"select wing, count(*) n from drawers where wing is not null and wing not in ('{WING_A}', '{WING_B}') group by wing",
    "either_side": f"select distinct id, source_wing, target_wing from tunnels where source_wing = '{WING_A}' or target_wing = '{WING_A}'",
    "list_tunnels": 'select distinct id, source_wing, source_room, target_wing, target_room, "label", kind from tunnels',
    "temporal_asof": f"select distinct id, subject, predicate, object from kg_triples where {_VALID}",
    "current_only": 'select distinct id from kg_triples where "current"',
    "kg_query": f"""select 'outgoing' direction, id, subject, predicate, object, valid_from, valid_to from kg_triples where subject = '{ENTITY}' and {_VALID}
union all select 'incoming', id, subject, predicate, object, valid_from, valid_to from kg_triples where object = '{ENTITY}' and {_VALID}""",
    "kg_query_current": f"""select 'outgoing' direction, id, subject, predicate, object from kg_triples where subject = '{ENTITY}' and "current"
union all select 'incoming', id, subject, predicate, object from kg_triples where object = '{ENTITY}' and "current\"""",
    "kg_stats": """select (select count(*) from (select subject e from kg_triples union select object from kg_triples) where e is not null) entities,
  count(*) triples, count(*) filter ("current") "current", count(*) filter (not "current") expired from kg_triples""",
    "kg_stats_fallback": "select (select count(*) from (select subject e from kg_triples union select object from kg_triples) where e is not null) entities, count(*) triples from kg_triples",
    "entity_union": "select subject entity from kg_triples union select object from kg_triples",
    "kg_invalidate": f"""with c as (select coalesce(subject = 'project:loomcraft' and predicate = 'has_status' and object = 'active', false) m, * from kg_triples)
select case when m then false else "current" end "current", count(*) n, count(*) filter (m or valid_to = timestamp '{AT}') closed_then from c group by 1""",
    "status": """select 'total' "level", '' "name", count(*) n from drawers union all select 'wing', wing, count(*) from drawers group by wing
union all select 'room', room, count(*) from drawers group by room""",
    "list_wings": "select wing, count(*) n from drawers group by wing",
    "taxonomy": "select wing, room, count(*) n from drawers group by wing, room",
    "taxonomy_nested": """select wing, '{' || string_agg('"' || room || '":' || n, ',' order by room) || '}' rooms from (select wing, room, count(*) n from drawers group by all) group by wing""",
    "top_wings": "select wing, count(*) n from drawers group by wing order by n desc, wing limit 10",
    "find_tunnels": f"""select room, string_agg(distinct wing, ',' order by wing) wings, count(distinct wing) wing_count from drawers group by room
having count(distinct wing) >= 2 and bool_or(wing = '{WING_A}') and bool_or(wing = '{WING_B}')""",
    "find_tunnels_all": "select room, string_agg(distinct wing, ',' order by wing) wings, count(distinct wing) wing_count from drawers group by room having count(distinct wing) >= 2",
    "tunnel_graph_stats": """select count(*) rooms, count(*) filter (w >= 2) shared_rooms, coalesce(sum(w) filter (w >= 2), 0)::bigint connections
from (select room, count(distinct wing) w from drawers group by room)""",
    "endpoint_count": f"select count(*) n from drawers where {_SCOPE}",
    "list_page": f"""with d as (select distinct id, wing, room, title, "text", filed_at from drawers where parent_drawer_id is null and wing = '{WING_A}')
select id, wing, room, title, substr("text", 1, 200) preview, filed_at, (select count(*) from d) total from d order by filed_at desc nulls last, id limit 20 offset 40""",
    "diary_recent": f"select distinct id, title, filed_at from drawers where wing = '{WING_A}' and room = 'diary' order by filed_at desc nulls last, id desc limit 3",
    "traverse_graph": f"select distinct room, 1 hops from drawers where room <> '{ROOM}' and wing in (select wing from drawers where room = '{ROOM}')",
    "follow_tunnels": f"""with e as (select *, coalesce(source_wing = '{WING_A}', false) s from tunnels where source_wing = '{WING_A}' or target_wing = '{WING_A}'),
f as (select id, case when s then 'outgoing' else 'incoming' end direction, case when s then target_wing else source_wing end wing, case when s then target_room else source_room end room,
  case when s then target_drawer_id else source_drawer_id end did, "label", kind from e)
select f.id, direction, wing, room, "label", kind, coalesce(t, '') preview from f left join (select id, min(substr("text", 1, 300)) t from drawers where id <> '' group by id) d on d.id = did""",
    "tag_semi": """with t as (select tag from drawer_tags group by tag order by count(*) desc, tag limit 2)
select distinct id, wing, room from drawers where id in (select drawer_id from drawer_tags where tag in (select tag from t) group by drawer_id having count(distinct tag) = 2)""",
    "list_tags": "select tag, count(distinct drawer_id) n from drawer_tags group by tag",
    "untag_drawer": "select tag, count(distinct drawer_id) n from drawer_tags where drawer_id not in (select drawer_id from drawer_deletions where drawer_id is not null) group by tag",
    "parents_with_children": "select distinct id from drawers where parent_drawer_id is null and id not in (select parent_drawer_id from drawers where parent_drawer_id <> '')",
    "parent_semi": f"select distinct id, {_CID} cid from drawers where {_CID} in (select id from drawers where parent_drawer_id is null and {_SCOPE})",
    "reassemble_chunks": """select parent_drawer_id, count(*) n, md5(string_agg(t, '' order by chunk_index)) text_md5
from (select parent_drawer_id, chunk_index, min("text") t from drawers where parent_drawer_id <> '' and chunk_index is not null and "text" is not null group by 1, 2) group by 1""",
    "delete_by_source": "select source_file, count(*) n, min(id) first_id from drawers where source_file is not null group by source_file having count(*) > 1",
    "delete_drawer": f"""with g as (select distinct drawer_id from drawer_deletions where drawer_id is not null)
select wing, count(*) n from drawers where {_CID} not in (select * from g) and id not in (select * from g) group by wing""",
    "add_drawer": f"""with d as (select distinct source wing, lang room, {_TITLE} title, "text" from documents where source is not null and lang is not null and "text" is not null),
p as (select *, 'drawer_' || wing || '_' || room || '_' || substr(sha256(length(wing) || ':' || wing || length(room) || ':' || room || length("text") || ':' || "text"), 1, 24) id from d),
c as (select id, unnest(range(0, ceil(length("text") / 800.0)::bigint)) i, "text" from p where length("text") > 800)
select distinct id, md5("text") text_md5, md5(case when length("text") > 800 then title else "text" end) embed_md5, null::int chunk_index, null::varchar parent_drawer_id, length("text") > 800 is_parent from p
union all select distinct id || '_chunk_' || lpad(i::varchar, 6, '0'), md5(substr("text", (i * 800 + 1)::bigint, 800)), md5(substr("text", (i * 800 + 1)::bigint, 800)), i::int, id, false from c""",
    "row_upsert": "select id, filed_at, added_by from drawers qualify row_number() over (partition by id order by filed_at desc nulls last, added_by asc nulls last, source_file asc nulls last) = 1",
    "dead_ids": rf"""select distinct i issue_id from (select unnest(regexp_extract_all("text", '{_IDS}', 1)) i from documents)
where i not in (select f from (select {_LEAD} f from drawers) where regexp_matches(f, '^[a-z][a-z0-9]*-[a-z0-9][a-z0-9.]*$'))""",
    "catalogue_drift": """select predicate, coalesce(n, 0) n, case when coalesce(n, 0) = 0 then 'MISSING' when n > 1 then 'DUPLICATE' else 'OK' end state
from kg_predicates left join (select predicate, count(*) n from kg_triples group by 1) using (predicate)""",
    "lines_not_listed": "select replace(lower(trim(source)), '-', '_') source from documents where source is not null except select source from mix_targets",
    "dup_triples": "select subject, predicate, object, count(distinct id) n_ids from kg_triples group by all having count(distinct id) > 1",
    "latency_stats": """with v as (select event_type, list_sort(list(value)) s, avg(value) m from events where value is not null group by 1)
select event_type, s[len(s) // 2 + 1] p50, s[floor(len(s) * 0.95)::bigint + 1] p95, round(m, 6) mean from v""",
    "fail_fraction": """select file_name, count(*) processed, count(*) filter (not json_valid(raw)) failed, count(*) >= 4 and count(*) filter (not json_valid(raw)) * 100 > count(*) * 25 abort
from agent_records where trim(raw) <> '' group by 1""",
    "count_jsonl": "select file_name, count(*) n from agent_records where trim(raw) <> '' group by 1",
    "scan_tail_n": "select record_id, file_name, line_no from agent_records qualify row_number() over (partition by file_name order by line_no desc, record_id desc) <= 80",
    "offsets": """select record_id, (sum(n + 1) over w)::bigint - n - 1 off_start, (sum(n + 1) over w)::bigint - 1 off_end
from (select *, strlen(raw) n from agent_records) window w as (partition by file_name order by line_no, record_id)""",
    "budget_prefix": """with d as (select distinct wing, id, title from drawers where parent_drawer_id is null),
s as (select wing, id, (sum(length(title) + 1) over w)::bigint size, row_number() over w r from d window w as (partition by wing order by id))
select wing, id, size from s where r = 1 or size <= 10000""",
    "first_occurrence": rf"""with o as (select doc_id, unnest(a) issue_id, generate_subscripts(a, 1) i from (select doc_id, regexp_extract_all("text", '{_IDS}', 1) a from documents))
select doc_id, issue_id, (row_number() over (partition by doc_id order by min(i)) - 1)::int "at" from o group by doc_id, issue_id""",
    "escalation_only": """with t as (select event_id, user_id, ts, case when value > 90 then 2 when value > 60 then 1 else 0 end tier from events)
select event_id, user_id, tier from (select *, coalesce(lag(tier) over (partition by user_id order by ts, event_id), 0) b from t) where tier > b""",
    "hourly_counts": """select date_trunc('hour', ts) "hour", event_type, count(*) n from events group by 1, 2""",
    "since_last_gap": """with g as (select *, epoch(ts)::bigint - lag(epoch(ts)::bigint) over (partition by user_id order by ts, event_id) gap from events),
s as (select *, max(ts) filter (gap > 10800) over (partition by user_id) since from g)
select user_id, since, count(*) n from s where ts >= since group by 1, 2""",
    "eav_pivot": "select id, min(wing) wing, min(room) room, min(source_file) source_file from drawers group by id",
}
