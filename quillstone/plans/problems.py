"""Queries on references without record, nested lines and attribute history, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import history, nested, orphans
from quillstone.sources.tables import table, texts


def _reference_tables(spark: SparkSession, root: str) -> tuple[DataFrame, ...]:
    return (
        table(spark, root, "drawers").select("id", "parent_drawer_id", "filed_at"),
        table(spark, root, "drawer_tags"),
        table(spark, root, "tunnels"),
        table(spark, root, "drawer_deletions"),
    )


def _orphan_state(spark: SparkSession, root: str) -> orphans.OrphanState:
    return orphans.replay_store(*_reference_tables(spark, root))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphans(_orphan_state(spark, root)).select("ref_field", "row_key", "drawer_id").distinct()


def p1_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphans.snapshot_counts(_orphan_state(spark, root))


def p1_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return orphans.store_snapshots(*_reference_tables(spark, root))


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    return nested.parse_lines(texts(spark, root, "agent_records"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return nested.blocks(_parsed(spark, root)).select("record_id", "block_path", "block_type", "block_id")


def p5_blocks(spark: SparkSession, root: str) -> DataFrame:
    return nested.blocks(_parsed(spark, root)).select("record_id", "block_path", "parent_path", "block_type", "block_id", "name", "tool_use_id")


def p5_records(spark: SparkSession, root: str) -> DataFrame:
    return nested.records(_parsed(spark, root)).select("record_id", "file_name", "line_no", "record_type", "session_id", "role", "n_blocks")


def p5_tool_calls(spark: SparkSession, root: str) -> DataFrame:
    return nested.tool_calls(nested.blocks(_parsed(spark, root)))


def p5_tool_results(spark: SparkSession, root: str) -> DataFrame:
    return nested.tool_results(nested.blocks(_parsed(spark, root)))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return history.fact_history(table(spark, root, "kg_triples"), table(spark, root, "kg_predicates"))


def p6_history(spark: SparkSession, root: str) -> DataFrame:
    return history.current_at(p6_found(spark, root))


_REFS = """
refs as (
  select 'drawer_tags.drawer_id' ref_field, tag row_key, drawer_id, created_at t from drawer_tags
  union all select 'tunnels.source_drawer_id', id, source_drawer_id, created_at from tunnels
  union all select 'tunnels.target_drawer_id', id, target_drawer_id, created_at from tunnels
  union all select 'drawers.parent_drawer_id', id, parent_drawer_id, filed_at from drawers),
par as (select id, min(filed_at) f from drawers group by id)"""

_BLOCKS = """
with recursive ok as (
  select record_id, raw::json j from agent_records
  where json_valid(raw) and case when json_valid(raw) then json_type(raw::json) = 'OBJECT' else false end),
top as (select record_id, j->'$.message.content' c from ok),
lst as (
  select record_id, case json_type(c) when 'ARRAY' then c when 'OBJECT' then json_array(c) when 'VARCHAR' then json_array(c) end a from top),
b(record_id, block_path, parent_path, v) as (
  select record_id, (i - 1)::varchar, '', json_extract(a, '$[' || (i - 1)::varchar || ']')
  from (select record_id, a, unnest(range(1, json_array_length(a)::bigint + 1)) i from lst where a is not null)
  union all
  select record_id, p || '.' || (i - 1)::varchar, p, json_extract(a, '$[' || (i - 1)::varchar || ']')
  from (select record_id, p, a, unnest(range(1, json_array_length(a)::bigint + 1)) i
        from (select record_id, block_path p, case json_type(v->'$.content') when 'ARRAY' then v->'$.content' when 'OBJECT' then json_array(v->'$.content') end a
              from b where json_type(v) = 'OBJECT') where a is not null)),
blk as (
  select record_id, block_path, parent_path,
    case when json_type(v) = 'VARCHAR' then 'text' else coalesce(v->>'$.type', '') end block_type,
    case when json_type(v) = 'VARCHAR' then '' else coalesce(v->>'$.id', '') end block_id,
    case when json_type(v) = 'VARCHAR' then '' else coalesce(v->>'$.name', '') end "name",
    case when json_type(v) = 'VARCHAR' then '' else coalesce(v->>'$.tool_use_id', '') end tool_use_id
  from b where json_type(v) in ('OBJECT', 'VARCHAR'))"""

_HISTORY = """
with f as (
  select subject, predicate, object, valid_from s, valid_to e from kg_triples
  where predicate in (select predicate from kg_predicates where single_valued)
    and valid_from is not null and (valid_to is null or valid_to > valid_from)
  qualify row_number() over (partition by subject, predicate, valid_from order by created_at desc nulls last, id desc) = 1),
c as (select *, lead(s) over w nxt from f window w as (partition by subject, predicate order by s)),
d as (select *, case when e is null then nxt when nxt is null then e else least(e, nxt) end x from c),
g as (select *, lag(x) over w px, lag(object) over w po from d window w as (partition by subject, predicate order by s)),
h as (select *, sum(case when px = s and po is not distinct from object then 0 else 1 end) over (partition by subject, predicate order by s) run from g),
hist as (
  select subject, predicate, any_value(object) object, epoch(min(s))::bigint start_s,
    coalesce(epoch(max_by(x, s))::bigint, -1) end_s, bool_or(false) z
  from (select * replace (coalesce(x, timestamp '9999-01-01') as x) from h) group by subject, predicate, run)"""

_END = "case when end_s = epoch(timestamp '9999-01-01')::bigint then -1 else end_s end"

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_counts, p1_snapshots, p5_found, p5_blocks, p5_records, p5_tool_calls, p5_tool_results, p6_found, p6_history)
}

SQL = {
    "p1_found": f"""with {_REFS}
select distinct ref_field, row_key, drawer_id from refs left join par on id = drawer_id
where drawer_id is not null and drawer_id <> '' and (id is null or f > t)""",
    "p1_counts": f"""with {_REFS}, gone as (select distinct drawer_id g from drawer_deletions),
st as (
  select distinct ref_field, row_key, drawer_id, t,
    case when id is null then case when g is null then 'absent' else 'removed' end else 'late' end status
  from refs left join par on id = drawer_id left join gone on g = drawer_id
  where drawer_id is not null and drawer_id <> '' and (id is null or f > t))
select ref_field, coalesce(strftime(t, '%Y-%m'), '') "month", status, count(*) n_refs, count(distinct drawer_id) n_ids from st group by 1, 2, 3""",
    "p1_snapshots": f"""with {_REFS}, lh as (select epoch_us(min(filed_at)) lo, epoch_us(max(filed_at)) hi from drawers),
cut as (select i - 1 period, case when i < 4 then make_timestamp(lo + (hi - lo) * i // 4) else timestamp '9999-01-01' end c from lh, (select unnest(range(1, 5)) i)),
seen as (select period, id, min(filed_at) f from drawers, cut where filed_at is null or filed_at < c group by 1, 2),
gone as (select period, drawer_id g from drawer_deletions, cut where drawer_id not in (select id from drawers) and (deleted_at is null or deleted_at < c) group by 1, 2),
st as (select distinct cut.period, ref_field, row_key, drawer_id, t, case when id is null then case when g is null then 'absent' else 'removed' end when f > t then 'late' end status
  from refs join cut on t is null or t < c left join seen on seen.period = cut.period and id = drawer_id left join gone on gone.period = cut.period and g = drawer_id
  where drawer_id is not null and drawer_id <> '')
select period::int period, ref_field, status, count(*) n_refs from st where status is not null group by 1, 2, 3""",
    "p5_found": f"{_BLOCKS} select record_id, block_path, block_type, block_id from blk",
    "p5_blocks": f"{_BLOCKS} select * from blk",
    "p5_records": f"""{_BLOCKS}
select record_id, file_name, line_no, j->>'$.type' record_type, j->>'$.sessionId' session_id, j->>'$.message.role' "role", coalesce(n, 0)::int n_blocks
from ok join agent_records using (record_id)
left join (select record_id, count(*) n from blk where parent_path = '' group by 1) using (record_id)""",
    "p5_tool_calls": f"{_BLOCKS} select record_id, block_path, parent_path, block_id call_id, \"name\" from blk where block_type = 'tool_use'",
    "p5_tool_results": f"{_BLOCKS} select record_id, block_path, parent_path, tool_use_id call_id from blk where block_type = 'tool_result'",
    "p6_found": f"{_HISTORY} select subject, predicate, object, start_s, {_END} end_s from hist",
    "p6_history": f"{_HISTORY} select subject, predicate, object, start_s, {_END} end_s, {_END} = -1 is_current from hist",
}
