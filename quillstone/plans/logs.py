"""Transcript and history queries over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import mining, nested, transcripts
from quillstone.sources.tables import table, texts


def _parsed(spark: SparkSession, root: str) -> DataFrame:
    return nested.parse_lines(texts(spark, root, "agent_records"))


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.top_blocks(_parsed(spark, root))


def scan_transcript_lines(spark: SparkSession, root: str) -> DataFrame:
    e = transcripts.events(_parsed(spark, root))
    return e.select("record_id", "session_id", "ts", "role", "n_tool", F.md5("text").alias("text_md5"), "side")


def tolerant_event_filter(spark: SparkSession, root: str) -> DataFrame:
    e = transcripts.events(_parsed(spark, root)).where("not side and role <> ''")
    return e.groupBy("file_name", "role").agg(F.count("*").alias("n"))


def struggle_signals(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.signals(transcripts.events(_parsed(spark, root)), abandon_turns=3)


def stage_spend(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.spend(transcripts.usage(_parsed(spark, root)))


def spend_total(spark: SparkSession, root: str) -> DataFrame:
    return stage_spend(spark, root).agg(F.sum("net").alias("net"), F.count("*").alias("n_files"))


def context_tier(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.context_tiers(transcripts.usage(_parsed(spark, root)), 40_000, 70_000)


def tier_escalations(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.escalations(transcripts.usage(_parsed(spark, root)), 40_000, 70_000)


def tool_result_pair(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.tool_results(_blocks(spark, root)).select("record_id", "i", "tool_use_id", "issuer")


def result_text(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.tool_results(_blocks(spark, root)).select("record_id", "i", F.md5("result").alias("result_md5"))


def last_bash_latch(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.last_failures(_blocks(spark, root))


def final_report(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.final_reports(_blocks(spark, root)).select("file_name", F.md5("report").alias("report_md5"))


def commands(spark: SparkSession, root: str) -> DataFrame:
    return _blocks(spark, root).where("type = 'tool_use' and command <> ''").select("record_id", "i", "command")


def claim_provenance(spark: SparkSession, root: str) -> DataFrame:
    return transcripts.provenance(_blocks(spark, root))


def evidence_slots(spark: SparkSession, root: str) -> DataFrame:
    """Evidence slots in all documents."""
    d = texts(spark, root, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("report"))
    return transcripts.slots(d).select(F.col("key").cast("bigint").alias("doc_id"), "at", "form", "payload", F.size("commands").alias("n_commands"))


def fence_state(spark: SparkSession, root: str) -> DataFrame:
    """Lines inside and outside code fences per document; a fence line is neither."""
    d = texts(spark, root, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    fence = lambda x: x.rlike(r"^\s*(```|~~~)")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("inside"), F.lit(0).alias("outside"))
    step = lambda a, x: F.when(fence(x), F.struct((1 - a["open"]).alias("open"), a["inside"].alias("inside"), a["outside"].alias("outside"))).otherwise(
        F.struct(a["open"].alias("open"), (a["inside"] + a["open"]).alias("inside"), (a["outside"] + 1 - a["open"]).alias("outside"))
    )
    return d.select("doc_id", F.aggregate("lines", start, step).alias("s")).select("doc_id", "s.inside", "s.outside")


def _units(spark: SparkSession, root: str) -> DataFrame:
    """Documents as history units: first line, text and the paths it names."""
    d = texts(spark, root, "documents").where("text is not null")
    # Through inline, so that the expressions are computed once and not wherever a score names them.
    unit = F.struct(tx.derive_title("text").alias("subject"), F.col("text").alias("body"), F.array_join(tx.extract_paths("text"), ",").alias("files"))
    return d.select("doc_id", F.inline(F.array(unit)))


def commit_score(spark: SparkSession, root: str) -> DataFrame:
    return _units(spark, root).select("doc_id", mining.commit_score().alias("score"))


def pr_score(spark: SparkSession, root: str) -> DataFrame:
    u = _units(spark, root).withColumn("labels", F.lit("design")).withColumn("has_review", F.col("doc_id") % 2 == 0)
    return u.select("doc_id", mining.pull_score(title="subject").alias("score"))


def manifest_triples(spark: SparkSession, root: str) -> DataFrame:
    u = mining.surviving(_units(spark, root), mining.commit_score())
    drafts = u.select(F.col("doc_id").cast("string").alias("id"), F.col("subject").alias("title"), tx.cluster_key("files").alias("cluster"), F.lit("documents").alias("source"))
    return mining.draft_triples(drafts)


QUERIES = {
    f.__name__: f
    for f in (
        scan_transcript_lines, tolerant_event_filter, struggle_signals, stage_spend, spend_total, context_tier, tier_escalations,
        tool_result_pair, result_text, last_bash_latch, final_report, commands, claim_provenance, evidence_slots, fence_state,
        commit_score, pr_score, manifest_triples,
    )
}

_OK = """ok as (select record_id, file_name, line_no, raw::json j from agent_records
  where json_valid(raw) and case when json_valid(raw) then json_type(raw::json) = 'OBJECT' else false end)"""
_ITEM = "json_extract(c, '$[' || (i - 1)::varchar || ']')"
_ITEMS = f"""it as (select record_id, file_name, line_no, role, i - 1 i, {_ITEM} b
  from (select record_id, file_name, line_no, coalesce(j->>'$.message.role', '') role, j->'$.message.content' c, unnest(range(1, json_array_length(j->'$.message.content')::bigint + 1)) i
        from ok where json_type(j->'$.message.content') = 'ARRAY'))"""
_EVENTS = f"""{_OK}, {_ITEMS},
agg as (select record_id, bool_or(json_type(b) not in ('OBJECT', 'NULL')) odd, count(*) filter (b->>'$.type' = 'tool_use') n_tool,
  coalesce(string_agg(coalesce(b->>'$.text', ''), ' ' order by i) filter (b->>'$.type' = 'text'), '') t from it group by 1),
ev as (select record_id, file_name, line_no, coalesce(j->>'$.sessionId', '') session_id, coalesce(j->>'$.timestamp', '') ts,
  coalesce((j->>'$.isMeta')::boolean, false) or coalesce((j->>'$.isSidechain')::boolean, false) side,
  case when coalesce(odd, false) then '' else coalesce(j->>'$.message.role', '') end "role", coalesce(n_tool, 0)::int n_tool,
  regexp_replace(case when json_type(j->'$.message.content') = 'VARCHAR' then j->>'$.message.content' else coalesce(t, '') end, '[\\t\\n\\r]', ' ', 'g') "text"
  from ok left join agg using (record_id))"""
_USAGE = f"""{_OK}, us as (select file_name, line_no, record_id, coalesce((j->>'$.message.usage.cache_read_input_tokens')::bigint, 0) cr,
  coalesce((j->>'$.message.usage.cache_creation_input_tokens')::bigint, 0) cc, coalesce((j->>'$.message.usage.output_tokens')::bigint, 0) o from ok
  where j->>'$.type' = 'assistant' and j->>'$.message.role' = 'assistant' and json_type(j->'$.message.usage') is not null and json_type(j->'$.message.usage') <> 'NULL'),
fl as (select file_name, min((line_no, record_id, cr, cc, o)) f, max((line_no, record_id, cr, cc, o)) l from us group by 1),
e as (select file_name, f[3] fcr, f[4] fcc, f[5] fo, l[3] lcr, l[4] lcc, l[5] lo from fl),
sp as (select file_name, case when fcr = lcr and fcc = lcc and fo = lo then lo else fo + lo end output, lcr, lcc from e)"""
_TB = f"""{_OK}, {_ITEMS},
tb as (select record_id, file_name, line_no, role, i::int i, coalesce(b->>'$.type', '') ty, coalesce(b->>'$.id', '') id, coalesce(b->>'$.name', '') nm, coalesce(b->>'$.tool_use_id', '') tid,
  coalesce(b->>'$.text', '') tx, coalesce(b->>'$.input.file_path', '') fp, coalesce(b->>'$.input.command', '') cmd, b->'$.content' c from it where json_type(b) = 'OBJECT'),
st as (select *, case when ty = 'tool_use' then id else tid end k from tb where (ty = 'tool_use' and id <> '') or ty = 'tool_result'),
tr as (select *, coalesce(last_value(case when ty = 'tool_use' then nm end ignore nulls) over (partition by file_name, k order by line_no, record_id, i rows between unbounded preceding and 1 preceding), '') issuer from st),
sub as (select record_id, i, n, json_extract(c, '$[' || (n - 1)::varchar || ']') x from (select record_id, i, c, unnest(range(1, json_array_length(c)::bigint + 1)) n from tb where ty = 'tool_result' and json_type(c) = 'ARRAY')),
sj as (select record_id, i, string_agg(case json_type(x) when 'OBJECT' then coalesce(x->>'$.text', '') when 'VARCHAR' then x->>'$' end, chr(10) order by n) s from sub group by 1, 2),
res as (select tr.*, case json_type(c) when 'VARCHAR' then c->>'$' when 'ARRAY' then coalesce(s, '') else '' end result from tr left join sj using (record_id, i) where ty = 'tool_result')"""
_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: length(t) >= 3))"
_Q = lambda s: s.replace("'", "''")
_TITLE = f"""coalesce(substr(list_filter(list_transform(regexp_split_to_array(coalesce("text", ''), '{tx.LINE_END}'), lambda x: regexp_replace(x, '^{tx.BLANKS}|{tx.BLANKS}$', '', 'g')), lambda x: x <> '')[1], 1, 512), '(untitled)')"""
_PATH = r"[A-Za-z0-9_./-]+\.(?:" + "|".join(sorted(tx.PATH_EXTENSIONS, key=len, reverse=True)) + r")\b"
_UNIT = f"""un as (select doc_id, {_TITLE} subject, "text" body, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all("text", '{_PATH}'))), ','), '') files from documents where "text" is not null),
cs as (select *, case when regexp_matches(lower(subject), '{mining.JUNK}') or regexp_matches(lower(subject), '{mining.CHURN}') then 0 else
  (strlen(body) >= 40)::int + (len(list_filter(regexp_split_to_array(subject, '\\s+'), lambda x: x <> '')) >= 3)::int + 2 * regexp_matches(files, '(?im){mining.DECISION_FILES}')::int
  + regexp_matches(body, '(?im){mining.RATIONALE}')::int end score,
  case when lower(files) like '%schema%' then 'schema' when lower(files) like '%migrat%' then 'migrat' when lower(files) like '%proto%' then 'proto' when lower(files) like '%interface%' then 'interface'
  when lower(files) like '%config%' then 'config' when split_part(files, ',', 1) like '%/%' then split_part(split_part(files, ',', 1), '/', 1) when files = '' then '_misc' else '_root' end cluster_ from un)"""

SQL = {
    "scan_transcript_lines": f'with {_EVENTS} select record_id, session_id, ts, "role", n_tool, md5("text") text_md5, side from ev',
    "tolerant_event_filter": f"""with {_EVENTS} select file_name, "role", count(*) n from ev where not side and "role" <> '' group by 1, 2""",
    "struggle_signals": f"""with {_EVENTS},
k as (select *, "role" = 'user' and not starts_with("text", '<') and not starts_with("text", '[Request interrupted') re from ev where not side and ("role" = 'assistant' or ("role" = 'user' and "text" <> ''))),
g as (select *, coalesce(sum(re::int) over (w rows between unbounded preceding and 1 preceding), 0) g, count(*) filter ("role" = 'assistant' and n_tool > 0) over (w rows between unbounded preceding and current row) tools,
  coalesce(lead("role" = 'assistant' and regexp_matches("text", '{_Q(transcripts.UPGRADE)}')) over w, false) adm from k window w as (partition by file_name order by line_no, record_id)),
a as (select *, row_number() over (partition by file_name, g order by line_no desc, record_id desc) r, count(*) over (partition by file_name, g) n from g where "role" = 'assistant'),
ring as (select file_name, g, any_value(n) n, string_agg("text", ' ' order by line_no, record_id) filter (r <= 5) ring from a group by 1, 2),
t as (select g.*, coalesce(n, 0) consec, {_WORDS.format('"text"')} w, {_WORDS.format("coalesce(ring, '')")} v from g left join ring using (file_name, g) where re),
c as (select *, case when regexp_matches(lower("text"), '{_Q(transcripts.DIAGNOSTIC)}') then 'A_diagnostic'
  when length("text") <= 200 and tools >= 3 and regexp_matches(lower("text"), '{_Q(transcripts.STEERING)}') then 'A_steering'
  when regexp_matches(lower("text"), '{_Q(transcripts.REVERSION)}') then 'B_reversion'
  when consec >= 3 and len(w) >= 10 and 1 - len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) > 0.7 then 'B_abandon' end cls from t)
select record_id, file_name, cls signal_class, adm::int upgrade_weight, substr("text", 1, 500) excerpt from c where cls is not null""",
    "stage_spend": f"with {_USAGE} select file_name, lcr + lcc + output gross, lcr + lcc + output - 14000 net, output from sp",
    "spend_total": f"with {_USAGE} select sum(lcr + lcc + output - 14000)::bigint net, count(*) n_files from sp",
    "context_tier": f"with {_USAGE} select file_name, lcr + lcc context, case when lcr + lcc > 70000 then 'red' when lcr + lcc > 40000 then 'yellow' else 'green' end tier from e",
    "tier_escalations": f"""with {_USAGE}, r as (select *, case when cr + cc > 70000 then 2 when cr + cc > 40000 then 1 else 0 end rk from us),
l as (select *, coalesce(lag(rk) over (partition by file_name order by line_no, record_id), 0) b from r) select file_name, line_no, record_id, rk "rank" from l where rk > b""",
    "tool_result_pair": f"with {_TB} select record_id, i, tid tool_use_id, issuer from res",
    "result_text": f"with {_TB} select record_id, i, md5(result) result_md5 from res",
    "last_bash_latch": f"""with {_TB}, sh as (select *, regexp_matches(result, '{transcripts.FAILURE}') and not contains(result, '{transcripts.CONFLICT[0]}') and not contains(result, '{transcripts.CONFLICT[1]}') bad
  from res where issuer = 'Bash'),
la as (select file_name, max((line_no, record_id, i)) p, arg_max(bad, (line_no, record_id, i)) failed from sh group by 1),
ed as (select file_name, max((line_no, record_id, i)) ep from tb where ty = 'tool_use' and nm in ('Edit', 'Write', 'MultiEdit') and regexp_matches(fp, '{transcripts.TEST_PATH}') group by 1)
select file_name, failed, failed and coalesce(ep > p, false) tests_edited from la left join ed using (file_name)""",
    "final_report": f"""with {_TB}, r as (select file_name, line_no, record_id, string_agg(tx, chr(10) order by i) t from tb where role = 'assistant' and ty = 'text' group by 1, 2, 3)
select file_name, md5(arg_max(t, (line_no, record_id))) report_md5 from r group by 1""",
    "commands": f"with {_TB} select record_id, i, cmd command from tb where ty = 'tool_use' and cmd <> ''",
    "fence_state": r"""with l as (select doc_id, generate_subscripts(a, 1) i, unnest(a) x from (select doc_id, string_split("text", chr(10)) a from documents where "text" is not null)),
f as (select *, regexp_matches(x, '^[ \t\x0b\f\r]*(```|~~~)') fence from l), s as (select *, sum(fence::int) over (partition by doc_id order by i) n from f)
select doc_id, count(*) filter (not fence and n % 2 = 1)::int inside, count(*) filter (not fence and n % 2 = 0)::int outside from s group by 1""",
    "commit_score": f"with {_UNIT} select doc_id, score from cs",
    "pr_score": f"""with {_UNIT} select doc_id, (doc_id % 2 = 0)::int + (strlen(body) >= 60)::int + 2 + regexp_matches(body, '(?im){mining.CLOSES}')::int + regexp_matches(files, '(?im){mining.DECISION_FILES}')::int
  + regexp_matches(subject || chr(10) || body, '(?im){mining.RATIONALE}|adopt')::int score from cs""",
    "manifest_triples": f"""with {_UNIT} select doc_id::varchar subject, 'has_title' predicate, subject object from cs where score >= 2 union all
select doc_id::varchar, 'in_cluster', cluster_ from cs where score >= 2 union all select doc_id::varchar, 'mined_from', 'documents' from cs where score >= 2""",
}
