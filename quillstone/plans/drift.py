"""Drift, citation and relation queries over whole tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import shell
from quillstone.functions import text as tx
from quillstone.operators import drift, nested, transcripts
from quillstone.sources.tables import table, texts


def doc_citations(spark: SparkSession, root: str) -> DataFrame:
    """Drawers (by id, or by slug), issues and files that texts cite and that the store does not know.

    Commits and slash commands are not judged: no table lists any they could resolve to.
    """
    d = table(spark, root, "drawers")
    known = {
        "drawer": d.select("id"),
        "issue": d.select(tx.leading_id("title").alias("id")),
        "path": d.select(F.col("source_file").alias("id")),
        "slug": d.select(F.explode(F.array("id", "title", "room", F.concat_ws("/", "wing", "room"))).alias("id")).select(tx.normalized("id").alias("id")),
    }
    targets = [ids.where("id is not null").distinct().select(F.lit(kind).alias("kind"), "id") for kind, ids in known.items()]
    cited = drift.citations(texts(spark, root, "documents"), "doc_id").where(F.col("kind").isin(*known))
    return drift.unresolved(cited, reduce(DataFrame.unionByName, targets), ["kind", "id"]).select("doc_id", "kind", "id")


def doc_cardinality(spark: SparkSession, root: str) -> DataFrame:
    """Counts stated by n_chars against the texts' own, per source."""
    d = table(spark, root, "documents").where("n_chars is not null and text is not null")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") != F.length("text")).alias("n_wrong"))


def drift_set(spark: SparkSession, root: str) -> DataFrame:
    """Drawers against documents by title: state of each title."""
    one = lambda df: df.groupBy("path").agg(F.min("sha256").alias("sha256"))
    a = one(texts(spark, root, "documents").select(tx.derive_title("text").alias("path"), F.sha2("text", 256).alias("sha256")))
    b = one(table(spark, root, "drawers").where("parent_drawer_id is null and title <> ''").select(F.col("title").alias("path"), F.sha2("text", 256).alias("sha256")))
    return drift.drift_states(a, b).groupBy("state").agg(F.count("*").alias("n"))


def item_decision(spark: SparkSession, root: str) -> DataFrame:
    """Events of a user in order, with the kind of event as decision; a purchase ends the list."""
    e = table(spark, root, "events")
    items = e.select(F.col("user_id").alias("list"), F.col("ts").alias("at"), F.col("event_id").alias("item"))
    return drift.decided(items, e.select(F.col("event_id").alias("item"), F.col("event_type").alias("decision")), stop="purchase")


def upstream_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation texts and documents that name the same issue id or file, else share a word of six letters or more."""
    items = table(spark, root, "eval_items").select(F.col("item_id").alias("id"), "text")
    docs = texts(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")
    keys = F.array_union(tx.any_id_scan("text"), tx.extract_paths("text"))
    return drift.related(items, docs, keys, F.filter(tx.word_set("text"), lambda w: F.length(w) >= 6))


def close_ids(spark: SparkSession, root: str) -> DataFrame:
    """Sub-commands of the transcripts' shell calls, as lexed: how many hold a search."""
    c = transcripts.top_blocks(nested.parse_lines(texts(spark, root, "agent_records"))).where("command <> ''")
    return c.select("record_id", "i", shell.has_phrase(F.col("command"), "grep -rn").alias("searches"), F.size(shell.closed_ids(F.col("command"), "bd")).alias("n_closed"))


def deny_search(spark: SparkSession, root: str) -> DataFrame:
    """Predicates as patterns against objects."""
    t = table(spark, root, "kg_triples").select("id", "predicate", "object").distinct()
    return t.where(shell.matches(F.col("object"), F.col("predicate"))).select("id")


def wing_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Wing of each document: its own, else its source, else a default, and where it is from."""
    d = table(spark, root, "documents")
    value, name = drift.first_present(wing=F.col("wing"), source=F.col("source"), default=F.lit("unfiled"))
    return d.select("doc_id", value.alias("wing"), name.alias("taken_from"))


def label_union(spark: SparkSession, root: str) -> DataFrame:
    """Documents labelled as abuse, or that name a failure."""
    labelled = table(spark, root, "doc_labels").where("category <> 'none'").select("doc_id")
    named = table(spark, root, "documents").where(F.col("text").rlike(r"(?i)\bfail(ed|ure)?\b")).select("doc_id")
    return labelled.union(named).distinct()


def partition_wild(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation texts by whether they hold an issue id."""
    e = table(spark, root, "eval_items")
    return e.groupBy((F.size(tx.any_id_scan("text")) > 0).alias("known"), "kind").agg(F.count("*").alias("n"))


def set_operations(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of title and first line of each drawer: common, all, only in the title."""
    d = table(spark, root, "drawers").where("parent_drawer_id is null").select("id", tx.title_tokens("title").alias("a"), tx.title_tokens(tx.derive_title("text")).alias("b"))
    return d.select("id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("all_"), F.size(F.array_except("a", "b")).alias("only_title")).distinct()


def stamp_vs_current(spark: SparkSession, root: str) -> DataFrame:
    """Per drawer with several rows whether the newest row's text is the oldest row's."""
    d = table(spark, root, "drawers").select("id", F.coalesce("filed_at", F.lit("1900-01-01").cast("timestamp_ntz")).alias("t"), F.md5("text").alias("h"))
    per = d.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("t", "h"))["h"].alias("old"), F.max(F.struct("t", "h"))["h"].alias("new"))
    return per.where("n > 1").select("id", "n", (F.col("old") == F.col("new")).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_citations, doc_cardinality, drift_set, item_decision, upstream_pairs, close_ids, deny_search,
        wing_resolution, label_union, partition_wild, set_operations, stamp_vs_current,
    )
}

_PATH = r"[A-Za-z0-9_./-]+\.(?:" + "|".join(sorted(tx.PATH_EXTENSIONS, key=len, reverse=True)) + r")\b"
_IDS = r"(?:^|[^A-Za-z0-9._/-])([a-z][a-z0-9_]*-[0-9a-f]{3}(?:\.[0-9]+)*)"
_TITLE = f"""coalesce(substr(list_filter(list_transform(regexp_split_to_array(coalesce("text", ''), '{tx.LINE_END}'), lambda x: regexp_replace(x, '^{tx.BLANKS}|{tx.BLANKS}$', '', 'g')), lambda x: x <> '')[1], 1, 512), '(untitled)')"""
_TOKENS = f"list_distinct(regexp_extract_all(lower({{0}}), '{tx.TITLE_TOKEN}'))"
_WORDS6 = """list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower("text"), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: length(t) >= 6))"""
_KEYS = f"""list_distinct(list_concat(regexp_extract_all("text", '{_IDS}', 1), regexp_extract_all("text", '{_PATH}')))"""

_FIRST_WORD = r"lower(regexp_extract(coalesce(title, ''), '^[# ]*\s*(\S+)', 1))"
_LEAD = f"case when regexp_matches({_FIRST_WORD}, '^[a-z][a-z0-9]*-[a-z0-9][a-z0-9.]*$') then {_FIRST_WORD} end"
_SLUG = drift._SLUG

SQL = {
    "doc_citations": rf"""with t as (select doc_id, "text" t from documents where "text" is not null),
tok as (select doc_id, regexp_replace(regexp_replace(x, '\.+$', ''), '^_(.+)_$', '\1') x from (select doc_id, unnest(regexp_extract_all(t, '(^|[^A-Za-z0-9_./-])([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)', 2)) x from t)),
c as (select doc_id, 'drawer' kind, unnest(regexp_extract_all(t, 'drawer_[a-z0-9_-]+_[0-9a-f]{{24}}')) id from t union select doc_id, 'issue', unnest(regexp_extract_all(t, '{_IDS}', 1)) from t
  union select doc_id, 'path', x from tok where regexp_matches(x, '[A-Za-z0-9_-]\.[A-Za-z][A-Za-z0-9]*$')
  union select doc_id, 'slug', trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) from (select doc_id, unnest(regexp_extract_all(t, '{_SLUG}', 1)) x from t)),
k as (select 'drawer' kind, id from drawers union select 'issue', {_LEAD} from drawers union select 'path', source_file from drawers
  union select 'slug', trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', ' ', 'g')) from (select unnest([id, title, room, concat_ws('/', wing, room)]) x from drawers))
select c.* from c where not exists (select 1 from k where k.kind = c.kind and k.id = c.id)""",
    "doc_cardinality": """select source, count(*) n, count(*) filter (n_chars <> length("text")) n_wrong from documents where n_chars is not null and "text" is not null group by 1""",
    "drift_set": f"""with a as (select {_TITLE} k, min(sha256("text")) a from documents group by 1), b as (select title k, min(sha256("text")) b from drawers where parent_drawer_id is null and title <> '' group by 1)
select case when a is null then 'FAIL source missing' when b is null then 'DRIFT absent' when a = b then 'OK' else 'DRIFT differs' end state, count(*) n from a full join b using (k) group by 1""",
    "item_decision": """select user_id list, ts "at", event_id item, case when coalesce(bool_or(event_type = 'purchase') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) then 'skip' else event_type end decision from events""",
    "upstream_pairs": f"""with i as (select item_id, "text" from eval_items), d as (select doc_id, "text" from documents),
ik as (select distinct item_id, unnest({_KEYS}) k from i), dk as (select distinct doc_id, unnest({_KEYS}) k from d),
iw as (select distinct item_id, unnest({_WORDS6}) k from i), dw as (select distinct doc_id, unnest({_WORDS6}) k from d),
s as (select distinct item_id, doc_id from ik join dk using (k) where item_id <> doc_id),
w as (select distinct item_id, doc_id from iw join dw using (k) where item_id <> doc_id)
select item_id open_id, doc_id closed_id, 'strong' strength from s union all select item_id, doc_id, 'weak' from w where (item_id, doc_id) not in (select (item_id, doc_id) from s)""",
    "deny_search": "select distinct id from kg_triples where regexp_matches(object, predicate)",
    "wing_resolution": """select doc_id, coalesce(nullif(wing, ''), nullif(source, ''), 'unfiled') wing, case when coalesce(wing, '') <> '' then 'wing' when coalesce(source, '') <> '' then 'source' else 'default' end taken_from from documents""",
    "label_union": r"""select doc_id from doc_labels where category <> 'none' union select doc_id from documents where regexp_matches("text", '(?i)\bfail(ed|ure)?\b')""",
    "partition_wild": f"""select len(regexp_extract_all("text", '{_IDS}', 1)) > 0 known, kind, count(*) n from eval_items group by 1, 2""",
    "set_operations": f"""with t as (select id, {_TOKENS.format("coalesce(title, '')")} a, {_TOKENS.format(_TITLE)} b from drawers where parent_drawer_id is null)
select distinct id, len(list_intersect(a, b))::int common, len(list_distinct(list_concat(a, b)))::int all_, (len(a) - len(list_intersect(a, b)))::int only_title from t""",
    "stamp_vs_current": """with d as (select id, coalesce(filed_at, timestamp '1900-01-01') t, md5("text") h from drawers)
select id, count(*) n, arg_min(h, (t, h)) = arg_max(h, (t, h)) same from d group by id having count(*) > 1""",
}
