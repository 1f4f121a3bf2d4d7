"""Queries through the memory object and other stateful operators, over stores built from the tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import shell
from quillstone.functions import text as tx
from quillstone.memory import Memory
from quillstone.operators import bm25, census, drift, evaluate, lanes, mining, search, state, transcripts
from quillstone.operators import store as st
from quillstone.plans import logs as log_plans
from quillstone.plans import parts as part_plans
from quillstone.plans import retrieval as retrieval_plans
from quillstone.plans import scalars as scalar_plans
from quillstone.session import fresh_folder, staged
from quillstone.sources import files
from quillstone.sources.tables import table, texts
from quillstone.streaming import incremental

NOW = "2026-01-01 00:00:00"


def by_length(values: list[str]) -> list[list[float]]:
    """A stand-in for an embedding that SQL can follow: texts are alike if their lengths are equal modulo 64."""
    return [[float(i == len(v or "") % 64) for i in range(64)] for v in values]


def _memory(spark: SparkSession, root: str, *names: str) -> Memory:
    """A store that holds the named tables."""
    m = Memory(spark, fresh_folder(spark, "memory"), embed=by_length, clock=lambda: NOW)
    for name in names:
        m._change(name, lambda base, name=name: base.unionByName(table(spark, root, name).select(base.columns)))
    return m


# --- the memory object -----------------------------------------------------------------------------


def get_drawer(spark: SparkSession, root: str) -> DataFrame:
    """A drawer that is there, and one that is not."""
    m = _memory(spark, root, "drawers")
    rows = []
    for i in (m.table("drawers").agg(F.min("id")).first()[0], "missing"):
        try:
            r = m.get_drawer(i)
            rows.append((i, r["wing"], r["title"], r["text"], True))
        except KeyError:
            rows.append((i, None, None, None, False))
    return spark.createDataFrame(rows, "id string, wing string, title string, text string, found boolean").select("id", "wing", "title", F.md5("text").alias("text_md5"), "found")


def _rows(d: DataFrame) -> DataFrame:
    return d.select("id", F.md5("text").alias("text_md5"), "chunk_index", "parent_drawer_id").distinct()


def update_drawer(spark: SparkSession, root: str) -> DataFrame:
    """The table after the first long drawer got its text twice over: new chunks, no old ones, all else as it was."""
    m = _memory(spark, root, "drawers")
    one = census.logical(m.table("drawers")).where("length(text) > 800").orderBy("id").select("id", "text").first()
    m.update_drawer(one["id"], text=one["text"] * 2)
    return _rows(m.table("drawers"))


def rechunk(spark: SparkSession, root: str) -> DataFrame:
    m = _memory(spark, root, "drawers")
    m.rechunk()
    return m.table("drawers").select(F.coalesce("parent_drawer_id", "id").alias("parent_id"), "id", "chunk_index", F.length("text").alias("n_chars")).distinct()


def kg_add(spark: SparkSession, root: str) -> DataFrame:
    """Facts after one was added for every subject: current, without start or end, of confidence 1."""
    m = _memory(spark, root, "kg_triples")
    new = table(spark, root, "kg_triples").select("subject").distinct()
    m.kg_adds(new.select(F.concat(F.lit("triple_"), F.substring(F.sha2("subject", 256), 1, 16)).alias("id"), "subject", F.lit("seen_in").alias("predicate"), F.lit("store").alias("object")))
    open_ = F.col("valid_from").isNull() & F.col("valid_to").isNull()
    return m.table("kg_triples").groupBy("predicate").agg(F.count("*").alias("n"), F.count_if("current").alias("n_current"), F.count_if(open_).alias("n_open"), F.count_if(F.col("confidence") == 1).alias("n_sure"))


def row_insert(spark: SparkSession, root: str) -> DataFrame:
    """Deletions logged behind the tags, in one table of ids: what lacks a column gets null."""
    tags, gone = table(spark, root, "drawer_tags"), table(spark, root, "drawer_deletions")
    return st.insert(tags.select("drawer_id", "tag"), gone.select("drawer_id")).groupBy("drawer_id").agg(F.count("*").alias("n"), F.count("tag").alias("n_tags"))


def tag_drawer(spark: SparkSession, root: str) -> DataFrame:
    """Every drawer tagged 'seen', and every tag set once more: none twice."""
    m = _memory(spark, root, "drawer_tags")
    m.tag_all(table(spark, root, "drawers").select(F.col("id").alias("drawer_id"), F.lit("seen").alias("tag")))
    m.tag_all(m.table("drawer_tags").where("drawer_id is not null and tag is not null").select("drawer_id", "tag"))
    return m.table("drawer_tags").groupBy("tag").agg(F.count("*").alias("n"))


def create_tunnel(spark: SparkSession, root: str) -> DataFrame:
    """All tunnels made anew: one per pair of ends that hold drawers, the latest orientation, the first time."""
    m = _memory(spark, root, "drawers")
    m.create_tunnels(table(spark, root, "tunnels"))
    return m.table("tunnels").select(F.col("id").alias("tunnel_id"), "source_wing", "source_room", "target_wing", "target_room", "created_at")


def delete_tunnel(spark: SparkSession, root: str) -> DataFrame:
    """Tunnels after the first was deleted, twice."""
    m = _memory(spark, root, "tunnels")
    first = m.table("tunnels").agg(F.min("id")).first()[0]
    m.delete_tunnel(first)
    m.delete_tunnel(first)
    return m.table("tunnels").select("id").distinct()


def diary_write(spark: SparkSession, root: str) -> DataFrame:
    """Documents as diary entries of an agent per language, all of them in one change."""
    m = _memory(spark, root)
    d = texts(spark, root, "documents").where("lang is not null and text is not null").groupBy(F.col("lang").alias("agent"), F.col("text").alias("entry")).agg(F.min("source").alias("topic"))
    m.diary_writes(d)
    return m.table("drawers").select("id", "wing", "room", "title", "chunk_index", "added_by")


def checkpoint_batch(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation texts in order of id, half of them stored before, and an item without text: added, duplicate or error."""
    m = _memory(spark, root)
    items = table(spark, root, "eval_items").select(F.lit("w").alias("wing"), F.lit("r").alias("room"), "text", "item_id")
    m.add_drawers(items.where("item_id % 2 = 0").drop("item_id"))
    asked = [r.asDict() for r in items.orderBy("item_id").collect()]
    out = m.checkpoint([*asked, {"wing": "w", "room": "r", "item_id": -1}])
    wrong = {e["item"]: "error" for e in out["errors"]} | {d["item"]: "duplicate" for d in out["duplicates"]}
    return spark.createDataFrame([(a["item_id"], wrong.get(n, "added")) for n, a in enumerate([*asked, {"item_id": -1}])], "item_id bigint, outcome string")


def migrate_kg(spark: SparkSession, root: str) -> DataFrame:
    """Facts as exported and loaded, twice: defaults filled, one row per id."""
    t = table(spark, root, "kg_triples")
    out = t.select("id", "subject", "predicate", "object", "confidence", "current", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in ("valid_from", "valid_to", "created_at")])
    path = part_plans._file(out.select(F.to_json(F.struct("*")).alias("value")))
    m = _memory(spark, root)
    for _ in range(2):
        m.load_facts(files.facts(spark, path))
    return m.table("kg_triples").select("id", "subject", "predicate", "object", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "current", "valid_from", "created_at")


def migrate_drawers(spark: SparkSession, root: str) -> DataFrame:
    """Drawers as exported without titles and loaded, twice: titles derived, missing times filled, one row per id."""
    d = table(spark, root, "drawers")
    path = part_plans._file(d.select("id", "wing", "room", "text", tx.iso("filed_at").alias("filed_at")).select(F.to_json(F.struct("*")).alias("value")))
    m = _memory(spark, root)
    for _ in range(2):
        m.load_drawers(files.drawers(spark, path))
    return m.table("drawers").select("id", "title", "filed_at")


def resume_checkpoint(spark: SparkSession, root: str) -> DataFrame:
    """Facts that arrive as files in two lots and are drained after each: a lot is read once."""
    t = table(spark, root, "kg_triples").select(F.coalesce("current", F.lit(False)).alias("first"), F.to_json(F.struct("id", "predicate")).alias("value"))
    source, mark, kept = fresh_folder(spark, "arriving"), fresh_folder(spark, "mark"), fresh_folder(spark, "applied")
    for run, lot in enumerate((t.where("first"), t.where("not first"))):
        lot.select("value").write.mode("append").text(source)
        stream = incremental.json_stream(spark, source, "id string, predicate string")
        incremental.drain(stream, lambda b, n, run=run: b.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{kept}/batch={n}"), mark)
    return spark.read.schema("id string, predicate string, run int").parquet(kept).groupBy("run", "predicate").agg(F.count("*").alias("n"))


def exists_probe(spark: SparkSession, root: str) -> DataFrame:
    """A place that holds drawers, one that does not, and a table that cannot be read."""
    d = lambda: table(spark, root, "drawers")
    here = (F.col("wing") == part_plans.WING) & (F.col("room") == part_plans.ROOM)
    answers = [("there", st.has_row(d, here)), ("absent", st.has_row(d, F.col("wing") == "no such wing")), ("unreadable", st.has_row(lambda: table(spark, root, "no such table"), here))]
    return spark.createDataFrame(answers, "probe string, found boolean")


# --- state ----------------------------------------------------------------------------------------

_KEYS = ("activity", "stage", "bead", "parallel_candidates", "dispatch", "stage_spend", "context_pressure", "orphan_pressure", "unknown")
_VALUES = ("worker", "inline:small", "", "null", "12", "red", "x1")


def _states(spark: SparkSession, root: str) -> DataFrame:
    """A document per user from the event log: key and value by the number of the event."""
    pick = lambda xs, by: F.get(F.array(*map(F.lit, xs)), by.cast("int"))
    e = table(spark, root, "events")
    key = pick(_KEYS, F.col("event_id") % len(_KEYS))
    return state.merge(e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), key.alias("key"), pick(_VALUES, F.floor(F.col("value")) % len(_VALUES)).alias("value"), F.col("ts").alias("at")))


def state_merge(spark: SparkSession, root: str) -> DataFrame:
    return _states(spark, root)


def state_get(spark: SparkSession, root: str) -> DataFrame:
    doc = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return _states(spark, root).select("doc", doc.alias("j")).select("doc", *[state.field(F.col("j"), k).alias(k) for k in ("stage", "bead", "orphan_pressure", "absent")])


def stamp_write(spark: SparkSession, root: str) -> DataFrame:
    """Stamps per user after the event log; a purchase also syncs. Some users have a stamp before, some one of the old form."""
    e = table(spark, root, "events")
    u = e.select(F.col("user_id").alias("target")).distinct()
    third = lambda k, c: F.when(F.col("target") % 3 == k, c)
    name = lambda x: F.concat(F.lit(x), F.col("target").cast("string"))
    present = u.select("target", third(1, name("s")).alias("last_synced"), third(1, F.lit("2023-01-01")).alias("last_synced_date"), third(0, name("h")).alias("hash"), F.when(F.col("target") % 6 == 0, F.lit("2022-01-01")).alias("date"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return state.stamps(present, e.select(F.col("user_id").alias("target"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("synced"), F.concat("event_type", F.col("event_id").cast("string")).alias("hash"), day.alias("date")))


def orphan_escalation(spark: SparkSession, root: str) -> DataFrame:
    """Readings of a user's counter that rose above the reading before."""
    e = table(spark, root, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") / 10).cast("bigint").alias("n"))
    return state.rising(e, "user_id", ["ts", "event_id"], "n").select("event_id", "user_id", "n", "before")


def canonical_export(spark: SparkSession, root: str) -> DataFrame:
    """Lines of documents: English ones are memories and come last in byte order, the others as they stand."""
    memory = F.col("lang") == "en"
    kind = F.when(memory, "memory").otherwise("issue")
    line = F.concat(F.lit('{"title":'), F.md5("text"), F.lit(',"_type":"'), kind, F.lit('"}'))
    d = table(spark, root, "documents").where("text is not null").select(F.col("doc_id").alias("at"), line.alias("value"))
    return state.canonical_order(d, F.col("value").contains('"_type":"memory"')).select(F.col("at").alias("doc_id"), "position")


def since_synced(spark: SparkSession, root: str) -> DataFrame:
    """Wings whose newest chunk was filed over seven days after their newest logical drawer."""
    d = table(spark, root, "drawers").where("wing is not null").select("wing", F.col("filed_at").alias("at"), "parent_drawer_id")
    return drift.older_by(d.where("parent_drawer_id <> ''"), d.where("parent_drawer_id is null"), "wing")


# --- files and listings ---------------------------------------------------------------------------


def scan_mtime_window(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the transcripts whose last event is within 14 whole days of the last of all, the listing taken from the lines."""
    e = transcripts.events(part_plans.nested.parse_lines(texts(spark, root, "agent_records"))).where("ts <> ''")
    seen = e.groupBy("file_name").agg(F.max(F.substring("ts", 1, 10)).alias("day"))
    last = seen.agg(F.max("day")).first()[0] or "1970-01-01"
    inside = seen.where(files.in_window(F.concat(F.regexp_replace("file_name", r"^.*/|\.jsonl$", ""), F.lit(".jsonl")), F.col("day").cast("timestamp"), 14, last)).select("file_name")
    return table(spark, root, "agent_records").join(inside, "file_name", "left_semi").groupBy("file_name").agg(F.count("*").alias("n"))


def scan_files_sorted(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation texts written as a file each in folders of their own, listed with a digest."""
    folder = fresh_folder(spark, "listed")
    table(spark, root, "eval_items").select("item_id", "text").write.partitionBy("item_id").text(folder)
    return files.files_sorted(spark, folder).where("path like '%.txt'").select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), "sha256")


def _porcelain(spark: SparkSession, root: str) -> DataFrame:
    """Worktree listings, one per kind: each evaluation text is a worktree, every third is locked."""
    e = table(spark, root, "eval_items").select(F.col("kind").alias("host"), "item_id")
    i = F.col("item_id").cast("string")
    lock = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("locked pid "), i)).when(F.col("item_id") % 3 == 1, F.lit("locked"))
    lines = F.array(F.concat(F.lit("worktree /w/tree "), i), F.concat(F.lit("HEAD "), F.md5(i)), F.concat(F.lit("branch refs/heads/b"), i), F.coalesce(lock, F.lit("")))
    return e.select("host", "item_id", F.posexplode(lines).alias("k", "value")).select("host", (F.col("item_id") * 4 + F.col("k")).alias("line_no"), "value")


def scan_porcelain(spark: SparkSession, root: str) -> DataFrame:
    return files.worktrees(_porcelain(spark, root), ("host",))


def _trees(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(worktrees, live, issues): a tunnel is a worktree locked by its source drawer for the issue of its target drawer."""
    t, d = table(spark, root, "tunnels"), table(spark, root, "drawers")
    trees = t.select(F.col("id").alias("path"), F.nullif("source_drawer_id", F.lit("")).alias("pid"), F.nullif("target_drawer_id", F.lit("")).alias("issue")).distinct()
    gone = table(spark, root, "drawer_deletions").select(F.col("drawer_id").alias("id")).distinct().withColumn("status", F.lit("closed"))
    return trees, d.select(F.col("id").alias("pid")), gone


def orphan_worktrees(spark: SparkSession, root: str) -> DataFrame:
    return drift.abandoned(*_trees(spark, root)).select("path", "dead", "closed").distinct()


def orphan_total(spark: SparkSession, root: str) -> DataFrame:
    """Worktrees whose lock is dead, and processes that no worktree is locked by."""
    trees, live, issues = _trees(spark, root)
    dead = drift.abandoned(trees, live, issues).where("dead").select("path").distinct().agg(F.count("*").alias("n"))
    idle = drift.unresolved(live.distinct(), trees.where("pid is not null"), "pid").agg(F.count("*").alias("n"))
    return dead.unionByName(idle).agg(F.sum("n").alias("n"))


def watch_pr(spark: SparkSession, root: str) -> DataFrame:
    """Issues that name a pull request, or none, and its state where it is known."""
    e = table(spark, root, "eval_items")
    i = F.col("item_id").cast("string")
    url = F.concat(F.lit("https://github.com/org/"), F.col("kind"), F.lit("/pull/"), i)
    named = e.select("item_id", F.when(F.col("item_id") % 5 > 0, F.concat(F.lit("waits for "), url, F.lit(" and https://github.com/org/x/pull/1"))).otherwise(F.lit("nothing")).alias("t"))
    pulls = e.where("item_id % 4 > 0").select(url.alias("url"), F.get(F.array(*map(F.lit, ("open", "merged", "closed", "open"))), (F.col("item_id") % 4).cast("int")).alias("state"))
    return drift.pull_states(named.select(F.col("item_id").alias("id"), "t"), pulls, tx.pull_url("t"))


def unreferenced_clones(spark: SparkSession, root: str) -> DataFrame:
    """Clones of a wing's repository that no tunnel names as its source."""
    wing = table(spark, root, "drawers").where("wing is not null").select(F.concat(F.lit("org/"), "wing").alias("slug")).distinct()
    remote = table(spark, root, "tunnels").where("source_wing is not null").select(F.explode(tx.repo_slugs(F.concat(F.lit("git@github.com:org/"), "source_wing", F.lit(".git")))).alias("slug"))
    return drift.unresolved(wing, remote, "slug")


def template_drift(spark: SparkSession, root: str) -> DataFrame:
    """Documents as templates by title against drawers as copies: how many are in which state."""
    one = lambda df: df.groupBy("path").agg(F.min("sha256").alias("sha256"))
    a = one(texts(spark, root, "documents").where("text is not null").select(tx.derive_title("text").alias("path"), F.sha2("text", 256).alias("sha256")))
    b = one(census.logical(table(spark, root, "drawers")).select(F.coalesce(F.nullif("title", F.lit("")), tx.derive_title("text")).alias("path"), F.sha2("text", 256).alias("sha256")))
    return drift.drift_states(a, b).select(F.md5("path").alias("path_md5"), "state")


def merged_not_closed(spark: SparkSession, root: str) -> DataFrame:
    """Issues whose newest current status is not closed and that a document's first line names."""
    t = table(spark, root, "kg_triples").where("subject like 'issue:%' and predicate = 'has_status' and current")
    issues = t.groupBy(F.substring("subject", 7, 200).alias("id")).agg(F.max(F.struct("valid_from", "id", "object"))["object"].alias("o"))
    issues = issues.select("id", F.when(F.col("o") == "closed", "closed").when(F.col("o") == "active", "in_progress").otherwise("open").alias("status"))
    ids = F.array_union(tx.any_id_scan("t"), F.regexp_extract_all("t", F.lit("[a-z]+-[0-9]{8}"), F.lit(0)))
    return drift.merged_but_open(texts(spark, root, "documents").select(tx.derive_title("text").alias("t")), issues, ids).select("id", "status")


def label_regex_filter(spark: SparkSession, root: str) -> DataFrame:
    return drift.named_set(texts(spark, root, "documents"), "loomcraft").select("doc_id")


def command_match(spark: SparkSession, root: str) -> DataFrame:
    """Commands of the transcripts, alone and behind others, and the verb that each holds."""
    c = transcripts.top_blocks(part_plans.nested.parse_lines(texts(spark, root, "agent_records"))).where("command <> ''").select("record_id", "i", "command")
    tail = F.get(F.array(*map(F.lit, ("", " && git -C /x push", "; bd --json close a-1", " | cat", "\ngit merge", " && bd dolt  push", " digit merge"))), (F.col("record_id") % 7).cast("int"))
    return c.select("record_id", "i", shell.central_verb(F.concat("command", tail)).alias("verb"))


def path_classes(spark: SparkSession, root: str) -> DataFrame:
    p = texts(spark, root, "documents").select(F.explode(tx.extract_paths("text")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    kinds = F.array(*[F.struct(F.lit(r).alias("runtime"), shell.path_class(F.col("path"), r).alias("class")) for r in ("", "python", "bash")])
    return p.select("n", F.inline(kinds)).groupBy("runtime", "class").agg(F.sum("n").alias("n"), F.count("*").alias("n_paths"))


def split_arrow(spark: SparkSession, root: str) -> DataFrame:
    """Citations made of titles and quoted arrows: the commands that each may name."""
    t = F.regexp_replace(F.coalesce(F.nullif("title", F.lit("")), F.lit("x")), r"[\s→\[\]`]+", " ")
    forms = ("grep '{} -> 1' f -> 2", "{} -> {} → 3", '"{} -> it\'s" -> 0', "{} ' -> open")
    cite = lambda f: reduce(lambda a, b: F.concat(a, b), [x for k, part in enumerate(f.split("{}")) for x in ([F.lit(part)] if k == 0 else [t, F.lit(part)])])
    d = census.logical(table(spark, root, "drawers")).select("id", "title").distinct()
    rows = d.select("id", F.posexplode(F.array(*[cite(f) for f in forms])).alias("form", "payload"))
    slots = transcripts.slots(rows.select(F.concat_ws("|", "id", "form").alias("key"), F.concat(F.lit("evidence: "), "payload").alias("report")))
    return slots.select("key", F.size("commands").alias("n"), F.md5(F.array_join("commands", "\x1f")).alias("commands_md5"))


# --- transcripts and history ----------------------------------------------------------------------


def ring5(spark: SparkSession, root: str) -> DataFrame:
    """Per turn of a user the last five assistant texts since the turn before."""
    kept = transcripts.kept_events(transcripts.events(part_plans.nested.parse_lines(texts(spark, root, "agent_records"))))
    turns = kept.where("real").select("record_id", "file_name", "g").join(transcripts.turn_rings(kept), ["file_name", "g"], "left")
    return turns.select("record_id", F.md5(F.array_join(F.coalesce("ring", F.array().cast("array<string>")), " ")).alias("ring_md5"))


def _slots(spark: SparkSession, root: str) -> DataFrame:
    """The slots of all assistant texts with a bracket line put in, as data hold few."""
    b = transcripts.top_blocks(part_plans.nested.parse_lines(texts(spark, root, "agent_records"))).where("role = 'assistant' and type = 'text'")
    made = F.concat(F.lit("Seen `it` [`cat a` -> ok] and [INFERRED]\n# no [heading]\n  evidence: `"), F.substring("text", 1, 20), F.lit("`\n```\n[fenced]\n```\n[ ] [x]\n"), "text")
    return transcripts.slots(b.select(F.concat_ws("|", "record_id", "i").alias("key"), made.alias("report")))


def slots(spark: SparkSession, root: str) -> DataFrame:
    return _slots(spark, root).select("key", "at", "form", F.md5("payload").alias("payload_md5"))


def slot_count(spark: SparkSession, root: str) -> DataFrame:
    """Slots of each text, and those that are only inferred: the work list."""
    return _slots(spark, root).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("payload") == "INFERRED").alias("n_inferred"))


def history_mine(spark: SparkSession, root: str) -> DataFrame:
    """Documents as history: scored, judged (a text of even length is salient), drafted, clustered, and the new mark."""
    units = log_plans._units(spark, root).withColumnRenamed("doc_id", "id")
    out = mining.mine(units, mining.commit_score(), tx.cluster_key("files"), lambda bodies: [len(b) % 2 == 0 for b in bodies], "documents")
    n = out.clusters.select(F.col("cluster").alias("subject"), F.lit("members").alias("predicate"), F.col("n").cast("string").alias("object"))
    mark = spark.createDataFrame([("mark", "seen", str(out.mark))], "subject string, predicate string, object string")
    return out.triples.unionByName(n).unionByName(mark)


# --- retrieval ------------------------------------------------------------------------------------


def page_total(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "drawers").dropDuplicates(["id"])
    return census.list_page(d, 20, 0, wing=part_plans.WING).select("total").distinct()


def neighbour_stitch(spark: SparkSession, root: str) -> DataFrame:
    """For every drawer with chunks its best chunk for the probe and those beside it."""
    d = table(spark, root, "drawers")
    rows = search.canonical(d).where("chunk_index is not null").dropDuplicates(["id"]).select("cid", "chunk_index", "text", "embedding")
    parts = search.distances(rows, retrieval_plans._probe(d)[1]).groupBy("cid").agg(F.collect_list(F.struct("chunk_index", "dist", "text")).alias("parts"))
    return parts.select("cid", F.md5(search.stitched(F.col("parts"))).alias("stitched_md5"))


def bm25_score_sum(spark: SparkSession, root: str) -> DataFrame:
    """Scores of all documents for all evaluation texts."""
    q = table(spark, root, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.scores(bm25.build(part_plans._docs(spark, root)), q).select(F.col("query_id").alias("item_id"), F.col("cid").alias("doc_id"), F.round("score", 6).alias("score"))


def _lanes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of the raw vector search and of the hybrid one: a tunnel's source drawer asks for its target drawer.

    Both searches are made for the queries whose target they may find; any other adds 0 to the means.
    """
    d = table(spark, root, "drawers")
    t = table(spark, root, "tunnels").groupBy(F.col("id").alias("query_id")).agg(F.min(F.struct("source_drawer_id", "target_drawer_id", "kind")).alias("t"))
    one = search.canonical(d).where("embedding is not null and size(embedding) = 64 and not exists(embedding, x -> isnan(x))").groupBy("id").agg(F.min("title").alias("query"), F.min(F.struct("embedding", "cid")).alias("v"))
    one = staged(one.select("id", "query", "v.embedding", "v.cid"), "vectors")
    asked = t.select("query_id", F.col("t.source_drawer_id").alias("id"), F.col("t.target_drawer_id").alias("target"), "t.kind").where("target <> ''").join(one, "id")
    asked = staged(asked.select("query_id", "target", "kind", F.coalesce("query", F.lit("")).alias("query"), "embedding"), "asked")
    vectors, index = one.select("id", "cid", "embedding"), bm25.documents(d)
    queries = asked.join(lanes.reachable(index, vectors, asked, 10, 10 * search.OVERFETCH), "query_id", "left_semi").select("query_id", "query", "embedding")
    near = search.nearest_batch(vectors, queries, 10 * search.OVERFETCH)
    raw = near.where("rank <= 10").select("query_id", "id", "rank")
    both = search.hybrid_batch(d, index, queries, 10, near).select("query_id", F.col("cid").alias("id"), "rank")

    def metrics(found: DataFrame) -> DataFrame:
        # At most ten ids a query.
        lists = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("found"))
        rows = asked.join(lists, "query_id", "left").select("kind", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.array("target").alias("relevant"))
        return evaluate.metrics(rows, 10)

    return metrics(raw), metrics(both)


def before_after(spark: SparkSession, root: str) -> DataFrame:
    raw, both = _lanes(spark, root)
    out = raw.withColumn("mode", F.lit("before")).unionByName(both.withColumn("mode", F.lit("after")))
    return out.select("mode", "kind", "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def acceptance_gate(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.gate(*_lanes(spark, root))


def prior_art(spark: SparkSession, root: str) -> DataFrame:
    """What is known about one project: hybrid search, facts in both directions, its newest diary entries, tagged memories, issues that mention it."""
    d, t = table(spark, root, "drawers"), table(spark, root, "kg_triples")
    title, vector = retrieval_plans._probe(d)
    lane = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    facts = part_plans.graph.facts_about(t, "project:loomcraft", "both")
    diary = d.where("room = 'diary' and wing = 'loomcraft'").select("id", "filed_at").distinct().orderBy(F.desc_nulls_last("filed_at"), F.desc("id")).limit(5)
    memories = d.join(search.tagged(table(spark, root, "drawer_tags"), ["bug-family"]), "id", "left_semi").where("wing = 'loomcraft'")
    issues = t.where("subject like 'issue:%' and object = 'project:loomcraft'").select(F.col("subject").alias("id"))
    lanes = [lane(search.hybrid_search(d, retrieval_plans._index(d), title, vector, 10), "search"), lane(facts, "fact"), lane(diary, "diary"), lane(memories, "memory"), lane(issues, "issue")]
    return reduce(DataFrame.unionByName, lanes).distinct()


def active_cycles(spark: SparkSession, root: str) -> DataFrame:
    """Logical drawers with an open question, and those tagged for triage whose question is for the planner."""
    d = census.logical(table(spark, root, "drawers")).select("id", "text")
    tags = table(spark, root, "drawer_tags").select(F.col("drawer_id").alias("id"), "tag")
    return drift.active(d, tags, "(?i)open question", r"(?i)soundness-status:\s*(\w+)", r"(?i)question for the (\w+)", "triage", running="planner")


QUERIES = {
    f.__name__: f
    for f in (
        get_drawer, update_drawer, rechunk, kg_add, row_insert, tag_drawer, create_tunnel, delete_tunnel, diary_write, checkpoint_batch, migrate_kg,
        migrate_drawers, resume_checkpoint, exists_probe, state_merge, state_get, stamp_write, orphan_escalation, canonical_export, since_synced,
        scan_mtime_window, scan_files_sorted, scan_porcelain, orphan_worktrees, orphan_total, watch_pr, unreferenced_clones, template_drift,
        merged_not_closed, label_regex_filter, command_match, path_classes, split_arrow, ring5, history_mine, page_total, neighbour_stitch,
        bm25_score_sum, slots, slot_count, before_after, acceptance_gate, prior_art, active_cycles,
    )
}

_TITLE = scalar_plans._FIRST
_LOGICAL = "parent_drawer_id is null"
_PICK = "(['{}'])[(({}) % {} + 1)::int]"
_STATE = f"""e as (select user_id doc, event_id seq, {_PICK.format("', '".join(_KEYS), "event_id", len(_KEYS))} k, {_PICK.format("', '".join(_VALUES), 'floor("value")::bigint', len(_VALUES))} v, ts from events),
s as (select doc, null::varchar v, null::varchar "mode", arg_max(v, seq) filter (k = 'activity') activity, arg_max(v, seq) filter (k = 'stage') stage,
  arg_max(v, seq) filter (k = 'bead') bead, arg_max(v, seq) filter (k = 'dispatch') dispatch, arg_max(v, seq) filter (k = 'stage_spend') stage_spend, arg_max(v, seq) filter (k = 'context_pressure') context_pressure,
  arg_max(v, seq) filter (k = 'parallel_candidates') pc, arg_max(v, seq) filter (k = 'orphan_pressure') op,
  count(*) filter (k = 'dispatch' and v = 'worker') dispatched, count(*) filter (k = 'dispatch' and starts_with(v, 'inline:')) "inline", max(ts) updated from e group by 1),
st as (select doc, v, "mode", activity, stage, case when bead not in ('', 'null') then bead end bead, case when dispatch not in ('', 'null') then dispatch end dispatch,
  case when stage_spend not in ('', 'null') then stage_spend end stage_spend, case when context_pressure not in ('', 'null') then context_pressure end context_pressure,
  case when regexp_full_match(pc, '[0-9]+') then pc::bigint else 0 end parallel_candidates, case when regexp_full_match(op, '[0-9]+') then op::bigint else 0 end orphan_pressure,
  dispatched, "inline", updated from s)"""
_GLOB = lambda globs: "(" + " or ".join(f"path glob '{g}'" for g in globs) + ")"
_CLASS = " union all ".join(
    f"select '{r}' runtime, n, case when {_GLOB(shell.NEITHER)} then 'other' when {_GLOB(shell.TESTS + shell.RUNTIMES[r][0])} then 'test' when {_GLOB(shell.SOURCES + shell.RUNTIMES[r][1])} then 'source' else 'other' end \"class\" from p"
    for r in ("", "python", "bash")
)
_VERB = r"""case when regexp_matches(c, '(^|[;&|\s])git\s+(--?\S+\s+)*merge(\s|$)') then 'git merge' when regexp_matches(c, '(^|[;&|\s])git\s+(--?\S+\s+)*push(\s|$)') then 'git push'
when regexp_matches(c, '(^|[;&|\s])bd\s+(--?\S+\s+)*dolt\s+push(\s|$)') then 'bd dolt push' when regexp_matches(c, '(^|[;&|\s])bd\s+(--?\S+\s+)*close(\s|$)') then 'bd close'
when regexp_matches(c, '(^|[;&|\s])bd\s+(--?\S+\s+)*update(\s|$)') then 'bd update' end"""
_TREES = """t as (select distinct id path, nullif(source_drawer_id, '') pid, nullif(target_drawer_id, '') issue from tunnels),
a as (select path, pid is not null and pid not in (select id from drawers) dead, issue is not null and issue in (select drawer_id from drawer_deletions where drawer_id is not null) closed from t)"""
_GT = f"""g0 as (select id, min((source_drawer_id, target_drawer_id, kind)) t from tunnels group by 1),
src as (select id, min(title) title, min(embedding) embedding from drawers where {retrieval_plans._USABLE} group by 1),
gt as (select g0.id query_id, t[1] source, t[2] target, t[3] kind, coalesce(title, '') title, embedding from g0 join src on src.id = t[1] where t[2] <> '')"""
_D2 = retrieval_plans._D2
_METRICS = """s as (select "mode", kind, coalesce(max(case when id = target then 1.0::double end), 0) r, coalesce(max(case when id = target then 1.0::double / "rank" end), 0) m
  from (select m."mode", gt.query_id, gt.target, coalesce(nullif(gt.kind, ''), 'unspecified') kind, f.id, f."rank" from gt cross join (values ('before'), ('after')) m("mode") left join found f on f.query_id = gt.query_id and f."mode" = m."mode") group by "mode", query_id, kind),
mt as (select "mode", kind, count(*) n, avg(r) recall, avg(m) mrr from (select "mode", kind, r, m from s union all select "mode", 'all', r, m from s) group by 1, 2)"""
_LANES = f"""{_GT}, {retrieval_plans._bm25(retrieval_plans._UNITS, "select query_id, title query from gt")},
dr as (select distinct on (id) id, {retrieval_plans._CID} cid, parent_drawer_id, embedding from drawers),
dd as (select query_id, dr.id, cid, {_D2.format(a="dr.embedding", b="gt.embedding")} dist from dr, gt where dr.embedding is not null and len(dr.embedding) = 64 and not list_bool_or(list_transform(dr.embedding, lambda x: isnan(x)))),
rn as (select *, row_number() over (partition by query_id order by dist, id) r from dd),
vl as (select query_id, cid, row_number() over (partition by query_id order by d, i) "rank" from (select query_id, cid, min(dist) d, min_by(id, (dist, id)) i from rn where r <= 100 group by 1, 2)),
kl as (select query_id, cid, row_number() over (partition by query_id order by round(s, 9) desc, cid) "rank" from score where cid in (select id from drawers where parent_drawer_id is null)),
fu as (select query_id, cid, round(sum(1.0::double / (60 + "rank")), 12) score from (select * from vl union all select * from kl) group by 1, 2),
fl as (select id cid, max(filed_at) filed_at from drawers where parent_drawer_id is null group by 1),
af as (select query_id, cid, row_number() over (partition by query_id order by score desc, filed_at desc nulls last, cid) "rank" from fu left join fl using (cid)),
found as (select 'before' "mode", query_id, id, r "rank" from rn where r <= 10 union all select 'after', query_id, cid, "rank" from af where "rank" <= 10), {_METRICS}"""
_UNIT = log_plans._UNIT

_BARE = r"regexp_replace(replace({0}, '`', ''), '^\s+|\s+$', '', 'g')"
_SLOTS = rf"""{log_plans._TB}, rp as (select record_id || '|' || i k, 'Seen `it` [`cat a` -> ok] and [INFERRED]' || chr(10) || '# no [heading]' || chr(10) || '  evidence: `' || substr(tx, 1, 20) || '`' || chr(10) || '```' || chr(10) || '[fenced]' || chr(10) || '```' || chr(10) || '[ ] [x]' || chr(10) || tx t
  from tb where role = 'assistant' and ty = 'text'),
ln as (select k, generate_subscripts(a, 1) i, unnest(a) x from (select k, string_split(t, chr(10)) a from rp)),
fe as (select *, regexp_matches(x, '^\s*(```|~~~)') fence from ln),
fn as (select *, sum(fence::int) over (partition by k order by i) n from fe),
ul as (select *, regexp_matches(x, '^\s*evidence:') field from fn where not fence and n % 2 = 0 and not regexp_matches(x, '^\s*#{{1,6}}(\s|$)')),
sl as (select k, i, 0 j, 'field' form, {_BARE.format(r"regexp_extract(x, '^\s*evidence:(.*)$', 1)")} p from ul where field union all
  select k, i, j, 'bracket', {_BARE.format("y")} from (select k, i, generate_subscripts(m, 1) j, unnest(m) y from (select k, i, regexp_extract_all(x, '\[([^\]\[]+)\]', 1) m from ul where not field)))"""

SQL = {
    "slots": f'with {_SLOTS} select k "key", (row_number() over (partition by k order by i, j) - 1)::int "at", form, md5(p) payload_md5 from sl where p <> \'\'',
    "slot_count": f"with {_SLOTS} select k \"key\", count(*) n, count(*) filter (p = 'INFERRED') n_inferred from sl where p <> '' group by 1",
    "get_drawer": """select distinct id, wing, title, md5("text") text_md5, true found from drawers where id = (select min(id) from drawers) union all select 'missing', null, null, null, false""",
    "update_drawer": """with o as (select id, any_value("text") || any_value("text") t from drawers where parent_drawer_id is null and length("text") > 800 group by id order by id limit 1)
select distinct d.id, md5(d."text") text_md5, chunk_index, parent_drawer_id from drawers d, o where d.id <> o.id and coalesce(parent_drawer_id, '') <> o.id and d.id not in (select o.id || '_chunk_' || lpad(i::varchar, 6, '0') from o, range(0, 1000) r(i))
union all select id, md5(t), null, null from o union all
select id || '_chunk_' || lpad(i::varchar, 6, '0'), md5(substr(t, (i * 800 + 1)::bigint, 800)), i::int, id from (select id, t, unnest(range(0, ceil(length(t) / 800.0)::bigint)) i from o)""",
    "rechunk": """with d as (select distinct id, "text" t from drawers where parent_drawer_id is null)
select id parent_id, id, null::int chunk_index, length(t)::int n_chars from d union
select id, id || '_chunk_' || lpad(i::varchar, 6, '0'), i::int, length(substr(t, (i * 800 + 1)::bigint, 800))::int from (select id, t, unnest(range(0, ceil(length(t) / 800.0)::bigint)) i from d where length(t) > 800)""",
    "kg_add": """select predicate, count(*) n, count(*) filter ("current") n_current, count(*) filter (valid_from is null and valid_to is null) n_open, count(*) filter (confidence = 1) n_sure
from (select predicate, "current", valid_from, valid_to, confidence from kg_triples union all select 'seen_in', true, null, null, 1 from (select distinct subject from kg_triples)) group by 1""",
    "row_insert": "select drawer_id, count(*) n, count(tag) n_tags from (select drawer_id, tag from drawer_tags union all select drawer_id, null from drawer_deletions) group by 1",
    "tag_drawer": "select tag, count(*) n from drawer_tags group by 1 union all select 'seen', count(distinct id) from drawers",
    "create_tunnel": """with t as (select *, source_wing || '/' || source_room a, target_wing || '/' || target_room b from tunnels
  where (source_wing, source_room) in (select (wing, room) from drawers) and (target_wing, target_room) in (select (wing, room) from drawers)),
k as (select *, substr(sha256(least(a, b) || '|' || greatest(a, b)), 1, 16) tunnel_id, min(created_at) over (partition by least(a, b), greatest(a, b)) f from t)
select tunnel_id, source_wing, source_room, target_wing, target_room, f created_at from k
qualify row_number() over (partition by tunnel_id order by created_at desc nulls last, id desc, source_wing desc, source_room desc) = 1""",
    "delete_tunnel": "select distinct id from tunnels where id <> (select min(id) from tunnels)",
    "diary_write": f"""with d as (select lang, "text", min(source) topic from documents where lang is not null and "text" is not null group by 1, 2),
i as (select *, 'drawer_wing_' || lang || '_diary_' || substr(sha256(length('wing_' || lang) || ':wing_' || lang || '5:diary' || length("text") || ':' || "text"), 1, 24) id, coalesce(nullif(topic, ''), {_TITLE}) title from d)
select id, 'wing_' || lang wing, 'diary' room, title, null::int chunk_index, lang added_by from i union all
select id || '_chunk_' || lpad(k::varchar, 6, '0'), 'wing_' || lang, 'diary', title, k::int, lang from (select *, unnest(range(0, ceil(length("text") / 800.0)::bigint)) k from i where length("text") > 800)""",
    "checkpoint_batch": """with s as (select item_id, length("text") % 64 b from eval_items),
o as (select item_id, b in (select b from s where item_id % 2 = 0) old, row_number() over (partition by b order by item_id) r from s)
select item_id, case when old or r > 1 then 'duplicate' else 'added' end outcome from o union all select -1, 'error'""",
    "migrate_kg": f"""select id, subject, predicate, object, round(coalesce(confidence, 1.0)::double, 4) confidence, coalesce("current", true) "current", valid_from, coalesce(created_at, timestamp '{NOW}') created_at from kg_triples
qualify row_number() over (partition by id order by coalesce(created_at, timestamp '{NOW}') desc, object desc nulls last, valid_from desc nulls last, coalesce(confidence, 1.0) desc) = 1""",
    "migrate_drawers": f"select id, max({_TITLE}) title, max(coalesce(filed_at, timestamp '{NOW}')) filed_at from drawers group by id",
    "resume_checkpoint": """select (not coalesce("current", false))::int run, predicate, count(*) n from kg_triples group by 1, 2""",
    "exists_probe": f"select 'there' probe, count(*) > 0 found from drawers where wing = '{part_plans.WING}' and room = '{part_plans.ROOM}' union all select 'absent', count(*) > 0 from drawers where wing = 'no such wing' union all select 'unreadable', null",
    "state_merge": f"with {_STATE} select * from st",
    "state_get": f"with {_STATE} select doc, coalesce(stage, '') stage, coalesce(bead, '') bead, orphan_pressure::varchar orphan_pressure, '' absent from st",
    "stamp_write": """with w as (select user_id t, arg_max(event_type || event_id, event_id) lc, arg_max(strftime(ts, '%Y-%m-%d'), event_id) lcd, arg_min(strftime(ts, '%Y-%m-%d'), event_id) fd,
  arg_max(event_type || event_id, event_id) filter (event_type = 'purchase') s, arg_max(strftime(ts, '%Y-%m-%d'), event_id) filter (event_type = 'purchase') sd from events group by 1)
select t target, coalesce(s, case t % 3 when 1 then 's' || t when 0 then 'h' || t end) last_synced,
  case when s is not null then sd when t % 3 = 1 then '2023-01-01' when t % 6 = 0 then '2022-01-01' when t % 3 = 0 then fd end last_synced_date, lc last_checked, lcd last_checked_date from w""",
    "orphan_escalation": """with r as (select event_id, user_id, ts, floor("value" / 10)::bigint n from events), l as (select *, coalesce(lag(n) over (partition by user_id order by ts, event_id), 0) "before" from r)
select event_id, user_id, n, "before" from l where n > 0 and n > "before\"""",
    "canonical_export": """with l as (select doc_id, coalesce(lang = 'en', false) m, '{"title":' || md5("text") || ',"_type":"' || case when lang = 'en' then 'memory' else 'issue' end || '"}' v from documents where "text" is not null)
select doc_id, row_number() over (order by m, case when not m then doc_id end, v, doc_id) "position" from l""",
    "since_synced": """with a as (select wing, max(filed_at) filter (parent_drawer_id <> '') n, max(filed_at) filter (parent_drawer_id is null) o from drawers where wing is not null group by 1),
g as (select wing, floor((epoch(n)::bigint - epoch(o)::bigint) / 86400.0)::bigint age_days from a where n is not null and o is not null) select * from g where age_days > 7""",
    "scan_mtime_window": f"""with {log_plans._EVENTS}, s as (select file_name, max(substr(ts, 1, 10))::date d from ev where ts <> '' group by 1)
select file_name, count(*) n from agent_records where file_name in (select file_name from s where (select max(d) from s) - d < 14) group by 1""",
    "scan_files_sorted": """select item_id, sha256("text" || chr(10)) sha256 from eval_items""",
    "scan_porcelain": """select kind host, '/w/tree ' || item_id path, md5(item_id::varchar) head, 'refs/heads/b' || item_id branch, case item_id % 3 when 0 then 'pid ' || item_id when 1 then '' end locked from eval_items""",
    "orphan_worktrees": f"with {_TREES} select distinct path, dead, closed from a where dead or closed",
    "orphan_total": f"with {_TREES} select (count(distinct path) filter (dead) + (select count(distinct id) from drawers where id not in (select pid from t where pid is not null)))::bigint n from a",
    "watch_pr": """select item_id id, case when item_id % 5 > 0 then 'https://github.com/org/' || kind || '/pull/' || item_id end url,
case when item_id % 5 = 0 or item_id % 4 = 0 then 'SKIP' else (['OPEN', 'MERGED', 'CLOSED', 'OPEN'])[(item_id % 4 + 1)::int] end state from eval_items""",
    "unreferenced_clones": "select distinct 'org/' || wing slug from drawers where wing is not null and wing not in (select source_wing from tunnels where source_wing is not null)",
    "template_drift": f"""with a as (select {_TITLE} k, min(sha256("text")) a from documents where "text" is not null group by 1),
b as (select coalesce(nullif(title, ''), {_TITLE}) k, min(sha256("text")) b from drawers where {_LOGICAL} group by 1)
select md5(k) path_md5, case when a is null then 'FAIL source missing' when b is null then 'DRIFT absent' when a = b then 'OK' else 'DRIFT differs' end state from a full join b using (k)""",
    "merged_not_closed": f"""with n as (select unnest(list_concat(regexp_extract_all(t, '{scalar_plans._IDS}', 1), regexp_extract_all(t, '[a-z]+-[0-9]{{8}}'))) id from (select {_TITLE} t from documents)),
s as (select substr(subject, 7, 200) id, arg_max(object, (valid_from, id)) o from kg_triples where subject like 'issue:%' and predicate = 'has_status' and "current" group by 1)
select id, case o when 'active' then 'in_progress' else 'open' end status from s where o <> 'closed' and id in (select id from n)""",
    "label_regex_filter": """select doc_id from documents where regexp_matches("text", '(^|[^a-zA-Z0-9_])loomcraft-[a-z0-9]+') or contains("text", 'hooks/') or contains("text", 'scripts/loomcraft-')""",
    "command_match": f"""with {log_plans._TB}, c as (select record_id, i, cmd || (['', ' && git -C /x push', '; bd --json close a-1', ' | cat', chr(10) || 'git merge', ' && bd dolt  push', ' digit merge'])[(record_id % 7 + 1)::int] c from tb where cmd <> '')
select record_id, i, {_VERB} verb from c""",
    "path_classes": f"""with p as (select path, count(*) n from (select unnest(list_distinct(regexp_extract_all("text", '{scalar_plans._PATH}'))) path from documents) group by 1), c as ({_CLASS})
select runtime, "class", sum(n)::bigint n, count(*) n_paths from c group by 1, 2""",
    "split_arrow": r"""with d as (select distinct id, regexp_replace(coalesce(nullif(title, ''), 'x'), '[\s→\[\]`]+', ' ', 'g') t from drawers where parent_drawer_id is null),
f as (select id, unnest([0, 1, 2, 3]) form, unnest(['grep ''' || t || ' -> 1'' f -> 2', t || ' -> ' || t || ' → 3', '"' || t || ' -> it''s" -> 0', t || ' '' -> open']) p from d),
k as (select id, form, trim(p) p, unnest(range(1, length(p) + 1)) i from f),
a as (select id, form, i, trim(substr(p, 1, i - 1)) cmd from k where substr(p, i, 4) = ' -> ' or substr(p, i, 3) = ' → '),
c as (select *, not regexp_matches(regexp_replace(cmd, '''[^'']*''|"[^"]*"', '', 'g'), '[''"]') ok from a where cmd <> ''),
g as (select id, form, coalesce(list(cmd order by i) filter (ok), [arg_max(cmd, i)]) cmds from c group by 1, 2)
select f.id || '|' || f.form::varchar "key", len(coalesce(cmds, []))::int n, md5(array_to_string(coalesce(cmds, []), chr(31))) commands_md5 from f left join g using (id, form)""",
    "ring5": f"""with {part_plans._KEPT}, a as (select *, row_number() over (partition by file_name, g order by line_no desc, record_id desc) r from kg where "role" = 'assistant'),
x as (select file_name, g, string_agg("text", ' ' order by line_no, record_id) ring from a where r <= 5 group by 1, 2)
select record_id, md5(coalesce(ring, '')) ring_md5 from kg left join x using (file_name, g) where re""",
    "history_mine": f"""with {_UNIT}, k as (select * from cs where score >= 2 and length(body) % 2 = 0)
select doc_id::varchar subject, 'has_title' predicate, subject object from k union all select doc_id::varchar, 'in_cluster', cluster_ from k union all select doc_id::varchar, 'mined_from', 'documents' from k
union all select cluster_, 'members', count(*)::varchar from k group by 1 having count(*) >= 2 union all select 'mark', 'seen', max(doc_id)::varchar from documents where "text" is not null""",
    "page_total": f"select count(distinct id) total from drawers where {_LOGICAL} and wing = '{part_plans.WING}' having count(*) > 0",
    "neighbour_stitch": f"""with {retrieval_plans._PROBE}, r as (select distinct on (id) {retrieval_plans._CID} cid, chunk_index, "text", case when {retrieval_plans._USABLE} then {retrieval_plans._D2P} end dist from drawers, probe where chunk_index is not null),
b as (select cid, min_by(chunk_index, (coalesce(dist, 'inf'::double), chunk_index)) b from r group by 1),
p as (select cid, chunk_index, max("text") t from r group by 1, 2)
select cid, md5(coalesce(substr(string_agg(t, chr(10) || chr(10) order by chunk_index) filter (chunk_index between b - 1 and b + 1), 1, 10000), '')) stitched_md5 from p join b using (cid) group by 1""",
    "bm25_score_sum": f"""with {retrieval_plans._bm25('select doc_id unit, doc_id cid, coalesce("text", chr(0)) body from documents', 'select item_id query_id, "text" query from eval_items')}
select query_id::bigint item_id, cid doc_id, round(s, 6) score from score""",
    "before_after": f'with {_LANES} select "mode", kind, n, round(recall, 6) recall, round(mrr, 6) mrr from mt',
    "acceptance_gate": f"""with {_LANES} select a.kind, a.recall > b.recall and a.mrr >= b.mrr accepted from mt a join mt b on a.kind = b.kind and a."mode" = 'after' and b."mode" = 'before'""",
    "prior_art": f"""with {retrieval_plans._PROBE}, {retrieval_plans._KEY}, {retrieval_plans._klane()}, {retrieval_plans._vlane()}, {retrieval_plans._HYDRATE},
di as (select distinct id, filed_at from drawers where room = 'diary' and wing = 'loomcraft' order by filed_at desc nulls last, id desc limit 5)
select 'search' kind, cid id from best join own using (cid) union select 'fact', id from kg_triples where (subject = 'project:loomcraft' or object = 'project:loomcraft') and "current"
union select 'diary', id from di union select 'memory', id from drawers where wing = 'loomcraft' and id in (select drawer_id from drawer_tags where tag = 'bug-family')
union select 'issue', subject from kg_triples where subject like 'issue:%' and object = 'project:loomcraft'""",
    "active_cycles": r"""select distinct id, 'design' kind from drawers where parent_drawer_id is null and (regexp_matches("text", '(?i)open question') or regexp_extract("text", '(?i)soundness-status:\s*(\w+)', 1) not in ('', 'green'))
union select id, 'exploration' from drawers where parent_drawer_id is null and lower(regexp_extract("text", '(?i)question for the (\w+)', 1)) = 'planner' and id in (select drawer_id from drawer_tags where tag = 'triage')""",
}
