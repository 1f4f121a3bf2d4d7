"""Ordered-event analysis of agent transcripts: signals, spend, tiers, tool results, evidence.

Order is (file_name, line_no, record_id), never the order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import jaccard, word_set

# Phrases and thresholds that results depend on.
DIAGNOSTIC = (
    "you should have|you missed|you didn't|you didnt|you forgot|you misread|why did you|why didn't you|why didnt you|that's wrong|thats wrong|"
    "that's not right|thats not right|that's backwards|thats backwards|going down the wrong path|dead end"
)
STEERING = r"""(^|[,.!?][")]?\s*)(no|stop|wait|actually|don't|dont|instead)([ ,.!?]|$)"""
REVERSION = "let me back up|restart this|wrong approach|let me try a different"
UPGRADE = "(you're right|youre right|apologies|let me redo|let me back up)"
STEERING_MAX, STEERING_TOOLS, ABANDON_TURNS, ABANDON_WORDS, ABANDON_DISTANCE, EXCERPT = 200, 3, 20, 10, 0.7, 500
PREAMBLE, YELLOW, RED = 14_000, 400_000, 700_000
FAILURE = (
    r"(?im)(^FAIL\s|^FAIL:\s|\bFAILED\s+\S+(?:::|/)|^--- FAIL:|\b[1-9]\d*\s+(?:tests?\s+)?failed\b|\bassertion\s+(?:failed|error)\b|^Error:\s|"
    r"\bTraceback \(most recent call last\)|^panic:\s|\bTests?:.*\b[1-9]\d*\s+(?:tests?\s+)?failed\b|\bexit code:\s*[1-9])"
)
CONFLICT = ("CONFLICT (content):", "Automatic merge failed; fix conflicts")
TEST_PATH = r"/tests?/|/__tests__/|\.test\.(?:sh|bash|py|js|ts|jsx|tsx)$|_test\.(?:sh|bash|py|go)$|^test_.*\.(?:sh|py)$|/conftest\.py$|\.spec\.(?:js|ts|jsx|tsx)$"
EDITORS, SHELL, TAIL = ("Edit", "Write", "MultiEdit"), "Bash", 80

_CONTENT = "try_variant_get(doc, '$.message.content', 'variant')"
_KIND = "substr(schema_of_variant({0}), 1, 2)"


def _file_order(*extra) -> Window:
    return Window.partitionBy("file_name").orderBy("line_no", "record_id", *extra)


def events(parsed: DataFrame) -> DataFrame:
    """(record_id, file_name, line_no, session_id, ts, role, n_tool, text, side) of parsed lines.

    text is a string content, or the text blocks joined by blanks, on one line. A content array
    that holds anything but objects and nulls makes the line an event without role. side: from a
    side chain or a meta line.
    """
    get = lambda p, t: f"try_variant_get(doc, '$.{p}', '{t}')"
    items = f"(case when {_KIND.format(_CONTENT)} = 'AR' then try_variant_get({_CONTENT}, '$', 'array<variant>') else array() end)"
    kind = _KIND.format("b")
    rows = parsed.selectExpr(
        "record_id", "file_name", "line_no", f"coalesce({get('sessionId', 'string')}, '') as session_id", f"coalesce({get('timestamp', 'string')}, '') as ts",
        f"coalesce({get('isMeta', 'boolean')}, false) or coalesce({get('isSidechain', 'boolean')}, false) as side",
        f"case when exists({items}, b -> {kind} not in ('OB', 'VO')) then '' else coalesce({get('message.role', 'string')}, '') end as role",
        f"size(filter({items}, b -> try_variant_get(b, '$.type', 'string') = 'tool_use')) as n_tool",
        f"case when {_KIND.format(_CONTENT)} = 'ST' then try_variant_get({_CONTENT}, '$', 'string') else array_join(transform(filter({items}, b -> try_variant_get(b, '$.type', 'string') = 'text'), "
        "b -> coalesce(try_variant_get(b, '$.text', 'string'), '')), ' ') end as text",
    )
    return rows.withColumn("text", F.regexp_replace("text", "[\t\n\r]", " "))


def kept_events(event_rows: DataFrame) -> DataFrame:
    """Events that count, with real (a turn a user wrote) and g, the number of real turns before, which a new turn resets all by."""
    kept = event_rows.where("not side and (role = 'assistant' or (role = 'user' and text <> ''))")
    real = (F.col("role") == "user") & ~F.col("text").startswith("<") & ~F.col("text").startswith("[Request interrupted")
    return kept.withColumn("real", real).withColumn("g", F.coalesce(F.sum(F.col("real").cast("int")).over(_file_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def turn_rings(kept: DataFrame) -> DataFrame:
    """(file_name, g, ring): the last five assistant texts since the turn before, as the next turn finds them."""
    inside = Window.partitionBy("file_name", "g").orderBy("line_no", "record_id")
    talk = kept.where("role = 'assistant'").withColumn("ring", F.collect_list("text").over(inside.rowsBetween(-4, 0)))
    return talk.withColumn("_r", F.row_number().over(Window.partitionBy("file_name", "g").orderBy(F.desc("line_no"), F.desc("record_id")))).where("_r = 1").select("file_name", "g", "ring")


def signals(event_rows: DataFrame, abandon_turns: int = ABANDON_TURNS) -> DataFrame:
    """(record_id, file_name, signal_class, upgrade_weight, excerpt): user turns that show a struggle.

    The class is the first of A_diagnostic, A_steering, B_reversion and B_abandon that holds; the
    weight is 1 if the event kept next is an assistant's that admits it.
    """
    w = _file_order()
    assistant = F.col("role") == "assistant"
    kept = kept_events(event_rows)
    kept = kept.withColumn("tools", F.count_if(assistant & (F.col("n_tool") > 0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.withColumn("admits", F.coalesce(F.lead(assistant & F.col("text").rlike(UPGRADE)).over(w), F.lit(False)))
    inside = Window.partitionBy("file_name", "g").orderBy("line_no", "record_id")
    kept = kept.withColumn("consec", F.count_if(assistant).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    turns = kept.where("real").join(turn_rings(kept), ["file_name", "g"], "left")
    low, words = F.lower("text"), word_set("text")
    distance = 1.0 - jaccard(words, word_set(F.array_join(F.coalesce("ring", F.array().cast("array<string>")), " ")), 1.0)
    cls = (
        F.when(low.rlike(DIAGNOSTIC), "A_diagnostic")
        .when((F.length("text") <= STEERING_MAX) & (F.col("tools") >= STEERING_TOOLS) & low.rlike(STEERING), "A_steering")
        .when(low.rlike(REVERSION), "B_reversion")
        .when((F.col("consec") >= abandon_turns) & (F.size(words) >= ABANDON_WORDS) & (distance > ABANDON_DISTANCE), "B_abandon")
    )
    hits = turns.withColumn("signal_class", cls).where("signal_class is not null")
    return hits.select("record_id", "file_name", "signal_class", F.col("admits").cast("int").alias("upgrade_weight"), F.substring("text", 1, EXCERPT).alias("excerpt"))


def usage(parsed: DataFrame) -> DataFrame:
    """(file_name, line_no, record_id, cr, cc, out) of assistant lines with a usage member; missing counts are 0."""
    get = lambda p: f"coalesce(try_variant_get(doc, '$.message.usage.{p}', 'bigint'), 0)"
    has = "try_variant_get(doc, '$.message.usage', 'variant')"
    rows = parsed.where(f"try_variant_get(doc, '$.type', 'string') = 'assistant' and try_variant_get(doc, '$.message.role', 'string') = 'assistant' and {has} is not null and not is_variant_null({has})")
    return rows.selectExpr("file_name", "line_no", "record_id", f"{get('cache_read_input_tokens')} as cr", f"{get('cache_creation_input_tokens')} as cc", f"{get('output_tokens')} as out")


def _ends(use: DataFrame) -> DataFrame:
    row = F.struct("line_no", "record_id", "cr", "cc", "out")
    return use.groupBy("file_name").agg(F.min(row).alias("f"), F.max(row).alias("l"))


def spend(use: DataFrame, preamble: int = PREAMBLE) -> DataFrame:
    """(file_name, gross, net, output): the last context plus output of first and last, which count once if equal."""
    e = _ends(use)
    same = (F.col("f.cr") == F.col("l.cr")) & (F.col("f.cc") == F.col("l.cc")) & (F.col("f.out") == F.col("l.out"))
    out = F.when(same, F.col("l.out")).otherwise(F.col("f.out") + F.col("l.out"))
    gross = F.col("l.cr") + F.col("l.cc") + out
    return e.select("file_name", gross.alias("gross"), (gross - preamble).alias("net"), out.alias("output"))


def tier(total: Column, yellow: int = YELLOW, red: int = RED) -> Column:
    return F.when(total > red, "red").when(total > yellow, "yellow").otherwise("green")


def context_tiers(use: DataFrame, yellow: int = YELLOW, red: int = RED) -> DataFrame:
    total = F.col("l.cr") + F.col("l.cc")
    return _ends(use).select("file_name", total.alias("context"), tier(total, yellow, red).alias("tier"))


def escalations(use: DataFrame, yellow: int = YELLOW, red: int = RED) -> DataFrame:
    """Lines whose tier is above that of the line before (not above the highest so far)."""
    rank = F.when(F.col("cr") + F.col("cc") > red, 2).when(F.col("cr") + F.col("cc") > yellow, 1).otherwise(0)
    u = use.withColumn("rank", rank).withColumn("before", F.coalesce(F.lag("rank").over(_file_order()), F.lit(0)))
    return u.where("rank > before").select("file_name", "line_no", "record_id", "rank")


def top_blocks(parsed: DataFrame) -> DataFrame:
    """(file_name, line_no, record_id, role, i, type, id, name, tool_use_id, text, file_path, command, result) of the objects in message.content."""
    items = f"(case when {_KIND.format(_CONTENT)} = 'AR' then try_variant_get({_CONTENT}, '$', 'array<variant>') else array() end)"
    get = lambda p: f"try_variant_get(b, '$.{p}', 'string')"
    inner, kind = "try_variant_get(b, '$.content', 'variant')", _KIND
    result = (
        f"case when {kind.format(inner)} = 'ST' then try_variant_get({inner}, '$', 'string') when {kind.format(inner)} = 'AR' then array_join(filter(transform(try_variant_get({inner}, '$', 'array<variant>'), "
        f"x -> case when {kind.format('x')} = 'OB' then coalesce(try_variant_get(x, '$.text', 'string'), '') when {kind.format('x')} = 'ST' then try_variant_get(x, '$', 'string') end), x -> x is not null), '\\n') else '' end"
    )
    rows = parsed.selectExpr("file_name", "line_no", "record_id", "coalesce(try_variant_get(doc, '$.message.role', 'string'), '') as role", f"posexplode({items}) as (i, b)")
    return rows.where(f"{kind.format('b')} = 'OB'").selectExpr(
        "file_name", "line_no", "record_id", "role", "i", f"coalesce({get('type')}, '') as type", f"coalesce({get('id')}, '') as id", f"coalesce({get('name')}, '') as name",
        f"coalesce({get('tool_use_id')}, '') as tool_use_id", f"coalesce({get('text')}, '') as text", f"coalesce({get('input.file_path')}, '') as file_path",
        f"coalesce({get('input.command')}, '') as command", f"{result} as result",
    )


def tool_results(block_rows: DataFrame) -> DataFrame:
    """The tool_result blocks + issuer: name of the last tool_use before them in the file with that id, '' if none.

    Calls and results stand in one ordered stream per (file, id): a repeated id multiplies nothing.
    """
    use = F.col("type") == "tool_use"
    rows = block_rows.where("(type = 'tool_use' and id <> '') or type = 'tool_result'").withColumn("key", F.when(use, F.col("id")).otherwise(F.col("tool_use_id")))
    w = Window.partitionBy("file_name", "key").orderBy("line_no", "record_id", "i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("issuer", F.coalesce(F.last(F.when(use, F.col("name")), ignorenulls=True).over(w), F.lit(""))).where("type = 'tool_result'").drop("key")


def last_failures(block_rows: DataFrame, ignored: str | None = None) -> DataFrame:
    """(file_name, failed, tests_edited): does the last shell result of a file report a failure, and was a test edited since.

    ignored: results that hold this text decide nothing (a watcher's own messages).
    """
    at = F.struct("line_no", "record_id", "i")
    bad = F.col("result").rlike(FAILURE) & ~F.col("result").contains(CONFLICT[0]) & ~F.col("result").contains(CONFLICT[1])
    shell = tool_results(block_rows).where(F.col("issuer") == SHELL)
    if ignored is not None:
        shell = shell.where(~F.col("result").contains(ignored))
    last = shell.groupBy("file_name").agg(F.max(F.struct(at.alias("at"), bad.alias("failed"))).alias("l"))
    edits = block_rows.where((F.col("type") == "tool_use") & F.col("name").isin(*EDITORS) & F.col("file_path").rlike(TEST_PATH)).groupBy("file_name").agg(F.max(at).alias("edit"))
    return last.join(edits, "file_name", "left").select("file_name", "l.failed", (F.col("l.failed") & F.coalesce(F.col("edit") > F.col("l.at"), F.lit(False))).alias("tests_edited"))


def final_reports(block_rows: DataFrame) -> DataFrame:
    """(file_name, report): the text blocks, joined by newlines, of the last assistant line that has any."""
    text = block_rows.where("role = 'assistant' and type = 'text'")
    lines = text.groupBy("file_name", "line_no", "record_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("report"))
    return lines.groupBy("file_name").agg(F.max(F.struct("line_no", "record_id", "report"))["report"].alias("report"))


_FENCE, _HEADING, _FIELD = re.compile(r"\s*(```|~~~)"), re.compile(r"\s*#{1,6}(\s|$)"), re.compile(r"\s*evidence:\s*(.*)$")
_SLOT, _ARROW = re.compile(r"\[([^\]\[]+)\]"), re.compile(r" (?:->|→) ")


def _claim(text: str) -> str:
    out = text.strip().strip("`").strip()
    return out if any(c.isalnum() for c in out) else ""


_QUOTED = re.compile("'[^']*'|\"[^\"]*\"")


def commands_cited(payload: str) -> list[str]:
    """The command parts of 'command -> result' for every arrow outside quotes; else for the last arrow; none without.

    A quote ends at the next mark of its own kind, whatever stands between.
    """
    cuts = [payload[: m.start()].strip() for m in _ARROW.finditer(payload)]
    cuts = [c for c in cuts if c]
    closed = [c for c in cuts if not re.search("['\"]", _QUOTED.sub("", c))]
    return closed or cuts[-1:]


def evidence(report: str | None) -> list[tuple[str, str, str, list[str]]]:
    """(form, payload, claim, commands) of each evidence slot of a report.

    Slots are `[...]` anywhere in a line and lines that begin with `evidence:`. Fenced lines and
    headings hold none. The claim is the prose before a slot, else after it, else that of the
    nearest line above with any.
    """
    slots, fenced, above = [], False, ""
    for line in (report or "").split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or _HEADING.match(line):
            continue
        field = _FIELD.match(line)
        if field:
            payload = field.group(1).replace("`", "").strip()
            if payload:
                slots.append(("field", payload, above, commands_cited(payload)))
            continue
        found = list(_SLOT.finditer(line))
        for k, m in enumerate(found):
            payload = m.group(1).replace("`", "").strip()
            if not payload:
                continue
            before = line[found[k - 1].end() if k else 0 : m.start()]
            claim = _claim(before) or _claim(line[m.end() :]) or above
            slots.append(("bracket", payload, claim, commands_cited(payload)))
        prose = _claim(_SLOT.sub(" ", line))
        above = prose or above
    return slots


def slots(texts: DataFrame) -> DataFrame:
    """(key, at, form, payload, claim, commands) of the evidence slots in texts (key, report)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, at, *slot) for k, report in zip(pdf["key"], pdf["report"]) for at, slot in enumerate(evidence(report))]
            yield pd.DataFrame(rows, columns=["key", "at", "form", "payload", "claim", "commands"])

    return texts.select(F.col("key").cast("string").alias("key"), "report").mapInPandas(parse, "key string, at int, form string, payload string, claim string, commands array<string>")


def provenance(block_rows: DataFrame) -> DataFrame:
    """(file_name, n_slots, n_missing, n_inferred, verdict): F1 without slots, F2 with a cited command that no call holds, else OK."""
    reports = final_reports(block_rows).select(F.col("file_name").alias("key"), "report")
    found = slots(reports)
    calls = block_rows.where("type = 'tool_use' and command <> ''").select(F.col("file_name").alias("key"), "command").distinct()
    cited = found.where("size(commands) > 0").select("key", "at", F.explode("commands").alias("cited"))
    held = cited.join(calls, "key").where(F.col("command").contains(F.col("cited"))).select("key", "at").distinct()
    missing = cited.select("key", "at").distinct().join(held, ["key", "at"], "left_anti").groupBy("key").agg(F.count("*").alias("n_missing"))
    per = found.groupBy("key").agg(F.count("*").alias("n_slots"), F.count_if(F.col("payload") == "INFERRED").alias("n_inferred"))
    out = reports.select("key").join(per, "key", "left").join(missing, "key", "left").na.fill(0)
    verdict = F.when(F.col("n_slots") == 0, "F1").when(F.col("n_missing") > 0, "F2").otherwise("OK")
    return out.select(F.col("key").alias("file_name"), "n_slots", "n_missing", "n_inferred", verdict.alias("verdict"))
