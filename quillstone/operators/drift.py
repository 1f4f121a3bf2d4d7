"""Comparisons of two states: drift, missing citations, decisions by item, related issues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx


def drift_states(source: DataFrame, copies: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, state): OK, DRIFT absent, DRIFT differs or FAIL source missing."""
    a = source.select(key, F.col(digest).alias("_a"))
    b = copies.select(key, F.col(digest).alias("_b"))
    state = F.when(F.col("_a").isNull(), "FAIL source missing").when(F.col("_b").isNull(), "DRIFT absent").when(F.col("_a") == F.col("_b"), "OK").otherwise("DRIFT differs")
    return a.join(b, key, "full").select(key, state.alias("state"))


def changed_since(manifest: DataFrame, old_hash: str | None, new_hash: str, since: str) -> DataFrame:
    """Files to look at again: all without an old hash, none if it is the new one, else those changed since."""
    if old_hash is None or old_hash == "":
        return manifest
    if old_hash == new_hash:
        return manifest.limit(0)
    return manifest.where(F.col("changed_at") > F.lit(since).cast("timestamp_ntz"))


def decided(items: DataFrame, decisions: DataFrame, default: str = "skip", stop: str = "quit") -> DataFrame:
    """(list, at, item, decision): each item's decision, the default without; after a stop all of its list are skipped."""
    own = items.join(decisions, "item", "left").withColumn("decision", F.coalesce("decision", F.lit(default)))
    w = Window.partitionBy("list").orderBy("at", "item")
    stopped = F.coalesce(F.max((F.col("decision") == stop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return own.withColumn("decision", F.when(stopped, default).otherwise(F.col("decision"))).select("list", "at", "item", "decision")


def unresolved(citations: DataFrame, known: DataFrame, column: str | list[str]) -> DataFrame:
    """Citations whose target is not known."""
    return citations.join(known.select(column).distinct(), column, "left_anti")


_TOKEN_WITH_FOLDER = r"(?<![A-Za-z0-9_./-])[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+"
_DRAWER = "drawer_[a-z0-9_-]+_[0-9a-f]{24}"
_COMMIT = r"(?i)\b(?:commits?|sha1?|git|rev|revision)\b\W{0,3}([0-9a-f]{7,40})\b"
_SLUG = r"(?i)(?:\bdrawers?|\bmempalace|\bwing/|\bdecisions)[\s:,(]{0,3}`([^`\n]+)`"
_SLASH = r"(?<![\w/.:~-])/([a-z0-9][a-z0-9-]*)(?![\w/-]|\.\w)"


def cited_files(text: Column) -> Column:
    """Relative paths of at least one folder that end in any extension, as whole tokens, out of emphasis and without closing dots."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.+$", ""), r"^_(.+)_$", "$1")
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN_WITH_FOLDER), F.lit(0)), bare), lambda x: x.rlike(r"[A-Za-z0-9_-]\.[A-Za-z][A-Za-z0-9]*$"))


def citations(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, id), each once: drawers by id, issues, commits, paths, drawers by slug (normalised) and slash commands a text names."""
    t = F.col(text)
    found = {
        "drawer": F.regexp_extract_all(t, F.lit(_DRAWER), F.lit(0)),
        "issue": tx.any_id_scan(t),
        "commit": F.regexp_extract_all(t, F.lit(_COMMIT), F.lit(1)),
        "path": cited_files(t),
        "slug": F.transform(F.regexp_extract_all(t, F.lit(_SLUG), F.lit(1)), tx.normalized),
        "command": F.regexp_extract_all(t, F.lit(_SLASH), F.lit(1)),
    }
    each = [F.transform(ids, (lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))(kind)) for kind, ids in found.items()]
    return documents.select(key, F.explode(F.array_distinct(F.concat(*each))).alias("c")).select(key, "c.kind", "c.id")


def claimed_counts(claims: DataFrame, actual: DataFrame) -> DataFrame:
    """(what, claimed, n, holds) of numeric claims (what, claimed) against counts (what, n); a missing count is 0."""
    n = F.coalesce("n", F.lit(0))
    return claims.join(actual, "what", "left").select("what", "claimed", n.alias("n"), (F.col("claimed") == n).alias("holds"))


def related(open_: DataFrame, closed: DataFrame, keys: Column, words: Column, rare: int | None = None) -> DataFrame:
    """(open_id, closed_id, strength): strong if two items share a key, else weak if they share a word.

    open_, closed: (id, text). All pairs come out, however many items hold the word; a caller that
    wants fewer leaves out words of more than `rare` closed items.
    """
    none = F.array().cast("array<string>")

    def held(df: DataFrame, name: str) -> DataFrame:
        x = F.concat(F.transform(F.coalesce(keys, none), lambda k: F.struct(F.lit(True).alias("strong"), k.alias("k"))), F.transform(F.coalesce(words, none), lambda k: F.struct(F.lit(False).alias("strong"), k.alias("k"))))
        return df.select(F.col("id").alias(name), F.explode(x).alias("x")).select(name, "x.strong", "x.k")

    a, b = held(open_, "open_id").distinct(), held(closed, "closed_id")
    if rare is not None:
        common = b.where("not strong").groupBy("strong", "k").agg(F.countDistinct("closed_id").alias("c")).where(F.col("c") > rare)
        b = b.join(common, ["strong", "k"], "left_anti")
    # A pair meets once for each key or word it shares; strong and weak are settled in the one aggregate that makes it distinct.
    met = a.join(b, ["strong", "k"]).where("open_id <> closed_id").groupBy("open_id", "closed_id").agg(F.bool_or("strong").alias("strong"))
    return met.select("open_id", "closed_id", F.when(F.col("strong"), "strong").otherwise("weak").alias("strength"))


def merged_but_open(subjects: DataFrame, issues: DataFrame, ids: Column) -> DataFrame:
    """Open issues (id, status) that a commit subject names."""
    named = subjects.select(F.explode(ids).alias("id")).distinct()
    return issues.where(F.col("status").isin("open", "in_progress")).join(named, "id", "left_semi")


def pull_states(issues: DataFrame, pulls: DataFrame, url: Column) -> DataFrame:
    """(id, url, state): the state of the pull request an issue names, SKIP without one or if it is unknown."""
    named = issues.select("id", url.alias("url"))
    return named.join(pulls.select("url", "state"), "url", "left").select("id", "url", F.coalesce(F.upper("state"), F.lit("SKIP")).alias("state"))


def abandoned(worktrees: DataFrame, live: DataFrame, issues: DataFrame) -> DataFrame:
    """Worktrees (path, pid, issue) whose lock's process is dead or whose issue is closed."""
    alive = live.select(F.col("pid"), F.lit(True).alias("_alive")).distinct()
    status = issues.select(F.col("id").alias("issue"), "status")
    joined = worktrees.join(alive, "pid", "left").join(status, "issue", "left")
    dead = F.col("pid").isNotNull() & F.col("_alive").isNull()
    return joined.where(dead | (F.coalesce("status", F.lit("")) == "closed")).select("path", dead.alias("dead"), (F.coalesce("status", F.lit("")) == "closed").alias("closed"))


def named_set(items: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """Items whose text names a tool of a project: its prefix as a word of its own before `-name`, its hooks or its scripts."""
    p = re.escape(prefix)
    return items.where(F.col(text).rlike(rf"(^|[^a-zA-Z0-9_]){p}-[a-z0-9]+|hooks/|scripts/{p}-"))


def active(documents: DataFrame, tags: DataFrame, marker: str, soundness: str, status: str, tag: str, sound: str = "green", running: str = "active") -> DataFrame:
    """(id, kind): design documents with an open marker or a soundness that is stated and not `sound`; tagged ones of status `running`.

    documents: (id, text); tags: (id, tag). marker is a pattern, soundness and status are patterns with one group.
    """
    value = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    design = documents.where(F.col("text").rlike(marker) | (F.coalesce(value(soundness), F.lit(sound)) != sound)).select("id", F.lit("design").alias("kind"))
    found = documents.join(tags.where(F.col("tag") == tag).select("id"), "id", "left_semi").where(F.lower(value(status)) == running)
    return design.unionByName(found.select("id", F.lit("exploration").alias("kind"))).distinct()


def older_by(newest: DataFrame, stamped: DataFrame, key: str, days: int = 7) -> DataFrame:
    """(key, age_days): keys whose `newest` (key, at) is more than `days` whole days after their stamp (key, at)."""
    s = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = newest.groupBy(key).agg(F.max("at").alias("new"))
    b = stamped.groupBy(key).agg(F.max("at").alias("old"))
    return a.join(b, key).select(key, F.floor((s("new") - s("old")) / 86400).alias("age_days")).where(F.col("age_days") > days)


def first_present(**choices: Column) -> tuple[Column, Column]:
    """(value, its name) of the first choice that is neither null nor ''."""
    value, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, c in reversed(choices.items()):
        there = F.coalesce(c, F.lit("")) != ""
        value, name = F.when(there, c).otherwise(value), F.when(there, F.lit(key)).otherwise(name)
    return value, name
