"""Documents, stamps and readings folded from logs of updates, and a listing in canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import checkpointed

# The keys of a state document. Texts are kept as they come, nullable ones are cleared by '' or 'null', numbers are 0 unless all digits.
TEXTS = ("v", "mode", "activity", "stage")
NULLABLE = ("bead", "dispatch", "stage_spend", "context_pressure")
NUMBERS = ("parallel_candidates", "orphan_pressure")


def merge(updates: DataFrame) -> DataFrame:
    """(doc, a column per key, dispatched, inline, updated) of updates (doc, seq, key, value, at).

    The update of greatest seq wins per key; keys that are not listed change nothing but the time.
    dispatched and inline count the updates of dispatch to `worker` and to `inline:...`. Everything
    is a max or a sum, so a document with a third of all updates is combined before the shuffle.
    """
    at = lambda k: F.max_by("value", F.when(F.col("key") == k, F.col("seq")))
    cleared = lambda c: F.when(~c.isin("", "null"), c)
    number = lambda c: F.coalesce(F.when(c.rlike("^[0-9]+$"), c.cast("bigint")), F.lit(0)).cast("bigint")
    sent = F.col("key") == "dispatch"
    rows = updates.groupBy("doc").agg(
        *[at(k).alias(k) for k in (*TEXTS, *NULLABLE, *NUMBERS)],
        F.count_if(sent & (F.col("value") == "worker")).alias("dispatched"),
        F.count_if(sent & F.col("value").startswith("inline:")).alias("inline"),
        F.max("at").alias("updated"),
    )
    return rows.select(
        "doc", *TEXTS, *[cleared(F.col(k)).alias(k) for k in NULLABLE], *[number(F.col(k)).alias(k) for k in NUMBERS], "dispatched", "inline", "updated"
    )


def field(document: Column, key: str) -> Column:
    """A field of a JSON document as text; null or absent is ''."""
    return F.coalesce(F.get_json_object(document, f"$.{key}"), F.lit(""))


def stamps(present: DataFrame, writes: DataFrame) -> DataFrame:
    """(target, last_synced, last_synced_date, last_checked, last_checked_date) after writes (target, seq, synced, hash, date).

    present: (target, last_synced, last_synced_date, hash, date), one row per target; hash and date are
    the fields of the old form and count where last_synced is missing. Checking never touches what
    was synced; a sync without date takes that of the first write.
    """
    w = writes.groupBy("target").agg(
        F.max_by("hash", "seq").alias("last_checked"), F.max_by("date", "seq").alias("last_checked_date"), F.min_by("date", "seq").alias("first_date"),
        F.max(F.when(F.col("synced"), F.struct("seq", F.col("hash").alias("h"), F.col("date").alias("d")))).alias("s"),
    )
    p = present.select("target", F.nullif("last_synced", F.lit("")).alias("ls"), "last_synced_date", F.nullif("hash", F.lit("")).alias("old"), F.col("date").alias("old_date"))
    both = w.join(p, "target", "left")
    old_hash = F.coalesce("ls", "old")
    old_date = F.coalesce(F.when(F.col("ls").isNotNull(), F.col("last_synced_date")).otherwise(F.col("old_date")), "first_date")
    synced = F.when(F.col("s").isNotNull(), F.col("s.h")).otherwise(old_hash)
    date = F.when(F.col("s").isNotNull(), F.col("s.d")).when(old_hash.isNotNull(), old_date)
    return both.select("target", synced.alias("last_synced"), date.alias("last_synced_date"), "last_checked", "last_checked_date")


def rising(readings: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The readings above 0 and above the one before of their key, which each reading replaces whether it rises or not."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    return readings.withColumn("before", before).where((F.col(value) > 0) & (F.col(value) > F.col("before")))


def canonical_order(lines: DataFrame, memory: Column) -> DataFrame:
    """lines (at, value) + position: rows that are no memory in order of at, then memories in byte order of value.

    The sort is by ranges; a row's number is its place in its range plus the rows of those before.
    """
    group = F.coalesce(memory, F.lit(False)).cast("int")
    rows = lines.withColumn("_g", group).orderBy("_g", F.when(F.col("_g") == 0, F.col("at")), "value", "at")
    rows = checkpointed(rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)))
    # One row a range of the sort.
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.col("_m") - F.shiftleft("_p", 33)
    return rows.join(F.broadcast(before), "_p").select("at", "value", (F.col("before") + inside + 1).alias("position"))
