"""References to records that do not exist, kept up to date batch by batch.

State is two keyed tables. `parents` is the parent index: a row per record id with the earliest
dated filing and the latest known removal. `references` holds every reference seen with its
present status. A batch brings new references, arriving parents and removals; only references
whose key the batch touches, and new ones, are probed again:

* a new reference probes the index;
* an arriving parent resolves (or turns into `late`) the references that wait for it;
* a removal reopens the references that its key had resolved.

The classification depends on the index alone, not on the order of batches, so any cut of the
history into batches ends in the same state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.session import checkpointed

REFERENCE = T.StructType(
    [
        T.StructField("ref_field", T.StringType()),
        T.StructField("row_key", T.StringType()),
        T.StructField("drawer_id", T.StringType()),
        T.StructField("ref_time", T.TimestampNTZType()),
    ]
)
PARENT = T.StructType(
    [
        T.StructField("drawer_id", T.StringType()),
        T.StructField("first_filed", T.TimestampNTZType()),
        T.StructField("last_filed", T.TimestampNTZType()),
        T.StructField("filings", T.LongType()),
        T.StructField("removed_at", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class OrphanState:
    """The keyed state between two batches."""

    parents: DataFrame
    references: DataFrame


def empty_state(spark) -> OrphanState:
    return OrphanState(
        spark.createDataFrame([], PARENT),
        spark.createDataFrame([], T.StructType([*REFERENCE.fields, T.StructField("status", T.StringType())])),
    )


def _fold_parents(*parts: DataFrame) -> DataFrame:
    """One row per id. Everything is a min or max, so a hot id is combined before the shuffle and a batch may come twice."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("drawer_id").agg(
        F.min("first_filed").alias("first_filed"),
        F.max("last_filed").alias("last_filed"),
        F.max("filings").alias("filings"),
        F.max("removed_at").alias("removed_at"),
    )


def arrivals(filings: DataFrame) -> DataFrame:
    """Parent rows of (drawer_id, filed_at); a null filed_at counts as a filing without date."""
    return filings.where("drawer_id is not null").select(
        "drawer_id",
        F.col("filed_at").cast("timestamp_ntz").alias("first_filed"),
        F.col("filed_at").cast("timestamp_ntz").alias("last_filed"),
        F.lit(1).cast("long").alias("filings"),
        F.lit(None).cast("timestamp_ntz").alias("removed_at"),
    )


def removals(log: DataFrame) -> DataFrame:
    """Parent rows of (drawer_id, deleted_at)."""
    return log.where("drawer_id is not null").select(
        "drawer_id",
        F.lit(None).cast("timestamp_ntz").alias("first_filed"),
        F.lit(None).cast("timestamp_ntz").alias("last_filed"),
        F.lit(0).cast("long").alias("filings"),
        F.col("deleted_at").cast("timestamp_ntz").alias("removed_at"),
    )


def _classify(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Status of each reference against the index: resolved, late, removed or absent.

    The index has one row per key, so a key that a third of all references name only makes the
    reference side of the join large, which adaptive execution splits.
    """
    gone = F.col("removed_at").isNotNull() & (F.col("last_filed").isNull() | (F.col("removed_at") > F.col("last_filed")))
    status = (
        F.when(F.coalesce(F.col("filings"), F.lit(0)) == 0, F.when(F.col("removed_at").isNotNull(), "removed").otherwise("absent"))
        .when(gone, "removed")
        .when(F.col("first_filed") > F.col("ref_time"), "late")
        .otherwise("resolved")
    )
    return references.join(parents, "drawer_id", "left").select(*REFERENCE.names, status.alias("status"))


def named(references: DataFrame) -> DataFrame:
    """The references that name something."""
    return references.where("drawer_id is not null and drawer_id <> ''").select(*REFERENCE.names)


def fold_parents(base: DataFrame, filings: DataFrame, deletions: DataFrame) -> DataFrame:
    """The parent index base after a batch."""
    return _fold_parents(base, arrivals(filings), removals(deletions))


def probe(base: DataFrame, keys: DataFrame, fresh: DataFrame, parents: DataFrame) -> DataFrame:
    """The references base after a batch: those of the changed keys (drawer_id) and the fresh ones are looked up in parents."""
    touched = base.join(keys, "drawer_id", "left_semi").select(*REFERENCE.names)
    untouched = base.join(keys, "drawer_id", "left_anti").select(*REFERENCE.names, "status")
    return untouched.unionByName(_classify(touched.unionByName(fresh).distinct(), parents)).distinct()


def advance(state: OrphanState, references: DataFrame, filings: DataFrame, deletions: DataFrame) -> OrphanState:
    """The state after one batch.

    references: (ref_field, row_key, drawer_id, ref_time); rows whose drawer_id is null or ''
    refer to nothing and are left out, repeated rows count once. filings: (drawer_id, filed_at).
    deletions: (drawer_id, deleted_at). Any of them may be empty.
    """
    parents = checkpointed(fold_parents(state.parents, filings, deletions))
    keys = filings.select("drawer_id").unionByName(deletions.select("drawer_id")).distinct()
    return OrphanState(parents, checkpointed(probe(state.references, keys, named(references), parents)))


def states(spark, batches: Iterable[tuple[DataFrame, DataFrame, DataFrame]]) -> Iterator[OrphanState]:
    """The state after each batch of (references, filings, deletions)."""
    state = empty_state(spark)
    for batch in batches:
        state = advance(state, *batch)
        yield state


def replay(spark, batches: Iterable[tuple[DataFrame, DataFrame, DataFrame]]) -> OrphanState:
    """Fold batches of (references, filings, deletions) into one state."""
    last = empty_state(spark)
    for last in states(spark, batches):
        pass
    return last


def orphans(state: OrphanState) -> DataFrame:
    """References that now name no record, or one that was filed only after them."""
    return state.references.where("status <> 'resolved'")


def snapshot_counts(state: OrphanState) -> DataFrame:
    """Counts per reference field, month of the reference and status; month '' without a time."""
    return (
        orphans(state)
        .groupBy("ref_field", F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit("")).alias("month"), "status")
        .agg(F.count("*").alias("n_refs"), F.countDistinct("drawer_id").alias("n_ids"))
    )


def drawer_references(drawers: DataFrame, tags: DataFrame, tunnels: DataFrame) -> DataFrame:
    """The four reference fields of the memory store as reference rows."""

    def rows(df: DataFrame, field: str, key: str, column: str, time: str) -> DataFrame:
        return df.select(
            F.lit(field).alias("ref_field"),
            F.col(key).alias("row_key"),
            F.col(column).alias("drawer_id"),
            F.col(time).cast("timestamp_ntz").alias("ref_time"),
        )

    return (
        rows(tags, "drawer_tags.drawer_id", "tag", "drawer_id", "created_at")
        .unionByName(rows(tunnels, "tunnels.source_drawer_id", "id", "source_drawer_id", "created_at"))
        .unionByName(rows(tunnels, "tunnels.target_drawer_id", "id", "target_drawer_id", "created_at"))
        .unionByName(rows(drawers, "drawers.parent_drawer_id", "id", "parent_drawer_id", "filed_at"))
    )


def store_batches(drawers: DataFrame, tags: DataFrame, tunnels: DataFrame, deletions: DataFrame, periods: int = 4) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """The store's history cut into `periods` equal spans of time, one batch each.

    Rows without a time come with the first span. The drawers table is what is there now, so a
    logged removal of an id that still has a row is outranked by that row and left out.
    """
    references = drawer_references(drawers, tags, tunnels)
    filings = drawers.select(F.col("id").alias("drawer_id"), "filed_at")
    removed = deletions.select("drawer_id", "deleted_at").join(filings.select("drawer_id"), "drawer_id", "left_anti")
    lo, hi = filings.agg(F.min("filed_at"), F.max("filed_at")).first()
    if lo is None or periods < 2:
        cuts = []
    else:
        cuts = [lo + (hi - lo) * i / periods for i in range(1, periods)]
    edges = [None, *cuts, None]

    def span(df: DataFrame, time: str, i: int) -> DataFrame:
        low, high = edges[i], edges[i + 1]
        keep = F.lit(True)
        if low is not None:
            keep = keep & (F.col(time) >= F.lit(low).cast("timestamp_ntz"))
        if high is not None:
            inside = F.col(time) < F.lit(high).cast("timestamp_ntz")
            keep = keep & (F.coalesce(inside, F.lit(i == 0)))
        elif i > 0:
            keep = keep & F.col(time).isNotNull()
        return df.where(keep)

    for i in range(len(edges) - 1):
        yield span(references, "ref_time", i), span(filings, "filed_at", i), span(removed, "deleted_at", i)


def replay_store(drawers: DataFrame, tags: DataFrame, tunnels: DataFrame, deletions: DataFrame, periods: int = 4) -> OrphanState:
    """The state after the whole history of the store."""
    return replay(drawers.sparkSession, store_batches(drawers, tags, tunnels, deletions, periods))


def store_snapshots(drawers: DataFrame, tags: DataFrame, tunnels: DataFrame, deletions: DataFrame, periods: int = 4) -> DataFrame:
    """(period, ref_field, status, n_refs): the open references after each span of time, as they stood then."""
    after = states(drawers.sparkSession, store_batches(drawers, tags, tunnels, deletions, periods))
    counts = [orphans(s).groupBy("ref_field", "status").agg(F.count("*").alias("n_refs")).select(F.lit(i).alias("period"), "ref_field", "status", "n_refs") for i, s in enumerate(after)]
    return reduce(DataFrame.unionByName, counts)
