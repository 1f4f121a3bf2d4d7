"""Incremental loads and per-event state on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators import orphans
from quillstone.operators.store import Store
from quillstone.session import checkpointed


def json_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """JSON-lines files of a folder as they arrive; lines that are no object are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("o")).where("o is not null").select("o.*")


def drain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand all that is new to `apply`, batch by batch, and stop; the checkpoint resumes where it ended.

    A batch may be empty, and after a failure the last one comes again, so `apply` must be an upsert
    or keep the batch number.
    """
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def once_per_key(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first event of each key. With a time column, state is dropped once the watermark has passed."""
    if time is None:
        return stream.dropDuplicates(keys)
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def hourly_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(hour, kind, n) of closed hours; times without zone count as UTC."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = stamped.groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("hour"), kind, "n")


class OrphanStream:
    """The orphan ledger fed by batches, its two tables in hashed buckets of a store: a batch rewrites the buckets of its keys.

    All of it is a min, a max or a set, so a batch that comes again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, rows_per_bucket: int = 200_000) -> None:
        self.spark, self.store = spark, Store(spark, root, rows_per_bucket)

    def state(self, number: int | None = None) -> orphans.OrphanState:
        """The ledger after the last batch; number is that of the last batch, if given."""
        empty = orphans.empty_state(self.spark)
        parents, references = self.store.read("parents"), self.store.read("references")
        return orphans.OrphanState(empty.parents if parents is None else parents, empty.references if references is None else references)

    def apply(self, batch: DataFrame, number: int) -> None:
        """batch: (op, ref_field, row_key, drawer_id, at) with op in reference, filing, deletion."""
        at, key = F.col("at").cast("timestamp_ntz"), F.col("drawer_id")
        empty = orphans.empty_state(self.spark)
        batch = checkpointed(batch.select("op", "ref_field", "row_key", "drawer_id", at.alias("at")))
        fresh = orphans.named(batch.where("op = 'reference'").select("ref_field", "row_key", "drawer_id", F.col("at").alias("ref_time")))
        filed = batch.where("op = 'filing' and drawer_id is not null").select("drawer_id", F.col("at").alias("filed_at"))
        gone = batch.where("op = 'deletion' and drawer_id is not null").select("drawer_id", F.col("at").alias("deleted_at"))
        changed = filed.select("drawer_id").unionByName(gone.select("drawer_id")).distinct()
        self.store.change("parents", lambda base: orphans.fold_parents(empty.parents if base is None else base, filed, gone), key, changed)
        keys = changed.unionByName(fresh.select("drawer_id")).distinct()
        parents = self.store.near("parents", key, keys)
        self.store.change("references", lambda base: orphans.probe(empty.references if base is None else base, changed, fresh, parents), key, keys)


def unseen(rows: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not in the table of processed ones."""
    return rows.join(processed.select(*keys), keys, "left_anti")


def after_mark(rows: DataFrame, order: str, mark) -> tuple[DataFrame, object]:
    """(rows beyond a high-water mark, the new mark); the mark stays if there is nothing new."""
    fresh = rows if mark is None else rows.where(F.col(order) > F.lit(mark))
    top = fresh.agg(F.max(order)).first()[0]
    return fresh, mark if top is None else top
