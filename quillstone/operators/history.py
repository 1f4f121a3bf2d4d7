"""History of changing attributes: runs of equal payload, merged pairwise in a tree of time blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import checkpointed

RUN = "struct<o:string,s:bigint,e:bigint>"


def versions(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One unit interval per (keys, valid_from): the row with the latest created_at, then id.

    Rows without valid_from, or with valid_to at or before it, are no versions. A null created_at
    is older than any. The choice is a max over a struct, combined before the shuffle. Times become
    seconds since 1970-01-01 (UTC); e is null while open.
    """
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return (
        facts.where("valid_from is not null and (valid_to is null or valid_to > valid_from)")
        .groupBy(*keys, "valid_from")
        .agg(F.max(F.struct("created_at", "id", "object", "valid_to")).alias("v"))
        .select(*keys, F.col("v.object").alias("o"), seconds("valid_from").alias("s"), seconds("v.valid_to").alias("e"))
    )


def coalesce_history(unit: DataFrame, keys: list[str], block_seconds: int = 1 << 16) -> DataFrame:
    """(keys, object, start_s, end_s): maximal runs of touching versions with one object.

    unit: (keys, o, s, e), one row per key and start. Time is cut into blocks of block_seconds, 18 hours
    by default, the leaves of the tree. Inside a leaf, which holds few versions and at most one a second,
    a window cuts each version at the next start and joins equal neighbours. Then blocks merge pairwise, level by level, until one is left
    per key: a merge sees only the first and last run of either side, so an entity with a third of
    all versions is never gathered in one task; whatever can no longer change leaves at once.
    end_s is -1 for a run that is open. Null objects equal each other.
    """
    block = F.floor(F.col("s") / F.lit(block_seconds)).cast("long")
    own = unit.withColumn("b", block)
    w = Window.partitionBy(*keys, "b").orderBy("s")
    cut = own.withColumn("nxt", F.lead("s").over(w)).withColumn("e", F.least("e", "nxt"))
    starts = cut.withColumn("pe", F.lag("e").over(w)).withColumn("po", F.lag("o").over(w))
    first = F.row_number().over(w) == 1
    joined = ~first & F.col("po").eqNullSafe(F.col("o")) & F.col("pe").eqNullSafe(F.col("s"))
    runs = (
        starts.withColumn("g", F.sum(F.when(joined, 0).otherwise(1)).over(w))
        .groupBy(*keys, "b", "g")
        .agg(F.first("o").alias("o"), F.min("s").alias("s"), F.max(F.struct(F.col("s").alias("x"), "e"))["e"].alias("e"))
    )
    last = F.max("g").over(Window.partitionBy(*keys, "b"))
    runs = checkpointed(runs.withColumn("n", last))
    final = [runs.where("g > 1 and g < n").select(*keys, "o", "s", "e")]
    run = F.struct("o", "s", "e")
    edge = (
        runs.where("g = 1 or g = n")
        .groupBy(*keys, "b")
        .agg(F.max(F.when(F.col("g") == 1, run)).alias("f"), F.max(F.when(F.col("g") == F.col("n"), run)).alias("l"), F.max("n").alias("n"))
        .withColumn("multi", F.col("n") > 1)
        .select(*keys, "b", "f", "l", "multi")
    )
    lo, hi = edge.agg(F.min("b"), F.max("b")).first()
    if lo is None:
        return runs.select(*keys, F.col("o").alias("object"), F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    edge = edge.withColumn("b", F.col("b") - F.lit(lo))
    for _ in range((hi - lo).bit_length()):
        side = lambda k: F.max(F.when(F.col("b") % 2 == k, F.struct("f", "l", "multi")))
        pair = (
            edge.withColumn("up", F.shiftright("b", 1))
            .groupBy(*keys, "up")
            .agg(side(0).alias("L"), side(1).alias("R"))
            .withColumn("both", F.col("L").isNotNull() & F.col("R").isNotNull())
            .withColumn("le", F.when(F.col("both"), F.least(F.col("L.l.e"), F.col("R.f.s"))).otherwise(F.col("L.l.e")))
            .withColumn("join", F.col("both") & F.col("L.l.o").eqNullSafe(F.col("R.f.o")) & F.col("le").eqNullSafe(F.col("R.f.s")))
            .withColumn("mid", F.struct(F.col("L.l.o").alias("o"), F.col("L.l.s").alias("s"), F.when(F.col("join"), F.col("R.f.e")).otherwise(F.col("le")).alias("e")))
        )
        lm, rm = F.col("L.multi"), F.col("R.multi")
        none = F.lit(None).cast(RUN)
        out = F.array(
            F.when(F.col("both") & lm & (~F.col("join") | rm), F.col("mid")).otherwise(none),
            F.when(F.col("both") & ~F.col("join") & rm, F.col("R.f")).otherwise(none),
        )
        only = F.coalesce("L", "R")
        merged = checkpointed(
            pair.select(
                *keys,
                F.col("up").alias("b"),
                F.when(F.col("both"), F.when(lm, F.col("L.f")).otherwise(F.col("mid"))).otherwise(only["f"]).alias("f"),
                F.when(F.col("both"), F.when(rm, F.col("R.l")).when(F.col("join"), F.col("mid")).otherwise(F.col("R.f"))).otherwise(only["l"]).alias("l"),
                F.when(F.col("both"), lm | rm | ~F.col("join")).otherwise(only["multi"]).alias("multi"),
                F.filter(out, lambda x: x.isNotNull()).alias("out"),
            )
        )
        final.append(merged.select(*keys, F.explode("out").alias("r")).select(*keys, "r.o", "r.s", "r.e"))
        edge = merged.drop("out")
    top = edge.select(*keys, F.explode(F.when(F.col("multi"), F.array("f", "l")).otherwise(F.array("f"))).alias("r"))
    final.append(top.select(*keys, "r.o", "r.s", "r.e"))
    return reduce(DataFrame.unionByName, final).select(
        *keys, F.col("o").alias("object"), F.col("s").alias("start_s"), F.coalesce("e", F.lit(-1)).alias("end_s")
    )


def fact_history(triples: DataFrame, predicates: DataFrame, block_seconds: int = 1 << 16) -> DataFrame:
    """(subject, predicate, object, start_s, end_s) of the single-valued predicates.

    predicates: (predicate, single_valued), one row per predicate; it is broadcast only if Spark
    finds it below its own threshold.
    """
    single = predicates.where("single_valued").select("predicate").distinct()
    facts = triples.select("id", "subject", "predicate", "object", "valid_from", "valid_to", "created_at").join(single, "predicate", "left_semi")
    return coalesce_history(versions(facts, ["subject", "predicate"]), ["subject", "predicate"], block_seconds)


def current_at(history: DataFrame, now_s: int | None = None) -> DataFrame:
    """history with is_current: open, or (with now_s) covering that second."""
    open_ = F.col("end_s") == -1
    if now_s is None:
        return history.withColumn("is_current", open_)
    return history.withColumn("is_current", (F.col("start_s") <= now_s) & (open_ | (F.col("end_s") > now_s)))
