"""Order-dependent choices without one task per group: greedy sets over conflict pairs.

A greedy pass keeps an item unless an earlier kept one conflicts with it. That is fixed by the
conflicts alone: an item is out once an earlier neighbour is kept, and kept once all its earlier
neighbours are out. Rounds decide all items that can be decided at a time; their number is the
longest chain of conflicts, not the number of items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import vector as vx
from quillstone.operators.links import components
from quillstone.session import checkpointed, fresh_folder

BLOCK_ROWS = 2000


def greedy(pairs: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """(id, kept) of all ids in pairs (a, b): a comes before b and conflicts with it.

    always: (id) of items that are kept whatever comes before.
    """
    pairs = checkpointed(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    state = ids.withColumn("kept", F.lit(None).cast("boolean"))
    if always is not None:
        state = state.join(always.select("id", F.lit(True).alias("_k")).distinct(), "id", "left").select("id", F.col("_k").alias("kept"))
    state = checkpointed(state)
    while True:
        earlier = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a").groupBy(F.col("b").alias("id")).agg(
            F.bool_or(F.coalesce("ka", F.lit(False))).alias("blocked"), F.bool_or(F.col("ka").isNull()).alias("open")
        )
        now = F.when(F.coalesce("blocked", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = checkpointed(state.join(earlier, "id", "left").select("id", F.coalesce("kept", now).alias("kept")))
        if state.where("kept is null").isEmpty():
            return state


def waves(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, wave): first-fit groups of items without conflict; pairs (a, b) as in greedy().

    An item's wave is the least number that no earlier neighbour has. A round gives it to all items
    whose earlier neighbours have theirs and passes it on to the later ones, each pair once.
    """
    done = None
    rest = items.select("id").distinct().withColumn("taken", F.array().cast("array<int>"))
    rest, pairs = checkpointed(rest), checkpointed(pairs.select("a", "b").distinct())
    while not rest.isEmpty():
        waiting = pairs.select(F.col("b").alias("id")).distinct()
        free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("taken") + 1), "taken"))
        now = checkpointed(rest.join(waiting, "id", "left_anti").select("id", free.alias("wave")))
        done = now if done is None else done.unionByName(now)
        told = pairs.join(now.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.collect_set("wave").alias("new"))
        left = rest.join(now, "id", "left_anti").join(told, "id", "left")
        rest = checkpointed(left.select("id", F.when(F.col("new").isNull(), F.col("taken")).otherwise(F.array_union("taken", "new")).alias("taken")))
        pairs = checkpointed(pairs.join(now.select(F.col("id").alias("a")), "a", "left_anti"))
    return done if done is not None else items.select("id").withColumn("wave", F.lit(0)).limit(0)


def path_conflicts(items: DataFrame, order: str) -> DataFrame:
    """(a, b): items (id, order, paths) that share a path, the earlier one first; ties of order by id."""
    one = items.select("id", F.col(order).alias("o"), F.explode(F.array_distinct("paths")).alias("p")).distinct()
    a, b = one.alias("a"), one.alias("b")
    first = (F.col("a.o") < F.col("b.o")) | ((F.col("a.o") == F.col("b.o")) & (F.col("a.id") < F.col("b.id")))
    return a.join(b, (F.col("a.p") == F.col("b.p")) & first).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def dep_edges(items: DataFrame, order: str) -> DataFrame:
    """(a, b): items (id, order, deps) of which either depends on the other, the earlier one first as in path_conflicts()."""
    one = items.select("id", F.col(order).alias("o"))
    edges = items.select("id", F.col(order).alias("o"), F.explode(F.array_distinct("deps")).alias("d")).distinct().alias("x")
    met = edges.join(one.alias("y"), (F.col("x.d") == F.col("y.id")) & (F.col("x.id") != F.col("y.id")))
    first = (F.col("x.o") < F.col("y.o")) | ((F.col("x.o") == F.col("y.o")) & (F.col("x.id") < F.col("y.id")))
    return met.select(F.when(first, F.col("x.id")).otherwise(F.col("y.id")).alias("a"), F.when(first, F.col("y.id")).otherwise(F.col("x.id")).alias("b")).distinct()


def incompatible(items: DataFrame, order: str) -> DataFrame:
    """(a, b): items (id, order, paths[, deps]) that share a path or of which one depends on the other."""
    pairs = path_conflicts(items, order)
    return pairs.union(dep_edges(items, order)).distinct() if "deps" in items.columns else pairs


def claims(items: DataFrame, order: str) -> DataFrame:
    """(id, o, p): what each item (id, order, paths[, deps]) claims: its paths, and every dependency between two items as one more.

    Two items conflict if they claim the same; no pair of them is ever written down.
    """
    paths = items.select("id", F.col(order).alias("o"), F.explode(F.array_distinct("paths")).alias("p")).where("p is not null")
    if "deps" not in items.columns:
        return paths.distinct()
    edges = dep_edges(items, order)
    name = F.concat_ws("\x1f", F.lit(""), F.col("a").cast("string"), F.col("b").cast("string"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), name.alias("p")).join(items.select("id", F.col(order).alias("o")), "id").select("id", "o", "p")
    return paths.unionByName(ends).distinct()


def _decide(rows: DataFrame, group: str, waves: bool) -> DataFrame:
    """First-fit waves, or the greedy choice as wave 1 and 0, of each group of claims, in one pass in order over each."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id"], kind="stable")
        ids, paths = pdf["id"].to_numpy(), pdf["p"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        # Per path the waves taken, as the bits of a number.
        taken: dict[str, int] = {}
        out = np.zeros(len(starts), dtype=np.int64)
        for n, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            used = 0
            for p in paths[s:e]:
                used |= taken.get(p, 0)
            if not waves and used:
                continue
            free = ~used & (used + 1)
            for p in paths[s:e]:
                taken[p] = taken.get(p, 0) | free
            out[n] = free.bit_length()
        return pd.DataFrame({"id": ids[starts], "wave": out})

    return rows.groupBy(group).applyInPandas(run, f"id {kind}, wave int")


def _in_rounds(rows: DataFrame, waves: bool) -> DataFrame:
    """As _decide() for a group too large for one task: a round settles every item that is the first unsettled one of all it claims."""
    spark = rows.sparkSession
    decided = fresh_folder(spark, "decided")
    kind = f"id {rows.schema['id'].dataType.simpleString()}, wave int"
    open_ = checkpointed(rows.select("id", "o", "p"))
    used = spark.createDataFrame([], "p string, w int")
    while not open_.isEmpty():
        first = open_.groupBy("p").agg(F.min(F.struct("o", "id")).alias("m"))
        ready = open_.join(first, "p").groupBy("id").agg(F.bool_and(F.col("m.id") == F.col("id")).alias("r")).where("r").select("id")
        mine = open_.join(ready, "id", "left_semi")
        told = mine.join(used, "p", "left").groupBy("id").agg(F.collect_set("w").alias("t"))
        now = checkpointed(told.select("id", F.array_min(F.array_except(F.sequence(F.lit(1), F.size("t") + 1), "t")).alias("wave")))
        fresh = open_.join(now, "id").select("p", F.col("wave").alias("w"))
        if waves:
            used = checkpointed(used.unionByName(fresh))
            done = now
        else:
            lost = open_.join(fresh.select("p").distinct(), "p", "left_semi").select("id").distinct().join(now, "id", "left_anti")
            done = checkpointed(now.unionByName(lost.select("id", F.lit(0).alias("wave"))))
        done.select("id", F.col("wave").cast("int").alias("wave")).write.mode("append").parquet(decided)
        open_ = checkpointed(open_.join(done, "id", "left_anti"))
    there = spark.read.schema(kind)
    return there.parquet(decided) if not rows.isEmpty() else spark.createDataFrame([], kind)


def first_fit(claimed: DataFrame, waves: bool = True, most: int = 4_000_000) -> DataFrame:
    """(id, wave) of the items of claims(): the least wave without an earlier item of the same claim.

    Without waves the greedy choice: 1 if no earlier chosen item claims the same, else 0. Order is o,
    then id. Connected items are decided together, in order, by one task as long as they make at most
    `most` claims; a larger component is decided in rounds over all executors, with the same result.
    """
    claimed = checkpointed(claimed)
    if claimed.limit(most + 1).count() <= most:
        return _decide(claimed.withColumn("g", F.lit(0)), "g", waves)
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    labels = components(claimed.select(node("i", "id").alias("a"), node("p", "p").alias("b")))
    rows = claimed.join(labels.withColumnRenamed("node", "n"), node("i", "id") == F.col("n")).select("id", "o", "p", F.col("label").alias("g"))
    large = checkpointed(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g"))
    small = _decide(rows.join(large, "g", "left_anti"), "g", waves)
    return small.unionByName(_in_rounds(rows.join(large, "g", "left_semi"), waves))


def _close_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, dist): pairs that meet in a block and are within the cosine distance.

    rows: (block, side, id, n, vec): within a block rows of side 0 meet each other (side null) or
    those of side 1. Large blocks are cut into parts by hash and parts meet pairwise, so a task
    holds at most about two parts, and only close pairs leave it.
    """
    sizes = rows.groupBy("block").agg(F.count("*").alias("rows_"))
    cut = rows.join(sizes.where("rows_ > 1"), "block").withColumn("parts", F.ceil(F.col("rows_") / BLOCK_ROWS).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "part").alias("lo"), F.greatest(x, "part").alias("hi")))
    sent = cut.select("block", "side", "id", "n", "vec", "part", F.explode(meets).alias("m")).select("block", "m.lo", "m.hi", "side", "id", "n", "vec", "part")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").reset_index(drop=True)
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(size == 0, 1.0, size)
        part, side, n, ids = pdf["part"].to_numpy(), pdf["side"].to_numpy(), pdf["n"].to_numpy(), pdf["id"].to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left = np.flatnonzero(part == lo)
        i, j = np.nonzero(1.0 - x[left] @ x.T <= threshold + 1e-12)
        i = left[i]
        ok = (i != j) & ((part[j] == hi) | (lo == hi)) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[ok], j[ok]
        first = (n[i] > n[j]) | ((n[i] == n[j]) & (ids[i] < ids[j]))
        a, b = np.where(first, i, j), np.where(first, j, i)
        d = 1.0 - np.einsum("ij,ij->i", x[a], x[b])
        keep = d <= threshold
        return pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]], "dist": d[keep]})

    return sent.groupBy("block", "lo", "hi").applyInPandas(meet, "a string, b string, dist double").groupBy("a", "b").agg(F.min("dist").alias("dist"))


def near_duplicates(drawers: DataFrame, protected: DataFrame | None = None, threshold: float = 0.08, title_similarity: float = 0.8, dim: int = 64) -> DataFrame:
    """(id, canonical_id, wing, room, distance): logical drawers that a longer one makes redundant.

    Within a (wing, room), longest text first (ties by id), a drawer goes if a kept one is within the
    cosine distance and has a title alike in tokens, or the same leading id; its canonical is the
    nearest such. Two titles without tokens are alike. Protected ids stay. Drawers without a usable
    vector, or with a zero one, are near nothing. Rows of one id must agree and count once.
    """
    d = drawers.where(F.col("parent_drawer_id").isNull() & vx.usable("embedding", dim) & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["id"])
    whole = checkpointed(
        d.select(
            "id", "wing", "room", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.col("embedding").alias("vec"),
            F.array_sort(tx.title_tokens("title")).alias("tokens"), tx.leading_id("title").alias("lead"),
        )
        .withColumn("place", F.concat_ws("\x1f", F.coalesce("wing", F.lit("\x00")), F.coalesce("room", F.lit("\x00"))))
        .withColumn("cls", F.concat_ws("\x1f", "place", F.array_join("tokens", " ")))
    )
    # Drawers equal in place, title tokens, leading id and vector have the same neighbours: only the first of them, and those
    # protected, take part in pairs; the others go, as the first is kept or what removed it stands before them too.
    alike_all = ["cls", "lead", "vec"]
    firsts = whole.groupBy(*alike_all).agg(F.min(F.struct((-F.col("n")).alias("m"), "id"))["id"].alias("rep"), F.count("*").alias("size"))
    shared = firsts.where("size > 1").drop("size")
    same = lambda x: (whole["cls"] == x["cls"]) & whole["lead"].eqNullSafe(x["lead"]) & (whole["vec"] == x["vec"])
    members = whole.join(shared, same(shared)).where("id <> rep").select("id", "n", "wing", "room", "rep")
    if protected is not None:
        members = members.join(protected.select("id"), "id", "left_anti")
    members = checkpointed(members)
    d = checkpointed(whole.join(members.select("id"), "id", "left_anti"))
    classes = d.where("size(tokens) > 0").select("place", "cls", "tokens").distinct()
    token = classes.select("place", "cls", F.explode("tokens").alias("t"))
    freq = token.groupBy("place", "t").agg(F.count("*").alias("f"))
    sizes = classes.select("cls", F.size("tokens").alias("k"))
    by_rarity = token.join(freq, ["place", "t"]).groupBy("place", "cls").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ts")).join(sizes, "cls")
    prefix = by_rarity.select("place", "cls", "k", F.explode(F.slice("ts", F.lit(1), F.col("k") - F.ceil(F.col("k") * title_similarity - 1e-9).cast("int") + 1)).alias("x")).select("place", "cls", "k", F.col("x.t").alias("t"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near_size = (F.col("a.k") >= F.col("b.k") * title_similarity) & (F.col("b.k") >= F.col("a.k") * title_similarity)
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.cls") < F.col("b.cls")) & near_size).select(F.col("a.cls").alias("c1"), F.col("b.cls").alias("c2")).distinct()
    words = classes.select("cls", "tokens")
    alike = (
        met.join(words.select(F.col("cls").alias("c1"), F.col("tokens").alias("t1")), "c1")
        .join(words.select(F.col("cls").alias("c2"), F.col("tokens").alias("t2")), "c2")
        .where(tx.jaccard("t1", "t2", 1.0) >= title_similarity)
        .select("c1", "c2", F.concat_ws("\x1e", F.lit("P"), "c1", "c2").alias("block"))
    )
    row = ["id", "n", "vec"]
    own = d.select(F.concat_ws("\x1e", F.lit("T"), "cls").alias("block"), F.lit(2).alias("side"), *row)
    lead = d.where("lead is not null").select(F.concat_ws("\x1e", F.lit("L"), "place", "lead").alias("block"), F.lit(2).alias("side"), *row)
    one = alike.select(F.col("c1").alias("cls"), "block", F.lit(0).alias("side")).unionByName(alike.select(F.col("c2").alias("cls"), "block", F.lit(1).alias("side")))
    cross = d.join(one, "cls").select("block", "side", *row)
    pairs = checkpointed(_close_pairs(own.unionByName(lead).unionByName(cross), threshold))
    state = greedy(pairs, protected)
    kept = state.where("kept").select(F.col("id").alias("a"))
    gone = state.where("not kept").select(F.col("id").alias("b"))
    length = d.select(F.col("id").alias("a"), F.col("n"))
    # Equal vectors are at distances equal up to the last bit.
    nearness = F.min(F.struct(F.round("dist", 12).alias("dist"), -F.col("n"), "a")).alias("m")
    nearest = pairs.join(kept, "a", "left_semi").join(gone, "b", "left_semi").join(length, "a").groupBy("b").agg(nearness)
    nodes = nearest.join(d.select(F.col("id").alias("b"), "wing", "room"), "b").select(F.col("b").alias("id"), F.col("m.a").alias("canonical_id"), "wing", "room", F.col("m.dist").alias("distance"))
    reps = members.select("rep").distinct()
    around = pairs.select(F.col("b").alias("rep"), "a", "dist").unionByName(pairs.select(F.col("a").alias("rep"), F.col("b").alias("a"), "dist")).join(reps, "rep", "left_semi")
    around = around.unionByName(reps.select("rep", F.col("rep").alias("a"), F.lit(0.0).alias("dist")))
    around = around.join(state.select(F.col("id").alias("a"), "kept"), "a", "left").where(F.coalesce("kept", F.lit(True))).join(length, "a")
    own = members.select(F.col("id").alias("b"), F.col("n").alias("nb"), "wing", "room", "rep").join(around, "rep").where((F.col("n") > F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("a") < F.col("b"))))
    return nodes.unionByName(own.groupBy("b", "wing", "room").agg(nearness).select(F.col("b").alias("id"), F.col("m.a").alias("canonical_id"), "wing", "room", F.col("m.dist").alias("distance")))
