"""Near-duplicate records by an inverted index over positional hash bytes, with count filtering.

A record is the set of hashes of its runs of `k` consecutive words. One order of all runs, rare
before frequent, gives every hash its position in the record. If two records are similar to
degree t, they share at least ceil(t*n) runs, so the first n - ceil(t*n) + c positions of both
hold at least c common ones: only these positions are indexed, pairs are tallied over the index,
and pairs that reach the guaranteed minimum c are verified on the words themselves. No list, pair
or record is capped or dropped, and no similar pair is missed.

The frequencies behind the order come from a counting sketch with about two slots a word, up to
128 MB (any order is right; a good one keeps lists short, and beyond some 60 million words slots
begin to be shared, see the README).
Records with the same words are one class from the start and are expanded only in a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import WordHashes, runs, words
from quillstone.operators.links import components
from quillstone.session import checkpointed, staged

RANGES = 64
#: Most ids that are broadcast to pick bodies before a shuffle; more are joined by shuffling.
BROADCAST_IDS = 100_000


def _need(n: int, t: float) -> int:
    return int(np.ceil(t * n - 1e-9))


def _sets(batches: Iterator[pd.DataFrame], k: int, min_words: int) -> Iterator[tuple[str, list[str], np.ndarray]]:
    hashes = WordHashes()
    for pdf in batches:
        for i, text in zip(pdf["id"], pdf["body"]):
            ws = words(text)
            if len(ws) >= max(min_words, k):
                yield i, ws, np.unique(runs(hashes(ws), k))


def frequency_codes(records: DataFrame, k: int, min_words: int, bits: int) -> np.ndarray:
    """2**bits bytes: a monotone code of how often the runs of each slot occur, over all records.

    Each task sums its own records into sparse counts; those are summed per range of slots by
    streaming tasks, and RANGES rows of fixed length reach the driver. 1 means one record at most.
    """
    size = 1 << bits
    part = size // RANGES
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            slots, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(slots, np.arange(RANGES + 1) * part)
            rows = [
                (r, (slots[a:b] - r * part).astype("<u4").tobytes(), n[a:b].astype("<u4").tobytes())
                for r, (a, b) in enumerate(zip(at[:-1], at[1:]))
                if b > a
            ]
            yield pd.DataFrame(rows, columns=["r", "slots", "n"])

        for _, _, s in _sets(batches, k, min_words):
            held.append((s >> shift).astype(np.int64))
            total += len(s)
            if total > 2_000_000:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r, slots, n in zip(pdf["r"], pdf["slots"], pdf["n"]):
                total = sums.setdefault(int(r), np.zeros(part, dtype=np.int64))
                total[np.frombuffer(slots, "<u4")] += np.frombuffer(n, "<u4")
        for r, total in sums.items():
            code = np.where(total < 16, total, np.minimum(255, 16 + 8 * np.log2(np.maximum(total, 16) / 16)))
            yield pd.DataFrame({"r": [r], "codes": [code.astype(np.uint8).tobytes()]})

    sparse = records.mapInPandas(count, "r int, slots binary, n binary")
    dense = sparse.repartition("r").mapInPandas(add, "r int, codes binary")
    codes = np.zeros(size, dtype=np.uint8)
    for r, row in dense.collect():
        codes[r * part : (r + 1) * part] = np.frombuffer(bytes(row), np.uint8)
    return codes


def index_rows(records: DataFrame, codes: np.ndarray, k: int, min_words: int, t: float, matches: int, bits: int) -> DataFrame:
    """(cls, id, n, c, skip, keys): class of equal words, run count, guaranteed minimum, indexed hashes.

    keys[i] has position skip + i in the record's order; what stands before occurs nowhere else.
    """
    shared = records.sparkSession.sparkContext.broadcast(codes)
    shift = np.uint64(64 - bits)
    columns = ["cls", "id", "n", "c", "skip", "keys"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for i, ws, s in _sets(batches, k, min_words):
            n = len(s)
            need = _need(n, t)
            c = min(matches, need)
            freq = shared.value[(s >> shift).astype(np.int64)]
            first = np.lexsort((s, freq))[: n - need + c]
            skip = int((freq[first] <= 1).sum())
            out.append((xxhash.xxh128_digest(" ".join(ws)), i, n, c, skip, s[first[skip:]].view(np.int64)))
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return records.mapInPandas(rows, "cls binary, id string, n int, c int, skip int, keys array<bigint>")


def _verified(pairs: DataFrame, k: int, t: float) -> DataFrame:
    """pairs (a, b, body_a, body_b) whose sets of runs of k words are similar to degree t."""

    def shingles(ws: list[str]) -> set:
        return set(zip(*(ws[i:] for i in range(k))))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, set()
        for pdf in batches:
            keep = []
            for a, ta, tb in zip(pdf["a"], pdf["body_a"], pdf["body_b"]):
                if a != last:
                    last, left = a, shingles(words(ta))
                right = shingles(words(tb))
                both = len(left & right)
                keep.append(both / (len(left) + len(right) - both) if both else 0.0)
            out = pdf[["a", "b"]].assign(similarity=keep)
            yield out[out["similarity"] >= t]

    return pairs.mapInPandas(check, "a string, b string, similarity double")


class NearDuplicates:
    """Classes of equal records, and the similar pairs of their representatives."""

    def __init__(self, members: DataFrame, pairs: DataFrame) -> None:
        #: (rep, id): every record and the least id of its class.
        self.members = members
        #: (a, b, similarity), a < b: similar representatives.
        self.pairs = pairs

    def expanded(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every similar pair of records."""
        m = self.members
        across = (
            self.pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a")
            .join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
            .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        )
        many = m.where("n_members > 1")
        inside = many.select("rep", F.col("id").alias("id_a")).join(many.select("rep", F.col("id").alias("id_b")), "rep").where("id_a < id_b")
        return across.unionByName(inside.select("id_a", "id_b"))

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_links): n_links counts similar classes, group_id the least id of the linked group."""
        links = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = links.groupBy("a").agg(F.count("*").alias("n_links"))
        labels = components(self.pairs.select("a", "b"))
        return (
            self.members.join(degree.withColumnRenamed("a", "rep"), "rep", "left")
            .join(labels.select(F.col("node").alias("rep"), F.col("label")), "rep", "left")
            .select("id", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )


def sketch_bits(records: DataFrame, least: int = 20, most: int = 27) -> int:
    """Bits of the slot number for about two slots a word, by the characters of all bodies; at most 128 MB of codes are sent."""
    chars = records.agg(F.sum(F.length("body"))).first()[0] or 0
    return min(most, max(least, math.ceil(math.log2(max(1, chars / 3)))))


def near_duplicates(records: DataFrame, t: float = 0.8, k: int = 5, min_words: int = 0, matches: int = 5, bits: int | None = None) -> NearDuplicates:
    """Similar records of (id, body): similarity is that of their sets of runs of k words.

    Null bodies and records with fewer than max(min_words, k) words are in no pair; repeated rows
    of an id count once; other columns are ignored. matches, at most 7, is the number of common
    positions that the indexed prefixes guarantee. bits is that of sketch_bits() by default.
    """
    if not 1 <= matches <= 7:
        raise ValueError("matches must be between 1 and 7")
    records = records.select("id", "body").where("id is not null and body is not null")
    bits = sketch_bits(records) if bits is None else bits
    codes = frequency_codes(records, k, min_words, bits)
    rows = index_rows(records, codes, k, min_words, t, matches, bits).withColumn("num", F.monotonically_increasing_id())
    rows = staged(rows, "neardup-index")
    classes = rows.groupBy("cls").agg(F.min("id").alias("rep"), F.min("num").alias("num"))
    members = rows.select("cls", "id").distinct().join(classes.select("cls", "rep"), "cls").select("rep", "id")
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_members"))
    members = members.join(sizes, "rep")
    heads = checkpointed(classes.select("num", "rep"))
    entries = (
        rows.join(heads.select("num"), "num", "left_semi")
        .select("num", "n", "c", "skip", F.posexplode("keys").alias("at", "key"))
        .select("key", "num", F.expr("shiftleft(cast(n as bigint), 32) + (skip + at) * 8 + c").alias("meta"))
    )
    side = lambda x: entries.select(
        "key", F.col("num").alias(x), F.expr("shiftright(meta, 32)").alias(f"n{x}"), F.expr("shiftright(meta & 4294967295, 3)").alias(f"p{x}"), F.expr("meta & 7").alias(f"c{x}")
    )
    # Runs common to both before this position, this one, and at most all after it.
    reach = F.least("pa", "pb") + 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    tally = (
        side("a")
        .join(side("b"), "key")
        .where((F.col("a") < F.col("b")) & (reach * (1 + t) >= (F.col("na") + F.col("nb")) * t - 1e-6))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.min(F.least("ca", "cb")).alias("least"))
        .where("shared >= least")
        .select("a", "b")
    )
    tally = checkpointed(tally)
    named = tally.join(heads.select(F.col("num").alias("a"), F.col("rep").alias("ra")), "a").join(heads.select(F.col("num").alias("b"), F.col("rep").alias("rb")), "b")
    named = checkpointed(named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
    wanted = named.select(F.col("a").alias("id")).unionByName(named.select(F.col("b").alias("id"))).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    bodies = records.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    joined = (
        named.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        .join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        .select("a", "b", "body_a", "body_b")
    )
    return NearDuplicates(members, checkpointed(_verified(joined, k, t)))


def drawer_bodies(drawers: DataFrame) -> DataFrame:
    """(id, body) of logical drawers: title, then text."""
    return drawers.where("parent_drawer_id is null or parent_drawer_id = ''").select(
        "id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("body")
    )
