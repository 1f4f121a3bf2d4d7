"""A mix of sources with target shares, by Poisson replication seeded with a hash of the document.

Each document has a fixed uniform number from its id; its count is the inverse of a Poisson
distribution at that number, cut at the source's max_repeats. The mean is chosen per source so that
the tokens of the counts reach its share: as the counts depend on the numbers alone, one histogram
of tokens over them, of fixed size, gives the tokens of any mean. Documents are exploded by count
and put in the order of another hash.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import staged

BINS = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def canonical_source(name: str) -> Column:
    """One spelling of a source: trimmed, lower case, underscores for hyphens; null stays null."""
    return F.regexp_replace(F.lower(F.trim(F.col(name))), "-", "_")


def uniform(doc_id: str, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) / F.lit(float(1 << 53))


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """documents (doc_id, source, text) as (doc_id, source, tokens); a null text has none."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    shared = spark.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def poisson_steps(mean: float, most: int) -> list[float]:
    """The numbers u at which the inverse Poisson count reaches 1 .. most."""
    steps, total = [], math.exp(-mean)
    for k in range(1, most + 1):
        steps.append(total)
        # In logarithms, as exp(-mean) is no number for means above 745.
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else 0.0
    return steps


@dataclass
class Plan:
    """Per source the steps of its counts, and the planned size of the whole mix."""

    steps: dict[str, list[float]]
    total: int


def plan(counted: DataFrame, targets: DataFrame, total: int | None, seed: int) -> Plan:
    """counted: (doc_id, source, tokens); total: planned tokens, by default those of all targeted documents.

    The targets are collected: one row per source, a list somebody wrote. So is a histogram of BINS
    numbers per targeted source.
    """
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    bins = F.least(F.floor(uniform("doc_id", seed) * BINS), F.lit(BINS - 1)).cast("int")
    counted = counted.join(F.broadcast(targets.select("source")), "source", "left_semi")
    held: dict[str, np.ndarray] = {s: np.zeros(BINS) for s in wanted}
    for r in counted.groupBy("source", bins.alias("bin")).agg(F.sum("tokens").alias("tokens")).collect():
        held[r["source"]][r["bin"]] = r["tokens"]
    if total is None:
        total = int(sum(h.sum() for h in held.values()))
    steps = {}
    for source, (share, most) in wanted.items():
        # tokens of documents with a number of at least x, linear inside a bin
        above = np.concatenate([np.cumsum(held[source][::-1])[::-1], [0.0]])
        tokens = lambda mean: sum(float(np.interp(x * BINS, np.arange(BINS + 1), above)) for x in poisson_steps(mean, most))  # noqa: E731, B023
        goal = (share or 0.0) * total
        if most is None or most < 1 or goal <= 0:
            steps[source] = []
        elif goal >= most * above[0]:
            steps[source] = [0.0] * most
        else:
            lo, hi = 0.0, 1.0
            while tokens(hi) < goal and hi < 1e4:
                hi *= 2
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if tokens(mid) < goal else (lo, mid)
            steps[source] = poisson_steps(hi, most)
    return Plan(steps, total)


def _counts(spark, made: Plan) -> DataFrame:
    return spark.createDataFrame(list(made.steps.items()), "source string, steps array<double>")


def _copies(seed: int) -> Column:
    return F.size(F.filter("steps", lambda x: uniform("doc_id", seed) >= x))


def canonical_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per source: shares of its spellings add up, the least cap holds."""
    return (
        targets.select(canonical_source("source").alias("source"), "target_share", "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )


def prepare(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, Plan]:
    """(targets, counted documents of targeted sources, plan)."""
    targets = canonical_targets(targets)
    docs = documents.select("doc_id", canonical_source("source").alias("source"), "text").where("doc_id is not null")
    docs = docs.join(F.broadcast(targets.select("source")), "source", "left_semi")
    counted = staged(count_tokens(docs, tokenizer), "token-counts")
    return targets, counted, plan(counted, targets, total, seed)


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy, text) in the order of the mix: copy runs from 1 to the document's count.

    Documents without source, or of a source without target, are not in it. The list of targets is
    the only thing broadcast; the text moves once, to its place in the order.
    """
    _, _, made = prepare(documents, targets, total, seed, tokenizer)
    docs = documents.select("doc_id", canonical_source("source").alias("source"), "text").where("doc_id is not null")
    return (
        docs.join(F.broadcast(_counts(documents.sparkSession, made)), "source")
        .withColumn("n", _copies(seed))
        .where("n > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "text")
        .orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), "doc_id", "copy")
    )


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per target: (source, target_share, max_repeats, n_docs, n_copies, tokens, largest, mix_tokens, share, share_of_mix, reached).

    share is of the planned size, share_of_mix of what the mix holds. reached: within 2 % of the
    target share of the planned size; sources without documents, or too small even at max_repeats,
    are not.
    """
    targets, counted, made = prepare(documents, targets, total, seed, tokenizer)
    used = counted.join(F.broadcast(_counts(documents.sparkSession, made)), "source").withColumn("n", _copies(seed))
    per = used.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_copies"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.sum(F.col("n") * F.col("tokens")).alias("mix_tokens"))
    out = targets.join(per, "source", "left").na.fill(0, ["n_docs", "n_copies", "tokens", "largest", "mix_tokens"])
    whole = out.agg(F.sum("mix_tokens").alias("whole"))
    share = F.col("mix_tokens") / F.lit(float(max(1, made.total)))
    return out.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "n_docs", "n_copies", "tokens", "largest", "mix_tokens",
        share.alias("share"), (F.col("mix_tokens") / F.greatest("whole", F.lit(1))).alias("share_of_mix"),
        (share >= 0.98 * F.col("target_share")).alias("reached"),
    )
