"""History mining: scores, clusters and failure shares of commits and pull requests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that results depend on.
JUNK = r"^wip|wip:|^fixup|^squash!|^typo| typo|^bump|merge main|merge branch|revert|^upgrade|upgrade |^chore|^lint| lint |lint errors|lint fix|de-flake|deflake"
CHURN = r"update .*(deps|dependenc|packages|pkgs)|bump .*(deps|dependenc)"
DECISION_FILES = r"schema|migrat|\.proto$|interface|config"
RATIONALE = r"because|trade-?off|chose|decision|rfc|instead of|rather than"
LABELS, CLOSES = r"breaking|design|rfc", r"closes #|fixes #|resolves #"


def _one(test: Column, worth: int = 1) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), worth).otherwise(0)


def _matches(column: str, pattern: str) -> Column:
    return F.col(column).rlike(f"(?im){pattern}")


def commit_score(subject: str = "subject", body: str = "body", files: str = "files") -> Column:
    """Additive score of a commit; junk subjects are 0 whatever else holds. Lengths are in bytes."""
    low = F.lower(F.col(subject))
    junk = low.rlike(JUNK) | low.rlike(CHURN)
    words = F.size(F.filter(F.split(F.col(subject), r"\s+"), lambda x: x != ""))
    score = _one(F.octet_length(body) >= 40) + _one(words >= 3) + _one(_matches(files, DECISION_FILES), 2) + _one(_matches(body, RATIONALE))
    return F.when(F.coalesce(junk, F.lit(False)), 0).otherwise(score)


def pull_score(title: str = "title", body: str = "body", labels: str = "labels", files: str = "files", reviewed: str = "has_review") -> Column:
    both = F.concat_ws("\n", title, body)
    return (
        _one(F.col(reviewed)) + _one(F.octet_length(body) >= 60) + _one(_matches(labels, LABELS), 2) + _one(_matches(body, CLOSES))
        + _one(_matches(files, DECISION_FILES)) + _one(both.rlike(f"(?im){RATIONALE}|adopt"))
    )


def surviving(units: DataFrame, score: Column, least: int = 2) -> DataFrame:
    return units.withColumn("score", score).where(F.col("score") >= least)


def clusters(units: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """(cluster, n): keys with at least two members."""
    return units.groupBy(key.alias("cluster")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def too_many_failures(processed: Column, failed: Column) -> Column:
    """Over a quarter of at least four failed."""
    return (processed >= 4) & (failed * 100 > processed * 25)


def retried(call: Callable, waits: Sequence[float] = (30, 60, 120, 240), warm_up: float = 8, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after an error: first after warm_up seconds, then after each of waits; the last error is raised."""

    def run(*args):
        for wait in (warm_up, *waits):
            try:
                return call(*args)
            except Exception:  # noqa: BLE001
                sleep(wait)
        return call(*args)

    return run


def salient(units: DataFrame, judge: Callable[[list[str]], list[bool]], text: str = "body", pause: Callable | None = None) -> DataFrame:
    """The units that judge keeps: one call per Arrow batch of texts, tried again by `pause` (retried() by default)."""
    ask = (pause or retried)(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[list(map(bool, ask([t or "" for t in pdf[text]])))]

    return units.mapInPandas(run, units.schema)


@dataclass(frozen=True)
class Mined:
    """drafts (id, title, cluster, source), their triples, clusters of at least two, and the mark for the next run."""

    drafts: DataFrame
    triples: DataFrame
    clusters: DataFrame
    mark: object


def mine(units: DataFrame, score: Column, cluster: Column, judge: Callable[[list[str]], list[bool]], source: str, mark=None, cap: int | None = None, least: int = 2) -> Mined:
    """units (id, subject, body, files) beyond the mark: scored, capped in order of id if asked, judged, drafted and clustered.

    The new mark is the greatest id looked at, whether or not anything came of it.
    """
    fresh = units if mark is None else units.where(F.col("id") > F.lit(mark))
    top = fresh.agg(F.max("id")).first()[0]
    kept = surviving(fresh, score, least)
    if cap is not None:
        kept = kept.orderBy("id").limit(cap)
    kept = salient(kept, judge)
    drafts = kept.select(F.col("id").cast("string").alias("id"), F.col("subject").alias("title"), cluster.alias("cluster"), F.lit(source).alias("source"))
    return Mined(drafts, draft_triples(drafts), clusters(drafts, F.col("cluster"), 2), mark if top is None else top)


def draft_triples(drafts: DataFrame) -> DataFrame:
    """Three facts per draft (id, title, cluster, source)."""
    fact = lambda p, o: F.struct(F.col("id").alias("subject"), F.lit(p).alias("predicate"), F.col(o).cast("string").alias("object"))
    return drafts.select(F.explode(F.array(fact("has_title", "title"), fact("in_cluster", "cluster"), fact("mined_from", "source"))).alias("t")).select("t.*")
