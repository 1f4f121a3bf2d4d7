"""The k most similar vectors of every vector.

Vectors are projected on a few random Gaussian (2-stable) directions and a kd-tree over the
projections, fitted on a bounded sample, cuts the collection into leaves. The search is incremental:
a round has its own directions and its own tree, each vector meets the vectors of its leaf there, and
its k best so far go with it into the next round. Two stopping tests use the k-th distance found so
far, d2, and that two vectors at squared distance d2 are d2 times a chi-square variable apart:

* inside a leaf only pairs whose projected squared distance is at most d2 * quantile(p), of as many
  degrees of freedom as there are directions, are verified in double precision;
* a vector at a distance g from a cut has its neighbour beyond the cut with half the probability that
  a chi-square variable of one degree exceeds g*g / d2. All cuts of a leaf together, and all rounds
  together, give the probability that a nearer vector has been missed so far; once that is at most
  1 - p, the vector searches no more (others still meet it).

No leaf ever meets another one, so a round is linear in the vectors, and the number of rounds grows
with a small power of their number. Every vector is indexed and is a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import staged

STATE = "cls bigint, vec binary, near array<bigint>, cosine array<double>, missed double"


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution, by bisection over its regularised gamma series."""

    def cdf(x: float) -> float:
        a, y = k / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > total * 1e-15:
            term *= y / (a + n)
            total += term
            n += 1
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if y > 0 else 0.0

    lo, hi = 0.0, k + 40 * math.sqrt(k) + 40
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(bytes(r) for r in raw), dtype="<f4").reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete kd-tree as (dimension, cut) in heap order: the widest dimension at its median."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    while len(nodes) + 1 < leaves:
        after = []
        for p in level:
            d = int(np.argmax(p.var(axis=0))) if len(p) > 1 else 0
            cut = float(np.median(p[:, d])) if len(p) else 0.0
            nodes.append((d, cut))
            after += [p[p[:, d] <= cut], p[p[:, d] > cut]]
        level = after
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each point, its distances to the cuts on the way there)."""
    at = np.zeros(len(points), dtype=np.int64)
    depth = (len(nodes) + 1).bit_length() - 1
    gaps = np.empty((len(points), depth), dtype=np.float32)
    if nodes:
        dims = np.array([d for d, _ in nodes])
        cuts = np.array([c for _, c in nodes])
        for level in range(depth):
            off = points[np.arange(len(points)), dims[at]] - cuts[at]
            gaps[:, level] = np.abs(off)
            at = 2 * at + 1 + (off > 0)
    return at - len(nodes), gaps


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) with `dim` numbers, no null, NaN or infinity, not all zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col("id").isNotNull() & e.isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0)).select("id", "embedding")


def classes(rows: DataFrame, dim: int, lead: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, leads, vectors): (cls, id) of every row, (cls, id) of the least ids of each class, (cls, vec).

    Equal vectors are one class, known by a 64-bit hash. Each task keeps a vector once with its
    `lead` least ids, so a vector shared by a third of all rows is sent on once per task.
    """

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[str]] = {}
        vecs: dict[int, bytes] = {}

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"cls": list(best), "id": None, "vec": [vecs[c] for c in best], "leads": list(best.values())})

        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype("<f4") + np.float32(0)
            keys = []
            for i, v in zip(pdf["id"], x):
                raw = v.tobytes()
                c = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                keys.append(c)
                held = best.get(c)
                if held is None:
                    best[c], vecs[c] = [i], raw
                elif i not in held:
                    best[c] = sorted([*held, i])[:lead]
            yield pd.DataFrame({"cls": keys, "id": pdf["id"], "vec": None, "leads": None})
            if len(best) > 100_000:
                yield flush()
                best, vecs = {}, {}
        if best:
            yield flush()

    out = staged(rows.mapInPandas(both, "cls bigint, id string, vec binary, leads array<string>"), "vector-classes")
    heads = out.where("vec is not null")
    return out.where("id is not null").select("cls", "id").distinct(), heads.select("cls", F.explode("leads").alias("id")), heads.select("cls", "vec")


def fold(top: np.ndarray, keys: np.ndarray, rows: np.ndarray, found: np.ndarray, cos: np.ndarray) -> None:
    """Merge (row, key found, cosine) into the best of each row: descending cosines in top, their keys in keys."""
    keep = top.shape[1]
    order = np.lexsort((found, -cos, rows))
    rows, found, cos = rows[order], found[order], cos[order]
    hit, start, n = np.unique(rows, return_index=True, return_counts=True)
    place = np.arange(len(rows)) - np.repeat(start, n)
    few = place < keep
    at = np.repeat(np.arange(len(hit)), n)[few]
    c, k = np.full((len(hit), 2 * keep), -np.inf), np.zeros((len(hit), 2 * keep), dtype=np.int64)
    c[:, :keep], k[:, :keep] = top[hit], keys[hit]
    c[at, keep + place[few]], k[at, keep + place[few]] = cos[few], found[few]
    for again in (True, False):
        order = np.lexsort((k, -c), axis=1)
        c, k = np.take_along_axis(c, order, 1), np.take_along_axis(k, order, 1)
        if again:
            # A pair that met in an earlier round has the same cosine, so it stands beside itself.
            c[:, 1:][(k[:, 1:] == k[:, :-1]) & (c[:, 1:] == c[:, :-1])] = -np.inf
    top[hit], keys[hit] = c[:, :keep], k[:, :keep]


def search_leaf(x: np.ndarray, cls: np.ndarray, top: np.ndarray, keys: np.ndarray, open_: np.ndarray, r: np.ndarray, k: int, least: float, quantile: float) -> None:
    """Verify the pairs of a leaf with an open row that pass the test; top and keys of both rows take what is better.

    x: unit rows. A row's radius is its k-th distance so far, at most that of `least`.
    """
    order = np.argsort(~open_, kind="stable")
    asking = int(open_.sum())
    x, cls = x[order], cls[order]
    t, ks = top[order], keys[order]
    p = x.astype(np.float32) @ r
    size = (p * p).sum(1)
    cut2 = 2 - 2 * (least - 1e-6)
    side = np.concatenate([p, -size[:, None] / 2], 1).T.copy()
    step_i, step_j = 1024, 8192
    for i0 in range(0, asking, step_i):
        i1 = min(i0 + step_i, asking)
        mine = np.concatenate([p[i0:i1], np.ones((i1 - i0, 1), np.float32)], 1)
        for j0 in range(i0, len(x), step_j):
            j1 = min(j0 + step_j, len(x))
            ri = np.minimum(2 - 2 * t[i0:i1, k - 1] + 1e-9, cut2)
            rj = np.minimum(2 - 2 * t[j0:j1, k - 1] + 1e-9, cut2)
            g = mine @ side[:, j0:j1]
            loose = (size[i0:i1] - np.maximum(ri, rj.max()) * quantile) / 2 - 1e-4
            i, j = np.nonzero(g >= loose[:, None].astype(np.float32))
            near = size[i0 + i] - 2 * g[i, j] <= np.maximum(ri[i], rj[j]) * quantile + 1e-3
            i, j = i[near] + i0, j[near] + j0
            i, j = i[i < j], j[i < j]
            cos = np.empty(len(i))
            for c0 in range(0, len(i), 200_000):
                s = slice(c0, c0 + 200_000)
                cos[s] = np.einsum("ij,ij->i", x[i[s]], x[j[s]])
            cos = np.round(cos, 10)
            ok = cos >= least
            i, j, cos = i[ok], j[ok], cos[ok]
            if len(i):
                fold(t, ks, np.r_[i, j], np.r_[cls[j], cls[i]], np.r_[cos, cos])
    top[order], keys[order] = t, ks


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(N(0, 1) > z) for z >= 0, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def search_round(pdf: pd.DataFrame, dim: int, m: int, seed: int, nodes: list[tuple[int, float]], keep: int, k: int, least: float, p: float, leaf_rows: int) -> pd.DataFrame:
    """The rows of one leaf after its round: better neighbours, and the probability of having missed one.

    Rows of one class become one. A leaf that its sample underrates, of more than 2 * leaf_rows, is
    cut further here at its own medians.
    """
    pdf = pdf.drop_duplicates("cls", ignore_index=True)
    x, r = unit_rows(pdf["vec"].tolist(), dim), directions(dim, m, seed)
    cls, n = pdf["cls"].to_numpy(), len(pdf)
    top, keys = np.full((n, keep), -np.inf), np.zeros((n, keep), dtype=np.int64)
    held = pdf["near"].map(len).to_numpy()
    if held.any():
        at, place = np.repeat(np.arange(n), held), np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        top[at, place], keys[at, place] = np.concatenate(pdf["cosine"].to_numpy()), np.concatenate(pdf["near"].to_numpy())
    missed = pdf["missed"].to_numpy().copy()
    open_ = missed > 1 - p
    points = x.astype(np.float32) @ r
    _, gaps = leaf_of(points, nodes)
    inner = fit_tree(points, 1 << math.ceil(math.log2(n / leaf_rows))) if n > 2 * leaf_rows else []
    leaf, more = leaf_of(points, inner)
    gaps = np.concatenate([gaps, more], 1)
    for one in np.unique(leaf):
        own = np.flatnonzero(leaf == one)
        t, ks = top[own], keys[own]
        search_leaf(x[own], cls[own], t, ks, open_[own], r, k, least, chi2_quantile(p, m))
        top[own], keys[own] = t, ks
    reach = np.sqrt(np.maximum(np.minimum(2 - 2 * top[:, k - 1], 2 - 2 * least), 1e-12))
    inside = np.prod(1 - _normal_tail(gaps / reach[:, None]), axis=1)
    missed = np.where(open_, missed * (1 - inside), missed)
    filled = top > -np.inf
    return pd.DataFrame({"cls": cls, "vec": pdf["vec"], "near": [a[f] for a, f in zip(keys, filled)], "cosine": [a[f] for a, f in zip(top, filled)], "missed": missed})


def rounds_for(depth: int, least: float, p: float) -> int:
    """Rounds after which a pair at cosine `least` has shared a leaf with probability p; a median cut parts it with angle / pi."""
    together = (1 - math.acos(least) / math.pi) ** depth
    return 1 if depth == 0 else max(1, round(math.log(1 - p) / math.log(1 - together)))


def nearest(vectors: DataFrame, k: int = 5, least: float = 0.85, dim: int = 64, m: int = 20, p: float = 0.98, leaf_rows: int = 20_000, sample: int = 20_000, most_leaves: int = 1024) -> DataFrame:
    """(id, neighbour, cosine, rank): for each usable vector its k nearest others with cosine >= least.

    vectors: (id, embedding). Rows of one id must agree and count once; cosines are rounded to 10
    decimals and ties go to the smaller id, among at most k + 2 distinct vectors of equal cosine. The
    trees are fitted on at most 2 * `sample` vectors and have at most most_leaves leaves, beyond which
    leaves are cut where they are searched. p is the confidence of both stopping tests. Other columns
    are ignored; null, short, zero or NaN vectors have no neighbours.
    """
    lead, keep = k + 1, k + 2
    members, leads, distinct = classes(usable(vectors, dim), dim, lead)
    total = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, total / leaf_rows))))
    leaves = min(1 << depth, most_leaves)
    rows = distinct.select("cls", "vec", F.array().cast("array<bigint>").alias("near"), F.array().cast("array<double>").alias("cosine"), F.lit(1.0).alias("missed"))
    fit = np.empty((0, dim))
    if leaves > 1:
        part = max(1, math.ceil(total / sample))
        picked = distinct.select("vec").where(F.pmod(F.xxhash64("cls"), F.lit(part)) == 0).limit(2 * sample).collect()
        fit = unit_rows([v[0] for v in picked], dim).astype(np.float32)
    for seed in range(7, 7 + rounds_for(depth, least, p)):
        rows = _round(rows, seed, fit, leaves, dim, m, keep, k, least, p, leaf_rows)
    # The least ids of each class, whatever the number of tasks that met it.
    by_id = Window.partitionBy("cls").orderBy("id")
    names = leads.distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= lead).select(F.col("cls").alias("other"), F.col("id").alias("neighbour"))
    near = rows.select("cls", F.explode(F.arrays_zip("near", "cosine")).alias("n")).select("cls", F.col("n.near").alias("other"), F.col("n.cosine").alias("cosine"))
    # Members of the own class are at cosine 1. A class has at most (keep + 1) * lead candidates.
    own = names.select(F.col("other").alias("cls"), (-F.lit(1.0)).alias("d"), "neighbour")
    found = near.join(names, "other").select("cls", (-F.col("cosine")).alias("d"), "neighbour").unionByName(own)
    best = found.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour"))), 1, lead).alias("best"))
    ranked = members.join(best, "cls").select("id", F.posexplode(F.slice(F.expr("filter(best, x -> x.neighbour <> id)"), 1, k)).alias("at", "n"))
    return ranked.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.d")).alias("cosine"), (F.col("at") + 1).alias("rank")).where(F.col("cosine") >= least)


def _round(rows: DataFrame, seed: int, fit: np.ndarray, leaves: int, dim: int, m: int, keep: int, k: int, least: float, p: float, leaf_rows: int) -> DataFrame:
    """One round over the state: rows go to their leaf's partition and are searched there."""
    nodes = fit_tree(fit @ directions(dim, m, seed), leaves) if leaves > 1 else []

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = directions(dim, m, seed)
        for pdf in batches:
            leaf = leaf_of(unit_rows(pdf["vec"].tolist(), dim).astype(np.float32) @ r, nodes)[0] if len(pdf) else []
            yield pdf.assign(leaf=np.asarray(leaf, dtype=np.int32))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition is a leaf: about leaf_rows vectors of dim numbers.
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            yield search_round(pd.concat(held, ignore_index=True), dim, m, seed, nodes, keep, k, least, p, leaf_rows)

    placed = rows.mapInPandas(place, STATE + ", leaf int") if leaves > 1 else rows.withColumn("leaf", F.lit(0))
    return placed.repartitionById(leaves, F.col("leaf")).drop("leaf").mapInPandas(search, STATE)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair once whichever side found it."""
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
