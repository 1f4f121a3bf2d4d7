"""Abusive, hateful or sexual passages: subword-bag embeddings under a linear softmax, in numpy.

A text is folded (case, accents, invisible characters, digits for letters, stretched, spaced and
masked spellings), cut into passages, and a passage is the bag of its character n-grams inside
words, its words and its pairs of words. Bags share hashed embedding rows, averaged and fed to a
softmax; rows and softmax are trained jointly, so an unseen misspelling still shares n-grams with
what was seen. Labels are given per document, passages carry the abuse: models fitted on one half of
the documents relabel the passages of the other half, hard passages of clean documents join, and the
last fit uses the passages so labelled. For scoring, embedding rows times softmax is one small
table of fixed size; a document's score is that of its worst passage.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("none", "insult", "hate", "sexual")
BASE = np.uint64(0x100000001B3 * 2654435761 % (1 << 63) | 1)

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_ACCENTS = re.compile("[̀-ͯ]+")
_MASKED = re.compile(r"[#*@$%!](?<=[^\W\d].)[#*@$%!]+(?=[^\W\d])", re.S)
_SPACED = re.compile(r"\b\w[ .\-*](?:\w[ .\-*])+\w\b")
_MIXED = re.compile(r"(?<![\w@$])[^\W\d]*+[0134579@$][\w@$]*")
_STRETCHED = re.compile(r"([^\W\d])\1{2,}")
_GAPS = re.compile(r"[ .\-*]")
_PASSAGE = re.compile(r"(?<![.!?])[.!?。！？；]++[\"')*`]*+(?:\s|$)|[。！？；]|\n")
#: Digits and signs that stand for letters.
_LETTERS = str.maketrans("0134579@$", "oieastgas")
MASK = "\x02"


def _respell(m: re.Match) -> str:
    word = m.group()
    return word if word.isdigit() else word.translate(_LETTERS)


def _stretched(text: str) -> bool:
    """Whether some letter (or a sign after it in the code table) stands three times in a row."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return bool(len(c) > 2 and ((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] > 96)).any())


def fold(text: str) -> str:
    """text in the spelling that the model sees; passages stay apart by newlines and sentence ends."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not text.isascii():
            text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower().replace("_", "-")
    text = _MASKED.sub(MASK + MASK, text)
    text = _SPACED.sub(lambda m: _GAPS.sub("", m.group()), text)
    text = _MIXED.sub(_respell, text)
    return _STRETCHED.sub(r"\1", text) if _stretched(text) else text


def passages(text: str | None) -> list[str]:
    """The folded passages of a text; of one or two characters only those with a letter or a masked word."""
    wordy = lambda part: any(c.isalpha() or c == MASK or c > "\uffff" for c in part)
    return [part for part in _PASSAGE.split(fold(text)) if len(part) > 2 or wordy(part)] if text else []


@functools.cache
def _letters() -> np.ndarray:
    """Code points of the basic plane, with a blank for all that are neither letters nor digits."""
    return np.array([c if c == ord(MASK) or chr(c).isalnum() else 32 for c in range(0x10000)], dtype=np.uint64)


def bags(parts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owners): the hashed features of all passages and the passage of each."""
    text = " " + "  ".join(parts) + " "
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cp = np.where(cp < 0x10000, _letters()[np.minimum(cp, 0xFFFF)], cp.astype(np.uint64))
    space = cp == 32
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 2
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
    blank = np.cumsum(space, dtype=np.int32)
    shift = np.uint64(64 - bits)
    slots, owners = [], []
    with np.errstate(over="ignore"):
        acc = cp * BASE + np.uint64(1)
        for n in range(2, 6):
            acc = acc[:-1] * BASE + cp[n - 1 :]
            if n < 3:
                continue
            # Only the ends of an n-gram may be a word's edge.
            ok = np.flatnonzero(blank[n - 2 : len(cp) - 1] == blank[: len(cp) - n + 1])
            h = acc[ok] ^ (acc[ok] >> np.uint64(29))
            slots.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32))
            owners.append(owner[ok])
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        power = np.full(len(cp) + 1, BASE, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(len(cp) + 1, pow(int(BASE), -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        total = np.concatenate([[np.uint64(0)], np.add.accumulate(cp * power[:-1])])
        word = (total[ends] - total[starts]) * inverse[starts]
        word = (word ^ (word >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        slots.append((word >> shift).astype(np.int32))
        owners.append(owner[starts])
        next_to = owner[starts[:-1]] == owner[starts[1:]]
        pair = (word[:-1] * np.uint64(3) + (word[1:] >> np.uint64(7))) * np.uint64(0x94D049BB133111EB)
        slots.append((pair[next_to] >> shift).astype(np.int32))
        owners.append(owner[starts[:-1]][next_to])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass
class Model:
    """Per slot the logit of each category, and their bias and the threshold on a score."""

    table: np.ndarray
    bias: np.ndarray
    bits: int
    threshold: float

    def probabilities(self, parts: list[str]) -> np.ndarray:
        """(passages, categories); a passage without letters is surely clean."""
        out = np.empty((len(parts), len(CATEGORIES)), dtype=np.float64)
        if parts:
            slots, owners = bags(parts, self.bits)
            bag = np.bincount(owners, minlength=len(parts))
            n = np.maximum(bag, 1)
            for c in range(len(CATEGORIES)):
                out[:, c] = np.bincount(owners, weights=self.table[:, c][slots], minlength=len(parts)) / n + self.bias[c]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[bag == 0] = np.eye(len(CATEGORIES))[0]
        return out


def fit(parts: list[str], labels: np.ndarray, weights: np.ndarray, bits: int, dim: int = 16, epochs: int = 6, rate: float = 1.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) after joint SGD on embedding rows and softmax; AdaGrad keeps rare rows quick."""
    rng = np.random.default_rng(seed)
    size, cats = 1 << bits, len(CATEGORIES)
    emb = (rng.random((size, dim), dtype=np.float32) - 0.5) / dim
    soft = (rng.random((dim, cats), dtype=np.float32) - 0.5) / dim
    bias = np.zeros(cats, dtype=np.float32)
    seen = np.full(size, 1e-4, dtype=np.float32)
    seen_soft = np.full(soft.shape, 1e-4, dtype=np.float32)
    slots, owners = bags(parts, bits)
    order = np.argsort(owners, kind="stable")
    slots = slots[order]
    offset = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(parts)))])
    count = np.maximum(np.diff(offset), 1)
    batch = 256
    # Few passages are gone through more often: at least 200 steps.
    epochs = max(epochs, 200 * batch // max(batch, len(parts)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        perm = rng.permutation(len(parts))
        for b0 in range(0, len(perm), batch):
            pick = perm[b0 : b0 + batch]
            pick = pick[np.diff(offset)[pick] > 0]
            if not len(pick):
                continue
            n = count[pick]
            own = np.repeat(np.arange(len(pick)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offset[pick], n)
            s = slots[at]
            rows = emb[s]
            first = np.cumsum(n) - n
            hidden = np.add.reduceat(rows, first, axis=0) / n[:, None]
            z = hidden @ soft + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(pick)), labels[pick]] -= 1
            z *= weights[pick][:, None]
            g_soft = hidden.T @ z / len(pick)
            g_hidden = (z @ soft.T) / n[:, None]
            seen_soft += g_soft**2
            soft -= 0.3 * step * g_soft / np.sqrt(seen_soft)
            bias -= 0.1 * step * z.mean(0)
            sort = np.argsort(s, kind="stable")
            hit, start = np.unique(s[sort], return_index=True)
            g = np.add.reduceat(g_hidden[own[sort]], start, axis=0)
            seen[hit] += (g**2).mean(1)
            emb[hit] -= 0.1 * step * g / np.sqrt(seen[hit])[:, None]
    return (emb @ soft).astype(np.float32), bias.astype(np.float64)


def train(docs: list[tuple[str, str]], bits: int = 17, clean_passages: int = 20_000, threshold: float = 0.5, seed: int = 3) -> Model | None:
    """A model of (text, category) documents; None without both clean and abusive ones.

    clean_passages bounds the passages of clean documents in one fit.
    """
    rng = np.random.default_rng(seed)
    # Passages of one or two characters are scored but not learned from.
    parts = [[x for x in passages(t) if len(x) > 2] for t, _ in docs]
    cat = np.array([CATEGORIES.index(c) for _, c in docs], dtype=int)
    if not (cat > 0).any() or not (cat == 0).any():
        return None
    flat = [p for ps in parts for p in ps]
    doc_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    clean, bad = np.flatnonzero(cat[doc_of] == 0), np.flatnonzero(cat[doc_of] > 0)
    fold = rng.integers(0, 2, len(docs))
    some = rng.permutation(clean)[:clean_passages]
    at, y = np.concatenate([some, bad]), np.concatenate([np.zeros(len(some), int), cat[doc_of[bad]]])
    # All passages of abusive documents weigh a fraction of the clean ones: what both have stays clean.
    weight = np.where(y > 0, min(1.0, 0.2 * len(some) / max(1, len(bad))), 1.0).astype(np.float32)
    for _ in range(2):
        # Documents are judged by a model that has not seen them, so a wrong label teaches nothing.
        out = np.zeros(len(flat))
        for f in (0, 1):
            use = fold[doc_of[at]] != f
            if not (y[use] > 0).any() or not (y[use] == 0).any():
                use = np.ones(len(at), dtype=bool)
            table, bias = fit([flat[i] for i in at[use]], y[use], weight[use], bits, epochs=4)
            own = np.flatnonzero(fold[doc_of] == f)
            out[own] = 1 - Model(table, bias, bits, threshold).probabilities([flat[i] for i in own])[:, 0]
        best = np.zeros(len(docs))
        np.maximum.at(best, doc_of, out)
        score, top = out[bad], best[doc_of[bad]]
        # Of an abusive document, its worst passage and others as clear are abuse; most are not.
        high, low = (score >= 0.6 * top) & (score >= 0.4), score < 0.3
        fair = clean[out[clean] < 0.9]
        hard = fair[np.argsort(-out[fair], kind="stable")[: clean_passages // 2]]
        some = np.unique(np.concatenate([rng.permutation(fair)[: clean_passages // 2], hard]))
        if not high.any():
            break
        at = np.concatenate([some, bad[low], bad[high]])
        y = np.concatenate([np.zeros(len(some) + low.sum(), int), cat[doc_of[bad[high]]]])
        weight = np.ones(len(y), dtype=np.float32)
    table, bias = fit([flat[i] for i in at], y, weight, bits, epochs=5)
    return Model(table, bias, bits, threshold)


def labelled(documents: DataFrame, labels: DataFrame, most: int) -> list[tuple[str, str]]:
    """At most `most` (text, category) of documents whose raters agree by majority, in order of a hash of the id.

    A tie, or no known category, leaves a document out. The ids chosen, at most `most`, are broadcast,
    so the texts are not shuffled.
    """
    votes = labels.where(F.col("category").isin(*CATEGORIES)).select("doc_id", "rater", "category").distinct().groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    top = votes.groupBy("doc_id").agg(F.max(F.struct("n", "category"))["category"].alias("category"), F.max("n").alias("most"), F.sum("n").alias("all"))
    sure = top.where("2 * most > all").select("doc_id", "category").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(sure), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [(r["text"], r["category"]) for r in rows.select("text", "category").collect()]


def scores(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, category, flagged) of every document; null or empty texts score 0.0 and 'none'."""
    schema = "doc_id bigint, score double, category string, flagged boolean"
    docs = documents.select("doc_id", "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit("none").alias("category"), F.lit(False).alias("flagged"))
    shared = documents.sparkSession.sparkContext.broadcast((model.table, model.bias, model.bits, model.threshold))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for pdf in batches:
            for c0 in range(0, len(pdf), 500):
                some = pdf.iloc[c0 : c0 + 500]
                parts = [passages(t) for t in some["text"]]
                n = np.array([len(p) for p in parts])
                p = m.probabilities([x for ps in parts for x in ps])
                score, cat = np.zeros(len(some)), np.zeros(len(some), dtype=int)
                has = np.flatnonzero(n)
                if len(has):
                    first = (np.cumsum(n) - n)[has]
                    bad = 1 - p[:, 0]
                    score[has] = np.maximum.reduceat(bad, first)
                    for d, s, e in zip(has, first, first + n[has]):
                        worst = s + int(np.argmax(bad[s:e]))
                        cat[d] = 1 + int(np.argmax(p[worst, 1:]))
                flagged = score >= m.threshold
                names = np.array(CATEGORIES, dtype=object)[np.where(flagged, cat, 0)]
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "score": score, "category": names, "flagged": flagged})

    return docs.mapInPandas(rate, schema)


def fitted_scores(documents: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """scores() under a model trained on at most `most` labelled documents."""
    return scores(documents, train(labelled(documents, labels, most)))


def rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate) per source, in any spelling of it."""
    from quillstone.llm.mixing import canonical_source

    return (
        documents.select("doc_id", canonical_source("source").alias("source"))
        .join(scored.select("doc_id", "flagged"), "doc_id")
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"))
        .withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
    )
