"""Evaluation texts in training texts: a BM25 index of the items, searched by block-max WAND.

The items are the indexed collection and passages of the corpus are the queries. An item's score
against a passage grows with every further word of the item in it, so the least score of any `run`
consecutive words of the item is a threshold that no passage with such a run can miss. Impacts are
divided by their item's threshold; all items that reach 1 are retrieved, none is cut off by a top-k.
A passage is a stretch of words in which every window of `run` words could reach 1 by the largest
impact of each word, over all items and then within a block of items: the first tests of block-max
WAND, made for all windows at once. The stretches that pass are searched one by one. Retrieved pairs are verified on the words themselves.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import WordHashes, runs, words

#: Postings in a block of a list, and blocks of items in the first test of all windows.
BLOCK, GROUPS = 32, 32
_QUESTION = re.compile(r"[?？]")


class ItemIndex:
    """Postings of a bounded block of items, with a maximum per list and per block of it, in flat arrays."""

    def __init__(self, items: list[tuple[int, str]], run: int, k1: float = 1.5, b: float = 0.75) -> None:
        self.run = run
        kept = [(i, ws) for i, text in items if len(ws := words(text)) >= run]
        self.ids = [i for i, _ in kept]
        self.texts = ["\n".join(ws) for _, ws in kept]
        question = {i: len(words(_QUESTION.split(text or "", maxsplit=1)[0])) if _QUESTION.search(text or "") else 0 for i, text in items}
        self.question = [question[i] for i in self.ids]
        n = len(kept)
        df = Counter(w for _, ws in kept for w in set(ws))
        mean = sum(len(ws) for _, ws in kept) / max(1, n)
        # Word 0 is any word of no item.
        self.number = {w: k for k, w in enumerate(df, 1)}
        terms, docs, xs = [], [], []
        for at, (_, ws) in enumerate(kept):
            norm = k1 * (1 - b + b * len(ws) / mean)
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
            least = min(sum(impact[w] for w in set(ws[i : i + run])) for i in range(len(ws) - run + 1))
            terms += [self.number[w] for w in impact]
            docs += [at] * len(impact)
            xs += [x / least for x in impact.values()]
        term, doc, x = np.array(terms, dtype=np.int64), np.array(docs, dtype=np.int32), np.array(xs, dtype=np.float64)
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], x[order]
        self.start = np.searchsorted(term[order], np.arange(len(df) + 2))
        self.most = np.zeros(len(df) + 1)
        np.maximum.at(self.most, term, x)
        self.group_most = np.zeros((len(df) + 1, GROUPS), dtype=np.float32)
        np.maximum.at(self.group_most, (term, doc.astype(np.int64) * GROUPS // max(1, n)), x)
        hashes = WordHashes()
        each = [runs(hashes(ws), run) for _, ws in kept]
        length = np.array([len(h) for h in each], dtype=np.int64)
        key = np.concatenate(each) if each else np.empty(0, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        self.gram = key[order]
        self.gram_item = np.repeat(np.arange(n, dtype=np.int32), length)[order]
        self.gram_at = (np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)[order]
        #: Lists of words as they are needed: items, impacts and the maximum of each block.
        self.docs: dict[int, list[int]] = {}
        self.impacts: dict[int, list[float]] = {}
        self.block_most: dict[int, list[float]] = {}

    def _load(self, t: int) -> None:
        x = self.impacts[t] = self.impact[self.start[t] : self.start[t + 1]].tolist()
        self.block_most[t] = [max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
        self.docs[t] = self.doc[self.start[t] : self.start[t + 1]].tolist()

    def above(self, terms: list[int], floor: float = 1 - 1e-9) -> list[int]:
        """Positions of all items whose score against the set of terms reaches floor."""
        docs, impacts, most, blocks = self.docs, self.impacts, self.most, self.block_most
        end = len(self.ids)
        if len(docs) > 200_000:
            docs.clear()
        for t in terms:
            if t and t not in docs:
                self._load(t)
        cursors = [[docs[t][0], 0, t] for t in terms if t]
        found = []
        while cursors:
            cursors.sort()
            upper, pivot = 0.0, -1
            for k, (doc, _, t) in enumerate(cursors):
                upper += most[t]
                if upper >= floor:
                    pivot = k
                    break
            if pivot < 0 or cursors[pivot][0] >= end:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            bound, after = 0.0, end
            for c in cursors[: pivot + 1]:
                at = c[1] if c[0] == target else bisect_left(docs[c[2]], target, c[1])
                block = at // BLOCK
                if block < len(blocks[c[2]]):
                    bound += blocks[c[2]][block]
                    edge = (block + 1) * BLOCK
                    after = min(after, docs[c[2]][edge] if edge < len(docs[c[2]]) else end)
            if bound < floor:
                # No item up to the nearest block edge or the next list's item can reach it.
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                move_to = max(after, target + 1)
            elif cursors[0][0] == target:
                if sum(impacts[t][at] for doc, at, t in cursors[: pivot + 1]) >= floor:
                    found.append(target)
                move_to = target + 1
            else:
                move_to = target
            for c in cursors[: pivot + 1]:
                if c[0] < move_to:
                    c[1] = bisect_left(docs[c[2]], move_to, c[1])
                    c[0] = docs[c[2]][c[1]] if c[1] < len(docs[c[2]]) else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def stretches(self, terms: np.ndarray, longest: int) -> list[tuple[int, int]]:
        """[start, end) of the passages to search; a longer stretch is cut with an overlap of run - 1 words."""
        if len(terms) < self.run:
            return []
        total = np.concatenate([[0.0], np.cumsum(self.most[terms])])
        pass_ = np.flatnonzero(total[self.run :] - total[: -self.run] >= 1 - 1e-6)
        if not len(pass_):
            return []
        by_group = np.concatenate([np.zeros((1, GROUPS)), np.cumsum(self.group_most[terms], axis=0, dtype=np.float64)])
        pass_ = np.flatnonzero((by_group[self.run :] - by_group[: -self.run]).max(axis=1) >= 1 - 1e-5)
        if not len(pass_):
            return []
        breaks = np.flatnonzero(np.diff(pass_) > 1)
        out = []
        for s, e in zip(pass_[np.r_[0, breaks + 1]], pass_[np.r_[breaks, len(pass_) - 1]] + self.run):
            step = longest - self.run + 1
            out += [(x, min(x + longest, e)) for x in range(s, max(s + 1, e - self.run + 1), step)]
        return out

    def leaks(self, ws: list[str], longest: int, hashes: WordHashes) -> dict[int, tuple[int, int]]:
        """{item position: (question words, answer words)} covered by shared runs in the words of a text."""
        number = self.number
        terms = np.array([number.get(w, 0) for w in ws], dtype=np.int64)
        covered: dict[int, set[int]] = {}
        for s, e in self.stretches(terms, longest):
            hits = self.above(sorted(set(terms[s:e].tolist())))
            if not hits:
                continue
            keys = runs(hashes(ws[s:e]), self.run)
            lo, hi = np.searchsorted(self.gram, keys), np.searchsorted(self.gram, keys, side="right")
            for x in np.flatnonzero(hi > lo):
                for g in range(lo[x], hi[x]):
                    at, pos = int(self.gram_item[g]), int(self.gram_at[g])
                    # The hash only says where to look.
                    if at in hits and self.texts[at].split("\n")[pos : pos + self.run] == ws[s + x : s + x + self.run]:
                        covered.setdefault(at, set()).update(range(pos, pos + self.run))
        return {at: (sum(k < self.question[at] for k in held), sum(k >= self.question[at] for k in held)) for at, held in covered.items()}


def leaks(documents: DataFrame, items: DataFrame, run: int = 10, longest: int = 40, items_at_once: int = 50_000) -> DataFrame:
    """(doc_id, item_id, question_words, answer_words): documents sharing a run of words with an item.

    The last two count the item's words, before and after its first question mark, that lie in
    shared runs. Null texts and items shorter than a run leak nothing; repeated rows count once.
    Items are indexed once, on the driver, and the index is broadcast, items_at_once at a time, so a
    larger evaluation set means more passes over the corpus, not a larger broadcast.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, question_words int, answer_words int"
    docs = documents.select("doc_id", "text").where("text is not null")
    items = items.select("item_id", "text").where("text is not null").distinct()
    n = items.count()
    passes = max(1, math.ceil(n / items_at_once))
    parts = []
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        # Part of the corpus side: what is collected is one bounded block of evaluation items.
        shared = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in block.orderBy("item_id", "text").collect()], run))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, hashes = shared.value, WordHashes()
            for pdf in batches:
                rows = []
                for d, text in zip(pdf["doc_id"], pdf["text"]):
                    rows += [(d, index.ids[at], q, a) for at, (q, a) in index.leaks(words(text), longest, hashes).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "question_words", "answer_words"])

        parts.append(docs.mapInPandas(search, schema))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.max("question_words").alias("question_words"), F.max("answer_words").alias("answer_words"))


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_docs, max_words): which items leaked, into how many documents."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max(F.col("question_words") + F.col("answer_words")).alias("max_words"))
