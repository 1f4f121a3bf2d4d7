"""Oversized texts cut at topic boundaries found by lexical cohesion.

At every place where a text could be cut, the words of a block before it and of a block after it
are compared; low similarity between high neighbours is a valley, where the topic changes. A piece
ends at the deepest valley inside its size window, among paragraph, line and sentence ends; where
the window has none, at the last word end, and only in a run without blanks at the limit itself.
The next piece starts about `overlap` characters before that end, at the start of a word if one is
near. Sizes are code points; no cut falls inside CR LF or before a combining mark.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'”’)\]]*+(?=\s)(?:\r\n|\s)?|[。！？；]+[”’」』）]*")
_BLANK = re.compile(r"\s+")
#: A word; characters of scripts written without blanks count one by one.
_TERM = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_]+")
#: How much a place is worth besides its valley: paragraph, line, sentence end.
_WORTH = (0.3, 0.15, 0.1)


def _places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a natural cut is possible, ascending, and what each is worth."""
    worth: dict[int, float] = {}
    for pattern, value in zip((_SENTENCE, _LINE, _PARAGRAPH), reversed(_WORTH)):
        for m in pattern.finditer(text):
            worth[m.end()] = max(value, worth.get(m.end(), 0.0))
    at = sorted(p for p in worth if 0 < p < len(text))
    return np.array(at, dtype=np.int64), np.array([worth[p] for p in at])


def valleys(text: str, at: np.ndarray, block: int = 40) -> np.ndarray:
    """Depth of the similarity valley at each place: how far its neighbours rise above it on both sides."""
    terms = [(m.start(), m.group().lower()) for m in _TERM.finditer(text)]
    starts = np.array([s for s, _ in terms], dtype=np.int64)
    mid = np.searchsorted(starts, at)
    sims = np.ones(len(at))
    for k, m in enumerate(mid):
        left = Counter(w for _, w in terms[max(0, m - block) : m])
        right = Counter(w for _, w in terms[m : m + block])
        if left and right:
            dot = sum(n * right[w] for w, n in left.items() if w in right)
            sims[k] = dot / ((sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5)
    # The peak beside a place: as far as similarity does not fall when walking away from it.
    left, right = sims.copy(), sims.copy()
    for k in range(1, len(at)):
        if sims[k - 1] >= sims[k]:
            left[k] = left[k - 1]
    for k in range(len(at) - 2, -1, -1):
        if sims[k + 1] >= sims[k]:
            right[k] = right[k + 1]
    return left + right - 2 * sims


def _whole(text: str, p: int, least: int) -> int:
    """p, or a place shortly before it, that splits no CR LF and no base from its combining mark."""
    x = p
    while x > least and x < len(text) and (text[x - 1 : x + 1] == "\r\n" or unicodedata.combining(text[x]) or text[x] in "‍️"):
        x -= 1
    return x if x > least else p


def split(text: str, limit: int = 800, overlap: int = 80) -> list[tuple[int, int]]:
    """[start, end) of the pieces; one piece if the text is not over the limit, none if it is empty.

    Every piece is at most limit long and starts in the one before; together they cover the text.
    """
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    at, worth = _places(text)
    depth = valleys(text, at) + worth if len(at) else worth
    pieces = []
    start, end = 0, 0
    while True:
        if len(text) - start <= limit:
            pieces.append((start, len(text)))
            return pieces
        lo, hi = max(end + 1, start + limit // 2), start + limit
        a, b = np.searchsorted(at, lo), np.searchsorted(at, hi, "right")
        if a == b:
            a = np.searchsorted(at, max(end + 1, start + overlap + 1))
        if a < b:
            end = int(at[a + int(np.argmax(depth[a:b]))])
        else:
            least = max(end, start + overlap) + 1
            ends = [m.end() for m in _BLANK.finditer(text, least, hi)]
            end = _whole(text, ends[-1] if ends else hi, least)
        pieces.append((start, end))
        # The start of the word nearest to the wanted overlap, which never grows by more than a half.
        want = end - overlap
        near = [m.end() for m in _BLANK.finditer(text, max(start + 1, want - overlap // 2), end) if m.end() < end]
        near = [p for p in near if abs(p - want) <= overlap // 2]
        start = min(near, key=lambda p: (abs(p - want), p)) if near else max(start + 1, _whole(text, want, start + 1))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _logical(drawers: DataFrame, limit: int) -> DataFrame:
    """(id, text) of logical drawers over the limit, one row per id."""
    return drawers.where("id is not null and (parent_drawer_id is null or parent_drawer_id = '') and length(text) > " + str(int(limit))).select("id", "text").dropDuplicates(["id"])


def pieces(drawers: DataFrame, limit: int = 800, overlap: int = 80) -> DataFrame:
    """(drawer_id, parent_drawer_id, chunk_index, text, start, overlap) for logical drawers over the limit."""
    return _split(_logical(drawers, limit).withColumn("chunks", F.lit(None).cast("array<struct<i:int,n:int,h:string>>")), limit, overlap)


def _split(rows: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of the rows (id, text, chunks) whose chunks, if any, do not join to the text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, chunks in zip(pdf["id"], pdf["text"], pdf["chunks"]):
                if chunks is not None and len(chunks):
                    at, same = 0, True
                    for c in chunks:
                        same = same and _digest(text[at : at + c["n"]]) == c["h"]
                        at += c["n"]
                    if same and at == len(text):
                        continue
                last = 0
                for k, (s, e) in enumerate(split(text, limit, overlap)):
                    out.append((f"{i}_chunk_{k:06d}", i, k, text[s:e], s, last - s if k else 0))
                    last = e
            yield pd.DataFrame(out, columns=["drawer_id", "parent_drawer_id", "chunk_index", "text", "start", "overlap"])

    return rows.mapInPandas(cut, "drawer_id string, parent_drawer_id string, chunk_index int, text string, start int, overlap int")


def resplit(drawers: DataFrame, limit: int = 800, overlap: int = 80) -> DataFrame:
    """New pieces for logical drawers over the limit that the stored chunks do not cover.

    Stored chunks cover a drawer if their distinct (chunk_index, text) are exactly the indexes
    0..n-1, one text each, and join in that order to its text. Counts, bounds and total length per
    parent are combined before the shuffle and decide first; only the chunks of parents that pass
    are gathered, without the empty ones, so a gathered group is no longer than its parent's text.
    Texts are compared by length and SHA-256, so the chunks' texts are not moved.
    """
    big = _logical(drawers, limit)
    chunks = (
        drawers.where("parent_drawer_id is not null and parent_drawer_id <> ''")
        .select("parent_drawer_id", F.col("chunk_index").alias("i"), F.coalesce(F.length("text"), F.lit(-1)).alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
        .distinct()
    )
    sizes = chunks.groupBy("parent_drawer_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("i").isNull() | (F.col("n") < 0)).alias("bad"),
        F.min("i").alias("low"), F.max("i").alias("high"), F.sum("i").alias("sum_i"), F.sum("n").alias("total"),
    )
    n = F.col("rows")
    whole = sizes.where((F.col("bad") == 0) & (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("sum_i") * 2 == n * (n - 1)))
    lengths = big.select(F.col("id").alias("parent_drawer_id"), F.length("text").alias("length"))
    likely = whole.join(lengths, "parent_drawer_id").where("total = length").select("parent_drawer_id", "rows")
    kept = (
        chunks.join(likely, "parent_drawer_id")
        .groupBy("parent_drawer_id")
        .agg(F.countDistinct("i").alias("indexes"), F.first("rows").alias("rows"), F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("i", "n", "h")))).alias("chunks"))
        .where("indexes = rows")
        .select(F.col("parent_drawer_id").alias("id"), "chunks")
    )
    return _split(big.join(kept, "id", "left").select("id", "text", "chunks"), limit, overlap)
