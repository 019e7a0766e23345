"""Runs: stretches of consecutive words that repeat with a period, found in whole texts.

All runs of a text, by its longest-previous-factor array.  Suffixes are sorted by doubling, which leaves a rank for each word and each
power of two; these ranks give the longest common extension of any two places, forwards and backwards, by halving.  Suffix and LCP
array give the longest previous factor of each place, and that the blocks of the LZ factorisation.  A run that touches a boundary
between blocks is found from it: its period is under the length of the two blocks beside the boundary, and the extensions of the
boundary and the place one period on (or back) show where it ends.  A run strictly inside a block is a copy of one that starts earlier,
in the block's previous occurrence: runs are bucketed by start and copied block by block.

A run of ``least`` words or more repeats at least half as many, so texts that repeat fewer in a row have none and go no further.  The
texts of a batch are sorted together, each among its own words only.

Defined cases: null and empty texts and those of white space have no runs and collapse to the empty text; texts without runs collapse
to their words joined by spaces; repeated rows stay rows; null keys stay null; a text of any length is one row of one task, in memory
of some 300 bytes a word; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, settled, small_batches, unused
from .units import factorized, ragged

#: The fewest words of a run.
LEAST = 12


class Ranks:
    """The ranks of all stretches of 1, 2, 4, ... words of texts (codes of words, the text of each) among those of their own text."""

    def __init__(self, codes: np.ndarray, place: np.ndarray, texts: int) -> None:
        n = len(codes)
        counts = np.bincount(place, minlength=texts)
        self.starts = np.cumsum(counts) - counts
        self.start, end = self.starts[place], (self.starts + counts)[place]
        key = place * (int(codes.max(initial=0)) + 1) + codes
        rank, active = self._refined(np.zeros(n, dtype=np.int64), np.arange(n), key)
        self.levels, step = [], 1
        while True:
            self.levels.append(np.append(rank, -1))  # what lies behind the last word is like nothing
            if not len(active):
                break
            after = np.where(active + step < end[active], self.levels[-1][active + step] + 1, 0)
            rank, active = self._refined(rank, active, rank[active] * (n + 1) + after)
            step *= 2

    @staticmethod
    def _refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (the place of the first of each group in suffix order) after the active ones are told apart by ``key``, and those
        still alike."""
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        at, group = np.arange(len(key)), rank[active]
        first = lambda new: np.maximum.accumulate(np.where(new, at, 0))
        changed = lambda x: np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]
        sub = changed(key)
        out = rank.copy()
        out[active] = group + first(sub) - first(changed(group))
        alone = sub & np.append(sub[1:], True)[: len(sub)]
        return out, active[~alone]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same (i != j, of one text)."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[level][i] == self.levels[level][j]).astype(np.int64) << level
            i, j, length = i + step, j + step, length + step
        return length

    def backward(self, i: np.ndarray, j: np.ndarray, start: int) -> np.ndarray:
        """How many words before i and before j are the same (i < j, of the text that begins at ``start``)."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << level), j - (1 << level)
            step = ((a >= start) & (self.levels[level][np.maximum(a, 0)] == self.levels[level][np.maximum(b, 0)])).astype(np.int64) << level
            i, j, length = i - step, j - step, length + step
        return length


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """Suffix order and LCPs with the suffix before (0 for the first) to the longest previous factor of each place, and where it lies.
    Places are taken out from the last one on: the suffixes beside one are then the most like it of those that start earlier."""
    n = len(order)
    rank, factor, source = [0] * n, [0] * n, [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    before, after, lcp = list(range(-1, n)), list(range(1, n + 2)), [*lcp, 0]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q, a = before[r], after[r], lcp[r]
        b = lcp[q]
        if a >= b:
            factor[i], source[i], lcp[q] = a, order[p], b
        else:
            factor[i], source[i], lcp[q] = b, order[q], a
        after[p] = q
        before[q] = p
    return factor, source


def blocks(factor: list[int]) -> list[int]:
    """Where the blocks of the LZ factorisation start, and the end of the text."""
    out = [0]
    while out[-1] < len(factor):
        out.append(out[-1] + (factor[out[-1]] or 1))
    return out


def _touching(ranks: Ranks, start: int, n: int, bounds: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Runs that touch a boundary: start to (end, period), ends ascending; a stretch has its smallest period."""
    sizes = np.append(np.diff(bounds), 0)
    widest = sizes[:-1] + sizes[1:] - 1  # the periods to try at the boundary behind each block
    at, period = np.repeat(bounds[1:], widest), ragged(np.ones(len(widest), dtype=np.int64), widest)
    first, period = np.concatenate((at, at - period)), np.concatenate((period, period))  # one period lies behind the boundary, or before it
    fits = (first >= 0) & (first + period <= n) & (2 * period <= n)
    first, period = first[fits] + start, period[fits]
    word = ranks.levels[0]
    alike = (word[first] == word[first + period]) & (first + period < start + n) | (first > start) & (word[first - 1] == word[first + period - 1])
    first, period = first[alike], period[alike]
    ahead, back = ranks.forward(first, first + period), ranks.backward(first, first + period, start)
    long = ahead + back >= np.maximum(period, least - period)
    begin, end, period = (first - back)[long] - start, (first + period + ahead)[long] - start, period[long]
    out: dict[int, list[tuple[int, int]]] = {}
    seen = None
    for k in np.lexsort((period, end, begin)).tolist():
        b, e = int(begin[k]), int(end[k])
        if (b, e) != seen:
            seen = (b, e)
            out.setdefault(b, []).append((e, int(period[k])))
    return out


def runs(lists: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words: (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    codes, place, _ = factorized(lists)
    if not len(codes):
        return out
    ranks = Ranks(codes, place, len(lists))
    order = np.argsort(ranks.levels[-1][:-1])
    repeats = len(ranks.levels) > (least // 2).bit_length() - 1  # else no text repeats that many words in a row
    same = np.append(False, place[order[1:]] == place[order[:-1]]) if repeats else np.zeros(len(order), dtype=bool)
    lcp = np.zeros(len(order), dtype=np.int64)
    lcp[same] = ranks.forward(order[:-1][same[1:]], order[1:][same[1:]])
    for text in np.unique(place[order[lcp >= -(-least // 2)]]).tolist():
        start, n = int(ranks.starts[text]), len(lists[text])
        factor, source = previous_factors((order[start : start + n] - start).tolist(), lcp[start : start + n].tolist())
        bounds = blocks(factor)
        found = _touching(ranks, start, n, np.array(bounds, dtype=np.int64), least)
        if not found:
            continue
        for b, e in zip(bounds, bounds[1:], strict=False):
            if e - b < least:
                continue
            shift = b - source[b]
            for i in range(b + 1, e):
                if earlier := found.get(i - shift):
                    copied = []
                    for end, period in earlier:
                        if end + shift >= e:
                            break
                        copied.append((end + shift, period))
                    if copied:
                        found[i] = copied + found.get(i, [])
        out[text] = sorted((b, e - b, q) for b, ends in found.items() for e, q in ends)
        out[text].sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period, joined by spaces."""
    if found:
        inside = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in found:
            inside[start + period] += 1
            inside[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "replace")


def find(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs``, an array of (start, length, period) by start, then period, and ``collapsed``; columns of those names are
    replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")
    parts = [unused(docs, f"run_{c}") for c in ("start", "length", "period")]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in parts), T.StructField("collapsed", T.StringType())])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in pdf[text]]  # bytes split at ASCII white space only
            found = runs(lists, least)
            columns = {c: [np.array([r[k] for r in own], dtype=np.int64) for own in found] for k, c in enumerate(parts)}
            yield pdf.assign(**columns, collapsed=[collapsed(w, own) for w, own in zip(lists, found, strict=True)])

    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(parts, ("start", "length", "period"), strict=True)])
    out = docs.mapInPandas(batches, schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], zipped.alias("runs"), "collapsed")


def longest(found: str = "runs") -> Column:
    """The run of the greatest length, ties going to the smallest start, then period; null where there is none."""
    return F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))


def listed(found: str = "runs") -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def stuttered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose texts of one key in ten (by crc32 of the key as text, h % 10 = 0) stutter: with g = h div 10 and n words, word i from
    a = g % n on becomes word a + (i - a) % p, p being 1 + (n - a) div (3 + g % 8).  Rows of null keys stay as they are."""
    h = F.crc32(F.col(key).cast("string"))
    chosen = F.when((h % 10 == 0) & F.col(text).isNotNull(), F.regexp_extract_all(text, F.lit(f"({WORD})")))
    words = unused(docs, "words")
    rows = settled(docs, words, chosen)
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    told = settled(rows, f"{words}_a", F.when(n > 0, F.struct(a.alias("a"), p.alias("p"))))
    at = lambda i: F.when(i < F.col(f"{words}_a.a"), i).otherwise(F.col(f"{words}_a.a") + (i - F.col(f"{words}_a.a")) % F.col(f"{words}_a.p"))
    new = F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(F.col(words), at(i).cast("int"))), " ")
    return told.withColumn(text, F.when(F.col(f"{words}_a").isNotNull(), new).otherwise(F.col(text))).drop(words, f"{words}_a")
