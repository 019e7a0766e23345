"""Phrase collocations: frequent phrases of 2 to 5 words, mined by pivot partitioning as in MG-FSM, and scored by how their parts go together.

Words are counted first.  Each phrase belongs to its rarest word, its pivot (of a word that stands in it twice, to the first).  So every
occurrence of a word is rewritten to the fragment that holds the phrases it owns: up to four words before it, as long as they are more
frequent, and up to four behind it that are no rarer; rarer words, infrequent ones and the ends of pieces cut it off.  Equal fragments
are summed and routed to their pivot, where phrases that hold the pivot are counted: nowhere else do they occur, so what is
infrequent there goes at once.  A pivot with a large share of all occurrences is dealt over several groups by the fragment's hash, and
a group beyond what a task may hold is mined in parts; the sums of their phrases are added up afterwards.

Mappers know the most frequent ``dictionary`` words, a bounded number.  Words beyond, if any, are rarer than all of those and ordered by
their bytes; the phrases that they own are counted as text, by Spark alone.

Defined cases: null and empty texts have no words; documents of null language count as ``und``; repeated rows count as often as they
stand; keys are never read; an empty table gives no rows; a text of any length is one row of one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small_batches

#: Occurrences that make a phrase frequent, words of a phrase, and phrases reported for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Words that mappers know at most, the bytes of such a word, the share of all occurrences (one in so many) that a group of a pivot
#: holds at most, and the parts in which a language is ranked first.
DICTIONARY, WORD_BYTES, SHARE, SALTS = 200_000, 64, 2000, 64
#: Distinct words that a task holds before it passes them on, fragments that it mines at once, and those of one group that it holds.
HELD, MINED, MOST = 300_000, 200_000, 1_000_000
_CUT = b"\xff"  # no byte of UTF-8
_SEPARATED = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _CUT * 10 + b" ")
_SALT_BITS = 20


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with ``_CUT`` where a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATED).replace(_CUT, b" " + _CUT + b" ").split()


def _by_language(pdf: pd.DataFrame, text: str, lang: str) -> Iterator[tuple[str, list[bytes]]]:
    for name, texts in pdf[text].groupby(pdf[lang].where(pdf[lang].notna(), "und"), sort=False):
        out: list[bytes] = []
        for t in texts:
            out += words(t)
            out.append(_CUT)
        yield name, out


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n) over all texts."""
    small_batches(docs.sparkSession, 50_000)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def told() -> Iterator[pd.DataFrame]:
            for name, counts in held.items():
                counts.pop(_CUT, None)
                if not counts:
                    continue
                yield pd.DataFrame({"lang": name, "word": [w.decode("utf-8", "replace") for w in counts], "n": list(counts.values())})
            held.clear()

        for pdf in it:
            for name, own in _by_language(pdf, text, lang):
                held.setdefault(name, Counter()).update(own)
            if sum(map(len, held.values())) > HELD:
                yield from told()
        yield from told()

    parts = docs.select(F.col(lang).cast("string").alias(lang), text).mapInPandas(batches, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Dictionary:
    """What mappers know: of each language its words, most frequent first, how often each occurs, and the number of its first word
    among those of all languages.  ``whole``: no other word is frequent."""

    languages: list[str]
    words: list[list[str]]
    counts: list[np.ndarray]
    first: np.ndarray
    whole: bool

    def __post_init__(self) -> None:
        self.place = {name: k for k, name in enumerate(self.languages)}
        self.ids = [{w.encode(): i + 1 for i, w in enumerate(own)} for own in self.words]
        every = np.concatenate([np.zeros(1, dtype=np.int64), *self.counts])
        self.salts = every // max(1, int(every.sum()) // SHARE) + 1  # by number


def learn(frequent: DataFrame, dictionary: int = DICTIONARY) -> Dictionary:
    """The most frequent words of (lang, word, n), at most ``dictionary`` of them: those above the least count that keeps to it."""
    step = F.floor(F.log2("n") * 16)  # counts within some 4 % of each other stay together, so there are at most some 700 steps
    sizes = frequent.where(F.octet_length("word") <= WORD_BYTES).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    total, kept = 0, None
    for row in sorted(sizes, reverse=True):
        if total + row["n"] > dictionary:
            break
        total, kept = total + row["n"], row["step"]
    chosen = [] if kept is None else frequent.where((F.octet_length("word") <= WORD_BYTES) & (step >= kept)).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for lang, word, n in chosen:
        by.setdefault(lang, []).append((-n, word))
    names = sorted(by)
    ranked = [sorted(by[name]) for name in names]
    lengths = np.array([0, *map(len, ranked)], dtype=np.int64)
    return Dictionary(names, [[w for _, w in own] for own in ranked], [np.array([-n for n, _ in own], dtype=np.int64) for own in ranked], np.cumsum(lengths)[:-1] if names else lengths, frequent.count() == total)


def windows(ids: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Ids of words in a row (1 the most frequent, 0 a cut) to a row for each: its id and those at its left and right by distance, as far
    as it owns phrases with them."""
    n, side = len(ids), longest - 1
    padded = np.concatenate((np.zeros(side, dtype=np.int64), ids, np.zeros(side, dtype=np.int64)))
    out = np.zeros((n, 1 + 2 * side), dtype=np.int64)
    out[:, 0] = ids
    left = right = np.ones(n, dtype=bool)
    for k in range(1, longest):
        a, b = padded[side - k : side - k + n], padded[side + k : side + k + n]
        left, right = left & (a > 0) & (a < ids), right & (b > 0) & (b <= ids)
        out[:, 2 * k - 1], out[:, 2 * k] = np.where(left, a, 0), np.where(right, b, 0)
    return out[(ids > 0) & ((out[:, 1] > 0) | (out[:, 2] > 0))]


def hashed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), dtype=np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def tally(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their weights."""
    if not len(rows):
        return rows, weights
    h = hashed(rows)
    order = np.argsort(h)
    h, sorted_rows = h[order], rows[order]
    differ = (sorted_rows[1:] != sorted_rows[:-1]).any(axis=1)
    if (differ & (h[1:] == h[:-1])).any():  # two rows share a hash: sort by their values
        order = np.lexsort(rows.T)
        sorted_rows = rows[order]
        differ = (sorted_rows[1:] != sorted_rows[:-1]).any(axis=1)
    starts = np.flatnonzero(np.append(True, differ))
    return sorted_rows[starts], np.add.reduceat(weights[order], starts)


def _packed(ids: np.ndarray) -> list[bytes]:
    """Rows of ids as bytes, three for each; zeros at the end are left out."""
    data = np.ascontiguousarray(np.ascontiguousarray(ids.astype(">u4")).view(np.uint8).reshape(len(ids), -1, 4)[:, :, 1:].reshape(len(ids), -1))
    return data.view(f"S{data.shape[1]}").ravel().tolist()


def _unpacked(packed: list[bytes], columns: int) -> np.ndarray:
    data = np.array(packed, dtype=f"S{3 * columns}").view(np.uint8).reshape(len(packed), columns, 3).astype(np.int64)
    return (data[:, :, 0] << 16) | (data[:, :, 1] << 8) | data[:, :, 2]


def fragments(docs: DataFrame, known: Dictionary, text: str = "text", lang: str = "lang") -> DataFrame:
    """(group, fragment, n): the fragments of all words of the dictionary, summed within a task, with the group of their pivot."""
    small_batches(docs.sparkSession, 50_000)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in it:
            for name, own in _by_language(pdf, text, lang):
                if (k := known.place.get(name)) is None:
                    continue
                ids = known.ids[k]
                rows = windows(np.fromiter((ids.get(w, 0) for w in own), dtype=np.int64, count=len(own)))
                rows, n = tally(rows, np.ones(len(rows), dtype=np.int64))
                number = known.first[k] + rows[:, 0]
                salt = hashed(rows) % known.salts[number].astype(np.uint64)
                yield pd.DataFrame({"group": (number << _SALT_BITS) | salt.astype(np.int64), "fragment": _packed(rows[:, 1:]), "n": n})

    return docs.select(F.col(lang).cast("string").alias(lang), text).mapInPandas(batches, "group long, fragment binary, n long")


def mined(group: np.ndarray, sides: np.ndarray, n: np.ndarray, known: Dictionary, least: int, part: int = -1, longest: int = LONGEST) -> pd.DataFrame:
    """(lang, phrase, n) of groups of fragments, whole but for the group ``part``; a pivot of one whole group shows only phrases that are
    frequent."""
    number = group >> _SALT_BITS
    place = np.searchsorted(known.first, number - 1, side="right") - 1
    own = number - known.first[place]
    rows, weights = [], []
    for a in range(longest):
        for b in range(longest - a):
            if not a + b:
                continue
            fits = np.ones(len(group), dtype=bool)
            if a:
                fits &= sides[:, 2 * a - 2] > 0
            if b:
                fits &= sides[:, 2 * b - 1] > 0
            at = np.flatnonzero(fits)
            phrase = np.zeros((len(at), 1 + longest), dtype=np.int64)
            phrase[:, 0] = group[at]
            for k in range(a):
                phrase[:, 1 + k] = sides[at, 2 * (a - k) - 2]
            phrase[:, 1 + a] = own[at]
            for k in range(1, b + 1):
                phrase[:, 1 + a + k] = sides[at, 2 * k - 1]
            rows.append(phrase)
            weights.append(n[at])
    found, sums = tally(np.concatenate(rows), np.concatenate(weights))
    number = found[:, 0] >> _SALT_BITS
    kept = (sums >= least) | (known.salts[number] > 1) | (found[:, 0] == part)
    found, sums, number = found[kept], sums[kept], number[kept]
    place = np.searchsorted(known.first, number - 1, side="right") - 1
    said = [" ".join([known.words[k][i - 1] for i in ids if i]) for k, ids in zip(place.tolist(), found[:, 1:].tolist(), strict=True)]
    return pd.DataFrame({"lang": np.array([known.languages[k] for k in place.tolist()], dtype=object), "phrase": np.array(said, dtype=object), "n": sums})


def owned(parts: DataFrame, known: Dictionary, least: int = LEAST) -> DataFrame:
    """Fragments, routed to their groups, to (lang, phrase, n)."""
    shared = parts.sparkSession.sparkContext.broadcast(known)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, size, part = shared.value, [], 0, -1

        def told(pdf: pd.DataFrame) -> pd.DataFrame:
            return mined(pdf["group"].to_numpy(np.int64), _unpacked(pdf["fragment"].tolist(), 2 * (LONGEST - 1)), pdf["n"].to_numpy(np.int64), known, least, part)

        limit = MINED
        for pdf in it:
            held.append(pdf)
            size += len(pdf)
            if size < limit:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = pdf["group"].iloc[-1]  # groups stand together: all but this one are whole
            whole = (pdf["group"] != last).to_numpy()
            if whole.any():
                yield told(pdf[whole])
                pdf = pdf[~whole]
            if len(pdf) >= MOST:
                part = last
                yield told(pdf)
                pdf = pdf[:0]
            held, size = [pdf], len(pdf)
            limit = min(MOST, size + MINED)
        if size:
            yield told(pd.concat(held, ignore_index=True))

    return parts.repartition("group").sortWithinPartitions("group").mapInPandas(batches, "lang string, phrase string, n long")


def owned_by_others(docs: DataFrame, known: Dictionary, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n): the phrases whose pivot is not in the dictionary, counted as text."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in it:
            for name, own in _by_language(pdf, text, lang):
                k = known.place.get(name)
                ids, table = (known.ids[k], known.words[k]) if k is not None else ({}, [])
                others = sorted({w for w in own if w not in ids and w != _CUT})
                beyond = {w: len(table) + 1 + i for i, w in enumerate(others)} | {_CUT: 0}
                table = table + [w.decode("utf-8", "replace") for w in others]
                rows = windows(np.fromiter((ids.get(w) or beyond[w] for w in own), dtype=np.int64, count=len(own)))
                rows = rows[rows[:, 0] > len(ids)]
                if not len(rows):
                    continue
                rows, n = tally(rows, np.ones(len(rows), dtype=np.int64))
                sides = rows.tolist()
                left = [[table[i - 1] for i in r[-2::-2] if i] for r in sides]
                right = [[table[i - 1] for i in r[2::2] if i] for r in sides]
                yield pd.DataFrame({"lang": name, "before": [len(x) for x in left], "words": [[*a, table[r[0] - 1], *b] for a, r, b in zip(left, sides, right, strict=True)], "n": n})

    parts = docs.select(F.col(lang).cast("string").alias(lang), text).mapInPandas(batches, "lang string, before int, words array<string>, n long")
    parts = parts.groupBy("lang", "before", "words").agg(F.sum("n").alias("n"))
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.col("before")), lambda a: F.transform(F.filter(F.sequence(F.col("before"), F.size("words") - 1), lambda b: (b > a) & (b - a < LONGEST)), lambda b: F.array_join(F.slice("words", a + 1, b - a + 1), " "))))
    return parts.select("lang", "n", F.explode(cut).alias("phrase")).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, counts: DataFrame, least: int = LEAST, dictionary: int = DICTIONARY, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f): all phrases of 1 to 5 words that occur ``least`` times; ``counts`` is a written table of ``word_counts``."""
    frequent = counts.where(F.col("n") >= least)
    known = learn(frequent, dictionary)
    parts = owned(fragments(docs, known, text, lang), known, least)
    if not known.whole:
        parts = parts.unionByName(owned_by_others(docs, known, text, lang))
    several = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(several)


def _joined(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of several words, by their lowest-scoring cut; ``phrases`` is a written table."""
    several = phrases.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _joined(F.col("w"), 1, F.col("k")).alias("first"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products have up to 38 digits
    both = both.withColumns({"up": exact("a") * F.lit(1000).cast("decimal(4,0)") * exact("n"), "down": exact("l") * exact("r")}).withColumn("score", F.expr("up div down"))
    least = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def whole(rows: DataFrame, percent: int = 100) -> DataFrame:
    """Scored phrases that no longer one holds contiguously in ``percent`` of their occurrences.  Frequencies fall as phrases grow, so it
    is enough to look at phrases of one word more."""
    words = F.split("phrase", " ")
    longer = rows.withColumn("w", words).where(F.size("w") > 2)
    inner = longer.select("lang", "a", F.explode(F.array(_joined(F.col("w"), 1, F.size("w") - 1), _joined(F.col("w"), 2, F.size("w") - 1))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    return rows.join(most, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < percent * F.col("a"))).drop("within")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; languages are ranked in parts first, so no task gets all phrases of one."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, dictionary: int = DICTIONARY, percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases."""
    counts = durable(word_counts(docs, text, lang))
    phrases = durable(frequent_phrases(docs, counts, least, dictionary, text, lang))
    rows = durable(scored(phrases, counts.groupBy("lang").agg(F.sum("n").alias("n"))))
    return ranked(whole(rows, percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
