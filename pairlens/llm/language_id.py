"""Language identification by interpolated Kneser-Ney character models.

A model of order 5 over lower-cased words of letters, each padded at its start and closed by an end mark; a character is 12 bits, a
5-gram is one 60-bit key.  For each order the model keeps a sorted array of keys, with a column of discounted shares per language,
and one of context keys, with the weight that goes to the order below.  The prediction is the language of the least cross-entropy
per character.  A language rejects a text whose cross-entropy lies further above what its calibration documents have, by
length, than nearly all of those do.

Training reads a sample of at most about ``per_language`` documents for each language, chosen by a hash of id and text and bounded by that
parameter, equal texts once; a fifth of it is held back for calibration.  5-grams are counted by Spark; what the driver gathers is bounded by the sample.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and rejected; characters never seen share the
uniform rest; of languages with equal cross-entropy the first in code-point order wins; without training rows every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fraction, small_batches
from .units import code_points, factorized

ORDER, BITS, PER_LANGUAGE, MAX_LANGUAGES, SEED = 5, 12, 600, 1000, 10
START, END = 0, 1
#: Calibration: a text is rejected beyond SLACK times the distance that all but TAIL of the calibration documents keep, and in any
#: case only SURE nats a character above the mean.
TAIL, SLACK, SURE = 0.002, 2.0, 0.6
_WORDS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters (category L).  The pattern also takes numerals that are no decimal digits, as in ½ or ②: rare words with one
    are cut at it."""
    words = _WORDS.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def keys5(pieces) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram key that ends at each character and end mark of each word, characters with the end mark of each word)."""
    cps, lengths = code_points(pieces)
    if not len(lengths):
        return np.empty(0, dtype=np.int64), lengths
    cps = cps.astype(np.int64)
    ids = np.where(cps < 2046, cps + 2, 2048 + cps * 40503 % 2048)  # beyond Greek, Cyrillic, Hebrew and Arabic characters share ids
    ends = np.cumsum(lengths)
    ids = np.insert(ids, ends, END)
    sizes = lengths + 1
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(ids))
    key = np.zeros(len(ids), dtype=np.int64)
    for back in range(ORDER - 1, -1, -1):
        key = (key << BITS) | np.where(at - back >= first, ids[np.maximum(at - back, 0)], START)
    return key, sizes


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # by order from 1: sorted keys
    shares: list[np.ndarray]  # keys x languages
    contexts: list[np.ndarray]
    rests: list[np.ndarray]  # context keys x languages
    uniform: np.ndarray
    mean: np.ndarray | None = None  # calibration, by language: mean nats a character, and allowed distance times sqrt(length)
    reach: np.ndarray | None = None

    def nats(self, keys: np.ndarray) -> np.ndarray:
        """-log p of the last character of each 5-gram, by language."""
        p = np.broadcast_to(self.uniform, (len(keys), len(self.langs)))
        for n in range(1, ORDER + 1):
            own = keys & ((1 << BITS * n) - 1)
            p = _rows(self.grams[n - 1], self.shares[n - 1], own, 0.0) + _rows(self.contexts[n - 1], self.rests[n - 1], own >> BITS, 1.0) * p
        return -np.log(p)

    def documents(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(nats a character of each text and language, characters of each text)."""
        codes, places, words = factorized(map(letter_words, texts))
        total, length = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if len(words):
            keys, sizes = keys5(words)
            distinct, back = np.unique(keys, return_inverse=True)
            by_word = np.add.reduceat(self.nats(distinct)[back], np.cumsum(sizes) - sizes, axis=0)
            length = np.bincount(places, weights=sizes[codes], minlength=len(texts))
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(places, weights=by_word[codes, j], minlength=len(texts))
        return total / np.maximum(length, 1)[:, None], length

    def predict(self, texts) -> pd.DataFrame:
        """lang_pred, score, cross_entropy, rejected."""
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        nats, length = self.documents(texts)
        none = length == 0
        best = nats.argmin(axis=1)
        least = nats[np.arange(len(texts)), best]
        # the posterior, as if at most 60 characters spoke
        odds = np.exp(-(nats - least[:, None]) * np.minimum(length, 60)[:, None])
        above = (least - self.mean[best]) if self.mean is not None else np.zeros(len(texts))
        allowed = np.maximum(SURE, SLACK * self.reach[best] / np.sqrt(np.maximum(length, 1))) if self.reach is not None else np.inf
        far = above > allowed
        score = np.where(none, 0.0, 1 / odds.sum(axis=1)) * np.where(far, 0.5, 1.0)
        return pd.DataFrame({"lang_pred": np.where(none, "und", np.array(self.langs, dtype=object)[best]), "score": score, "cross_entropy": np.where(none, np.nan, least), "rejected": none | far})


def _rows(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(asked), values.shape[1]), other)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where((keys[at] == asked)[:, None], values[at], other)


def fit(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Kneser-Ney from 5-gram counts: raw at order 5; below, the number of different characters seen before the gram."""
    shares: list[list] = [[] for _ in range(ORDER)]
    rests: list[list] = [[] for _ in range(ORDER)]
    uniform = np.zeros(len(langs))
    for j, lang in enumerate(langs):
        keys, n = counts[lang]
        uniform[j] = 1.0 / (1 + len(np.unique(keys & ((1 << BITS) - 1))))
        for order in range(ORDER, 0, -1):
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            contexts, back = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(back, weights=n)
            kinds = np.bincount(back)
            shares[order - 1].append((j, keys, np.maximum(n - d, 0) / total[back]))
            rests[order - 1].append((j, contexts, d * kinds / total))
            keys, n = np.unique(keys & ((1 << BITS * (order - 1)) - 1), return_counts=True)
    grams, values = zip(*(_joined(x, len(langs), 0.0) for x in shares), strict=True)
    contexts, weights = zip(*(_joined(x, len(langs), 1.0) for x in rests), strict=True)
    return Model(langs, list(grams), list(values), list(contexts), list(weights), uniform)


def _joined(columns: list, width: int, other: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for _, k, _ in columns])) if columns else np.empty(0, dtype=np.int64)
    out = np.full((len(keys), width), other)
    for j, k, v in columns:
        out[np.searchsorted(keys, k), j] = v
    return keys, out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", may_learn: Column | None = None, per_language: int = PER_LANGUAGE, seed: int = SEED) -> Model:
    """A model of the languages of the rows that ``may_learn`` admits (all, by default)."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if may_learn is None else may_learn))
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], [], [], [], [], np.zeros(0))
    rate = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, per_language / n))])
    part = fraction(seed, key, text)
    sample = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (part / rate[F.col(lang)]).alias("part")).where("part < 1")
    sample = durable(sample.groupBy("lang", "text").agg(F.min("part").alias("part")))  # a text that repeats teaches once

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, group in pdf.groupby("lang"):
                codes, _, words = factorized(map(letter_words, group["text"]))
                keys, sizes_ = keys5(words)
                weights = np.repeat(np.bincount(codes, minlength=len(words)), sizes_)
                distinct, back = np.unique(keys, return_inverse=True)
                yield pd.DataFrame({"lang": name, "gram": distinct, "n": np.bincount(back, weights=weights, minlength=len(distinct)).astype(np.int64)})

    grams = sample.where("part < 0.8").select("lang", "text").mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: (g["gram"].to_numpy(), g["n"].to_numpy().astype(float)) for name, g in grams.sort_values("gram").groupby("lang")}
    model = fit(sorted(counts), counts)
    sent = spark.sparkContext.broadcast(model)

    def measured(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            nats, length = sent.value.documents(pdf["text"])
            yield pd.DataFrame({"lang": pdf["lang"], "length": length, "nats": [nats[i, sent.value.langs.index(x)] if x in sent.value.langs else np.nan for i, x in enumerate(pdf["lang"])]})

    held = sample.where("part >= 0.8").select("lang", "text").mapInPandas(measured, "lang string, length double, nats double").toPandas()
    held = held[(held["length"] > 0) & held["nats"].notna()]
    overall = held["nats"].mean() if len(held) else 3.0
    model.mean, model.reach = np.full(len(model.langs), overall), np.full(len(model.langs), 10.0)
    for j, name in enumerate(model.langs):
        own = held[held["lang"] == name]
        if len(own) >= 5:
            model.mean[j] = np.average(own["nats"], weights=own["length"])
            model.reach[j] = max(1.0, ((own["nats"] - model.mean[j]) * np.sqrt(own["length"])).quantile(1 - TAIL))
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, cross_entropy, rejected for each row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = sent.value.predict(pdf[text])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return docs.select(key, text).mapInPandas(batches, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, in one pass over whole rows."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[~sent.value.predict(pdf[text])["rejected"].to_numpy(dtype=bool)]

    return docs.mapInPandas(batches, docs.schema)
