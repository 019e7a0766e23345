"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words, the character n-grams (3 to 5) of its words, and its word pairs, all
hashed to ``BUCKETS`` (pairs of a word with itself to one of them); a softmax over two labels follows.  It is trained by numpy stochastic gradient descent, a document a step, on
at most about ``max_train`` labelled documents, chosen by a hash of the id; that bound is a parameter.  The features of the sample are
made in tasks, and one task, which gets only them, learns; the driver holds what is learned, a number for each bucket.  For scoring, vectors and output layer are multiplied once to one number a bucket.

Defined cases: null and empty texts have the score of the bias alone; null labels teach nothing; repeated rows are scored each, and
teach once; a document with several labels teaches each of them; texts of any length are scored whole; without labelled rows every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fraction, small_batches
from .units import code_points, factorized

BUCKETS, DIMS, EPOCHS, RATE, MAX_TRAIN, SEED = 1 << 17, 8, 8, 4.0, 2400, 4
#: The bucket of all pairs of a word with itself: new words repeat as known ones do.
TWICE = 0
NGRAMS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature of each word, place of the word, hash of each word)."""
    padded = [f"<{w}>" for w in words]
    cps, lengths = code_points(padded)
    cps = cps.astype(np.uint64) + np.uint64(1)
    place = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(cps))  # characters to the end of the word
    hashes = pd.util.hash_array(words, categorize=False).astype(np.uint64)
    buckets, places = [_bucket(hashes)], [np.arange(len(words))]
    with np.errstate(over="ignore"):
        h = cps.copy()
        for n in range(2, max(NGRAMS) + 1):
            h = h[: len(cps) - n + 1] * _MIX + cps[n - 1 :]
            if n in NGRAMS:
                inside = left[: len(h)] >= n
                buckets.append(_bucket(h[inside] + np.uint64(n)))
                places.append(place[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(places), hashes


def _features(texts) -> tuple:
    """(codes, documents, distinct words' buckets, their places, buckets of word pairs, documents of the pairs)."""
    codes, docs, words = factorized([(t or "").split() for t in texts])
    if not len(words):
        none = np.empty(0, dtype=np.int64)
        return codes, docs, none, none, none, none
    buckets, places, hashes = word_features(words)
    same = docs[1:] == docs[:-1]
    with np.errstate(over="ignore"):
        a, b = codes[:-1][same], codes[1:][same]
        pairs = np.where(a == b, TWICE, _bucket(hashes[a] * np.uint64(3) + hashes[b] * _MIX))
    return codes, docs, buckets, places, pairs, docs[1:][same]


@dataclass
class Model:
    by_bucket: np.ndarray  # of the log odds
    bias: float

    def score(self, texts) -> np.ndarray:
        codes, docs, buckets, places, pairs, pair_docs = _features(texts)
        n = len(texts)
        kinds = int(codes.max()) + 1 if len(codes) else 0
        word_sum, word_n = np.bincount(places, weights=self.by_bucket[buckets], minlength=kinds), np.bincount(places, minlength=kinds)
        total = np.bincount(docs, weights=word_sum[codes], minlength=n) + np.bincount(pair_docs, weights=self.by_bucket[pairs], minlength=n)
        count = np.bincount(docs, weights=word_n[codes], minlength=n) + np.bincount(pair_docs, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def bags(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their counts) of each text."""
    out = []
    for text in texts:
        codes, _, buckets, places, pairs, _ = _features([text])
        weights = np.concatenate([np.bincount(codes, minlength=1)[places] if len(places) else places, np.ones(len(pairs), dtype=np.int64)])
        distinct, back = np.unique(np.concatenate([buckets, pairs]), return_inverse=True)
        out.append((distinct.astype(np.int32), np.bincount(back, weights=weights, minlength=len(distinct)).astype(np.float32)))
    return out


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the cross-entropy, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS))
    out, bias = np.zeros((DIMS, 2)), np.zeros(2)
    steps, at = epochs * max(1, len(samples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            now = rate * (1 - at / steps)
            at += 1
            rows, counts = samples[i]
            share = counts / max(1.0, counts.sum())
            mean = share @ vectors[rows]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= now * 0.25 * np.outer(mean, p)
            bias -= now * 0.02 * p
            # a step of the average's size: without the 1 / n of each share, so that long documents teach as much as short ones
            vectors[rows] -= now * (share / max(share.max(), 1e-9))[:, None] * 0.05 * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", may_learn: Column | None = None, max_train: int = MAX_TRAIN, seed: int = SEED) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (F.lit(True) if may_learn is None else may_learn)).distinct()
    n = marked.count()
    chosen = marked.where(fraction(seed, key) < (min(1.0, max_train / n) if n else 0.0))
    # each id at most twice in ``chosen``, so about max_train rows at most; documents of one id may be many, so they are thinned again
    sample = durable(docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).select("text", "y").distinct())
    if (got := sample.count()) > 2 * max_train:
        sample = sample.where(fraction(seed, "text") < max_train / got)

    def task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            own = bags(pdf["text"])
            yield pd.DataFrame({"y": pdf["y"], "buckets": [b.tobytes() for b, _ in own], "counts": [c.tobytes() for _, c in own]})

    # one task learns from the whole sample (no y is null), which max_train bounds; the driver gets a number for each bucket
    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sorted(zip(pdf["buckets"], pdf["y"], pdf["counts"], strict=True), key=lambda r: r[:2])  # whatever order the rows came in
        model = fit([(np.frombuffer(b, dtype=np.int32), np.frombuffer(c, dtype=np.float32)) for b, _, c in got], np.array([y for _, y, _ in got]), seed=seed)
        return pd.DataFrame({"by_bucket": [model.by_bucket.tobytes()], "bias": [model.bias]})

    learned = sample.mapInPandas(task, "y int, buckets binary, counts binary").groupBy(F.col("y").isNull()).applyInPandas(learn, "by_bucket binary, bias double").first()
    return Model(np.frombuffer(learned["by_bucket"], dtype=np.float64), learned["bias"]) if learned else Model(np.zeros(BUCKETS), 0.0)


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of each row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "score": sent.value.score(pdf[text])})

    return docs.select(key, text).mapInPandas(batches, schema)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[sent.value.score(pdf[text]) >= least]

    return docs.mapInPandas(batches, docs.schema)
