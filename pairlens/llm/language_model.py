"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A token's class is drawn from a softmax over classes, then the token from a softmax over those of its class.  The log-weights of both
are sums over features of the tokens before: n-grams (the last one, the last two) and a skip (the last but one), each hashed to a row of weights.  The most frequent tokens, ``OUTPUTS`` of them, fill word classes by frequency.  All other words, seen in
training or not, are in classes by their last two characters, where a word's share is its smoothed count.  So the probabilities of all
training words and of one unseen word in each such class add up to one.

Training is distributed: each task takes gradient steps over all of its training documents, and the rows of weights it ends with are
averaged over tasks, each by how often the task met its feature.  Averages are made in a tree, so no task gathers more than ``FAN`` models.
The model has a set size, whatever the corpus; the counts grow with it.

Counts of the most frequent ``DICTIONARY`` words go to all tasks, which is a bounded number; words beyond are joined with their counts.

Defined cases: null and empty texts are one token, the end; a document of null key is scored and told apart by its row; repeated rows stay
rows; with no training texts every class is as likely as the next; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches, unused
from .units import ragged

#: Classes of frequent tokens and tokens of each, classes by last characters, rows of hashed weights for classes and within them.
WORD_CLASSES, IN_CLASS, TAIL_CLASSES, ROWS, INNER_ROWS = 16, 64, 16, 1 << 14, 1 << 14
assert max(ROWS, INNER_ROWS) <= 1 << 16
OUTPUTS, CLASSES = WORD_CLASSES * IN_CLASS, WORD_CLASSES + TAIL_CLASSES
#: Words whose counts all tasks know, bytes of such a word, words a task counts before it passes them on, models that one task adds up.
DICTIONARY, WORD_BYTES, HELD, FAN = 200_000, 64, 300_000, 64
#: Tasks that train at once, or two for each core if that is more: few, as each sends a model.
WORKERS = 12
#: Tokens of a gradient step, its size, and how many tokens of one feature are added one by one.
STEP, RATE, FEW = 8192, 0.15, 6
_UNKNOWN = 1 << 16  # codes of words outside the dictionary, by their hash
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, without the ends."""
    small_batches(docs.sparkSession)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def told() -> Iterator[pd.DataFrame]:
            if held:
                yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in held], "n": list(held.values())})
            held.clear()

        for pdf in it:
            for t in pdf[text]:
                held.update(words(t))
                if len(held) > HELD:
                    yield from told()
        yield from told()

    return docs.select(text).mapInPandas(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % TAIL_CLASSES


def _tail_class(word: str) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % TAIL_CLASSES).cast("int")


@dataclass
class Vocabulary:
    """Counts over the training tokens.  Codes: 0 the end, then the dictionary's words by frequency, those beyond by hash."""

    dictionary: list[str]
    counts: np.ndarray  # by code
    train_tokens: int
    distinct: int
    tail_tokens: np.ndarray  # of each class by last characters: tokens and distinct words
    tail_words: np.ndarray
    code: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.code = {w.encode(): i + 1 for i, w in enumerate(self.dictionary)}
        n = len(self.dictionary) + 1
        self.classes = np.array([min(i, OUTPUTS) // IN_CLASS if i < OUTPUTS else WORD_CLASSES + tail_class(self.dictionary[i - 1]) for i in range(n)], dtype=np.int64)
        self.log_counts = np.log10(self.counts + 0.5)
        self.log_total = np.log10(self.train_tokens + 0.5 * (self.distinct + 1))
        self.tail_log_totals = np.log10(self.tail_tokens + 0.5 * (self.tail_words + 1))

    def coded(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
        """(codes of all tokens, where each text starts, the words of each text outside the dictionary, classes)."""
        get, beyond = self.code.get, len(self.dictionary) + 1
        codes, others, tails = [], [], []
        for own in texts:
            found, unknown = [get(w, -1) for w in own], []
            if -1 in found:
                for i, c in enumerate(found):
                    if c < 0:
                        word = own[i].decode("utf-8", "replace")
                        found[i] = beyond + zlib.crc32(own[i]) % _UNKNOWN
                        unknown.append(word)
                        tails.append(WORD_CLASSES + tail_class(word))
            codes += found
            codes.append(0)
            others.append(unknown)
        out = np.array(codes, dtype=np.int64)
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        known = out < beyond
        classes = self.classes[np.where(known, out, 0)]
        classes[~known] = tails
        return out, np.cumsum(lengths) - lengths, others, classes


def vocabulary(counts: DataFrame, texts: int, dictionary: int = DICTIONARY) -> Vocabulary:
    """``counts``: a written table of ``token_counts`` over so many training texts.  The dictionary has the words above the least count
    that keeps it to its size."""
    step = F.floor(F.log2("n") * 16)
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    total, kept = 0, None
    for row in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some 700 at most
        if total + row["n"] > dictionary:
            break
        total, kept = total + row["n"], row["step"]
    chosen = [] if kept is None else sorted((-n, w) for w, n in short.where(step >= kept).collect())
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    outputs = counts.sparkSession.createDataFrame([(w,) for _, w in chosen[: OUTPUTS - 1]], "word string")
    tails = counts.join(F.broadcast(outputs), "word", "left_anti").groupBy(_tail_class("word").alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tail_tokens, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in tails:
        tail_tokens[r["tail"]], tail_words[r["tail"]] = r["n"], r["words"]
    return Vocabulary([w for _, w in chosen], np.array([texts, *(-n for n, _ in chosen)], dtype=np.float64), int(sums[0]) + texts, int(sums[1]) + (texts > 0), tail_tokens, tail_words)


def _row(rows: int, kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind, dtype=np.uint64) * _ODD[2]
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * _ODD[0]
        h ^= h >> np.uint64(31)
    return ((h * _ODD[1]) >> np.uint64(40)).astype(np.int64) & (rows - 1)


def contexts(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The codes one and two tokens before each; -1 before a text begins."""
    into = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    return [np.where(into >= k, np.concatenate((np.full(k, -1), codes[: len(codes) - k]))[: len(codes)], -1) for k in (1, 2)]


def class_rows(before: list[np.ndarray]) -> np.ndarray:
    """The rows of class weights of each token's features: its bigram, trigram and skip."""
    one, two = before
    return np.stack([_row(ROWS, 1, one), _row(ROWS, 2, two, one), _row(ROWS, 3, two)], axis=1)


def inner_rows(classes: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """The rows of weights within a class: its bigram and a skip."""
    return np.stack([_row(INNER_ROWS, 5, classes, before[0]), _row(INNER_ROWS, 6, classes, before[1])], axis=1)


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log of the sum of weights) of each row; ``logits`` is overwritten."""
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    p = np.exp(logits)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    return p, (np.log(total) + top)[:, 0]


@dataclass
class Table:
    """Hashed rows of weights with what gradient steps keep of them."""

    weights: np.ndarray
    seen: np.ndarray
    squares: np.ndarray

    @staticmethod
    def of(weights: np.ndarray) -> Table:
        return Table(weights.copy(), np.zeros(len(weights), dtype=np.int64), np.zeros(len(weights), dtype=np.float32))

    def step(self, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """One step against the gradient of each token (tokens x outputs) for the rows of its features (tokens x features)."""
        flat = rows.ravel().astype(np.uint16)  # sorted by radix
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        at, size, token = flat[first], np.diff(np.append(first, len(flat))), order // rows.shape[1]
        sums = gradient[token[first]]
        for k in range(1, FEW):  # most features stand once or twice: reduceat is slow on those
            more = np.flatnonzero((size > k) & (size <= FEW))
            if len(more):
                sums[more] += gradient[token[first[more] + k]]
        many = np.flatnonzero(size > FEW)
        if len(many):
            starts = np.cumsum(size[many]) - size[many]
            sums[many] = np.add.reduceat(gradient[token[ragged(first[many], size[many])]], starts, axis=0)
        self.seen[at] += size
        self.squares[at] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        self.weights[at] -= (rate / np.sqrt(self.squares[at] + 1e-6))[:, None] * sums


@dataclass
class Model:
    class_bias: np.ndarray
    inner_bias: np.ndarray
    class_weights: np.ndarray
    inner_weights: np.ndarray

    @staticmethod
    def start(v: Vocabulary) -> Model:
        """Without features: the training counts of classes, and of the tokens of each."""
        own = np.full(OUTPUTS, -np.inf)
        n = min(len(v.counts), OUTPUTS)
        own[:n] = np.log(v.counts[:n] + 0.5)
        tokens = np.append(np.where(np.isfinite(own), np.exp(own), 0).reshape(WORD_CLASSES, IN_CLASS).sum(axis=1), v.tail_tokens + 0.5 * (v.tail_words + 1))
        with np.errstate(divide="ignore"):
            class_bias = np.log(tokens)
        return Model(class_bias.astype(np.float32), own.reshape(WORD_CLASSES, IN_CLASS).astype(np.float32), np.zeros((ROWS, CLASSES), dtype=np.float32), np.zeros((INNER_ROWS, IN_CLASS), dtype=np.float32))

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.class_weights[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            out += self.class_weights[rows[:, k]]
        out += self.class_bias
        return out

    def inner_logits(self, classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = self.inner_weights[rows[:, 0]]
        out += self.inner_weights[rows[:, 1]]
        out += self.inner_bias[classes]
        return out

    def logs(self, codes: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The natural log of each token's class, and of the token in it where its class is one of words."""
        before, out = contexts(codes, starts), np.zeros(len(codes))
        for a in range(0, len(codes), STEP):
            own, cls = [b[a : a + STEP] for b in before], classes[a : a + STEP]
            logits = self.class_logits(class_rows(own))
            said = logits[np.arange(len(cls)), cls].astype(np.float64)
            out[a : a + STEP] = said - _softmax(logits)[1]
            at = np.flatnonzero(cls < WORD_CLASSES)
            if len(at):
                logits = self.inner_logits(cls[at], inner_rows(cls[at], [b[at] for b in own]))
                said = logits[np.arange(len(at)), codes[a + at] % IN_CLASS].astype(np.float64)
                out[a + at] += said - _softmax(logits)[1]
        return out

    def learn(self, codes: np.ndarray, classes: np.ndarray, starts: np.ndarray, of_classes: Table, inside: Table, rate: float = RATE) -> None:
        """Gradient steps over these tokens; ``of_classes`` and ``inside`` hold this model's weights."""
        before = contexts(codes, starts)
        for a in range(0, len(codes), STEP):
            own, cls = [b[a : a + STEP] for b in before], classes[a : a + STEP]
            rows = class_rows(own)
            p, _ = _softmax(self.class_logits(rows))
            p[np.arange(len(cls)), cls] -= 1
            of_classes.step(rows, p, rate)
            at = np.flatnonzero(cls < WORD_CLASSES)
            if len(at):
                rows = inner_rows(cls[at], [b[at] for b in own])
                p, _ = _softmax(self.inner_logits(cls[at], rows))
                p[np.arange(len(at)), codes[a + at] % IN_CLASS] -= 1
                inside.step(rows, p, rate)


#: Rows of weights that travel together.
BLOCK = 256
assert not (ROWS % BLOCK or INNER_ROWS % BLOCK)


def _blocks(kind: int, table: Table) -> Iterator[tuple[int, int, bytes, bytes]]:
    for b in range(0, len(table.weights), BLOCK):
        if (seen := table.seen[b : b + BLOCK]).any():
            yield kind, b, table.weights[b : b + BLOCK].astype(np.float16).tobytes(), seen.tobytes()


def gradients(docs: DataFrame, v: Vocabulary, model: Model, text: str = "text") -> Model:
    """``model`` after one pass of gradient steps over all texts: every task's rows, averaged."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((v, model))
    schema = "worker int, kind int, block int, weights binary, seen binary"

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, start = shared.value
        of_classes, inside = Table.of(start.class_weights), Table.of(start.inner_weights)
        own = Model(start.class_bias, start.inner_bias, of_classes.weights, inside.weights)
        for pdf in it:
            codes, starts, _, classes = v.coded([words(t) for t in pdf[text]])
            own.learn(codes, classes, starts, of_classes, inside)
        rows = [*_blocks(0, of_classes), *_blocks(1, inside)]
        for a in range(0, len(rows), 64):
            kind, block, weights, seen = zip(*rows[a : a + 64], strict=True)
            yield pd.DataFrame({"worker": TaskContext.get().partitionId(), "kind": kind, "block": block, "weights": weights, "seen": seen})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = [np.frombuffer(x, dtype=np.int64) for x in pdf["seen"]]
        sums = sum(np.frombuffer(x, dtype=np.float16).reshape(BLOCK, -1) * n[:, None].astype(np.float64) for x, n in zip(pdf["weights"], seen, strict=True))
        first, total = pdf.iloc[:1], sum(seen)
        return first.assign(worker=first["worker"] // FAN, weights=[(sums / np.maximum(total, 1)[:, None]).astype(np.float16).tobytes()], seen=[total.tobytes()])

    some = docs.select(text).coalesce(max(WORKERS, 2 * spark.sparkContext.defaultParallelism))
    parts = durable(some.mapInPandas(batches, schema))  # a task without texts sends nothing
    workers = (parts.agg(F.max("worker")).first()[0] or 0) + 1
    while workers > 1:
        parts, workers = parts.groupBy("kind", "block", F.floor(F.col("worker") / FAN).cast("int").alias("_w")).applyInPandas(lambda _, pdf: added(pdf), schema), -(-workers // FAN)
    out = [model.class_weights.copy(), model.inner_weights.copy()]
    for r in parts.toLocalIterator():  # as many blocks as the model has
        seen = np.frombuffer(r["seen"], dtype=np.int64)
        at = np.flatnonzero(seen)
        out[r["kind"]][r["block"] + at] = np.frombuffer(r["weights"], dtype=np.float16).reshape(len(seen), -1)[at]
    return Model(model.class_bias, model.inner_bias, *out)


def train(docs: DataFrame, text: str = "text", rounds: int = 1, dictionary: int = DICTIONARY) -> tuple[Vocabulary, Model, DataFrame]:
    """The counts of all texts of ``docs``, the model after so many passes over them, and the counts as a written table."""
    counts = durable(token_counts(docs, text))
    v = vocabulary(counts, docs.count(), dictionary)
    model = Model.start(v)
    for _ in range(rounds):
        model = gradients(docs, v, model, text)
    return v, model, counts


def score(docs: DataFrame, v: Vocabulary, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row: log10 probabilities by counts alone and by the model."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((v, model))
    row, rare = unused(docs, "row_id"), unused(docs, "rare")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, {rare} array<string>"

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, model = shared.value
        beyond = len(v.dictionary) + 1
        for pdf in it:
            codes, starts, others, classes = v.coded([words(t) for t in pdf[text]])
            known = codes < beyond
            at = np.where(known, codes, 0)
            counted = np.where(known, v.log_counts[at], 0.0)  # those beyond are added below
            inside = np.where(classes < WORD_CLASSES, 0.0, counted - v.tail_log_totals[np.maximum(classes - WORD_CLASSES, 0)])
            by_model = model.logs(codes, classes, starts) / np.log(10) + inside
            sums = lambda x: np.add.reduceat(x, starts)
            yield pd.DataFrame({key: pdf[key], "n_tokens": np.diff(np.append(starts, len(codes))), "n_known": sums((known & (v.counts[at] > 0)).astype(np.int64)), "base_score": sums(counted - v.log_total), "score": sums(by_model), rare: others})

    told = durable(docs.select(key, text).mapInPandas(batches, schema).withColumn(row, F.monotonically_increasing_id()))
    each = told.select(row, F.explode(rare).alias("word"))
    each = each.join(counts, "word", "left").groupBy(row).agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("_logs"), F.count("n").alias("_known"))
    more = lambda c: F.coalesce(c, F.lit(0))
    return told.join(each, row, "left").select(
        key, "n_tokens", (F.col("n_known") + more("_known")).alias("n_known"), F.lit(v.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("_logs")).alias("base_score"), (F.col("score") + more("_logs")).alias("score"),
    )
