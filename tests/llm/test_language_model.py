import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import language_model as lm
from pairlens.llm import queries
from pairlens.llm.common import read

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def base(train, texts):
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for x in texts]


def vocabulary(counts, texts, size):
    ranked = sorted((-n, w) for w, n in counts.items())
    tails = np.zeros((2, lm.TAIL_CLASSES))
    for n, w in ranked[lm.OUTPUTS - 1 :]:
        tails[:, lm.tail_class(w)] += (-n, 1)
    chosen = ranked[:size]
    return lm.Vocabulary([w for _, w in chosen], np.array([texts, *(-n for n, _ in chosen)], dtype=np.float64), sum(counts.values()) + texts, len(counts) + 1, *tails)


@pytest.fixture
def tiny(monkeypatch):
    for name, n in {"WORD_CLASSES": 2, "IN_CLASS": 3, "TAIL_CLASSES": 2, "ROWS": 64, "INNER_ROWS": 32, "OUTPUTS": 6, "CLASSES": 4, "STEP": 7}.items():
        monkeypatch.setattr(lm, name, n)
    counts = {f"w{i}": 40 - i for i in range(20)}
    v = vocabulary(counts, 9, 12)
    rng = np.random.default_rng(3)
    m = lm.Model.start(v)
    m.class_weights, m.inner_weights = rng.normal(size=(64, 4)).astype(np.float32), rng.normal(size=(32, 3)).astype(np.float32)
    return counts, v, m


def plain(v, m, before, cls, code):
    """The log-probability of a class and a token in it, written out for one place."""
    one, two = (np.array([b]) for b in before)
    scores = m.class_bias.astype(float) + sum(m.class_weights[r].astype(float) for r in lm.class_rows([one, two])[0])
    out = scores[cls] - math.log(sum(math.exp(x) for x in scores))
    if cls < lm.WORD_CLASSES:
        inner = m.inner_bias[cls].astype(float) + sum(m.inner_weights[r].astype(float) for r in lm.inner_rows(np.array([cls]), [one, two])[0])
        out += inner[code % lm.IN_CLASS] - math.log(sum(math.exp(x) for x in inner))
    return out


def test_scores_equal_the_formula_and_add_up_to_one(tiny):
    counts, v, m = tiny
    texts = [[b"w0", b"w3", b"w19", b"w1", b"new", b"w7"] * 3, [], [b"w2"]]
    codes, starts, others, classes = v.coded(texts)
    assert others[0] == ["w19", "new"] * 3 and codes[starts[1]] == 0 and len(codes) == 22
    logs, at = m.logs(codes, classes, starts), 0
    for text in texts:
        own = codes[at : at + len(text) + 1]
        for i, code in enumerate(own):
            before = [own[i - k] if i >= k else -1 for k in (1, 2)]
            assert logs[at + i] == pytest.approx(plain(v, m, before, classes[at + i], code), abs=1e-4)
        at += len(own)
    total = 0.0
    for w in [None, *counts]:  # all that can follow, and an unseen word in each class of words by their tails
        code = 0 if w is None else v.code.get(w.encode(), 10**6)
        if code < lm.OUTPUTS:
            total += math.exp(plain(v, m, (1, 2), code // lm.IN_CLASS, code))
        else:
            t = lm.tail_class(w)
            total += math.exp(plain(v, m, (1, 2), lm.WORD_CLASSES + t, 0)) * (counts[w] + 0.5) / 10 ** v.tail_log_totals[t]
    total += sum(math.exp(plain(v, m, (1, 2), lm.WORD_CLASSES + t, 0)) * 0.5 / 10 ** v.tail_log_totals[t] for t in range(lm.TAIL_CLASSES))
    assert total == pytest.approx(1, abs=1e-5)


def test_a_step_follows_the_gradient(tiny, monkeypatch):
    _, v, m = tiny
    monkeypatch.setattr(lm, "STEP", 100)
    codes, starts, _, classes = v.coded([[b"w0", b"w1", b"w0", b"w1", b"w5", b"w15"] * 4])
    loss = lambda: -m.logs(codes, classes, starts).sum()
    tables = []
    for name in ("class_weights", "inner_weights"):
        w = getattr(m, name).astype(np.float64)
        setattr(m, name, w)
        t = lm.Table.of(w)
        tables.append(t)
    own = lm.Model(m.class_bias, m.inner_bias, tables[0].weights, tables[1].weights)
    own.learn(codes, classes, starts, *tables, rate=0.1)
    for name, table in zip(("class_weights", "inner_weights"), tables, strict=True):
        w = getattr(m, name)
        for r in np.flatnonzero(table.seen)[:6]:
            slope = np.zeros(w.shape[1])
            for c in range(w.shape[1]):
                w[r, c] += 1e-4
                up = loss()
                w[r, c] -= 2e-4
                slope[c] = (up - loss()) / 2e-4
                w[r, c] += 1e-4
            want = w[r] - 0.1 / math.sqrt((slope**2).mean() + 1e-6) * slope
            assert table.weights[r] == pytest.approx(want, abs=2e-3)
    assert tables[0].seen.sum() == 3 * len(codes)


def test_rows_of_tasks_are_averaged_by_use(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "WORKERS", 100)
    texts = [f"a{i % 3} b{i % 5} c" for i in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    counts = Counter(w for t in texts for w in t.split())
    v = vocabulary(counts, len(texts), 100)
    start = lm.Model.start(v)
    got = lm.gradients(df, v, start)
    rows = df.withColumn("p", F.spark_partition_id()).collect()
    sums, seen = 0, 0
    for p in range(5):
        a, b = lm.Table.of(start.class_weights), lm.Table.of(start.inner_weights)
        codes, starts, _, classes = v.coded([lm.words(r["text"]) for r in rows if r["p"] == p])
        lm.Model(start.class_bias, start.inner_bias, a.weights, b.weights).learn(codes, classes, starts, a, b)
        sums, seen = sums + a.weights * a.seen[:, None], seen + a.seen
    want = np.divide(sums, seen[:, None], out=np.zeros(sums.shape), where=seen[:, None] > 0)
    assert np.allclose(got.class_weights, want, atol=2e-3) and (got.class_weights != 0).any()


def test_query_against_counts(spark):
    got = queries.op12_lm_scoring(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    want = dict(zip(docs, base([t for i, t in docs.items() if not held[i]], docs.values()), strict=True))
    assert len(got) == len(docs)
    for r in got:
        n, known, total, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, total)
        assert r["base_score"] == pytest.approx(score, abs=1e-6 * n) and math.isfinite(r["score"]) and r["score"] < 0
    new = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in new) > sum(r["base_score"] for r in new)


@pytest.mark.parametrize("dictionary", [0, 3, 200_000])
def test_any_dictionary_and_odd_rows(spark, dictionary):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("The cat sat on a mat É \x1cx".split(" "), k=rng.randint(0, 9)))) for i in range(40)]
    rows += [(None, "the cat"), (None, None), (1, ""), (2, "never seen before"), (3, "x" * 100 + " the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rare": F.lit(1), "row_id": F.lit(2), "score": F.lit("s")})
    train = df.where("doc_id % 2 = 0")
    v, m, counts = lm.train(train, dictionary=dictionary)
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score(df, v, m, counts).collect())
    assert got == sorted((a, b, c, round(d, 6)) for a, b, c, d in base([t for i, t in rows if i is not None and i % 2 == 0], [t for _, t in rows]))
    none = df.limit(0)
    v, m, counts = lm.train(none, dictionary=dictionary)
    assert lm.score(none, v, m, counts).count() == 0
    r = lm.score(df.where("doc_id = 2 and text like 'never%'"), v, m, counts).first()
    assert r["n_known"] == 0 == r["train_tokens"] and r["base_score"] == pytest.approx(0) and math.isfinite(r["score"])
