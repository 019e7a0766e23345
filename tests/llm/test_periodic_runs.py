import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairlens.llm import periodic_runs, queries
from pairlens.llm.common import read

SF = "/root/testdata/sf0.001"


def brute(words, least):
    """Every period by itself: stretches of words that equal those a period on."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # periods ascend: the first is the smallest
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def stuttered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("least", [2, 3, 6, 12])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        lists = []
        for _ in range(rng.randint(1, 4)):
            n, kinds = rng.choice([0, 1, 5, 20, 60, 120]), rng.choice([1, 2, 2, 3, 4])
            words = [bytes([97 + rng.randrange(kinds)]) for _ in range(n)]
            if rng.random() < 0.4 and n > 5:
                p = rng.randint(1, n)
                words = [words[i % p] for i in range(n)]
                words[rng.randrange(n)] = b"z"
            elif rng.random() < 0.3:
                a, b = [b"a"], [b"a", b"b"]  # Fibonacci words hold as many runs as texts can
                while len(b) < n:
                    a, b = b, b + a
                words = b
            lists.append(words)
        assert periodic_runs.runs(lists, least) == [brute(w, least) for w in lists]


def test_previous_factors_and_blocks():
    text = "abaabababb"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda i, j: next((k for k in range(len(text)) if text[i : i + k + 1] != text[j : j + k + 1] or max(i, j) + k >= len(text)), 0)
    lcp = [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
    factor, source = periodic_runs.previous_factors(order, lcp)
    want = [max((common(j, i) for j in range(i)), default=0) for i in range(len(text))]
    assert factor == want
    assert all(source[i] < i and common(source[i], i) == n for i, n in enumerate(factor) if n)
    at = periodic_runs.blocks(factor)
    assert at[0] == 0 and at[-1] == len(text) and all(b - a == (factor[a] or 1) for a, b in zip(at, at[1:], strict=False))


def test_query_matches_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = read(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words, r = stuttered(doc_id, split(text)), got[doc_id]
        found = brute(words, 12) if len(words) < 2000 else periodic_runs.runs([words])[0]
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        inside = {i for s, n, q in found for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in inside)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert (r["runs_sha256"], r["collapsed_sha256"]) == (hashlib.sha256(told).hexdigest(), hashlib.sha256(kept).hexdigest())
        with_runs += bool(found)
    assert with_runs > 10


def test_odd_rows(spark):
    rows = [(None, "x " * 30, 1), (1, None, 2), (2, "", 3), (3, " \t\n\x0b\x0c\r ", 4), (4, "a b " * 12, 5), (4, "a b " * 12, 5), (5, "one two", 6), (6, "w " * 30000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumns({"run_start": F.lit("mine"), "collapsed": F.lit(0)})
    out = periodic_runs.find(periodic_runs.stuttered(df)).collect()
    assert len(out) == len(rows) and {r["run_start"] for r in out} == {"mine"}
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert of[None] == [([(0, 30, 1)], "x")] and of[1] == of[2] == of[3] == [([], "")] and of[5] == [([], "one two")]
    assert of[4] == [([(0, 12, 1)], "a b")] * 2 and of[6] == [([(0, 30000, 1)], "w")]
    assert periodic_runs.find(df.limit(0)).count() == 0
