from collections import Counter, defaultdict
import random
import re

import duckdb
import numpy as np
import pytest

from pairlens.llm import collocations, queries
from pairlens.llm.common import durable

SF = "/root/testdata/sf0.001"


def brute(rows, least, top=2000, percent=100):
    f = defaultdict(Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f[lang or "und"][" ".join(w[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        total = sum(c for p, c in counts.items() if " " not in p)
        candidates = {p: c for p, c in counts.items() if " " in p and c >= least}
        kept = []
        for p, a in candidates.items():
            if any(p != q and f" {p} " in f" {q} " and 100 * b >= percent * a for q, b in candidates.items()):
                continue
            w = p.split(" ")
            cut = min((1000 * a * total // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w)))
            kept.append((-cut[0], -a, p.encode(), p, a, counts[" ".join(w[: cut[1]])], counts[" ".join(w[cut[1] :])], total))
        out += [(lang, i + 1, x[3], x[4], x[5], x[6], x[7], -x[0]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "\x1cx", "long" * 30, "b c"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(120):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        at = rng.randrange(len(words) + 1)
        words[at:at] = ["New", "york", "city"] * rng.randint(0, 2)
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", ", "] if rng.random() < 0.2 else [" "]) for w in words)))
    return rows + [("en", None), ("fr", ""), (None, " .\n"), ("en", "a " * 500)]


@pytest.mark.parametrize("dictionary,share,percent,most", [(200_000, 2, 100, 1000), (200_000, 300, 100, 1000), (200_000, 1, 90, 5), (5, 100, 80, 20), (0, 5, 60, 20)])
def test_matches_brute_force(spark, monkeypatch, dictionary, share, percent, most):
    monkeypatch.setattr(collocations, "SHARE", share)
    monkeypatch.setattr(collocations, "MINED", most // 2)
    monkeypatch.setattr(collocations, "MOST", most)
    monkeypatch.setattr(collocations, "WORD_BYTES", 20)
    rows = texts(dictionary + share)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least=6, dictionary=dictionary, percent=percent, top=40)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6, 40, percent)


def test_query_matches_sql(spark):
    duckdb.sql(f"create or replace view documents as from '{SF}/documents.parquet'")
    got = queries.op13_collocations(spark, SF)
    want = duckdb.sql(queries.ORACLES["op13_collocations"])
    assert got.columns == want.columns and len(want.fetchall()) > 0
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_products_beyond_64_bits(spark):
    big = 10**13
    phrases = durable(spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7)], "lang string, phrase string, f long"))
    row = collocations.scored(phrases, spark.createDataFrame([("en", 5 * big)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big - 7) * 5 * big // (big * (big - 1))


def test_tally_survives_equal_hashes(monkeypatch):
    rng = np.random.default_rng(0)
    rows, n = rng.integers(0, 3, (500, 3)), rng.integers(1, 5, 500)
    want = Counter()
    for r, k in zip(rows.tolist(), n.tolist(), strict=True):
        want[tuple(r)] += k
    for f in (collocations.hashed, lambda rows: (rows[:, 0] % 2).astype(np.uint64)):
        monkeypatch.setattr(collocations, "hashed", f)
        found, sums = collocations.tally(rows, n)
        assert dict(zip(map(tuple, found.tolist()), sums.tolist(), strict=True)) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
