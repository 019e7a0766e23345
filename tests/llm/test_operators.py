"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import json
import math
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pairlens.llm import chat_format, components, language_id, license_scan, mixing, quality, queries, simhash, spotsigs, topk_search, unigram, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "en", None, 3), (4, "the cat sat on the mat and ran", "en", "b", 30), (4, "the cat sat on the mat and ran", "en", "b", 30),
    (5, "the cat sat on the mat and ran", "en", "c", 30), (6, "!!! 123 ***", "en", "b", 9), (7, "long " * 20_000, "en", "c", 100_000), (8, "x" * 50_000, "de", "c", 50_000), (None, "no id here at all", "en", "a", 3),
    (10, "the de " * 30_000, "en", "c", 210_000), (9, "naïve Łódź ▁ 東京 \U0001f600 ½", "en", "a", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"score": F.lit("clash"), "fp": F.lit(1), "size": F.lit("s"), "pattern": F.lit(0), "h": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1


def test_topk_matches_sql(spark):
    got = queries.op1_topk_search(spark, SF).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    duckdb.sql(f"create or replace view embeddings as from '{SF}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLES["op1_topk_search"]).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, check_dtype=False)


def test_topk_shards_blocks_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(200)] + [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [math.nan, 0.0, 0.0, 0.0]), (503, [math.inf, 0.0, 0.0, 0.0]), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<double>").withColumn("score", F.lit("clash"))
    asked = df.where("vec_id % 20 = 0 or vec_id > 400").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(topk_search.top_k(asked, df, k=7))}
    want = {}
    for qid in range(0, 200, 20):
        q = np.floor(256 * np.array(vectors[qid][1]))
        best = sorted(((-int(q @ np.floor(256 * np.array(v))), i) for i, v in vectors[:200] if i != qid))[:7]
        want |= {(qid, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want
    assert topk_search.top_k(asked.limit(0), df).count() == 0 and topk_search.top_k(asked, df.limit(0)).count() == 0


def test_topk_copies_repeated_ids_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk_search, "LEAF_ROWS", 4)
    vectors = [(i, [0.5, 0.25]) for i in range(90)] + [(i, [i / 100, -0.5]) for i in range(100, 140)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<double>")  # two thirds are copies of one vector
    asked = spark.createDataFrame([(5, [0.5, 0.25]), (5, [1.0, -1.0]), (5, [1.0, -1.0])], "query_id long, vector array<double>")
    want = []
    for v in ([0.5, 0.25], [1.0, -1.0]):
        best = sorted((-int(np.floor(256 * np.array(v)) @ np.floor(256 * np.array(x))), i) for i, x in vectors if i != 5)[:3]
        want += [(5, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk_search.top_k(asked, df, k=3))) == sorted(want)
    with pytest.raises(ValueError, match="fit a long"):
        topk_search.top_k(spark.createDataFrame([(1, [1e30, 1.0])], "query_id long, vector array<double>"), df)


# 2


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_license_scan_finds_what_exact_containment_finds(spark, docs):
    got = {(r["doc_id"], r["template_id"]) for r in rows(license_scan.scan(docs, license_scan.default_templates(spark)))}
    want = set()
    for r in docs.collect():
        own = shingles(r["text"])
        for name, notice in license_scan.NOTICES.items():
            t = set(shingles(notice))
            m, w, step, _ = license_scan.class_of(len(t))
            if any(len(t & set(own[i : i + w])) >= 0.8 * len(t) for i in range(0, len(own), step)):
                want.add((r["doc_id"], name))
    assert got == want and want


def test_license_scan_odd_rows(spark, odd, none):
    notice = license_scan.NOTICES["mit-grant"]
    more = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(99), "text": F.lit("so " * 500 + notice.upper() + " and" * 700)}))
    assert {(r["doc_id"], r["template_id"]) for r in rows(license_scan.scan(more, license_scan.default_templates(spark)))} == {(99, "mit-grant")}
    assert license_scan.scan(none, license_scan.default_templates(spark)).count() == 0
    with pytest.raises(ValueError, match="under 5 words"):
        license_scan.scan(none, spark.createDataFrame([("x", "a b c d")], "template_id string, text string"))


def test_license_query_finds_short_notices(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["template_id"]): r for r in rows(queries.op2_license_scan(spark, sf)) if r["template_id"] in license_scan.SHORT_NOTICES}
    words = {r["doc_id"]: [w for w in re.split(r"[\W_]+", (r["text"] or "").lower()) if w] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at = {d: [i for i in range(len(w)) if w[i : i + 3] == ["all", "rights", "reserved"]] for d, w in words.items()}
    assert {k[0]: (r["position"], r["windows"], r["containment"]) for k, r in got.items() if k[1] == "all-rights-reserved"} == {d: (p[0], len(p), 1.0) for d, p in at.items() if p} and any(at.values())
    more = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(99), "text": F.lit("// SPDX-License-Identifier: MIT\nrights reserved mit SPDX-License-Identifier: MIT")}))
    assert [(r["doc_id"], r["template_id"], r["position"], r["windows"]) for r in rows(license_scan.scan_short(more, license_scan.short_templates(spark)))] == [(99, "spdx-mit", 0, 2)]
    assert license_scan.scan_short(none, license_scan.short_templates(spark)).count() == 0


def test_license_scan_recall_at_any_position(spark):
    rng = np.random.default_rng(5)
    words, made = [f"w{i}" for i in range(2000)], []
    for i in range(120):
        name = list(license_scan.NOTICES)[i % len(license_scan.NOTICES)]
        own = license_scan.NOTICES[name].split()
        if len(own) > 40:  # one word changed: five shingles of over forty
            own[rng.integers(len(own))] = "altered"
        made.append((i, name, " ".join([*rng.choice(words, rng.integers(0, 300)), *own, *rng.choice(words, rng.integers(0, 300))])))
    df = spark.createDataFrame([(i, t) for i, _, t in made], "doc_id long, text string")
    got = {(r["doc_id"], r["template_id"]) for r in rows(license_scan.scan(df, license_scan.default_templates(spark)))}
    held = {(i, n) for i, n, t in made if len(set(shingles(t)) & set(shingles(license_scan.NOTICES[n]))) >= 0.8 * len(set(shingles(license_scan.NOTICES[n])))}
    assert len(held) > 100 and len(held - got) <= 1  # a band misses one in a thousand


def test_license_bands_keep_their_promise():
    for n in (1, 2, 3, 5, 9, 30, 200):
        m, w, step, bands = license_scan.class_of(n)
        share = math.ceil(0.8 * n)
        assert n <= m and w - step + 1 >= n
        assert (1 - share / (w + n - share)) ** bands <= 1e-3 + 1e-12 or w == 1


# 3


def test_chat_format_round_trip(spark):
    got = {r["conv_id"]: r for r in rows(queries.op3_chat_format(spark, SF))}
    table = pd.read_parquet(f"{SF}/conversations.parquet")
    more = pd.DataFrame({"conv_id": -7, "turn": [0, 1], "role": ["user", "assistant"], "text": "</s>[INST] ok [/INST]"})
    for cid, g in pd.concat([table, more]).groupby("conv_id"):
        g = g.assign(text=g["text"].fillna("")).sort_values(["turn", "role", "text"])
        told = "".join(f"{r}\n{t}\n" for r, t in zip(g["role"], g["text"], strict=True))
        loss = "".join(g[g["role"] == "assistant"]["text"])
        r = got[cid]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(g), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] > len(told)
    assert len(got) == table["conv_id"].nunique() + 1


def test_chat_layouts_and_escapes(spark):
    nasty = ["<|end|>", "\\", "\\<|turn|>\\", "<|text|>[INST]<<SYS>></s>\\|", "", "<\\|", None]
    records = [json.dumps({"messages": [{"role": "user", "content": t}, {"role": "assistant", "content": t}]}) for t in nasty]
    records += [json.dumps(x) for x in (
        {"instruction": "do", "input": "this", "output": "done"}, {"prompt": "a", "completion": "b"}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        {"question": "q", "answer": "a", "extra": {"deep": [1]}}, {"nothing": 1}, [1, 2],
    )] + [None, "not json"]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id long, record string, text string")
    out = sorted(rows(chat_format.parse(chat_format.render(chat_format.canonical_turns(df)))), key=lambda r: r["id"])
    for r, t in zip(out, nasty, strict=False):
        assert [(x["role"], x["text"]) for x in r["parsed"]] == [("user", t or ""), ("assistant", t or "")] and r["loss_text"] == (t or "")
        assert len(re.findall(r"<\|end\|>", r["formatted"])) == 2 and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]
    assert [r["layout"] for r in out[len(nasty) :]] == ["instruction_input", "prompt_completion", "conversations", "question_answer", "unknown", "unknown", "unknown", "unknown"]
    assert [(x["role"], x["text"]) for x in out[len(nasty)]["parsed"]] == [("user", "do\nthis"), ("assistant", "done")]
    assert out[len(nasty) + 2]["loss_text"] == "ho" and out[0]["text"] == "x"
    assert len({r["schema_id"] for r in out[: len(nasty)]}) == 1


def test_chat_query_matches_sql(spark):
    duckdb.sql(f"create or replace view conversations as from '{SF}/conversations.parquet'")
    want = duckdb.sql(queries.ORACLES["op3_chat_format"]).df().sort_values("conv_id").reset_index(drop=True)
    got = queries.op3_chat_format(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, check_dtype=False)


def test_chat_roles_layouts_and_clashes(spark):
    turns = {1: [("human", "a"), ("gpt", "b")], 2: [("user", ""), ("assistant", "x\ny")], 3: [("system", "s"), ("user", "u"), ("assistant", "v")], 4: [("system", ""), ("user", "u"), ("assistant", "v")], 5: [("assistant", "first")], 6: [("user", "q"), ("user", "q"), ("assistant", "long " * 20_000)]}
    df = spark.createDataFrame([(c, i, r, t) for c, own in turns.items() for i, (r, t) in enumerate(own)], "conv_id long, turn long, role string, text string")
    records = chat_format.gather(df)
    out = {r["conv_id"]: r for r in rows(chat_format.parse(chat_format.render(chat_format.canonical_turns(records, roles={}))))}
    assert {c: [(t["role"], t["text"]) for t in r["parsed"]] for c, r in out.items()} == turns
    assert [out[c]["layout"] for c in range(1, 7)] == ["conversations", "prompt_response", "system_prompt", "messages", "conversations", "messages"]
    assert len({r["schema_id"] for r in out.values()}) == 4
    clash = records.withColumns({c: F.lit("mine") for c in ("layout", "schema_id", "turns", "safe", "heads", "formatted", "loss_spans", "text")})
    again = {r["conv_id"]: r for r in rows(chat_format.render(chat_format.canonical_turns(clash, roles={})))}
    assert {c: (r["formatted"], r["layout"], r["safe"], r["heads"], r["text"]) for c, r in again.items()} == {c: (r["formatted"], r["layout"], "mine", "mine", "mine") for c, r in out.items()}
    assert len(rows(chat_format.canonical_turns(records.unionByName(records)))) == 12


def test_chat_of_many_turns_takes_time_by_length(spark):
    turns = [("assistant" if i % 2 else "user", f"turn {i} <|end|> \\ é𝄞" if i % 5 else None) for i in range(20_000)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    start = time.time()
    out = rows(chat_format.parse(chat_format.render(chat_format.canonical_turns(chat_format.gather(df), roles={}))))[0]
    assert [(t["role"], t["text"]) for t in out["parsed"]] == [(r, t or "") for r, t in turns]
    assert out["loss_text"] == "".join(t or "" for r, t in turns if r == "assistant") and len(out["loss_spans"]) == 10_000
    assert time.time() - start < 30


def test_chat_gather_nulls(spark):
    df = spark.createDataFrame([(1, 1, None, "b"), (1, 0, "user", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in rows(chat_format.parse(chat_format.render(chat_format.canonical_turns(chat_format.gather(df)))))}
    assert [(t["role"], t["text"]) for t in out[1]["parsed"]] == [("user", ""), ("", "b")] and len(out) == 2
    assert chat_format.gather(df.limit(0)).count() == 0


# 4


def test_quality_learns_on_held_out(spark):
    out = queries.op4_quality(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert held[held["quality"] == 1]["score"].mean() > held[held["quality"] == 0]["score"].mean() + 0.5
    import zlib

    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()


def test_quality_scores_equal_the_plain_average():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.3)
    texts = ["a bb a bb bb", "", None, "word " * 50, "ünï çødé"]
    for text, s in zip(texts, model.score(texts), strict=True):
        (b, c), = quality.bags([text])
        mean = (model.by_bucket[b] * c).sum() / max(c.sum(), 1)
        assert s == pytest.approx(1 / (1 + math.exp(-mean - 0.3)))


def test_quality_training_equals_plain_steps():
    samples = [(np.array([3, 9], dtype=np.int32), np.array([2.0, 1.0], dtype=np.float32)), (np.array([9, 11], dtype=np.int32), np.array([1.0, 1.0], dtype=np.float32)), (np.array([5], dtype=np.int32), np.array([4.0], dtype=np.float32))]
    labels = np.array([1, 0, 1])
    got = quality.fit(samples, labels, epochs=3)
    rng = np.random.default_rng(quality.SEED)
    v = rng.uniform(-1 / quality.DIMS, 1 / quality.DIMS, (quality.BUCKETS, quality.DIMS))
    u, b, t = [[0.0, 0.0] for _ in range(quality.DIMS)], [0.0, 0.0], 0
    for _ in range(3):
        for i in rng.permutation(3):
            rate, (rows_, counts) = quality.RATE * (1 - t / 9), samples[i]
            t += 1
            mean = [sum(c * v[r][d] for r, c in zip(rows_, counts, strict=True)) / sum(counts) for d in range(quality.DIMS)]
            z = [sum(mean[d] * u[d][y] for d in range(quality.DIMS)) + b[y] for y in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, z)) - (y == labels[i]) for y, x in enumerate(z)]
            back = [u[d][0] * p[0] + u[d][1] * p[1] for d in range(quality.DIMS)]
            u = [[u[d][y] - rate * 0.25 * mean[d] * p[y] for y in (0, 1)] for d in range(quality.DIMS)]
            b = [b[y] - rate * 0.02 * p[y] for y in (0, 1)]
            for r, c in zip(rows_, counts, strict=True):
                v[r] -= rate * (c / max(counts)) * 0.05 * np.array(back)
    for r in (3, 5, 9, 11, 100):
        assert got.by_bucket[r] == pytest.approx(sum(v[r][d] * (u[d][1] - u[d][0]) for d in range(quality.DIMS)), abs=1e-6)
    assert got.bias == pytest.approx(b[1] - b[0], abs=1e-6)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (1, None), (None, 1), (7, 5)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    out = rows(quality.scores(odd, model))
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scores(none, quality.train(none, labels)).count() == 0
    assert {r["score"] for r in rows(quality.scores(odd, quality.train(odd, labels.limit(0))))} == {0.5}
    assert quality.accepted(odd, model).columns == odd.columns


# 5


def brute_simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, docs):
    base = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    words = base[0]["text"].split()
    more = [{"doc_id": 10_000 + i, "text": " ".join(words[:i] + ["new"] + words[i:])} for i in range(40)]
    df = spark.createDataFrame(base + more, "doc_id long, text string")
    fps = {r["doc_id"]: brute_simhash(r["text"]) for r in base + more}
    want = brute_components(fps)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows(simhash.near_duplicates(df))}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert len(set(want.values())) < len(want)


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_prints_match_brute_force(docs):
    for r in docs.limit(50).collect():
        every = simhash.prints(r["text"], 5, 42, 8)
        assert every[0] == brute_simhash(r["text"], 5) and len(set(every)) in (1, 8)
    long = " ".join(f"w{i % 997} x{i}" for i in range(20_000))
    assert simhash.prints(long, 5, 42, 2)[0] == brute_simhash(long, 5)


def test_representatives_against_similarities(spark, docs):
    base = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    many = [f"word{i}" for i in range(150)]
    more = [{"doc_id": 10_000 + i, "text": " ".join(many[:i] + ["new"] + many[i:])} for i in range(60)]  # similarity 0.93 or more to the whole
    every = base + more + [{"doc_id": 9_999, "text": " ".join(many)}]
    kept = {r["doc_id"] for r in rows(simhash.representatives(spark.createDataFrame(every, "doc_id long, text string")))}
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in every}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert kept.isdisjoint(r["doc_id"] for r in more) and 9_999 in kept
    for i in sets.keys() - kept:  # nothing goes that has no like
        assert not sets[i] or max(like(i, j) for j in sets if j != i) > 0.75
    alike = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and like(a, b) >= 0.8]
    assert sum(not {a, b} <= kept for a, b in alike) >= 0.9 * len(alike)
    one_table = {r["doc_id"] for r in rows(simhash.representatives(spark.createDataFrame(every, "doc_id long, text string"), tables=1))}
    assert len(kept) < len(one_table)


def test_shingle_sets_equal_plain_python(spark):
    texts = [(1, "A b  c\td e f"), (2, "a B c d e f g\x0b"), (3, None), (4, "É only"), (5, "é only"), (6, "x " * 50)]
    got = {r["node"]: set(r["shingles"]) for r in simhash.shingle_sets(spark.createDataFrame(texts, "node long, text string")).collect()}
    sets = {i: shingle_set(t or "") for i, t in texts}
    assert {i: len(s) for i, s in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(len(got[i] & got[j]) == len(sets[i] & sets[j]) for i in got for j in got)


def test_most_bits_follows_the_similarity():
    assert simhash.most_bits(512, 1.0) == 0 and simhash.most_bits(512, 0.9) < simhash.most_bits(512, 0.8) < 128


def test_simhash_odd_rows(spark, odd, none):
    out = rows(simhash.near_duplicates(odd))
    assert len(out) == len(ODD)
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in out if r["doc_id"] in (4, 5)} == {4}
    assert next(r for r in out if r["doc_id"] == 1)["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(r["doc_id"] or -1 for r in rows(simhash.representatives(odd))) == [-1, 1, 4, 6, 7, 8, 9, 10]
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).withColumnRenamed("id", "fp"), 3)


def test_representatives_of_null_and_repeated_keys(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    data = [(None, near, "a")] * 20 + [(None, near, "b")] * 5 + [(7, near, "a"), (7, near, "a"), (8, near, "c")] + [(None, f"lone text number {i} and more of it {i}", None) for i in range(6)] + [(None, None, None)] * 9
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumns({"row_a": F.lit(1), "fp": F.lit("x"), "name": F.lit(2)})
    out = rows(simhash.representatives(df))
    assert [r["doc_id"] for r in out if r["text"] == near] == [7] and sum(r["text"] is None for r in out) == 1 and len(out) == 8
    assert list(out[0]) == df.columns


def test_components_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 900L, 901L union all select 5L, 5L union all select null, 3L"))
    got = {r["node"]: r["component"] for r in rows(components.components(chain))}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


# 6


def test_mixing_meets_its_targets(spark, docs):
    out = mixing.mix(docs).toPandas()
    text = docs.toPandas().set_index("doc_id")["text"]
    assert (out.set_index("doc_id")["size"] == text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))).reindex(out["doc_id"])).all()
    by = out.groupby("source").agg(size=("size", "sum"), s=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["s"]).all() and (abs(by["taken"] - by["target"]) <= 1).all()
    assert (out["taken"] <= 3 * out["size"]).all() and by["target"].sum() == pytest.approx(by["size"].sum())
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mixing_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1}, 210) == {"a": 30.0, "b": 90.0, "c": 90.0}
    # a pattern that counts for two sources helps the one that lacks tokens, and repeats only what it must
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 15})
    assert sum(given.values()) == 25 and given[("b",)] + given[("a", "b")] >= 15
    assert mixing.route({("a",): 10}, {"a": 35}) == {("a",): 30}
    assert mixing.route({(): 5, ("a",): 0}, {"a": 3}) == {(): 0, ("a",): 0}


def cheapest(patterns, quotas, repeats):
    """The most that can be routed, and its least cost, by trying all."""
    arcs = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    for way in itertools.product(*[range(min(repeats * patterns[p], quotas[s]) + 1) for p, s in arcs]):
        gives, gets = dict.fromkeys(patterns, 0), dict.fromkeys(quotas, 0)
        for (p, s), n in zip(arcs, way, strict=True):
            gives[p] += n
            gets[s] += n
        if all(gives[p] <= repeats * patterns[p] for p in patterns) and all(gets[s] <= quotas[s] for s in quotas):
            cost = sum(repetition(gives[p], patterns[p]) for p in patterns)
            best = max(best, (sum(gives.values()), -cost))
    return best


def repetition(given, size):
    return sum(max(0, min(given - r * size, size)) * r * (r + 1) // 2 for r in range(3)) if size else 0


def test_mixing_flow_is_the_cheapest(monkeypatch):
    calls, flow = [], mixing.flow
    monkeypatch.setattr(mixing, "flow", lambda *a: calls.append(1) or flow(*a))
    rng = np.random.default_rng(6)
    for _ in range(25):
        patterns = {p: int(rng.integers(0, 4)) for p in [("a",), ("a", "b"), ("b",)] if rng.random() < 0.8}
        quotas = {"a": int(rng.integers(0, 7)), "b": int(rng.integers(0, 7))}
        given = mixing.route(patterns, quotas)
        total, cost = cheapest(patterns, quotas, 3)
        assert (sum(given.values()), -sum(repetition(given[p], patterns[p]) for p in patterns)) == (total, cost)
    assert calls


def test_mixing_refuses_what_it_cannot_hold(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b", f"s{i}", ["x"]) for i in range(6)], "doc_id long, text string, source string, member array<string>")
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    for member in (None, "member"):
        with pytest.raises(ValueError, match="over 2"):
            mixing.mix(df, member=member)


def test_mixed_rows_of_null_and_repeated_keys(spark):
    data = [(None, f"w{i} " * 10, "a") for i in range(20)] + [(3, "x y z", "b")] * 4 + [(None, None, None), (None, "", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"mix_size": F.lit("mine"), "taken": F.lit(1)})
    sizes, out = mixing.mix(df).toPandas(), rows(mixing.repeated(df))
    assert len(sizes) == len(data) and list(out[0]) == df.columns
    times = {}
    for r in out:
        times[r["text"]] = times.get(r["text"], 0) + 1
    assert all(n <= 3 for t, n in times.items() if t != "x y z") and times["x y z"] <= 12
    for name, own in sizes[sizes["size"] > 0].groupby("source"):
        got = sum(len(r["text"].split()) for r in out if r["source"] == name)
        assert abs(got - own["target"].iloc[0]) <= own["size"].max()


def test_mixing_takes_the_rows_of_the_seeded_order(spark):
    """Plain Python: of each source whole passes, and the rest from its rows in order; half of all rows are one row."""
    table = [(i, "w " * (i % 13), f"s{i % 3}") for i in range(300)] + [(7, "one hot row", "s1")] * 600 + [(None, "a b", None)] * 40
    df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(9)
    order = {(r["doc_id"], r["text"], r["source"]): (r["h"], r["tie"]) for r in rows(mixing.measured(df, "doc_id", "text", "source", None, mixing.SEED, {c: c for c in mixing.PLACES}))}
    sizes = {s: sum(len(t.split()) for _, t, x in table if x == s) for s in ("s0", "s1", "s2", None)}
    want = mixing.targets(sizes, {"s0": 1, "s1": 2, "s2": 3, None: 1}, sum(sizes.values()))
    taken = []
    for s, n in sizes.items():
        passes, rest = divmod(round(want[s]), n)
        for doc, text, _ in sorted((r for r in table if r[2] == s), key=lambda r: order[r]):
            more = min(len(text.split()), rest)
            rest -= more
            taken.append((str(doc), str(s), len(text.split()), passes * len(text.split()) + more))
    for cut in (df, df.coalesce(1)):
        assert sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in rows(mixing.mix(cut))) == sorted(taken)


def test_mixing_flow_of_many_patterns():
    many = {tuple(f"s{x}" for x in sorted({i % 97, i % 89, i % 83})): 10 + i % 7 for i in range(20_000)}
    quotas = {f"s{i}": 2 * sum(many.values()) // 100 for i in range(97)}
    began = time.process_time()
    given = mixing.route(many, quotas)
    assert time.process_time() - began < 60 and all(0 <= given[p] <= 3 * n for p, n in many.items())
    assert sum(given.values()) == sum(quotas.values())


def test_mixing_odd_rows(spark, odd, none):
    out = mixing.mix(odd).toPandas()
    assert len(out) == len(ODD) and (out["taken"] <= 3 * out["size"]).all()
    by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 1).all() and by["size"].sum() == by["target"].sum()
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    lists = odd.withColumn("sources", F.when(F.col("doc_id") != 6, F.array("source", F.lit("b"))))
    assert mixing.mix(lists, member="sources").count() == len(ODD)


# 7


@pytest.fixture(scope="module")
def tokenizer():
    return unigram.Tokenizer(unigram.read_pieces(queries.PIECES))


def best_cuts(tok, unit):
    """Score of the best cut of a unit, by trying all."""
    pieces = {tok.out_bytes[a : a + n].tobytes().decode(): s for a, n, s in zip(tok.out_starts, tok.out_lengths, tok.scores, strict=True) if n and s < 0}
    best = {0: 0.0}
    for j in range(1, len(unit) + 1):
        ways = [best[i] + pieces[unit[i:j]] for i in range(j) if unit[i:j] in pieces]
        best[j] = max([*ways, best[j - 1] + tok.unknown] if unit[j - 1] not in pieces else ways)
    return best[len(unit)]


def test_unigram_best_cut_and_round_trip(tokenizer, docs):
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", "a", " ", "  two  spaces ", "\n\ttabs\n", "東京 ½ \U0001f600", "x" * 300, "hest"]
    ids, counts = tokenizer.encode_batch(texts)
    assert tokenizer.decode_batch(ids, counts) == texts
    for text, end, n in zip(texts, counts.cumsum(), counts, strict=True):
        assert ids[end - n : end].tolist() == [i for u in tokenizer.units(text) for i in tokenizer.cut_one(u.encode())]
    for unit in {u for t in texts[:6] for u in tokenizer.units(t) if len(u) < 30 and "\n" not in u}:
        assert tokenizer.scores[tokenizer.cut_one(unit.encode())].sum() == pytest.approx(best_cuts(tokenizer, unit))


def test_unigram_agrees_with_the_library(tokenizer):
    spm, pb = pytest.importorskip("sentencepiece"), pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(queries.PIECES, "rb").read())
    m.trainer_spec.model_type = 1
    lib = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    words = sorted({w for t in pd.read_parquet(f"{SF}/documents.parquet")["text"] for w in t.split()})[:3000]
    same = 0
    for w in words:
        own, theirs = tokenizer.encode_batch([w])[0], lib.encode(w)
        same += own.tolist() == theirs
        assert tokenizer.scores[own].sum() >= tokenizer.scores[theirs].sum() or 0 in tokenizer.scores[own]
    assert same > 0.98 * len(words)


def test_sentencepiece_frames(spark, odd, none):
    out = unigram.encode(odd, queries.PIECES, decoded=True)
    got = {r["doc_id"]: r for r in rows(out)}
    assert got[1]["decoded"] is None and got[1]["n_tokens"] == 0 and got[2]["decoded"] == "" and out.count() == len(ODD)
    assert all(got[i]["decoded"] == (t or "").replace("▁", " ") for i, t, *_ in ODD if t is not None)
    back = {r["doc_id"]: r["text"] for r in rows(unigram.decode(out.withColumn("text", F.lit("clash")), queries.PIECES))}
    assert back[9] == ODD[-1][1].replace("▁", " ") and back[8] == "x" * 50_000
    assert unigram.encode(none, queries.PIECES).count() == 0


# 8


def brute_sigs(text):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    common = set(spotsigs.COMMON)
    starts = [i + 1 for i, w in enumerate(words) if w in common and i + 1 < len(words) and words[i + 1] not in common]
    segments = [" ".join(list(itertools.takewhile(lambda x: x not in common, words[s:]))) for s in starts]
    out = [" ".join(" ".join(segments[j : j + 3]).split()[:3]) for j in range(len(segments))]
    return set(out) | {"=" + w for w in words[: spotsigs.HEAD]}


def test_spotsigs_matches_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in rows(spotsigs.near_edits(docs))}
    base = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    for (i, text), (_, after) in zip(base, base[1:] + base[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = brute_sigs(text), brute_sigs(edited), brute_sigs(after)
        share = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(share(a, b)) and got[i]["near_next"] == pytest.approx(share(a, c))
        assert got[i]["fingerprint"].startswith(f"{len(a)}:")


def test_spotsigs_odd_rows_and_pairs(spark, odd, none):
    out = rows(spotsigs.near_edits(odd))
    assert len(out) == len(ODD) and all(r["near_edited"] is not None and r["near_next"] is not None for r in out)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (4, 5)}) == 1
    assert spotsigs.near_edits(none).count() == 0
    same = spark.createDataFrame([("2:ab:-5,7", "2:ab:-5,7"), ("2:ab:-5,7", "3:cd:-5,1,9"), ("0:e:", "1:f:4")], "a string, b string").select(spotsigs.sketch_likeness("a", "b"))
    assert [r[0] for r in same.collect()] == [1.0, 0.25, 0.0]
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(6):
        base = list(rng.choice(words, 60))
        for v in range(4):
            own = list(base)
            for _ in range(v):
                own[rng.integers(60)] = "z"
            texts.append((len(texts), " the ".join(own)))
    df = spark.createDataFrame(texts + [(99, texts[0][1])], "doc_id long, text string")
    members, pairs = spotsigs.near_duplicates(df)
    of = {r["doc_id"]: r["class_id"] for r in rows(members)}
    assert of[99] == of[0]
    sets = {of[i]: brute_sigs(t) for i, t in texts}
    want = {frozenset((a, b)) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {frozenset((r["class_a"], r["class_b"])) for r in rows(pairs)} == want and want


# 9


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda r: len(r[0]), default=None)


ODD_URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "https://a.Example.COM/en/x?q=/fr/#f", "http://www.example.com/en/", "http://x.www.example.com/en/1", "http://notexample.com/en/", "http://net/es/", "http://a.net/fr/x", "http://a.net/fr", "a://b://c/d", "http://a.org/1\n2/é"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").withColumn("host", F.lit(""))
    for r in rows(url_filter.judge(pages)) + rows(url_filter.judge(table)):
        host, path, rule = brute_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), r
        assert r["verdict"] == rule[1] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages).count() == len(ODD_URLS) and url_filter.judge(pages.limit(0)).count() == 0


def test_url_tree_learns_templates(spark):
    rules = [("bad.test", "/shop/a", "block"), ("bad.test", "/shop/b", "block"), ("bad.test", "/news/1", "allow")]
    urls = [f"http://bad.test/shop/{x}{i}" for i in range(60) for x in "abc"] + [f"http://bad.test/news/{i}" for i in range(40)]
    got = rows(url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules=rules))
    free = [r for r in got if r["rule"] is None]
    assert all(r["verdict"] == ("block" if "/shop/" in r["url"] else "allow") for r in free) and {r["template"] for r in free} == {"shop/*", "news/*"}


def test_url_tree_decides_pages_below_no_rule(spark):
    rules = [("a.test", "/x/p", "block"), ("a.test", "/x/q", "block"), ("a.test", "/y/", "allow"), ("b.test", "/one/", "block")]
    urls = [f"http://a.test/x/{s}/t" for s in "pq" for _ in range(30)] + ["http://a.test/y/t"] * 60 + ["http://b.test/one/t"] * 30
    free = {"http://a.test/x/new/deep/er": "block", "http://a.test/y": "allow", "http://a.test/z/t": "allow", "http://b.test/two/t": "block", "http://c.test/one/t": "allow"}
    table = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *free])], "page_id long, url string")
    got = {r["url"]: r for r in rows(url_filter.judge(table, rules=rules))}
    assert {u: got[u]["verdict"] for u in free} == free and all(got[u]["rule"] is None for u in free)
    assert got["http://a.test/x/p/t"]["template"] == got["http://a.test/x/q/t"]["template"] == "x/?/t"  # merged at an inner node


def test_url_templates_by_distinct_paths_and_levels(spark):
    paths = [f"/user/u{i}x/post/p{i}y" for i in range(30)] + [f"/a/b/c/d/e/f/g/{x}" for x in ("h", "i")]
    want = {p: "user/*/post/*" if "user" in p else p[1:] for p in paths}
    for urls in ([f"http://a.test{p}" for p in paths], [f"http://a.test{p}?n={k}" for p in paths for k in range(3)], [f"http://a.test{p}" for p in paths] * 4):
        got = rows(url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules=[]))
        assert len(got) == len(urls) and {r["path"]: r["template"] for r in got} == want


# 10


def test_language_held_out_accuracy(spark):
    out = queries.op10_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet"), on="doc_id")
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and out["rejected"].mean() < 0.01
    assert out["score"].between(0, 1).all()


def test_kneser_ney_sums_to_one_and_matches_the_formula():
    words = ["banana", "bandana", "cab", "abba", "nab"] * 3
    keys, sizes = language_id.keys5(words)
    distinct, n = np.unique(keys, return_counts=True)
    model = language_id.fit(["x"], {"x": (distinct, n.astype(float))})
    ends = np.unique(distinct & 4095)
    context = keys[3] >> 12 << 12
    shift = (context << 12) & ((1 << 60) - 1)
    p = np.exp(-model.nats(shift | ends))[:, 0]
    assert 0.9 < p.sum() <= 1 + 1e-9  # the rest is for characters never seen
    # order by order, by dictionaries
    table = dict(zip(distinct.tolist(), n.tolist(), strict=True))
    levels = [table]
    for order in range(4, 0, -1):
        below: dict = {}
        for k in levels[0]:
            below[k & ((1 << 12 * order) - 1)] = below.get(k & ((1 << 12 * order) - 1), 0) + 1
        levels.insert(0, below)
    want = 1 / (1 + len(ends))
    key = int(keys[5])
    for order, level in enumerate(levels, 1):
        once, twice = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        own = key & ((1 << 12 * order) - 1)
        same = {k: v for k, v in level.items() if k >> 12 == own >> 12}
        if same:
            want = max(level.get(own, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * want
    assert np.exp(-model.nats(keys[5:6]))[0, 0] == pytest.approx(want)


def test_language_needs_letters(spark, odd):
    model = language_id.train(odd)
    df = spark.createDataFrame([(1, "½ ² ① Ⅷ ৪ 12 _"), (2, "½ a"), (3, "東")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in rows(language_id.identify(df, model))} == {1: True, 2: False, 3: False}


def test_language_odd_rows(spark, odd, none):
    model = language_id.train(odd)
    out = {r["doc_id"]: r for r in rows(language_id.identify(odd, model))}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (1, 2, 3, 6))
    assert out[4]["lang_pred"] in ("en", "de") and language_id.identify(odd, model).count() == len(ODD)
    empty = language_id.train(none)
    assert {r["lang_pred"] for r in rows(language_id.identify(odd, empty))} == {"und"} and language_id.identify(none, empty).count() == 0
    assert language_id.accepted(odd, model).columns == odd.columns


@pytest.mark.parametrize("sizes", [(2, 1024, 256), (1, 4, 4), (3, 2, 2)])
@pytest.mark.parametrize("kind", ["far", "hashed", "hot"])
def test_spotsigs_next_row(spark, monkeypatch, sizes, kind):
    for name, value in zip(("BLOCK", "OUTER", "INNER"), sizes, strict=True):
        monkeypatch.setattr(spotsigs, name, value)
    rng = np.random.default_rng(1)
    ids = {"far": [None, -9, 0, 1, 2, 3, 5, 40, 41, 1000, 1_000_000], "hashed": rng.integers(-(1 << 62), 1 << 62, 150).tolist(), "hot": [1] * 60 + [2, 3, None, None, 8] + [7] * 30}[kind]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    blocks = spotsigs.with_block(df.withColumn("tie", F.xxhash64("text")), "doc_id", "tie").groupBy("_block", "_sub").count().toPandas()["count"]
    assert sizes[1] < 1024 or blocks.max() <= 8 * sizes[0]
    order = sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["tie"], r["text"]) for r in df.withColumn("tie", F.xxhash64("text")).collect())
    got = {r["text"]: r["next_text"] for r in spotsigs.with_next(df, "doc_id", "text", lambda d: d, ["text"]).collect()}
    assert got == {a[2]: b[2] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_spread_join_equals_a_join(spark):
    from pairlens.llm.common import spread_join

    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, -1, id % 7) as k")
    few = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = {(r["id"], r["top"]) for r in left.join(few, "k").collect()}
    for hot in (2, 4, 1000):
        got = spread_join(left, few, "k", "n", hot).collect()
        assert len(got) == 3000 and {(r["id"], r["top"]) for r in got} == want
    assert spread_join(left.limit(0), few.limit(0), "k", "n").count() == 0
