"""The engine on hand-computed cases, and some of its queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pairlens import oracles, queries
from pairlens.functions import metrics, parsing, text
from pairlens.operators import hybrid, lattice, matchers, pairs, search, support
from pairlens.sources import generate, io

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()])


def value(df):
    return df.first()[0]


@pytest.mark.parametrize("name", ["pair_merge_robust", "cosine_pairs", "support_set", "attr_saliency", "counterfactuals", "token_paths", "kendall", "faithfulness", "lattice_algebra", "lattice_edges", "noisy_sources", "noise_f1"])
def test_query_matches_sql(spark, name):
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duckdb.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    numbers = lambda df: df.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" else c)
    assert shown(numbers(got)) == shown(numbers(want))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


def test_algebra_of_found_subsets(spark):
    random.seed(3)
    found = {(p, s): {random.randrange(1, 31) for _ in range(random.randrange(1, 6))} for p in "abcdefgh" for s in "LR"}
    df = spark.createDataFrame([(p, s, m) for (p, s), masks in found.items() for m in masks for _ in range(2)] + [("z", "L", None)], "pair_id string, side string, mask int")
    got: dict = {}
    closed = lattice.algebra(df)
    for r in closed.collect():
        got.setdefault((r["pair_id"], r["side"]), {})[r["mask"]] = (r["origin"], r["minimal"], r["maximal"])
    edges = {tuple(r) for r in lattice.covers(closed, 5).collect()}
    want_edges = set()
    for at, masks in found.items():
        joins, every = set(masks), set()
        while (more := joins | {a | b for a in joins for b in joins}) != joins:
            joins = more
        every = set(joins)
        while (more := every | {a & b for a in every for b in every} | {a | b for a in every for b in every}) != every:
            every = more
        inside = lambda a, b: a != b and a & b == a
        assert got[at] == {m: ("found" if m in masks else "join" if m in joins else "meet", int(m in masks and not any(inside(x, m) for x in masks)), int(m in masks and not any(inside(m, x) for x in masks))) for m in every}
        want_edges |= {(*at, a, b) for a in every for b in every if inside(a, b) and not any(inside(a, x) and inside(x, b) for x in every)}
    assert edges == want_edges and set(got) == set(found)
    assert lattice.algebra(df.limit(0)).count() == 0


def test_noisy_copies(spark):
    df = spark.createDataFrame([(1, "steel package of hardware"), (2, None), (3, ""), (3, ""), (4, "x " * 3000)], "id long, v string")
    got = {(r["id"], r["level"]): r["v"] for r in generate.noisy_copies(df, ["v"], "s", [0, 10]).collect()}
    assert sorted(got[1, 0].split()) == sorted("steel package of hardware".split()) and got[1, 10] != got[1, 0]
    assert got[2, 0] is got[2, 10] is None and got[3, 10] == "" and len(got[4, 0]) == 6000
    assert {tuple(r) for r in generate.truth(df).collect()} == {(i, i, 1) for i in (1, 2, 3, 4)} | {(1, 2, 0), (2, 3, 0), (3, 4, 0)}
    assert generate.truth(df.limit(0)).count() == 0


def test_cosine_rbo_ndcg(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    df = one(spark, a=arr("a", "b", "b"), b=arr("b", "c"), x=arr("a", "b", "c"), y=arr("b", "a", "d"), none=arr())
    r = df.select(text.count_cosine(F.col("a"), F.col("b")).alias("cos"), text.count_cosine(F.col("a"), F.col("none")).alias("zero"), metrics.rbo(F.col("x"), F.col("y")).alias("rbo"), metrics.rbo(F.col("x"), F.col("x")).alias("self"), metrics.ndcg(F.col("x"), F.array(F.lit("b"), F.lit("c"))).alias("ndcg"), metrics.kendall(F.col("x"), F.col("x")).alias("tau")).first()
    assert r["cos"] == pytest.approx(0.632456, abs=1e-6) and r["zero"] == 0
    assert r["rbo"] == pytest.approx(0.63) and r["self"] == pytest.approx(1.0)
    assert r["ndcg"] == pytest.approx(0.693426, abs=1e-6) and r["tau"] == 1


def test_ccc_auc_distances(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 4), (4, 4), (None, 1)], "t int, p int")
    assert value(metrics.concordance_correlation(df, "t", "p")) == pytest.approx(0.916667, abs=1e-6)
    assert value(metrics.concordance_correlation(df.limit(0), "t", "p")) is None
    points = spark.createDataFrame([(0.1, 1.0), (0.33, 0.8), (0.5, 0.5), (0.7, 0.5), (0.9, 0.2)], "x double, y double")
    assert value(metrics.auc(points, "x", "y")) == pytest.approx(0.4875)
    m = lambda s: F.create_map(*[F.lit(x) for i, v in enumerate(s) for x in (f"k{i}", v)])
    p, s = one(spark, a=m("wxyz"), b=m("wxyq")).select(*metrics.cf_distance(F.col("a"), F.col("b"))).first()
    assert (p, s) == (0.25, 0.875)
    two = spark.createDataFrame([(1, "a", "b", "c", "d"), (1, "a", "b", "c", "e")], "id int, k string, l string, m string, n string")
    assert metrics.diversity(two, "id", list("klmn")).first()["diversity"] == pytest.approx(0.125)


def test_subsequences_and_lattice(spark):
    got = {r["v"] for r in support.subsequences(spark.createDataFrame([(1, "a b c")], "id long, v string"), ["v"]).collect()}
    assert got == {"b c", "a", "c", "a b"}
    ranks = spark.createDataFrame([("p", "L", m, f, 2) for m, f in ((1, 1), (3, 2), (2, 0), (4, 0), (5, 0), (6, 0))], "pair_id string, side string, mask int, flips long, tried long")
    tri = spark.createDataFrame([("p",), ("p",)], "pair_id string")
    suff = lattice.sufficiency(ranks, tri)
    ps = {r["mask"]: r["sufficiency"] for r in suff.collect()}
    assert ps[1] == 0.5 and ps[3] == 1 and [r["mask"] for r in lattice.summary(suff).collect()] == [3]
    pn = {r["feature"]: r["saliency"] for r in lattice.saliency(ranks, ["x", "y", "z"]).collect()}
    assert pn["ltable_x"] == 1 and pn["ltable_y"] == pytest.approx(2 / 3) and pn["ltable_z"] == 0 == pn["rtable_x"]
    with pytest.raises(ValueError, match="choose at most"):
        lattice.subsets([str(i) for i in range(105)])


def test_answers(spark):
    df = spark.createDataFrame([("Yes.",), ("no",), ("1",), ("non-matching",), ("unsure",), (None,)], "a string")
    assert [r[0] for r in df.select(parsing.answer_to_match(F.col("a"), F.lit("unsure"))).collect()] == [1, 0, 1, 0, 0, 0]
    raw = ['```json\n{"match": "True", "saliency": {"x": 0.5}}\n```', 'so {"answers": {"1": "no", "3": {"y": "z"}}} there', "{broken", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "a string").select(parsing.parse_answer(F.col("a"))).collect()]
    assert [g["prediction"] for g in got] == [1, 0, None, None] and got[0]["saliency"] == {"x": 0.5} and got[1]["counterfactual"] == {"y": "z"}
    values = spark.createDataFrame([("0.5",), ("[0.25]",), ('{"saliency": 1}',), ("x",)], "a string")
    assert [r[0] for r in values.select(parsing.saliency_value(F.col("a"))).collect()] == [0.5, 0.25, 1.0, None]


def test_matchers_fail_apart_and_f1_of_nothing(spark):
    left, right, truth = generate.sources(spark, 40, 3, 10, 10)
    rows = pairs.merge(truth, left, right)

    def fails(pdf):
        raise RuntimeError("no service")

    got = matchers.PandasMatcher(fails, wait=0).score(rows).select("match_score", "status").distinct().collect()
    assert {r[0] for r in got} == {0.5} and "failed: RuntimeError" in {r[1] for r in got} <= {"failed: RuntimeError", "failed: not asked"}
    assert matchers.f1(rows.limit(0).withColumn("prediction", F.lit(1))).first()["f1"] == 0
    same = [generate.sources(spark.newSession(), 40, 3, 10, 10)[0].orderBy("id").collect() for _ in range(2)]
    assert same[0] == same[1]


def test_hybrid_combinations(spark):
    d = spark.createDataFrame([("p", 0, "a", 0.9), ("p", 0, "b", 0.5), ("p", 1, "b", 0.9), ("p", 1, "c", 0.1), ("p", 1, "a", -1.0)], "pair_id string, draw int, feature string, score double")
    names = lambda how: [r["feature"] for r in hybrid.combine(d, 2, how).orderBy("place").collect()]
    assert names("freq") == ["b", "a"] and names("union") == ["a", "b", "c"] and names("intersection") == ["b"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n\n2,y\n")
    assert io.read_records(spark, str(tmp_path / "a.csv"), ["name"]).count() == 2
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.json").write_text('{"data": [{"id": 1, "prediction": "yes", "saliency": {"x": "1"}}], "total_time": 2}')
    (tmp_path / "r" / "two.json").write_text('[{"id": 2, "label": 1}]')
    assert {(r["file"], r["id"]) for r in io.read_results(spark, str(tmp_path / "r")).collect()} == {("one.json", 1), ("two.json", 2)}
    (tmp_path / "p.txt").write_text("system::be brief\nuser::{ltuple}\n")
    assert [(r["role"], r["content"]) for r in io.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == [("system", "be brief"), ("user", "{ltuple}")]


@pytest.mark.parametrize("block", [13])
@pytest.mark.parametrize("name", ["threshold_candidates", "candidate_topk_whole", "support_set"])
def test_whole_search_matches_sql(spark, name, block, monkeypatch):
    for setting, n in {"BLOCK": block, "MORE": 2, "SMALL": 0}.items():
        monkeypatch.setattr(search, setting, n)
    test_query_matches_sql(spark, name)


def test_explain_searches_the_whole_source(spark):
    left = spark.createDataFrame([(i, f"filler{i} word{i} x{i}") for i in range(300)] + [(999, "red steel bolt nine")], "id long, name string")
    right = spark.createDataFrame([(1, "red steel bolt nine")] + [(i, f"other{i} thing{i}") for i in range(2, 300)], "id long, name string")
    rows = pairs.merge(spark.createDataFrame([(0, 1, 0)], "ltable_id long, rtable_id long, label int"), left, right)
    best = support.candidates(rows, left, right).where("side = 'L' and place = 1").first()
    assert (best["c_id"], best["c_decision"]) == (999, 1) and best["score"] == 1
