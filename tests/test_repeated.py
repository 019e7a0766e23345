"""Tables that repeat their records: equal texts and equal pairs are worked out once, with the results of all."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pairlens import oracles, queries, studies
from pairlens.operators import pairs, search, support
from tests.test_engine import SF


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repeated"))
    duckdb.sql(f"copy (select p_partkey + 1000 * j as p_partkey, * exclude (p_partkey) from '{SF}/part.parquet' cross join (select unnest(range(3)) as j) where p_partkey < 60) to '{at}/part.parquet' (format parquet)")
    return at


@pytest.mark.parametrize("name", ["candidate_topk", "triangles", "counterfactuals"])
def test_repeated_records_match_sql(spark, repeated, name):
    duckdb.sql(f"create or replace view part as from '{repeated}/part.parquet'")
    got, want = queries.QUERIES[name](spark, repeated).toPandas(), duckdb.sql(oracles.ORACLES[name]).df()
    numbers = lambda df: df.apply(lambda c: c.astype(float).round(6) + 0.0 if c.dtype.kind in "iuf" else c)
    shown = lambda df: sorted(map(str, numbers(df[sorted(df.columns)]).itertuples(index=False, name=None)))
    assert shown(got) == shown(want)


def test_equal_pairs_are_explained_once(spark, repeated):
    e = queries.explained(spark, repeated)
    values = [p + a for p in ("ltable_", "rtable_") for a in e.names]
    assert e.distinct.rows.count() == e.rows.select(values).distinct().count() < e.rows.count() / 2
    assert e.distinct.support.count() < e.support.count() / 2


def test_equal_texts_are_searched_once(spark, monkeypatch):
    seen = []
    for name in ("most_alike", "least_alike"):
        monkeypatch.setattr(search, name, lambda texts, source, k, f=getattr(search, name): seen.append((texts.count(), source.count())) or f(texts, source, k))
    monkeypatch.setattr(search, "SMALL", 0)
    kinds = ["red bolt a", "bolt Red a", "red nut b", "blue cap a", "odd"]
    records = [(i, kinds[i % 5]) for i in range(50)]
    source = spark.createDataFrame(records, "c_id long, c_text string")
    asked = spark.createDataFrame([(t, m) for t in ("red bolt", "BOLT red") for m in (True, False)], "text string, most boolean")
    got = {}
    for r in support.scored_whole(asked, source, 12).collect():
        got.setdefault((r["text"], r["most"]), []).append((r["score"], r["c_id"]))
    assert seen == [(1, 4), (1, 4)]  # two of the five texts have equal words
    every = {i: support.search.scores([["red", "bolt"]], [t.lower().split()])[0, 0] for i, t in records}
    high, low = (sorted(every.items(), key=lambda x: (sign * x[1], x[0]))[:12] for sign in (-1, 1))
    for (_, most), found in got.items():
        assert sorted(found) == sorted((s, i) for i, s in (high if most else low))
    assert len(got) == 4
    above = support.scored_whole(asked.where("most"), source, least=0.5).groupBy("text").agg(F.count("*").alias("n")).collect()
    assert {r["n"] for r in above} == {sum(s >= 0.5 for s in every.values())}


@pytest.mark.parametrize("copied", [True, False])
def test_supports_are_those_of_all_candidates(spark, repeated, copied):
    rows, (left, right) = pairs.distinct(queries.rows_of(spark, repeated))[0], queries.sources(spark, repeated)
    found = support.candidates(rows, left, right)
    want = support.balanced(support.augmented(found, rows) if copied else found)
    got = support.supports(rows, left, right, copied=copied)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_draws_need_no_flips_and_flips_no_values(spark, repeated):
    e = queries.explained(spark, repeated)
    drawn = queries.draws(e).select("pair_id", "feature").distinct()
    assert "flips" not in e.distinct.__dict__
    assert sorted(drawn.collect()) == sorted(e.saliency.select("pair_id", "feature").collect())
    assert e.distinct.flips.columns == ["pair_id", "triangle_id", "side", "mask", "flip", "asked"]


def test_equal_pairs_are_told_to_a_model_once(spark, repeated, monkeypatch):
    asked = []
    monkeypatch.setattr(studies.SelfExplainer, "explain", lambda self, rows, f=studies.SelfExplainer.explain: asked.append(rows.count()) or f(self, rows))
    (told,) = studies.results(spark, repeated, "self")
    assert asked[0] < told.count() / 2 and told.count() == queries.rows_of(spark, repeated).count()
