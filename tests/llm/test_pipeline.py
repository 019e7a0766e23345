import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairlens.llm import common, language_id, quality, simhash
from pairlens.llm.common import durable, read

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    first = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "SimHash near-dedup", "mixing", "SentencePiece encoding"]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = durable(stage(spark, docs, SF))
        kept.append(docs)
        if docs.columns != first.columns:
            break
    lang, good, one, mixed, ids = kept
    model = language_id.train(first)
    rejected = {r["doc_id"] for r in language_id.identify(first, model).where("rejected").collect()}
    assert {r["doc_id"] for r in lang.collect()} == {r["doc_id"] for r in first.collect()} - rejected
    scores = {r["doc_id"]: r["score"] for r in quality.scores(lang, quality.train(lang, read(spark, SF, "labels"))).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, s in scores.items() if s >= 0.5}
    assert {r["doc_id"] for r in one.collect()} < {r["doc_id"] for r in good.collect()}
    assert one.select("text").distinct().count() == one.count()
    assert 0 < mixed.count() and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in one.collect()}
    assert ids.count() == mixed.count() == before.count() and ids.where("n_tokens = 0").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == ids.count()


def test_stages_on_odd_tables(spark):
    docs = read(spark, SF, "documents")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).withColumns({"size": F.lit("mine"), "score": F.lit(1), "row_a": F.lit(2)})
    many = odd.unionByName(odd.where("doc_id % 5 = 0")).unionByName(odd.limit(3).withColumn("text", F.lit(None).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, many = many, durable(stage(spark, many, SF))
        assert many.columns == odd.columns and 0 < many.count()
        if stage is not corpus_pipeline.mixed:
            assert many.count() <= before.count()
    copies = many.groupBy(*[c for c in many.columns]).count().agg(F.max("count")).first()[0]
    assert copies <= 3  # as many as the mix repeats, whatever the ids
    assert corpus_pipeline.tokens(spark, many, SF).count() == many.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = durable(stage(spark, none, SF))
        assert none.count() == 0


def test_run_leaves_only_the_stages_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert len(list(tmp_path.glob("table-*"))) == len(corpus_pipeline.STAGES) and out.count() > 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())
