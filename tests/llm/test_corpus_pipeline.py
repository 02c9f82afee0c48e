"""The stages after one another, each against what it must do to its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from framewise.llm import simhash, suffix_dedup
from framewise.llm.common import DOCUMENT_COLUMNS, documents, write_table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = documents(spark, sf_dir), {}
    for name, stage in pipeline.STAGES:
        docs, _ = write_table(stage(spark, docs, sf_dir))
        out[name] = docs
    return out


def test_shape(stages):
    assert list(stages) == ["quality_classifier", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    for name, df in list(stages.items())[:-1]:
        assert tuple(df.columns) == DOCUMENT_COLUMNS and df.count() > 0
        assert df.where("n_chars != length(text)").count() == 0


def test_decisions_take_effect(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = stages["quality_classifier"].join(labels, "doc_id")
    assert good.where("quality = 1").count() >= 0.95 * labels.where("quality = 1").count()
    assert good.where("quality = 0").count() <= 0.2 * labels.where("quality = 0").count()
    near = simhash.near_duplicates(stages["simhash_near_dedup"])
    assert near.where("doc_id != component_id").count() == 0
    left = suffix_dedup.passages(stages["suffix_array_dedup"])
    before = suffix_dedup.passages(stages["simhash_near_dedup"])
    assert left.count() <= 0.1 * max(1, before.count())


def test_packing_takes_all(stages):
    packed = stages["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in stages["suffix_array_dedup"].collect()}


def test_run_is_the_stages(spark, sf_dir, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(pipeline.run(spark, sf_dir).select(key).collect()) == sorted(stages["packing"].select(key).collect())
