"""The pipeline's stages on empty tables, null ids and clashing columns, and on what a text may be."""

import corpus_pipeline
import pytest
from helpers import DOC, docs, words
from pyspark.sql import functions as F

COLUMNS = [c.split()[0] for c in DOC.split(", ")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_an_empty_table(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, spark.createDataFrame([], DOC), sf_dir)
    assert got.count() == 0 and (name == "packing" or got.columns == COLUMNS)


def test_rows_without_an_id_stay(spark, sf_dir):
    """Of rows with null ids none can be told from another, so none goes as a copy; secrets in them go all the same."""
    text = " ".join(words(80, 1, 5000))
    rows = [(None, text, "en", "s", 1), (None, text, "en", None, 1), (7, text, None, "s", None), (8, text + " token = abcdef0123456789abcdef01", "en", "s", 1), (9, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, DOC)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, d, sf_dir)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [7, 9, None, None]
    clean = {r.doc_id: r.text for r in stages["secret scans"](spark, d, sf_dir).collect()}
    assert clean[8] == text + " [SECRET]" and clean[9] is None
    mixed = stages["mixing sources to target weights"](spark, d, sf_dir)
    assert mixed.columns == COLUMNS and mixed.count() >= 1
    assert stages["packing"](spark, d, sf_dir).where("doc_id is null").count() >= 2


def test_a_very_long_text_passes_whole(spark, sf_dir):
    long = " ".join(words(150_000, 3, 20_000))
    d = docs(spark, [long, long + " end", "a short one of its own"])
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in stages["n-gram Jaccard join"](spark, d, sf_dir).collect()) == [0, 2]
    pieces = stages["packing"](spark, d.where("doc_id = 0"), sf_dir).agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).first()
    assert pieces.n == pieces.m > 150_000
