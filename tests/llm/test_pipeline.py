"""The corpus pipeline: what each stage decides takes effect, and all it keeps goes on."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontam, minhash


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, counts = docs, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "encoding"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        counts.append(after.count())
        before = after
    assert counts[0] == counts[1] >= counts[2] >= counts[3] == counts[4] > 0.6 * docs.count()
    third = spark.read.parquet(f"{tmp_path}/3")
    assert decontam.decontaminate(third, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    assert minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/2")).where("not kept").count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id")
    assert labels.join(kept, "doc_id", "left_anti").count() <= 0.02 * labels.count() + 1


def test_empty_corpus(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_null_rows(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0)], docs.schema))
    assert corpus_pipeline.STAGES[stage][1](spark, odd, sf_dir).where("doc_id IS NULL").count() == 2


def test_near_duplicates_by_row(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (None, a), (None, a), (2, b), (2, c), (3, c), (None, b + " more"), (None, "alone here"), (4, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, sf_dir).collect() if r["text"])
    texts = [t for _, t in got]
    assert len(got) == 4 and {a, c, "alone here"} < set(texts) and ("1", a) in got and ("3", c) in got and sum(t.startswith(b) for t in texts) == 1


def test_contamination_by_row(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(None, item), (1, item), (1, "a clean text of that id"), (2, "clean"), (None, "clean too")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in corpus_pipeline.drop_contaminated(spark, df, sf_dir).collect()) == ["a clean text of that id", "clean", "clean too"]


def test_toxicity_by_row(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    foul = "you stupid idiot moron, worthless pathetic scum and filth, disgusting loser trash " * 3
    rows = [(None, foul), (1, foul), (1, "a kind word about the garden and the weather today"), (2, "the cat sat on the mat")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["text"] for r in corpus_pipeline.drop_toxic(spark, df, str(tmp_path)).collect())
    assert (foul in kept) == (kept.count(foul) == 2) and "the cat sat on the mat" in kept


def test_empty_benchmark(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()
