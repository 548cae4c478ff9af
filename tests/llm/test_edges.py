"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontam, langid, line_dedup, minhash, quality_model, quality_rules, sentencepiece_codec, sharding, toxicity, url_filter
from tidewatch.llm.common import pick

LONG = "the long text of many words " * 20_000
ROWS = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "a", None), (5, LONG, "en"), (6, "the quick brown fox jumps over the lazy dog again", "en"), (6, "the quick brown fox jumps over the lazy dog again", "en"),
    (None, "le chat est sur la table et il dort", "fr"), (7, "le chat est sur la table et il dort", "fr"), (8, "le chat\n\nle chat\n", "xx"), (9, "🙂 \u0000 ​ é", "de"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns that clash with outputs, or with inputs but for case."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    df = df.select("*", F.lit(1).alias("n_words"), F.lit("x").alias("score"), F.lit("y").alias("kept"))
    return df.toDF(*df.columns).select("doc_id", "text", "lang", "n_words", "score", "kept", F.lit("z").alias("TEXT"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "lazy dog"), (4, "the quick brown fox jumps over the lazy dog"), (4, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")


def operators(docs, labels, benchmark):
    spark = docs.sparkSession
    return {
        "langid": lambda d: langid.predict(d, langid.train(d)),
        "quality_rules": quality_rules.quality_rules,
        "quality_model": lambda d: quality_model.score_quality(d, labels),
        "line_dedup": line_dedup.dedup_lines,
        "sentencepiece": sentencepiece_codec.encode_documents,
        "decontam": lambda d: decontam.decontaminate(d, benchmark),
        "minhash": minhash.near_duplicates,
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "sharding": sharding.assign_shards,
        "url": lambda d: url_filter.judge_urls(pick(d, "doc_id", "text").select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), url_filter.train(url_filter.labelled_urls(spark))),
    }


NAMES = ("langid", "quality_rules", "quality_model", "line_dedup", "sentencepiece", "decontam", "minhash", "toxicity", "sharding", "url")


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(docs, labels, benchmark, name):
    got = operators(docs, labels, benchmark)[name](docs).collect()
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, benchmark, name):
    assert operators(none, labels, benchmark)[name](none).collect() == []


def test_no_labels_and_no_benchmark(docs, labels, benchmark):
    assert {r["score"] for r in quality_model.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert not any(r["contaminated"] for r in decontam.decontaminate(docs, benchmark.limit(0)).collect())


def test_pick_takes_the_exact_name(docs):
    assert pick(docs, "text").where("text = 'z'").count() == 0
    assert pick(docs, "TEXT").where("TEXT = 'z'").count() == len(ROWS)
    assert pick(docs, "missing").where("missing IS NULL").count() == len(ROWS)


def test_defined_results(docs, benchmark):
    und = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert und[1]["lang_pred"] == und[2]["lang_pred"] == "und" and und[7]["lang_pred"] == "fr"
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert near[1]["kept"] and near[1]["n_shingles"] == 0 and near[3]["component_id"] == 3 and near[None]["kept"] and near[4]["n_shingles"] == 1
    found = {r["doc_id"]: r for r in decontam.decontaminate(docs, benchmark).collect()}
    assert found[6]["item_ids"] == [3, 4] and not found[5]["contaminated"]
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert lines[1]["n_lines"] == 1 and lines[1]["text"] == "" and lines[8]["n_lines"] == 4


def test_all_lines_dropped_leave_an_empty_text(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(i, f"  {line.upper()} \n{line}" if i else line) for i in range(4)] + [(None, line)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == ("", 1, 1) and got[1] == ("", 2, 2) and got[3] == (f"  {line.upper()} \n{line}", 2, 0) and got[None] == (line, 1, 0)


def test_null_and_repeated_items(spark):
    words = [f"w{i}" for i in range(24)]
    bench = spark.createDataFrame([(None, " ".join(words[:12])), (7, " ".join(words[12:])), (7, "other text of the same id that is in no document at all"), (7, " ".join(words[12:]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:12])), (None, " ".join(words)), (2, "some words of no item"), (2, " ".join(["x", *words[12:], "y"]))], "doc_id long, text string")
    for limit in (decontam.MAX_BROADCAST_SEEDS, 0):
        got = sorted((str(r["doc_id"]), r["contaminated"], r["n_items"], r["item_ids"]) for r in decontam.decontaminate(docs, bench, limit).collect())
        assert got == [("1", True, 1, []), ("2", False, 0, []), ("2", True, 1, [7]), ("None", True, 2, [7])]


def test_a_doc_id_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "alone")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_two_texts_of_a_doc_id_lose_their_own_lines(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (2, line), (3, line), (1, f"own\n{line}\nwords")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()) == [(1, ""), (1, "own\nwords"), (2, ""), (3, line)]


@pytest.mark.parametrize("name", NAMES)
def test_a_column_of_nulls(spark, labels, benchmark, name):
    nulls = spark.createDataFrame([(1, None, None), (None, None, None), (2, None, "en")], SCHEMA)
    assert len(operators(nulls, labels, benchmark)[name](nulls).collect()) == 3


def test_shards_of_nulls_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b"), (2, "")], "doc_id long, text string")
    sharding.write_shards(df, f"{tmp_path}/s", n_shards=2)
    assert spark.read.parquet(f"{tmp_path}/s").select("doc_id", "text").exceptAll(df).count() == 0 and spark.read.parquet(f"{tmp_path}/s").count() == 5
