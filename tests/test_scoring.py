"""Worked examples of the scoring core."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import scoring
from tidewatch.operators.signals import SIGNAL, long_table

CASES = {
    # signals (id, category, weight): evidence, score, level
    "pressure and secrets": ([("u", "social-engineering", 13), ("f", "social-engineering", 15), ("c", "credential-theft", 20), ("l", "content", 9)], 57, 86, "high"),
    "parcel": ([("d", "content", 10), ("l", "content", 9)], 19, 48, "medium"),
    "nothing": ([], 0, 0, "low"),
    "no floor": ([("a", "url", 8)], 8, 24, "low"),
    "floor 60": ([("a", "url", 22)], 22, 60, "medium"),
    "floor 72": ([("a", "url", 26)], 26, 72, "high"),
    "cap": ([("a", "content", 20), ("b", "content", 20)], 26, 59, "medium"),
    "all trust": ([("a", "url", 10), ("p", "positive", -22)], 10, 0, "low"),
    "half trust": ([("a", "url", 25), ("b", "domain", 20), ("p", "positive", -20)], 45, 70, "medium"),
    "one id counts once": ([("a", "url", 8), ("a", "url", 14), ("a", "url", -3)], 14, 38, "medium"),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(k, [(i, s[0], s[1], s[2], None, None) for i, s in enumerate(v[0])]) for k, v in CASES.items()] + [("null", None)]
    df = spark.createDataFrame(rows, f"k string, signals array<{SIGNAL}>")
    return {r["k"]: r for r in scoring.score_signals(df, "signals").collect()}


@pytest.mark.parametrize("name", CASES)
def test_worked_example(scored, name):
    _, evidence, score, level = CASES[name]
    r = scored[name]
    assert (r["evidence"], r["score"], r["level"]) == (evidence, score, level)


def test_confidence_and_null(scored):
    assert scored["nothing"]["confidence"] == 0.62
    assert scored["all trust"]["positives"][0]["weight"] == -22
    assert scored["parcel"]["categories"][0]["signals"] == 2


@pytest.mark.parametrize("p,weight", [(0, -11), (0.1, -7), (0.34, 0), (0.35, 0), (0.351, 5), (0.599, 5), (0.6, 12), (0.7, 19), (0.8, 26), (1, 26)])
def test_probability_weight(spark, p, weight):
    got = spark.range(1).select(scoring.probability_signal(F.lit(float(p)), "url")["weight"].alias("w")).first()["w"]
    assert got == weight


def test_long_table_leaves_out_empty_rows(spark):
    df = spark.createDataFrame([(1, [(0, "a", "url", 8, None, None)]), (2, []), (3, None)], f"k int, signals array<{SIGNAL}>")
    assert [r["k"] for r in long_table(df, "k", "signals").collect()] == [1]


def test_fusion_keeps_floor(spark):
    df = spark.createDataFrame([(80, 72, 0.0), (80, None, 0.0), (80, None, None)], "score int, floor int, other double")
    assert [r["fused_score"] for r in scoring.fuse(df, F.col("other")).collect()] == [72, 52, 80]
