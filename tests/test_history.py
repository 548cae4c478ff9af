"""History, reputation, limits and streams."""

import datetime as dt
import math
import statistics

from pyspark.sql import functions as F

from tidewatch.plans import evaluate, history
from tidewatch.queries import QUERIES
from tidewatch.sources import records
from tidewatch.streaming import live

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_reputation_and_intel(spark):
    rows = [(at(i), "https://www.bad.example.net/x", None, "r" * 300, None, f"u{i % 2}") for i in range(5)] + [(at(9), "not a url at all", None, None, None, None), (at(9), "https://google.com", None, None, None, "u")]
    reports = history.report_rows(spark.createDataFrame(rows, "reported_at timestamp, url string, text string, reason string, level string, reporter string"))
    assert reports.agg(F.max(F.length("reason"))).first()[0] == 240
    rep = history.reputation(reports)
    got = {r["domain"]: (r["reports"], r["reporters"], r["last_reported_at"]) for r in rep.collect()}
    assert got["example.net"] == (5, 2, at(4)) and got["google.com"][0] == 1
    links = spark.createDataFrame([(1, "example.net", "http://example.net/a"), (1, "google.com", "http://google.com"), (2, "clean.org", "http://clean.org/l")], "id long, domain string, url string")
    listed = spark.createDataFrame([("http://clean.org/l",)], "url string")
    found = {r["id"]: [(s["id"], s["weight"]) for s in r["intel"]] for r in history.intel_signals(links, rep, listed).collect()}
    assert found == {1: [("intel-reported-example.net", 30)], 2: [("intel-safe-browsing", 45)]}


def test_breaker_opens_and_closes(spark):
    calls = spark.createDataFrame([(i, "ml", at(i), f) for i, f in enumerate([True, True, True, False, True])], "i int, service string, t timestamp, failed boolean")
    assert [(r["failures"], r["open"]) for r in history.breaker(calls, "service", "t", "failed", "i").orderBy("i").collect()] == [(1, False), (2, False), (3, True), (0, False), (1, False)]


def test_empty_history(spark):
    none = spark.createDataFrame([], "level string, score int, duration_ms long, type string, analyzed_at timestamp")
    assert history.totals(none).first().asDict() == {"analyses": 0, "low": 0, "medium": 0, "high": 0, "average_score": 0, "average_duration_ms": 0}
    assert history.trend(none).collect() == []


def test_threshold_prefers_the_middle_of_a_plateau(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, p double")
    assert abs(evaluate.tuned_threshold(evaluate.sweep(rows, "y", "p")).first()["threshold"] - 0.505) < 1e-9
    assert evaluate.roc_auc(rows, "y", "p").first()["auc"] == 1.0


def test_threshold_over_300_halves(spark, tmp_path):
    """The query against brute force over 300 stratified halves of a small table, in the order of Spark's own hash."""
    rows = [(i, i % 3 % 2) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = [(i, y, math.floor((i * 7919 % 1000 + y * 400) / 1.4) / 1000) for i, y in rows]
    hashed = spark.range(60).crossJoin(spark.range(1, 301).select(F.col("id").cast("int").alias("r"))).select("r", "id", F.xxhash64(F.lit(42), "r", "id").alias("h")).collect()
    order = {(x["r"], x["id"]): x["h"] for x in hashed}
    picks = []
    for r in range(1, 301):
        tune = []
        for y in (0, 1):
            of = sorted((x for x in scored if x[1] == y), key=lambda x: (order[r, x[0]], x[0]))
            tune += of[: len(of) // 2]
        p, n, plateau, best = sum(x[1] for x in tune), sum(1 - x[1] for x in tune), [], -1.0
        for c in evaluate.CANDIDATES:
            recall, fpr = sum(x[1] for x in tune if x[2] >= c) / max(1, p), sum(1 - x[1] for x in tune if x[2] >= c) / max(1, n)
            if fpr <= 0.4 and recall >= best:
                plateau, best = ([c] if recall > best else [*plateau, c]), recall
        picks.append(statistics.median(plateau) if plateau else 0.5)
    got = QUERIES["threshold_robust"](spark, str(tmp_path)).first()
    want = (statistics.median(picks), min(picks), max(picks), statistics.pstdev(picks))
    assert all(abs(g - w) < e for g, w, e in zip(got, want, (0.0051, 1e-9, 1e-9, 5.1e-5), strict=True))


def test_validation(spark):
    df = spark.createDataFrame([("1", "nonsense", "hello", None), ("2", "sms", "  ", None), ("3", "url", None, "http://a.b"), ("4", "email", "x" * 200_001, None)], "id string, type string, content string, url string")
    good, bad = records.split_errors(df)
    assert {r["id"]: r["type"] for r in good.collect()} == {"1": "auto", "3": "url"}
    assert {r["id"]: r["error"] for r in bad.collect()} == {"2": "empty_input", "4": "input_too_large"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", twice\nand again', 1)], "id string, text string, label int")
    records.write_csv(df, f"{tmp_path}/c")
    assert records.read_csv(spark, f"{tmp_path}/c", "id string, text string, label int").collect() == df.collect()


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_streamed_rate_limit(spark, tmp_path):
    rows = [("a", at(s)) for s in (5, 6, 7, 64, 65, 66)] + [("b", at(5))]
    spark.createDataFrame(rows, "key string, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, t timestamp").parquet(f"{tmp_path}/in")
    got = {(r["key"], r["t"]): (r["n"], r["limited"]) for r in _run(live.rate_limit(stream, "key", "t", 60, 2), "limited").collect()}
    assert [got["a", at(s)] for s in (5, 6, 7, 64, 65, 66)] == [(1, False), (2, False), (3, True), (4, True), (1, False), (2, False)]
    assert got["b", at(5)] == (1, False)


def test_streamed_reputation(spark, tmp_path):
    rows = [(at(i), ["x.org", "y.org"] if i else ["x.org"]) for i in range(4)]
    spark.createDataFrame(rows, "reported_at timestamp, domains array<string>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("reported_at timestamp, domains array<string>").parquet(f"{tmp_path}/in")
    got = {r["domain"]: r["reports"] for r in _run(live.live_reputation(stream), "reputation", "complete").collect()}
    assert got == {"x.org": 4, "y.org": 3}


def test_rate_limits_start_with_the_first_request(spark):
    times = [0, 10, 59, 60, 61, 200, 259, 260]
    rows = [(i, k, at(t)) for k in ("a", None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "i int, k string, t timestamp")
    got = history.rate_limits(df, "k", "t", "i", window_s=60, most=2)
    for k in ("a", None):
        own = got.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("i").collect()
        assert [(r["n"], r["remaining"], r["limited"]) for r in own] == [(1, 1, False), (2, 0, False), (3, 0, True), (1, 1, False), (2, 0, False), (1, 1, False), (2, 0, False), (1, 1, False)]
    assert history.rate_limits(df.limit(0), "k", "t", "i").collect() == []


def test_circuit_cools_down(spark):
    calls = [(0, True), (1, True), (2, True), (3, True), (32, False), (33, True), (34, False), (40, True), (41, True), (42, True), (72, True), (73, True)]
    df = spark.createDataFrame([(i, "ml", at(t), bad) for i, (t, bad) in enumerate(calls)], "i int, service string, t timestamp, failed boolean")
    got = history.circuit(df, "service", "t", "failed", "i").orderBy("i").collect()
    assert [(r["failures"], r["refused"]) for r in got] == [(1, False), (2, False), (3, False), (3, True), (3, True), (1, False), (0, False), (1, False), (2, False), (3, False), (3, True), (1, False)]


def test_percentiles_take_the_element_at_the_index(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 121)], "ms long")
    found = evaluate.latency(df, "ms").first()
    assert (found["median"], found["p95"], found["max"]) == (61, 115, 120)
    assert evaluate.latency(spark.createDataFrame([(7,), (None,)], "ms long"), "ms").first()["p95"] == 7


def test_ranking_metrics_against_brute_force(spark):
    rows = [(i * 7 % 10 // 6, round(i * 37 % 101 / 50, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    good, bad = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert abs(evaluate.roc_auc(df, "y", "s").first()["auc"] - auc) < 1e-4
    precision, before = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, n = sum(y for y, s in rows if s >= t), sum(s >= t for _, s in rows)
        precision, before = precision + (tp - before) / len(good) * tp / n, tp
    assert abs(evaluate.average_precision(df, "y", "s").first()["average_precision"] - precision) < 1e-4
    assert evaluate.average_precision(df.limit(0), "y", "s").first()["average_precision"] is None


def test_split_and_cross_validation(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(2000)], "k long, y int")
    held = evaluate.stratified_split(df, "y", "k").where("held_out").groupBy("y").count().collect()
    assert all(150 < r["count"] < 250 for r in held)
    assert evaluate.cross_validated(df, "y", "k", lambda train: lambda test: test.withColumn("predicted", F.col("k") % 2)).first()["f1_mean"] == 1.0


def test_kept_history_stays_bounded(spark, tmp_path):
    schema = "id long, t timestamp"
    for i in range(4):
        spark.createDataFrame([(10 * i + k, at(10 * i + k)) for k in range(5)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.keep_latest(stream, f"{tmp_path}/kept", "t", 7, f"{tmp_path}/check", "id")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["id"] for r in live.kept(spark, f"{tmp_path}/kept").collect()} == {33 - 10, 24, *range(30, 35)}
    assert len(list((tmp_path / "kept").glob("batch=*"))) == 2
