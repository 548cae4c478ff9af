"""Evaluation: metrics of predictions, decision rules, latency percentiles, the threshold tuner."""

from __future__ import annotations

from collections.abc import Callable
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up

#: Ranges that distinct scores are ordered in.
RANGES = 256
CANDIDATES = tuple(round(0.02 + 0.01 * i, 2) for i in range(94))


def metrics(rows: DataFrame, truth: str, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1, fpr, fnr (4 places; 0 for empty denominators), for each group
    of ``by``.  Rows with a null truth or prediction are left out."""
    p = predicted.cast("int")
    rows = rows.where(F.col(truth).isNotNull() & p.isNotNull())
    cell = lambda t, q: F.count_if((F.col(truth) == t) & (p == q))
    counted = rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))
    share = lambda a, b: half_up(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counted.select(
        *by, "tp", "fp", "tn", "fn", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"), share(fn, fn + tp).alias("fnr"),
    )


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row, auc (4 places; null with one class only): by ranks of distinct scores, ordered in RANGES ranges, so that
    no task sees them all."""
    rows = rows.select(F.col(truth).alias("_y"), F.col(score).alias("_s")).where(F.col("_y").isNotNull() & F.col("_s").isNotNull())
    by = rows.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("n"))
    # scores are dealt to ranges by their approximate quantiles; the ranges before one are summed up apart
    cuts = by.agg(F.percentile_approx("_s", [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first()["q"] or []
    ranges = F.size(F.filter(F.array(*[F.lit(float(q)) for q in sorted(set(cuts))]).cast("array<double>"), lambda q: q < F.col("_s").cast("double")))
    by = by.withColumn("_r", ranges)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    under = by.groupBy("_r").agg(F.sum("n").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_under"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_under")
    wins = by.join(F.broadcast(under), "_r").select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("w"))
    return wins.agg(half_up(F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 4).alias("auc"))


def index_percentile(column: str, share: float, n: int) -> Column:
    """The element at floor(n * share), from 0, of the n sorted values; an aggregate over counts of values."""
    place = (min(n - 1, floor(n * share)) + 0.5) / max(n, 1)
    return F.expr(f"percentile_disc({min(1.0, max(0.0, place))!r}D) within group (order by `{column}`)")


def latency(rows: DataFrame, ms: str) -> DataFrame:
    """One row: mean, median, p95, max; percentiles are the elements at floor(n * share).  Nulls are left out."""
    n = rows.where(F.col(ms).isNotNull()).count()
    return rows.agg(half_up(F.avg(ms), 2).alias("mean"), index_percentile(ms, 0.5, n).alias("median"), index_percentile(ms, 0.95, n).alias("p95"), F.max(ms).alias("max"))


def average_precision(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """One row, average_precision (4 places): the sum of precisions at each distinct score, weighted by the recall that
    it adds; null without positives."""
    rows = rows.select(F.col(truth).alias("_y"), F.col(score).cast("double").alias("_s")).where(F.col("_y").isNotNull() & F.col("_s").isNotNull())
    by = rows.groupBy("_s").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count("*").alias("n"))
    cuts = by.agg(F.percentile_approx("_s", [i / RANGES for i in range(1, RANGES)], 10_000).alias("q")).first()["q"] or []
    by = by.withColumn("_r", F.size(F.filter(F.array(*[F.lit(float(q)) for q in sorted(set(cuts))]).cast("array<double>"), lambda q: q < F.col("_s"))))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    over = by.groupBy("_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")).select("_r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_over") for c in ("_p", "_n")])
    own = Window.partitionBy("_r").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    both = by.join(F.broadcast(over), "_r").select("p", (F.sum("p").over(own) + F.col("_p_over")).alias("tp"), (F.sum("n").over(own) + F.col("_n_over")).alias("flagged"))
    return both.agg(half_up(F.sum(F.col("p") * F.col("tp") / F.col("flagged")) / F.nullif(F.sum("p"), F.lit(0)), 4).alias("average_precision"))


def stratified_split(rows: DataFrame, truth: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with held_out: a ``share`` of each class, by a hash of the key (the same for all rows of a key)."""
    part = F.pmod(F.xxhash64(F.lit(seed), truth, key), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("held_out", part < share)


def folds(rows: DataFrame, truth: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold, 0 to k - 1, of near equal classes, by a hash of the key."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), truth, key), F.lit(k)).cast("int"))


def cross_validated(rows: DataFrame, truth: str, key: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], k: int = 5, seed: int = 42) -> DataFrame:
    """One row, f1_mean and f1_deviation over k folds.  fit: from training rows to a function that adds predicted."""
    split, each = folds(rows, truth, key, k, seed).persist(), None
    for i in range(k):
        found = fit(split.where(F.col("fold") != i))(split.where(F.col("fold") == i))
        one = metrics(found.withColumn("fold", F.lit(i)), truth, F.col("predicted"), "fold")
        each = one if each is None else each.union(one)
    out = each.agg(half_up(F.avg("f1"), 4).alias("f1_mean"), half_up(F.stddev_pop("f1"), 4).alias("f1_deviation"))
    return out


def accepted(found: DataFrame) -> DataFrame:
    """found (rows of metrics) with passed: accuracy over 0.9 and false positives under 0.1."""
    return found.withColumn("passed", (F.col("accuracy") > 0.9) & (F.col("fpr") < 0.1))


def sweep(rows: DataFrame, truth: str, score: str, candidates: tuple[float, ...] = CANDIDATES, *by: str) -> DataFrame:
    """candidate, tp, fp, p, n: one pass counts rows by the last candidate at or below their score, and a window over
    those few counts sums them up; rows are not multiplied by candidates."""
    places = F.array(*[F.lit(float(c)) for c in candidates])
    rows = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    at = F.size(F.filter(places, lambda c: F.col(score) >= c))
    counted = rows.groupBy(*by, at.alias("at")).agg(F.count_if(F.col(truth) == 1).alias("t"), F.count_if(F.col(truth) == 0).alias("f"))
    spark = rows.sparkSession
    steps = spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(candidates)], "i int, candidate double")
    over = Window.partitionBy(*by)
    totals = counted.select(*by, "at", "t", "f", F.sum("t").over(over).alias("p"), F.sum("f").over(over).alias("n"))
    joined = totals.join(F.broadcast(steps), F.col("at") >= F.col("i"), "right") if not by else totals.join(F.broadcast(steps), F.col("at") >= F.col("i"))
    out = joined.groupBy(*by, "candidate").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tp"), F.coalesce(F.sum("f"), F.lit(0)).alias("fp"), F.max("p").alias("_p"), F.max("n").alias("_n"))
    if by:
        return out.withColumnRenamed("_p", "p").withColumnRenamed("_n", "n")
    whole = counted.agg(F.sum("t").alias("p"), F.sum("f").alias("n"))
    return out.drop("_p", "_n").crossJoin(F.broadcast(whole))  # one row


def tuned_threshold(swept: DataFrame, max_fpr: float = 0.10) -> DataFrame:
    """One row, threshold: the middle of the candidates with the highest recall among those within the budget of false
    positives; 0.5 if there is none."""
    rated = swept.select("candidate", (F.col("tp") / F.greatest(F.col("p"), F.lit(1))).alias("recall"), (F.col("fp") / F.greatest(F.col("n"), F.lit(1))).alias("fpr")).where(F.col("fpr") <= max_fpr)
    best = rated.withColumn("best", F.max("recall").over(Window.partitionBy(F.lit(1)))).where("recall = best")
    return best.agg(F.coalesce(F.percentile("candidate", F.lit(0.5)), F.lit(0.5)).alias("threshold"))


def stratified_halves(rows: DataFrame, truth: str, key: str, repeats: int = 300, seed: int = 42) -> DataFrame:
    """rows repeated with columns repeat and tune: in each repeat half of each class, by a hash of key, is for tuning."""
    many = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    place = F.row_number().over(Window.partitionBy("repeat", truth).orderBy(F.xxhash64(F.lit(seed), "repeat", key), key))
    size = F.count("*").over(Window.partitionBy("repeat", truth))
    return many.withColumn("tune", place * 2 <= size)


def robust_threshold(rows: DataFrame, truth: str, score: str, key: str, repeats: int = 300, max_fpr: float = 0.10, seed: int = 42) -> DataFrame:
    """threshold (median over repeated halves, 2 places), least, most, deviation."""
    halves = stratified_halves(rows.select(key, truth, score), truth, key, repeats, seed).where("tune")
    swept = sweep(halves, truth, score, CANDIDATES, "repeat")
    rated = swept.select("repeat", "candidate", (F.col("tp") / F.greatest(F.col("p"), F.lit(1))).alias("recall"), (F.col("fp") / F.greatest(F.col("n"), F.lit(1))).alias("fpr")).where(F.col("fpr") <= max_fpr)
    best = rated.withColumn("best", F.max("recall").over(Window.partitionBy("repeat"))).where("recall = best")
    picks = best.groupBy("repeat").agg(F.percentile("candidate", F.lit(0.5)).alias("pick"))
    return picks.agg(half_up(F.percentile("pick", F.lit(0.5)), 2).alias("threshold"), F.min("pick").alias("least"), F.max("pick").alias("most"), half_up(F.stddev_pop("pick"), 4).alias("deviation"))
