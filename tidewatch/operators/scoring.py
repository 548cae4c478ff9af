"""Scoring: from a row's signals to a score of 0 to 100, its level and confidence.  Projections only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import knowledge as K
from ..functions.text import half_up
from .signals import strongest


@dataclass(frozen=True)
class Scoring:
    """The constants of the score; any may be set otherwise."""

    kappa: float = K.KAPPA
    caps: dict[str, int] = field(default_factory=lambda: dict(K.CATEGORY_CAPS))
    default_cap: int = K.DEFAULT_CATEGORY_CAP
    positive_cap: int = K.POSITIVE_CAP
    damping: tuple = K.DAMPING
    floors: tuple = K.FLOORS
    low: int = K.LOW
    medium: int = K.MEDIUM


def level_of(score: Column, s: Scoring = Scoring()) -> Column:
    return F.when(score <= s.low, "low").when(score <= s.medium, "medium").otherwise("high")


def _sum(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0), lambda a, x: a + x["weight"])


def score_signals(df: DataFrame, signals: str, scoring: Scoring = Scoring()) -> DataFrame:
    """Adds risky and positives (signals, strongest first, ties in the order of emission), categories (structs
    category, raw, applied, capped, signals, top, by applied points), evidence, damping_factor, damping, net,
    curve (1 place), floor (null if none), score, level, confidence.

    Signals of one id count once, by the largest absolute weight.  A null weight is left out, a null array is empty.
    """
    keep = df.columns
    df = df.withColumn("_s", strongest(F.col(signals)))
    ranked = lambda test, order: F.transform(F.array_sort(F.transform(F.filter("_s", test), lambda x, i: F.struct(order(x).alias("o"), i.alias("i"), x.alias("s")))), lambda x: x["s"])
    df = df.withColumn("risky", ranked(lambda x: x["weight"] > 0, lambda x: -x["weight"])).withColumn("positives", ranked(lambda x: x["weight"] < 0, lambda x: x["weight"]))
    cap = F.lit(scoring.default_cap)
    names = F.array_distinct(F.transform(F.filter("_s", lambda x: x["weight"] > 0), lambda x: F.coalesce(x["category"], F.lit("content"))))

    def category(c: Column, i: Column) -> Column:
        own = F.filter("risky", lambda x: F.coalesce(x["category"], F.lit("content")) == c)
        most = cap
        for k, v in scoring.caps.items():
            most = F.when(c == k, F.lit(v)).otherwise(most)
        raw = _sum(own)
        return F.struct(-F.least(raw, most).alias("o"), i.alias("i"), c.alias("category"), raw.alias("raw"), F.least(raw, most).alias("applied"), (raw > most).alias("capped"), F.size(own).alias("signals"), F.get(own, F.lit(0))["id"].alias("top"))

    df = df.withColumn("categories", F.transform(F.array_sort(F.transform(names, category)), lambda x: F.struct(*[x[k].alias(k) for k in ("category", "raw", "applied", "capped", "signals", "top")])))
    df = df.withColumn("evidence", F.aggregate("categories", F.lit(0), lambda a, x: a + x["applied"]))
    factor = F.lit(1.0)
    for least, f in reversed(scoring.damping):
        factor = F.when(F.col("evidence") >= least, F.lit(float(f))).otherwise(factor)
    df = df.withColumn("damping_factor", factor)
    df = df.withColumn("damping", F.least(F.lit(scoring.positive_cap), F.abs(_sum(F.col("positives")))) * F.col("damping_factor"))
    df = df.withColumn("net", F.greatest(F.lit(0.0), F.col("evidence") - F.col("damping")))
    df = df.withColumn("_curve", 100 * (1 - F.exp(-F.col("net") / scoring.kappa)))
    heaviest, floor = F.coalesce(F.get("risky", F.lit(0))["weight"], F.lit(0)), F.lit(None).cast("int")
    for least, f in reversed(scoring.floors):
        floor = F.when((F.col("net") > 0) & (heaviest >= least) & (F.col("_curve") < f), F.lit(f)).otherwise(floor)
    df = df.withColumn("floor", floor).withColumn("curve", half_up(F.col("_curve"), 1))
    df = df.withColumn("score", half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col("floor").cast("double"), F.col("_curve"))))).cast("int"))
    df = df.withColumn("level", level_of(F.col("score"), scoring))
    band = F.when(F.col("score").between(35, 62), 0.12).otherwise(0.0)
    sure = F.when(F.size("risky") == 0, 0.62 + F.least(F.lit(0.14), F.size("positives") * 0.05)).otherwise(0.5 + F.least(F.lit(0.28), F.size("categories") * 0.07) + F.least(F.lit(0.2), F.col("net") / 250) - band)
    df = df.withColumn("confidence", half_up(F.least(F.lit(0.97), F.greatest(F.lit(0.35), sure)), 2))
    return df.select(*keep, "risky", "positives", "categories", "evidence", "damping_factor", "damping", "net", "curve", "floor", "score", "level", "confidence")


def fuse(df: DataFrame, other: Column, weight: float = 0.35, scoring: Scoring = Scoring()) -> DataFrame:
    """Adds fused_score, fused_level, fused: the score blended with another one of 0 to 100 (null: unchanged), never
    under the floor that applied.  weight is held to 0 to 0.6."""
    w = min(0.6, max(0.0, weight))
    blended = half_up(F.col("score") * (1 - w) + F.least(F.lit(100.0), F.greatest(F.lit(0.0), other.cast("double"))) * w).cast("int")
    df = df.withColumn("fused_score", F.when(other.isNull() | F.isnan(other.cast("double")), F.col("score")).otherwise(F.greatest(blended, F.coalesce("floor", F.lit(0)))))
    return df.withColumn("fused_level", level_of(F.col("fused_score"), scoring)).withColumn("fused", other.isNotNull())


def feature_groups(signals: Column) -> Column:
    """Array of structs id, hits, points, top: the risky signals by feature group."""

    def group(name: str, categories: tuple[str, ...]) -> Column:
        own = F.filter(signals, lambda x: x["category"].isin(*categories) & (x["weight"] > 0))
        best = F.array_max(F.transform(own, lambda x, i: F.struct(x["weight"].alias("w"), (-i).alias("i"), x["id"].alias("id"))))
        return F.struct(F.lit(name).alias("id"), F.size(own).alias("hits"), _sum(own).alias("points"), best["id"].alias("top"))

    return F.array(*[group(n, c) for n, c in K.FEATURE_GROUPS])


def probability_signal(p: Column, kind: str) -> Column:
    """Struct id, category, weight of a model's probability; weights round half up.  Null for a null probability."""
    up = lambda c: F.floor(c + 0.5).cast("int")
    risk = up(26 * F.least(F.lit(1.0), (p - 0.6) / 0.35 + 0.45))
    trust = -up(F.least(F.lit(12.0), (0.35 - p) * 30))
    weight = F.when(p >= 0.6, risk).when(p <= 0.35, trust).otherwise(up(F.lit(26 * 0.18)))
    return F.when(p.isNotNull(), F.struct(F.concat(F.lit(f"ml-{kind}-"), F.when(p >= 0.6, "high").when(p <= 0.35, "low").otherwise("uncertain")).alias("id"), F.when((p <= 0.35), "positive").otherwise("ml").alias("category"), weight.alias("weight")))


def review_signal(score: Column) -> Column:
    """Struct id, category, weight of a language model's score of 0 to 100; null between 25 and 65 and for null."""
    up = lambda c: F.floor(c + 0.5).cast("int")
    return F.when(score >= 65, F.struct(F.lit("ai-assessment-malicious").alias("id"), F.lit("ai").alias("category"), up(F.least(F.lit(22.0), 8 + (score - 65) * 0.4)).alias("weight"))).when(
        score <= 25, F.struct(F.lit("ai-assessment-benign").alias("id"), F.lit("positive").alias("category"), (-up(F.least(F.lit(10.0), (25 - score) * 0.4))).alias("weight")))
