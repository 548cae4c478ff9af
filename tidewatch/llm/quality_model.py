"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

The statistics are SQL functions over whole texts, written once as a narrow table.  cos(xW + b) approximates a
Gaussian kernel; each partition sums its part of the normal equations, partial sums are added in a tree, and the
driver solves one system of FEATURES + 1 unknowns.  The calibration is fitted on cross-fitted scores: each half of the
labelled rows is scored by the regression of the other half, and summed in BINS bins of the raw score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, pick, stored, words_of

FEATURES = 192
BINS = 400
RIDGE = 1e-3
THRESHOLD = 0.3
FOLDS = 5
STATISTICS = (
    "log_chars", "log_words", "word_length", "lower", "upper", "digit", "blank", "symbols", "stops", "bangs", "bars",
    "distinct_words", "repeats_last_word", "log_lines", "distinct_lines", "words_a_line",
)


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns of carry and x: the STATISTICS of the whole text (null as empty) as an array of doubles."""
    frame = pick(docs, "doc_id", "text", *carry).withColumn("text", F.coalesce("text", F.lit("")))
    frame = frame.withColumn("_w", words_of(F.col("text"))).withColumn("_l", F.split("text", "\n"))
    frame = frame.withColumn("_j", F.array_join("_w", ""))
    only = lambda kind: F.length(F.regexp_replace("_j", rf"\P{{{kind}}}+", ""))
    count = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    n, w, k = F.greatest(F.length("text"), F.lit(1)), F.greatest(F.size("_w"), F.lit(1)), F.size("_l")
    again = F.size(F.filter("_w", lambda x, i: F.coalesce(x == F.get("_w", i - 1), F.lit(False))))
    values = {
        "log_chars": F.log1p(F.length("text")), "log_words": F.log1p(F.size("_w")), "word_length": F.length("_j") / w,
        "lower": only("Ll") / n, "upper": only("Lu") / n, "digit": only("Nd") / n, "blank": (F.length("text") - F.length("_j")) / n,
        "symbols": count("#*$%&<>@^~_=+") / n, "stops": count(".,;:?") / n, "bangs": count("!") / n, "bars": count("|") / n,
        "distinct_words": F.size(F.array_distinct("_w")) / w, "repeats_last_word": again / w,
        "log_lines": F.log1p(k), "distinct_lines": F.size(F.array_distinct("_l")) / k, "words_a_line": F.log1p(F.size("_w") / k),
    }
    return frame.select("doc_id", *carry, F.array(*[values[s].cast("double") for s in STATISTICS]).alias("x"))


class Model:
    """Standardisation, the random projection, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(0.0, np.sqrt(1.0 / d), (d, FEATURES))
        self.b = rng.uniform(0.0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.at, self.level = np.array([0.0]), np.array([0.5])

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0.0, 1.0)


def pool_adjacent(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted isotonic (ascending) fit: each point's place and its level."""
    blocks: list[list[float]] = []  # level, weight, points
    for m, w in zip(mean, weight, strict=True):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return at, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _matrix(b: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = b.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def train(rows: DataFrame) -> Model:
    """rows: doc_id, x, y (0 or 1).  The regression is fitted on all rows, the calibration on the scores that each half
    of them, by a hash of the doc_id, gets from the regression of the other half."""
    d = len(STATISTICS)
    aggregates = [f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = rows.agg(*aggregates, F.count("*").alias("n")).first()
    if not sums["n"]:
        return Model(np.zeros(d), np.ones(d))
    model = Model(np.array([sums[f"m{i}"] for i in range(d)]), np.array([sums[f"s{i}"] for i in range(d)]))
    rows = rows.select("x", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for b in batches:
            z, y, half = model.expand(_matrix(b)), b.column("y").to_numpy(zero_copy_only=False), b.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                total[h, :, :-1] += z[half == h].T @ z[half == h]
                total[h, :, -1] += z[half == h].T @ y[half == h]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.mapInArrow(partial, "part binary").rdd.map(lambda r: np.frombuffer(r["part"]).copy())
    total = parts.treeReduce(lambda a, b: a + b, depth=3).reshape(2, FEATURES + 1, FEATURES + 2)

    def solved(t: np.ndarray) -> np.ndarray:
        n = max(1.0, t[-1, -2])  # an empty half has weights of 0
        penalty = RIDGE * n * np.eye(FEATURES + 1)
        penalty[-1, -1] = 1e-9 * n
        return np.linalg.solve(t[:, :-1] + penalty, t[:, -1])

    model.beta = solved(total.sum(axis=0))
    other = np.stack([solved(total[1]), solved(total[0])])  # by half, the weights of the other

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = b.column("half").to_numpy(zero_copy_only=False)
            scores = np.clip((model.expand(_matrix(b)) * other[half]).sum(axis=1), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((scores + 0.5) / 2.0 * (BINS - 1)).astype(np.int32)), b.column("y")], ["bin", "y"])

    binned = rows.mapInArrow(raw, "bin int, y double")
    found = sorted((r["bin"], r["y"], r["n"]) for r in binned.groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect())
    at = (np.array([b for b, _, _ in found]) + 0.5) / (BINS - 1) * 2.0 - 0.5
    n = np.array([n for _, _, n in found], dtype=float)
    model.at, model.level = pool_adjacent(at, np.array([y for _, y, _ in found]) / n, n)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from THRESHOLD on).

    labels: doc_id, quality.  Labels of rows in fold 0 are not looked at; a doc_id with several labels counts as 1
    if any is 1; null labels and ids are left out.  Null and empty texts are scored like others, from statistics of
    0.  Without any labels all scores are 0.5.
    """
    stats = stored(statistics(docs), "quality-statistics")
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("y"))
    model = train(stats.join(known, "doc_id").select("doc_id", "x", "y"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(_matrix(b)), pa.float64())], ["doc_id", "score"])

    scored = stats.select(F.col("doc_id").cast("long"), "x").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
