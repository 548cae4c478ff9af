"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters: a fixed lexicon of insults, lexicons and word-beginning patterns induced from labelled rows (each split over
several voters by a hash, so that voters see different words), and two voters against.  Every voter votes 1, -1
or 0 (abstains).  The label model is a latent-class model fitted by expectation maximisation to the counts of vote
patterns over all documents (at most 2**voters rows); residual correlations between voters within a class temper
their joint weight.  A logistic regression on hit counts is then fitted to the posteriors of a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, pick, stored
from .langid import tokens

FOLDS = 5
THRESHOLD = 0.5
#: Expected labelled rows that lexicons are induced from, and rows that the classifier is fitted on.
LABELLED_ROWS, CLASSIFIER_ROWS = 20_000, 20_000
#: Least likelihood ratio statistic (one degree of freedom) of an induced word or beginning.
MIN_GAIN = 20.0
#: The fold of labelled rows that anchors the label model; lexicons come from the other folds.
ANCHOR_FOLD = 4
WORD_VOTERS, PATTERN_VOTERS = 6, 3
BEGINNINGS = (4, 5, 6)
INSULTS = frozenset("idiot idiots idiotic moron morons moronic stupid dumb dumbass scum trash garbage worthless pathetic disgusting clown loser losers filth vermin parasite imbecile cretin retard bastard bitch whore slut pig swine degenerate subhuman freak creep liar coward ugly hate despise".split())
VOTERS = ("insults", *[f"words{i}" for i in range(WORD_VOTERS)], *[f"patterns{i}" for i in range(PATTERN_VOTERS)], "no_hit", "rare_hits")


class Lexicon:
    """Induced words and word beginnings with their log odds."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings

    def hits(self, text: str | None) -> np.ndarray:
        """Counts of a text: distinct insults, induced words by voter, words with an induced beginning by voter, the
        sums of their log odds, words, distinct words."""
        counts = Counter(tokens(text)) if text else Counter()
        out = np.zeros(1 + WORD_VOTERS + PATTERN_VOTERS + 4)
        for w, times in counts.items():
            out[-2] += times
            if w in INSULTS:
                out[0] += 1
            if (odds := self.words.get(w)) is not None:
                out[1 + crc32(w.encode()) % WORD_VOTERS] += 1
                out[-4] += odds
            for n in BEGINNINGS:
                if len(w) >= n and (odds := self.beginnings.get(w[:n])) is not None:
                    out[1 + WORD_VOTERS + crc32(w[:4].encode()) % PATTERN_VOTERS] += 1
                    out[-3] += odds
                    break
        out[-1] = len(counts)
        return out


def votes(hits: np.ndarray) -> np.ndarray:
    """A row of -1, 0 and 1 a text, in the order of VOTERS."""
    h = np.atleast_2d(hits)
    n = 1 + WORD_VOTERS
    out = np.zeros((len(h), len(VOTERS)), dtype=np.int8)
    out[:, :n] = h[:, :n] >= 1
    out[:, n : n + PATTERN_VOTERS] = h[:, n : n + PATTERN_VOTERS] >= 2
    some = h[:, : n + PATTERN_VOTERS].sum(axis=1)
    out[:, -2] = np.where(some == 0, -1, 0)
    out[:, -1] = np.where(h[:, -4] + h[:, -3] < 0.004 * h[:, -1], -1, 0)
    return out


def features(hits: np.ndarray) -> np.ndarray:
    """The classifier's inputs: log counts by voter, totals, and their rates a distinct word."""
    h = np.atleast_2d(hits)
    found, size = h[:, :-4], np.maximum(1.0, h[:, -1:])
    total = found.sum(axis=1, keepdims=True)
    odds = h[:, -4:-2]
    return np.hstack([np.log1p(found), found > 0, (found > 0).sum(axis=1, keepdims=True), np.log1p(total), np.log1p(odds), np.sqrt(total / size), np.sqrt(odds / size), np.log1p(size) / 5])


def induce(docs: DataFrame, labelled: DataFrame, sample_rows: int = LABELLED_ROWS) -> tuple[Lexicon, float]:
    """docs: doc_id, text; labelled: doc_id, y.  The lexicon, and the share of labels with y = 1.

    If there are more labels than sample_rows, each is taken with equal chance by a hash of its id; the few that are
    left are broadcast, so texts do not move.

    What comes to the driver are the words and beginnings that pass MIN_GAIN; as each needs several labelled rows, the
    sample bounds their number.
    """
    by_class = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = by_class.get(1, 0), by_class.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, {}), 0.1
    known, kept = labelled, min(1.0, sample_rows / (toxic + clean))
    if kept < 1.0:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * kept))
        toxic, clean = toxic * kept, clean * kept
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")  # about sample_rows ids at most
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != ""))
    begins = F.flatten(F.array(*[F.array_distinct(F.transform(F.filter("words", lambda x, n=n: F.length(x) >= n), lambda x, n=n: F.left(x, F.lit(n)))) for n in BEGINNINGS]))
    rows = rows.select("y", words.alias("words")).withColumn("begins", begins)

    def telling(column: str, least: float) -> dict[str, float]:
        counted = rows.select("y", F.explode(column).alias("item")).groupBy("item").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
        odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
        share, both = toxic / (toxic + clean), F.col("t") + F.col("c")
        part = lambda n, p: F.when(n > 0, 2 * n * F.log(n / (both * p))).otherwise(F.lit(0.0))
        gain = part(F.col("t"), share) + part(F.col("c"), 1 - share)  # the likelihood ratio of word and label
        kept = counted.where("t > 0").withColumn("odds", odds).withColumn("gain", gain)
        kept = kept.where((F.col("odds") >= least) & (F.col("gain") >= MIN_GAIN))
        return {r["item"]: r["odds"] for r in kept.select("item", "odds").collect()}

    return Lexicon(telling("words", 2.0), telling("begins", 1.6)), toxic / (toxic + clean)


class LabelModel:
    """A latent class y and, for each voter, the probabilities of its three votes in each class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, prior: float, rounds: int = 50):
        """known: of each pattern's rows the class, or -1.  Rows of known class count so that they weigh as much in
        all as the others do."""
        v, c = np.asarray(patterns, dtype=int).reshape(-1, len(VOTERS)) + 1, np.asarray(counts, dtype=float)
        known = np.asarray(known, dtype=int)
        sure, rest = c[known >= 0].sum(), c[known < 0].sum()
        if sure and rest > sure:
            c = np.where(known >= 0, c * rest / sure, c)
        self.prior = min(0.5, max(0.01, prior))
        self.weight = np.ones(len(VOTERS))
        self.table = np.zeros((len(VOTERS), 2, 3))  # voter, class, vote
        for j, name in enumerate(VOTERS):
            against = name in ("no_hit", "rare_hits")
            self.table[j] = [[0.8, 0.18, 0.02], [0.1, 0.88, 0.02]] if against else [[0.01, 0.95, 0.04], [0.01, 0.5, 0.49]]
        if not len(v):
            return
        for turn in range(rounds):
            p = np.where(known >= 0, known, self._posterior(v))
            for y, q in ((0, 1 - p), (1, p)):
                for vote in range(3):
                    self.table[:, y, vote] = ((v == vote) * (c * q)[:, None]).sum(axis=0) + 0.05 * (vote == 1) + 0.01
            self.table /= self.table.sum(axis=2, keepdims=True)
            self.prior = min(0.5, max(0.005, 0.5 * self.prior + 0.5 * float((c * p).sum() / c.sum())))
            if turn % 10 == 9:
                self._temper(v, c, p)

    def _temper(self, v: np.ndarray, c: np.ndarray, p: np.ndarray) -> None:
        """Voters that agree beyond what the class explains share their weight."""
        together = np.zeros((len(VOTERS), len(VOTERS)))
        for q in (1 - p, p):
            w = c * q
            if w.sum() < 1e-9:
                continue
            x = (v - 1.0) - ((v - 1.0) * w[:, None]).sum(axis=0) / w.sum()
            cov = (x * w[:, None]).T @ x / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            together += 0.5 * np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0.0)
        np.fill_diagonal(together, 0.0)
        self.correlation = together
        self.weight = 1.0 / (1.0 + np.clip(np.abs(together), 0.0, None).sum(axis=1))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior))
        for j in range(len(VOTERS)):
            odds = odds + self.weight[j] * np.log(self.table[j, 1, v[:, j]] / self.table[j, 0, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(np.asarray(patterns, dtype=int) + 1)


def logistic(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the bias), means and scales of a logistic regression on soft labels, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.clip((x - mean) / scale, -20, 20), np.ones((len(x), 1))])
    beta, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ z + ridge, z.T @ (p - q) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta, mean, scale


class Classifier:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.lexicon, self.beta, self.mean, self.scale = lexicon, beta, mean, scale

    def score_hits(self, hits: np.ndarray) -> np.ndarray:
        z = np.clip((features(hits) - self.mean) / self.scale, -20, 20)
        return 1 / (1 + np.exp(-np.clip(z @ self.beta[:-1] + self.beta[-1], -30, 30)))


def _hits(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rows: doc_id, text, any further columns.  Adds hits and the vote pattern, takes text away."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            hits = np.array([shared.value.hits(t.as_py()) for t in b.column("text")])
            pattern = ["".join("-01"[v + 1] for v in row) for row in votes(hits).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_hash"), pa.array(list(hits), pa.list_(pa.float64())), pa.array(pattern, pa.string())], ["doc_id", "row_hash", "hits", "pattern"])

    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, row_hash long, hits array<double>, pattern string")


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> tuple[Classifier, DataFrame]:
    """The classifier, and doc_id, row_hash, hits for all docs (a stored table)."""
    fold = crc_fold(F.col("doc_id"), folds)
    known = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & (fold != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = pick(docs, "doc_id", "text")
    lexicon, share = induce(rows, known.where(fold != ANCHOR_FOLD))
    seen = stored(_hits(rows, lexicon), "toxicity-hits")
    anchored = seen.join(known.where(fold == ANCHOR_FOLD), "doc_id", "left").groupBy("pattern", F.coalesce("y", F.lit(-1)).alias("y"))
    patterns = anchored.agg(F.count("*").alias("n")).orderBy("pattern", "y").collect()  # at most 3 * 2**len(VOTERS) rows
    decode = lambda s: ["-01".index(c) - 1 for c in s]
    label_model = LabelModel(np.array([decode(r["pattern"]) for r in patterns]), np.array([r["n"] for r in patterns]), np.array([r["y"] for r in patterns]), share)
    total = sum(r["n"] for r in patterns)
    sample = seen if total <= CLASSIFIER_ROWS else seen.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * CLASSIFIER_ROWS / total))
    fitted = sample.select("doc_id", "hits", "pattern").orderBy("doc_id", "pattern").collect()
    if not fitted:
        n = features(np.zeros(1 + WORD_VOTERS + PATTERN_VOTERS + 4)).shape[1]
        return Classifier(lexicon, np.append(np.zeros(n), -2.0), np.zeros(n), np.ones(n)), seen
    p = label_model.posterior(np.array([decode(r["pattern"]) for r in fitted]))
    return Classifier(lexicon, *logistic(features(np.array([r["hits"] for r in fitted])), p)), seen


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from THRESHOLD on), row_hash (of the text).

    labels: doc_id, toxic.  Labels of rows in fold 0 are not looked at; a doc_id with several labels counts as toxic
    if any is; null labels and ids are left out.  Null and empty texts have no hits and get the score of such texts.
    Without labels only the fixed lexicon and the patterns' priors decide.  Each row gives one row.
    """
    scored = score_hits(*train(docs, labels, folds))
    held_out = F.coalesce(crc_fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "row_hash")


def score_hits(classifier: Classifier, seen: DataFrame) -> DataFrame:
    """doc_id, score, row_hash of a table of hits."""
    shared = seen.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            column = b.column("hits")
            hits = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score_hits(hits), pa.float64()), b.column("row_hash")], ["doc_id", "score", "row_hash"])

    return seen.select("doc_id", "row_hash", "hits").mapInArrow(run, "doc_id long, score double, row_hash long")
