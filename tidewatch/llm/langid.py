"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

The model is learned from a sample of labelled rows whose expected size is bounded by SAMPLE_ROWS, shared out evenly
among the languages so that rare ones keep theirs.  Words and n-grams are counted in Spark; each language keeps its
WORDS_PER_LANGUAGE and, for each length, NGRAMS_PER_LANGUAGE most frequent ones, so what is broadcast grows with the
number of languages only.  Texts are scored in Arrow batches; a worker keeps the scores of at most MEMO words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

SAMPLE_ROWS = 10_000
WORDS_PER_LANGUAGE = 20_000
NGRAMS_PER_LANGUAGE = 5_000
LONGEST = 4
MEMO = 100_000
#: Smallest share that a word or n-gram kept for another language has in this one.
FLOOR = 1e-6
#: A text's words count as at most so many independent ones when the score is made.
EVIDENCE = 30.0

_LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def _grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log shares by language of words (length 0) and of n-grams of each length."""

    def __init__(self, counts: dict[tuple[int, str], dict[str, int]], totals: dict[tuple[int, str], int]):
        """counts: by length and language, how often each item was seen; totals: how often any was, kept or not."""
        self.languages = sorted({k for _, k in totals})
        shares = {n: self._shares({k: counts.get((n, k), {}) for k in self.languages}, {k: totals.get((n, k), 1) for k in self.languages}) for n in range(LONGEST + 1)}
        self.words, self.grams = shares.pop(0), shares

    def _shares(self, by: dict[str, dict[str, int]], totals: dict[str, int]) -> dict[str, tuple[float, ...]]:
        known = {x for c in by.values() for x in c}
        return {x: tuple(math.log(max(FLOOR, by[k].get(x, 0) / totals[k])) for k in self.languages) for x in known}

    def word(self, word: str) -> tuple[float, ...] | None:
        """The word's log shares; for an unseen word the mean of its longest known n-grams'; None if it has none."""
        if (found := self.words.get(word)) is not None:
            return found
        for n in range(LONGEST, 0, -1):
            known = [s for g in _grams(word, n) if (s := self.grams[n].get(g)) is not None]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known, strict=True))
        return None

    def predict(self, text: str | None, memo: dict) -> tuple[str, float]:
        counts = Counter(tokens(text)) if text else None
        if not counts or not self.languages or not any(c.isalpha() for w in counts for c in w):
            return "und", 0.0
        sums, seen = [0.0] * len(self.languages), 0
        for w, times in counts.items():
            s = memo.get(w, 0)
            if s == 0:
                if len(memo) >= MEMO:
                    memo.clear()
                s = memo[w] = self.word(w)
            if s is not None:
                seen += times
                for i, x in enumerate(s):
                    sums[i] += times * x
        if not seen:
            return self.languages[0], 1.0 / len(self.languages)
        scale = min(seen, EVIDENCE) / seen
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return self.languages[best], 1.0 / sum(math.exp(min(0.0, max(-700.0, scale * (x - sums[best])))) for x in sums)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled: doc_id, text, lang.  Rows without doc_id, text or language teach nothing.

    A language with more rows than its even part of sample_rows has each taken with equal chance by a hash of its id;
    the others are taken whole.
    """
    rows = pick(labelled, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy())) / F.col("n"))
    sizes = sizes.withColumn("share", share)  # a row a language
    rows = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    token = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != ""))
    words = stored(rows.select("lang", token.alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n")), "langid-words")

    def grams(n: int) -> Column:
        padded = F.concat(F.lit("<"), "item", F.lit(">")) if n > 1 else F.col("item")
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.struct(F.lit(n).alias("size"), F.substr(padded, i, F.lit(n)).alias("item"))), lambda g: F.length(g["item"]) == n)

    pieces = F.concat(F.array(F.struct(F.lit(0).alias("size"), F.col("item").alias("item"))), *[grams(n) for n in range(1, LONGEST + 1)])
    counted = words.select("lang", "n", F.inline(pieces)).toDF("lang", "times", "size", "item").groupBy("lang", "size", "item").agg(F.sum("times").alias("n"))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    ranked = counted.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "size"))).withColumn("place", F.row_number().over(best))
    kept = ranked.where(F.col("place") <= F.when(F.col("size") == 0, WORDS_PER_LANGUAGE).otherwise(NGRAMS_PER_LANGUAGE))
    counts: dict[tuple[int, str], dict[str, int]] = defaultdict(dict)
    totals: dict[tuple[int, str], int] = {}
    for r in kept.collect():  # at most WORDS_PER_LANGUAGE + LONGEST * NGRAMS_PER_LANGUAGE rows a language
        counts[r["size"], r["lang"]][r["item"]] = r["n"]
        totals[r["size"], r["lang"]] = r["total"]
    return Model(counts, totals)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if the model knows no language.
    A text whose letters are all unknown to the model gets its first language with an even score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = shared.value, {}
        for b in batches:
            found = [known.predict(t.as_py(), memo) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


