"""Benchmark decontamination with spaced seeds.

A seed is a hash of the words at fixed offsets (a mask); the positions between do not matter, so a substituted word
there does not hide an overlap.  Each mask is laid at every start where it fits, and MASKS are chosen so that in WINDOW
words in a row, and in all words of an item of SPAN words or more, any substitutions that MIN_SHARE permits leave a seed
without one (checked in the tests, for each length).  Seeds of all document positions are joined to the seeds of the
benchmark, and around each hit the aligned words are compared: a document is contaminated if in some window of
WINDOW benchmark words (or of a shorter item's all words) at least MIN_SHARE stand at the aligned places.

The document side is exploded and probed inside one generated stage; only hits leave it, grouped by document, item and
shift before any words are compared, so a passage that is copied whole is verified once.  The benchmark side is
broadcast if its seeds are at most MAX_BROADCAST_SEEDS (counted first), else both sides are shuffled by seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, pick, stored

MASKS = ((0, 3, 4, 6, 7), (0, 2, 3, 4, 5), (0, 1, 2, 3, 7))
SHORTEST = min(max(m) for m in MASKS) + 1
SPAN = 8
WINDOW = 16
MIN_SHARE = 0.8
MAX_BROADCAST_SEEDS = 300_000
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&@^~`+=/\\_-"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words without ASCII punctuation; null and blank texts have none."""
    plain = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), F.lit(BLANKS))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, BLANK_RUN))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str, at: Column) -> Column:
    """One seed for each mask.  A mask that ends past the last word has a seed of fewer words; no seed of an item is like it."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get(words, at + o) for o in mask]) for m, mask in enumerate(MASKS)])


def _whole(words: str, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(1000 + n), *[F.get(words, at + o) for o in range(n)])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """doc_id, row_hash, item_id, item (hash of the item's id and text), start (of the best window, in words of the
    document), matched, compared.

    One row for each row of docs (told apart by doc_id and text) and benchmark row that overlap; benchmark rows are
    told apart by id and text, so null and repeated ids have their own.  Items of fewer words than SPAN are found
    where they stand word by word; items without words, and null texts, match nothing.
    """
    items = pick(benchmark, "item_id", "text").select("item_id", F.xxhash64("item_id", F.lit(0), "text").alias("item"), word_hashes(F.col("text")).alias("iw"))
    items = items.where(F.size("iw") > 0).dropDuplicates(["item"]).withColumn("len", F.size("iw"))
    whole = [r["len"] for r in items.where(F.col("len") < SPAN).select("len").distinct().collect()]  # at most SPAN - 1 numbers
    long = items.where(F.col("len") >= SPAN).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("len") - SHORTEST)))
    seeds = long.select("item", "j", "len", F.posexplode(_seeds("iw", F.col("j"))).alias("m", "seed"))
    seeds = seeds.where(F.col("j") + F.get(F.array(*[F.lit(max(m)) for m in MASKS]), F.col("m")) < F.col("len")).select("item", "j", "seed")
    for n in whole:
        seeds = seeds.union(items.where(F.col("len") == n).select("item", F.lit(0).alias("j"), _whole("iw", F.lit(0), n).alias("seed")))
    seeds = stored(seeds, "seeds")
    few = seeds.count() <= max_broadcast

    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row_hash"), word_hashes(F.col("text")).alias("dw"))
    # no filter on the number of words here: Spark would push it below and hash every text twice
    at = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("dw") - min([*whole, SHORTEST]), F.lit(0)))))
    own = F.when(F.col("i") + SHORTEST <= F.size("dw"), _seeds("dw", F.col("i"))).otherwise(F.array().cast("array<bigint>"))
    for n in whole:
        own = F.concat(own, F.when(F.col("i") + n <= F.size("dw"), F.array(_whole("dw", F.col("i"), n))).otherwise(F.array().cast("array<bigint>")))
    key = ["doc_id", "row_hash"]
    hits = at.select(*key, "i", F.explode(own).alias("seed")).join(F.broadcast(seeds) if few else seeds, "seed")
    hits = hits.groupBy(*key, "item", (F.col("i") - F.col("j")).alias("shift")).agg(F.min("j").alias("from"), F.max("j").alias("to"))
    hits = stored(hits, "hits")
    light = F.broadcast if few and hits.count() <= max_broadcast else lambda t: t
    # the words of the documents with hits, hashed once more instead of carried through the exchange
    hit = hits.select(F.col("doc_id").alias("h_id"), F.col("row_hash").alias("h_hash")).distinct()
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_hash"), "text")
    texts = texts.join(light(hit), F.col("t_id").eqNullSafe(F.col("h_id")) & (F.col("t_hash") == F.col("h_hash")), "left_semi")
    texts = texts.select("t_id", "t_hash", word_hashes(F.col("text")).alias("dw"))
    both = texts.join(light(hits), F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_hash") == F.col("row_hash")))
    return _verified(both.join(F.broadcast(items) if few else items, "item"), key)


def _verified(hits: DataFrame, key: list[str]) -> DataFrame:
    """The windows around the hits of a shift, compared word by word; the best of each document and item."""
    hits = hits.withColumn("w", F.least("len", F.lit(WINDOW)))
    first = F.greatest(F.lit(0), F.col("from") + F.least("len", F.lit(SHORTEST)) - F.col("w"))
    last = F.least(F.col("to"), F.col("len") - F.col("w"))
    same = lambda k: F.when(F.get("iw", k) == F.get("dw", k + F.col("shift")), 1).otherwise(0)
    score = lambda s: F.aggregate(F.sequence(s, s + F.col("w") - 1), F.lit(0), lambda a, k: a + same(k))
    # matched words in the upper half, the start (moved to be positive) in the lower: a long has a fast maximum
    best = F.array_max(F.transform(F.sequence(first, last), lambda s: F.shiftleft(score(s).cast("long"), 32) + (s + F.col("shift") + WINDOW).cast("long")))
    found = hits.select(*key, "item", "item_id", F.col("w").alias("compared"), best.alias("best")).groupBy(*key, "item", "compared").agg(F.max("best").alias("best"), F.first("item_id").alias("item_id"))
    found = found.withColumn("matched", F.shiftright("best", 32).cast("int")).where(F.col("matched") >= F.ceil(F.col("compared") * MIN_SHARE))
    start = F.col("best").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") - WINDOW
    return found.select(*key, "item_id", "item", F.greatest(start, F.lit(0)).alias("start"), "matched", "compared")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST_SEEDS) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), best_share (0 if none), row_hash (of the text): one row for
    each row of docs.

    n_items counts benchmark rows that differ in id or text; item_ids has their distinct ids, without null.  Null and
    empty texts are clean.  Repeated rows are treated alike.  With an empty benchmark all are clean.
    """
    overlaps = find_overlaps(docs, benchmark, max_broadcast)
    marks = overlaps.groupBy("doc_id", "row_hash").agg(F.count_distinct("item").alias("n"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("matched") / F.col("compared")).alias("best_share"))
    marks = marks.select(F.col("doc_id").alias("m_id"), F.col("row_hash").alias("m_hash"), "n", "item_ids", "best_share")
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row_hash"))
    both = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_hash") == F.col("m_hash")), "left")
    return both.select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"), "row_hash",
    )
