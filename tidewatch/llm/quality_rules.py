"""Quality rules: base counts of a text, and its distance from how its language usually looks.

The method's verdict compares two histograms of a text, its character classes and its common words, to references
of its language by the Jensen-Shannon distance (base 2, 0 to 1).  The references are sums over all texts of that
language which pass the base rules and are near a first reference made without that condition.  All of it is built from SQL
functions: one pass counts, writes a narrow table without texts to the shared folder, a grouped sum makes one reference
row a language, and a join to those rows (broadcast up to MAX_REFERENCES) gives the distances.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, pick, stored, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Languages with common words of their own; others are counted by the common words of all.
LANGUAGES = ("en", "fr", "de", "es")
COMMON_WORDS = {
    "en": "the of and to in a is that it for on with as be by this are was at from or an not he they".split(),
    "fr": "le la les de des du et un une en que qui est pour dans sur au par il ne pas avec ce elle ou aux".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "es": "el la los las de del que en y a se un una por con no su para es al lo como más o".split(),
}
WORDS = list(dict.fromkeys(w for k in LANGUAGES for w in COMMON_WORDS[k]))
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "other")
#: Distances above these reject; texts shorter than the guards are not judged by that distance.
MAX_CLASS_DISTANCE, MIN_CLASS_CHARS = 0.165, 200
MAX_WORD_DISTANCE, MIN_HISTOGRAM_WORDS = 0.33, 100
MAX_REFERENCES = 10_000
_LOW = 21  # bits for a window's position


def repeated_words(frame: DataFrame, words: str, out: str) -> DataFrame:
    """Adds out: how many words lie in windows of three words that occur twice or more in the array ``words``.

    Windows are sorted as 43 bits of hash and 21 of position, so equal ones become neighbours in one primitive sort.
    Neighbours with equal hash are compared word by word; where any differ, or a text has over two million words,
    the windows themselves are sorted instead, so the count is exact.
    """
    w, n, mask = F.col(words), F.size(words), (1 << _LOW) - 1
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    frame = frame.withColumn("_h", F.when(n < (1 << _LOW), hashed))
    key = lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))
    empty = F.array().cast("array<bigint>")
    frame = frame.withColumn("_s", F.sort_array(F.when((n >= 3) & F.col("_h").isNotNull(), F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), key)).otherwise(empty)))
    same = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), _LOW) == 0  # noqa: E731  null beyond the ends
    beside = lambda x, k: F.coalesce(F.when(k > 0, same(x, F.get("_s", k - 1))), F.lit(False)) | F.coalesce(same(x, F.get("_s", k + 1)), F.lit(False))
    frame = frame.withColumn("_d", F.filter("_s", beside))
    at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    equal = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    clash = F.exists(F.transform("_d", lambda x, k: F.when((k > 0) & same(x, F.get("_d", k - 1)), ~equal(at(x), at(F.get("_d", k - 1)))).otherwise(F.lit(False))), lambda x: x)
    frame = frame.withColumn("_slow", clash | F.col("_h").isNull())
    triple = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
    frame = frame.withColumn("_t", F.when(F.col("_slow") & (n >= 3), F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), triple))))
    twin = lambda x, k: F.coalesce(F.when(k > 0, x["t"] == F.get("_t", k - 1)["t"]), F.lit(False)) | F.coalesce(x["t"] == F.get("_t", k + 1)["t"], F.lit(False))
    starts = F.when(F.col("_t").isNotNull(), F.transform(F.filter("_t", twin), lambda x: x["i"])).otherwise(F.transform("_d", at))
    frame = frame.withColumn("_p", F.sort_array(starts))
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    return frame.withColumn(out, F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_h", "_s", "_d", "_slow", "_t", "_p")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, classes, common.

    classes counts code points by CLASSES; common has first how many words are not, and then how many are (in lower
    case) each of the common words of the text's language, or of all languages where it is unknown.
    """
    frame = pick(docs, "doc_id", "text", "lang").withColumn("text", F.coalesce("text", F.lit("")))
    frame = frame.withColumn("_w", words_of(F.col("text")))
    frame = repeated_words(frame, "_w", "n_repeat_words")
    frame = frame.withColumn("_j", F.array_join("_w", "")).withColumn("_l", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    frame = frame.withColumn("_c", F.filter(F.transform("_w", F.lower), lambda x: x.isin(WORDS)))
    only = lambda kind: F.length(F.regexp_replace("_j", rf"\P{{{kind}}}+", ""))
    n_words, chars = F.size("_w").cast("long"), F.length("_j").cast("long")
    frame = frame.select(
        "doc_id", "lang", n_words.alias("n_words"), chars.alias("word_chars"),
        (F.length("_j") - F.length(F.translate("_j", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.length("text").alias("_n"), only("Ll").alias("_ll"), only("Lu").alias("_lu"), only("Nd").alias("_nd"), "_c",
    )
    own = F.array(*map(F.lit, WORDS))
    for k in LANGUAGES:
        own = F.when(F.col("lang") == k, F.array(*map(F.lit, COMMON_WORDS[k]))).otherwise(own)
    symbols, blanks = F.col("n_symbols").cast("int"), (F.col("_n") - F.col("word_chars")).cast("int")
    classes = F.array("_ll", "_lu", "_nd", blanks, symbols, F.col("_n") - F.col("_ll") - F.col("_lu") - F.col("_nd") - blanks - symbols)
    common = F.transform(own, lambda c: F.size("_c") - F.size(F.array_remove("_c", c)))
    frame = frame.withColumn("_k", common)
    return frame.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        classes.alias("classes"), F.concat(F.array(F.col("n_words").cast("int") - F.aggregate("_k", F.lit(0), lambda a, x: a + x)), F.col("_k")).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; null if either sums to 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    share = lambda x: F.transform(x, lambda v: v / F.nullif(total(x), F.lit(0.0)))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(total(parts), F.lit(0.0)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept.

    Null and empty texts have no words and fail the base rules.  Each value of lang has a reference, and so have all
    texts whose lang is null; a language without any text that passes the base rules has no
    reference, and nothing is rejected for distance there.  A distance is null where a guard or a missing reference
    leaves it out.  Repeated rows are judged each for itself; an empty table gives no rows.
    """
    counted = stored(base_counts(docs).withColumn("lang", F.coalesce("lang", F.lit("*"))), "quality-counts")
    first = _judged(counted, _references(counted.where(~F.col("base_failed"))))
    judged = _judged(counted, _references(first.where("kept")))
    return judged.drop("lang", "classes", "common")


def _references(counted: DataFrame) -> DataFrame:
    """A row a language: the sums of the histograms."""
    bins = (("classes", len(CLASSES)), ("common", len(WORDS) + 1))
    sums = [F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)).cast("double").alias(f"{c}{i}") for c, n in bins for i in range(n)]
    refs = counted.groupBy("lang").agg(*sums)
    return refs.select("lang", *[F.array(*[f"{c}{i}" for i in range(n)]).alias(f"{c}_ref") for c, n in bins])


def _judged(counted: DataFrame, refs: DataFrame) -> DataFrame:
    refs = stored(refs, "quality-references")
    both = counted.join(F.broadcast(refs) if refs.count() <= MAX_REFERENCES else refs, "lang", "left")
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    distance = lambda c: js_distance(F.transform(c, lambda x: x.cast("double")), F.slice(f"{c}_ref", F.lit(1), F.size(c)))
    judged = both.select(
        *counted.columns,
        F.when(n_chars >= MIN_CLASS_CHARS, distance("classes")).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_HISTOGRAM_WORDS, distance("common")).alias("word_distance"),
    )
    near = [F.coalesce(F.col(c) <= most, F.lit(True)) for c, most in (("class_distance", MAX_CLASS_DISTANCE), ("word_distance", MAX_WORD_DISTANCE))]
    return judged.withColumn("kept", reduce(lambda a, b: a & b, near, ~F.col("base_failed")))
