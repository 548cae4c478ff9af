"""A training corpus from raw documents: five stages, each one of the operators of tidewatch.llm.

toxicity, line dedup, near dedup, decontamination, encoding.  A stage gets (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, line_dedup, minhash, sentencepiece_codec, toxicity
from tidewatch.llm.common import pick, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1").select("doc_id", "row_hash").distinct())


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are found in many of them but in one."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, 0.8).

    Rows of a doc_id with several texts, and rows without one, go by a number above 2**62 that is made of doc_id and
    text, the latter by the greater ones; so each text is judged on its own.  One of equal rows stays.
    """
    rows = pick(docs, *COLUMNS)
    again = stored(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("n > 1").select("doc_id", (F.col("lo") < F.col("hi")).alias("several")), "repeated")
    plain = again.isEmpty() and rows.where("doc_id IS NULL").isEmpty()
    if plain:
        named = rows.withColumn("uid", F.col("doc_id"))
    else:
        made = F.xxhash64("doc_id", F.lit(0), "text").bitwiseAND(F.lit((1 << 61) - 1)) + F.when(F.col("doc_id").isNull(), F.lit(3 << 61)).otherwise(F.lit(1 << 62))
        uid = F.when(F.col("doc_id").isNull() | F.coalesce("several", F.lit(False)), made).otherwise(F.col("doc_id"))
        named = rows.join(_light(again), "doc_id", "left").withColumn("odd", F.col("doc_id").isNull() | F.col("several").isNotNull())
        named = stored(named.withColumn("uid", uid), "named")
    found = minhash.near_duplicates(named.select(F.col("uid").alias("doc_id"), "text"))
    dropped = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("uid")).distinct(), "dropped")
    kept = named.join(_light(dropped), "uid", "left_anti")
    if not plain:
        kept = kept.where("NOT odd").union(kept.where("odd").dropDuplicates(["uid"]).select(kept.columns))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    dropped = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "row_hash").distinct()
    return _without(docs, dropped)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of each document."""
    encoded = sentencepiece_codec.encode_documents(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def _light(stored_table: DataFrame, most: int = 200_000) -> DataFrame:
    """To be broadcast if it has few rows, else both sides of the join are shuffled."""
    return F.broadcast(stored_table) if stored_table.count() <= most else stored_table


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows of these doc_ids (null is one too) and xxhash64 of the text."""
    dropped = _light(stored(dropped.select(F.col("doc_id").alias("d_id"), F.col("row_hash").alias("d_hash")), "dropped"))
    rows = pick(docs, *COLUMNS)
    return rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.xxhash64("text") == F.col("d_hash")), "left_anti").select(*COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: Learned, hashed and iterative stages: SQL cannot express the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
