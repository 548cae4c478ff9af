"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, line_dedup, minhash, quality_model, quality_rules, sentencepiece_codec, sharding, toxicity, url_filter
from .common import crc_fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id"), 4) == 2
    found = langid.predict(docs, langid.train(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.train(url_filter.labelled_urls(spark)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",").alias("item_ids"), "best_share")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says by rule alone: host, path, the longest rule that fits and its verdict."""
    rows = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    return rows.withColumn("r", url_filter.rule_of(F.col("host"), F.col("path"))).select("page_id", "host", "path", "r.rule", "r.verdict")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op3."""
    counted = quality_rules.base_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laws of op10: rows and bytes in all, slots without gaps in each shard, bytes of shards near equal (by a share
    of a shard's mean and the largest text)."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    each = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"), F.max("size").alias("most"))
    total = each.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.max("most").alias("most"), F.max(F.abs(F.col("bytes") * sharding.SHARDS)).alias("high"), F.bool_and((F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    even = F.col("high") <= 1.01 * F.col("n_bytes") + sharding.SHARDS * 2 * F.col("most")
    return total.select("n_rows", "n_bytes", "gapless", "first_shard", "last_shard", even.alias("even"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_decontamination": op7_decontamination,
    "op8_minhash": op8_minhash,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "url_rules": url_rules,
    "quality_base_counts": quality_base_counts,
    "shard_laws": shard_laws,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_WORDS = lambda text: f"list_filter(string_split_regex({text}, '[ \\t-\\r]+'), lambda x: x <> '')"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
_MARKS = decontam.PUNCTUATION.replace("'", "''")
ORACLE_SQL: dict[str, str] = {
    "url_rules": f"""
        WITH rests AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {_UPPER}, {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
        fits AS (
            SELECT p.page_id, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.p) DESC) AS n
            FROM parts p JOIN (VALUES {_RULES}) AS r(h, p, verdict) ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
        SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1""",
    "quality_base_counts": f"""
        WITH given AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS("coalesce(text, '')")} AS w FROM documents),
        windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM given WHERE len(w) >= 3),
        keyed AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS t FROM windows),
        twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM keyed) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
        lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len({_WORDS("x")}) > 0) AS l FROM given),
        counted AS (
            SELECT g.doc_id, len(g.w) AS n_words, length(array_to_string(g.w, '')) AS word_chars,
                   length(g.text) - length(translate(g.text, '{quality_rules.SYMBOLS}', '')) AS n_symbols, len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM given g JOIN lines l ON g.doc_id = l.doc_id LEFT JOIN covered c ON g.doc_id = c.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted""",
    "shard_laws": """
        SELECT count(*) AS n_rows, CAST(sum(octet_length(encode(coalesce(text, ''))) + 8) AS BIGINT) AS n_bytes, true AS gapless, CAST(0 AS INTEGER) AS first_shard, CAST(23 AS INTEGER) AS last_shard, true AS even
        FROM documents""",
    "op7_decontamination": f"""
        WITH docs AS (SELECT doc_id, {_WORDS(f"translate(lower(coalesce(text, '')), '{_MARKS}', '')")} AS w FROM documents),
        items AS (SELECT item_id, {_WORDS(f"translate(lower(coalesce(text, '')), '{_MARKS}', '')")} AS w FROM benchmark),
        d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
        b AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, least(len(w), {decontam.WINDOW}) AS n FROM items),
        met AS (SELECT d.doc_id, b.item_id, b.n, b.j, d.i - b.j AS shift FROM d JOIN b ON d.word = b.word),
        often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM met),
        runs AS (
            SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {decontam.WINDOW - 1} FOLLOWING) AS matched
            FROM often WHERE 5 * total >= 4 * n),
        best AS (SELECT doc_id, item_id, n, max(matched) AS matched FROM runs WHERE 5 * matched >= 4 * n GROUP BY doc_id, item_id, n),
        marks AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(matched / n) AS best_share FROM best GROUP BY doc_id)
        SELECT o.doc_id, m.n_items IS NOT NULL AS contaminated, coalesce(m.n_items, 0) AS n_items, coalesce(m.item_ids, '') AS item_ids, coalesce(m.best_share, 0.0::DOUBLE) AS best_share
        FROM documents o LEFT JOIN marks m ON o.doc_id = m.doc_id""",
    "op8_minhash": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS(f"translate(coalesce(text, ''), {_UPPER}, {_LOWER})")} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
        posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM posted a JOIN posted b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM met WHERE 100 * shared >= 80 * (n_a + n_b - shared)),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM sets s JOIN least_of c ON s.doc_id = c.doc_id""",
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (
            SELECT k.*, coalesce(c.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
