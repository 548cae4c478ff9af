"""Line deduplication: lines found in many documents stay in one of them only.

Plan: one pass explodes the normalised lines of at least ``min_chars`` code points to (row, position, 128-bit hash)
rows, without their texts, and writes them to the shared folder.  A grouped distinct count with partial aggregation
finds the hashes over the threshold, which are written too, so that nothing but the exchanges stands before the join
that marks the positions to drop: Spark splits it at hot lines, or broadcasts the hashes where they are few.  Marks
return to the documents, which move through one exchange, and a slice per gap reassembles the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, pick, stored

MIN_CHARS = 20
MIN_DOCS = 3


def _dropped(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, row_hash, dropped): for each row that loses lines, their positions from 0, ascending."""
    keys = F.transform(F.split(ascii_lower(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.filter(
        F.transform(keys, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))),
        lambda s: s.isNotNull(),
    )
    lines = stored(rows.select("doc_id", "row_hash", F.inline(hashed)).where(F.col("doc_id").isNotNull()), "lines")
    common = (
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    common = stored(common, "common-lines")
    return (
        lines.join(common, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "row_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, text (what is kept), n_lines (before), n_dropped.

    A text is split at line feeds; null and empty texts are one empty line.  A line's key has ASCII blanks stripped
    at both ends and A-Z lower-cased.  Keys of at least ``min_chars`` code points found in at least ``min_docs``
    different doc_ids lose all their lines except in the largest doc_id.  Rows without a doc_id neither count nor
    lose lines.  Repeated rows of a doc_id count as one document and are treated alike.  A text that loses all its
    lines becomes empty.  Any input row gives one output row; an empty table gives none.
    """
    rows = pick(docs, "doc_id", "text", *carry).withColumn("row_hash", F.xxhash64("text"))
    marks = _dropped(rows, min_chars, min_docs)
    marks = marks.select(F.col("doc_id").alias("m_id"), F.col("row_hash").alias("m_hash"), "dropped")
    both = rows.join(marks, (rows.doc_id == F.col("m_id")) & (rows.row_hash == F.col("m_hash")), "left")
    both = both.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("gone", F.coalesce("dropped", F.array().cast("array<int>")))
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)  # noqa: E731  the first line of gap k
    until = lambda k: F.when(k == F.size("gone"), F.size("lines")).otherwise(F.get("gone", k))
    gaps = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", after(k) + 1, until(k) - after(k)))
    kept = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(gaps), "\n"))
    return both.select("doc_id", *carry, kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
