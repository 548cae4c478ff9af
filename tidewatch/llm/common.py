"""Helpers shared by the operators: column picking, word splitting, durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns with exactly these names, the first of each; all others are left out.

    Works where df has further columns whose names differ only in case or occur twice.  A missing name gives nulls.
    """
    own = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(own))])
    return flat.select(*[(F.col(f"_c{own.index(n)}") if n in own else F.lit(None)).alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs of other characters than ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids give null."""
    return F.crc32(doc_id.cast("string")) % folds


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, the session's checkpoint
    folder; a new temporary one only for a local master, whose executors are in the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tidewatch-")
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    The files stay until the interpreter ends, as the lazy results built on them may be used at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
