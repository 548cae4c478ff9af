"""Streams: verdicts on arriving records, incremental reputation, rolling figures, exact rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.analyze import analyze


def verdicts(records: DataFrame) -> DataFrame:
    """The analysis of a stream of records: projections only, so it streams as it is."""
    return analyze(records).select("id", "kind", "score", "level", "confidence", F.transform("risky", lambda s: s["id"]).alias("reasons"))


def live_reputation(reports: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window, domain, reports, reporters (different ones, about; 0 without a column reporter), last_reported_at of a stream
    of report rows; state is dropped when a window and the time for late rows have passed."""
    reporter = F.col("reporter") if "reporter" in reports.columns else F.lit(None).cast("string").alias("reporter")
    rows = reports.withWatermark("reported_at", late).select("reported_at", reporter, F.explode("domains").alias("domain"))
    return rows.groupBy(F.window("reported_at", window), "domain").agg(F.count("*").alias("reports"), F.approx_count_distinct("reporter").alias("reporters"), F.max("reported_at").alias("last_reported_at"))


def live_trend(rows: DataFrame, at: str, level: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window, level, n of a stream of verdicts."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), level).agg(F.count("*").alias("n"))


def rate_limit(requests: DataFrame, key: str, at: str, window_s: int = 60, most: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, at, n, remaining, limited for each request of a stream: fixed windows that start with a key's first request
    after the last window's end.  Rows later than ``late`` are left out; the state of a key (two numbers) is dropped
    when the watermark is two windows past the end of its last one."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, 0)
        for frame in frames:
            frame = frame.sort_values(at, kind="stable")
            numbers = []
            for us in frame[at].astype("int64") // (1000 if frame[at].dtype == "datetime64[ns]" else 1):
                if us >= reset:
                    count, reset = 0, us + window_s * 1_000_000
                count += 1
                numbers.append(count)
            out = pd.DataFrame({key: frame[key], at: frame[at], "n": numbers})
            out["remaining"] = (most - out["n"]).clip(lower=0)
            out["limited"] = out["n"] > most
            yield out
        state.update((count, reset))
        state.setTimeoutTimestamp(max(reset // 1000 + 2 * window_s * 1000, state.getCurrentWatermarkMs() + 1))

    kinds = dict(requests.dtypes)
    out = f"{key} {kinds[key]}, {at} timestamp, n long, remaining long, limited boolean"
    return requests.withWatermark(at, late).select(key, at).groupBy(key).applyInPandasWithState(step, out, "count long, reset long", "append", GroupStateTimeout.EventTimeTimeout)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions below path, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    done = [f.getPath().getParent().getName() for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))]
    return sorted(int(name.split("=")[1]) for name in done)


def keep_latest(rows: DataFrame, path: str, at: str, most: int, checkpoint: str, *ties: str) -> StreamingQuery:
    """Keeps the newest ``most`` rows of a stream as Parquet; ``kept`` reads them.

    Each batch writes a version made of the version before and its own rows, then drops all but these two; a batch that
    is run again after a failure starts from the version before it, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < number]
        every = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/batch={before[-1]}")) if before else batch
        every.orderBy(F.desc(at), *ties).limit(most).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in before[:-1]:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The rows that keep_latest holds now; an error where there is no version yet."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"nothing is kept at {path} yet")
    return spark.read.parquet(f"{path}/batch={versions[-1]}")
