"""History, reports, reputation and the dashboard's figures, over tables of verdicts and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import knowledge as K
from ..functions import text, urls
from ..functions.text import among, half_up, shortened
from ..operators.signals import SIGNAL

HISTORY_LIMIT, REPORT_LIMIT, TREND_DAYS, TOP = 500, 2000, 14, 8


def history_rows(analysed: DataFrame, at: Column, duration_ms: Column | None = None) -> DataFrame:
    """The redacted record of each verdict of plans.analyze."""
    top = F.get("risky", F.lit(0))["id"]
    domains = F.slice(F.filter(F.transform("url_results", lambda u: u["rd"]), lambda d: d != ""), 1, 5)
    return analysed.select(
        text.fnv1a(F.concat_ws("|", at.cast("string"), F.col("preview"), F.coalesce("url", F.lit("")))).alias("id"), at.alias("analyzed_at"), F.col("kind").alias("type"), "channel", "score", "level", "confidence",
        shortened(F.col("preview"), 160).alias("preview"), "url", domains.alias("domains"), top.alias("top_reason"),
        F.slice(F.transform("tactics", lambda t: t["id"]), 1, 8).alias("tactics"), F.transform("categories", lambda c: c["category"]).alias("categories"),
        (F.lit(0) if duration_ms is None else duration_ms).cast("long").alias("duration_ms"),
    )


def report_rows(reports: DataFrame) -> DataFrame:
    """reports: reported_at, url, text, reason, level, reporter.  Domains of the url, cut texts, hashed reporter."""
    rd = urls.registrable_domain(F.col("_p")["host"])
    df = reports.withColumn("_p", urls.parse_url(F.col("url")))
    domains = F.when(F.col("_p").isNotNull(), F.array(rd)).otherwise(F.array().cast("array<string>"))
    who = F.when(F.coalesce("reporter", F.lit("")) != "", text.fnv1a(F.col("reporter")))
    return df.select("reported_at", "url", domains.alias("domains"), shortened(F.coalesce("text", F.lit("")), 160).alias("preview"), shortened(F.col("reason"), 240).alias("reason"), "level", who.alias("reporter"))


def reputation(reports: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """domain, reports, reporters (different ones), last_reported_at.  wanted: a column domain to keep."""
    rows = reports.select(F.explode("domains").alias("domain"), "reporter", "reported_at")
    if wanted is not None:
        rows = rows.join(wanted.select("domain").distinct(), "domain", "left_semi")
    return rows.groupBy("domain").agg(F.count("*").alias("reports"), F.count_distinct("reporter").alias("reporters"), F.max("reported_at").alias("last_reported_at"))


def report_weight(reports: Column) -> Column:
    weight = F.lit(None).cast("int")
    for least, w in reversed(K.REPORT_WEIGHTS):
        weight = F.when(reports >= least, F.lit(w)).otherwise(weight)
    return weight


def intel_signals(links: DataFrame, known: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """links: id, domain, url.  known: reputation rows; blocklist: url.  id and its array intel of signals: one for each
    reported domain that is not trusted, and one if any link is listed."""
    hits = links.select("id", "domain").distinct().join(known, "domain").where(~among(F.col("domain"), K.TRUSTED_DOMAINS))
    found = hits.select("id", F.struct(F.lit(501).alias("ord"), F.concat(F.lit("intel-reported-"), "domain").alias("id"), F.lit("intel").alias("category"), report_weight(F.col("reports")).alias("weight"), F.col("last_reported_at").cast("string").alias("evidence"), F.lit(None).cast("string").alias("url")).cast(SIGNAL).alias("s"))
    if blocklist is not None:
        listed = links.join(blocklist.select("url").distinct(), "url", "left_semi").groupBy("id").agg(F.min("url").alias("u"))
        found = found.union(listed.select("id", F.struct(F.lit(502).alias("ord"), F.lit("intel-safe-browsing").alias("id"), F.lit("intel").alias("category"), F.lit(K.BLOCKLIST_WEIGHT).alias("weight"), F.col("u").alias("evidence"), F.col("u").alias("url")).cast(SIGNAL).alias("s")))
    return found.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("intel"))


def latest(rows: DataFrame, at: str, most: int, *ties: str) -> DataFrame:
    """The newest ``most`` rows (bounded retention)."""
    return rows.orderBy(F.desc(at), *ties).limit(most)


def page_of(rows: DataFrame, at: str, limit: int = 25, offset: int = 0, level: str | None = None, *ties: str) -> DataFrame:
    """A page of the history, newest first; limit is held to 1 to 100."""
    rows = rows.where(F.col("level") == level) if level else rows
    return rows.orderBy(F.desc(at), *ties).offset(max(0, offset)).limit(min(100, max(1, limit)))


def totals(rows: DataFrame) -> DataFrame:
    """One row: analyses, low, medium, high, average_score, average_duration_ms (rounded half up, 0 for none)."""
    mean = lambda c: F.coalesce(half_up(F.avg(c)).cast("long"), F.lit(0))
    return rows.agg(F.count("*").alias("analyses"), *[F.count_if(F.col("level") == k).alias(k) for k in ("low", "medium", "high")], mean("score").alias("average_score"), mean("duration_ms").alias("average_duration_ms"))


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def top_items(rows: DataFrame, column: str, most: int = TOP) -> DataFrame:
    """item, n: the most frequent elements of an array column, ties by the item."""
    return rows.select(F.explode(column).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(most)


def trend(rows: DataFrame, at: str = "analyzed_at", days: int = TREND_DAYS) -> DataFrame:
    """day, total, high, medium, low of the last ``days`` days that have rows, oldest first."""
    daily = rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("total"), *[F.count_if(F.col("level") == k).alias(k) for k in ("high", "medium", "low")])
    return daily.orderBy(F.desc("day")).limit(days).orderBy("day")


def rate_limited(requests: DataFrame, key: str, at: str, *ties: str, window_s: int = 60, most: int = 60) -> DataFrame:
    """As rate_limits, with windows that start on the epoch's multiples of window_s: for limits by the clock."""
    n = F.row_number().over(Window.partitionBy(key, "_w").orderBy(at, *ties))
    df = requests.withColumn("_w", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(window_s * 1_000_000))).withColumn("n", n)
    return df.withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("n"))).withColumn("limited", F.col("n") > most).drop("_w")


def _in_order(rows: DataFrame, key: str, at: str, ties: tuple[str, ...], out: str, step: Callable[[Any], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """rows with the columns that step adds to batches of them, which are in the order of key, time and ties.

    Keys are dealt to tasks and sorted there; a task reads its rows once, in Arrow batches, and keeps the state of one
    key only, so a key of any size needs no more memory than a batch.  Null keys are a key.
    """
    ordered = rows.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), at, *ties)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = step(None)
        for b in batches:
            yield fold(b)

    return ordered.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), out]))


def rate_limits(requests: DataFrame, key: str, at: str, *ties: str, window_s: int = 60, most: int = 60) -> DataFrame:
    """requests with n (the request's number in its window), remaining and limited.  A key's window starts with its
    first request, and anew with the first one at or after its end."""

    def step(_: Any) -> Callable[[pd.DataFrame], pd.DataFrame]:
        state: list[Any] = [object(), None, 0]  # key, end of the window, count

        def fold(b: pd.DataFrame) -> pd.DataFrame:
            numbers = []
            for k, t in zip(b[key], b[at], strict=True):
                k = None if pd.isna(k) else k
                if k != state[0] or t >= state[1]:
                    state[:] = [k, t + pd.Timedelta(seconds=window_s), 0]
                state[2] += 1
                numbers.append(state[2])
            n = pd.Series(numbers, index=b.index, dtype="int64")
            return b.assign(n=n, remaining=(most - n).clip(lower=0), limited=n > most)

        return fold

    return _in_order(requests.where(F.col(at).isNotNull()), key, at, ties, "n long, remaining long, limited boolean", step)


def circuit(calls: DataFrame, key: str, at: str, failed: str, *ties: str, threshold: int = 3, cooldown_s: float = 30) -> DataFrame:
    """calls with refused (the circuit was open, the call was not made) and failures (the count after the call).

    The circuit opens with the failure that reaches the threshold.  A call more than cooldown_s later closes it and
    starts the count anew, and so does a success.
    """

    def step(_: Any) -> Callable[[pd.DataFrame], pd.DataFrame]:
        state: list[Any] = [object(), 0, None]  # key, failures, when it opened

        def fold(b: pd.DataFrame) -> pd.DataFrame:
            counts, refused = [], []
            for k, t, bad in zip(b[key], b[at], b[failed], strict=True):
                k = None if pd.isna(k) else k
                if k != state[0]:
                    state[:] = [k, 0, None]
                if state[1] >= threshold and t - state[2] > pd.Timedelta(seconds=cooldown_s):
                    state[1] = 0
                refused.append(state[1] >= threshold)
                if not refused[-1]:
                    state[1] = state[1] + 1 if bad else 0
                    if state[1] >= threshold:
                        state[2] = t
                counts.append(state[1])
            return b.assign(failures=pd.Series(counts, index=b.index, dtype="int64"), refused=pd.Series(refused, index=b.index, dtype="bool"))

        return fold

    return _in_order(calls.where(F.col(at).isNotNull()), key, at, ties, "failures long, refused boolean", step)


def breaker(calls: DataFrame, key: str, at: str, failed: str, *ties: str, threshold: int = 3) -> DataFrame:
    """calls with failures: how many in a row have failed up to and with this one, and open: whether that reaches the
    threshold.  A success starts the count anew."""
    order = Window.partitionBy(key).orderBy(at, *ties)
    run = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = calls.withColumn("_run", run)
    failures = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(key, "_run").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("failures", failures).withColumn("open", F.col("failures") >= threshold).drop("_run")
