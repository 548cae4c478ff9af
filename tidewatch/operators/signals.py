"""Signals: the weighted findings that analyzers emit, as an array of structs in each row.

A row's signals never leave it: analyzers are projections, and so are merging and scoring.  The long table is one
explode away.  ord keeps the order of emission for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNAL = "struct<ord:int,id:string,category:string,weight:int,evidence:string,url:string>"


def signal(when: Column, ord: int, id: str | Column, category: str, weight: int | Column, evidence: Column | str | None = None, url: Column | None = None) -> Column:
    """The signal where ``when`` is true, else null."""
    text = F.lit(evidence) if evidence is None or isinstance(evidence, str) else evidence
    value = F.struct(
        F.lit(ord).alias("ord"), (F.lit(id) if isinstance(id, str) else id).alias("id"), F.lit(category).alias("category"),
        (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight"), text.cast("string").alias("evidence"),
        (F.lit(None) if url is None else url).cast("string").alias("url"),
    )
    return F.when(when, value.cast(SIGNAL))


def gathered(*found: Column) -> Column:
    """Those that are not null, as an array."""
    return F.array_compact(F.array(*found))


def no_signals() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def strongest(signals: Column) -> Column:
    """Of each id the signal with the largest absolute weight, the first of equals, in the order of emission."""
    numbered = F.transform(F.filter(signals, lambda s: s["weight"].isNotNull()), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    better = lambda a, b: (F.abs(a["s"]["weight"]) > F.abs(b["s"]["weight"])) | ((F.abs(a["s"]["weight"]) == F.abs(b["s"]["weight"])) & (a["i"] < b["i"]))
    kept = F.filter(numbered, lambda x: ~F.exists(numbered, lambda y: (y["s"]["id"] == x["s"]["id"]) & better(y, x)))
    return F.transform(kept, lambda x: x["s"])


def long_table(df: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each struct of an array column, with the key.

    The outer generator and a test afterwards, as for the plain one Spark would infer a filter on the array, push it
    below the projections that make the array, and work everything out twice.
    """
    first = df.schema[column].dataType.elementType.fieldNames()[0]
    return df.select(key, F.inline_outer(column)).where(F.col(first).isNotNull())
