"""Analysis records: their schema, readers and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {
    "id": "STRING", "type": "STRING", "content": "STRING", "url": "STRING", "html": "STRING", "sender_email": "STRING", "sender_name": "STRING", "reply_to": "STRING",
    "links": "ARRAY<STRUCT<href:STRING,text:STRING>>", "headers": "MAP<STRING,STRING>",
}
RECORD = ", ".join(f"{k} {v}" for k, v in FIELDS.items())
# The limits of a record.
TYPES = ("auto", "message", "email", "sms", "chat", "whatsapp", "social", "url", "website")
MAX_CONTENT, MAX_URL, MAX_LINKS, MAX_LABEL, MAX_ADDRESS, MAX_NAME, MAX_HEADERS, MAX_KEY, MAX_VALUE = 200_000, 2048, 100, 300, 320, 200, 60, 80, 2000


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; broken lines give rows of nulls, which validation sets aside."""
    return spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180 tables with a header: quotes, doubled quotes and line feeds within quotes."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the files appear all at once."""
    df.write.json(path, mode="overwrite")


def records(df: DataFrame) -> DataFrame:
    """df with all columns of FIELDS, missing ones as nulls of their type, further ones kept."""
    have = set(df.columns)
    return df.withColumns({k: F.lit(None).cast(v) for k, v in FIELDS.items() if k not in have})


def validated(df: DataFrame) -> DataFrame:
    """Adds error: ``empty_input``, ``input_too_large`` or null; other fields are cut to their limits.

    An unknown type becomes auto, a null content empty.
    """
    df = records(df)
    cut = lambda c, n: F.substring(F.trim(c), 1, n)
    content = F.coalesce("content", F.lit(""))
    size = F.greatest(F.length(content), F.length(F.coalesce("html", F.lit(""))))
    empty = (F.trim(F.regexp_replace(content, r"\s", " ")) == "") & (F.coalesce(F.trim("url"), F.lit("")) == "") & (F.coalesce("html", F.lit("")) == "")
    links = F.transform(F.slice(F.filter("links", lambda x: x["href"].isNotNull()), 1, MAX_LINKS), lambda x: F.struct(F.substring(x["href"], 1, MAX_URL).alias("href"), F.substring(F.coalesce(x["text"], F.lit("")), 1, MAX_LABEL).alias("text")))
    pairs = F.transform(F.slice(F.map_entries("headers"), 1, MAX_HEADERS), lambda e: F.struct(F.substring(F.lower(e["key"]), 1, MAX_KEY).alias("key"), F.substring(F.coalesce(e["value"], F.lit("")), 1, MAX_VALUE).alias("value")))
    return df.withColumns({
        "error": F.when(empty, "empty_input").when(size > MAX_CONTENT, "input_too_large"),
        "type": F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise(F.lit("auto")),
        "content": content, "url": cut(F.col("url"), MAX_URL), "links": links, "headers": F.map_from_entries(pairs),
        "sender_email": cut(F.col("sender_email"), MAX_ADDRESS), "sender_name": cut(F.col("sender_name"), MAX_NAME), "reply_to": cut(F.col("reply_to"), MAX_ADDRESS),
    })


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid records, and those set aside with their error."""
    checked = validated(df)
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def with_pages(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of type website get the HTML of an already fetched page of their url (columns url, html); where there
    is none, they are judged by their link alone, and fetched says so."""
    known = pages.select(F.col("url").alias("_u"), F.col("html").alias("_h")).dropDuplicates(["_u"])
    both = df.join(known, df.url == F.col("_u"), "left")
    return both.withColumn("html", F.coalesce(F.nullif("html", F.lit("")), "_h")).withColumn("fetched", F.col("_h").isNotNull()).drop("_u", "_h")
