"""The main plan: records in, verdicts out.  One scan and projections; the only joins are those to tables of scores
and reputation that callers hand in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, mail, rx, text
from ..functions import knowledge as K
from ..functions.urls import parse_url
from ..operators.explain import explanation
from ..operators.page_signals import page_signals
from ..operators.models import MessageModel, predict_messages, predict_urls
from ..operators.scoring import Scoring, feature_groups, fuse, probability_signal, score_signals
from ..operators.sender_signals import sender_signals
from ..operators.signals import SIGNAL, no_signals
from ..operators.text_facts import urls_of
from ..operators.text_signals import claimed_brands, haystacks, text_signals
from ..operators.url_signals import url_signals
from ..sources.records import records

_HEADERS = r"^(?:from|to|subject|date|received|return-path|reply-to|message-id|authentication-results)\s*:"
_ADDRESS = r"^(?:https?://|www\.)|^[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:[/:?#]|$)"


def input_type(content: Column, url: Column, page: Column) -> Column:
    """website, url, email, sms or message, by the first rule that fits."""
    link, markup = text.text_or_empty(url), F.trim(text.text_or_empty(page))
    body = F.trim(text.plain_blanks(content), F.lit(" \t\n\x0b\f\r"))
    return text.let(body, lambda body: (
        F.when(markup != "", "website").when((link != "") & (body == ""), "url").when(body == "", "message")
        .when(rx.matches(body, r"^<(?:!doctype|html|head|body)\b") | (body.contains("<") & rx.matches(body, r"<html[\s>]") & rx.matches(body, "</html>")), "website")
        .when(F.substring(body, 1, 1500).rlike("(?im)" + _HEADERS), "email")
        .when(~body.rlike(r"\s") & rx.matches(body, _ADDRESS), "url")
        .when(F.size(F.split(body, r"\s+", 46)) <= 45, "sms").otherwise("message")
    ))


def channel(kind: Column) -> Column:
    found = F.lit("message")
    for k, v in K.CHANNELS.items():
        found = F.when(kind == k, v).otherwise(found)
    return found


def preprocess(df: DataFrame) -> DataFrame:
    """Adds kind, channel, body, header_text, markup, page_links, urls and body_urls; keeps all columns.

    Given headers count before those found in the content.
    """
    df = records(df)
    keep = df.columns
    df = df.withColumn("kind", F.when(F.col("type").isNotNull() & (F.col("type") != "auto"), F.col("type")).otherwise(input_type(F.col("content"), F.col("url"), F.col("html"))))
    df = df.withColumn("_mail", mail.split_mail(F.when(F.col("kind") == "email", F.col("content"))))
    raw = F.when(F.col("kind") == "email", F.col("_mail")["body"]).otherwise(text.text_or_empty(F.col("content")))
    df = df.withColumn("_body", raw)
    df = df.withColumn("_is_page", (F.col("kind") == "website") & (F.coalesce("html", F.lit("")) == "") & rx.matches(F.col("_body"), r"<[a-z][\s\S]*>"))
    df = df.withColumn("markup", F.when(F.col("_is_page"), F.col("_body")).otherwise(text.text_or_empty(F.col("html"))))
    reduced = F.col("_is_page") | ((F.col("markup") != "") & (F.trim("_body") == ""))
    df = df.withColumn("body", F.when(reduced, html.html_to_text(F.col("markup"))).otherwise(F.col("_body")))
    given = F.array_join(F.transform(F.map_entries(F.col("headers")), lambda e: F.concat(e["key"], F.lit(": "), F.regexp_replace(F.coalesce(e["value"], F.lit("")), r"\n", " "))), "\n")
    names = F.coalesce(F.map_keys("headers"), F.array().cast("array<string>"))
    own = F.filter(F.split(F.coalesce(F.when(F.col("kind") == "email", F.col("_mail")["header_text"]), F.lit("")), "\n"), lambda x: ~F.array_contains(names, F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)))) & (x != ""))
    df = df.withColumn("header_text", F.concat_ws("\n", F.nullif(given, F.lit("")), F.nullif(F.array_join(own, "\n"), F.lit(""))))
    df = df.withColumn("_base", F.when(F.col("markup") != "", text.text_or_empty(F.col("url"))))
    df = df.withColumn("_p", parse_url(F.col("_base"))).withColumn("_anchors", F.when(F.col("markup") != "", html.page_features(F.col("markup"), F.col("_p"))["anchors"]))
    anchors = F.transform("_anchors", lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text")))
    df = df.withColumn("page_links", F.when(F.size("links") > 0, F.col("links")).when(F.col("markup") != "", anchors).otherwise(F.array().cast("array<struct<href:string,text:string>>")))
    df = df.withColumn("body_urls", urls_of(F.col("body")))
    bare = F.trim(text.text_or_empty(F.col("content")))
    of_link = F.when(F.col("kind") == "url", F.concat(text.urls_in(F.col("content")), F.when((bare != "") & ~bare.rlike(r"\s"), F.array(bare)).otherwise(F.array().cast("array<string>"))))
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(of_link, none), F.when(F.coalesce("url", F.lit("")) != "", F.array("url")).otherwise(none), F.filter(F.transform("page_links", lambda x: x["href"]), lambda x: F.coalesce(x, F.lit("")) != ""), "body_urls")
    df = df.withColumn("urls", F.array_distinct(every)).withColumn("channel", channel(F.col("kind")))
    return df.select(*keep, "kind", "channel", "body", "header_text", "markup", "page_links", "urls", "body_urls")


def rule_signals(df: DataFrame) -> DataFrame:
    """Adds signals (text, sender, URL and page, in this order) and what the analyzers found, to a preprocessed df."""
    written = F.when((F.trim("body") != "") & (F.col("kind") != "url"), F.col("body"))
    df = df.withColumn("_text", written)
    # who has only a text claims the brands of the text, which its signals know
    df = df.withColumn("_head", F.concat_ws(" ", F.coalesce(mail.header(F.col("header_text"), "subject"), F.lit("")), F.coalesce(mail.header(F.col("header_text"), "from"), F.lit("")), F.coalesce("sender_name", F.lit(""))))
    df = df.withColumn("_alone", F.col("_text").isNotNull() & (F.trim("_head") == ""))
    df = df.withColumn("_of", F.when(~F.col("_alone"), F.concat_ws(" ", "body", "_head")))
    keep = df.columns
    df = haystacks(df, "_of", prefix="_b_").select(*keep, F.col("_b_canonical").alias("_b"))
    df = text_signals(df, "_text", "page_links", found="body_urls")
    df = df.withColumn("brands", F.when(F.col("_alone"), F.col("claimed")).otherwise(claimed_brands("_b")))
    df = df.withColumn("text_signals", F.when(F.col("_text").isNotNull(), F.col("text_signals")).otherwise(no_signals()))
    df = df.withColumn("tactics", F.when(F.col("_text").isNotNull(), F.col("tactics")).otherwise(F.slice("tactics", 1, 0)))
    df = sender_signals(df, "header_text", F.col("sender_email"), F.col("sender_name"), F.col("reply_to"), F.col("brands"))
    df = url_signals(df, "urls", F.get("brands", F.lit(0))["sites"])
    df = page_signals(df, "markup", "url")
    df = df.withColumn("signals", F.concat("text_signals", "sender_signals", "url_signals", "page_signals"))
    return df.drop("_head", "_alone", "_of", "_b", "_text", "claimed", "text_urls", "body_urls")


Provider = Callable[[DataFrame], Column]


def ranked_urls(results: Column) -> Column:
    """The links of url_results, those with most points first, equals in their order."""
    order = F.array_sort(F.transform(results, lambda r, i: F.struct((-r["points"]).alias("o"), i.alias("i"), r["url"].alias("url"))))
    return F.transform(order, lambda x: x["url"])


def model_stage(key: str, message_model: MessageModel | None = None, url_model: PipelineModel | None = None) -> Callable[[DataFrame], DataFrame]:
    """A step for analyze(enrich=...): adds ml (struct used, probability, models, message, url) and ml_signals.

    The message model reads the body where it is not blank, the URL model the link ranked first; the probability is
    the greater of the two.  key: a column that tells rows apart; rows with a null key or nothing to classify get
    used = false and no signals.
    """

    def step(df: DataFrame) -> DataFrame:
        keep = df.columns
        df = df.withColumn("_first", F.get(ranked_urls(F.col("url_results")), F.lit(0)))
        df = df.withColumn("_m", F.lit(None).cast("double")).withColumn("_u", F.lit(None).cast("double"))
        if message_model is not None:
            found = predict_messages(df.where(F.trim(F.coalesce("body", F.lit(""))) != ""), message_model, key, "body").select(F.col(key).alias("_key"), F.col("probability").alias("_pm"))
            df = df.join(found.dropDuplicates(["_key"]), F.col(key) == F.col("_key"), "left").withColumn("_m", F.col("_pm")).drop("_key", "_pm")
        if url_model is not None:
            df = predict_urls(df, url_model, "_first").withColumn("_u", F.when(F.col("_first").isNotNull(), F.col("probability"))).drop("probability", "indicators", "label")
        signals = F.array_compact(F.array(*[_model_signal(F.col(c), kind, i) for i, (c, kind) in enumerate((("_m", "message"), ("_u", "url")))]))
        models = F.array_compact(F.array(F.when(F.col("_m").isNotNull(), F.lit("message")), F.when(F.col("_u").isNotNull(), F.lit("url"))))
        ml = F.struct((F.size(models) > 0).alias("used"), F.greatest("_m", "_u").alias("probability"), models.alias("models"), F.col("_m").alias("message"), F.col("_u").alias("url"))
        return df.select(*keep, ml.alias("ml"), signals.alias("ml_signals"))

    return step


def _model_signal(p: Column, kind: str, place: int) -> Column:
    s = probability_signal(p, kind)
    row = F.struct(F.lit(601 + place).alias("ord"), s["id"].alias("id"), s["category"].alias("category"), s["weight"].alias("weight"), p.cast("string").alias("evidence"), F.lit(None).cast("string").alias("url"))
    return F.when(s.isNotNull(), row.cast(SIGNAL))


def analyze(df: DataFrame, providers: tuple[Provider, ...] = (), review_score: str | None = None, review_weight: float = 0.35, scoring: Scoring = Scoring(), enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The whole analysis of records (see sources.records.FIELDS; missing columns are nulls).

    providers: functions from the frame with the rules' signals to a column of further signals, such as the model's or
    reputation's.  enrich: a step on that frame before them, such as model_stage, whose ml_signals count if it adds
    any.  review_score: a column with another score of 0 to 100 to blend in.  Adds, besides what the steps
    add, groups (feature groups) and explanation; score and level are the final ones.
    """
    df = rule_signals(preprocess(df))
    df = df.withColumn("groups", feature_groups(F.col("signals")))
    if enrich:
        df = enrich(df)
        providers = (*((lambda d: F.col("ml_signals"),) if "ml_signals" in df.columns else ()), *providers)
    for p in providers:
        df = df.withColumn("signals", F.concat("signals", F.coalesce(p(df), no_signals())))
    df = score_signals(df, "signals", scoring)
    if review_score:
        df = fuse(df, F.col(review_score), review_weight, scoring)
        df = df.withColumn("rule_score", F.col("score")).withColumn("score", F.col("fused_score")).withColumn("level", F.col("fused_level")).drop("fused_score", "fused_level")
    df = df.withColumn("explanation", explanation())
    body = F.when(F.coalesce("body", F.lit("")) != "", F.col("body")).otherwise(F.coalesce("url", F.lit("")))
    return df.withColumn("preview", text.shortened(text.squeeze(body), 320))


def level_counts(df: DataFrame) -> DataFrame:
    """How many verdicts there are of each level: one row, low, medium, high."""
    return df.agg(*[F.count_if(F.col("level") == k).alias(k) for k in ("low", "medium", "high")])
