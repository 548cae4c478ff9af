"""A query for each family of operators over the whole synthetic tables, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import html, mail, text, urls
from .functions import knowledge as K
from .functions import knowledge_model as M
from .operators import models, scoring
from .operators.signals import SIGNAL, long_table
from .operators.page_signals import page_signals
from .operators.sender_signals import sender_signals
from .operators.text_signals import claimed_brands, text_signals
from .operators.url_features import url_features
from .operators.url_signals import url_signals
from .plans import evaluate, history
from .plans.analyze import analyze, channel, input_type
from .sources.records import validated


#: What stands before the last </body> (or all), and the rest.
_BODY = r"(?is)\A(.*(?=</body>)|(?!.*</body>).*)(.*)\z"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Rows of few files dealt to all cores: to analyse a text takes milliseconds, far more than to move it.  Tables of
    as many files as there are cores, or more, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _overlay(spark: SparkSession, rows: tuple[str, ...], column: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(rows)), f"k int, {column} string"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: every document with a snippet in front."""
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    over = _overlay(spark, fixtures.TEXTS, "snippet")
    return docs.join(over, (F.col("doc_id") % len(fixtures.TEXTS)).cast("int") == F.col("k")).select("doc_id", F.concat("snippet", F.lit(" "), "text").alias("content"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url: every page's own link and one of the overlay's."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    over = _overlay(spark, fixtures.URLS, "link")
    laid = pages.join(over, (F.col("page_id") % len(fixtures.URLS)).cast("int") == F.col("k")).select((-F.col("page_id") - 1).alias("page_id"), F.col("link").alias("url"))
    return pages.union(laid)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: every page with a fragment before the last end of its body, or after all where there is none."""
    pages = _spread(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    over = _overlay(spark, fixtures.PAGES, "fragment")
    return pages.join(over, (F.col("page_id") % len(fixtures.PAGES)).cast("int") == F.col("k")).select("page_id", "url", F.concat(F.regexp_extract("html", _BODY, 1), "fragment", F.regexp_extract("html", _BODY, 2)).alias("html"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of the history: analyzed_at, type, level, score, duration_ms, reporter."""
    e = _table(spark, sf_dir, "events")
    level = F.when(F.col("value") <= 30, "low").when(F.col("value") <= 70, "medium").otherwise("high")
    return e.select("event_id", F.col("ts").alias("analyzed_at"), F.col("event_type").alias("type"), level.alias("level"), F.floor("value").alias("score"), F.floor(F.col("value") * 7).alias("duration_ms"), "user_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's link: host, domain, seven signals, category caps, curve, score, level."""
    df = url_signals(_table(spark, sf_dir, "pages").select("page_id", F.array("url").alias("links")), "links")
    df = scoring.score_signals(df, "url_signals")
    first = F.get("url_results", F.lit(0))
    return df.select("page_id", first["host"].alias("host"), first["rd"].alias("rd"), first["scheme"].alias("scheme"), F.array_join(F.array_sort(F.transform("url_signals", lambda s: s["id"])), ",").alias("signals"), F.col("evidence").cast("bigint").alias("evidence"), "score", "level")


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "pages").withColumn("p", urls.parse_url(F.col("url"))).withColumn("host", F.col("p")["host"])
    return df.select("page_id", F.col("p")["scheme"].alias("scheme"), "host", F.col("p")["path"].alias("path"), F.col("p")["query"].alias("query"), urls.registrable_domain(F.col("host")).alias("rd"), urls.top_level(F.col("host")).alias("tld"), urls.domain_label(F.col("host")).alias("label"), urls.subdomain(F.col("host")).alias("sub"))


def url_signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = url_signals(links(spark, sf_dir).select("page_id", F.array("url").alias("links")), "links")
    return long_table(df, "page_id", "url_signals").select("page_id", "id", "category", "weight")


def url_model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_features(_table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", *M.URL_FEATURES)


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    df = messages(spark, sf_dir)
    return df.select(
        "doc_id", F.md5(text.squeeze(c)).alias("squeezed"), text.half_up(text.upper_ratio(c) * 1000).cast("bigint").alias("upper"), F.array_join(text.emails_in(c), ",").alias("emails"),
        text.occurrences(c, "the").alias("thes"), F.md5(text.shortened(c, 160)).alias("preview"), F.md5(text.json_object(F.concat(F.lit("x {a} "), c))).alias("json"),
    )


def message_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.text_statistics(F.col("content"))
    return messages(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", "s.characters", "s.words", "s.links", "s.emails", "s.digits", "s.caps_ratio", "s.exclamations")


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("page_id", F.md5(html.html_to_text(F.col("html"))).alias("text_md5"))


def link_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("doc_id", F.array_join(text.urls_in(F.col("content")), " ").alias("urls"), F.array_join(text.phones_in(F.col("content")), "|").alias("phones"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return messages(spark, sf_dir).select("doc_id", F.md5(text.canonical(text.despaced(c))).alias("canonical"), text.fnv1a(c).alias("record_id"), F.round(text.entropy(c), 6).alias("entropy"))


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each disguise undone by itself: blanks, look-alikes, leet, letters set apart; edit distance with a bound."""
    c = F.col("content")
    return messages(spark, sf_dir).select(
        "doc_id", F.md5(text.plain_blanks(c)).alias("plain"), F.md5(text.dehomoglyph(c)).alias("dehomoglyph"), F.md5(text.deleet(c)).alias("deleet"), F.md5(text.despaced(text.plain_blanks(c))).alias("despaced"),
        text.edit_distance(F.substring(c, 1, 12), F.substring(c, 3, 12), 5).alias("distance"), F.floor(text.half_up(F.length(c) / 7, 2) * 100).cast("bigint").alias("rounded"),
    )


def message_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = input_type(F.col("content"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return messages(spark, sf_dir).select("doc_id", kind.alias("kind")).withColumn("channel", channel(F.col("kind")))


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.col("role").alias("type"), F.col("text").alias("content"))
    for i, odd in enumerate(("", " \t\n", None)):  # each turn again with a text that must not pass
        rows = rows.union(c.select("conv_id", F.col("turn") + 1000 * (i + 1), F.lit("sms"), F.lit(odd).cast("string")))
    return validated(rows).select("conv_id", "turn", "type", "error", F.length("content").alias("n"))


def tactic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_signals(messages(spark, sf_dir), "content")
    return long_table(df, "doc_id", "tactics").select("doc_id", "id", "category", "hits", "weight")


def text_signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text_signals(messages(spark, sf_dir), "content")
    return long_table(df, "doc_id", "text_signals").select("doc_id", "id", "category", "weight")


def message_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analyze(messages(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")))
    return df.select("doc_id", "kind", "score", "level", "confidence", F.array_join(F.transform("risky", lambda s: s["id"]), ",").alias("risky"), F.array_join(F.transform("groups", lambda g: g["points"].cast("string")), ",").alias("groups"), F.array_join("explanation.advice", " ").alias("advice"))


def message_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each message in ids and numbers: score, level, confidence, risky signals and how grave the first
    ones are, signs of trust, points by feature group."""
    df = analyze(messages(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string")))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return df.select(
        "doc_id", "kind", F.col("score").cast("bigint").alias("score"), "level", "confidence", joined("risky", lambda s: s["id"]).alias("risky"), joined("explanation.reasons", lambda r: r["severity"]).alias("severities"),
        F.array_join("explanation.trust", ",").alias("trust"), joined("groups", lambda g: g["points"].cast("string")).alias("group_points"), F.size("url_results").cast("bigint").alias("n_links"),
    )


def sender_signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sender's signals of each mail's head alone; brands are claimed by its From and Subject."""
    over = _overlay(spark, fixtures.MAILS, "head")
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.join(over, (F.col("doc_id") % len(fixtures.MAILS)).cast("int") == F.col("k")).select("doc_id", mail.split_mail(F.col("head"))["header_text"].alias("head"))
    said = F.concat_ws(" ", mail.header(F.col("head"), "subject"), mail.header(F.col("head"), "from"))
    rows = rows.withColumn("said", text.canonical(text.despaced(text.plain_blanks(said)))).withColumn("brands", claimed_brands("said"))
    none = F.lit(None).cast("string")
    df = sender_signals(rows, "head", none, none, none, F.col("brands"))
    return long_table(df, "doc_id", "sender_signals").select("doc_id", "id", "category", "weight")


def page_signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of each page; some pages are taken to come from well-known addresses."""
    at = F.col("page_id") % 7
    address = F.when(at == 3, "https://www.google.com/a/b").when(at == 5, "https://docs.python.org/b").otherwise(F.col("url"))
    df = page_signals(sites(spark, sf_dir).withColumn("url", address), "html", "url")
    return long_table(df, "page_id", "page_signals").select("page_id", "id", "category", "weight")


def mail_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = _overlay(spark, fixtures.MAILS, "head")
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.join(over, (F.col("doc_id") % len(fixtures.MAILS)).cast("int") == F.col("k")).select("doc_id", F.concat("head", "text").alias("content"))
    df = analyze(rows)
    return df.select("doc_id", "kind", "score", "level", F.array_join(F.transform("sender_signals", lambda s: s["id"]), ",").alias("sender_signals"), "sender.address", "sender.spf", "sender.dmarc")


def site_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = analyze(sites(spark, sf_dir).withColumn("type", F.lit("website")))
    return df.select("page_id", "score", "level", F.array_join(F.transform("page_signals", lambda s: s["id"]), ",").alias("page_signals"), "page.login", "page.forms", "page.anchors")


def score_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring core on signals made from order lines: each order is a record, each line a signal."""
    li = _table(spark, sf_dir, "lineitem")
    kinds = ["url", "domain", "sender", "content", "credential-theft", "positive"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("l_suppkey") % 6).cast("int"))
    weight = (F.col("l_quantity").cast("int") % 31) * F.when(kind == "positive", -1).otherwise(1)
    row = F.struct(F.col("l_linenumber").cast("int").alias("ord"), F.concat(F.lit("s"), (F.col("l_partkey") % 9).cast("string")).alias("id"), kind.alias("category"), weight.cast("int").alias("weight"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("url"))
    df = li.select("l_orderkey", row.cast(SIGNAL).alias("s")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("signals"))
    df = scoring.score_signals(df, "signals")
    return df.select("l_orderkey", F.col("evidence").cast("bigint").alias("evidence"), F.size("risky").cast("bigint").alias("risky"), F.size("positives").cast("bigint").alias("positives"), F.size("categories").cast("bigint").alias("categories"), F.col("floor").cast("bigint").alias("floor"), "damping_factor", "damping", "net", "curve", F.col("score").cast("bigint").alias("score"), "level", "confidence", F.array_join(F.transform("categories", lambda c: F.concat_ws(":", c["category"], c["raw"].cast("string"), c["applied"].cast("string"), c["signals"].cast("string"))), ",").alias("by_category"))


def model_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of probabilities and of review scores, and scores blended with reviews."""
    e = _table(spark, sf_dir, "events")
    p, review = F.col("event_id") % 1001 / 1000, (F.col("event_id") % 101).cast("double")
    df = e.select("event_id", scoring.probability_signal(p, "message").alias("m"), scoring.review_signal(review).alias("r"), (F.col("event_id") % 97).cast("int").alias("score"), F.when(F.col("event_id") % 5 == 0, 60).cast("int").alias("floor"), F.when(F.col("event_id") % 3 > 0, review).alias("review"))
    df = scoring.fuse(df, F.col("review"))
    return df.select("event_id", "m.id", F.col("m.weight").cast("bigint").alias("model_weight"), F.col("r.weight").cast("bigint").alias("review_weight"), F.col("fused_score").cast("bigint").alias("fused_score"), "fused_level")


def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.totals(_events(spark, sf_dir))


def history_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.by_type(_events(spark, sf_dir))


def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trend(_events(spark, sf_dir))


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_events(spark, sf_dir), "analyzed_at", history.HISTORY_LIMIT, "event_id").select("event_id", "type", "level", "score")


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page_of(_events(spark, sf_dir), "analyzed_at", 25, 50, "high", "event_id").select("event_id", "type", "score")


def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.array("type", "level", F.concat("type", F.lit("-"), "level")).alias("tactics"))
    return history.top_items(rows, "tactics")


def report_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports on the hosts of all pages, event after event; trusted domains have no weight."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    n = max(1, pages.count())
    e = _table(spark, sf_dir, "events").select(F.col("ts").alias("reported_at"), (F.col("event_id") % n).alias("k"), F.col("user_id").cast("string").alias("reporter"))
    reports = e.join(pages, F.col("k") == F.col("page_id")).select("reported_at", "url", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("level"), "reporter")
    rep = history.reputation(history.report_rows(reports))
    return rep.select("domain", "reports", "reporters", F.unix_micros(F.col("last_reported_at").cast("timestamp")).alias("last_us"), history.report_weight(F.col("reports")).cast("bigint").alias("weight"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return history.rate_limits(e, "event_type", "ts", "event_id", window_s=3600, most=2).select("event_id", F.col("n").cast("bigint").alias("n"), F.col("remaining").cast("bigint").alias("remaining"), "limited")


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") > 40).alias("failed"))
    return history.circuit(e, "user_id", "ts", "failed", "event_id", cooldown_s=86_400).select("event_id", F.col("failures").cast("bigint").alias("failures"), "refused")


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    rows = _table(spark, sf_dir, "labels").join(docs, "doc_id")
    return evaluate.accepted(evaluate.metrics(rows, "quality", F.col("n_chars") > 900, "lang"))


def label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.roc_auc(rows, "quality", "n_chars")


def _scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.floor((F.col("doc_id") * 7919 % 1000 + F.col("quality") * 400) / 1.4) / 1000
    return _table(spark, sf_dir, "labels").select("doc_id", "quality", score.alias("score"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(_scored_labels(spark, sf_dir), "quality", "score")


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tuned_threshold(evaluate.sweep(_scored_labels(spark, sf_dir), "quality", "score"), 0.4)


def threshold_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.robust_threshold(_scored_labels(spark, sf_dir), "quality", "score", "doc_id", max_fpr=0.4)


def latency_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(_events(spark, sf_dir), "duration_ms")


def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.normalized(messages(spark, sf_dir), "content").select("doc_id", F.md5("normalized").alias("normalized_md5"), F.length("normalized").alias("n"))


def url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark, sf_dir).withColumn("label", (F.col("page_id") < 0).cast("int"))
    return models.predict_urls(rows, models.train_url_model(rows, "url", "label"), "url").select("page_id", "probability", "label", F.array_join(F.transform("indicators", lambda i: i["feature"]), ",").alias("indicators"))


def message_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short messages (conversation turns and snippets) classified by the trained text model."""
    over = _overlay(spark, fixtures.TEXTS, "snippet")
    turns = _spread(_table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    risky = ("suspended", "blocked", "prize", "fee", "OTP", "wire", "password", "infected")
    rows = turns.join(over, (F.col("id") % len(fixtures.TEXTS)).cast("int") == F.col("k")).select("id", F.concat("snippet", F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"), F.col("snippet").rlike("|".join(risky)).cast("int").alias("label"))
    rows = models.normalized(rows, "text", "_norm").select("id", "label", "_norm").persist()  # read for training and for its use
    model = models.train_normalized(rows)
    return models.predict_normalized(rows, model, "id").select("id", "probability", "label", F.array_join(F.transform("indicators", lambda i: i["term"]), ",").alias("indicators"))


def knowledge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension tables as one relation: kind, item, detail."""
    rows = [("brand", n, ",".join(d)) for n, _, d in K.BRANDS] + [("tactic", i, f"{c}:{w}:{r}:{m}:{len(p)}") for i, c, w, r, m, p in K.TACTICS]
    for kind in ("OTHER_TRUSTED_DOMAINS", "FREE_MAIL_DOMAINS", "DISPOSABLE_MAIL_DOMAINS", "URL_SHORTENERS", "SUSPICIOUS_TLDS", "FREE_HOSTING_HOSTS", "MULTI_PART_SUFFIXES", "DANGEROUS_EXTENSIONS", "REDIRECT_PARAMS", "IDENTITY_PARAMS"):
        rows += [(kind.lower(), x, "") for x in getattr(K, kind)]
    rows += [("cap", k, str(v)) for k, v in K.CATEGORY_CAPS.items()]
    return spark.createDataFrame(rows, "kind string, item string, detail string")


def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id")
    part: Callable[[int], Column] = lambda m: ((F.col("event_id") * m) % 256).cast("string")
    first = F.get(F.array(*[F.lit(x) for x in ("10", "172", "192", "8", "169", "100", "127", "224")]), (F.col("event_id") % 8).cast("int"))
    host = F.concat_ws(".", first, F.when(F.col("event_id") % 3 == 0, F.lit("168")).otherwise(part(7)), part(11), part(13))
    return e.select("event_id", host.alias("host")).withColumn("denied", urls.in_private_range(F.col("host")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        flagship, url_parse, url_signal_table, url_model_features, text_scalars, message_statistics, visible_text, link_extraction, normal_forms, canonical_forms, message_types, record_validation, tactic_table,
        text_signal_table, message_scores, sender_signal_table, page_signal_table, message_verdicts, mail_verdicts, site_verdicts, score_core, model_signals, history_totals, history_by_type, history_trend, history_latest, history_page, history_top,
        report_reputation, rate_limit, circuit_breaker, label_metrics, label_auc, threshold_sweep, threshold_choice, threshold_robust, latency_figures, normalized_messages, url_model, message_model,
        knowledge_tables, private_addresses,
    )
}
