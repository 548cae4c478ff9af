"""Page analyzer: what a web page asks for, where it sends it, and whom it looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, html, rx, text, urls
from ..functions import knowledge as K
from ..functions.text import among
from .signals import gathered, no_signals, signal

# The patterns that signals of pages depend on, here and in the calls below.
_LOGIN = r"\b(sign in|log ?in|login|username|password|continue to your account|account login|net ?banking|internet banking|user id)\b"
_CAPTURE = r"(?:formspree|jotform|getform|sheetdb|script\.google\.com|api\.telegram\.org|discord(?:app)?\.com/api/webhooks|pipedream|requestbin|webhook\.site|ngrok)"
_ALARM = r"\b(your (account|session) (has been|is) (locked|suspended|limited|disabled)|verify (your )?(identity|account) (now|immediately)|unusual (sign[-\s]?in|activity) detected|re-?confirm your (details|information))\b"
_BLOBS = r"(?:\\x[0-9a-f]{2}){12,}|(?:%[0-9a-f]{2}){20,}"
_MENU = r"document\.addEventListener\s*\(\s*['\"]contextmenu['\"][\s\S]{0,80}preventDefault|oncontextmenu\s*=\s*[\"']?return false"


def _sensitive(i: Column) -> Column:
    return (i["type"] == "password") | i["name"].rlike("|".join(K.CREDENTIAL_FIELD_NAMES))


def page_signals(df: DataFrame, page: str, url: str, out: str = "page_signals") -> DataFrame:
    """Adds out and page (struct title, rd, https, login, fields, impersonates, forms, inputs, anchors).

    page: a column of HTML; null and blank pages have no signals.  url: where the page came from, or null.
    """
    keep = df.columns
    df = df.withColumn("_p", urls.parse_url(F.col(url))).withColumn("_html", F.coalesce(F.col(page), F.lit("")))
    df = df.withColumn("_host", F.coalesce(F.col("_p")["host"], F.lit("")))
    df = df.withColumn("_rd", urls.registrable_domain(F.col("_host"))).withColumn("_text", text.plain_blanks(html.html_to_text(F.col("_html"))))
    for name, column in html.page_features(F.col("_html"), F.col("_p")).items():
        df = df.withColumn(f"_{name}", column)
    df = df.withColumn("_canon_text", text.canonical(F.col("_text"))).withColumn("_canon_title", text.canonical(F.col("_title")))
    df = df.withColumn("_inputs", F.concat(F.flatten(F.transform("_forms", lambda f: f["inputs"])), F.col("_loose_inputs")))
    with_site = lambda f: F.struct(f["action"].alias("action"), f["resolved"].alias("resolved"), f["method"].alias("method"), f["inputs"].alias("inputs"), urls.parse_url(f["resolved"]).alias("p"))
    df = df.withColumn("_forms2", F.transform(F.filter("_forms", lambda f: F.exists(f["inputs"], _sensitive)), with_site))
    df = df.withColumn("_forms3", F.transform("_forms2", lambda f: F.struct(f["action"].alias("action"), f["method"].alias("method"), f["inputs"].alias("inputs"), f["p"].alias("p"), urls.registrable_domain(f["p"]["host"]).alias("site"))))
    has_password = F.exists("_inputs", lambda i: i["type"] == "password")
    df = df.withColumn("_login", has_password | (rx.matches(F.col("_text"), _LOGIN) & (F.size("_inputs") >= 2)))
    sites = lambda column: F.transform(F.transform(column, lambda u: urls.parse_url(u)["host"]), lambda h: urls.registrable_domain(h))
    df = df.withColumn("_assets", sites(F.array_compact(F.concat("_images", F.array("_favicon")))))
    df = df.withColumn("_frames", F.transform("_iframes", lambda f: F.struct(f["src"].alias("src"), f["hidden"].alias("hidden"), urls.registrable_domain(F.coalesce(urls.parse_url(f["src"])["host"], F.lit(""))).alias("site"))))
    brands = []
    for name, keywords, domains in K.BRANDS:
        words = [derive.canonical(k).strip() for k in keywords]
        in_title = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("_canon_title"), w))
        mentions = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("_canon_text"), w)))
        own = F.lit(False) if not domains else F.col("_rd").isin(*derive.brand_sites()[name])
        brands.append(F.when((in_title | (mentions >= 2)) & ~own, F.struct(F.lit(name).alias("brand"), in_title.alias("in_title"))))
    # most records have no page: what costs most is not worked out for them
    blank = F.trim("_html") == ""
    df = df.withColumn("_fake", F.when(~blank, F.get(gathered(*brands), F.lit(0))))
    login, rd, host, https = F.col("_login"), F.col("_rd"), F.col("_host"), F.coalesce(F.col("_p")["scheme"] == "https", F.lit(False))
    official, trusted = among(rd, K.OFFICIAL_DOMAINS), among(rd, K.TRUSTED_DOMAINS)
    body, js, forms, fake, size = F.col("_text"), F.col("_inline"), F.col("_forms3"), F.col("_fake"), F.length("_html")
    has_js = js.rlike("(?s)[^\\n]")
    some = lambda test: F.exists(forms, test)
    dead = F.size(F.filter("_anchors", lambda a: a["raw"].rlike(r"^#\z|^javascript:void")))
    hidden_name = F.filter(F.flatten(F.transform("_forms", lambda f: f["inputs"])), lambda i: (i["type"] == "hidden") & i["name"].rlike("email|mail|user|id|target|victim|bot|chat"))
    brand_asset = F.get(F.filter("_assets", lambda a: (a != rd) & among(a, K.OFFICIAL_DOMAINS)), F.lit(0))
    fields = F.array_distinct(F.filter(F.transform(F.filter("_inputs", _sensitive), lambda i: F.when(i["name"] != "", i["name"]).otherwise(i["type"])), lambda x: x != ""))
    calls = rx.count(js, r"\b(eval|Function\s*\(|atob|unescape|decodeURIComponent\s*\(\s*escape)\b", ignore_case=False)
    found = gathered(
        signal(login, 401, "page-login-form", "page", 6, F.array_join(F.slice(fields, 1, 5), ", ")),
        signal(login & F.col("_p").isNotNull() & ~https, 402, "page-insecure-login", "credential-theft", 26, F.col(url)),
        signal(some(lambda f: f["action"].isNull() | rx.matches(f["action"], "^#|^javascript:")), 403, "page-form-script-handler", "page", 9),
        signal((host != "") & some(lambda f: f["p"].isNotNull() & (f["p"]["host"] != "") & (f["site"] != rd)), 404, "page-cross-domain-post", "credential-theft", 28, rd),
        signal(https & some(lambda f: F.coalesce(f["p"]["scheme"] == "http", F.lit(False))), 405, "page-downgrade-post", "credential-theft", 24),
        signal(some(lambda f: F.coalesce(rx.matches(F.concat(f["p"]["host"], f["p"]["path"]), _CAPTURE), F.lit(False))), 406, "page-exfil-endpoint", "credential-theft", 30),
        signal(some(lambda f: (f["method"] == "get") & F.exists(f["inputs"], lambda i: i["type"] == "password")), 407, "page-password-in-url", "credential-theft", 18),
        signal(fake.isNotNull() & (login | fake["in_title"]), 408, "page-brand-impersonation", "domain", F.when(login, 27).otherwise(16), F.col("_title")),
        signal((host != "") & brand_asset.isNotNull() & ~official, 409, "page-hotlinked-brand-assets", "domain", 17, brand_asset),
        signal(has_js & ((calls >= 3) | rx.matches(js, _BLOBS)), 410, "page-obfuscated-script", "page", 15),
        signal(has_js & rx.matches(F.concat(js, F.lit(" "), F.col("_html")), _MENU), 411, "page-right-click-blocked", "page", 11),
        signal(has_js & rx.matches(js, r"\b(?:on)?(?:paste|copy)\b[\s\S]{0,60}preventDefault"), 412, "page-paste-blocked", "page", 12),
        signal(has_js & rx.matches(js, r"\b(?:api\.telegram\.org|sendMessage\?chat_id|discord(?:app)?\.com/api/webhooks)\b"), 413, "page-telegram-exfil", "credential-theft", 30),
        signal(has_js & login & rx.matches(js, r"window\.(?:location|open)\s*=?\s*\(?['\"]https?://"), 414, "page-auto-redirect", "page", 8),
        signal(F.exists("_frames", lambda f: f["hidden"] & f["src"].isNotNull()), 415, "page-hidden-iframe", "page", 16),
        signal(login & (host != "") & F.exists("_frames", lambda f: ~f["hidden"] & f["src"].isNotNull() & (f["site"] != rd)), 416, "page-framed-login", "page", 12),
        signal(login & (F.size(hidden_name) > 0), 417, "page-hidden-target-field", "page", 13, F.array_join(F.transform(F.slice(hidden_name, 1, 3), lambda i: i["name"]), ", ")),
        signal(login & (F.size("_anchors") >= 4) & (10 * dead > 6 * F.size("_anchors")), 418, "page-dead-navigation", "page", 12, dead),
        signal(login & (size > 0) & (size < 2500) & ~trusted, 419, "page-thin-clone", "page", 10, size),
        signal(login & ~trusted & ~rx.matches(body, r"\b(privacy policy|terms of (use|service)|about us|contact us|customer care|helpline)\b"), 420, "page-no-legal-pages", "page", 8),
        signal(rx.matches(body, _ALARM), 421, "page-alarming-copy", "social-engineering", 13, rx.extract(body, _ALARM)),
        signal(~official & rx.matches(body, r"\b(enter (your )?(otp|one[-\s]?time password)|otp sent to your (mobile|registered))\b"), 422, "page-otp-capture", "credential-theft", 24),
        signal(official, 423, "page-official-domain", "positive", -22, rd),
        signal(trusted & ~official, 424, "page-trusted-domain", "positive", -14, rd),
    )
    df = df.withColumn("_found", F.when(~blank, found))
    calm = signal(https & login & ~F.exists("_found", lambda s: s["weight"] >= 20), 425, "page-https-login", "positive", -5, F.col(url))
    df = df.withColumn(out, F.when(blank, no_signals()).otherwise(F.concat("_found", gathered(calm))))
    facts = F.struct(F.col("_title").alias("title"), F.nullif(rd, F.lit("")).alias("rd"), https.alias("https"), login.alias("login"), fields.alias("fields"), fake["brand"].alias("impersonates"), F.size("_forms").alias("forms"), F.size("_inputs").alias("inputs"), F.size("_anchors").alias("anchors"))
    return df.withColumn("page", facts).select(*keep, out, "page")
