"""URL analyzer: how a link is built and whom it imitates.

Links of a row are an array.  Each step maps the array of structs to a larger one, so that what a step works out is
there once and expressions stay small; nothing is exploded and nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, rx, text, urls
from ..functions import knowledge as K
from ..functions.text import among, strings
from .signals import gathered, signal, strongest

MOST_URLS = 12
LOOKALIKE = "struct<score:int,back:int,brand:string,official:string,kind:string,distance:int>"


def lookalike(flat: Column, sub: Column, most_first: bool = True) -> Column:
    """The best imitation of a brand by a domain's label (flat) or, where sub is given, its subdomain; or null.

    most_first: the highest score wins, the earlier brand of equals; else the first brand at all wins.
    """
    rows = (f"named_struct('i', {i}, 'brand', {text.quoted(b)}, 'official', {text.quoted(d)}, 'label', {text.quoted(x)}, 'most', {m})" for i, (b, d, x, m) in enumerate(derive.brand_labels()))
    table = text.constant(f"array({', '.join(rows)})")

    def hit(t: Column) -> Column:
        inside = F.contains(flat, t["label"]) & (flat != t["label"])
        below = F.lit(False) if sub is None else F.contains(sub, t["label"])
        near = F.abs(F.length(flat) - F.length(t["label"])) <= t["most"]
        distance = F.when(near, F.levenshtein(flat, t["label"]))
        row = lambda score, kind, d: F.struct((F.lit(score) if isinstance(score, int) else score).cast("int").alias("score"), (-t["i"]).alias("back"), t["brand"].alias("brand"), t["official"].alias("official"), F.lit(kind).alias("kind"), d.cast("int").alias("distance")).cast(LOOKALIKE)
        return F.when(inside, row(3, "embedded", F.lit(0))).when(below, row(3, "subdomain", F.lit(0))).when((distance > 0) & (distance <= t["most"]), row(4 - distance, "typosquat", distance))

    hits = F.filter(F.transform(table, hit), lambda x: x.isNotNull())
    return F.array_max(hits) if most_first else F.get(hits, F.lit(0))


def url_facts(links: Column) -> Column:
    """Array of structs raw, p (parsed), host, rd, tld, label, sub, path, all (canonical host, path and query), params,
    official, trusted, like (lookalike); p is null for what cannot be parsed."""
    a = F.transform(links, lambda u: F.struct(u.alias("raw"), urls.parse_url(u).alias("p")))
    host = lambda x: urls.clean_host(x["p"]["host"])
    a = F.transform(a, lambda x: F.struct(x["raw"].alias("raw"), x["p"].alias("p"), host(x).alias("host")))
    a = F.transform(a, lambda x: F.struct(x["raw"].alias("raw"), x["p"].alias("p"), x["host"].alias("host"), urls._registrable(x["host"]).alias("rd")))
    a = F.transform(a, lambda x: F.struct(
        x["raw"].alias("raw"), x["p"].alias("p"), x["host"].alias("host"), x["rd"].alias("rd"), urls._suffix(x["rd"]).alias("tld"),
        F.when(x["host"] == x["rd"], F.lit("")).otherwise(F.substring(x["host"], F.lit(1), F.greatest(F.length(x["host"]) - F.length(x["rd"]) - 1, F.lit(0)))).alias("sub"),
        urls.unescaped(x["p"]["path"]).alias("path"), urls.parameters(x["p"]["query"]).alias("params"),
        among(x["rd"], K.OFFICIAL_DOMAINS).alias("official"), among(x["rd"], K.TRUSTED_DOMAINS).alias("trusted"),
    ))
    names = ("raw", "p", "host", "rd", "tld", "sub", "path", "params", "official", "trusted")
    tail = lambda x: F.concat(F.lit("."), x["tld"])
    a = F.transform(a, lambda x: F.struct(*[x[n].alias(n) for n in names], F.when(F.endswith(x["rd"], tail(x)), F.substring(x["rd"], F.lit(1), F.length(x["rd"]) - F.length(tail(x)))).otherwise(x["rd"]).alias("label")))
    names = (*names, "label")
    bare = lambda c: F.regexp_replace(text.canonical(c), "[-_.]", "")
    a = F.transform(a, lambda x: F.struct(*[x[n].alias(n) for n in names], bare(x["label"]).alias("flat"), bare(x["sub"]).alias("flat_sub"), text.canonical(F.concat(x["host"], x["path"], x["p"]["query"])).alias("all")))
    names = (*names, "all")
    return F.transform(a, lambda x: F.struct(*[x[n].alias(n) for n in names], F.when(~x["official"], lookalike(x["flat"], x["flat_sub"])).alias("like"), F.filter(strings(K.CREDENTIAL_PATH_WORDS), lambda w: F.contains(x["all"], w)).alias("hot")))


def _signals_of(x: Column, claimed: Column) -> Column:
    """The signals of one link's facts.  claimed: sites of the brand that the message claims to come from, or null."""
    p, host, rd, label, path, query = x["p"], x["host"], x["rd"], x["label"], x["path"], x["p"]["query"]
    scheme, href, like = p["scheme"], p["href"], x["like"]
    extra = F.greatest(F.lit(0), F.size(F.filter(F.split(host, r"\."), lambda v: v != "")) - F.size(F.split(rd, r"\.")))
    hyphens = F.length(label) - F.length(F.replace(label, F.lit("-"), F.lit("")))
    letters = F.regexp_replace(label, "[^a-z0-9]", "")
    shortener = among(rd, K.URL_SHORTENERS) | among(host, K.URL_SHORTENERS)
    hosting = urls.free_hosting(host)
    redirect = F.get(F.filter(x["params"], lambda q: among(F.lower(q["key"]), K.REDIRECT_PARAMS) & rx.matches(q["value"], "https?%3a|https?://")), F.lit(0))
    identity = F.transform(F.filter(x["params"], lambda q: among(F.lower(q["key"]), K.IDENTITY_PARAMS)), lambda q: q["key"])
    extension = F.regexp_extract(F.lower(path), r"\.([a-z0-9]{2,5})(?:\z|[?#])", 1)
    strange = p["host"].rlike("[^\\x00-\\x7f]") | p["host"].rlike(r"(?i)(^|\.)xn--")
    weight = {"typosquat": F.when(like["distance"] == 1, 26).otherwise(21), "embedded": F.lit(22), "subdomain": F.lit(24)}
    escapes = rx.count(href, "%[0-9a-f]{2}")
    found = gathered(
        signal(scheme == "http", 301, "url-no-https", "url", 8, href, href),
        signal(~scheme.isin("http", "https"), 302, "url-odd-scheme", "url", 14, scheme, href),
        signal((p["port"] != "") & ~p["port"].isin("80", "443"), 303, "url-nonstandard-port", "url", 7, p["port"], href),
        signal(urls.is_ipv4(host) | urls.is_ipv6(host), 304, "url-ip-host", "url", 20, host, href),
        signal(strange, 305, "url-homograph", "domain", 15, p["host"], href),
        signal((p["userinfo"] != "") | rx.replace(href, "^https?://", "").rlike("^[^/]*@"), 306, "url-userinfo", "url", 22, text.shortened(href, 120), href),
        signal(shortener, 307, "url-shortener", "url", 16, host, href),
        signal(extra >= 3, 308, "url-deep-subdomain", "url", 12, host, href),
        signal((extra == 2) & ~x["trusted"], 309, "url-many-subdomains", "url", 6, host, href),
        signal(hyphens >= 3, 310, "url-hyphen-spam", "domain", 11, rd, href),
        signal((hyphens == 2) & ~x["trusted"], 311, "url-hyphens", "domain", 5, rd, href),
        signal(among(x["tld"], K.SUSPICIOUS_TLDS), 312, "url-suspicious-tld", "domain", 14, rd, href),
        signal(hosting.isNotNull(), 313, "url-free-hosting", "domain", 12, host, href),
        signal(F.length(label) >= 25, 314, "url-long-domain", "domain", 7, rd, href),
        signal((F.length(label) >= 8) & (text.entropy(letters) > 3.6), 315, "url-random-domain", "domain", 10, rd, href),
        signal(label.rlike("[0-9]{4,}"), 316, "url-digit-run", "domain", 6, rd, href),
        *[signal(F.coalesce(like["kind"] == k, F.lit(False)), 317, f"url-brand-{k}", "domain", w, host, href) for k, w in weight.items()],
        signal(F.coalesce(~F.array_contains(claimed, rd), F.lit(False)), 318, "url-brand-mismatch", "domain", 20, host, href),
        signal((F.size(x["hot"]) > 0) & ~x["official"], 319, "url-credential-path", "credential-theft", F.least(F.lit(18), 7 + (F.size(x["hot"]) - 1) * 4), F.array_join(F.slice(x["hot"], 1, 4), ", "), href),
        signal(escapes >= 6, 320, "url-heavy-encoding", "url", 10, escapes, href),
        signal(href.contains("%25"), 321, "url-double-encoding", "url", 12, text.shortened(href, 120), href),
        signal(redirect.isNotNull(), 322, "url-open-redirect", "url", 15, F.concat_ws("=", redirect["key"], text.shortened(redirect["value"], 80)), href),
        signal(F.size(identity) > 0, 323, "url-identity-params", "credential-theft", 13, text.shortened(query, 100), href),
        signal(query.rlike(r"[?&](?:[a-z0-9_-]{1,12}=)?[A-Za-z0-9+/]{40,}={0,2}(?:&|\z)"), 324, "url-encoded-blob", "url", 8, text.shortened(query, 90), href),
        signal(among(extension, K.DANGEROUS_EXTENSIONS), 325, "url-dangerous-file", "url", F.when(among(extension, K.HIGH_RISK_EXTENSIONS), 24).otherwise(13), text.shortened(path, 100), href),
        signal(F.length(href) > 130, 326, "url-very-long", "url", 6, F.length(href), href),
        signal(x["official"], 327, "url-official-domain", "positive", -22, rd, href),
        signal(x["trusted"] & ~x["official"], 328, "url-trusted-domain", "positive", -16, rd, href),
    )
    bad = signal(F.lit(True), 300, "url-unparseable", "url", 6, text.shortened(x["raw"], 120), x["raw"])
    return F.when(p.isNull(), F.array(bad)).otherwise(found)


def url_signals(df: DataFrame, links: str, claimed: Column | None = None, out: str = "url_signals") -> DataFrame:
    """Adds out (merged signals of the first MOST_URLS links) and url_results (array of structs url, host, rd, scheme,
    shortener, impersonates, points, risky, signals).

    Merged: of each id the largest absolute weight, the first of equals; positive ones fall away if any weight is at
    least 14.  claimed: sites of the claimed brand.  A null array has no links.
    """
    keep = df.columns
    claimed = F.lit(None).cast("array<string>") if claimed is None else claimed
    df = df.withColumn("_claimed", claimed)
    df = df.withColumn("_facts", url_facts(F.slice(F.coalesce(F.col(links), F.array().cast("array<string>")), F.lit(1), F.lit(MOST_URLS))))
    df = df.withColumn("_each", F.transform("_facts", lambda x: F.struct(x.alias("x"), _signals_of(x, F.col("_claimed")).alias("s"))))
    clean = signal(F.lit(True), 329, "url-clean", "positive", -6)
    lone = lambda e: (F.size(e["s"]) == 0) & e["x"]["p"].isNotNull() & (e["x"]["p"]["scheme"] == "https") & ~e["x"]["trusted"]
    df = df.withColumn("_each", F.transform("_each", lambda e: F.struct(e["x"].alias("x"), F.when(lone(e), F.array(clean)).otherwise(e["s"]).alias("s"))))
    total = lambda s: F.aggregate(s, F.lit(0), lambda a, v: a + F.greatest(v["weight"], F.lit(0)))
    shortener = lambda x: F.coalesce(among(x["rd"], K.URL_SHORTENERS) | among(x["host"], K.URL_SHORTENERS), F.lit(False))
    df = df.withColumn("url_results", F.transform("_each", lambda e: F.struct(
        F.coalesce(e["x"]["p"]["href"], e["x"]["raw"]).alias("url"), F.coalesce(e["x"]["host"], F.lit("")).alias("host"), F.coalesce(F.when(e["x"]["p"].isNotNull(), e["x"]["rd"]), F.lit("")).alias("rd"),
        F.coalesce(e["x"]["p"]["scheme"], F.lit("")).alias("scheme"), shortener(e["x"]).alias("shortener"), e["x"]["like"]["brand"].alias("impersonates"),
        total(e["s"]).alias("points"), F.size(F.filter(e["s"], lambda v: v["weight"] > 0)).alias("risky"), e["s"].alias("signals"),
    )))
    df = df.withColumn("_all", strongest(F.flatten(F.transform("url_results", lambda r: r["signals"]))))
    grave = F.exists("_all", lambda s: s["weight"] >= 14)
    df = df.withColumn(out, F.when(grave, F.filter("_all", lambda s: s["category"] != "positive")).otherwise(F.col("_all")))
    return df.select(*keep, out, "url_results")
