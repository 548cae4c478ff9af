"""Text analyzer: manipulation tactics and how a message is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, rx, text, urls
from ..functions import knowledge as K
from ..functions.text import strings
from .signals import gathered, signal
from .text_facts import facts_of, urls_of

def claimed_brands(canonical: str) -> Column:
    """Array of structs brand, keyword, sites, domain: the brands of which a keyword stands alone in this column of
    canonical texts, in the order of the table, each with its first keyword found."""
    rows = []
    for name, keywords, domains in K.BRANDS:
        plain = {k: "".join(f"\\{c}" if c in ".*+?^${}()|[]\\" else c for c in derive.canonical(k)) for k in keywords}
        hits = " ".join(f"WHEN contains(near, {text.quoted(derive.canonical(k))}) AND x RLIKE {text.quoted(f'(?:^|[^a-z0-9]){p}(?:[^a-z0-9]|\\z)')} THEN {text.quoted(k.strip())}" for k, p in plain.items())
        sites = f"array({', '.join(map(text.quoted, derive.brand_sites()[name]))})"
        rows.append(f"named_struct('brand', {text.quoted(name)}, 'keyword', CASE {hits} END, 'sites', {sites}, 'domain', {text.quoted(domains[0])})")
    near = rx.digest("x", [derive.canonical(k) for _, keywords, _ in K.BRANDS for k in keywords])
    found = F.expr(f"get(transform(array(concat(' ', {canonical}, ' ')), x -> get(transform(array({near}), near -> array({', '.join(rows)})), 0)), 0)")
    return F.filter(found, lambda b: b["keyword"].isNotNull())


def haystacks(df: DataFrame, column: str, prefix: str = "_") -> DataFrame:
    """Adds the four forms that patterns are tried on (plain, despaced, canonical of both).  Those after the first are
    null where they say the same as one before, apart from case, so they cost nothing."""
    p = prefix
    df = df.withColumn(f"{p}h0", text.plain_blanks(F.col(column)))
    df = df.withColumn(f"{p}h1", text.despaced(F.col(f"{p}h0"))).withColumn(f"{p}h2", text.canonical(F.col(f"{p}h0")))
    df = df.withColumn(f"{p}l0", F.lower(f"{p}h0")).withColumn(f"{p}canonical", F.when(F.col(f"{p}h1") == F.col(f"{p}h0"), F.col(f"{p}h2")).otherwise(text.canonical(F.col(f"{p}h1"))))
    df = df.withColumn(f"{p}h3", F.when((F.col(f"{p}canonical") != F.col(f"{p}h2")) & (F.col(f"{p}canonical") != F.lower(f"{p}h1")), F.col(f"{p}canonical")))
    df = df.withColumn(f"{p}h2", F.when(F.col(f"{p}h2") != F.col(f"{p}l0"), F.col(f"{p}h2")))
    return df.withColumn(f"{p}h1", F.when(F.col(f"{p}h1") != F.col(f"{p}h0"), F.col(f"{p}h1")))


def text_signals(df: DataFrame, column: str, links: str | None = None, out: str = "text_signals", found: str | None = None) -> DataFrame:
    """Adds out (signals), tactics (array of structs id, category, hits, weight, evidence), claimed (of the text),
    text_urls, emails, phones and words.

    links: an array column of structs href, text (anchors of the message), or none.  found: an array column of the
    text's links, if they are known.  A null text counts as empty.
    """
    keep = df.columns
    df = df.withColumn("_facts", facts_of(F.col(column))).withColumn("text_urls", F.col(found) if found else urls_of(F.col(column)))
    df = df.withColumns({c: F.col("_facts")[c] for c in ("tactics", "claimed", "emails", "phones", "words")}).withColumn("_raw", text.plain_blanks(F.col(column)))
    df = df.withColumn("_sites", F.array_distinct(F.filter(F.transform(F.transform("text_urls", lambda u: urls.parse_url(u)["host"]), lambda h: urls.registrable_domain(F.coalesce(h, F.lit("")))), lambda x: x != "")))
    raw, facts, n_urls, n_tactics, words = F.col("_raw"), F.col("_facts"), F.size("text_urls"), F.size("tactics"), F.col("words")
    foreign = F.get(F.filter("claimed", lambda c: ~F.arrays_overlap(c["sites"], F.col("_sites"))), F.lit(0))
    ids = F.transform("tactics", lambda t: t["id"])
    strong = F.arrays_overlap(ids, strings(K.STRONG_TACTICS))
    df = df.withColumn("_foreign", foreign).withColumn("_strong", strong)
    if links:
        label = lambda x: text.squeeze(x["text"])
        shown = F.filter(F.coalesce(F.col(links), F.array()), lambda x: x["href"].isNotNull() & rx.matches(label(x), r"^(?:https?://|www\.)|\.[a-z]{2,}(?:/|$)"))
        df = df.withColumn("_pairs", F.transform(shown, lambda x: F.struct(urls.parse_url(label(x))["host"].alias("a"), urls.parse_url(x["href"])["host"].alias("b"))))
        df = df.withColumn("_pairs", F.transform("_pairs", lambda x: F.struct(urls.registrable_domain(x["a"]).alias("a"), urls.registrable_domain(x["b"]).alias("b"))))
        df = df.withColumn("_pair", F.get(F.filter("_pairs", lambda x: (x["a"] != "") & (x["b"] != "") & (x["a"] != x["b"])), F.lit(0)))
    else:
        df = df.withColumn("_pair", F.lit(None).cast("struct<a:string,b:string>"))
    n_short = (n_urls == 0) & (words < 60) & facts["never"] & rx.matches(raw, r"\b\d{4,8}\b")
    signals = [
        signal(F.size("claimed").__gt__(0) & (F.size("_sites") > 0) & F.col("_foreign").isNotNull(), 101, "content-brand-link-mismatch", "domain", 19, F.array_join(F.slice("_sites", 1, 3), ", ")),
        signal(F.col("_pair").isNotNull(), 102, "content-anchor-mismatch", "url", 24, F.concat_ws(" > ", F.col("_pair")["a"], F.col("_pair")["b"])),
        signal(facts["spaced"].isNotNull(), 103, "content-spaced-words", "content", 12, text.shortened(text.squeeze(facts["spaced"]), 60)),
        signal(F.size(facts["leet"]) > 0, 104, "content-leetspeak", "content", 11, F.array_join(F.slice(F.array_distinct(facts["leet"]), 1, 3), ", ")),
        signal(facts["hidden"], 105, "content-invisible-chars", "content", 13),
        signal(facts["mixed"], 106, "content-mixed-script", "content", 12),
        signal(facts["caps"] > 0.55, 107, "content-shouting", "content", 8, F.concat(F.floor(facts["caps"] * 100 + 0.5).cast("string"), F.lit("%"))),
        signal(facts["loud"], 108, "content-punctuation", "content", 5),
        signal((F.size("phones") > 0) & (words < 90) & (n_tactics >= 1), 109, "content-callback-number", "social-engineering", 9, F.array_join(F.slice("phones", 1, 2), ", ")),
        signal(facts["chat"].isNotNull(), 110, "content-messaging-link", "social-engineering", 12, facts["chat"]),
        signal((n_tactics >= 2) & (F.size(facts["topics"]) >= 2), 111, "content-sensitive-topic", "credential-theft", 10, F.array_join(F.slice(facts["topics"], 1, 4), ", ")),
        signal(words.between(1, 5) & (n_urls >= 1), 112, "content-bare-link", "content", 10, text.shortened(text.squeeze(raw), 80)),
        signal(n_urls >= 4, 113, "content-many-links", "content", 5, n_urls),
        signal(facts["chain"], 114, "content-chain-message", "social-engineering", 9),
        signal((n_tactics == 0) & (words >= 12), 115, "content-neutral-tone", "positive", -12),
        signal(~F.col("_strong") & (n_tactics == 1) & (words >= 25), 116, "content-mild-tone", "positive", -6, F.get(ids, F.lit(0))),
        signal(n_short, 117, "content-transactional-code", "positive", -16),
        signal(facts["leave"], 118, "content-unsubscribe", "positive", -7),
    ]
    of_tactics = F.transform("tactics", lambda t, i: F.struct(i.alias("ord"), F.concat(F.lit("tactic-"), t["id"]).alias("id"), t["category"].alias("category"), t["weight"].alias("weight"), F.array_join(t["evidence"], " | ").alias("evidence"), F.lit(None).cast("string").alias("url")))
    df = df.withColumn(out, F.concat(of_tactics, gathered(*signals)))
    return df.select(*keep, out, "tactics", "claimed", "text_urls", "emails", "phones", "words")
