"""Sender analyzer: who a mail says it is from, and whether that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive, mail, rx, text, urls
from ..functions import knowledge as K
from ..functions.text import among
from .signals import gathered, no_signals, signal
from .url_signals import lookalike


def _named_brand(name: Column) -> Column:
    """Struct brand, sites of the first brand with a keyword of three letters or more in the canonical name."""
    found = []
    for brand, keywords, _ in K.BRANDS:
        words = [k for k in (derive.canonical(x).strip() for x in keywords) if len(k) >= 3]
        plain = "|".join("".join(f"\\{c}" if c in ".*+?^${}()|[]\\" else c for c in k) for k in words)
        found.append(F.when(name.rlike(f"(?:^|[^a-z0-9])(?:{plain})(?:[^a-z0-9]|\\z)"), F.struct(F.lit(brand).alias("brand"), F.array(*map(F.lit, derive.brand_sites()[brand])).alias("sites"))))
    return F.get(gathered(*found), F.lit(0))


def sender_signals(df: DataFrame, header_text: str, sender_email: Column, sender_name: Column, reply_to: Column, claimed: Column, out: str = "sender_signals") -> DataFrame:
    """Adds out and sender (struct address, display, domain, reply_to, return_path, spf, dkim, dmarc, subject).

    claimed: array of structs with sites (registrable domains) of the brands that the message claims, in order.
    Without any address there are no signals.
    """
    keep = df.columns
    of = lambda n: mail.header(F.col(header_text), n)
    empty = F.lit("")
    df = df.withColumn("_from", mail.address(F.coalesce(of("from"), F.nullif(sender_email, empty), empty)))
    df = df.withColumn("_reply", mail.address(F.coalesce(of("reply-to"), F.nullif(reply_to, empty), empty))).withColumn("_path", mail.address(F.coalesce(of("return-path"), empty)))
    df = df.withColumn("_auth", mail.authentication(F.col(header_text))).withColumn("_claims", claimed)
    df = df.withColumn("_name", text.squeeze(F.coalesce(F.nullif(F.col("_from")["display"], empty), sender_name, empty)))
    df = df.withColumn("_rd", urls.registrable_domain(F.col("_from")["domain"])).withColumn("_reply_rd", urls.registrable_domain(F.col("_reply")["domain"])).withColumn("_path_rd", urls.registrable_domain(F.col("_path")["domain"]))
    df = df.withColumn("_label", urls.domain_label(F.col("_rd"))).withColumn("_tld", urls._suffix(F.col("_rd")))
    df = df.withColumn("_canon_name", text.canonical(F.col("_name"))).withColumn("_flat", F.regexp_replace(text.canonical(F.col("_label")), "[-_.]", ""))
    df = df.withColumn("_brand", F.when(F.col("_name") != "", _named_brand(F.col("_canon_name"))))
    df = df.withColumn("_like", F.when((F.col("_rd") != "") & ~among(F.col("_rd"), K.OFFICIAL_DOMAINS), lookalike(F.col("_flat"), None, most_first=False)))
    for k, n in (("_subject", "subject"), ("_mailer", "x-mailer"), ("_to", "to"), ("_refs", "references"), ("_irt", "in-reply-to")):
        df = df.withColumn(k, of(n))
    sender, reply, path, auth, rd = F.col("_from"), F.col("_reply"), F.col("_path"), F.col("_auth"), F.col("_rd")
    failed = F.filter(F.array(*[F.when(auth[k].isin("fail", "softfail", "permerror"), F.lit(k)) for k in ("spf", "dkim", "dmarc")]), lambda x: x.isNotNull())
    passed = F.coalesce((auth["spf"] == "pass") & (F.coalesce(auth["dkim"], empty).eqNullSafe("pass") | F.coalesce(auth["dmarc"], empty).eqNullSafe("pass")), F.lit(False))
    unlike = lambda a, d: (a["domain"] != "") & ((sender["domain"] == "") | (d != rd))
    free = among(rd, K.FREE_MAIL_DOMAINS)
    n_claims = F.size("_claims")
    verified = F.coalesce(F.array_contains(F.get("_claims", F.lit(0))["sites"], rd), F.lit(False))
    like = F.col("_like")
    evidence = F.concat(F.col("_name"), F.lit(" <"), sender["address"], F.lit(">"))
    found = gathered(
        signal(F.col("_brand").isNotNull() & ~F.coalesce(F.array_contains(F.col("_brand")["sites"], rd), F.lit(False)), 201, "sender-display-spoof", "sender", 24, evidence),
        signal((F.col("_name") != "") & rx.matches(F.col("_name"), r"\b(ceo|cfo|md|director|manager|hr|principal|dean|accounts?|finance|payroll)\b") & free, 203, "sender-exec-freemail", "bec", 22, evidence),
        signal((reply["address"] != "") & unlike(reply, F.col("_reply_rd")), 204, "sender-replyto-mismatch", "sender", 21, reply["address"]),
        signal(unlike(path, F.col("_path_rd")) & (reply["address"] == ""), 205, "sender-returnpath-mismatch", "sender", 12, path["address"]),
        signal(auth["present"] & (F.size(failed) > 0), 206, "sender-auth-fail", "sender", F.when(F.array_contains(failed, "dmarc"), 26).otherwise(20), F.array_join(failed, " ")),
        signal(auth["present"] & (F.size(failed) == 0) & passed, 207, "sender-auth-pass", "positive", -14, F.concat_ws(" ", auth["spf"], auth["dkim"], auth["dmarc"])),
        signal(like.isNotNull(), 208, "sender-lookalike-domain", "sender", F.when(like["kind"] == "typosquat", 26).otherwise(22), rd),
        signal(among(rd, K.DISPOSABLE_MAIL_DOMAINS), 209, "sender-disposable", "sender", 22, rd),
        signal((rd != "") & among(F.col("_tld"), K.SUSPICIOUS_TLDS), 210, "sender-suspicious-tld", "sender", 13, rd),
        signal((n_claims > 0) & verified, 211, "sender-brand-verified", "positive", -20, rd),
        signal((n_claims > 0) & ~verified & free, 212, "sender-brand-freemail", "sender", 22, sender["address"]),
        signal((n_claims > 0) & ~verified & ~free, 213, "sender-brand-mismatch", "sender", 18, sender["address"]),
        signal((n_claims == 0) & like.isNull() & among(rd, K.TRUSTED_DOMAINS), 214, "sender-trusted-domain", "positive", -12, rd),
        signal(rx.matches(F.col("_mailer"), r"\b(php ?mailer|swiftmailer|sendblaster|mass ?mailer|bulk|turbo-?smtp)\b"), 215, "sender-bulk-mailer", "sender", 10, text.shortened(F.col("_mailer"), 60)),
        signal(rx.matches(F.col("_subject"), r"^(?:re|fwd?)\s*:") & F.col("_refs").isNull() & F.col("_irt").isNull(), 216, "sender-fake-thread", "sender", 14, text.shortened(F.col("_subject"), 70)),
        signal(rx.matches(F.col("_to"), r"undisclosed[-\s]?recipients?"), 217, "sender-hidden-recipients", "sender", 9, text.shortened(F.col("_to"), 60)),
    )
    df = df.withColumn(out, F.when(sender["address"] == "", no_signals()).otherwise(found))
    some = lambda c: F.nullif(c, empty)
    df = df.withColumn("sender", F.struct(some(sender["address"]).alias("address"), some(F.col("_name")).alias("display"), some(rd).alias("domain"), some(reply["address"]).alias("reply_to"), some(path["address"]).alias("return_path"), auth["spf"].alias("spf"), auth["dkim"].alias("dkim"), auth["dmarc"].alias("dmarc"), F.col("_subject").alias("subject")))
    return df.select(*keep, out, "sender")
