"""Mail functions: header block, addresses, authentication verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .text import squeeze, text_or_empty

_STARTS = r"(?im)^(?:from|to|subject|date|received|return-path|reply-to|message-id|authentication-results)\s*:"
_BLOCK = r"^(?:[A-Za-z-]+:[^\n]*(?:\n[ \t][^\n]*)*\n)+"
_BLANK_LINE = r"\n\s*\n"


def looks_like_mail(text: Column, within: int = 2000) -> Column:
    return F.substring(text, 1, within).rlike(_STARTS)


def split_mail(raw: Column) -> Column:
    """Struct is_mail, header_text (unfolded), body.  Texts that do not look like mail are all body."""
    text = F.replace(text_or_empty(raw), F.lit("\r\n"), F.lit("\n"))
    block = F.regexp_extract(text, _BLOCK, 0)
    head = F.when(block != "", block).otherwise(F.element_at(F.split(text, _BLANK_LINE, 2), 1))
    rest = F.when(block != "", F.substring(text, F.length(block) + 1, F.length(text))).otherwise(F.coalesce(F.get(F.split(text, _BLANK_LINE, 2), F.lit(1)), F.lit("")))
    body = F.regexp_replace(rest, r"^\s+|\s+\z", "")
    is_mail = looks_like_mail(text)
    unfolded = F.regexp_replace(head, r"\n[ \t]+", " ")
    return F.struct(is_mail.alias("is_mail"), F.when(is_mail, unfolded).alias("header_text"), F.when(~is_mail, text).when(body == "", text).otherwise(body).alias("body"))


def header(header_text: Column, name: str) -> Column:
    """A header's value, several joined by ' | '; null if absent or empty."""
    lines = F.filter(F.split(F.coalesce(header_text, F.lit("")), "\n"), lambda x: x.rlike(rf"(?i)^\s*{name}\s*:"))
    values = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", "")))
    return F.when(F.coalesce(header_text, F.lit("")) != "", F.nullif(F.array_join(values, " | "), F.lit("")))


def header_names(header_text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(header_text, F.lit("")), "\n"), lambda x: x.rlike(r"^[^:]+:"))
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)))), lambda x: x != ""))


def address(value: Column) -> Column:
    """Struct display, address, domain of ``Name <address>``; empty texts where there is nothing."""
    raw = squeeze(value)
    angled = r"^(.*?)<\s*([^>]+?)\s*>\z"
    display = F.trim(F.regexp_replace(F.regexp_extract(raw, angled, 1), r"^[\"']|[\"']\s*\z", ""))
    mail = F.lower(F.trim(F.regexp_replace(F.when(raw.rlike(angled), F.regexp_extract(raw, angled, 2)).otherwise(raw), r"(?i)^mailto:", "")))
    return F.struct(display.alias("display"), mail.alias("address"), F.when(mail.contains("@"), F.substring_index(mail, "@", -1)).otherwise(F.lit("")).alias("domain"))


_VERDICTS = "pass|fail|softfail|neutral|none|permerror|temperror|bestguesspass"


def authentication(header_text: Column) -> Column:
    """Struct spf, dkim, dmarc (null if not stated) and present."""
    of = lambda n: header(header_text, n)
    signed = F.when(of("dkim-signature").isNotNull(), F.lit("dkim=present"))
    stated = F.lower(F.concat_ws(" ", of("authentication-results"), of("arc-authentication-results"), of("received-spf"), of("x-spf-result"), signed))
    verdict = lambda k: F.nullif(rx.extract(stated, rf"{k}\s*=\s*({_VERDICTS})", 1), F.lit(""))
    received = F.nullif(rx.extract(F.coalesce(F.lower(of("received-spf")), F.lit("")), r"^\s*(pass|fail|softfail|neutral|none|permerror|temperror)", 1), F.lit(""))
    return F.struct(F.coalesce(verdict("spf"), received).alias("spf"), verdict("dkim").alias("dkim"), verdict("dmarc").alias("dmarc"), (stated != "").alias("present"))
