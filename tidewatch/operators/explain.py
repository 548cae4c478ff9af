"""Explanations: ranked reasons, trust indicators, advice and a summary, from a scored row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import knowledge as K
from ..functions.text import shortened, strings

#: What to do, by category; own wording.
ADVICE = {
    "credential-theft": ("Keep passwords, codes and identity numbers to yourself.", "Change any password that was already entered, and turn on a second factor."),
    "financial-fraud": ("Pay and transfer nothing because of this message.", "Check changed payment details by calling a number you knew before."),
    "bec": ("Ask the colleague over a channel you already use.", "Follow the usual approval steps, however urgent it sounds."),
    "sender": ("Check the sender with contact details from the official site.", "Distrust replies that go to another address."),
    "domain": ("Read the domain letter by letter.", "Use the official app or a bookmark instead."),
    "url": ("Leave the link alone and type the known address.", "Look at where a link leads before opening it."),
    "page": ("Enter nothing on a page reached from a message.", "Close it and go to the service yourself."),
    "social-engineering": ("Take your time; pressure proves nothing.", "Ask the organisation over an official channel first."),
    "content": ("Open no unexpected files or links.", "Have the sender confirm it another way."),
    "general": ("Report the message and delete it.", "Block the sender."),
    "safe": ("No strong sign of phishing, but stay alert where money or passwords are asked for.", "Confirm payments over an official channel in any case."),
}
PHRASES = {
    "url": "its link is built to mislead", "domain": "its address imitates a brand", "sender": "its sender is not who it claims", "credential-theft": "it asks for secrets",
    "financial-fraud": "it wants money moved", "bec": "it poses as an internal request", "social-engineering": "it applies pressure", "page": "the page behaves like a credential trap",
    "content": "it is written like known scams", "intel": "it is known from reports", "ai": "a language model finds it malicious",
}
OPENERS = {"high": "This looks like phishing.", "medium": "This has warning signs; check before acting.", "low": "Nothing here looks like phishing."}


def severity(weight: Column) -> Column:
    return F.when(weight >= 22, "critical").when(weight >= 14, "high").when(weight >= 8, "moderate").otherwise("low")


def reasons(risky: Column, most: int = 8) -> Column:
    return F.transform(F.slice(risky, 1, most), lambda s, i: F.struct((i + 1).alias("rank"), s["id"].alias("id"), s["category"].alias("category"), shortened(s["evidence"], 160).alias("evidence"), s["weight"].alias("weight"), severity(s["weight"]).alias("severity")))


def _lines(table: dict[str, tuple[str, ...]], key: str) -> Column:
    return F.array(*map(F.lit, table[key]))


def chosen_categories(categories: Column) -> Column:
    """The categories that give advice, in the order of advice, until five lines are there (two lines each)."""
    fired = F.transform(categories, lambda c: c["category"])
    return F.slice(F.filter(strings(K.ADVICE_ORDER), lambda k: F.array_contains(fired, k)), 1, 3)


def explanation() -> Column:
    """Struct summary, reasons, triggers, trust, advice, confidence, of a row with the columns of scoring."""
    level, categories, risky, positives = (F.col(c) for c in ("level", "categories", "risky", "positives"))
    lines = F.flatten(F.transform(chosen_categories(categories), lambda k: _advice_of(k)))
    none = F.array().cast("array<string>")
    brand = F.get("brands", F.lit(0))["brand"]
    asks = F.exists(risky, lambda s: s["category"] == "credential-theft")
    body = F.concat(F.when(F.size(lines) > 0, lines).otherwise(_lines(ADVICE, "social-engineering")), F.when(level == "high", _lines(ADVICE, "general")).otherwise(none))
    first = F.concat(
        F.when(asks, F.array(F.lit("If a password or code was already shared, change it now and tell your bank."))).otherwise(none),
        F.when(brand.isNotNull(), F.array(F.concat(F.lit("Reach "), brand, F.lit(" only through its own app or address.")))).otherwise(none),
    )
    tips = F.when(level == "low", _lines(ADVICE, "safe")).otherwise(F.slice(F.array_distinct(F.concat(first, body)), 1, 6))
    phrases = F.filter(F.transform(F.slice(categories, 1, 3), lambda c: _phrase(c["category"])), lambda p: p.isNotNull())
    opener = F.when(level == "high", OPENERS["high"]).when(level == "medium", OPENERS["medium"]).otherwise(OPENERS["low"])
    why = F.when(level == "low", F.lit("")).otherwise(F.concat(F.lit(" Reasons: "), F.array_join(phrases, "; "), F.lit(". Strongest sign: "), F.coalesce(F.get(risky, F.lit(0))["id"], F.lit("none")), F.lit(".")))
    sure = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "moderate").otherwise("low")
    return F.struct(
        F.concat(opener, F.lit(" Score "), F.col("score").cast("string"), F.lit(" of 100."), why).alias("summary"), reasons(risky).alias("reasons"),
        F.transform(F.slice(risky, 1, 5), lambda s: s["id"]).alias("triggers"), F.transform(F.slice(positives, 1, 5), lambda s: s["id"]).alias("trust"), tips.alias("advice"), sure.alias("confidence"),
    )


def _advice_of(k: Column) -> Column:
    found = F.array().cast("array<string>")
    for name in K.ADVICE_ORDER:
        found = F.when(k == name, _lines(ADVICE, name)).otherwise(found)
    return found


def _phrase(k: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, phrase in PHRASES.items():
        found = F.when(k == name, phrase).otherwise(found)
    return found
