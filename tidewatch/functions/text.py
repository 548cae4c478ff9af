"""Text functions: Column in, Column out, nulls taken as empty.  All of them stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import knowledge as K
from . import rx

#: Unicode blanks that browsers count as white space and Java does not.
WIDE_BLANKS = "                 　﻿"
INVISIBLE = "[​-‏‪-‮⁠﻿]"
#: Any but ASCII and the letters of Latin-1: none of those is a wide blank, invisible, or has a compatibility form.
_BEYOND = "[^\\x00-\\x7f\\xc0-\\xff]"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it; keeps expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_CONSTANTS: dict[tuple[int, str], Column] = {}


def constant(sql: str) -> Column:
    """An expression without columns, parsed once a JVM: long lists cost a call for each item otherwise."""
    key = (id(SparkContext._gateway), sql)
    if key not in _CONSTANTS:
        _CONSTANTS[key] = F.expr(sql)
    return _CONSTANTS[key]


def quoted(s: str) -> str:
    """A string as Spark SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """An array of fixed strings."""
    return constant(f"array({', '.join(map(quoted, values))})")


def among(c: Column, values: Iterable[str]) -> Column:
    """Whether c is one of the fixed strings; null for null."""
    return F.array_contains(strings(values), c)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def plain_blanks(c: Column) -> Column:
    """Unicode blanks as U+0020, so that \\s means the same in every engine."""
    plain = lambda x: F.when(is_ascii(x) | ~x.rlike(_BEYOND), x).otherwise(F.translate(x, WIDE_BLANKS.replace("\ufeff", ""), " " * (len(WIDE_BLANKS) - 1)))
    return let(text_or_empty(c), plain)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; letters keep their case."""
    return F.trim(F.regexp_replace(plain_blanks(c), "\\s+", " "))


@lru_cache(1)
def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms."""
    pairs = [(chr(i), f) for i in range(128, 0x10000) if not 0xD800 <= i < 0xE000 and len(f := unicodedata.normalize("NFKC", chr(i))) == 1 and f != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Compatibility characters that stand for several letters, of those that occur in disguised Latin words.
_SEVERAL = tuple((c, unicodedata.normalize("NFKC", c)) for c in "ﬀﬁﬂﬃﬄﬅﬆĳŉǆǉǌǳ…‥№℡™℠½¼¾")


def compatible(c: Column) -> Column:
    """Compatibility forms (NFKC) of single characters and Latin ligatures; combining accents go, as their letters
    would lose them in dehomoglyph anyway."""
    folded = F.translate(c, *_compatible())
    for a, b in _SEVERAL:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.when(c.rlike(_BEYOND), F.regexp_replace(folded, "[̀-ͯ]", "")).otherwise(c)


@lru_cache(1)
def _look_alikes() -> tuple[str, str]:
    both = dict(zip(K.HOMOGLYPHS_FROM, K.HOMOGLYPHS_TO, strict=True))
    for a, b in list(both.items()):
        if len(a.upper()) == 1 and a.upper().lower() == a and a.upper() not in both and ord(a.upper()) > 127:
            both[a.upper()] = b
    return "".join(both), "".join(both.values())


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Look-alikes and leet in one table; leet has no case, so it may be undone before letters are lower-cased."""
    leet = dict(zip(K.LEET_FROM, K.LEET_TO, strict=True))
    both = leet | {a: leet.get(b.lower(), b) for a, b in zip(*_look_alikes(), strict=True)}
    return "".join(both), "".join(both.values())


def dehomoglyph(c: Column) -> Column:
    return F.translate(c, *_look_alikes())


def deleet(c: Column) -> Column:
    return F.translate(F.lower(c), K.LEET_FROM, K.LEET_TO)


def canonical(c: Column) -> Column:
    """Without invisible characters, compatibility forms, look-alikes and leet; lower case."""
    folded = lambda x: F.when(is_ascii(x) | ~x.rlike(_BEYOND), x).otherwise(let(F.regexp_replace(x, INVISIBLE, ""), compatible))
    return F.lower(F.translate(let(text_or_empty(c), folded), *_plain_letters()))


_ONE, _SEP, _END = "(?<![0-9A-Za-z])[A-Za-z]", "[\\s._*-]", "(?![0-9A-Za-z])"
_SPACED = f"(?<={_ONE}){_SEP}(?=[A-Za-z]{_SEP}[A-Za-z]{_END})|(?<={_ONE}{_SEP}[A-Za-z]){_SEP}(?=[A-Za-z]{_END})"


#: A letter between separators: any three letters set apart hold one, and it is found fast.
LONE_LETTER = rx.java(r"[\s._*-][A-Za-z][\s._*-]", False)


def despaced(c: Column) -> Column:
    """``v e r i f y`` as ``verify``: separators between single letters go where at least three stand in a row."""
    return F.when(c.rlike(LONE_LETTER) & c.rlike(_SPACED), F.regexp_replace(c, _SPACED, "")).otherwise(c)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, most + 1 if it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty texts."""
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    size = F.length(c)
    # each character is taken out of what the ones before have left, so that frequent ones are passed once
    state = lambda rest, left, n, h: F.struct(rest.alias("rest"), left.alias("left"), n.alias("n"), h.alias("h"))
    less = lambda a, r: let(F.struct(F.length(r).alias("left"), ((a["left"] - F.length(r)) / a["n"]).alias("p")), lambda v: state(r, v["left"], a["n"], a["h"] - v["p"] * F.log2(v["p"])))
    return F.aggregate(chars, state(c, size, size, F.lit(0.0)), lambda a, x: let(F.replace(a["rest"], x, F.lit("")), lambda r: less(a, r)), lambda a: a["h"])


def upper_ratio(c: Column) -> Column:
    """A-Z among letters; 0 for fewer than 12 letters."""
    count = lambda x: F.length(F.regexp_replace(c, rx.java(f"[^{x}]+", False), ""))
    return let(count("A-Za-z"), lambda letters: F.when(letters < 12, F.lit(0.0)).otherwise(count("A-Z") / letters))


def half_up(c: Column, places: int = 0) -> Column:
    """Rounded with halves towards positive infinity."""
    return F.floor(c * 10**places + F.lit(0.5)) / 10**places


def shortened(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def occurrences(haystack: Column, needle: str) -> Column:
    """How often needle occurs, without overlaps; 0 for an empty needle."""
    if not needle:
        return F.lit(0)
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def fnv1a(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes' ASCII values, 32 bits, as 8 hex digits (the record id)."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(chars, F.lit(2166136261).cast("long"), step)), 8, "0"))


# Fixed value: what counts as a link in a text.  Labels of a host take all letters at once and give none back, as going
# back takes long on runs of letters without a dot.
_SCAN = r"\b((?:https?://|www\.)[^\s<>\"'`)\]}]+|(?:[a-z0-9][a-z0-9-]*+(?<!-)\.)+[a-z]{2,24}(?:/[^\s<>\"'`)\]}]*)?)"


def urls_in(c: Column) -> Column:
    """Links of a text in their order, each once: defanged forms are restored, a missing scheme becomes http://, and
    of those without a scheme only www. and two-label hosts count."""
    text = plain_blanks(c)
    text = rx.replace(text, r"hxxp(s?)://", "http$1://")
    text = F.regexp_replace(F.regexp_replace(text, r"\[\s*\.\s*\]", "."), r"\(\s*\.\s*\)", ".")
    text = rx.replace(text, r"\s+dot\s+", ".")
    # most texts have no dot between letters
    some = F.when(text.rlike(rx.java(r"://|(?<=[a-z0-9])\.[^\s]")), rx.extract_all(text, _SCAN, 1))
    clean = F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda u: F.regexp_replace(u, r"[.,;:!?'\")\]]+\z", ""))
    full = lambda u: u.rlike("(?i)^https?://")
    kept = F.filter(clean, lambda u: full(u) | u.rlike(r"(?i)^www\.") | u.rlike(r"(?i)^[a-z0-9-]+\.[a-z]{2,24}(?:[/:?#]|\z)"))
    return F.array_distinct(F.transform(kept, lambda u: F.when(full(u), u).otherwise(F.concat(F.lit("http://"), u))))


def emails_in(c: Column) -> Column:
    c = text_or_empty(c)
    found = F.when(c.contains("@"), rx.extract_all(c, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(found, F.lower))


def phones_in(c: Column) -> Column:
    found = F.when(F.coalesce(c.rlike("[0-9]{5}"), F.lit(False)), rx.extract_all(plain_blanks(c), r"(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{3,5}\)?[\s-]?)?\d{5,10}\b")).otherwise(F.array().cast("array<string>"))
    found = F.transform(found, lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 8))


def text_statistics(c: Column) -> Column:
    """Struct of characters, words, links, emails, digits, caps_ratio (3 places), exclamations."""
    text = plain_blanks(c)
    words = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return F.struct(
        F.length(text).alias("characters"), F.size(words).alias("words"), rx.count(text, r"https?://|www\.").alias("links"),
        F.size(rx.extract_all(text, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}")).alias("emails"), rx.count(text, r"\d").alias("digits"),
        half_up(F.when(letters > 0, upper / letters).otherwise(0.0), 3).alias("caps_ratio"), rx.count(text, "!").alias("exclamations"),
    )


def json_object(c: Column) -> Column:
    """From the first { to the last }; null where there is none."""
    return F.nullif(F.regexp_extract(text_or_empty(c), r"(?s)\{.*\}", 0), F.lit(""))


