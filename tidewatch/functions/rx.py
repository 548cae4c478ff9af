"""One regular-expression dialect for the whole library.

Patterns are written with ASCII word borders, as browsers and RE2 read them.  Java's \\b follows Unicode letters and
its $ also matches before a final line feed; both are rewritten here, never by hand.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable
from functools import lru_cache
from re import _parser as parser
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "0-9A-Za-z_"
_BORDER = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_START = f"(?<![{_WORD}])"


_ESCAPED = {r"\s": r" \t\n\x0B\f\r", r"\d": "0123456789", r"\w": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"}


def _spelled(body: str) -> str:
    """The inside of a character class with its ASCII letters, digits and blanks one by one: Java looks those up in a
    table, while it tries ranges one after the other."""
    items = re.findall(r"\\.|[^\\]", body, re.S)
    out, i = [], 0
    while i < len(items):
        a, b = items[i], items[i + 2] if items[i + 1 : i + 2] == ["-"] and i + 2 < len(items) else ""
        if b:
            alike = a.isascii() and b.isascii() and any(a in s and b in s for s in (string.digits, string.ascii_lowercase, string.ascii_uppercase))
            out.append("".join(map(chr, range(ord(a), ord(b) + 1))) if alike else f"{a}-{b}")
            i += 3
        else:
            out.append(_ESCAPED.get(a, a))
            i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Java: ASCII word borders, $ as the very end, ranges of ASCII classes spelled out."""
    return ("(?i)" if ignore_case else "") + re.sub(r"(\\.)|\[(\^?)((?:[^\\\]\[]|\\.)+)\]", lambda m: m[1] or f"[{m[2]}{_spelled(m[3])}]", _java(pattern), flags=re.S)


def _java(pattern: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if two == "\\b" and not in_class:
                # at the start of a pattern whose first character must be a word character, half a test is enough
                out.append(_START if not out and pattern[2:3] == "(" and pattern[3:4] not in "?" else _BORDER)
            else:
                out.append(two)
            i += 2
            continue
        if two[0] == "[" and not in_class:
            in_class = True
        elif two[0] == "]":
            in_class = False
        out.append("\\z" if two[0] == "$" and not in_class else two[0])
        i += 1
    return "".join(out)


def _groups(parsed: Any) -> list[list[str]]:
    """Groups of lower-case texts; every match of a parsed pattern holds one at least of each group."""
    found: list[list[str]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is parser.LITERAL:
            run += chr(value).lower()
            continue
        if len(run) >= 2:
            found.append([run])
        run = ""
        if op is parser.SUBPATTERN:
            found += _groups(value[-1])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] >= 1:
            found += _groups(value[2])
        elif op is parser.BRANCH:
            parts = [_groups(b) for b in value[1]]
            if all(parts):
                # of each branch the group whose shortest text is longest: it rules out most
                found.append([x for p in parts for x in max(p, key=lambda g: (min(4, min(map(len, g))), -len(g)))])
    return found


@lru_cache(None)
def needles(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Groups of lower-case texts of which every match, in any case, holds one at least of each group."""
    groups = [dict.fromkeys(g) for g in _groups(parser.parse(pattern))]
    return tuple(dict.fromkeys(tuple(x for x in g if not any(y != x and y in x for y in g)) for g in groups))


def _trie(words: list[str]) -> str:
    """A pattern of the longest of the words that starts at a place."""
    if words == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    branches = [(c, re.escape(c) + _trie(rest)) for c, rest in sorted(by.items())]
    if len(branches) > 8:  # a test of a few letters at once spares most branches
        parts = [branches[i : i + 5] for i in range(0, len(branches), 5)]
        branches = [("", f"(?=[{''.join(re.escape(c) for c, _ in p)}])(?:{'|'.join(b for _, b in p)})") for p in parts]
    whole = "|".join(b for _, b in branches)
    return f"(?:{whole}){'?' * ('' in words)}" if len(branches) > 1 or "" in words else whole


@lru_cache(None)
def finder(words: frozenset[str]) -> str:
    """A pattern whose group 1 is, at each place of a text, the longest of the words that starts there."""
    return f"(?=({_trie(sorted(words))}))"


def digest(text: str, words: Iterable[str]) -> str:
    """SQL of a short text that contains those of the words, and only those, that the text in this SQL contains: one
    pass over a long text instead of one for each word.  No word may hold a line feed."""
    pattern = finder(frozenset(words)).replace("'", "\\x27")
    return f"array_join(array_distinct(regexp_extract_all({text}, r'{pattern}', 1)), '\\n')"


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java(pattern, ignore_case))


def extract(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The first match's group; empty where there is none."""
    return F.regexp_extract(text, java(pattern, ignore_case), group)


def extract_all(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def count(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(java(pattern, ignore_case)))
