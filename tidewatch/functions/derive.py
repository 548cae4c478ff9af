"""What follows from the fixed values, worked out once in Python when plans are built."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from . import knowledge as K
from .text import _compatible, _look_alikes


def canonical(text: str) -> str:
    """The Python twin of text.canonical, for keywords."""
    text = unicodedata.normalize("NFKC", re.sub("[​-‏‪-‮⁠﻿]", "", text))
    return text.translate(str.maketrans(*_look_alikes())).lower().translate(str.maketrans(K.LEET_FROM, K.LEET_TO)).lower()


def registrable(domain: str) -> str:
    labels = domain.removeprefix("www.").split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and ".".join(labels[-2:]) in K.MULTI_PART_SUFFIXES else labels[-2:])


def label(domain: str) -> str:
    """The registrable domain without its suffix."""
    rd = registrable(domain)
    labels = rd.split(".")
    suffix = ".".join(labels[-2:]) if len(labels) >= 3 and ".".join(labels[-2:]) in K.MULTI_PART_SUFFIXES else labels[-1]
    return rd.removesuffix(f".{suffix}")


def look_alikes() -> tuple[str, str]:
    """Look-alike letters of both cases and what they look like, place by place."""
    return _look_alikes()


def folding() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms."""
    return _compatible()


@lru_cache(1)
def brand_labels() -> tuple[tuple[str, str, str, int], ...]:
    """(brand, domain, canonical label, edits allowed), for labels of four letters and more, in order."""
    rows = [(name, d, canonical(label(d))) for name, _, domains in K.BRANDS for d in domains]
    return tuple((n, d, x, 2 if len(x) >= 8 else 1) for n, d, x in rows if len(x) >= 4)


@lru_cache(1)
def brand_sites() -> dict[str, tuple[str, ...]]:
    return {name: tuple(dict.fromkeys(registrable(d) for d in domains)) for name, _, domains in K.BRANDS}
