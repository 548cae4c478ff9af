"""What the text analyzer reads out of whole texts, a batch of texts at a time in Python workers.

Arrow's regular expressions (RE2, one pass without going back) say which texts a pattern can match at all; only those
are searched with the pattern itself, by Python's re with ASCII classes, which finds what Java finds.  RE2 gets the
patterns without look-arounds and folds more letters, so it passes too many texts, never too few.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import derive, text
from ..functions import knowledge as K

SHARE = r"\b(forward|share|send)\s+(this\s+)?(message\s+)?(to|with)\s+(\d+|as many|all your|your)\s*(friends|people|groups|contacts|whatsapp groups)?"
CHAT = r"\b(?:wa\.me|t\.me|chat\.whatsapp\.com|api\.whatsapp\.com)\b"
NEVER = r"\b(do not|don'?t|never)\s+(share|disclose|reveal|tell|give)\b"
AGAIN = r"\bre-?send this to\b"
LEAVE = r"\b(unsubscribe|manage (your )?(email )?preferences|opt[-\s]?out|view (this )?(email )?in (your )?browser|privacy policy)\b"
RUN_OF_LETTERS = r"\b(?:[a-z][\s._*-]){3,}[a-z]\b"
#: Looked for in the plain text only.
_PLAIN = (SHARE, CHAT, NEVER, AGAIN, LEAVE, RUN_OF_LETTERS)
#: Bytes of texts worked on at a time, so that a worker holds the forms of few; patterns that RE2 looks for in one pass.
_BYTES, _TOGETHER = 4_000_000, 8

TACTIC = pa.struct([("id", pa.string()), ("category", pa.string()), ("hits", pa.int32()), ("weight", pa.int32()), ("evidence", pa.list_(pa.string()))])
CLAIMED = pa.struct([("brand", pa.string()), ("keyword", pa.string()), ("sites", pa.list_(pa.string())), ("domain", pa.string())])
FACTS = pa.struct([
    ("tactics", pa.list_(TACTIC)), ("claimed", pa.list_(CLAIMED)), ("emails", pa.list_(pa.string())), ("phones", pa.list_(pa.string())), ("words", pa.int32()), ("caps", pa.float64()),
    ("topics", pa.list_(pa.string())), ("leet", pa.list_(pa.string())), ("spaced", pa.string()), ("chat", pa.string()), ("chain", pa.bool_()), ("never", pa.bool_()), ("leave", pa.bool_()),
    ("hidden", pa.bool_()), ("mixed", pa.bool_()), ("loud", pa.bool_()),
])
_STRINGS = "array<string>"
_TYPE = (
    "struct<tactics:array<struct<id:string,category:string,hits:int,weight:int,evidence:array<string>>>,claimed:array<struct<brand:string,keyword:string,sites:array<string>,domain:string>>,emails:array<string>,phones:array<string>,words:int,"
    "caps:double,topics:array<string>,leet:array<string>,spaced:string,chat:string,chain:boolean,never:boolean,leave:boolean,hidden:boolean,mixed:boolean,loud:boolean>"
)

_FLAGS = re.I | re.A
_BLANKS = str.maketrans({c: " " for c in text.WIDE_BLANKS if c != "\ufeff"})
_INVISIBLE, _BEYOND, _ACCENTS = re.compile(text.INVISIBLE), re.compile(text._BEYOND), re.compile("[\u0300-\u036f]")
_RUN = re.compile(r"\s+", re.A)
_APART = re.compile(text._SPACED, re.A)
_LETTERS, _UPPER = bytes(range(65, 91)) + bytes(range(97, 123)), bytes(range(65, 91))
_LEET = re.compile(r"\b[a-z]{2,}[0134578@$][a-z]{2,}\b", _FLAGS)
_LEET_WORD = re.compile("acc0unt|passw0rd|verif|p4y|b4nk|s3cur|l0gin|updat3|w1n|fr33")
_EMAIL = re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}", _FLAGS)
_PHONE = re.compile(r"(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{3,5}\)?[\s-]?)?\d{5,10}\b", _FLAGS)
_FIVE, _LOUD, _LETTER, _FOREIGN = re.compile("[0-9]{5}"), re.compile("[!?]{3,}"), re.compile("[A-Za-z]"), re.compile("[\u0400-\u04ff\u0370-\u03ff]")
_HXXP, _DOTS, _DOT = re.compile("hxxp(s?)://", _FLAGS), (re.compile(r"\[\s*\.\s*\]", re.A), re.compile(r"\(\s*\.\s*\)", re.A)), re.compile(r"\s+dot\s+", _FLAGS)
_ADDRESS, _SCAN, _TAIL = re.compile(r"://|(?<=[a-z0-9])\.[^\s]", _FLAGS), re.compile(text._SCAN, _FLAGS), re.compile(r"[.,;:!?'\")\]]+\Z")
_FULL, _KEPT = re.compile("https?://", _FLAGS), re.compile(r"https?://|www\.|[a-z0-9-]+\.[a-z]{2,24}(?:[/:?#]|\Z)", _FLAGS)

_RE2_APART = r"(?:^|[^0-9A-Za-z])[A-Za-z][\s\x0B._*-][A-Za-z][\s\x0B._*-][A-Za-z](?:[^0-9A-Za-z]|$)"
_RE2_ADDRESS = r"(?i)://|[a-z0-9]\.[^\s\x0B]|\[[\s\x0B]*\.[\s\x0B]*\]|\([\s\x0B]*\.[\s\x0B]*\)|[\s\x0B]dot[\s\x0B]"


def _re2(pattern: str) -> str:
    """The pattern without look-arounds, \\s with the vertical tab that RE2 leaves out."""
    pattern = re.sub(r"\(\?<?[!=](?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)", "", pattern)
    out, in_class = [], False
    for item in re.findall(r"\\.|[^\\]", pattern, re.S):
        in_class = item == "[" or in_class and item != "]"
        out.append(item if item != r"\s" else r"\s\x0B" if in_class else r"[\s\x0B]")
    return "".join(out)


class _Sought:
    """Patterns to be looked for together."""

    def __init__(self, patterns: tuple[str, ...]):
        self.exact = [re.compile(p, _FLAGS) for p in patterns]
        self.each = ["(?i)" + _re2(p) for p in patterns]
        ids = range(len(patterns))
        self.groups = [ids[i : i + _TOGETHER] for i in range(0, len(patterns), _TOGETHER)]
        self.joined = ["(?i)" + "|".join(f"(?:{_re2(patterns[i])})" for i in g) for g in self.groups]

    def first(self, texts: list[str]) -> dict[int, dict[int, str]]:
        """By place of a text, and by pattern: the first match, if it is not empty."""
        found: dict[int, dict[int, str]] = {}
        whole = pa.array(texts, pa.large_string())
        for group, joined in zip(self.groups, self.joined, strict=True):
            some = pc.indices_nonzero(pc.match_substring_regex(whole, joined))
            if not len(some):
                continue
            part, places = whole.take(some), some.to_pylist()
            for i in group:
                for k in pc.indices_nonzero(pc.match_substring_regex(part, self.each[i])).to_pylist():
                    m = self.exact[i].search(texts[places[k]])
                    if m and m[0]:
                        found.setdefault(places[k], {})[i] = m[0]
        return found


@lru_cache(1)
def _tactics() -> _Sought:
    return _Sought(tuple(p for *_, patterns in K.TACTICS for p in patterns))


@lru_cache(1)
def _plain() -> _Sought:
    return _Sought(_PLAIN)


@lru_cache(1)
def _brands() -> tuple[str, list]:
    """What RE2 looks for, and of each brand its keywords (canonical, pattern, itself) and its struct."""
    rows, words = [], set()
    for name, keywords, domains in K.BRANDS:
        own = [(c := derive.canonical(k), re.compile(f"(?:^|[^a-z0-9]){re.escape(c)}(?:[^a-z0-9]|\\Z)"), k.strip()) for k in keywords]
        words |= {c.strip() for c, *_ in own}
        rows.append((own, {"brand": name, "sites": list(derive.brand_sites()[name]), "domain": domains[0]}))
    quoted = "|".join(re.sub(r"([^a-z0-9 ])", r"\\\1", w) for w in sorted(words))
    return f"(?:^|[^a-z0-9])(?:{quoted})(?:[^a-z0-9]|$)", rows


@lru_cache(1)
def _tables() -> tuple[dict, bytes, dict]:
    """Compatibility forms; look-alikes and leet as a table of Latin-1 and of all letters."""
    letters = str.maketrans(*text._plain_letters())
    latin = bytes(letters.get(i, i) for i in range(256))
    return str.maketrans(*text._compatible()), latin, letters


def plain(s: str) -> str:
    return s if s.isascii() else s.translate(_BLANKS) if _BEYOND.search(s) else s


def canonical(s: str) -> str:
    """text.canonical."""
    forms, latin, letters = _tables()
    if not s.isascii() and _BEYOND.search(s):
        s = _INVISIBLE.sub("", s)
        if _BEYOND.search(s):
            s = s.translate(forms)
            for a, b in text._SEVERAL:
                s = s.replace(a, b)
            s = _ACCENTS.sub("", s)
    try:
        return s.encode("latin-1").translate(latin).decode("latin-1").lower()
    except UnicodeEncodeError:
        return s.translate(letters).lower()


def squeeze(s: str) -> str:
    return _RUN.sub(" ", plain(s)).strip(" ")


def urls(s: str) -> list[str]:
    """text.urls_in."""
    s = _HXXP.sub(r"http\1://", plain(s))
    for dots in _DOTS:
        s = dots.sub(".", s)
    s = _DOT.sub(".", s)
    if not _ADDRESS.search(s):
        return []
    found = {u if _FULL.match(u) else f"http://{u}": None for u in (_TAIL.sub("", m[1]) for m in _SCAN.finditer(s)) if _KEPT.match(u)}
    return list(found)


def _caps(s: str) -> float:
    b = s.encode("utf-8")
    letters = len(b) - len(b.translate(None, _LETTERS))
    return 0.0 if letters < 12 else (len(b) - len(b.translate(None, _UPPER))) / letters


def _phones(s: str) -> list[str]:
    found = dict.fromkeys(m[0].strip(" ") for m in _PHONE.finditer(s)) if _FIVE.search(s) else {}
    return [x for x in found if sum(c in "0123456789" for c in x) >= 8]


def _marks(array: pa.Array, pattern: str) -> list[bool]:
    return pc.match_substring_regex(array, pattern).to_pylist()


def facts(texts: list[str]) -> list[dict]:
    """A FACTS for each text."""
    h0 = [plain(s) for s in texts]
    apart = _marks(pa.array(h0, pa.large_string()), _RE2_APART)
    h1 = [_APART.sub("", s) if a else s for s, a in zip(h0, apart, strict=True)]
    h2 = [canonical(s) for s in h0]
    last = [c if a is b else canonical(b) for a, b, c in zip(h0, h1, h2, strict=True)]
    # what says the same as a form before, apart from case, is not searched again
    forms = [
        list(enumerate(h0)), [(i, b) for i, (a, b) in enumerate(zip(h0, h1, strict=True)) if a != b], [(i, c) for i, (a, c) in enumerate(zip(h0, h2, strict=True)) if c != a.lower()],
        [(i, d) for i, (b, c, d) in enumerate(zip(h1, h2, last, strict=True)) if d != c and d != b.lower()],
    ]
    hits: list[dict[int, str]] = [{} for _ in texts]
    for form in forms:
        for k, own in _tactics().first([s for _, s in form]).items() if form else ():
            at = hits[form[k][0]]
            for p, m in own.items():
                at.setdefault(p, m)
    said = _plain().first(h0)
    pattern, brands = _brands()
    named = _marks(pa.array(last, pa.large_string()), pattern)
    disguised = _marks(pa.array(h0, pa.large_string()), "[A-Za-z]{2}[0134578@$][A-Za-z]{2}")
    rows = []
    for i, (s, raw, canon) in enumerate(zip(texts, h0, last, strict=True)):
        tactics, at = [], 0
        for id_, category, weight, repeat, cap, patterns in K.TACTICS:
            own = [squeeze(hits[i][p])[:90] for p in range(at, at + len(patterns)) if p in hits[i]]
            at += len(patterns)
            if own:
                tactics.append({"id": id_, "category": category, "hits": len(own), "weight": min(cap, weight + min(len(own) - 1, 4) * repeat), "evidence": list(dict.fromkeys(own))[:3]})
        claimed, x = [], f" {canon} "
        for keywords, brand in brands if named[i] else ():
            keyword = next((k for c, p, k in keywords if c in x and p.search(x)), None)
            if keyword is not None:
                claimed.append(brand | {"keyword": keyword})
        own, exotic = said.get(i, {}), not s.isascii()
        rows.append({
            "tactics": tactics, "claimed": claimed, "emails": list(dict.fromkeys(m.lower() for m in _EMAIL.findall(raw))) if "@" in raw else [], "phones": _phones(raw), "words": len(canon.encode("utf-8").split()),
            "caps": _caps(raw), "topics": [t for t in K.SENSITIVE_TOPICS if t in canon] if len(tactics) >= 2 else [], "leet": [w for w in _LEET.findall(raw) if _LEET_WORD.search(canonical(w))] if disguised[i] else [],
            "spaced": own.get(5), "chat": own.get(1), "chain": 0 in own or 3 in own, "never": 2 in own, "leave": 4 in own, "hidden": exotic and bool(_INVISIBLE.search(s)),
            "mixed": exotic and bool(_FOREIGN.search(raw)) and bool(_LETTER.search(raw)), "loud": raw.count("!") >= 4 or bool(_LOUD.search(raw)),
        })
    return rows


def _batches(array: pa.Array):
    """Lists of texts, nulls as empty ones; bytes that are no UTF-8 become U+FFFD, as in Java."""
    sums, begin = pc.cumulative_sum(pc.fill_null(pc.binary_length(array), 0).cast(pa.int64())).to_pylist(), 0
    while begin < len(array):
        end = max(begin + 1, bisect_right(sums, (sums[begin - 1] if begin else 0) + _BYTES, begin))
        part, begin = array.slice(begin, end - begin), end
        try:
            yield [s or "" for s in part.to_pylist()]
        except UnicodeDecodeError:
            yield [(b or b"").decode("utf-8", "replace") for b in part.cast(pa.binary()).to_pylist()]


def facts_of(c: Column) -> Column:
    """A struct of a text: tactics, claimed, emails, phones, words, caps, topics (of texts with two tactics), leet,
    spaced and chat (first match or null), chain, never, leave, hidden, mixed, loud.  A null text counts as empty."""

    @F.arrow_udf(_TYPE)
    def text_facts(a: pa.Array) -> pa.Array:
        return pa.array([r for texts in _batches(a) for r in facts(texts)], FACTS)

    return text_facts(c.cast("string"))


def urls_of(c: Column) -> Column:
    """text.urls_in for long texts."""

    @F.arrow_udf(_STRINGS)
    def text_urls(a: pa.Array) -> pa.Array:
        found = []
        for texts in _batches(a):
            some = _marks(pa.array([plain(s) for s in texts], pa.large_string()), _RE2_ADDRESS)
            found += [urls(s) if x else [] for s, x in zip(texts, some, strict=True)]
        return pa.array(found, pa.list_(pa.string()))

    return text_urls(c.cast("string"))
