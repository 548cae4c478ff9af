"""Scalars: texts, addresses, mails, pages, patterns."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch import fixtures
from tidewatch.functions import derive, html, mail, rx, text, urls
from tidewatch.functions import knowledge as K
from tidewatch.queries import QUERIES


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("v e r i f y me", "verify me"), ("p-a-s-s word", "pass word"), ("a b", "a b"), ("I am a b c", "I am abc"), ("", "")])
def test_despaced(spark, raw, want):
    assert one(spark, text.despaced, raw) == want


@pytest.mark.parametrize("raw", ["P4yP4l", "аpple ＡＢＣ", "Ünïcode ﬁx​ed", "x!|@$"])
def test_canonical_agrees_with_the_python_twin(spark, raw):
    assert one(spark, text.canonical, raw) == derive.canonical(raw)


def test_links(spark):
    raw = "see hxxp://evil[.]com/a, www.a.b.org! info.The a@gmail.com sub.deep.host.com http://x.y/z) dot com"
    assert one(spark, text.urls_in, raw) == ["http://evil.com/a", "http://www.a.b.org", "http://info.The", "http://gmail.com", "http://x.y/z"]


def test_phones_and_mails(spark):
    assert one(spark, text.emails_in, "A@B.com a@b.com") == ["a@b.com"]
    assert one(spark, text.phones_in, "call 98765 or +44 20794 609580") == ["+44 20794 609580"]


@pytest.mark.parametrize("host,rd", [("www.a.b.co.uk", "b.co.uk"), ("a.b.com", "b.com"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost"), ("", "")])
def test_registrable_domain(spark, host, rd):
    assert one(spark, urls.registrable_domain, host) == rd


@pytest.mark.parametrize("raw,href", [
    ("HTTP://User@Ex.COM:80/a b?q=1#f", "http://User@ex.com/a%20b?q=1#f"), ("ex.com", "http://ex.com/"), ("https://ex.com:8443", "https://ex.com:8443/"), ("mailto:a@b.c", "mailto:a@b.c"),
    ("http://a b/", None), ("", None), (None, None), ("http://1.2.3.999/", None),
])
def test_parse(spark, raw, href):
    got = one(spark, urls.parse_url, raw)
    assert (got and got["href"]) == href


def test_parameters_and_escapes(spark):
    assert [(p["key"], p["value"]) for p in one(spark, urls.parameters, "?a=1&b=x%20y+z&c")] == [("a", "1"), ("b", "x y z"), ("c", "")]
    assert one(spark, urls.unescaped, "%zz") == "%zz"


def test_mail(spark):
    raw = "From: Ann <a@b.org>\nSubject: one\n two\nX-A: 1\nX-A: 2\n\nbody"
    got = one(spark, mail.split_mail, raw)
    assert got["is_mail"] and got["body"] == "body"
    assert one(spark, lambda c: mail.header(c, "x-a"), got["header_text"]) == "1 | 2"
    assert one(spark, lambda c: mail.header(c, "subject"), got["header_text"]) == "one two"
    assert one(spark, mail.address, '"Ann L" <MAILTO:A@b.org>').asDict() == {"display": "Ann L", "address": "a@b.org", "domain": "b.org"}


def test_html(spark):
    assert one(spark, html.html_to_text, "<p>a&amp;b</p><script>x</script><br/>c") == "a&b\n \nc"
    assert one(spark, lambda c: html.attribute(c, "href"), "<a class=x href = 'y z'>") == "y z"


def test_border_is_ascii_and_end_is_the_end(spark):
    assert one(spark, lambda c: rx.matches(c, r"\bpin\b"), "épin x") is True
    assert one(spark, lambda c: rx.matches(c, "x$"), "x\n") is False


def test_fixed_values():
    assert len(K.BRANDS) == 45 and len(K.TACTICS) == 16 and sum(len(t[5]) for t in K.TACTICS) == 103
    assert len(K.HOMOGLYPHS_FROM) == len(K.HOMOGLYPHS_TO) and len(K.LEET_FROM) == len(K.LEET_TO)


def test_normal_forms_read_whole_contents(spark, tmp_path):
    """Documents that differ only far behind the snippet, and one with other letters there, against brute force."""
    texts = {0: "a b " * 300 + "end", 20: "a b " * 300 + "enf", 40: "", 60: "zażółć gęślą jaźń " * 40, 61: "x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["record_id"], r["entropy"]) for r in QUERIES["normal_forms"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        content, h = f"{fixtures.TEXTS[i % len(fixtures.TEXTS)]} {t}", 0x811C9DC5
        for x in content:
            h = (h ^ ord(x)) * 0x01000193 % 2**32
        bits = -sum(k / len(content) * math.log2(k / len(content)) for k in Counter(content).values())
        assert got[i][0] == f"{h:08x}" and abs(got[i][1] - bits) < 1e-6
    assert len({x for x, _ in got.values()}) == len(texts)


def test_one_pass_finds_the_words_that_many_would(spark):
    words = ["act", "action", "tion", "24", " vi ", "api.what", "don't", "ion x"]
    texts = ["an action x", "acts at 24", "a vi b api.whatsapp", "don't", "apixwhat", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", F.expr(rx.digest("t", words)).alias("d"))
    for r in df.collect():
        assert [w in r["d"] for w in words] == [w in r["t"] for w in words]


def test_classes_spelled_out_match_as_ranges_do(spark):
    every = "".join(map(chr, range(1, 0x250)))
    for pattern in (r"[\s._*-]", r"[^\s<>\"'`)\]}]", "[A-Fa-f0-3]", "[^A-Za-z]", r"[\d\w-]", "[à-ÿ]"):
        spelled = rx.java(pattern, False)
        assert r"\s" not in spelled and "A-" not in spelled
        got = spark.range(1).select(*[F.array_join(F.regexp_extract_all(F.lit(every), F.lit(p), F.lit(0)), "").alias(n) for n, p in (("a", pattern), ("b", spelled))]).first()
        assert got["a"] == got["b"]
