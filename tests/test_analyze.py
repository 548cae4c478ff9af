"""The whole plan on hand-made records: firing rules and near misses."""

import pytest
from pyspark.sql import functions as F

from tidewatch import fixtures
from tidewatch.operators import models
from tidewatch.plans.analyze import analyze, model_stage, ranked_urls

RECORDS = [
    ("threat", {"content": "Your bank account will be suspended within 24 hours. Verify your identity and click here to confirm your details."}),
    ("parcel", {"content": "Your package delivery has been delayed. Track it here."}),
    ("plain", {"content": "Hello team, the meeting notes of yesterday are in the shared folder, see you all next week on Monday."}),
    ("link", {"url": "http://paypal-secure-login.tk/verify/account.html?email=a@b.c"}),
    ("official", {"url": "https://www.google.com/"}),
    ("mail", {"content": "From: PayPal <x@evil.xyz>\nReply-To: a@b.com\nSubject: Re: hi\n\nDear customer, v e r i f y your PayPal account at http://bit.ly/x now!!!!"}),
    ("page", {"url": "http://foo.bar.example.com/l", "html": "<html><title>PayPal login</title><form action='http://evil.com/p'><input type=password name=pwd></form></html>"}),
    ("code", {"content": "482913 is your code. Do not share it with anyone."}),
    ("empty", {"content": ""}),
    ("null", {}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, r.get("content"), r.get("url"), r.get("html")) for k, r in RECORDS]
    df = spark.createDataFrame(rows, "id string, content string, url string, html string")
    df = analyze(df).select("id", "kind", "score", "level", F.transform("risky", lambda s: s["id"]).alias("risky"), F.transform("positives", lambda s: s["id"]).alias("positives"), "explanation")
    return {r["id"]: r for r in df.collect()}


def test_published_scores(found):
    assert (found["threat"]["score"], found["threat"]["level"]) == (86, "high")
    assert (found["parcel"]["score"], found["parcel"]["level"]) == (48, "medium")


def test_kinds(found):
    assert [found[k]["kind"] for k in ("threat", "link", "mail", "page", "empty", "null")] == ["sms", "url", "email", "website", "message", "message"]


def test_signals(found):
    assert found["plain"]["positives"] == ["content-neutral-tone"] and not found["plain"]["risky"]
    assert {"url-brand-embedded", "url-suspicious-tld", "url-no-https", "url-identity-params", "url-dangerous-file"} <= set(found["link"]["risky"])
    assert found["official"]["positives"] == ["url-official-domain"]
    assert {"sender-display-spoof", "sender-replyto-mismatch", "sender-fake-thread", "sender-suspicious-tld", "url-shortener", "content-spaced-words"} <= set(found["mail"]["risky"])
    assert {"page-cross-domain-post", "page-insecure-login", "page-brand-impersonation", "page-password-in-url"} <= set(found["page"]["risky"])
    assert "content-transactional-code" in found["code"]["positives"]


def test_nothing_in_nothing_out(found):
    assert found["empty"]["score"] == found["null"]["score"] == 0


def test_explanations(found):
    e = found["page"]["explanation"]
    assert e["reasons"][0]["severity"] == "critical" and 1 <= len(e["advice"]) <= 6
    assert len(found["plain"]["explanation"]["advice"]) == 2


def test_prefilter_never_hides_a_match():
    import re

    from tidewatch.functions import knowledge as K
    from tidewatch.functions import rx

    samples = ["Your ACCOUNT will be Suspended within 24 hours unless you verify", "congratulations you have won a lucky draw prize", "pay the registration fee now", "call support helpline", "are you at your desk", *fixtures.TEXTS]
    for *_, patterns in K.TACTICS:
        for p in patterns:
            for t in samples:
                if re.search(p, t, re.I | re.A):
                    assert all(any(n in t.lower() for n in group) for group in rx.needles(p))


def test_model_stage_takes_the_greater_probability(spark, tmp_path):
    rows = [(i, f"pay the fee now at http://evil{i}.top/login" if i % 2 else f"lunch on monday with team {i} at https://example.org/menu", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, content string, label int")
    model = models.train_message_model(df, "id", "content", "label")
    model.save(f"{tmp_path}/m")
    loaded = models.MessageModel.load(spark, f"{tmp_path}/m")
    links = spark.createDataFrame([(f"http://evil{i}.top/login" if i % 2 else f"https://example.org/m{i}", i % 2) for i in range(40)], "url string, label int")
    step = model_stage("id", loaded, models.train_url_model(links, "url", "label"))
    some = df.where("id < 4").select("id", "content").union(spark.createDataFrame([(90, " ")], "id long, content string"))
    got = {r["id"]: r for r in analyze(some, enrich=step).select("id", "ml", "score", F.transform("signals", lambda s: s["id"]).alias("ids"), F.col("url_results")).collect()}
    assert not got[90]["ml"]["used"] and got[90]["ml"]["probability"] is None
    for i in range(4):
        ml = got[i]["ml"]
        assert ml["models"] == ["message", "url"] and ml["probability"] == max(ml["message"], ml["url"]) and any(x.startswith("ml-message-") for x in got[i]["ids"])
    assert got[1]["ml"]["probability"] > 0.6 > got[0]["ml"]["probability"]
    again = {r["id"]: r["probability"] for r in models.predict_messages(df, loaded, "id", "content").collect()}
    assert again == {r["id"]: r["probability"] for r in models.predict_messages(df, model, "id", "content").collect()}


def test_links_are_ranked_by_points(spark):
    df = analyze(spark.createDataFrame([("see https://example.org/a and http://paypal-secure-login.tk/verify and https://example.org/b",)], "content string"))
    assert df.select(ranked_urls(F.col("url_results"))).first()[0][0] == "http://paypal-secure-login.tk/verify"


def test_repeated_grams_count(spark):
    got = spark.sql("SELECT 'banana' AS n").select(models.terms(F.col("n"))).first()[0]
    assert got.count("c:ana") == 2 and got.count("c: ba") == 1 and "c:a " not in got


ODD_TEXTS = [
    None, "", " \t\n", "v e r i f y your p.a.s.s.w.o.r.d at hxxps://login-check[.]xyz/secure, or www dot bad dot example", "Your аccount at Pаypаl: ​ver​ify within 24 hours or it will be suspended Ａﬁ",
    "PAY NOW!!! ſhare this message with 10 friends; call +44 20 7946 0958 or (0123) 4567890, mail A.B@Example.ORG and a.b@example.org", "verif1ed acc0unt p4ssword À la carte ¿qué? café\x0bwithin\x0b2\x0bhours or else",
    "do not share your OTP, never share the pin", "Please send your otp so i can complete it\u0085within 3 days or verify　now", "x" * 3000 + " A.b.c.d E_F-G " + "https://e.example.org/?q=(5). " * 40, "O P Q r s.t \U0001f600 vi \U0001f600 state bank Vi vi İstanbul ΣΣ", *fixtures.TEXTS,
]


def test_batches_of_texts_find_what_the_column_functions_find(spark):
    import re

    from tidewatch.functions import knowledge as K
    from tidewatch.functions import rx, text
    from tidewatch.operators.text_facts import facts_of, urls_of
    from tidewatch.operators.text_signals import claimed_brands, haystacks

    df = haystacks(spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, t string").coalesce(1), "t")
    flat = lambda rows: [tuple(map(str, r)) for r in rows]
    want = df.select("i", text.urls_in(F.col("t")), text.emails_in(F.col("_h0")), text.phones_in(F.col("_h0")), F.regexp_count("_canonical", F.lit(r"\S+")), text.upper_ratio(F.col("_h0")), claimed_brands("_canonical"))
    got = df.select("i", "t").withColumn("f", facts_of(F.col("t"))).withColumn("u", urls_of(F.col("t"))).select("i", "u", "f.emails", "f.phones", "f.words", "f.caps", "f.claimed", "f.tactics")
    found = {r["i"]: r["tactics"] for r in got.collect()}
    assert flat(want.orderBy("i").collect()) == flat(got.drop("tactics").orderBy("i").collect())
    for id_, _, _, _, _, patterns in K.TACTICS:
        first = F.array_compact(F.array(*[F.coalesce(*[F.nullif(rx.extract(F.col(f"_h{k}"), p), F.lit("")) for k in range(4)]) for p in patterns]))
        said = {r[0]: list(dict.fromkeys(re.sub(r"[ \t\n\x0b\f\r]+", " ", x.translate({0xA0: " ", 0x3000: " "})).strip(" ")[:90] for x in r[1]))[:3] for r in df.select("i", first).collect() if r[1]}
        assert said == {i: t["evidence"] for i, ts in found.items() for t in ts if t["id"] == id_}


def test_long_texts_are_not_searched_pattern_by_pattern(spark):
    plan = analyze(spark.createDataFrame([("a", "b")], "id string, content string")).select("score", "tactics")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(_h0" not in plan and "text_facts" in plan
