"""Operators against brute force, exact round trips, and held-out accuracy on the smallest tables."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontam, line_dedup, minhash, quality_rules, sentencepiece_codec, sharding, url_filter
from tidewatch.llm.common import crc_fold
from tidewatch.llm.queries import ORACLE_SQL, QUERIES

BLANKS = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.mark.parametrize("name", ORACLE_SQL)
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(columns).collect())


def test_base_counts(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect()}
    for i, t in texts.items():
        w = re.findall(BLANKS, t)
        seen: dict[tuple, list[int]] = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(BLANKS, x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_repeated_words_with_colliding_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_LOW", 60)  # four bits of hash are left, so the windows themselves decide
    rows = [(1, "a b c a b c d"), (2, " ".join(str(i) for i in range(200))), (3, " ".join(str(i % 7) for i in range(90)))]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("w", F.split("t", " "))
    got = {r["k"]: r["n"] for r in quality_rules.repeated_words(df, "w", "n").collect()}
    assert got == {1: 6, 2: 0, 3: 90}


def test_quality_rules_keep_and_drop(spark, sf_dir):
    r = QUERIES["op3_quality_rules"](spark, sf_dir).join(labels(spark, sf_dir), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {x["quality"]: x["kept"] for x in r}
    assert kept[1] > 0.95 and kept.get(0, 0) < 0.2


def shingles(text, k):
    w = text.encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(texts, k):
    sets, parent = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {p for at in by.values() for p in itertools.combinations(at, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sets, {i: find(i) for i in texts}


def test_near_duplicates(spark, sf_dir, texts):
    sets, want = components(texts, 4)
    got = {r["doc_id"]: r for r in QUERIES["op8_minhash"](spark, sf_dir).collect()}
    assert {i: (len(s), want[i]) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def test_near_duplicates_around_a_missing_base(spark):
    """Variants of one base, of which many are no links of each other, and chains of links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(120):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            w[at] = f"x{rng.integers(0, 40)}"
        texts[i] = " ".join(w)
    for i in range(120, 150):
        texts[i] = " ".join(f"y{j}" for j in range((i - 120) * 6, (i - 120) * 6 + 100))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, k=4).collect()}
    assert got == components(texts, 4)[1]


def test_masks_cover_three_substitutions():
    for wrong in itertools.combinations(range(decontam.WINDOW), 3):
        assert any(all(at + o not in wrong for o in m) for m in decontam.MASKS for at in range(decontam.WINDOW - max(m)))


def test_every_permitted_substitution_is_found(spark):
    """Items of 8 to 16 words, and a longer one, each with every set of substitutions that MIN_SHARE permits and one set too many."""
    bench, docs, want = [], [], {}
    for n in [*range(8, 17), 18]:
        item = [f"i{n}w{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        w = min(n, decontam.WINDOW)
        most = w - -(-4 * w // 5)
        for wrong in [*itertools.combinations(range(w), most), tuple(range(most + 1))]:
            words = ["changed" if k in wrong else x for k, x in enumerate(item[:w])]
            for before in ([], ["before"]):
                want[len(docs)] = [n] if len(wrong) == most else []
                docs.append((len(docs), " ".join(before + words)))
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for limit in (decontam.MAX_BROADCAST_SEEDS, 0):
        assert {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(df, items, limit).collect()} == want


def test_decontamination(spark, sf_dir, texts):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    clean = lambda t: t.lower().translate(str.maketrans("", "", decontam.PUNCTUATION)).split()
    item = {i: clean(t) for i, t in items}
    rng = np.random.default_rng(3)
    planted = dict(texts)
    for n, (i, w) in enumerate(item.items()):
        part = list(w[:24])
        for at in rng.choice(len(part), 3, replace=False):
            part[at] = "changed"
        planted[10_000 + n] = "some words before " + " ".join(part) + " and some after"
    want = {}
    for d, t in planted.items():
        places: dict[str, list[int]] = {}
        for k, x in enumerate(clean(t)):
            places.setdefault(x, []).append(k)
        found = set()
        for i, b in item.items():
            n = min(len(b), decontam.WINDOW)
            same: dict[int, set[int]] = {}  # by shift, the item's words that stand at the shifted place
            for j, x in enumerate(b):
                for k in places.get(x, ()):
                    same.setdefault(k - j, set()).add(j)
            if any(5 * len(js & set(range(s, s + n))) >= 4 * n for js in same.values() if 5 * len(js) >= 4 * n for s in range(len(b) - n + 1)):
                found.add(i)
        want[d] = sorted(found)
    df = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for limit in (decontam.MAX_BROADCAST_SEEDS, 0):
        got = {r["doc_id"]: r["item_ids"] for r in decontam.decontaminate(df, bench, limit).collect()}
        assert got == want


def test_sharding(spark, sf_dir, texts):
    got = QUERIES["op10_sharding"](spark, sf_dir).collect()
    sizes = {i: len(t.encode()) + 8 for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    mean = sum(sizes.values()) / 24
    assert all(abs(sum(r["size"] for r in rs) - mean) <= 2 * max(sizes.values()) for rs in by.values())
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())


def test_sharding_cuts_a_hot_group(spark):
    rows = [(i, "same text " * 20) for i in range(3000)] + [(5000 + i, f"text {i} " * (i % 30)) for i in range(2000)] + [(9000 + i, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, 24).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    total = sum(r["s"] for r in got)
    assert len(got) == 24 and all(abs(r["s"] - total / 24) < 0.02 * total / 24 + 500 and r["m"] == r["n"] - 1 for r in got)


def test_shards_written(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/s", n_shards=4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_sentencepiece_round_trip(spark, sf_dir, texts):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    extra = {90_000: "  two  blanks ▁ mark", 90_001: "日本語 \u0000 🙂", 90_002: "x" * 500_000 + " y z" * 200_000}
    df = spark.createDataFrame([*texts.items(), *extra.items()], "doc_id long, text string")
    encoded = sentencepiece_codec.encode_documents(df).persist()
    got = {r["doc_id"]: r for r in encoded.collect()}
    for i, t in (texts | {k: extra[k] for k in (90_000, 90_001)}).items():
        assert got[i]["ids"] == peer.encode(t) and got[i]["round_trip"] == (peer.decode(got[i]["ids"]) == t)
    assert got[90_002]["round_trip"] and all(got[i]["round_trip"] for i in texts)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_documents(encoded).collect()}
    assert all(back[i] == t for i, t in texts.items()) and back[90_002] == extra[90_002]


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/1"), (2, "https://example.org/en/12?x#y"), (3, "http://b.org/en/1"), (4, "http://x.com/fr/a"), (5, "http://x.com/de/a"), (6, "http://x.org"), (7, None), (8, "no scheme"),
        (9, "http://notexample.org/es/"), (10, "http://free-bets.example.net/a"), (11, "http://thewh.example.net/en/3"), (12, "http://com/de/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[9][2:] == ("org/", "allow") and got[12][2:] == ("com/de/", "block")
    assert got[6][1:3] == ("", None) and got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")


def test_language_held_out(spark):
    rows = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    from tidewatch.llm import langid

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = crc_fold(F.col("doc_id"), 4) == 2
    got = langid.predict(df.where(held), langid.train(df.where(~held))).join(df, "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97


@pytest.mark.parametrize("name,label,least", [("op4_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.8)])
def test_held_out_ranking(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).where("held_out").join(labels(spark, sf), "doc_id").collect()
    good, bad = [r["score"] for r in rows if r[label] == 1], [r["score"] for r in rows if r[label] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > least and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.5)) for r in rows)


def test_digest_is_of_utf8(spark):
    df = spark.createDataFrame([(1, "é\nü")], "doc_id long, text string")
    kept = line_dedup.dedup_lines(df).select(F.sha2("text", 256).alias("h")).first()["h"]
    assert kept == hashlib.sha256("é\nü".encode()).hexdigest()


def test_url_classifier_held_out(spark):
    rows = [(u, 1) for u in url_filter.UNWANTED] + [(u, 0) for u in url_filter.WANTED]
    model = url_filter.train(spark.createDataFrame([r for i, r in enumerate(rows) if i % 4], "url string, label int"))
    held = spark.createDataFrame([(u, y) for i, (u, y) in enumerate(rows) if not i % 4], "url string, y int").withColumn("page_id", F.monotonically_increasing_id())
    got = url_filter.judge_urls(held, model, rules=()).join(held, "page_id").collect()
    good, bad = [r["score"] for r in got if r["y"]], [r["score"] for r in got if not r["y"]]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_url_method_on_odd_urls(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    rows = [(1, "http://user:pw@HOST.net:8080/p;x?q"), (2, "https://a.net/" + "x" * 50_000), (3, "ftp://b.net#f"), (4, "://c.net/d"), (5, "http://"), (6, "")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), model).collect()}
    assert (got[1]["host"], got[1]["path"]) == ("user:pw@host.net:8080", "/p;x") and got[3]["host"] == "b.net" and got[4]["host"] == "c.net" and got[5]["host"] == got[6]["host"] == ""
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_scores_against_brute_force():
    from tidewatch.llm import langid

    model = langid.Model({(0, "a"): {"one": 3, "two": 1}, (0, "b"): {"two": 4}, (1, "a"): {"o": 4, "n": 3, "e": 3}, (1, "b"): {"t": 4, "w": 4, "o": 4}}, {(0, "a"): 4, (0, "b"): 4, (1, "a"): 10, (1, "b"): 12})
    share = lambda n, total: np.log(max(langid.FLOOR, n / total))
    unseen = np.mean([[share(4, 10), share(4, 12)], [share(3, 10), share(0, 12)]], axis=0)  # "on" by its letters
    total = np.array([share(3, 4), share(0, 4)]) + 2 * np.array([share(1, 4), share(4, 4)]) + unseen
    best, score = model.predict("one two TWO on", {})
    assert best == "ab"[int(total.argmax())] and np.isclose(score, 1 / np.exp(total - total.max()).sum())


def test_label_model_finds_accuracies():
    """Voters of known accuracy, of which two copy each other: posteriors are right and the copies share their weight."""
    from tidewatch.llm import toxicity

    rng = np.random.default_rng(1)
    n, k = 20_000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.2
    v = np.zeros((n, k), dtype=int)
    for j, name in enumerate(toxicity.VOTERS):
        if name in ("no_hit", "rare_hits"):
            v[:, j] = np.where(rng.random(n) < np.where(y, 0.1, 0.8), -1, 0)
        else:
            v[:, j] = rng.random(n) < np.where(y, 0.6, 0.05)
    v[:, 2] = v[:, 1]
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts, np.full(len(patterns), -1), 0.2)
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.95 and model.weight[1] < 0.75 * model.weight[3:9].mean()
    assert abs(model.table[4, 1, 2] - 0.6) < 0.05 and abs(model.table[4, 0, 2] - 0.05) < 0.03


def test_quality_solver_and_calibration(spark):
    """The weights solve the ridge equations of all rows, and the calibration pools like brute force."""
    from tidewatch.llm import quality_model

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, len(quality_model.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(c) for c in row], int(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "doc_id long, x array<double>, y int")
    model = quality_model.train(df)
    z = model.expand(x)
    penalty = quality_model.RIDGE * len(x) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9 * len(x)
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    assert (np.diff(model.level) >= -1e-12).all() and np.mean((model.score(x) > 0.5) == y) > 0.85
    at, level = quality_model.pool_adjacent(np.arange(4.0), np.array([0.1, 0.5, 0.3, 0.9]), np.array([1.0, 1.0, 3.0, 1.0]))
    assert np.allclose(level, [0.1, 0.35, 0.35, 0.9])


def test_groups_are_cut_only_at_splitters(spark):
    rows = [(i, f"text {i // 7} " * 9) for i in range(7_000)]
    placed = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n"))
    assert placed.where("n > 1").count() <= 7


def test_many_ranges_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 20)
    rows = [(i, f"text {i % 900}") for i in range(4_000)] + [(10_000 + i, "hot") for i in range(2_000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    by: dict[int, list[int]] = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 6_000 and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_unigram_model_against_the_library(spark, tmp_path):
    """A unigram model written by hand: user-defined and unused pieces, byte fallback, scores that compete."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    add = lambda piece, score, kind: model.pieces.append(proto.ModelProto.SentencePiece(piece=piece, score=score, type=kind))
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(piece, 0.0, kind)
    for b in range(256):
        add(f"<0x{b:02X}>", 0.0, 6)
    words = {"▁": -4.0, "▁the": -2.0, "▁cat": -3.1, "▁ca": -3.0, "t": -3.5, "s": -3.2, "at": -3.3, "▁s": -3.6, "a": -4.1, "c": -4.4, "e": -4.2, "h": -4.3, "▁t": -3.9, "he": -3.4, "ts": -3.7, "▁sat": -5.0, "é": -6.0}
    for piece, score in words.items():
        add(piece, score, 1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id = 1, True, 0, 1, 2
    model.trainer_spec.pad_id, model.trainer_spec.vocab_size = -1, len(model.pieces)
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    peer = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat", "cats", "the  cats at", "héé 日本 🙂", "", "x", "tttheecatsat hats", "a\nb\tc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = sentencepiece_codec.encode_documents(df, path)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert [got[i] for i in range(len(texts))] == [peer.encode(t) for t in texts]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_documents(encoded, path).collect()}
    assert [back[i] for i in range(len(texts))] == [peer.decode(peer.encode(t)) for t in texts]
