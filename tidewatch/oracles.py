"""SQL for the queries of queries.py, written apart from the DataFrame code, for an engine with lists and lambdas."""

from __future__ import annotations

from . import fixtures
from .functions import derive
from .functions import knowledge as K

_MESSAGES = f"""messages AS (
    SELECT d.doc_id, ov.snippet || ' ' || d.text AS content
    FROM documents d JOIN {fixtures.values(fixtures.TEXTS, "snippet")} ON d.doc_id % {len(fixtures.TEXTS)} = ov.k)"""
_SITES = f"""sites AS (
    SELECT p.page_id, p.url, CASE WHEN regexp_matches(p.html, '(?is)</body>') THEN regexp_extract(p.html, '(?is)^(.*)</body>', 1) || ov.fragment || right(p.html, length(p.html) - length(regexp_extract(p.html, '(?is)^(.*)</body>', 1)))
                                  ELSE p.html || ov.fragment END AS html
    FROM pages p JOIN {fixtures.values(fixtures.PAGES, "fragment")} ON p.page_id % {len(fixtures.PAGES)} = ov.k)"""
_EVENTS = """hist AS (
    SELECT event_id, ts AS analyzed_at, event_type AS type, CASE WHEN value <= 30 THEN 'low' WHEN value <= 70 THEN 'medium' ELSE 'high' END AS level,
           CAST(floor(value) AS BIGINT) AS score, CAST(floor(value * 7) AS BIGINT) AS duration_ms, user_id FROM events)"""
_WIDE = "chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def _list(items) -> str:
    return "[" + ", ".join(fixtures.literal(x) for x in items) + "]"


def _plain(c: str) -> str:
    return f"translate({c}, {_WIDE}, '{' ' * 18}')"


_PARTS = f"""parts AS (
    SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host,
           CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END AS path,
           regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query, url FROM pages),
    named AS (SELECT *, string_split(regexp_replace(host, '^www\\.', ''), '.') AS labels FROM parts),
    domains AS (
    SELECT *, CASE WHEN len(labels) <= 2 THEN array_to_string(labels, '.')
                   WHEN list_contains({_list(K.MULTI_PART_SUFFIXES)}, array_to_string(labels[-2:], '.')) THEN array_to_string(labels[-3:], '.')
                   ELSE array_to_string(labels[-2:], '.') END AS rd,
           CASE WHEN len(labels) > 2 AND list_contains({_list(K.MULTI_PART_SUFFIXES)}, array_to_string(labels[-2:], '.')) THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS tld FROM named)"""

_SWEEP = """scored AS (SELECT quality, floor((doc_id * 7919 % 1000 + quality * 400) / 1.4) / 1000 AS score FROM labels),
    candidates AS (SELECT round(0.02 + 0.01 * i, 2) AS candidate FROM range(94) t(i)),
    swept AS (
    SELECT candidate, count(*) FILTER (WHERE quality = 1 AND score >= candidate) AS tp, count(*) FILTER (WHERE quality = 0 AND score >= candidate) AS fp,
           count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM scored CROSS JOIN candidates GROUP BY candidate)"""

_HTML = "html"
for _pattern, _by in (
    ("<script[\\s\\S]*?</script>", "' '"), ("<style[\\s\\S]*?</style>", "' '"), ("<noscript[\\s\\S]*?</noscript>", "' '"), ("<!--[\\s\\S]*?-->", "' '"), ("<br\\s*/?>", "chr(10)"), ("</(p|div|tr|li|h[1-6])>", "chr(10)"),
    ("<[^>]+>", "' '"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("[ \\t]+", "' '"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+", "''"), ("\\s+$", "''"),
):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', {_by}, 'gi')"

_LEVEL = "CASE WHEN score <= 30 THEN 'low' WHEN score <= 70 THEN 'medium' ELSE 'high' END"
_CAPS = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.CATEGORY_CAPS.items()) + f" ELSE {K.DEFAULT_CATEGORY_CAP} END"


def _scores(signals: str, key: str) -> str:
    """CTEs that score a relation (key, ord, id, category, weight) called ``signals``; the last is ``scores``."""
    return f"""strongest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, id ORDER BY abs(weight) DESC, ord) AS r FROM {signals}) WHERE r = 1),
    capped AS (
        SELECT {key}, category, least(sum(weight), {_CAPS}) AS applied FROM strongest WHERE weight > 0 GROUP BY {key}, category),
    summed AS (
        SELECT k.{key}, coalesce((SELECT sum(applied) FROM capped c WHERE c.{key} = k.{key}), 0) AS evidence, coalesce((SELECT count(*) FROM capped c WHERE c.{key} = k.{key}), 0) AS categories,
               count(*) FILTER (WHERE weight > 0) AS risky, count(*) FILTER (WHERE weight < 0) AS positives, coalesce(max(weight) FILTER (WHERE weight > 0), 0) AS heaviest,
               least({K.POSITIVE_CAP}, abs(coalesce(sum(weight) FILTER (WHERE weight < 0), 0))) AS trust FROM strongest k GROUP BY k.{key}),
    nets AS (SELECT *, greatest(0.0, evidence - trust * CASE WHEN evidence >= 55 THEN 0.25 WHEN evidence >= 40 THEN 0.5 ELSE 1.0 END) AS net FROM summed),
    curves AS (SELECT *, 100 * (1 - exp(-CAST(net AS DOUBLE) / {K.KAPPA})) AS curve FROM nets),
    floors AS (SELECT *, CASE WHEN net > 0 AND heaviest >= 26 AND curve < 72 THEN 72 WHEN net > 0 AND heaviest >= 22 AND curve < 60 THEN 60 END AS floor FROM curves),
    scores AS (SELECT *, CAST(floor(least(100.0, greatest(0.0, coalesce(floor, curve))) + 0.5) AS BIGINT) AS score FROM floors)"""


_LABELS = ", ".join(f"({i}, {fixtures.literal(x)}, {m})" for i, (_, _, x, m) in enumerate(derive.brand_labels()))

_INVISIBLE = "[" + chr(0x200B) + "-" + chr(0x200F) + chr(0x202A) + "-" + chr(0x202E) + chr(0x2060) + chr(0xFEFF) + "]"


def despaced(c: str) -> str:
    """Runs of three single letters and more, each with a separator after it, drawn together one after the other."""
    runs = f"regexp_extract_all({c}, '(?i)\\b(?:[a-z][\\s._*-]){{2,}}[a-z]\\b')"
    return f"list_reduce(list_prepend({c}, {runs}), lambda a, m: replace(a, m, regexp_replace(m, '[\\s._*-]', '', 'g')))"


def canonical(c: str) -> str:
    """Invisible characters out, single compatibility forms, look-alikes, leet, lower case."""
    a, b = derive.folding()
    folded = f"translate(regexp_replace({c}, '{_INVISIBLE}', '', 'g'), {fixtures.literal(a)}, {fixtures.literal(b)})"
    return f"lower(translate(lower(translate({folded}, {fixtures.literal(derive.look_alikes()[0])}, {fixtures.literal(derive.look_alikes()[1])})), '{K.LEET_FROM}', '{K.LEET_TO}'))"


ORACLE_SQL: dict[str, str] = {
    "canonical_forms": f"""
        WITH {_MESSAGES}
        SELECT doc_id, md5({_plain("content")}) AS plain, md5(translate(content, {fixtures.literal(derive.look_alikes()[0])}, {fixtures.literal(derive.look_alikes()[1])})) AS dehomoglyph,
               md5(translate(lower(content), '{K.LEET_FROM}', '{K.LEET_TO}')) AS deleet, md5({despaced(_plain("content"))}) AS despaced,
               CAST(CASE WHEN levenshtein(substr(content, 1, 12), substr(content, 3, 12)) > 5 THEN 6 ELSE levenshtein(substr(content, 1, 12), substr(content, 3, 12)) END AS INTEGER) AS distance,
               CAST(floor(floor(length(content) / 7.0::DOUBLE * 100 + 0.5::DOUBLE) / 100 * 100) AS BIGINT) AS rounded FROM messages""",
    "normal_forms": f"""
        WITH {_MESSAGES},
        chars AS (SELECT doc_id, content, unnest(string_split(content, '')) AS ch FROM messages),
        counted AS (SELECT doc_id, ch, count(*) AS n FROM chars WHERE ch <> '' GROUP BY doc_id, ch),
        sized AS (SELECT doc_id, sum(n) AS total FROM counted GROUP BY doc_id),
        entropies AS (SELECT c.doc_id, -sum(n::DOUBLE / total * log2(n::DOUBLE / total)) AS h FROM counted c JOIN sized s ON c.doc_id = s.doc_id GROUP BY c.doc_id)
        SELECT m.doc_id, md5({canonical(despaced("content"))}) AS canonical, round(e.h, 6) AS entropy,
               lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(m.content, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619::BIGINT) & 4294967295::BIGINT))), 8, '0') AS record_id
        FROM messages m JOIN entropies e ON m.doc_id = e.doc_id""",
    "flagship": f"""
        WITH {_PARTS},
        facts AS (
            SELECT *, translate(lower(regexp_replace(host, '^www\\.', '') || path || query), '{K.LEET_FROM}', '{K.LEET_TO}') AS canon, len(labels) - len(string_split(rd, '.')) AS extra,
                   CASE WHEN ends_with(rd, '.' || tld) THEN left(rd, length(rd) - length(tld) - 1) ELSE rd END AS label,
                   regexp_extract(lower(path), '\\.([a-z0-9]{{2,5}})$', 1) AS ext,
                   translate(CASE WHEN len(labels) > len(string_split(rd, '.')) THEN replace(array_to_string(labels[1:len(labels) - len(string_split(rd, '.'))], '.'), '.', '') ELSE '' END, '{K.LEET_FROM}-_', '{K.LEET_TO}') AS flat_sub FROM domains),
        hot AS (SELECT *, len(list_filter({_list(K.CREDENTIAL_PATH_WORDS)}, lambda w: contains(canon, w))) AS hots, translate(replace(label, '-', ''), '{K.LEET_FROM}', '{K.LEET_TO}') AS flat FROM facts),
        looks AS (
            SELECT page_id, max(CASE WHEN contains(h.flat, b.label) AND h.flat <> b.label THEN 3 WHEN contains(h.flat_sub, b.label) THEN 3
                                     WHEN levenshtein(h.flat, b.label) BETWEEN 1 AND b.most THEN 4 - levenshtein(h.flat, b.label) END) AS best FROM hot h CROSS JOIN (VALUES {_LABELS}) AS b(i, label, most) GROUP BY page_id),
        signals AS (
            SELECT page_id, 301 AS ord, 'url-no-https' AS id, 'url' AS category, 8 AS weight FROM hot WHERE scheme = 'http'
            UNION ALL SELECT page_id, 308, 'url-deep-subdomain', 'url', 12 FROM hot WHERE extra >= 3
            UNION ALL SELECT page_id, 309, 'url-many-subdomains', 'url', 6 FROM hot WHERE extra = 2 AND NOT list_contains({_list(K.TRUSTED_DOMAINS)}, rd)
            UNION ALL SELECT page_id, 312, 'url-suspicious-tld', 'domain', 14 FROM hot WHERE list_contains({_list(K.SUSPICIOUS_TLDS)}, tld)
            UNION ALL SELECT page_id, 319, 'url-credential-path', 'credential-theft', least(18, 7 + (hots - 1) * 4) FROM hot WHERE hots > 0 AND NOT list_contains({_list(K.OFFICIAL_DOMAINS)}, rd)
            UNION ALL SELECT page_id, 325, 'url-dangerous-file', 'url', CASE WHEN list_contains({_list(K.HIGH_RISK_EXTENSIONS)}, ext) THEN 24 ELSE 13 END FROM hot WHERE list_contains({_list(K.DANGEROUS_EXTENSIONS)}, ext)
            UNION ALL SELECT page_id, 327, 'url-official-domain', 'positive', -22 FROM hot WHERE list_contains({_list(K.OFFICIAL_DOMAINS)}, rd)
            UNION ALL SELECT page_id, 317, 'url-brand', 'domain', 22 FROM looks WHERE best IS NOT NULL),
        merged AS (SELECT * FROM signals UNION ALL SELECT page_id, 329, 'url-clean', 'positive', -6 FROM hot WHERE scheme = 'https' AND page_id NOT IN (SELECT page_id FROM signals)),
        {_scores("merged", "page_id")}
        SELECT h.page_id, regexp_replace(h.host, '^www\\.', '') AS host, h.rd, h.scheme, (SELECT string_agg(id, ',' ORDER BY id) FROM merged m WHERE m.page_id = h.page_id) AS signals,
               CAST(s.evidence AS BIGINT) AS evidence, CAST(s.score AS INTEGER) AS score, {_LEVEL} AS level
        FROM hot h JOIN scores s ON h.page_id = s.page_id""",
    "url_parse": f"""
        WITH {_PARTS}
        SELECT page_id, scheme, host, path, query, rd, tld, CASE WHEN ends_with(rd, '.' || tld) THEN left(rd, length(rd) - length(tld) - 1) ELSE rd END AS label,
               CASE WHEN array_to_string(labels, '.') = rd THEN '' ELSE left(array_to_string(labels, '.'), length(array_to_string(labels, '.')) - length(rd) - 1) END AS sub FROM domains""",
    "text_scalars": f"""
        WITH {_MESSAGES},
        letters AS (SELECT *, regexp_replace(content, '[^A-Za-z]', '', 'g') AS az FROM messages)
        SELECT doc_id, md5(trim(regexp_replace({_plain("content")}, '\\s+', ' ', 'g'))) AS squeezed,
               CASE WHEN length(az) < 12 THEN 0 ELSE CAST(floor(CAST(length(regexp_replace(az, '[^A-Z]', '', 'g')) AS DOUBLE) / length(az) * 1000 + 0.5) AS BIGINT) END AS upper,
               array_to_string(list_distinct_ordered, ',') AS emails,
               CAST((length(content) - length(replace(content, 'the', ''))) // 3 AS INTEGER) AS thes,
               md5(CASE WHEN length(content) <= 160 THEN content ELSE left(content, 159) || '…' END) AS preview,
               md5(regexp_extract('x {{a}} ' || content, '(?s)\\{{.*\\}}', 0)) AS json
        FROM (SELECT *, list_filter(list_transform(regexp_extract_all(content, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,24}}'), lambda x: lower(x)), lambda x, i: list_position(list_transform(regexp_extract_all(content, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,24}}'), lambda y: lower(y)), x) = i) AS list_distinct_ordered FROM letters)""",
    "message_statistics": f"""
        WITH {_MESSAGES}
        SELECT doc_id, CAST(length(content) AS INTEGER) AS characters, CAST(len(list_filter(string_split_regex({_plain("content")}, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words,
               CAST(len(regexp_extract_all(content, '(?i)https?://|www\\.')) AS INTEGER) AS links, CAST(len(regexp_extract_all(content, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,24}}')) AS INTEGER) AS emails,
               CAST(len(regexp_extract_all(content, '[0-9]')) AS INTEGER) AS digits, CAST(length(content) - length(replace(content, '!', '')) AS INTEGER) AS exclamations,
               floor(coalesce(length(regexp_replace(content, '[^A-Z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(content, '[^A-Za-z]', '', 'g')), 0), 0.0::DOUBLE) * 1000 + 0.5::DOUBLE) / 1000 AS caps_ratio FROM messages""",
    "visible_text": f"WITH {_SITES} SELECT page_id, md5({_HTML}) AS text_md5 FROM sites",
    "record_validation": """
        WITH given AS (
            SELECT conv_id, turn, role, text AS content FROM conversations
            UNION ALL SELECT conv_id, turn + 1000 * (i + 1), 'sms', t FROM conversations CROSS JOIN (VALUES (0, ''), (1, ' ' || chr(9) || chr(10)), (2, NULL)) AS odd(i, t))
        SELECT conv_id, turn, CASE WHEN role IN ('auto', 'message', 'email', 'sms', 'chat', 'whatsapp', 'social', 'url', 'website') THEN role ELSE 'auto' END AS type,
               CASE WHEN trim(regexp_replace(coalesce(content, ''), '\\s', ' ', 'g')) = '' THEN 'empty_input' WHEN length(content) > 200000 THEN 'input_too_large' END AS error,
               CAST(length(coalesce(content, '')) AS INTEGER) AS n FROM given""",
    "score_core": f"""
        WITH given AS (
            SELECT l_orderkey, l_linenumber, l_partkey, ['url', 'domain', 'sender', 'content', 'credential-theft', 'positive'][CAST(l_suppkey % 6 AS INTEGER) + 1] AS category, CAST(l_quantity AS INTEGER) % 31 AS q FROM lineitem),
        signals AS (
            SELECT l_orderkey, 's' || (l_partkey % 9) AS id, category, CASE WHEN category = 'positive' THEN -q ELSE q END AS weight,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 's' || (l_partkey % 9), category, CASE WHEN category = 'positive' THEN -q ELSE q END) AS ord FROM given),
        {_scores("signals", "l_orderkey")},
        firsts AS (SELECT l_orderkey, category, min(ord) AS first_ord FROM strongest WHERE weight > 0 GROUP BY l_orderkey, category),
        detail AS (
            SELECT k.l_orderkey, k.category, sum(k.weight) AS raw, least(sum(k.weight), {_CAPS.replace("category", "k.category")}) AS applied, count(*) AS n, min(f.first_ord) AS first_ord
            FROM strongest k JOIN firsts f ON k.l_orderkey = f.l_orderkey AND k.category = f.category WHERE k.weight > 0 GROUP BY k.l_orderkey, k.category),
        lists AS (SELECT l_orderkey, string_agg(category || ':' || raw || ':' || applied || ':' || n, ',' ORDER BY applied DESC, first_ord) AS by_category FROM detail GROUP BY l_orderkey),
        sure AS (
            SELECT *, CASE WHEN risky = 0 THEN 0.62::DOUBLE + least(0.14::DOUBLE, positives * 0.05::DOUBLE)
                           ELSE 0.5::DOUBLE + least(0.28::DOUBLE, categories * 0.07::DOUBLE) + least(0.2::DOUBLE, net::DOUBLE / 250) - CASE WHEN score BETWEEN 35 AND 62 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END END AS c,
                   CASE WHEN evidence >= 55 THEN 0.25::DOUBLE WHEN evidence >= 40 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM scores)
        SELECT s.l_orderkey, CAST(evidence AS BIGINT) AS evidence, CAST(risky AS BIGINT) AS risky, CAST(positives AS BIGINT) AS positives, CAST(categories AS BIGINT) AS categories, CAST(floor AS BIGINT) AS floor, factor AS damping_factor,
               trust::DOUBLE * factor AS damping, net::DOUBLE AS net, floor(curve * 10 + 0.5::DOUBLE) / 10 AS curve, score, {_LEVEL} AS level, floor(least(0.97::DOUBLE, greatest(0.35::DOUBLE, c)) * 100 + 0.5::DOUBLE) / 100 AS confidence,
               coalesce(by_category, '') AS by_category
        FROM sure s LEFT JOIN lists l ON s.l_orderkey = l.l_orderkey""",
    "model_signals": f"""
        WITH given AS (SELECT event_id, (event_id % 1001) / 1000.0::DOUBLE AS p, CAST(event_id % 101 AS DOUBLE) AS review, event_id % 97 AS base, CASE WHEN event_id % 5 = 0 THEN 60 END AS floor FROM events),
        fused AS (
            SELECT *, CASE WHEN event_id % 3 = 0 THEN base ELSE greatest(CAST(floor(base::DOUBLE * (1.0::DOUBLE - 0.35::DOUBLE) + review * 0.35::DOUBLE + 0.5::DOUBLE) AS BIGINT), coalesce(floor, 0)) END AS score FROM given)
        SELECT event_id, CASE WHEN p >= 0.6 THEN 'ml-message-high' WHEN p <= 0.35 THEN 'ml-message-low' ELSE 'ml-message-uncertain' END AS id,
               CAST(CASE WHEN p >= 0.6::DOUBLE THEN floor(26 * least(1.0, (p - 0.6::DOUBLE) / 0.35::DOUBLE + 0.45::DOUBLE) + 0.5) WHEN p <= 0.35::DOUBLE THEN -floor(least(12.0, (0.35::DOUBLE - p) * 30) + 0.5) ELSE 5 END AS BIGINT) AS model_weight,
               CAST(CASE WHEN review >= 65 THEN floor(least(22.0, 8 + (review - 65) * 0.4::DOUBLE) + 0.5) WHEN review <= 25 THEN -floor(least(10.0, (25 - review) * 0.4::DOUBLE) + 0.5) END AS BIGINT) AS review_weight,
               CAST(score AS BIGINT) AS fused_score, {_LEVEL} AS fused_level FROM fused""",
    "history_totals": f"""
        WITH {_EVENTS}
        SELECT count(*) AS analyses, count(*) FILTER (WHERE level = 'low') AS low, count(*) FILTER (WHERE level = 'medium') AS medium, count(*) FILTER (WHERE level = 'high') AS high,
               CAST(coalesce(floor(avg(score) + 0.5), 0) AS BIGINT) AS average_score, CAST(coalesce(floor(avg(duration_ms) + 0.5), 0) AS BIGINT) AS average_duration_ms FROM hist""",
    "history_by_type": f"WITH {_EVENTS} SELECT type, count(*) AS n FROM hist GROUP BY type",
    "history_trend": f"""
        WITH {_EVENTS}
        SELECT CAST(analyzed_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE level = 'high') AS high, count(*) FILTER (WHERE level = 'medium') AS medium, count(*) FILTER (WHERE level = 'low') AS low
        FROM hist GROUP BY 1 ORDER BY 1 DESC LIMIT 14""",
    "history_latest": f"WITH {_EVENTS} SELECT event_id, type, level, score FROM hist ORDER BY analyzed_at DESC, event_id LIMIT 500",
    "history_page": f"WITH {_EVENTS} SELECT event_id, type, score FROM hist WHERE level = 'high' ORDER BY analyzed_at DESC, event_id LIMIT 25 OFFSET 50",
    "history_top": f"WITH {_EVENTS}, items AS (SELECT unnest([type, level, type || '-' || level]) AS item FROM hist) SELECT item, count(*) AS n FROM items GROUP BY item ORDER BY n DESC, item LIMIT 8",
    "report_reputation": f"""
        WITH {_PARTS},
        reports AS (SELECT d.rd AS domain, e.user_id, e.ts FROM events e JOIN domains d ON e.event_id % (SELECT count(*) FROM pages) = d.page_id),
        counted AS (SELECT domain, count(*) AS reports, count(DISTINCT user_id) AS reporters, epoch_us(max(ts)) AS last_us FROM reports GROUP BY domain)
        SELECT *, CAST(CASE WHEN reports >= 5 THEN 30 WHEN reports >= 2 THEN 22 ELSE 12 END AS BIGINT) AS weight FROM counted""",
    "rate_limit": """
        WITH RECURSIVE starts AS (
            SELECT event_type, min(ts) AS began FROM events GROUP BY event_type
            UNION ALL SELECT s.event_type, (SELECT min(e.ts) FROM events e WHERE e.event_type = s.event_type AND e.ts >= s.began + INTERVAL 3600 SECOND) FROM starts s WHERE s.began IS NOT NULL),
        placed AS (SELECT e.event_id, e.event_type, e.ts, s.began FROM events e ASOF JOIN (SELECT * FROM starts WHERE began IS NOT NULL) s ON e.event_type = s.event_type AND e.ts >= s.began),
        numbered AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, began ORDER BY ts, event_id) AS n FROM placed)
        SELECT event_id, n, greatest(0, 2 - n) AS remaining, n > 2 AS limited FROM numbered""",
    "circuit_breaker": """
        WITH RECURSIVE given AS (SELECT event_id, user_id, ts, value > 40 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        calls(event_id, user_id, k, failures, opened, refused) AS (
            SELECT event_id, user_id, k, CAST(failed AS BIGINT), NULL::TIMESTAMP, false FROM given WHERE k = 1
            UNION ALL
            SELECT event_id, user_id, k, CASE WHEN shut THEN before WHEN failed THEN before + 1 ELSE 0 END, CASE WHEN NOT shut AND failed AND before + 1 >= 3 THEN ts ELSE opened END, shut
            FROM (SELECT g.*, c.opened, CASE WHEN c.failures >= 3 AND g.ts - c.opened > INTERVAL 86400 SECOND THEN 0 ELSE c.failures END AS before,
                         c.failures >= 3 AND g.ts - c.opened <= INTERVAL 86400 SECOND AS shut
                  FROM calls c JOIN given g ON g.user_id = c.user_id AND g.k = c.k + 1))
        SELECT event_id, failures, refused FROM calls""",
    "label_metrics": """
        WITH given AS (SELECT d.lang, l.quality AS t, CAST(d.n_chars > 900 AS INTEGER) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
        counted AS (
            SELECT lang, count(*) FILTER (WHERE t = 1 AND p = 1) AS tp, count(*) FILTER (WHERE t = 0 AND p = 1) AS fp, count(*) FILTER (WHERE t = 0 AND p = 0) AS tn, count(*) FILTER (WHERE t = 1 AND p = 0) AS fn FROM given GROUP BY lang),
        rated AS (
            SELECT *, floor(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0) * 10000 + 0.5) / 10000 AS accuracy, floor(coalesce(tp / nullif(tp + fp, 0), 0.0) * 10000 + 0.5) / 10000 AS precision,
                   floor(coalesce(tp / nullif(tp + fn, 0), 0.0) * 10000 + 0.5) / 10000 AS recall, floor(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) * 10000 + 0.5) / 10000 AS f1,
                   floor(coalesce(fp / nullif(fp + tn, 0), 0.0) * 10000 + 0.5) / 10000 AS fpr, floor(coalesce(fn / nullif(fn + tp, 0), 0.0) * 10000 + 0.5) / 10000 AS fnr FROM counted)
        SELECT *, accuracy > 0.9 AND fpr < 0.1 AS passed FROM rated""",
    "label_auc": """
        WITH given AS (SELECT l.quality AS t, d.n_chars AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
        ranked AS (SELECT t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM given)
        SELECT floor((sum(r) FILTER (WHERE t = 1) - count(*) FILTER (WHERE t = 1) * (count(*) FILTER (WHERE t = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE t = 1) * count(*) FILTER (WHERE t = 0)) * 10000 + 0.5) / 10000 AS auc FROM ranked""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT CAST(candidate AS DOUBLE) AS candidate, tp, fp, p, n FROM swept",
    "threshold_choice": f"""
        WITH {_SWEEP}, rated AS (SELECT candidate, tp / greatest(p, 1) AS recall, fp / greatest(n, 1) AS fpr FROM swept)
        SELECT coalesce(CAST(quantile_cont(candidate, 0.5) AS DOUBLE), 0.5) AS threshold FROM rated WHERE fpr <= 0.4 AND recall = (SELECT max(recall) FROM rated WHERE fpr <= 0.4)""",
    "latency_figures": f"WITH {_EVENTS} SELECT floor(avg(duration_ms) * 100 + 0.5) / 100 AS mean, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1] AS median, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, max(duration_ms) AS max FROM hist",
    "private_addresses": """
        WITH hosts AS (
            SELECT event_id, ['10', '172', '192', '8', '169', '100', '127', '224'][CAST(event_id % 8 AS INTEGER) + 1] AS a, CASE WHEN event_id % 3 = 0 THEN 168 ELSE event_id * 7 % 256 END AS b,
                   event_id * 11 % 256 AS c, event_id * 13 % 256 AS d FROM events)
        SELECT event_id, a || '.' || b || '.' || c || '.' || d AS host,
               a IN ('10', '127', '224') OR (a = '172' AND b BETWEEN 16 AND 31) OR (a = '192' AND b = 168) OR (a = '169' AND b = 254) OR (a = '100' AND b BETWEEN 64 AND 127) AS denied FROM hosts""",
}

from .oracles_signals import SIGNAL_SQL  # noqa: E402  it builds on what stands above

ORACLE_SQL |= SIGNAL_SQL
