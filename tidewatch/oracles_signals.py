"""SQL for the analyzers of texts and links, written apart from the DataFrame code.

Patterns are the fixed values of functions.knowledge, read by RE2 here.  Its two kinds of look-around are put into
other words: a verb after a negation is struck out before the pattern is tried, and what follows is matched too.
"""

from __future__ import annotations

import re

from . import fixtures
from .functions import derive
from .functions import knowledge as K
from .functions import knowledge_model as M
from .oracles import _HTML, _INVISIBLE, _MESSAGES, _SITES, _list, _plain, _scores, canonical, despaced

_lit = fixtures.literal
_GAP = "'" + "." * 100 + "' || chr(10)"


def _tried(pattern: str) -> str:
    """Whether the pattern is found in any of a text's forms, which stand one after the other in ``forms``."""
    held = "forms"
    while m := re.match(r"\(\?<!\\b([a-z ]+)\)", pattern):
        pattern = pattern[m.end() :]
        held = "spared"
    pattern = re.sub(r"\(\?=(.*?)\)$", r"(?:\1)", pattern)
    return f"regexp_matches({held}, {_lit('(?i)' + pattern)})"


_VERBS = next(re.search(r"\\b(\([a-z|? -]+\))", p).group(1) for _, _, _, _, _, ps in K.TACTICS for p in ps if p.startswith("(?<!"))
_SPARED = f"regexp_replace(forms, {_lit('(?i)' + chr(92) + 'b(not to |not |never |dont )' + _VERBS)}, '\\1_', 'g')"


def _ordered(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def registrable(host: str) -> str:
    labels = f"list_filter(string_split(regexp_replace({host}, '^www\\.', ''), '.'), lambda v: v <> '')"
    tail = lambda n: f"array_to_string({labels}[-{n}:], '.')"
    return f"CASE WHEN regexp_matches({host}, '^([0-9]+\\.){{3}}[0-9]+$') OR starts_with({host}, '[') THEN {host} WHEN len({labels}) <= 2 THEN array_to_string({labels}, '.') WHEN list_contains({_list(K.MULTI_PART_SUFFIXES)}, {tail(2)}) THEN {tail(3)} ELSE {tail(2)} END"


_SCAN = r"""(?i)\b((?:https?://|www\.)[^\s<>"'`)\]}]+|(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}(?:/[^\s<>"'`)\]}]*)?)"""
_LINKS = f"""linked AS (
        SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h0, '(?i)hxxp(s?)://', 'http\\1://', 'g'), '\\[\\s*\\.\\s*\\]', '.', 'g'), '\\(\\s*\\.\\s*\\)', '.', 'g'), '(?i)\\s+dot\\s+', '.', 'g') AS refanged FROM plain),
    scanned AS (SELECT *, list_transform(regexp_extract_all(refanged, {_lit(_SCAN)}, 1), lambda u: regexp_replace(u, {_lit("[.,;:!?'" + chr(34) + ")" + chr(92) + "]]+$")}, '')) AS found FROM linked),
    sorted AS (
        SELECT *, list_transform(list_filter(found, lambda u: regexp_matches(u, '(?i)^(https?://|www\\.|[a-z0-9-]+\\.[a-z]{{2,24}}([/:?#]|$))')),
                                 lambda u: CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'http://' || u END) AS links,
               list_filter(list_transform(regexp_extract_all(h0, '(?:\\+?\\d{{1,3}}[\\s-]?)?(?:\\(?\\d{{3,5}}\\)?[\\s-]?)?\\d{{5,10}}\\b'), lambda x: trim(x)), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 8) AS calls FROM scanned),
    facts AS (SELECT *, {_ordered("links")} AS urls, {_ordered("calls")} AS phones FROM sorted)"""
_PLAIN = f"{_MESSAGES}, plain AS (SELECT doc_id, content, {_plain('content')} AS h0 FROM messages)"
_HITS = ", ".join(f"{' + '.join(f'CAST({_tried(p)} AS INTEGER)' for p in patterns)} AS t{i}" for i, (*_, patterns) in enumerate(K.TACTICS))
_TACTICS = ", ".join(
    f"CASE WHEN t{i} > 0 THEN {{'id': '{name}', 'category': '{category}', 'hits': t{i}, 'weight': least({cap}, {weight} + least(t{i} - 1, 4) * {repeat})}} END"
    for i, (name, category, weight, repeat, cap, _) in enumerate(K.TACTICS)
)
_FORMS = f"""formed AS (SELECT *, {despaced("h0")} AS h1 FROM facts),
    folded AS (SELECT *, {canonical("h0")} AS h2, {canonical("h1")} AS h3 FROM formed),
    joined AS (SELECT *, h0 || CASE WHEN h1 <> h0 THEN {_GAP} || h1 ELSE '' END || {_GAP} || h2 || CASE WHEN h3 <> h2 THEN {_GAP} || h3 ELSE '' END AS forms FROM folded),
    sparing AS (SELECT *, {_SPARED} AS spared FROM joined),
    hit AS (SELECT *, {_HITS} FROM sparing),
    tactical AS (SELECT *, list_filter([{_TACTICS}], lambda x: x IS NOT NULL) AS tactics FROM hit)"""


def _named(keywords: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(' ' || h3 || ' ', {_lit('(?:^|[^a-z0-9])' + re.escape(derive.canonical(k)) + '(?:[^a-z0-9]|$)')})" for k in keywords)


_BRANDS = ", ".join(f"CASE WHEN {_named(keywords)} THEN {_list(derive.brand_sites()[name])} END" for name, keywords, _ in K.BRANDS)
_HOST = "regexp_extract(lower(u), '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_SHARE = r"\b(forward|share|send)\s+(this\s+)?(message\s+)?(to|with)\s+(\d+|as many|all your|your)\s*(friends|people|groups|contacts|whatsapp groups)?"
_CONTENT = (
    ("len(claimed) > 0 AND len(sites) > 0 AND len(list_filter(claimed, lambda c: NOT list_has_any(c, sites))) > 0", "content-brand-link-mismatch", "domain", 19),
    ("regexp_matches(h0, '(?i)\\b(?:[a-z][\\s._*-]){3,}[a-z]\\b')", "content-spaced-words", "content", 12),
    (f"len(list_filter(regexp_extract_all(h0, '(?i)\\b[a-z]{{2,}}[0134578@$][a-z]{{2,}}\\b'), lambda w: regexp_matches({canonical('w')}, 'acc0unt|passw0rd|verif|p4y|b4nk|s3cur|l0gin|updat3|w1n|fr33'))) > 0", "content-leetspeak", "content", 11),
    (f"regexp_matches(content, '{_INVISIBLE}')", "content-invisible-chars", "content", 13),
    ("regexp_matches(h0, '[\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}]') AND regexp_matches(h0, '[A-Za-z]')", "content-mixed-script", "content", 12),
    ("length(az) >= 12 AND length(regexp_replace(az, '[^A-Z]', '', 'g'))::DOUBLE / length(az) > 0.55::DOUBLE", "content-shouting", "content", 8),
    ("regexp_matches(h0, '[!?]{3,}') OR length(h0) - length(replace(h0, '!', '')) >= 4", "content-punctuation", "content", 5),
    ("len(phones) > 0 AND words < 90 AND len(tactics) >= 1", "content-callback-number", "social-engineering", 9),
    ("regexp_matches(h0, '(?i)\\b(?:wa\\.me|t\\.me|chat\\.whatsapp\\.com|api\\.whatsapp\\.com)\\b')", "content-messaging-link", "social-engineering", 12),
    (f"len(list_filter({_list(K.SENSITIVE_TOPICS)}, lambda t: contains(h3, t))) >= 2 AND len(tactics) >= 2", "content-sensitive-topic", "credential-theft", 10),
    ("words BETWEEN 1 AND 5 AND len(urls) >= 1", "content-bare-link", "content", 10),
    ("len(urls) >= 4", "content-many-links", "content", 5),
    (f"regexp_matches(h0, {_lit('(?i)' + _SHARE)}) OR regexp_matches(h0, '(?i)\\bre-?send this to\\b')", "content-chain-message", "social-engineering", 9),
    ("len(tactics) = 0 AND words >= 12", "content-neutral-tone", "positive", -12),
    (f"len(tactics) = 1 AND words >= 25 AND NOT list_contains({_list(K.STRONG_TACTICS)}, tactics[1].id)", "content-mild-tone", "positive", -6),
    ("regexp_matches(h0, '\\b\\d{4,8}\\b') AND regexp_matches(h0, '(?i)\\b(do not|don''?t|never)\\s+(share|disclose|reveal|tell|give)\\b') AND len(urls) = 0 AND words < 60", "content-transactional-code", "positive", -16),
    ("regexp_matches(h0, '(?i)\\b(unsubscribe|manage (your )?(email )?preferences|opt[-\\s]?out|view (this )?(email )?in (your )?browser|privacy policy)\\b')", "content-unsubscribe", "positive", -7),
)
_FOUND = ", ".join(f"CASE WHEN {when} THEN {{'id': '{name}', 'category': '{category}', 'weight': {weight}}} END" for when, name, category, weight in _CONTENT)

_URL_ROWS = f"""links AS (
        SELECT page_id, url FROM pages
        UNION ALL SELECT -p.page_id - 1, ov.link FROM pages p JOIN {fixtures.values(fixtures.URLS, "link")} ON p.page_id % {len(fixtures.URLS)} = ov.k),
    whole AS (SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*:') THEN trim(url) ELSE 'http://' || trim(url) END AS u FROM links),
    cut AS (
        SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z0-9+.-]+):', 1)) AS scheme, NOT regexp_matches(u, '^[A-Za-z0-9+.-]+://') AS opaque, regexp_extract(u, '^[^:]*://([^/?#]*)', 1) AS authority,
               regexp_extract(u, '^[^:]*:(?://[^/?#]*)?([^?#]*)', 1) AS path0, regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) AS query0, regexp_extract(u, '(#.*)$', 1) AS hash FROM whole),
    parsed AS (
        SELECT page_id, scheme, opaque, regexp_extract(authority, '^(.*)@', 1) AS userinfo, lower(regexp_extract(regexp_extract(authority, '([^@]*)$', 1), '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS p_host,
               CASE WHEN (scheme = 'http' AND ends_with(authority, ':80')) OR (scheme = 'https' AND ends_with(authority, ':443')) THEN '' ELSE regexp_extract(authority, ':([0-9]+)$', 1) END AS port,
               replace(CASE WHEN scheme IN ('http', 'https') AND path0 = '' THEN '/' ELSE path0 END, ' ', '%20') AS path, replace(CASE WHEN query0 = '?' THEN '' ELSE query0 END, ' ', '%20') AS query, hash FROM cut),
    addressed AS (
        SELECT *, scheme || CASE WHEN opaque THEN ':' ELSE '://' END || CASE WHEN userinfo = '' THEN '' ELSE userinfo || '@' END || p_host || CASE WHEN port = '' THEN '' ELSE ':' || port END || path || query || hash AS href,
               regexp_replace(regexp_replace(p_host, '\\.$', ''), '^www\\.', '') AS host FROM parsed),
    sited AS (SELECT *, {registrable("host")} AS rd, list_filter(string_split(host, '.'), lambda v: v <> '') AS labels FROM addressed),
    suffixed AS (SELECT *, CASE WHEN len(string_split(rd, '.')) >= 3 AND list_contains({_list(K.MULTI_PART_SUFFIXES)}, array_to_string(string_split(rd, '.')[-2:], '.')) THEN array_to_string(string_split(rd, '.')[-2:], '.') ELSE string_split(rd, '.')[-1] END AS tld FROM sited),
    split AS (
        SELECT *, CASE WHEN ends_with(rd, '.' || tld) THEN left(rd, length(rd) - length(tld) - 1) ELSE rd END AS label, CASE WHEN host = rd THEN '' ELSE left(host, length(host) - length(rd) - 1) END AS sub,
               url_decode(path) AS plain_path, list_contains({_list(K.OFFICIAL_DOMAINS)}, rd) AS official, list_contains({_list(K.TRUSTED_DOMAINS)}, rd) AS trusted,
               list_transform(list_filter(string_split(regexp_replace(query, '^\\?', ''), '&'), lambda p: p <> ''), lambda p: {{'key': lower(url_decode(regexp_extract(p, '^([^=]*)', 1))), 'value': url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))}}) AS params FROM suffixed),
    measured AS (
        SELECT *, regexp_replace({canonical("label")}, '[-_.]', '', 'g') AS flat, regexp_replace({canonical("sub")}, '[-_.]', '', 'g') AS flat_sub, {canonical("host || plain_path || query")} AS whole_text,
               greatest(0, len(labels) - len(string_split(rd, '.'))) AS extra, length(label) - length(replace(label, '-', '')) AS hyphens, regexp_replace(label, '[^a-z0-9]', '', 'g') AS letters,
               regexp_extract(lower(plain_path), '\\.([a-z0-9]{{2,5}})(?:$|[?#])', 1) AS ext, len(regexp_extract_all(href, '(?i)%[0-9a-f]{{2}}')) AS escapes FROM split),
    looks AS (
        SELECT m.page_id, b.i, CASE WHEN contains(m.flat, b.label) AND m.flat <> b.label THEN 'embedded' WHEN contains(m.flat_sub, b.label) THEN 'subdomain' WHEN levenshtein(m.flat, b.label) BETWEEN 1 AND b.most THEN 'typosquat' END AS kind,
               levenshtein(m.flat, b.label) AS d FROM measured m CROSS JOIN (VALUES {", ".join(f"({i}, {_lit(x)}, {m})" for i, (_, _, x, m) in enumerate(derive.brand_labels()))}) AS b(i, label, most) WHERE NOT m.official),
    likest AS (SELECT page_id, arg_min({{'kind': kind, 'd': d}}, (-s, i)) AS look FROM (SELECT *, CASE WHEN kind = 'typosquat' THEN 4 - d ELSE 3 END AS s FROM looks WHERE kind IS NOT NULL) GROUP BY page_id),
    told AS (SELECT m.*, l.look.kind AS kind, l.look.d AS d, len(list_filter({_list(K.CREDENTIAL_PATH_WORDS)}, lambda w: contains(whole_text, w))) AS hots FROM measured m LEFT JOIN likest l ON m.page_id = l.page_id)"""
_URL_SIGNALS = (
    ("scheme = 'http'", "url-no-https", "url", 8),
    ("scheme NOT IN ('http', 'https')", "url-odd-scheme", "url", 14),
    ("port NOT IN ('', '80', '443')", "url-nonstandard-port", "url", 7),
    ("regexp_matches(host, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$') OR regexp_matches(host, '^\\[[0-9a-f:]+\\]$')", "url-ip-host", "url", 20),
    ("regexp_matches(p_host, '[^\\x00-\\x7f]') OR regexp_matches(p_host, '(^|\\.)xn--')", "url-homograph", "domain", 15),
    ("userinfo <> '' OR regexp_matches(regexp_replace(href, '^https?://', ''), '^[^/]*@')", "url-userinfo", "url", 22),
    (f"list_contains({_list(K.URL_SHORTENERS)}, rd) OR list_contains({_list(K.URL_SHORTENERS)}, host)", "url-shortener", "url", 16),
    ("extra >= 3", "url-deep-subdomain", "url", 12),
    ("extra = 2 AND NOT trusted", "url-many-subdomains", "url", 6),
    ("hyphens >= 3", "url-hyphen-spam", "domain", 11),
    ("hyphens = 2 AND NOT trusted", "url-hyphens", "domain", 5),
    (f"list_contains({_list(K.SUSPICIOUS_TLDS)}, tld)", "url-suspicious-tld", "domain", 14),
    (f"len(list_filter({_list(K.FREE_HOSTING_HOSTS)}, lambda f: host = f OR ends_with(host, '.' || f))) > 0", "url-free-hosting", "domain", 12),
    ("length(label) >= 25", "url-long-domain", "domain", 7),
    ("length(label) >= 8 AND list_aggregate(string_split(letters, ''), 'entropy') > 3.6::DOUBLE", "url-random-domain", "domain", 10),
    ("regexp_matches(label, '[0-9]{4,}')", "url-digit-run", "domain", 6),
    ("kind = 'typosquat'", "url-brand-typosquat", "domain", "CASE WHEN d = 1 THEN 26 ELSE 21 END"),
    ("kind = 'embedded'", "url-brand-embedded", "domain", 22),
    ("kind = 'subdomain'", "url-brand-subdomain", "domain", 24),
    ("hots > 0 AND NOT official", "url-credential-path", "credential-theft", "least(18, 7 + (hots - 1) * 4)"),
    ("escapes >= 6", "url-heavy-encoding", "url", 10),
    ("contains(href, '%25')", "url-double-encoding", "url", 12),
    (f"len(list_filter(params, lambda q: list_contains({_list(K.REDIRECT_PARAMS)}, q.key) AND regexp_matches(q.value, '(?i)https?%3a|https?://'))) > 0", "url-open-redirect", "url", 15),
    (f"len(list_filter(params, lambda q: list_contains({_list(K.IDENTITY_PARAMS)}, q.key))) > 0", "url-identity-params", "credential-theft", 13),
    ("regexp_matches(query, '[?&](?:[a-z0-9_-]{1,12}=)?[A-Za-z0-9+/]{40,}={0,2}(?:&|$)')", "url-encoded-blob", "url", 8),
    (f"list_contains({_list(K.DANGEROUS_EXTENSIONS)}, ext)", "url-dangerous-file", "url", f"CASE WHEN list_contains({_list(K.HIGH_RISK_EXTENSIONS)}, ext) THEN 24 ELSE 13 END"),
    ("length(href) > 130", "url-very-long", "url", 6),
    ("official", "url-official-domain", "positive", -22),
    ("trusted AND NOT official", "url-trusted-domain", "positive", -16),
)
_URL_FOUND = ", ".join(f"CASE WHEN {when} THEN {{'id': '{name}', 'category': '{category}', 'weight': CAST({weight} AS INTEGER)}} END" for when, name, category, weight in _URL_SIGNALS)

SIGNAL_SQL: dict[str, str] = {
    "link_extraction": f"WITH {_PLAIN}, {_LINKS} SELECT doc_id, array_to_string(urls, ' ') AS urls, array_to_string(phones, '|') AS phones FROM facts",
    "tactic_table": f"""
        WITH {_PLAIN}, {_LINKS}, {_FORMS}, laid AS (SELECT doc_id, unnest(tactics) AS t FROM tactical)
        SELECT doc_id, t.id AS id, t.category AS category, t.hits AS hits, CAST(t.weight AS INTEGER) AS weight FROM laid""",
    "text_signal_table": f"""
        WITH {_PLAIN}, {_LINKS}, {_FORMS},
        counted AS (
            SELECT *, len(list_filter(string_split_regex(h3, '\\s+'), lambda w: w <> '')) AS words, regexp_replace(h0, '[^A-Za-z]', '', 'g') AS az,
                   list_filter(list_transform(list_transform(urls, lambda u: {_HOST}), lambda h: {registrable("h")}), lambda s: s <> '') AS sites, list_filter([{_BRANDS}], lambda b: b IS NOT NULL) AS claimed FROM tactical),
        found AS (SELECT doc_id, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS f, tactics FROM counted),
        laid AS (
            SELECT doc_id, t.id AS id, t.category AS category, t.weight AS weight FROM (SELECT doc_id, unnest(f) AS t FROM found)
            UNION ALL SELECT doc_id, 'tactic-' || t.id, t.category, t.weight FROM (SELECT doc_id, unnest(tactics) AS t FROM found))
        SELECT doc_id, id, category, CAST(weight AS INTEGER) AS weight FROM laid""",
    "url_signal_table": f"""
        WITH {_URL_ROWS},
        found AS (
            SELECT page_id, scheme, trusted, CASE WHEN scheme IN ('http', 'https') AND (p_host = '' OR regexp_matches(p_host, '[\\s<>^|%"`{{}}]')) THEN [{{'id': 'url-unparseable', 'category': 'url', 'weight': CAST(6 AS INTEGER)}}]
                                                  ELSE list_filter([{_URL_FOUND}], lambda x: x IS NOT NULL) END AS f FROM told),
        complete AS (SELECT page_id, CASE WHEN len(f) = 0 AND scheme = 'https' AND NOT trusted THEN [{{'id': 'url-clean', 'category': 'positive', 'weight': CAST(-6 AS INTEGER)}}] ELSE f END AS f FROM found),
        weighed AS (SELECT page_id, CASE WHEN len(list_filter(f, lambda x: x.weight >= 14)) > 0 THEN list_filter(f, lambda x: x.category <> 'positive') ELSE f END AS f FROM complete),
        laid AS (SELECT page_id, unnest(f) AS t FROM weighed)
        SELECT page_id, t.id AS id, t.category AS category, t.weight AS weight FROM laid""",
    "message_types": f"""
        WITH {_PLAIN}, bodies AS (SELECT doc_id, regexp_replace(h0, '^\\s+|\\s+$', '', 'g') AS b FROM plain),
        kinds AS (
            SELECT doc_id, CASE WHEN b = '' THEN 'message'
                                WHEN regexp_matches(b, '(?i)^<(?:!doctype|html|head|body)\\b') OR (regexp_matches(b, '(?i)<html[\\s>]') AND regexp_matches(b, '(?i)</html>')) THEN 'website'
                                WHEN regexp_matches(left(b, 1500), '(?im)^(?:from|to|subject|date|received|return-path|reply-to|message-id|authentication-results)\\s*:') THEN 'email'
                                WHEN NOT regexp_matches(b, '\\s') AND regexp_matches(b, '(?i)^(?:https?://|www\\.)|^[a-z0-9-]+(?:\\.[a-z0-9-]+)+(?:[/:?#]|$)') THEN 'url'
                                WHEN len(string_split_regex(b, '\\s+')) <= 45 THEN 'sms' ELSE 'message' END AS kind FROM bodies)
        SELECT doc_id, kind, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CHANNELS.items())} ELSE 'message' END AS channel FROM kinds""",
}


def _taken(text: str, chars: str) -> str:
    """How many of the text's characters are among chars."""
    return f"(length({text}) - length(translate({text}, {_lit(chars)}, '')))"


def _named_in(text: str) -> str:
    return f"NOT official AND len(list_filter({_LABELS}, lambda b: contains({text}, b))) > 0"


_LABELS = _list([x for x in M.BRAND_LABELS if len(x) >= 4])
_ENTROPY = "coalesce(round(list_aggregate(list_filter(string_split({0}, ''), lambda x: x <> ''), 'entropy'), 4), 0)"
_FEATURES = {
    "url_length": "length(cand)", "host_length": "length(host)", "path_length": "length(path)", "query_length": "length(query)", "label_length": "length(label)", "num_dots_host": _taken("host", "."), "num_hyphens_host": _taken("host", "-"),
    "num_subdomains": f"CASE WHEN sub = '' THEN 0 ELSE {_taken('sub', '.')} + 1 END", "num_path_segments": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))", "num_params": "len(pairs)",
    "num_digits_host": "length(regexp_replace(host, '[^0-9]', '', 'g'))", "digit_ratio_host": "CASE WHEN host = '' THEN 0 ELSE round(length(regexp_replace(host, '[^0-9]', '', 'g'))::DOUBLE / length(host), 4) END",
    "num_digits_url": "length(regexp_replace(cand, '[^0-9]', '', 'g'))", "count_at": f"{_taken('netloc', '@')} + {_taken('path', '@')}", "count_percent": _taken("cand", "%"), "count_equals": _taken("cand", "="), "count_ampersand": _taken("cand", "&"),
    "count_underscore": _taken("cand", "_"), "num_special_chars": _taken("cand", "@%=&~+,;$!*'()"), "is_https": "scheme = 'https'", "has_port": "port NOT IN ('', '0', '80', '443')", "is_ip_host": "regexp_matches(host, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$')",
    "has_punycode": "contains(host, 'xn--')", "non_ascii_count": "length(regexp_replace(host, '[\\x00-\\x7f]', '', 'g'))", "host_entropy": _ENTROPY.format("host"), "path_entropy": _ENTROPY.format("path"),
    "tld_suspicious": f"list_contains({_list(M.SUSPICIOUS_TLDS)}, suffix)", "tld_common": f"list_contains({_list(M.COMMON_TLDS)}, suffix)", "tld_length": "length(suffix)",
    "is_shortener": f"list_contains({_list(M.URL_SHORTENERS)}, rd) OR list_contains({_list(M.URL_SHORTENERS)}, host)", "is_free_hosting": f"len(list_filter({_list(M.FREE_HOSTING_SUFFIXES)}, lambda s: host = s OR ends_with(host, '.' || s))) > 0",
    "is_official_domain": "official", "brand_in_label": _named_in("flat"), "brand_in_subdomain": _named_in("flat_sub"), "brand_in_path": _named_in("pq"), "nearest_brand_distance": "distance", "typosquat_flag": "NOT official AND distance BETWEEN 1 AND 2",
    "credential_word_count": f"len(list_filter({_list(M.CREDENTIAL_URL_WORDS)}, lambda w: contains(pq, w) OR contains(host, w)))", "credential_word_in_host": f"len(list_filter({_list(M.CREDENTIAL_URL_WORDS)}, lambda w: contains(host, w))) > 0",
    "has_redirect_param": f"list_has_any(keys, {_list(M.REDIRECT_PARAMS)}) AND regexp_matches(query, '(?i)https?(?::|%3a)')", "has_identity_param": f"list_has_any(keys, {_list(M.IDENTITY_PARAMS)})",
    "has_executable_ext": f"list_contains({_list(M.EXECUTABLE_EXTENSIONS)}, ext)", "has_archive_or_html_ext": f"list_contains({_list(M.ARCHIVE_WEB_EXTENSIONS)}, ext)",
    "has_base64_blob": "regexp_matches(CASE WHEN query <> '' THEN query ELSE path END, '[A-Za-z0-9+/]{32,}={0,2}')", "num_encoded_chars": "len(regexp_extract_all(cand, '%[0-9A-Fa-f]{2}'))",
    "longest_token_length": "list_max(list_transform(string_split_regex(lower(cand), '[^A-Za-z0-9]+'), lambda t: length(t)))", "vowel_ratio_label": "CASE WHEN flat = '' THEN 0 ELSE round(length(regexp_replace(flat, '[^aeiou]', '', 'g'))::DOUBLE / length(flat), 4) END",
    "max_consonant_run": "coalesce(list_max(list_transform(regexp_extract_all(flat, '[b-df-hj-np-tv-z]+'), lambda r: length(r))), 0)", "has_www": "starts_with(host, 'www.')", "double_slash_in_path": "contains(path, '//')",
    "hyphen_ratio_label": f"CASE WHEN label = '' THEN 0 ELSE round({_taken('label', '-')}::DOUBLE / length(label), 4) END",
}
_BARE = "list_filter(string_split(regexp_replace(regexp_replace(trim(host), '\\.+$', ''), '^www\\.', ''), '.'), lambda v: v <> '')"
SIGNAL_SQL["url_model_features"] = f"""
    WITH given AS (SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^[a-z][a-z0-9+.-]*://') THEN trim(url) ELSE 'http://' || trim(url) END AS cand FROM pages),
    cut AS (
        SELECT page_id, cand, lower(regexp_extract(cand, '^([^:]*)://', 1)) AS scheme, regexp_extract(cand, '^[^:]*://([^/?#]*)', 1) AS netloc, regexp_extract(cand, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(cand, '^[^?#]*\\?([^#]*)', 1) AS query FROM given),
    hosted AS (SELECT *, lower(regexp_extract(regexp_extract(netloc, '([^@]*)$', 1), '^([^:]*)', 1)) AS host, regexp_extract(netloc, ':([0-9]+)$', 1) AS port, list_filter(string_split(query, '&'), lambda p: p <> '') AS pairs FROM cut),
    labelled AS (SELECT *, {_BARE} AS v FROM hosted),
    sited AS (SELECT *, CASE WHEN len(v) <= 2 THEN array_to_string(v, '.') WHEN list_contains({_list(M.MULTI_PART_SUFFIXES)}, array_to_string(v[-2:], '.')) THEN array_to_string(v[-3:], '.') ELSE array_to_string(v[-2:], '.') END AS rd FROM labelled),
    ended AS (SELECT *, CASE WHEN len(string_split(rd, '.')) >= 3 AND list_contains({_list(M.MULTI_PART_SUFFIXES)}, array_to_string(string_split(rd, '.')[-2:], '.')) THEN array_to_string(string_split(rd, '.')[-2:], '.') ELSE string_split(rd, '.')[-1] END AS suffix FROM sited),
    split AS (
        SELECT *, CASE WHEN suffix <> '' AND ends_with(rd, '.' || suffix) THEN left(rd, length(rd) - length(suffix) - 1) ELSE rd END AS label, CASE WHEN rd <> '' AND ends_with(host, rd) AND host <> rd THEN left(host, greatest(0, length(host) - length(rd) - 1)) ELSE '' END AS sub,
               list_contains({_list(M.OFFICIAL_DOMAINS)}, rd) AS official, lower(path || '?' || query) AS pq, list_transform(pairs, lambda p: lower(url_decode(regexp_extract(p, '^([^=]*)', 1)))) AS keys,
               lower(regexp_extract(path, '\\.([A-Za-z0-9]{{2,5}})(?:$|[?#])', 1)) AS ext FROM ended),
    flattened AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS flat, regexp_replace(sub, '[^a-z0-9]', '', 'g') AS flat_sub FROM split),
    near AS (SELECT *, CASE WHEN flat = '' THEN 4 ELSE least(4, list_min(list_transform({_LABELS}, lambda b: levenshtein(flat, b)))) END AS distance FROM flattened)
    SELECT page_id, {", ".join(f"CAST({_FEATURES[n]} AS DOUBLE) AS {n}" for n in M.URL_FEATURES)} FROM near"""


def _header(name: str) -> str:
    return f"nullif(trim(regexp_extract(head, '(?im)^{name}:(.*)$', 1)), '')"


_ANGLED = r"^(.*?)<\s*([^>]+?)\s*>$"


def _mailbox(value: str) -> str:
    return f"lower(trim(CASE WHEN regexp_matches({value}, {_lit(_ANGLED)}) THEN regexp_extract({value}, {_lit(_ANGLED)}, 2) ELSE {value} END))"


def _domain(mailbox: str) -> str:
    return f"CASE WHEN contains({mailbox}, '@') THEN regexp_extract({mailbox}, '([^@]*)$', 1) ELSE '' END"


def _spoken(keywords: tuple[str, ...]) -> str:
    words = "|".join(re.escape(k) for k in (derive.canonical(x).strip() for x in keywords) if len(k) >= 3)
    return f"regexp_matches(plain_name, {_lit(f'(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)')})"


_NAMED = ", ".join(f"CASE WHEN {_spoken(keywords)} THEN {_list(derive.brand_sites()[name])} END" for name, keywords, _ in K.BRANDS)
_MARKS = ", ".join(f"{{'label': {_lit(x)}, 'most': {m}}}" for _, _, x, m in derive.brand_labels())
_VERDICT = "pass|fail|softfail|neutral|none|permerror|temperror|bestguesspass"
_SENDER = (
    ("spoken IS NOT NULL AND NOT list_contains(spoken, rd)", "sender-display-spoof", "sender", 24),
    (f"name <> '' AND regexp_matches(name, '(?i)\\b(ceo|cfo|md|director|manager|hr|principal|dean|accounts?|finance|payroll)\\b') AND list_contains({_list(K.FREE_MAIL_DOMAINS)}, rd)", "sender-exec-freemail", "bec", 22),
    ("reply <> '' AND reply_domain <> '' AND reply_rd <> rd", "sender-replyto-mismatch", "sender", 21),
    ("path_domain <> '' AND path_rd <> rd AND reply = ''", "sender-returnpath-mismatch", "sender", 12),
    ("stated <> '' AND len(failed) > 0", "sender-auth-fail", "sender", "CASE WHEN list_contains(failed, 'dmarc') THEN 26 ELSE 20 END"),
    ("stated <> '' AND len(failed) = 0 AND spf = 'pass' AND (dkim = 'pass' OR dmarc = 'pass')", "sender-auth-pass", "positive", -14),
    ("like_kind <> ''", "sender-lookalike-domain", "sender", "CASE WHEN like_kind = 'typosquat' THEN 26 ELSE 22 END"),
    (f"list_contains({_list(K.DISPOSABLE_MAIL_DOMAINS)}, rd)", "sender-disposable", "sender", 22),
    (f"rd <> '' AND list_contains({_list(K.SUSPICIOUS_TLDS)}, tld)", "sender-suspicious-tld", "sender", 13),
    ("len(claimed) > 0 AND list_contains(claimed[1], rd)", "sender-brand-verified", "positive", -20),
    (f"len(claimed) > 0 AND NOT list_contains(claimed[1], rd) AND list_contains({_list(K.FREE_MAIL_DOMAINS)}, rd)", "sender-brand-freemail", "sender", 22),
    (f"len(claimed) > 0 AND NOT list_contains(claimed[1], rd) AND NOT list_contains({_list(K.FREE_MAIL_DOMAINS)}, rd)", "sender-brand-mismatch", "sender", 18),
    (f"len(claimed) = 0 AND like_kind = '' AND list_contains({_list(K.TRUSTED_DOMAINS)}, rd)", "sender-trusted-domain", "positive", -12),
    ("regexp_matches(mailer, '(?i)\\b(php ?mailer|swiftmailer|sendblaster|mass ?mailer|bulk|turbo-?smtp)\\b')", "sender-bulk-mailer", "sender", 10),
    ("regexp_matches(subject, '(?i)^(?:re|fwd?)\\s*:') AND refs IS NULL AND irt IS NULL", "sender-fake-thread", "sender", 14),
    ("regexp_matches(receiver, '(?i)undisclosed[-\\s]?recipients?')", "sender-hidden-recipients", "sender", 9),
)
_SENT = ", ".join(f"CASE WHEN {when} THEN {{'id': '{name}', 'category': '{category}', 'weight': CAST({weight} AS INTEGER)}} END" for when, name, category, weight in _SENDER)
SIGNAL_SQL["sender_signal_table"] = f"""
    WITH heads AS (SELECT d.doc_id, regexp_replace(ov.head, '\\n[ \\t]+', ' ', 'g') AS head FROM documents d JOIN {fixtures.values(fixtures.MAILS, "head")} ON d.doc_id % {len(fixtures.MAILS)} = ov.k),
    fields AS (
        SELECT *, coalesce({_header("from")}, '') AS sender0, coalesce({_header("reply-to")}, '') AS reply0, coalesce({_header("return-path")}, '') AS path0, {_header("subject")} AS subject, {_header("x-mailer")} AS mailer, {_header("to")} AS receiver,
               {_header("references")} AS refs, {_header("in-reply-to")} AS irt, lower(coalesce({_header("authentication-results")}, '')) AS stated FROM heads),
    boxes AS (SELECT *, {_mailbox("sender0")} AS sender, {_mailbox("reply0")} AS reply, {_mailbox("path0")} AS path, trim(regexp_replace(trim(regexp_extract(sender0, {_lit(_ANGLED)}, 1)), '^["'']|["'']$', '', 'g')) AS name FROM fields),
    domains AS (SELECT *, {_domain("sender")} AS domain, {_domain("reply")} AS reply_domain, {_domain("path")} AS path_domain FROM boxes),
    sited AS (SELECT *, {registrable("domain")} AS rd, {registrable("reply_domain")} AS reply_rd, {registrable("path_domain")} AS path_rd FROM domains),
    ended AS (SELECT *, CASE WHEN list_contains({_list(K.MULTI_PART_SUFFIXES)}, array_to_string(string_split(rd, '.')[-2:], '.')) AND len(string_split(rd, '.')) >= 3 THEN array_to_string(string_split(rd, '.')[-2:], '.') ELSE string_split(rd, '.')[-1] END AS tld FROM sited),
    said AS (
        SELECT *, CASE WHEN ends_with(rd, '.' || tld) THEN left(rd, length(rd) - length(tld) - 1) ELSE rd END AS label, {canonical("name")} AS plain_name, {canonical(despaced("concat_ws(' ', subject, " + _header("from") + ")"))} AS h3,
               regexp_extract(stated, 'spf\\s*=\\s*({_VERDICT})', 1) AS spf, regexp_extract(stated, 'dkim\\s*=\\s*({_VERDICT})', 1) AS dkim, regexp_extract(stated, 'dmarc\\s*=\\s*({_VERDICT})', 1) AS dmarc FROM ended),
    flattened AS (SELECT *, regexp_replace({canonical("label")}, '[-_.]', '', 'g') AS flat, list_filter([{_BRANDS}], lambda b: b IS NOT NULL) AS claimed, CASE WHEN name <> '' THEN list_filter([{_NAMED}], lambda b: b IS NOT NULL)[1] END AS spoken FROM said),
    told AS (
        SELECT *, list_filter([CASE WHEN spf IN ('fail', 'softfail', 'permerror') THEN 'spf' END, CASE WHEN dkim IN ('fail', 'softfail', 'permerror') THEN 'dkim' END, CASE WHEN dmarc IN ('fail', 'softfail', 'permerror') THEN 'dmarc' END], lambda x: x IS NOT NULL) AS failed,
               coalesce(CASE WHEN rd <> '' AND NOT list_contains({_list(K.OFFICIAL_DOMAINS)}, rd)
                             THEN list_filter(list_transform([{_MARKS}], lambda t: CASE WHEN contains(flat, t.label) AND flat <> t.label THEN 'embedded' WHEN levenshtein(flat, t.label) BETWEEN 1 AND t.most THEN 'typosquat' END), lambda x: x IS NOT NULL)[1] END, '') AS like_kind FROM flattened),
    found AS (SELECT doc_id, list_filter([{_SENT}], lambda x: x IS NOT NULL) AS f FROM told WHERE sender <> ''),
    laid AS (SELECT doc_id, unnest(f) AS t FROM found)
    SELECT doc_id, t.id AS id, t.category AS category, t.weight AS weight FROM laid"""


def _attribute(tag: str, name: str) -> str:
    pattern = _lit(rf"""(?i){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
    return f"CASE WHEN regexp_matches({tag}, {pattern}) THEN trim(regexp_extract({tag}, {pattern}, 1) || regexp_extract({tag}, {pattern}, 2) || regexp_extract({tag}, {pattern}, 3)) END"


def _inputs(html: str) -> str:
    tag = f"lower(coalesce(nullif({_attribute('t', 'type')}, ''), 'text'))"
    name = f"lower(coalesce(nullif({_attribute('t', 'name')}, ''), {_attribute('t', 'id')}, ''))"
    return f"list_transform(regexp_extract_all({html}, '(?i)<input\\b[^>]*>'), lambda t: {{'type': {tag}, 'name': {name}}})"


def _absolute(href: str) -> str:
    """The address that a non-empty href stands for on the page."""
    return (
        f"CASE WHEN {href} IS NULL OR {href} = '' THEN NULL WHEN regexp_matches({href}, '(?i)^[a-z][a-z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN scheme || ':' || {href} WHEN starts_with({href}, '/') THEN root || {href} "
        f"WHEN starts_with({href}, '#') THEN url || {href} WHEN starts_with({href}, '?') THEN root || path || {href} ELSE root || regexp_replace(path, '[^/]*$', '') || {href} END"
    )


_HOST_OF = lambda u: f"lower(regexp_extract({u}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_ANCHOR = _lit(r"""(?i)<a\b[^>]*href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)[^>]*>([\s\S]*?)</a>""")
_SECRET = "(i.type = 'password' OR regexp_matches(i.name, '" + "|".join(K.CREDENTIAL_FIELD_NAMES) + "'))"
_LIKENESS = ", ".join(
    f"CASE WHEN (len(list_filter({_list([derive.canonical(k).strip() for k in ks])}, lambda w: contains(plain_title, w))) > 0 OR len(list_filter({_list([derive.canonical(k).strip() for k in ks])}, lambda w: contains(plain_body, w))) >= 2) "
    f"AND NOT list_contains({_list(derive.brand_sites()[name])}, rd) THEN {{'in_title': len(list_filter({_list([derive.canonical(k).strip() for k in ks])}, lambda w: contains(plain_title, w))) > 0}} END"
    for name, ks, _ in K.BRANDS
)
_ENTER = r"(?i)\b(sign in|log ?in|login|username|password|continue to your account|account login|net ?banking|internet banking|user id)\b"
_TAKEN_TO = r"(?i)(?:formspree|jotform|getform|sheetdb|script\.google\.com|api\.telegram\.org|discord(?:app)?\.com/api/webhooks|pipedream|requestbin|webhook\.site|ngrok)"
_ALARMING = r"(?i)\b(your (account|session) (has been|is) (locked|suspended|limited|disabled)|verify (your )?(identity|account) (now|immediately)|unusual (sign[-\s]?in|activity) detected|re-?confirm your (details|information))\b"
_LEGAL = r"(?i)\b(privacy policy|terms of (use|service)|about us|contact us|customer care|helpline)\b"
_NO_MENU = r"""(?i)document\.addEventListener\s*\(\s*['"]contextmenu['"][\s\S]{0,80}preventDefault|oncontextmenu\s*=\s*["']?return false"""
_NO_PASTE = r"(?i)\b(?:on)?(?:paste|copy)\b[\s\S]{0,60}preventDefault"
_SENT_OUT = r"(?i)\b(?:api\.telegram\.org|sendMessage\?chat_id|discord(?:app)?\.com/api/webhooks)\b"
_MOVED = r"""(?i)window\.(?:location|open)\s*=?\s*\(?['"]https?://"""
_SECRET_CODE = r"(?i)\b(enter (your )?(otp|one[-\s]?time password)|otp sent to your (mobile|registered))\b"
_any = lambda items, test: f"len(list_filter({items}, {test})) > 0"
_PAGE = (
    ("login", "page-login-form", "page", 6),
    ("login AND scheme <> 'https'", "page-insecure-login", "credential-theft", 26),
    (_any("secret_forms", "lambda f: f.action IS NULL OR regexp_matches(f.action, '(?i)^#|^javascript:')"), "page-form-script-handler", "page", 9),
    (_any("secret_forms", "lambda f: f.host <> '' AND f.site <> rd"), "page-cross-domain-post", "credential-theft", 28),
    ("scheme = 'https' AND " + _any("secret_forms", "lambda f: starts_with(lower(f.target), 'http://')"), "page-downgrade-post", "credential-theft", 24),
    (_any("secret_forms", f"lambda f: regexp_matches(regexp_replace(f.target, '^[A-Za-z]+://', ''), {_lit('(?i)^[^?#]*' + _TAKEN_TO[4:])})"), "page-exfil-endpoint", "credential-theft", 30),
    (_any("secret_forms", "lambda f: f.method = 'get' AND len(list_filter(f.inputs, lambda i: i.type = 'password')) > 0"), "page-password-in-url", "credential-theft", 18),
    ("fake IS NOT NULL AND (login OR fake.in_title)", "page-brand-impersonation", "domain", "CASE WHEN login THEN 27 ELSE 16 END"),
    (f"NOT official AND {_any('assets', f'lambda a: a <> rd AND list_contains({_list(K.OFFICIAL_DOMAINS)}, a)')}", "page-hotlinked-brand-assets", "domain", 17),
    ("len(regexp_extract_all(js, '\\b(eval|Function\\s*\\(|atob|unescape|decodeURIComponent\\s*\\(\\s*escape)\\b')) >= 3 OR regexp_matches(js, '(?i)(?:\\\\x[0-9a-f]{2}){12,}|(?:%[0-9a-f]{2}){20,}')", "page-obfuscated-script", "page", 15),
    (f"has_js AND regexp_matches(js || ' ' || html, {_lit(_NO_MENU)})", "page-right-click-blocked", "page", 11),
    (f"has_js AND regexp_matches(js, {_lit(_NO_PASTE)})", "page-paste-blocked", "page", 12),
    (f"has_js AND regexp_matches(js, {_lit(_SENT_OUT)})", "page-telegram-exfil", "credential-theft", 30),
    (f"has_js AND login AND regexp_matches(js, {_lit(_MOVED)})", "page-auto-redirect", "page", 8),
    (_any("frames", "lambda f: f.hidden AND f.src IS NOT NULL"), "page-hidden-iframe", "page", 16),
    ("login AND " + _any("frames", "lambda f: NOT f.hidden AND f.src IS NOT NULL AND f.site <> rd"), "page-framed-login", "page", 12),
    ("login AND " + _any("form_inputs", "lambda i: i.type = 'hidden' AND regexp_matches(i.name, 'email|mail|user|id|target|victim|bot|chat')"), "page-hidden-target-field", "page", 13),
    ("login AND len(anchors) >= 4 AND 10 * len(list_filter(anchors, lambda a: regexp_matches(a, '^#$|^javascript:void'))) > 6 * len(anchors)", "page-dead-navigation", "page", 12),
    ("login AND length(html) BETWEEN 1 AND 2499 AND NOT trusted", "page-thin-clone", "page", 10),
    (f"login AND NOT trusted AND NOT regexp_matches(body, {_lit(_LEGAL)})", "page-no-legal-pages", "page", 8),
    (f"regexp_matches(body, {_lit(_ALARMING)})", "page-alarming-copy", "social-engineering", 13),
    (f"NOT official AND regexp_matches(body, {_lit(_SECRET_CODE)})", "page-otp-capture", "credential-theft", 24),
    ("official", "page-official-domain", "positive", -22),
    ("trusted AND NOT official", "page-trusted-domain", "positive", -14),
)
_SEEN = ", ".join(f"CASE WHEN {when} THEN {{'id': '{name}', 'category': '{category}', 'weight': CAST({weight} AS INTEGER)}} END" for when, name, category, weight in _PAGE)
_OPENED = "regexp_extract(f, '(?i)<form\\b[^>]*>')"
SIGNAL_SQL["page_signal_table"] = f"""
    WITH {_SITES},
    placed AS (SELECT page_id, html, CASE page_id % 7 WHEN 3 THEN 'https://www.google.com/a/b' WHEN 5 THEN 'https://docs.python.org/b' ELSE url END AS url FROM sites),
    based AS (
        SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS root, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
               regexp_replace({_HOST_OF("url")}, '^www\\.', '') AS host FROM placed),
    sited AS (SELECT *, {registrable("host")} AS rd, {_plain(_HTML)} AS body, left(trim(regexp_replace({_plain("regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1)")}, '\\s+', ' ', 'g')), 200) AS title FROM based),
    read AS (
        SELECT *, list_contains({_list(K.OFFICIAL_DOMAINS)}, rd) AS official, list_contains({_list(K.TRUSTED_DOMAINS)}, rd) AS trusted, {canonical("body")} AS plain_body, {canonical("title")} AS plain_title,
               array_to_string(regexp_extract_all(html, '(?i)<script\\b[^>]*>([\\s\\S]*?)</script>', 1), chr(10)) AS js, {_inputs("html")} AS all_inputs,
               list_filter(list_transform(regexp_extract_all(html, {_ANCHOR}), lambda t: {_attribute("t", "href")}), lambda h: h IS NOT NULL AND h <> '') AS anchors,
               list_transform(regexp_extract_all(html, '(?i)<form\\b[^>]*>[\\s\\S]*?</form>'), lambda f: {{'opened': {_OPENED}, 'inputs': {_inputs("regexp_extract(f, '(?i)<form" + chr(92) + "b[^>]*>([" + chr(92) + "s" + chr(92) + "S]*?)</form>', 1)")}}}) AS forms0,
               list_transform(regexp_extract_all(html, '(?i)<img\\b[^>]*>'), lambda t: {_attribute("t", "src")}) AS images,
               list_transform(regexp_extract_all(html, '(?i)<iframe\\b[^>]*>'), lambda t: {{'src': {_attribute("t", "src")},
                   'hidden': regexp_matches(coalesce({_attribute("t", "style")}, ''), '(?i)display\\s*:\\s*none|visibility\\s*:\\s*hidden|opacity\\s*:\\s*0') OR coalesce({_attribute("t", "width")}, '') IN ('0', '1') OR coalesce({_attribute("t", "height")}, '') IN ('0', '1')}}) AS frames0 FROM sited),
    aimed AS (
        SELECT *, list_transform(forms0, lambda f: {{'action': nullif({_attribute("f.opened", "action")}, ''), 'method': lower(coalesce(nullif({_attribute("f.opened", "method")}, ''), 'get')), 'inputs': f.inputs}}) AS forms1, flatten(list_transform(forms0, lambda f: f.inputs)) AS form_inputs,
               list_transform(images, lambda s: {_absolute("s")}) AS pictures, list_transform(frames0, lambda f: {{'src': {_absolute("f.src")}, 'hidden': f.hidden}}) AS frames1, regexp_matches(js, '[^\\n]') AS has_js FROM read),
    targeted AS (SELECT *, list_transform(list_filter(forms1, lambda f: len(list_filter(f.inputs, lambda i: {_SECRET})) > 0), lambda f: {{'action': f.action, 'method': f.method, 'inputs': f.inputs, 'target': coalesce({_absolute("f.action")}, url)}}) AS forms2 FROM aimed),
    hosted AS (SELECT *, list_transform(forms2, lambda f: {{'action': f.action, 'method': f.method, 'inputs': f.inputs, 'target': f.target, 'host': {_HOST_OF("f.target")}}}) AS forms3 FROM targeted),
    facts AS (
        SELECT *, list_transform(forms3, lambda f: {{'action': f.action, 'method': f.method, 'inputs': f.inputs, 'target': f.target, 'host': f.host, 'site': {registrable("f.host")}}}) AS secret_forms,
               list_transform(list_filter(pictures, lambda s: s IS NOT NULL), lambda s: {registrable(_HOST_OF("s"))}) AS assets, list_transform(frames1, lambda f: {{'src': f.src, 'hidden': f.hidden, 'site': {registrable(_HOST_OF("coalesce(f.src, '')"))}}}) AS frames,
               len(list_filter(all_inputs, lambda i: i.type = 'password')) > 0 OR (regexp_matches(body, {_lit(_ENTER)}) AND len(all_inputs) + len(form_inputs) >= 2) AS login, list_filter([{_LIKENESS}], lambda b: b IS NOT NULL)[1] AS fake FROM hosted),
    found AS (SELECT page_id, scheme, login, list_filter([{_SEEN}], lambda x: x IS NOT NULL) AS f FROM facts),
    complete AS (SELECT page_id, CASE WHEN scheme = 'https' AND login AND len(list_filter(f, lambda x: x.weight >= 20)) = 0 THEN list_append(f, {{'id': 'page-https-login', 'category': 'positive', 'weight': CAST(-5 AS INTEGER)}}) ELSE f END AS f FROM found),
    laid AS (SELECT page_id, unnest(f) AS t FROM complete)
    SELECT page_id, t.id AS id, t.category AS category, t.weight AS weight FROM laid"""


_CLAIM = ("first_sites IS NOT NULL AND NOT list_contains(first_sites, rd)", "url-brand-mismatch", "domain", 20)
_AT = next(i for i, s in enumerate(_URL_SIGNALS) if s[1] == "url-credential-path")
_URL_CLAIMED = ", ".join(f"CASE WHEN {when} THEN {{'id': '{name}', 'category': '{category}', 'weight': CAST({weight} AS INTEGER)}} END" for when, name, category, weight in (*_URL_SIGNALS[:_AT], _CLAIM, *_URL_SIGNALS[_AT:]))
_GROUPS = " || ',' || ".join(f"coalesce(sum(weight) FILTER (WHERE weight > 0 AND category IN ({', '.join(map(_lit, categories))})), 0)" for _, categories in K.FEATURE_GROUPS)
_KIND = SIGNAL_SQL["message_types"]
SIGNAL_SQL["message_scores"] = f"""
    WITH {_PLAIN}, {_LINKS}, {_FORMS},
    counted AS (
        SELECT *, len(list_filter(string_split_regex(h3, '\\s+'), lambda w: w <> '')) AS words, regexp_replace(h0, '[^A-Za-z]', '', 'g') AS az,
               list_filter(list_transform(list_transform(urls, lambda u: {_HOST}), lambda h: {registrable("h")}), lambda s: s <> '') AS sites, list_filter([{_BRANDS}], lambda b: b IS NOT NULL) AS claimed FROM tactical),
    written AS (SELECT doc_id, claimed, urls, tactics, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS f FROM counted),
    text_signals AS (
        SELECT doc_id, generate_subscripts(tactics, 1) AS ord, 'tactic-' || unnest(tactics).id AS id, unnest(tactics).category AS category, unnest(tactics).weight AS weight FROM written
        UNION ALL SELECT doc_id, 100 + generate_subscripts(f, 1), unnest(f).id, unnest(f).category, unnest(f).weight FROM written),
    links AS (SELECT doc_id * 100 + generate_subscripts(urls[:12], 1) AS page_id, unnest(urls[:12]) AS url FROM written),
    {_URL_ROWS[_URL_ROWS.index("whole AS") :]},
    judged AS (SELECT t.*, w.claimed[1] AS first_sites FROM told t JOIN written w ON w.doc_id = t.page_id // 100),
    each_link AS (
        SELECT page_id, scheme, trusted, CASE WHEN scheme IN ('http', 'https') AND (p_host = '' OR regexp_matches(p_host, '[\\s<>^|%"`{{}}]')) THEN [{{'id': 'url-unparseable', 'category': 'url', 'weight': CAST(6 AS INTEGER)}}]
                                              ELSE list_filter([{_URL_CLAIMED}], lambda x: x IS NOT NULL) END AS f FROM judged),
    completed AS (SELECT page_id, CASE WHEN len(f) = 0 AND scheme = 'https' AND NOT trusted THEN [{{'id': 'url-clean', 'category': 'positive', 'weight': CAST(-6 AS INTEGER)}}] ELSE f END AS f FROM each_link),
    strewn AS (SELECT page_id // 100 AS doc_id, 1000 + page_id % 100 * 100 + generate_subscripts(f, 1) AS ord, unnest(f).id AS id, unnest(f).category AS category, unnest(f).weight AS weight FROM completed),
    firmest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY abs(weight) DESC, ord) AS r FROM strewn) WHERE r = 1),
    grave AS (SELECT doc_id, max(weight) AS most FROM firmest GROUP BY doc_id),
    link_signals AS (SELECT f.doc_id, f.ord, f.id, f.category, f.weight FROM firmest f JOIN grave g ON f.doc_id = g.doc_id WHERE f.category <> 'positive' OR g.most < 14),
    signals AS (SELECT * FROM text_signals UNION ALL SELECT * FROM link_signals),
    {_scores("signals", "doc_id")},
    rows AS (
        SELECT s.doc_id, string_agg(id, ',' ORDER BY weight DESC, ord) FILTER (WHERE weight > 0) AS risky_ids, {_GROUPS} AS points FROM signals s GROUP BY s.doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, weight > 0 ORDER BY abs(weight) DESC, ord) AS place FROM signals WHERE weight <> 0),
    told_of AS (
        SELECT doc_id, string_agg(CASE WHEN weight >= 22 THEN 'critical' WHEN weight >= 14 THEN 'high' WHEN weight >= 8 THEN 'moderate' ELSE 'low' END, ',' ORDER BY place) FILTER (WHERE weight > 0 AND place <= 8) AS severities,
               string_agg(id, ',' ORDER BY place) FILTER (WHERE weight < 0 AND place <= 5) AS trusts FROM ranked GROUP BY doc_id),
    kinds_of AS ({_KIND}),
    scored AS (
        SELECT w.doc_id, k.kind, coalesce(s.score, 0) AS score, coalesce(s.risky, 0) AS risky, coalesce(s.positives, 0) AS positives, coalesce(s.categories, 0) AS categories, coalesce(s.net, 0)::DOUBLE AS net, r.risky_ids, r.points, t.severities, t.trusts, least(12, len(w.urls)) AS n_links
        FROM written w JOIN kinds_of k ON w.doc_id = k.doc_id LEFT JOIN scores s ON w.doc_id = s.doc_id LEFT JOIN rows r ON w.doc_id = r.doc_id LEFT JOIN told_of t ON w.doc_id = t.doc_id),
    sure AS (
        SELECT *, CASE WHEN risky = 0 THEN 0.62::DOUBLE + least(0.14::DOUBLE, positives * 0.05::DOUBLE)
                       ELSE 0.5::DOUBLE + least(0.28::DOUBLE, categories * 0.07::DOUBLE) + least(0.2::DOUBLE, net / 250) - CASE WHEN score BETWEEN 35 AND 62 THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END END AS c FROM scored)
    SELECT doc_id, kind, CAST(score AS BIGINT) AS score, CASE WHEN score <= 30 THEN 'low' WHEN score <= 70 THEN 'medium' ELSE 'high' END AS level, floor(least(0.97::DOUBLE, greatest(0.35::DOUBLE, c)) * 100 + 0.5::DOUBLE) / 100 AS confidence,
           coalesce(risky_ids, '') AS risky, coalesce(severities, '') AS severities, coalesce(trusts, '') AS trust, coalesce(points, '{",".join("0" * len(K.FEATURE_GROUPS))}') AS group_points, CAST(n_links AS BIGINT) AS n_links FROM sure"""
