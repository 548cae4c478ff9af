"""URL and domain functions: Column in, Column out.  A URL is split once, by regular expressions, into a struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import knowledge as K
from .text import among, let, strings, text_or_empty

_IPV4 = r"^(?:\d{1,3}\.){3}\d{1,3}\z"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d|0\d\d?)"


def is_ipv4(host: Column) -> Column:
    return host.rlike(_IPV4) & F.forall(F.split(host, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(999)) <= 255)


def is_ipv6(host: Column) -> Column:
    return host.rlike(r"(?i)^\[?[0-9a-f:]+\]?\z") & host.contains(":")


def clean_host(host: Column) -> Column:
    """Lower case, without a final dot and a leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(host)), r"\.\z", ""), r"^www\.", "")


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def _registrable(h: Column) -> Column:
    return let(_labels(h), lambda labels: _joined(h, labels))


def _joined(h: Column, labels: Column) -> Column:
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when((h == "") | is_ipv4(h) | is_ipv6(h), h).when(F.size(labels) <= 2, F.array_join(labels, ".")).when(among(two, K.MULTI_PART_SUFFIXES), three).otherwise(two)


def registrable_domain(host: Column) -> Column:
    """The suffix and one label more; IP addresses and shorter names as they are."""
    return let(clean_host(host), _registrable)


def subdomain(host: Column) -> Column:
    before = lambda h, rd: F.when(h == rd, F.lit("")).otherwise(F.substring(h, F.lit(1), F.greatest(F.length(h) - F.length(rd) - 1, F.lit(0))))
    return let(clean_host(host), lambda h: let(_registrable(h), lambda rd: before(h, rd)))


def _suffix(rd: Column) -> Column:
    labels = F.split(rd, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    return F.when((F.size(labels) >= 3) & among(two, K.MULTI_PART_SUFFIXES), two).otherwise(F.element_at(labels, -1))


def top_level(host: Column) -> Column:
    return let(registrable_domain(host), _suffix)


def domain_label(host: Column) -> Column:
    """The registrable domain without its suffix."""
    without = lambda rd, tail: F.when(F.endswith(rd, tail), F.substring(rd, F.lit(1), F.length(rd) - F.length(tail))).otherwise(rd)
    return let(registrable_domain(host), lambda rd: let(F.concat(F.lit("."), _suffix(rd)), lambda tail: without(rd, tail)))


def same_site(a: Column, b: Column) -> Column:
    return (text_or_empty(a) != "") & (text_or_empty(b) != "") & (registrable_domain(a) == registrable_domain(b))


#: scheme, //, userinfo, host, port, path, query, fragment
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(//)?(?:([^/?#@]*(?:@[^/?#@]*)*)@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
PARSED = "struct<scheme:string,userinfo:string,host:string,port:string,path:string,query:string,href:string>"


def parse_url(url: Column) -> Column:
    """Struct scheme, userinfo, host, port, path, query (with ?), href; null for what is no address.

    Without a scheme http is assumed.  The scheme's usual port is dropped, the path of web addresses is at least /,
    blanks are escaped.  Hosts with blanks or other forbidden characters, brackets around anything but an IPv6 address,
    and web addresses without a host, are none.
    """
    return let(F.trim(F.regexp_replace(text_or_empty(url), "[\\t\\r\\n]", "")), lambda raw: let(_with_scheme(raw), lambda full: _parsed(raw, full)))


def _with_scheme(raw: Column) -> Column:
    full = F.when(raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), raw).otherwise(F.concat(F.lit("http://"), raw))
    return F.regexp_replace(full, r"(?i)^(https?):[/\\]*", "$1://")


def _parsed(raw: Column, full: Column) -> Column:
    web = full.rlike(r"(?i)^https?:")
    part = lambda i: F.regexp_extract(full, _PARTS, i)
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    opaque = ~web & ~full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")  # mailto:, javascript:, data:
    host = F.when(opaque, F.lit("")).otherwise(F.lower(part(4)))
    port = F.when(opaque, F.lit("")).otherwise(part(5))
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), F.lit("")).otherwise(port)
    path = F.when(opaque, F.regexp_extract(full, r"(?s)^[^:]*:([^?#]*)", 1)).otherwise(part(6))
    path = F.replace(F.when(web & (path == ""), F.lit("/")).otherwise(path), F.lit(" "), F.lit("%20"))
    query = F.replace(F.when(part(7) == "?", F.lit("")).otherwise(part(7)), F.lit(" "), F.lit("%20"))
    user = F.when(opaque, F.lit("")).otherwise(part(3))
    at = F.when(user == "", F.lit("")).otherwise(F.concat(user, F.lit("@")))
    colon = F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port))
    href = F.concat(scheme, F.when(opaque, F.lit(":")).otherwise(F.lit("://")), at, host, colon, path, query, part(8))
    bad = web & ((host == "") | host.rlike(r"[\s<>^|%\\\"`{}]") | (host.rlike(r"[\[\]]") & ~host.rlike(r"^\[[0-9a-f:.]+\]\z")) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535))
    dotted = host.rlike(_IPV4) & ~host.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z")
    return F.when(
        (raw == "") | bad | (web & dotted) | ~full.rlike(_PARTS), F.lit(None).cast(PARSED)
    ).otherwise(F.struct(scheme.alias("scheme"), user.alias("userinfo"), host.alias("host"), port.alias("port"), path.alias("path"), query.alias("query"), href.alias("href")))


def unescaped(c: Column) -> Column:
    """Percent escapes decoded; the raw text where one is malformed."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def parameters(query: Column) -> Column:
    """Array of structs key, value of a query string, in order, decoded."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    plain = lambda x: unescaped(F.replace(x, F.lit("+"), F.lit("%20")))
    return F.transform(pairs, lambda p: F.struct(plain(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("key"), plain(F.regexp_extract(p, r"(?s)^[^=]*=(.*)", 1)).alias("value")))


def in_private_range(host: Column) -> Column:
    """Whether a page at this address must not be fetched: loopback, private, link-local, carrier and reserved ranges
    of IPv4 (10/8, 127/8, 0/8, 172.16/12, 192.168/16, 169.254/16, 100.64/10, 224 and above), ::1, ::, fc, fd, fe80."""
    o = F.split(host, r"\.")
    a, b = (F.coalesce(F.get(o, i).try_cast("int"), F.lit(-1)) for i in (0, 1))
    v4 = a.isin(10, 127, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    bare = F.regexp_replace(F.lower(host), r"[\[\]]", "")
    return F.when(is_ipv4(host), v4).when(is_ipv6(host), bare.isin("::1", "::") | bare.rlike("^(fc|fd|fe80)")).otherwise(host.isin("localhost") | F.endswith(host, F.lit(".localhost")))


def free_hosting(host: Column) -> Column:
    """The first platform in list order that the host is, or lies under; null if none."""
    own = strings(K.FREE_HOSTING_HOSTS)
    return F.get(F.filter(own, lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h))), F.lit(0))
