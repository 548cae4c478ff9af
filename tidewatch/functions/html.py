"""HTML functions: visible text, attributes, and the structure of a page as nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx, urls
from .text import let, squeeze, text_or_empty

#: So many tags of a kind are looked at.
MOST_TAGS = 401

# The steps that turn markup into text, in order.
_STEPS = (
    (r"<script[\s\S]*?</script>", " "), (r"<style[\s\S]*?</style>", " "), (r"<noscript[\s\S]*?</noscript>", " "), (r"<!--[\s\S]*?-->", " "),
    (r"<br\s*/?>", "\n"), (r"</(p|div|tr|li|h[1-6])>", "\n"), (r"<[^>]+>", " "), (r"&nbsp;", " "), (r"&amp;", "&"), (r"&lt;", "<"),
    (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
)


def html_to_text(html: Column) -> Column:
    text = text_or_empty(html)
    for pattern, by in _STEPS:
        text = rx.replace(text, pattern, by)
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def attribute(tag: Column, name: str) -> Column:
    """The first value of name=..., quoted or not; null if the tag has none.  No border is asked for before the name."""
    pattern = rf"{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
    value = lambda found: F.concat(*[rx.extract(found, pattern, i) for i in (1, 2, 3)])
    return let(rx.extract(tag, pattern), lambda found: F.when(found != "", F.trim(value(found))))


def tags(html: Column, pattern: str) -> Column:
    return F.slice(rx.extract_all(html, pattern), F.lit(1), F.lit(MOST_TAGS))


def resolved(href: Column, base: Column) -> Column:
    """The absolute address of href on a page with this parsed address (null: localhost); null for none."""
    scheme, host = F.coalesce(base["scheme"], F.lit("http")), F.coalesce(base["host"], F.lit("localhost"))
    port = F.when(F.coalesce(base["port"], F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(":"), base["port"]))
    root = F.concat(scheme, F.lit("://"), host, port)
    path = F.coalesce(base["path"], F.lit("/"))
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    plain = F.regexp_replace(F.coalesce(base["href"], F.lit("http://localhost/")), r"#.*\z", "")

    def full(h: Column) -> Column:
        return (
            F.when(rx.matches(h, r"^[a-z][a-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h))
            .when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(F.startswith(h, F.lit("#")), F.concat(plain, h))
            .when(F.startswith(h, F.lit("?")), F.concat(root, path, h)).otherwise(F.concat(root, folder, h))
        )

    return let(href, lambda h: F.when(F.coalesce(h, F.lit("")) != "", urls.parse_url(full(h))["href"]))


def _input(tag: Column) -> Column:
    name = F.coalesce(F.nullif(attribute(tag, "name"), F.lit("")), attribute(tag, "id"), F.lit(""))
    kind = F.coalesce(F.nullif(attribute(tag, "type"), F.lit("")), F.lit("text"))
    return F.struct(F.lower(kind).alias("type"), F.lower(name).alias("name"))


def page_features(html: Column, base: Column) -> dict[str, Column]:
    """Columns by name: title, forms, loose_inputs, anchors, inline (script code), iframes, images, favicon.

    base is the page's parsed address, or null.  forms: action, resolved, method, inputs; anchors: href, raw, text;
    iframes: src, hidden.  At most MOST_TAGS of a kind.
    """
    source = text_or_empty(html)
    some = lambda x: F.nullif(x, F.lit(""))
    inputs = lambda part: F.transform(tags(part, r"<input\b[^>]*>"), _input)

    def form(whole: Column) -> Column:
        def of(opened: Column, action: Column) -> Column:
            inner = rx.extract(whole, r"<form\b[^>]*>([\s\S]*?)</form>", 1)
            return F.struct(
                some(action).alias("action"), F.coalesce(resolved(action, base), base["href"]).alias("resolved"),
                F.lower(F.coalesce(some(attribute(opened, "method")), F.lit("get"))).alias("method"), inputs(inner).alias("inputs"),
            )

        return let(rx.extract(whole, r"<form\b[^>]*>"), lambda opened: let(attribute(opened, "action"), lambda action: of(opened, action)))

    anchor_pattern = r"<a\b[^>]*href\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>([\s\S]*?)</a>"

    def anchor(whole: Column) -> Column:
        label = F.substring(squeeze(html_to_text(rx.extract(whole, anchor_pattern, 1))), 1, 120)
        return let(attribute(whole, "href"), lambda raw: F.struct(resolved(raw, base).alias("href"), some(raw).alias("raw"), label.alias("text")))

    def iframe(tag: Column) -> Column:
        small = lambda k: F.coalesce(attribute(tag, k), F.lit("")).isin("0", "1")
        style = F.coalesce(attribute(tag, "style"), F.lit(""))
        hidden = rx.matches(style, r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0") | small("width") | small("height")
        return F.struct(resolved(attribute(tag, "src"), base).alias("src"), hidden.alias("hidden"))

    icons = F.filter(tags(source, r"<link\b[^>]*rel\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>"), lambda t: rx.matches(F.coalesce(attribute(t, "rel"), F.lit("")), "icon"))
    return {
        "title": F.substring(squeeze(rx.extract(source, r"<title[^>]*>([\s\S]*?)</title>", 1)), 1, 200),
        "forms": F.transform(tags(source, r"<form\b[^>]*>[\s\S]*?</form>"), form),
        "loose_inputs": inputs(source),
        "anchors": F.filter(F.transform(tags(source, anchor_pattern), anchor), lambda a: a["raw"].isNotNull()),
        "inline": F.array_join(F.slice(rx.extract_all(source, r"<script\b[^>]*>([\s\S]*?)</script>", 1), F.lit(1), F.lit(MOST_TAGS)), "\n"),
        "iframes": F.transform(tags(source, r"<iframe\b[^>]*>"), iframe),
        "images": F.filter(F.transform(tags(source, r"<img\b[^>]*>"), lambda t: resolved(attribute(t, "src"), base)), lambda x: x.isNotNull()),
        "favicon": resolved(attribute(F.get(icons, F.lit(0)), "href"), base),
        "meta": F.filter(
            F.transform(tags(source, r"<meta\b[^>]*>"), lambda t: F.struct(F.lower(F.coalesce(some(attribute(t, "name")), attribute(t, "property"), F.lit(""))).alias("key"), F.coalesce(attribute(t, "content"), F.lit("")).alias("value"))),
            lambda m: m["key"] != "",
        ),
    }
